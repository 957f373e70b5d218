from __future__ import annotations

import random

import pytest


def make(spark, rows, clash=True):
    """Documents with columns whose names operators use themselves."""
    extra = ", doc long, block int, bucket int, key string, lost string, kinds string, c long, label long, n long, slot long, words string, seed long" if clash else ""
    pad = (1, 2, 3, "k", "l", "k", 4, 5, 6, 7, "w", 8) if clash else ()
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *pad) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long" + extra)


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls, empty and long texts, ties, repeated rows, several sources, and clashing columns."""
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("Al", "be", "gam", "é", "ño") for b in ("fa", "ta", "ma", ".", ",x")]
    prose = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(n))
    rows = [(0, None, "a"), (1, "", None), (2, " \n\t ", "a"), (3, "one", "b"), (4, "One two", "b"), (5, "one", "a")]
    shared, base = prose(30), prose(80)
    for i in range(6, 40):
        kind = i % 6
        if kind == 0:
            text = base
        elif kind == 1:
            w = base.split()
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = "edit"
            text = " ".join(w)
        elif kind == 2:
            text = prose(rng.randint(1, 20)) + shared + prose(rng.randint(0, 20))
        else:
            text = prose(rng.randint(1, 60))
        rows.append((i, text, rng.choice("abc")))
    rows += [(40, prose(60_000), "c"), (41, "x" * 300_000, "c"), (42, "Copyright line that is long enough\nb\n" * 3, "a"), (43, "  copyright LINE that is long enough\t\nz", "a"), (44, "copyright line that is long enough", "b")]
    rows += [rows[10], rows[10]]  # repeated rows
    return make(spark, rows)


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])


@pytest.fixture(scope="session")
def texts(hard):
    return {r.doc_id: r.text for r in hard.select("doc_id", "text").collect()}
