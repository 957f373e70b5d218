"""Prefixes, fuzzy terms, phrases and stems."""

from __future__ import annotations

import re
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkquill.conf import SearchConf
from sparkquill.functions.analysis import analyze
from sparkquill.functions.fuzzy import osa_distance, osa_prefix_distance
from sparkquill.functions.stem import english
from sparkquill.operators.index import IndexSpec, build_index
from sparkquill.operators.search import phrase_matches, search
from sparkquill.plans.query import BM25Query, bm25_phrase, bm25_phrase_prefix, bm25_prefix
from sparkquill.plans.resolve import PhraseFilter, expand_fuzzy, expand_prefix


def brute(a: str, b: str) -> int:
    @cache
    def d(i, j):
        if not i or not j:
            return i + j
        out = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            out = min(out, d(i - 2, j - 2) + 1)
        return out

    return d(len(a), len(b))


@given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.integers(0, 4))
@settings(max_examples=300, deadline=None)
def test_osa(a, b, most):
    want = brute(a, b)
    assert osa_distance(a, b, most) == (want if want <= most else None)
    near = min((brute(a, b[:n]) for n in range(max(0, len(a) - most), min(len(b), len(a) + most) + 1)), default=99)
    assert osa_prefix_distance(a, b, most) == (near if near <= most else None)
    assert osa_distance("ca", "abc", 4) == 3


@pytest.fixture(scope="module")
def index(spark):
    texts = ["quick test of quickness", "quantum quasi quark", "apple pie", "queue of queues", "red car blue car green car", "a red and blue car", "qick tset"]
    return build_index(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), IndexSpec("t", ("text",), "simple"))


def ids(df):
    return {r.doc_id for r in df.collect()}


def test_prefix(index):
    assert ids(search(index, bm25_prefix("QU"))) == {0, 1, 3}
    assert expand_prefix(index.terms, 0, "qu", 3) == ["quantum", "quark", "quasi"] and expand_prefix(index.terms, 0, "z", 9) == []


def test_fuzzy(index):
    assert expand_fuzzy(index.terms, 0, "test", 1, 50) == [("test", 0), ("tset", 1)]
    assert ids(search(index, BM25Query("quick", fuzzy=1))) == {0, 6}
    exact, near = ({r.doc_id: r.score for r in search(index, BM25Query("tset", fuzzy=1)).collect()} for _ in range(2))
    assert exact == near and set(exact) == {0, 6} and exact[6] < exact[0]
    assert ids(search(index, BM25Query("quik*", grammar=True, fuzzy=1))) >= {0}
    assert ids(search(index, BM25Query("of", fuzzy=2))) == {0, 3}  # too short to be fuzzy


def test_phrases(index):
    assert ids(search(index, bm25_phrase("red car"))) == {4} and ids(search(index, bm25_phrase(["blue", "car"]))) == {4, 5}
    assert ids(search(index, bm25_phrase("car red"))) == set() and ids(search(index, bm25_phrase_prefix("car gr"))) == {4}
    assert ids(search(index, BM25Query('"red car" "blue car"', grammar=True))) == {4}
    assert ids(search(index, bm25_phrase_prefix("qu"))) == {0, 1, 3}


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=6), min_size=1, max_size=4), st.lists(st.sampled_from("abc"), min_size=1, max_size=3))
@settings(max_examples=8, deadline=None)
def test_phrases_against_scan(spark, docs, phrase):
    index = build_index(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "id int, text string"), IndexSpec("t", ("text",), "simple"))
    want = {i for i, d in enumerate(docs) if any(d[j : j + len(phrase)] == phrase for j in range(len(d)))}
    assert ids(phrase_matches(index, PhraseFilter((0,), tuple(phrase)))) == want


def test_stop_word_in_phrase_never_matches(spark):
    index = build_index(spark.createDataFrame([(1, "cats and dogs"), (2, "running cats")], "id int, text string"), IndexSpec("s", ("text",), "english"))
    assert ids(search(index, bm25_phrase("cats and dogs"))) == set() and ids(search(index, "run")) == {2}
    assert ids(search(index, bm25_phrase("runs cat"))) == {2}


@pytest.mark.parametrize(("word", "want"), [("running", "run"), ("quickly", "quick"), ("relational", "relat"), ("hopping", "hop"), ("hoping", "hope"), ("caresses", "caress"), ("flies", "fli"), ("ties", "tie"), ("agreed", "agre"), ("happy", "happi"), ("generously", "generous"), ("nationality", "nation"), ("skies", "sky"), ("databases", "databas")])
def test_english(word, want):
    assert english(word) == want


def test_positions_count_stop_words():
    assert analyze("english", "The cat and the dogs") == [("cat", 2), ("dog", 5)]
    assert [t for t, _ in analyze("simple", "a-b_c É.1")] == re.findall(r"\w+", "a b_c é 1") and analyze("simple", None) == []


def test_settings():
    with pytest.raises(ValueError, match="max_fuzzy_distance"):
        SearchConf(max_fuzzy_distance=9)
