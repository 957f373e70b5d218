"""Scores against published values and a plain-Python oracle."""

from __future__ import annotations

import math
from collections import Counter

import pytest

from sparkquill.errors import QuillError
from sparkquill.functions.norms import quantised_length, quantised_length_col
from sparkquill.operators.index import IndexSpec, build_index
from sparkquill.operators.search import score_all, score_text, search, search_batch
from sparkquill.plans.query import BM25Query

GREETINGS = {1: "hello world", 2: "goodbye world", 3: "hello goodbye", 4: "world domination", 5: "hello"}


def frame(spark, texts, fields=("text",)):
    rows = [(i, *(t if isinstance(t, tuple) else (t,))) for i, t in texts.items()]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{f} string" for f in fields))


def found(df):
    return [(r.doc_id, round(r.score, 4)) for r in df.collect()]


@pytest.fixture(scope="module")
def greetings(spark):
    return build_index(frame(spark, GREETINGS), IndexSpec("g", ("text",), "simple"))


@pytest.mark.parametrize(("query", "want"), [("hello", [(5, -0.6588), (1, -0.5156), (3, -0.5156)]), ("goodbye", [(2, -0.8374), (3, -0.8374)]), ("domination", [(4, -1.3260)]), ("nothing", [])])
def test_published_scores(greetings, query, want):
    assert found(search(greetings, query)) == want


def test_every_row_and_batch_agree(spark, greetings):
    one = dict(found(search(greetings, "hello world")))
    assert dict(found(score_all(greetings, "hello world"))) == {i: one.get(i, 0.0) for i in GREETINGS}
    assert dict(found(score_text(greetings.documents, greetings.spec, "hello world"))) == {i: one.get(i, 0.0) for i in GREETINGS}
    batch = search_batch(greetings, spark.createDataFrame([(7, "hello world"), (8, None), (9, "")], "query_id int, text string"), 10).collect()
    assert {r.doc_id: round(r.score, 4) for r in batch} == one and {r.query_id for r in batch} == {7}


def test_repeated_words_count(greetings):
    once, twice = found(search(greetings, "hello")), found(search(greetings, "hello hello"))
    assert [i for i, _ in once] == [i for i, _ in twice] and twice[0][1] == pytest.approx(2 * once[0][1], abs=2e-4)


TITLES = {1: "spark", 2: "spark rules everywhere", 3: "machine learning", 4: "unrelated topic"}
BODIES = {4: "nothing notable to say here", 3: "spark is great", 2: "foo bar baz", 1: "lorem ipsum dolor sit amet"}


def test_fields_published_scores(spark):
    df = frame(spark, {i: (TITLES[i], BODIES[i]) for i in TITLES}, ("title", "body"))
    index = build_index(df, IndexSpec("f", ("title", "body"), "english"))
    assert found(search(index, BM25Query("title:spark", grammar=True))) == [(1, -0.8714), (2, -0.5754)]


@pytest.mark.parametrize(
    ("weights", "want"),
    [((), [(4, -1.710), (2, -0.726), (1, -0.693)]), ((10.0, 1.0), [(4, -7.948), (1, -6.931), (2, -0.726)]), ((1.0, 10.0), [(4, -10.859), (2, -7.262), (1, -0.693)])],
)
def test_field_weights_published_scores(spark, weights, want):
    heads = {4: "spark and rust", 3: "cats and dogs", 2: "database fundamentals", 1: "spark rules"}
    tails = {1: "rust is fast", 2: "spark is great", 3: "kittens are cute", 4: " ".join(["spark"] * 3)}
    index = build_index(frame(spark, {i: (heads[i], tails[i]) for i in heads}, ("title", "body")), IndexSpec("w", ("title", "body"), "english", field_weights=weights))
    assert [(r.doc_id, round(r.score, 3)) for r in search(index, "spark").collect()] == want


def test_quantised_lengths(spark):
    df = spark.range(0, 3000)
    for r in df.select("id", quantised_length_col(df.id).alias("q")).collect():
        assert r.q == quantised_length(r.id)
    table = sorted({quantised_length(n) for n in range(100_000)})
    assert all(quantised_length(x) == x for x in table) and table[:42] == [*range(40), 40, 42]


def test_long_documents_against_plain_python(spark):
    texts = {i: " ".join(f"w{(i * j) % 7}" for j in range(1, 30 + 41 * i)) for i in range(1, 9)}
    index = build_index(frame(spark, texts), IndexSpec("l", ("text",), "simple", k1=1.6, b=0.6))
    bags = {i: Counter(t.split()) for i, t in texts.items()}
    n, av = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    want = {}
    for i, b in bags.items():
        total = 0.0
        for w in ("w1", "w6"):
            df = sum(w in x for x in bags.values())
            if b[w]:
                total += math.log((n + 1) / (df + 0.5)) * b[w] * 2.6 / (b[w] + 1.6 * (0.4 + 0.6 * quantised_length(sum(b.values())) / av))
        if total:
            want[i] = -round(total, 6)
    assert {r.doc_id: round(r.score, 6) for r in search(index, "w1 w6").collect()} == want


def test_empty_and_null_rows(spark):
    df = frame(spark, {1: None, 2: "", 3: "...", 4: "word"})
    index = build_index(df, IndexSpec("e", ("text",), "simple"))
    assert index.stats.n_docs == 1 and found(search(index, "word")) == [(4, -0.2877)]
    assert found(search(build_index(df.where("id < 4"), IndexSpec("e", ("text",), "simple")), "word")) == []


@pytest.mark.parametrize("bad", [{"k1": 0.0}, {"b": 1.5}, {"field_weights": (1.0, 2.0)}, {"field_weights": (0.0,)}, {"text_config": ""}, {"text_config": "klingon"}, {"content_format": {"nope": "html"}}, {"content_format": "pdf"}])
def test_bad_options(bad):
    with pytest.raises(QuillError):
        IndexSpec(**{"name": "x", "fields": ("text",), "text_config": "simple", **bad})


def test_partitions_have_their_own_statistics(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "a c", "x"), (3, "a", "y"), (4, "d", "y"), (5, "d e", "y")], "id long, text string, p string")
    whole = build_index(df, IndexSpec("p", ("text",), "simple", partition_by="p"))
    for p in ("x", "y"):
        part = build_index(df.where(f"p = '{p}'"), IndexSpec("q", ("text",), "simple"))
        assert set(found(search(part, "a d"))) <= set(found(search(whole, "a d")))


def test_arrays_and_filters(spark):
    df = spark.createDataFrame([(1, ["red", None, "", "car"]), (2, None), (3, []), (4, ["blue car"])], "id long, tags array<string>")
    index = build_index(df, IndexSpec("a", ("tags",), "simple"))
    assert index.stats.n_docs == 2 and index.stats.total_len == 4
    assert [i for i, _ in found(search(index, BM25Query('"red car"', grammar=True)))] == [1]
    assert [i for i, _ in found(search(index, "car", 1, among=df.where("id = 4").select("id")))] == [4]
