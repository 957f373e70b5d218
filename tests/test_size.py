"""What makes queries grow no faster than their tables: no shuffle of tokens, bounded Python memory, one pass a need."""

from __future__ import annotations

import os
import sys
import tracemalloc

import duckdb
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import oracle  # noqa: E402

from sparkquill.catalogue import ORACLE_SQL, QUERIES, docs_index
from sparkquill.functions import analysis, fuzzy, markup
from sparkquill.operators import admin
from sparkquill.operators.index import IndexSpec, build_index
from sparkquill.operators.search import batch_scores, search_batch
from sparkquill.sources.store import IndexStore
from sparkquill.sources.tables import table


def plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


@pytest.fixture
def unspread(monkeypatch):
    """Tables stay where they lie, as large ones do."""
    monkeypatch.setattr("sparkquill.operators.index.SPREAD_BYTES", -1)


def test_batch_in_place(spark, sf, capsys, unspread):
    """no (query, document) row is shuffled, only the best of each task."""
    index, items = docs_index(spark, sf), table(spark, sf, "benchmark")
    assert "Exchange" not in plan(batch_scores(index, items, id_col="item_id"), capsys)
    top = plan(search_batch(index, items, 5, id_col="item_id"), capsys)
    assert top.count("Exchange") == 1 and "MapInArrow" in top.split("Exchange")[1]


def test_batch_odd_ids(spark):
    """Queries named by strings, without terms, null; documents without an id."""
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (None, "a"), (3, None), (4, "a b b")], "id long, text string")
    index = build_index(docs, IndexSpec("s", ("text",), "simple"))
    queries = spark.createDataFrame([("x", "a b zz"), ("y", ""), ("z", "qq"), ("w", None)], "query_id string, text string")
    got = [(r.query_id, r["rank"], r.doc_id) for r in search_batch(index, queries, 2).orderBy("query_id", "rank").collect()]
    assert got == [("x", 1, 1), ("x", 2, 4)]
    assert {(r.query_id, r.doc_id) for r in batch_scores(index, queries).collect()} == {("x", 1), ("x", 2), ("x", 4)}


def test_mrr_short_passages(spark, tmp_path):
    """only six words in a row make a document relevant, as in SQL."""
    docs = [(1, "a b c"), (2, "x a b c d e f g"), (3, "a b c d e"), (4, "q a b c d e f"), (5, None)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "a b c"), (8, "A b, c d e f z")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    oracle.compare(spark, con, str(tmp_path), QUERIES["bm25_mrr10"], ORACLE_SQL["bm25_mrr10"])


def test_fuzzy_candidates(spark):
    """built-in functions find all terms in reach and leave few to Python, which sees each once."""
    import itertools

    words = ["".join(w) for n in range(1, 6) for w in itertools.product("abc", repeat=n)]
    df = spark.createDataFrame([(w,) for w in words], "term string")
    for word, most in (("abca", 1), ("ab", 1), ("abc", 2)):
        near = {r[0] for r in df.where(fuzzy.near(df.term, word, most)).collect()}
        want = {w for w in words if fuzzy.osa_distance(word, w, most) is not None}
        assert want <= near and (most > 1 or want == near)


def test_english_memory():
    """tokens of a batch are arrays, not a Python object each."""
    texts = [" ".join(f"running{i % 50} the w{i * j % 999}" for j in range(100)) for i in range(1000)]
    own = pa.array([*texts, None, "", "The x " + "y" * 3000 + " z"])
    tracemalloc.start()
    got = analysis.analysed_texts("english", own)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20
    assert [[(t["term"], t["pos"]) for t in row] for row in got[-20:].to_pylist()] == [analysis.analyze("english", t) for t in own[-20:].to_pylist()]


def test_stream_keeps_texts_in_place(spark):
    """rows whose ids do not repeat are not moved; of an id that repeats, the latest row stays."""
    from sparkquill.streaming.ingest import one_row_an_id

    df = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, text string, at int")
    assert one_row_an_id(df, "id", None) is df
    more = df.unionByName(spark.createDataFrame([(1, "c", 2), (None, "d", 1), (None, "e", 2)], df.schema))
    assert sorted(r.text for r in one_row_an_id(more, "id", "at").collect()) == ["b", "c", "e"]


@pytest.mark.parametrize("name", ["bm25_vector", "bm25_positions"])
def test_postings_in_place(spark, sf, capsys, unspread, name):
    """Postings are made where a text lies."""
    assert "Exchange" not in plan(QUERIES[name](spark, sf), capsys)


def test_postings_of_slices(monkeypatch):
    """Postings do not depend on the slices in which they are made."""
    rows = [["b", "a", "b"], [], ["a"], ["é", "z", "é"]]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(rows)], ["doc_id", "tokens"])
    for most in (1, 3, 100):
        monkeypatch.setattr(analysis, "SLICE_TOKENS", most)
        got = [tuple(r.values()) for b in analysis.postings_rows([batch, batch.slice(3, 1)]) for r in b.to_pylist()]
        assert got == [(1, "a", 1, [2]), (1, "b", 2, [1, 3]), (3, "a", 1, [1]), (4, "z", 1, [2]), (4, "é", 2, [1, 3]), (4, "z", 1, [2]), (4, "é", 2, [1, 3])]


def test_segments_without_shuffle(spark, tmp_path, monkeypatch):
    """Segments are written and merged without moving postings, each file in order."""
    import glob

    import pyarrow.parquet as pq

    moved = []
    frame = type(spark.range(1))
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, *a: moved.append(a) or self)
    store = IndexStore(spark, f"file://{tmp_path}/i", IndexSpec("s", ("text",), "simple"))
    for k in (0, 10):
        store.append(spark.createDataFrame([(i + k, f"w{i} b a c{i % 2}") for i in range(8)], "id long, text string"))
    store.force_merge()
    files = glob.glob(f"{tmp_path}/i/segments/*/postings/*.parquet")
    keys = [[(t, d) for t, d in zip(x["term"].to_pylist(), x["doc_id"].to_pylist())] for x in map(pq.read_table, files)]
    assert not moved and all(k == sorted(k) for k in keys) and sum(map(len, keys)) == 4 * 16 * 2


def test_summary_without_positions(spark, sf, capsys, unspread):
    """a summary counts terms by text and makes no postings."""
    own = plan(admin.summarize(docs_index(spark, sf)), capsys)
    assert "collect_list" not in own and "MapInArrow" not in own and "doc_id" not in own


def test_markdown_without_spans(monkeypatch):
    """a text for an index needs no source span of each character."""
    source = "# A *b* `c` [d](e)\n\n> - x &amp; y\n```\n<i>z</i>\n```\n|a|b|\n|-|-|\n\\*q\n"
    want = markup.pieces("markdown", source).text()
    monkeypatch.setattr(markup, "Pieces", None)
    assert markup.normalise("markdown", source) == want


def test_sql_search_takes_words_first(spark, sf, capsys, unspread):
    """the SQL function makes no postings of words that are not asked for, and equal documents tie."""
    own = plan(QUERIES["bm25_sql_search"](spark, sf), capsys)
    assert "collect_list" not in own and "MapInArrow" not in own


def test_search_needs_no_positions(spark, sf, capsys, unspread):
    """plain terms reach the texts; tokens are words alone."""
    own = plan(QUERIES["bm25_except"](spark, sf), capsys)
    assert "struct(term" not in own and "Contains(" in own or "contains(" in own.lower()


def test_spans_memory():
    """match positions of a batch are arrays."""
    from sparkquill.operators.highlight import spans

    tracemalloc.start()
    got = spans([(j, j + 1) for j in range(100)] if i % 7 else None for i in range(4000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20 and got.null_count == 572 and got[1].as_py()[-1] == {"start": 99, "end": 100}
