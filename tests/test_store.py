from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from sparkquill.conf import SearchConf
from sparkquill.errors import QuillError
from sparkquill.operators import admin
from sparkquill.operators.index import IndexSpec, build_index, build_inherited
from sparkquill.operators.search import search
from sparkquill.plans.query import BM25Query
from sparkquill.sources.store import IndexStore
from sparkquill.sources.tables import load_queries, read, store_queries, write
from sparkquill.sqlapi import register_functions, register_index
from sparkquill.streaming.ingest import ingest

SPEC = IndexSpec("s", ("text",), "simple", conf=SearchConf(segments_per_level=3))


def frame(spark, ids, salt=0):
    return spark.createDataFrame([(i, " ".join(f"w{(i * j + salt) % 5}" for j in range(1, 4 + i % 3))) for i in ids], "id long, text string")


def found(index, q="w1 w3"):
    return [(r.doc_id, r.score) for r in search(index, q).collect()]


def test_segments_equal_rebuild(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/i", SPEC)
    with pytest.raises(QuillError):
        store.open()
    for a in range(0, 20, 5):
        store.append(frame(spark, range(a, a + 5)))
    assert len(store.manifest["segments"]) < 4  # three were merged
    assert found(store.open()) == found(build_index(frame(spark, range(20)), SPEC))
    store.delete(spark.createDataFrame([(3,), (17,)], "id long"))
    store.append(frame(spark, [4, 5], salt=1))
    rest = frame(spark, [i for i in range(20) if i not in (3, 4, 5, 17)]).unionByName(frame(spark, [4, 5], salt=1))
    want = build_index(rest, SPEC)
    assert found(store.open()) == found(want)
    assert store.vacuum().collect()[0] == (18, 1) and found(store.open()) == found(want)
    assert found(IndexStore(spark, f"file://{tmp_path}/i", SPEC).open()) == found(want)
    assert store.memory_usage().count() == 1
    store.append(frame(spark, [3]))
    assert {i for i, _ in found(store.open())} >= {3}


def test_append_delete_update(spark):
    base = build_index(frame(spark, range(6)), SPEC)
    assert found(base.append(frame(spark, range(6, 9)))) == found(build_index(frame(spark, range(9)), SPEC))
    assert found(base.delete(spark.createDataFrame([(1,)], "x long"))) == found(build_index(frame(spark, [0, 2, 3, 4, 5]), SPEC))
    assert base.prewarm() > 0 and admin.summarize(base).first().n_docs == 6 and {r.term for r in admin.dump(base, 2).collect()} == {"w0", "w1"} and admin.memory_usage(base).count() == 3


def test_stream_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    frame(spark, range(4)).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    frame(spark, [2, 3, 4, 5]).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    store = IndexStore(spark, f"file://{tmp_path}/i", SPEC)
    for _ in range(2):
        stream = spark.readStream.schema("id long, text string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        ingest(stream, store, f"{tmp_path}/c").awaitTermination(120)
    assert found(store.open()) == found(build_index(frame(spark, range(6)), SPEC))


def test_sql(spark):
    register_functions(spark)
    register_index(build_index(frame(spark, range(6)), SPEC), "mine")
    rows = spark.sql("SELECT doc_id, score FROM mine_search('w1 w3', 3) ORDER BY rank").collect()
    assert [(r.doc_id, round(r.score, 6)) for r in rows] == [(i, round(s, 6)) for i, s in found(build_index(frame(spark, range(6)), SPEC))[:3]]
    r = spark.sql("SELECT osa_distance('ca', 'abc') a, html_to_text('<b>x</b>') b, markdown_to_text('*x*') c, bm25_terms('english', 'cats') d, to_bm25vector('i', 'simple', 'a a') e, to_bm25query('q', 'i') f").first()
    assert tuple(r) == (3, "x", "x", ["cat"], "i:{a:2}", "i:q")


def test_tables(spark, tmp_path):
    df = frame(spark, range(3))
    for kind in ("parquet", "orc", "json", "csv", "tsv"):
        write(df, f"{tmp_path}/{kind}", kind)
        assert read(spark, f"{tmp_path}/{kind}", kind, "id long, text string").count() == 3
    qs = {1: BM25Query("a", "i", True), 2: BM25Query("b", fuzzy=2)}
    store_queries(spark, qs).write.parquet(f"{tmp_path}/q")
    assert load_queries(spark.read.parquet(f"{tmp_path}/q")) == qs


def test_two_writers(spark, tmp_path):
    """The writer that comes second fails and leaves the first one's state."""
    root = f"file://{tmp_path}/i"
    one, two = IndexStore(spark, root, SPEC), IndexStore(spark, root, SPEC)
    one.append(frame(spark, range(4)))
    with pytest.raises(QuillError, match="another writer"):
        two.append(frame(spark, range(4, 8)))
    assert found(IndexStore(spark, root, SPEC).open()) == found(build_index(frame(spark, range(4)), SPEC))
    (tmp_path / "i" / "manifest" / "2").touch()  # a manifest that is not yet written does not count
    assert IndexStore(spark, root, SPEC).manifest["version"] == 1


def test_tombstones_go(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/i", SPEC)
    store.append(frame(spark, range(4)))
    store.delete(spark.createDataFrame([(1,)], "id long"))
    store.append(frame(spark, range(4, 6)))
    assert store.manifest["tombstones"]
    store.force_merge()
    assert not store.manifest["tombstones"] and found(store.open()) == found(build_index(frame(spark, [0, 2, 3, 4, 5]), SPEC))


def test_inherited(spark):
    parent = frame(spark, range(3))
    child = frame(spark, range(3, 6)).selectExpr("text", "'x' more", "id")
    assert found(build_inherited(parent, [child], SPEC)) == found(build_index(frame(spark, range(6)), SPEC))
    with pytest.raises(QuillError, match="no column text"):
        build_inherited(parent, [child.drop("text")], SPEC)


def test_far_positions(spark):
    """A phrase is found wherever it stands."""
    text = " ".join(f"v{i % 7}" for i in range(17_000)) + " red car v1"
    index = build_index(spark.createDataFrame([(1, text), (2, "red v0 car")], "id long, text string"), SPEC)
    assert [i for i, _ in found(index, BM25Query('"red car"', grammar=True))] == [1]
    assert found(index, BM25Query('"car red"', grammar=True)) == []


def test_fuzzy_limit(spark):
    with pytest.raises(QuillError, match="at most 2"):
        search(build_index(frame(spark, range(3)), SPEC), BM25Query("w1", fuzzy=3))


def test_sql_highlights(spark):
    register_functions(spark)
    r = spark.sql("SELECT bm25_snippet('a fox ran', 'fox', 'simple') a, bm25_snippet_positions('foxes ran', 'fox*', 'simple') b, bm25_headline('a red fox', '\"red fox\"', 'english').matches[0].match_type c, bm25_snippet(null, 'x', 'simple') d, bm25_phrase_prefix('red f') e").first()
    assert r.a == "a <b>fox</b> ran" and [tuple(x) for x in r.b] == [(0, 5)] and r.c == "phrase" and r.d is None and r.e == '"red f*"'


def test_formats_keep_odd_texts(spark, tmp_path):
    """Control characters at either end, empty and null texts, a text like null's sign; what white space is, as in SQL."""
    import oracle

    from sparkquill.catalogue import ORACLE_SQL, QUERIES

    odd = ["", None, " x ", "\x01", "\x0b", "x\x0b", "\x1f lead", "\x00", "a\x00b", "''", '"q"', "null", "#x", "a,b", "a\u0085b", "a\u2028b", "\ufeff", "N", "a\x0bb", "a.b", "\\"]
    (tmp_path / "sf").mkdir()
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/sf/documents.parquet")
    for kind in ("csv", "tsv"):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(odd) if t is None or not t.endswith("\\")], "id long, text string")
        write(df, f"{tmp_path}/{kind}", kind)
        assert sorted(map(tuple, read(spark, f"{tmp_path}/{kind}", kind, "id long, text string").collect())) == sorted(map(tuple, df.collect()))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/sf/documents.parquet/*.parquet'")
    oracle.compare(spark, con, f"{tmp_path}/sf", QUERIES["bm25_formats"], ORACLE_SQL["bm25_formats"])
