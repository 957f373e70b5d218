from __future__ import annotations

import pytest

from sparkquill.errors import QuillError
from sparkquill.functions import highlighting as h
from sparkquill.functions.markup import normalise
from sparkquill.operators.highlight import bm25_headline, bm25_snippet, bm25_snippet_positions
from sparkquill.operators.index import IndexSpec, build_index
from sparkquill.plans.query import BM25Query

PLAN = h.Plan("simple", frozenset({"hello"}))


def test_bytes_and_snippets():
    assert h.positions(h.Plan("simple", frozenset({"héllo"})), "héllo world") == [(0, 6)]
    assert h.snippet(PLAN, "Hello hello", "[", "]", limit=1, offset=1) == "Hello [hello]"
    assert h.snippet(PLAN, None) is None and h.snippet(PLAN, "") == "" == h.snippet(PLAN, "nothing")
    long = "é" * 100 + " hello " + "ü" * 100
    out = h.snippet(PLAN, long, max_num_chars=21)
    assert "<b>hello</b>" in out and len(out.encode()) <= 21 + 7 + 2
    for bad in ({"max_num_chars": 0}, {"offset": -1}):
        with pytest.raises(QuillError):
            h.snippet(PLAN, "hello", **bad)


def test_overlaps():
    plan = h.Plan("simple", frozenset({"search"}), (("search", ()),))
    text = "searching for search results in the search engine"
    assert h.positions(plan, text) == [(0, 9), (14, 20), (14, 20), (36, 42), (36, 42)]
    assert h.snippet(plan, text).count("<b></b>") == 2


def test_phrase_is_one_range():
    assert h.positions(h.Plan("simple", frozenset(), (), ((("hello", "world"), False),)), "Hello world") == [(0, 11)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "Hello world", "Hello brave world"), (3, "héllo world", None)], "id int, title string, body string")


def test_columns(docs):
    index = build_index(docs, IndexSpec("h", ("title", "body"), "simple"))
    q = BM25Query("title:hello body:brav*", grammar=True)
    r = {x.id: x.headline for x in bm25_headline(index, docs, q).collect()}
    assert r[1].body.snippet == "Hello <b>brave</b> world" and r[1].body.matches[0].term == "brav" and r[1].body.matches[0].match_type == "prefix"
    assert r[3].body.snippet is None and r[3].body.matches == [] and r[3].title.snippet == ""
    assert [x.snippet for x in bm25_snippet(index, docs.where("id = 1"), q, "body").collect()] == ["Hello <b>brave</b> world"]
    assert [[(p.start, p.end) for p in x.positions] for x in bm25_snippet_positions(index, docs.where("id = 1"), BM25Query('"hello world"', grammar=True), "title").collect()] == [[(0, 11)]]
    with pytest.raises(QuillError):
        bm25_snippet(index, docs, q)
    with pytest.raises(QuillError):
        bm25_headline(index, docs, q, ["title"])


@pytest.mark.parametrize(
    ("kind", "source", "words"),
    [
        ("html", "<p>Hello <b>wor</b>ld &amp; friends</p>", "Hello wor ld & friends"),
        ("html", '<script>alert("x")</script><p>safe</p><style>a{}</style>', "safe"),
        ("html", "&lt;em&gt;Salt &amp; pepper&lt;/em&gt;", "Salt & pepper"),
        ("html", '<a href="https://e.com">click</a><br>here', "click here"),
        ("markdown", "# Main\n\nSome **bo**ld and *italic*", "Main Some bo ld and italic"),
        ("markdown", "[click](https://e.com/x?q=1) ![alt](i.png)", "click alt"),
        ("markdown", "```python\ndef f():\n```\n- one\n- two\n---\n`code` &amp; &copy;", "def f(): one two code &"),
        ("markdown", "a_b_c \\*x\\*\n> quote", "a_b_c *x * quote"),
        ("plain", "<b>", "<b>"),
    ],
)
def test_markup(kind, source, words):
    assert normalise(kind, source).split() == words.split() and normalise(kind, None) is None


def test_markup_offsets_point_to_the_source():
    source = "<p>caf&eacute; <b>hello</b></p>"
    plan = h.Plan("simple", frozenset({"hello", "café"}), fmt="html")
    assert [source.encode()[a:z].decode() for a, z in h.positions(plan, source)] == ["caf&eacute;", "hello"]
