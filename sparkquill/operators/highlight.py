"""Snippets, match positions and headlines of found documents: Arrow-batched, on the rows of a result only."""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QuillError
from ..functions import highlighting as h
from ..functions.analysis import analyze, normalise_word
from ..plans import grammar as g
from ..plans.query import BM25Query
from ..plans.resolve import _ascii_lower, expand_fuzzy, expand_prefix
from .index import Index, text_of
from .search import as_query

POSITIONS = "array<struct<start:int,end:int>>"
HEADLINE = "struct<snippet:string,positions:array<struct<start:int,end:int>>,matches:array<struct<start:int,end:int,term:string,matched_text:string,match_type:string>>>"


def highlight_plan(index: Index, query: str | BM25Query, field: str) -> h.Plan:
    """Query texts are always read with the grammar here."""
    spec, query, i = index.spec, as_query(query), index.field(field)
    exact, prefixes, phrases = set(), [], []
    for c in g.parse(query.text):
        if c.field is not None and len(spec.fields) > 1 and c.field not in spec.names:
            raise QuillError(f"field {c.field!r} does not exist")
        if c.field not in (None, field):
            continue
        if c.kind == g.TERM:
            for t in sorted({t for t, _ in analyze(spec.text_config, c.words[0])})[:1]:
                exact |= {x for x, _ in expand_fuzzy(index.words, i, t, query.fuzzy, spec.conf.max_fuzzy_expansions)} if query.fuzzy and len(t) >= spec.conf.min_fuzzy_term_len else {t}
        elif c.kind == g.PREFIX:
            p = _ascii_lower(c.words[0])
            # the reported term is the first expansion; with several fields it is the prefix itself
            names = tuple(expand_prefix(index.words, i, p, spec.conf.max_prefix_expansions)) if len(spec.fields) == 1 else ()
            prefixes.append((p, names))
        else:
            last = c.kind == g.PHRASE_PREFIX
            words = [w for part in c.words for w in ([part] if last and part is c.words[-1] else [x for x, _ in analyze("simple", part)])]
            terms = [normalise_word(spec.text_config, w) for w in (words[:-1] if last else words)]
            terms = [t for t in terms if t is not None] + ([_ascii_lower(words[-1])] if last else [])
            if terms:
                phrases.append((tuple(terms), last))
    return h.Plan(spec.text_config, frozenset(exact), tuple(prefixes), tuple(phrases), spec.format(field))


@lru_cache(maxsize=1024)
def text_plan(config: str, query: str) -> h.Plan:
    """A plan without an index: exact terms, prefixes and phrases of the query."""
    exact, prefixes, phrases = set(), [], []
    for c in g.parse(query):
        if c.kind == g.TERM:
            exact |= {t for t, _ in analyze(config, c.words[0])[:1]}
        elif c.kind == g.PREFIX:
            prefixes.append((_ascii_lower(c.words[0]), ()))
        else:
            last = c.kind == g.PHRASE_PREFIX
            words = [w for part in c.words for w in ([part] if last and part is c.words[-1] else [x for x, _ in analyze("simple", part)])]
            terms = [t for t in (normalise_word(config, w) for w in (words[:-1] if last else words)) if t is not None]
            terms += [_ascii_lower(words[-1])] if last else []
            if terms:
                phrases.append((tuple(terms), last))
    return h.Plan(config, frozenset(exact), tuple(prefixes), tuple(phrases))


def snippet_col(plan: h.Plan, text: Column, **options) -> Column:
    h.snippet(plan, "", **options)  # options are checked before any task runs

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: h.snippet(plan, t, **options))

    return run(text)


def spans(found) -> pa.Array:
    """POSITIONS of an iterable of lists of (start, end) or None: two numbers a span, whatever the size of a batch."""
    flat, offsets, null = array("i"), [0], []
    for own in found:
        for a, z in own or ():
            flat.append(a)
            flat.append(z)
        offsets.append(len(flat) // 2)
        null.append(own is None)
    ends = np.frombuffer(flat, np.int32).reshape(-1, 2) if flat else np.zeros((0, 2), np.int32)
    cells = pa.StructArray.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cells, mask=pa.array(null, pa.bool_()))


def positions_col(plan: h.Plan, text: Column, limit: int | None = None, offset: int = 0) -> Column:
    h.positions(plan, "", limit, offset)

    @F.arrow_udf(POSITIONS)
    def run(texts: pa.Array) -> pa.Array:
        return spans(h.positions(plan, t.as_py(), limit, offset) for t in texts)

    return run(text)


def headline_col(plan: h.Plan, text: Column) -> Column:
    @F.pandas_udf(HEADLINE)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([h.headline(plan, t) for t in texts], columns=["snippet", "positions", "matches"])

    return run(text)


def _raw(index: Index, df: DataFrame, field: str) -> Column:
    """The field's text before markup is normalised: plans normalise it themselves to keep offsets."""
    from dataclasses import replace

    return text_of(df, replace(index.spec, content_format="plain"), field)


def bm25_snippet(index: Index, df: DataFrame, query: str | BM25Query, field: str | None = None, out: str = "snippet", **options) -> DataFrame:
    """df with a snippet column. field may be left out where there is only one."""
    field = _one_field(index, field)
    return df.withColumn(out, snippet_col(highlight_plan(index, query, field), _raw(index, df, field), **options))


def bm25_snippet_positions(index: Index, df: DataFrame, query: str | BM25Query, field: str | None = None, out: str = "positions", **options) -> DataFrame:
    field = _one_field(index, field)
    return df.withColumn(out, positions_col(highlight_plan(index, query, field), _raw(index, df, field), **options))


def bm25_headline(index: Index, df: DataFrame, query: str | BM25Query, fields: list[str] | None = None, out: str = "headline") -> DataFrame:
    """df with a struct that has a headline for each field of the index."""
    fields = index.spec.names if fields is None else fields
    if len(fields) != len(index.spec.names):
        raise QuillError(f"a headline takes the {len(index.spec.names)} fields of the index")
    return df.withColumn(out, F.struct(*[headline_col(highlight_plan(index, query, n), _raw(index, df, f)).alias(n) for n, f in zip(index.spec.names, fields, strict=True)]))


def _one_field(index: Index, field: str | None) -> str:
    if field is None:
        if len(index.spec.fields) > 1:
            raise QuillError("name a field: the index has several")
        return index.spec.names[0]
    index.field(field)
    return field


class SearchResult:
    """Found (doc_id, score) rows with the query that found them, so that highlights need no further argument."""

    def __init__(self, index: Index, query: BM25Query, found: DataFrame):
        self.index, self.query, self.found = index, query, found

    def rows(self) -> DataFrame:
        """The found rows of the indexed table with their score."""
        if self.index.documents is None:
            raise QuillError("the index does not know its table")
        docs = self.index.documents
        return docs.join(self.found, docs[self.index.spec.id_col] == self.found.doc_id).drop("doc_id") if self.index.spec.id_col != "doc_id" else docs.join(self.found, "doc_id")

    def snippet(self, field: str | None = None, **options) -> DataFrame:
        return bm25_snippet(self.index, self.rows(), self.query, field, **options)

    def snippet_positions(self, field: str | None = None, **options) -> DataFrame:
        return bm25_snippet_positions(self.index, self.rows(), self.query, field, **options)

    def headline(self) -> DataFrame:
        return bm25_headline(self.index, self.rows(), self.query)
