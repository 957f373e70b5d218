"""SQL surface: temporary views of an index and scalar functions.

register_functions gives SQL the text functions, the builders of queries, and highlights of a text under a configuration (the
query is read with the grammar; no dictionary is at hand, so terms are exact, prefixes or phrases). register_index gives the
tables <name>_docs, <name>_postings, <name>_terms, <name>_stats and <name>_summary, and the table function
<name>_search(query, k) for plain queries on one field.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import QuillError
from .functions import analysis, fuzzy, highlighting, markup
from .operators.admin import summarize
from .operators.highlight import HEADLINE, POSITIONS, spans, text_plan
from .operators.index import Index
from .plans.grammar import has_grammar
from .plans.query import BM25Query, BM25Vector, bm25_phrase, bm25_phrase_prefix, bm25_prefix, to_bm25query


def register_functions(spark: SparkSession) -> list[str]:
    @F.pandas_udf("int")
    def osa(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else fuzzy.osa_distance(x, y, max(len(x), len(y))) for x, y in zip(a, b, strict=True)], dtype="Int32")

    @F.pandas_udf("string")
    def html_text(x: pd.Series) -> pd.Series:
        return x.map(lambda t: markup.normalise("html", t))

    @F.pandas_udf("string")
    def markdown_text(x: pd.Series) -> pd.Series:
        return x.map(lambda t: markup.normalise("markdown", t))

    @F.pandas_udf("array<string>")
    def terms(config: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([[t for t, _ in analysis.analyze(c, v)] for c, v in zip(config, x, strict=True)])

    @F.pandas_udf("string")
    def vector(index: pd.Series, config: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else str(BM25Vector.of(i, c, v)) for i, c, v in zip(index, config, x, strict=True)])

    @F.pandas_udf("string")
    def query(text: pd.Series, index: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else str(to_bm25query(t, i)) for t, i in zip(text, index, strict=True)])

    def builder(make):
        @F.pandas_udf("string")
        def build(x: pd.Series) -> pd.Series:
            return x.map(lambda t: None if t is None else str(make(t)))

        return build

    @F.pandas_udf("string")
    def snippet(text: pd.Series, query: pd.Series, config: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or q is None else highlighting.snippet(text_plan(c, q), t) for t, q, c in zip(text, query, config, strict=True)])

    @F.arrow_udf(POSITIONS)
    def positions(text: pa.Array, query: pa.Array, config: pa.Array) -> pa.Array:
        rows = ((t.as_py(), q.as_py(), c.as_py()) for t, q, c in zip(text, query, config, strict=True))
        return spans(None if t is None or q is None else highlighting.positions(text_plan(c, q), t) for t, q, c in rows)

    @F.pandas_udf(HEADLINE)
    def headline(text: pd.Series, query: pd.Series, config: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([highlighting.headline(text_plan(c, q or ""), t) for t, q, c in zip(text, query, config, strict=True)], columns=["snippet", "positions", "matches"])

    @F.pandas_udf("binary")
    def query_bytes(text: pd.Series, index: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else to_bm25query(t, i).to_bytes() for t, i in zip(text, index, strict=True)])

    @F.pandas_udf("string")
    def query_of_bytes(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else str(BM25Query.from_bytes(bytes(b))))

    @F.pandas_udf("binary")
    def vector_bytes(value: pd.Series) -> pd.Series:
        return value.map(lambda v: None if v is None else BM25Vector.parse(v).to_bytes())

    @F.pandas_udf("string")
    def vector_of_bytes(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else str(BM25Vector.from_bytes(bytes(b))))

    @F.pandas_udf("boolean")
    def grammar(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else has_grammar(t))

    binary = {"bm25query_to_bytes": query_bytes, "bm25query_from_bytes": query_of_bytes, "bm25vector_to_bytes": vector_bytes, "bm25vector_from_bytes": vector_of_bytes, "bm25_has_grammar": grammar}
    builders = {"bm25_prefix": builder(bm25_prefix), "bm25_phrase": builder(bm25_phrase), "bm25_phrase_prefix": builder(bm25_phrase_prefix)}
    marks = {"bm25_snippet": snippet, "bm25_snippet_positions": positions, "bm25_headline": headline}
    found = builders | marks | binary | {"osa_distance": osa, "html_to_text": html_text, "markdown_to_text": markdown_text, "bm25_terms": terms, "to_bm25vector": vector, "to_bm25query": query}
    for name, f in found.items():
        spark.udf.register(name, f)
    return sorted(found)


def register_index(index: Index, name: str | None = None) -> str:
    name = name or index.spec.name
    if not name.isidentifier():
        raise QuillError(f"{name!r} is no SQL identifier")
    for part, df in (("docs", index.docs), ("postings", index.postings), ("terms", index.terms), ("stats", index.stats_table), ("summary", summarize(index))):
        df.createOrReplaceTempView(f"{name}_{part}")
    if index.tokens is None:
        index.postings.select("doc_id", "term", "tf", "dlq").createOrReplaceTempView(f"{name}_words")
        tf = "sum(p.tf)"
    else:  # a row for each word: the query's words are taken out before anything is added up
        words = analysis.token_terms(index.spec.text_config, F.col("tokens"))
        index.tokens.select("doc_id", "dlq", F.explode_outer(words).alias("term")).createOrReplaceTempView(f"{name}_words")
        tf = "count(*)"
    if len(index.spec.fields) == 1 and index.spec.text_config == "simple" and not index.part:
        k1, b = index.spec.k1, index.spec.b
        index.docs.sparkSession.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION {name}_search(query STRING, k INT) RETURNS TABLE (doc_id BIGINT, score DOUBLE, rank INT) RETURN
WITH q AS (SELECT term, count(*) AS qf FROM (SELECT explode(regexp_extract_all(lower({name}_search.query), '[\\\\p{{L}}\\\\p{{N}}_]+', 0)) AS term) GROUP BY term),
p AS (SELECT /*+ BROADCAST(q) */ p.doc_id, p.term, p.dlq, {tf} AS tf FROM {name}_words p JOIN q ON q.term = p.term GROUP BY p.doc_id, p.term, p.dlq),
t AS (SELECT p.term, count(*) AS df FROM p GROUP BY p.term),
w AS (SELECT q.term, q.qf * ln(1 + (s.n_docs - t.df + 0.5) / (t.df + 0.5)) AS w, s.total_len / s.n_docs AS average FROM q JOIN t ON t.term = q.term CROSS JOIN {name}_stats s),
m AS (SELECT /*+ BROADCAST(w) */ p.doc_id, round(-sum(w.w * p.tf * {k1 + 1} / (p.tf + {k1} * ({1 - b} + {b} * p.dlq / w.average))), 10) AS score FROM p JOIN w ON w.term = p.term GROUP BY p.doc_id),
r AS (SELECT m.doc_id, m.score, row_number() OVER (ORDER BY m.score, m.doc_id) AS rank FROM m)
SELECT r.doc_id, r.score, r.rank FROM r WHERE r.rank <= {name}_search.k""")
    return name
