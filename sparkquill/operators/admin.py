"""Summaries and dumps of an index."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import Index


def summarize(index: Index) -> DataFrame:
    """One row (a row for each part): documents, terms, postings, lengths and settings."""
    by = index.part
    sums = [F.count(F.lit(1)).alias("n_terms"), F.sum("df").alias("n_postings"), F.max("df").alias("max_df")]
    terms = index.terms.groupBy(*by).agg(*sums) if by else index.terms.agg(*sums)
    # the tokens of the postings are the lengths' sum
    stats = index.stats_table.select(*by, "n_docs", "total_len", (F.col("total_len") / F.col("n_docs")).alias("avg_len"), F.col("total_len").alias("n_tokens"))
    none = F.lit(0).cast("long")
    terms, stats = (df.withColumns({c: F.coalesce(c, none) for c in df.columns if c not in (*by, "avg_len")}) for df in (terms, stats))
    both = stats.join(terms, by) if by else stats.crossJoin(F.broadcast(terms))  # one row by one row
    s = index.spec
    both = both.select(*by, "n_docs", "total_len", "avg_len", "n_terms", "n_postings", "n_tokens", "max_df")
    return both.withColumns({"k1": F.lit(s.k1), "b": F.lit(s.b), "text_config": F.lit(s.text_config), "fields": F.lit(",".join(s.names))})


def dump(index: Index, limit: int | None = None) -> DataFrame:
    """(field, term, df, doc_id, tf, positions) in dictionary order: a row for each posting, so no term is too frequent. limit:
    of terms."""
    names = F.element_at(F.array(*[F.lit(n) for n in index.spec.names]), F.col("field_idx") + 1)
    terms = index.terms.groupBy("field_idx", "term").agg(F.sum("df").alias("df"))
    if limit is not None:
        terms = terms.orderBy("field_idx", "term").limit(limit)
    out = index.postings.join(terms, ["field_idx", "term"]).orderBy("field_idx", "term", "doc_id")
    return out.select(names.alias("field"), "term", "df", "doc_id", "tf", "positions")


def memory_usage(index: Index) -> DataFrame:
    """(table_name, size_bytes): Catalyst's estimate of each table."""
    spark = index.docs.sparkSession
    size = lambda df: Decimal(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return spark.createDataFrame([("docs", size(index.docs)), ("postings", size(index.postings)), ("terms", size(index.terms))], "table_name string, size_bytes decimal(38,0)")
