"""A training corpus from documents: toxicity, near duplicates, benchmark passages, mixing, token ids."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.llm import decontaminate, mixing, near_dup, token_coder, toxicity
from sparkquill.llm.common import saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. The classifier learns from the labelled documents among docs that are not held out.

    Null and empty texts stay unless the classes' prior says otherwise; rows without an id are scored like others.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.rejected(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the smallest id. Rows without an id stay."""
    gone = near_dup.near_duplicates(docs, percent=80).where("not kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(gone, docs.doc_id == gone["__id"], "left_anti")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix."""
    return mixing.mixed(docs, mixing.WEIGHTS)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written in the order in which the mix lies in its files, read back: doc_id, start, n_tokens,
    ids_crc32. Documents that come from no file are mixed first."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = saved(spark, mixing.mixed(docs, mixing.WEIGHTS), "mixed-again")
    return token_coder.encode_corpus(spark, docs, order_by=None)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_ids", write_ids),
]

#: A trained classifier and a token coder have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
