"""Structured Streaming into an index: each micro-batch becomes a segment.

A batch that is delivered again replaces its own documents, because a document id is indexed once: the later delivery wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import IndexStore


def latest(df: DataFrame, id_col: str, order_col: str | None) -> DataFrame:
    """One row an id: the one of the largest order_col, or any."""
    if order_col is None:
        return df.dropDuplicates([id_col])
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col(order_col).desc()))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def one_row_an_id(df: DataFrame, id_col: str, order_col: str | None) -> DataFrame:
    """The same rows, but only the latest of an id that several rows have. Ids are counted without the texts, and rows whose id
    is in no other row are not moved."""
    again = df.groupBy(id_col).count().where("count > 1").select(F.col(id_col).alias("__id"))
    if not again.limit(1).count():
        return df
    same = df[id_col].eqNullSafe(again["__id"])
    return df.join(again, same, "left_anti").unionByName(latest(df.join(again, same, "left_semi"), id_col, order_col))


def ingest(stream: DataFrame, store: IndexStore, checkpoint: str, order_col: str | None = None, **trigger) -> StreamingQuery:
    """Start indexing a stream of rows; trigger: as of writeStream.trigger (availableNow=True by default)."""

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        try:
            if df.limit(1).count():
                store.append(one_row_an_id(df, store.spec.id_col, order_col))
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
