"""Reading and writing document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.query import BM25Query


#: Text formats give every text back as it was: no space or control character is trimmed, and an empty text is not null.
#: Fields of tab-separated files are quoted by a noncharacter only, so quotes in them are ordinary signs.
_EXACT = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "nullValue": "\\N"}
_TEXT = {"csv": _EXACT, "tsv": {**_EXACT, "sep": "\t", "quote": "\ufdd0", "escape": "\ufdd0"}}
_EMPTY = {"csv": '""', "tsv": "\ufdd0\ufdd0"}


def read(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Parquet, ORC, JSON, CSV or tab-separated (format tsv) tables."""
    reader = spark.read.format("csv" if format == "tsv" else format).options(**{**_TEXT.get(format, {}), **options})
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", **options) -> None:
    df.write.format("csv" if format == "tsv" else format).options(**{**_TEXT.get(format, {}), **({"emptyValue": _EMPTY[format]} if format in _EMPTY else {}), **options}).mode(mode).save(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store_queries(spark: SparkSession, queries: dict[int, BM25Query]) -> DataFrame:
    """(id, q): queries in their binary form, for any file format."""
    return spark.createDataFrame([(i, bytearray(q.to_bytes())) for i, q in queries.items()], "id long, q binary")


def load_queries(df: DataFrame) -> dict[int, BM25Query]:
    return {r["id"]: BM25Query.from_bytes(bytes(r["q"])) for r in df.select("id", "q").toLocalIterator()}
