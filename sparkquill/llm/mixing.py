"""Mixing sources to target weights by Pfair scheduling (DataFrame operations only).

Each source's documents, in a fixed pseudo-random order, are cut into blocks of equal size. With an integer weight w of W
in all, block k of a source may not be released before slot floor(k * W / w) and is due by slot ceil((k + 1) * W / w). One
block is run in each slot: of the released ones, the one with the earliest deadline. Such a schedule exists and
earliest-deadline-first finds it, so after any number of slots each source is less than one block away from its share.
The schedule repeats after W slots, so one period, whose size depends on the weights alone, places every block: block k
of a source with weight w goes to period k div w. When a source has run out, its later slots stay empty and the others
keep their order: no row is dropped.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lookup, saved, table

#: Words in a block.
BLOCK_WORDS = 20_000
#: Documents that one task orders at once, about.
CHUNK_DOCS = 512
#: Most slots of a period: the sum of all sources' weights.
MOST_SLOTS = 1_000_000


def pfair(weights: dict[str, int]) -> list[tuple[str, int]]:
    """One period of the schedule: for each slot the source and the number of its block within the period."""
    weights = {s: int(w) for s, w in weights.items()}
    if any(w < 1 for w in weights.values()):
        raise ValueError("weights are positive integers")
    total = sum(weights.values())
    if total > MOST_SLOTS:
        raise ValueError(f"weights sum to {total}; at most {MOST_SLOTS} slots in a period")
    due = lambda s, k: -(-(k + 1) * total // weights[s])
    later: list = []  # (release, source, block)
    ready = sorted((due(s, 0), s, 0) for s in weights)
    out = []
    for t in range(total):
        while later and later[0][0] <= t:
            _, s, k = heapq.heappop(later)
            heapq.heappush(ready, (due(s, k), s, k))
        _, s, k = heapq.heappop(ready)
        out.append((s, k))
        if k + 1 < weights[s]:
            heapq.heappush(later, ((k + 1) * total // weights[s], s, k + 1))
    return out


def _sums(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _placed(docs: DataFrame, weights: dict[str, int] | None, default: int, block_words: int, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """All rows and columns of docs, with __source, __words, __key, __block and __slot."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")).cast("long")
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    own = docs.withColumns({"__source": F.coalesce(F.col(source_col), F.lit("")), "__words": words, "__key": key, "__row": F.monotonically_increasing_id()})
    slim = saved(spark, own.select("__source", "__key", "__words", "__row"), "mix-keys")
    sizes = {r[0]: r[1] for r in slim.groupBy("__source").count().limit(MOST_SLOTS + 1).collect()}
    weights = {s: (weights or {}).get(s, default) for s in sorted(sizes)}
    # prefix sums in two levels: within chunks of the order of keys, then over the chunks of a source
    digits = 1
    while max(sizes.values(), default=0) > CHUNK_DOCS * 16**digits and digits < 6:
        digits += 1
    # rows of equal source, id and text, if they are very many, have chunks of their own, behind the others of their prefix
    hot = slim.groupBy("__source", "__key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > CHUNK_DOCS)
    hot = saved(spark, hot.select("__source", "__key", F.ceil(F.col("__n") / CHUNK_DOCS).alias("__parts")), "mix-hot")
    n_hot = hot.count()

    def chunked(df: DataFrame) -> DataFrame:
        df = lookup(df, hot, ["__source", "__key"], n_hot, "left")
        part = F.pmod(F.xxhash64("__row"), F.col("__parts"))
        last = F.concat(F.lit("~"), "__key", F.lpad(part.cast("string"), 12, "0"))
        return df.withColumn("__chunk", F.concat(F.substring("__key", 1, digits), F.when(F.col("__parts").isNotNull(), last).otherwise(""))).drop("__parts")

    # equal rows have equal words, so it does not matter which of them a chunk gets
    own = chunked(own)
    within = F.sum("__words").over(_sums(["__source", "__chunk"], ["__key"])) - F.col("__words")
    chunks = chunked(slim).groupBy("__source", "__chunk").agg(F.sum("__words").alias("__total"))
    before = F.sum("__total").over(_sums(["__source"], ["__chunk"])) - F.col("__total")
    chunks = chunks.select("__source", "__chunk", before.alias("__base"))
    own = own.withColumn("__within", within).join(chunks, ["__source", "__chunk"])
    own = own.withColumn("__block", F.floor((F.col("__base") + F.col("__within")) / F.lit(block_words)).cast("long"))
    total = sum(weights.values())
    rows = [(s, k, t, weights[s]) for t, (s, k) in enumerate(pfair(weights))]
    period = spark.createDataFrame(rows or [("", 0, 0, 1)], "__source string, __k long, __t long, __w long")
    own = lookup(own, period.groupBy("__source").agg(F.max("__w").alias("__w")), ["__source"], len(rows))
    own = lookup(own.withColumn("__k", F.col("__block") % F.col("__w")), period.select("__source", "__k", "__t"), ["__source", "__k"], len(rows))
    return own.withColumn("__slot", F.floor(F.col("__block") / F.col("__w")).cast("long") * F.lit(total) + F.col("__t"))


def schedule(docs: DataFrame, weights: dict[str, int] | None = None, default: int = 1, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, n_words, block, slot, key): the place of every row; sort by (slot, key) to read the mix.

    Sources without an entry in weights get `default`. A null source is the source ''. A null or empty text has no words
    and stays in the block where it falls. A document longer than a block takes the slots of its first block. Documents of
    a source are ordered by key, the md5 of the id and the md5 of the text (a null id counts as the empty string); rows that
    repeat an id and text are interchangeable. An empty table gives no rows.
    """
    own = _placed(docs, weights, default, block_words, id_col, source_col, text_col)
    return own.select(F.col(id_col).alias("doc_id"), F.col("__source").alias("source"), F.col("__words").alias("n_words"), F.col("__block").alias("block"), F.col("__slot").alias("slot"), F.col("__key").alias("key"))


def mixed(docs: DataFrame, weights: dict[str, int] | None = None, default: int = 1, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs in the order of the mix (see schedule): ranges of slots a partition, sorted within."""
    out = _placed(docs, weights, default, block_words, id_col, source_col, text_col)
    return out.repartitionByRange("__slot", "__key").sortWithinPartitions("__slot", "__key").select(*docs.columns)


#: Target weights of the registered query: the first sources are wanted more often than the rest.
WEIGHTS = {"src0": 5, "src1": 3, "src2": 2}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(table(spark, sf_dir, "documents"), WEIGHTS).select("doc_id", "source", "n_words", "block", "slot")


# The SQL runs the scheduler itself, slot by slot, over the sources of the table.
SQL10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source,
  len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n_words, md5(doc_id::VARCHAR || ':' || md5(coalesce(text, ''))) AS key FROM documents),
b AS (SELECT doc_id, source, n_words, ((sum(n_words) OVER (PARTITION BY source ORDER BY key ROWS UNBOUNDED PRECEDING) - n_words) // {BLOCK_WORDS})::BIGINT AS block FROM d),
w AS (SELECT source, CASE source {" ".join(f"WHEN '{s}' THEN {w}" for s, w in WEIGHTS.items())} ELSE 1 END AS w FROM (SELECT DISTINCT source FROM d)),
n AS (SELECT sum(w)::BIGINT AS total FROM w),
run AS (SELECT -1::BIGINT AS t, map_from_entries(list((source, 0::BIGINT))) AS done, NULL::VARCHAR AS source, NULL::BIGINT AS k FROM w
  UNION ALL
  SELECT t + 1, map_concat(done, MAP {{pick: done[pick] + 1}}), pick, done[pick] FROM (
    SELECT r.t, r.done, (SELECT arg_min(w.source, (((r.done[w.source] + 1) * n.total + w.w - 1) // w.w, w.source)) FROM w, n
      WHERE r.done[w.source] < w.w AND (r.done[w.source] * n.total) // w.w <= r.t + 1) AS pick
    FROM run r, n WHERE r.t + 1 < n.total))
SELECT b.doc_id, b.source, b.n_words, b.block, ((b.block // w.w) * n.total + r.t)::BIGINT AS slot
FROM b JOIN w USING (source) CROSS JOIN n JOIN run r ON r.source = b.source AND r.k = b.block % w.w
"""
