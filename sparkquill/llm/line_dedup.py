"""Line deduplication over levelled, sorted runs of line hashes (DataFrame operations only).

Batches of documents come in descending order of their ids. Every batch is merge-anti-joined with the runs (both sides are
sorted by key): a key that no run holds is new, and the largest document of the batch that has it is the largest of all. The
batch then becomes one run at level 0: for each of its keys the number of its documents, and for the new ones that largest
document. When a level has FANOUT runs, they are merged into one run of the next level, so a corpus of B batches keeps about
FANOUT * log(B) runs. In the end the merged runs tell of every key how many documents hold it and which is the largest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, saved, table

FANOUT = 4
MIN_CHARS = 20
MIN_DOCS = 3
#: Lines that hold this share of all lines or more are few (at most 1 / share) and joined by broadcast.
HOT_SHARE = 1 / 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line):
    """The line stripped of ASCII white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, row, pos, k1, k2): the lines whose key has at least min_chars code points. k1, k2: 128 bits of the key; row: a
    hash of the text, to tell rows apart that repeat an id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    lines = lines.select("doc", "row", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return lines.select("doc", "row", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(0x5EED), "key").alias("k2"))


class LineRuns:
    """Levels of sorted runs (k1, k2, n_docs, last_doc); last_doc is null where an earlier run has the key."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, []

    def _write(self, run: DataFrame) -> DataFrame:
        return saved(self.spark, run.sortWithinPartitions("k1", "k2"), "line-run")

    @staticmethod
    def _merge(runs: DataFrame) -> DataFrame:
        return runs.groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def all(self) -> DataFrame | None:
        """One row a key over all runs."""
        out = None
        for r in self.runs():
            out = r if out is None else out.unionByName(r)
        return None if out is None else self._merge(out)

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of a batch (k1, k2, ...) whose key no run holds: sorted merge-anti-joins with the rows that first had a key."""
        for r in self.runs():
            batch = batch.join(r.where("last_doc is not null").select("k1", "k2").hint("merge"), ["k1", "k2"], "left_anti")
        return batch

    def add(self, batch: DataFrame) -> None:
        """Anti-join a keyed batch with the runs, add it as a run of level 0 and compact full levels. Batches come in
        descending order of ids. A document counts once, however many of its rows or lines have the key."""
        own = batch.select("k1", "k2", "doc").distinct().groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last_doc"))
        run = own
        if self.levels:
            own = saved(self.spark, own.sortWithinPartitions("k1", "k2"), "line-batch")
            new = self.unseen(own).select("k1", "k2", F.lit(0).cast("long").alias("n_docs"), "last_doc")
            run = self._merge(own.withColumn("last_doc", F.lit(None).cast("long")).unionByName(new))
        level, run = 0, self._write(run)
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            full, self.levels[level] = self.levels[level], []
            out = full[0]
            for r in full[1:]:
                out = out.unionByName(r)
            level, run = level + 1, self._write(self._merge(out))


def dedup_lines(docs: DataFrame, batches: int = 1, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", fanout: int = FANOUT) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) for every document.

    A key (see line_key) of at least min_chars code points found in at least min_docs documents loses all its lines but
    those of the largest doc_id that holds it. Null and empty texts have one empty line. An empty table gives no rows.
    Rows that repeat a doc_id are one document with all their lines, and each has its own row. Rows without a doc_id keep
    their lines and count for no key.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = docs.where("doc_id is not null")
    runs, lines = LineRuns(spark, fanout), None
    # batches by quantile of the id: contiguous ids let row-group statistics skip the rest of the input
    cuts = sorted({int(x) for x in known.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)}) if batches > 1 else []
    for low, high in reversed(list(zip([None, *cuts], [*cuts, None], strict=True))):
        part = known
        if low is not None:
            part = part.where(F.col("doc_id") >= low)
        if high is not None:
            part = part.where(F.col("doc_id") < high)
        part = saved(spark, keyed(part, min_chars=min_chars), "line-keys")
        runs.add(part)
        lines = part if lines is None else lines.unionByName(part)
    repeated = saved(spark, runs.all().where(F.col("n_docs") >= min_docs), "line-repeated")
    n, total = repeated.agg(F.count(F.lit(1)), F.sum("n_docs")).first()
    if n <= BROADCAST_ROWS:
        lost = lines.join(F.broadcast(repeated.drop("n_docs")), ["k1", "k2"])
    else:  # the most frequent keys would be hot
        bar = max(100, int(total * HOT_SHARE))
        hot = repeated.where(F.col("n_docs") >= bar).drop("n_docs")
        rest = repeated.where(F.col("n_docs") < bar).drop("n_docs")
        lost = lines.join(F.broadcast(hot), ["k1", "k2"]).unionByName(lines.join(rest, ["k1", "k2"]))  # at most total / bar hot rows
    lost = lost.where("last_doc > doc").groupBy("doc", "row").agg(F.collect_set("pos").alias("lost"))
    # sets of numbers are subtracted by hashing: linear in the lines
    own = docs.withColumn("row", F.xxhash64("text"))
    out = own.join(lost, (own.doc_id == lost.doc) & (own.row == lost.row), "left")
    pieces = F.split(F.col("text"), "\n", -1)
    stay = lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("lost")), lambda i: F.get(ls, i))
    kept = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(F.element_at(F.transform(F.array(pieces), stay), 1), "\n"))
    n_lines = (F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("long")
    return out.select("doc_id", n_lines.alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"), batches=4)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


SQL9 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.pos, k.line, r.last_doc IS NOT NULL AND r.last_doc > k.doc_id AS dropped FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
