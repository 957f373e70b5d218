"""Near-duplicate classes by MinHash with tensored banding, verified on full shingle sets.

Two collections of SIDE sub-keys are computed for each set; a sub-key is a tuple of TUPLE min-hashes. A table key is a
pair (one of the first, one of the second collection): SIDE * SIDE tables of 2 * TUPLE min-hashes from only
2 * SIDE * TUPLE min-hashes. A pair of sets of similarity s meets in a table with probability
(1 - (1 - s**TUPLE)**SIDE)**2, which for (6, 30) is 1 - 1.4e-6 at 0.85, 1 - 2.2e-4 at 0.80, and 0.14 at 0.5, 0.0005 at 0.3. A
table key can only be shared if both its sub-keys are, so only pairs of shared sub-keys are formed: sets with no near copy
form none.

Equal sets are collapsed to one representative first. In each table bucket every set is tied to the smallest one. Each set
is verified against the one it is tied to most often: these links join most near copies, at a cost that is linear. The
connected parts of all ties are the candidate clusters; where one has several verified parts left, pairs of different parts
are verified as well, block by block (a task holds at most two blocks, and two blocks of one part never meet), by counting
common shingles in a matrix product. Tasks return spanning forests of the verified links, never pairs. The classes are the
connected parts of these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, buffers, in_groups, lookup, mix, release, rolling, saved, small_batches, table, word_hashes, words

SHINGLE = 5
TUPLE, SIDE = 6, 30
#: Percent of the union that the intersection must reach.
PERCENT = 85
#: Sets in a block of a large cluster, about.
BLOCK = 256
_RNG = np.random.Generator(np.random.PCG64(977))
_A = (_RNG.integers(0, 2**31, 2 * TUPLE * SIDE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_B = _RNG.integers(0, 2**32, 2 * TUPLE * SIDE, dtype=np.uint32)


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, ascending, and where each text's begin (len(off) values)."""
    low = LOWER[buf]
    s, e, first = words(low, off)
    counts = np.diff(first)
    h = word_hashes(low, s, e)
    doc = np.repeat(np.arange(len(counts)), counts)
    runs = rolling(h, k)
    ok = doc[: len(runs)] == doc[k - 1 :] if len(runs) else np.zeros(0, bool)
    runs, of = runs[ok], doc[: len(runs)][ok]
    few = np.flatnonzero((counts > 0) & (counts < k))
    if len(few):  # the whole sequence as one
        whole = [mix(np.array([len(x) + 1000], np.uint64) + (np.cumsum(x * np.uint64(0x9E3779B97F4A7C15))[-1:] ^ rolling(x, len(x))))[0] for x in (h[first[i] : first[i + 1]] for i in few)]
        runs, of = np.concatenate([runs, np.array(whole, np.uint64)]), np.concatenate([of, few])
    by = np.lexsort((runs, of))
    runs, of = runs[by], of[by]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (of[1:] != of[:-1])
    runs, of = runs[new], of[new]
    return runs, np.searchsorted(of, np.arange(len(counts) + 1))


def sub_keys(runs: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sub-keys (texts with a shingle, 2 * SIDE) of non-empty sets; start: where each begins."""
    x = (runs >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(start), 2 * SIDE), np.uint64)
    for i in range(2 * SIDE):
        key = np.full(len(start), i + 1, np.uint64)
        for j in range(i * TUPLE, (i + 1) * TUPLE):
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + np.minimum.reduceat(x * _A[j] + _B[j], start))
        out[:, i] = key
    return out


_SIGNATURES = "doc long, n long, f1 long, f2 long, left array<long>, right array<long>"


def _signatures(batches):
    for b in batches:
        buf, off = buffers(b.column(1))
        for i, j in in_groups(off):
            runs, at = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            n = np.diff(at)
            has = np.flatnonzero(n)
            keys, f = np.zeros((0, 2 * SIDE), np.uint64), np.zeros((2, 0), np.uint64)
            if len(has):
                keys = sub_keys(runs, at[has])
                f = np.array([np.add.reduceat(mix(runs ^ np.uint64(c)), at[has]) for c in (0x1234567, 0x89ABCDE)])
            full = lambda v: pa.array(v.view(np.int64))
            pick = pa.array(np.where(n > 0, np.cumsum(n > 0) - 1, -1))
            pick = pa.array([None if p < 0 else p for p in pick.to_pylist()], pa.int64())
            side = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1) * SIDE, pa.int32()), full(np.ascontiguousarray(v).ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), full(f[0]).take(pick), full(f[1]).take(pick), side(keys[:, :SIDE]).take(pick), side(keys[:, SIDE:]).take(pick)],
                ["doc", "n", "f1", "f2", "left", "right"],
            )
    release()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex that each vertex of the edges (a, b) reaches.

    Every vertex points to its smallest neighbour; pointers are followed to their ends, the ends become the vertices of the
    next round, and only edges between different ends go on. A round at least halves the vertices that still have edges,
    and what a vertex with very many edges contributes is summed up before it is sent anywhere.
    """
    edges = saved(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    label = None
    while edges.limit(1).count():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = saved(spark, both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("label")), "ends")
        while True:  # a pointer to a pointer becomes a pointer to its end
            further = saved(spark, ends.where("v <> label").select(F.col("v").alias("label"), F.col("label").alias("further")).join(ends.select("label").distinct(), "label", "left_semi"), "further")
            n = further.count()
            if not n:
                break
            ends = saved(spark, lookup(ends, further, ["label"], n, "left").select("v", F.coalesce("further", "label").alias("label")), "ends")
        n = ends.count()
        step = ends.select(F.col("v").alias("label"), F.col("label").alias("further"))
        label = ends if label is None else saved(spark, lookup(label, step, ["label"], n, "left").select("v", F.coalesce("further", "label").alias("label")), "labels")
        for side in ("a", "b"):
            edges = lookup(edges, ends.select(F.col("v").alias(side), F.col("label").alias(f"{side}_end")), [side], n)
        edges = saved(spark, edges.where("a_end <> b_end").select(F.greatest("a_end", "b_end").alias("a"), F.least("a_end", "b_end").alias("b")).distinct(), "edges")
    return spark.createDataFrame([], "v long, label long") if label is None else label


def candidate_ties(spark: SparkSession, sets: DataFrame) -> DataFrame:
    """(a, b, c): each set of a table bucket tied to the smallest of the bucket, in c buckets."""
    sub = sets.select("doc", F.explode(F.concat(F.transform("left", lambda x: F.struct(F.lit(0).alias("side"), x.alias("key"))), F.transform("right", lambda x: F.struct(F.lit(1).alias("side"), x.alias("key"))))).alias("s")).select("doc", "s.side", "s.key")
    shared = sub.groupBy("side", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    own = sub.join(shared, ["side", "key"]).groupBy("doc").agg(F.collect_list(F.when(F.col("side") == 0, F.col("key"))).alias("l"), F.collect_list(F.when(F.col("side") == 1, F.col("key"))).alias("r"))
    pairs = own.select("doc", F.explode("l").alias("x"), "r").select("doc", "x", F.explode("r").alias("y")).select("doc", F.xxhash64("x", "y").alias("key"))
    pairs = saved(spark, pairs, "table-keys")
    low = pairs.groupBy("key").agg(F.min("doc").alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "b")
    return pairs.join(low, "key").where("doc <> b").groupBy(F.col("doc").alias("a"), "b").agg(F.count(F.lit(1)).alias("c"))


_LINKS = "a long, b long"


def _verify(percent: int):
    def forest(doc, size, low, high, sets) -> list[tuple[int, int]]:
        """Links among the sets, or between those of block low and of block high, as a forest (child, root)."""
        flat = np.concatenate(sets)
        of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        keep = count[column] > 1
        rank = np.cumsum(count > 1) - 1
        column, of = rank[column[keep]], of[keep]
        order = np.argsort(column, kind="stable")
        column, of = column[order], of[order]
        common = np.zeros((len(low), len(high)), np.float32)
        place = np.full((2, len(sets)), -1)
        place[0, low], place[1, high] = np.arange(len(low)), np.arange(len(high))
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            i, j = np.searchsorted(column, [c, c + 4096])
            x, y = np.zeros((len(low), 4096), np.float32), np.zeros((len(high), 4096), np.float32)
            for m, p in ((x, place[0]), (y, place[1])):
                there = p[of[i:j]] >= 0
                m[p[of[i:j]][there], column[i:j][there] - c] = 1
            common += x @ y.T
        common = common.astype(np.int64)
        a, b = np.nonzero(100 * common >= percent * (size[low][:, None] + size[high][None, :] - common))
        root = list(range(len(sets)))

        def find(v):
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        for u, v in zip(low[a].tolist(), high[b].tolist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                if doc[u] > doc[v]:
                    u, v = v, u
                root[v] = u
        return [(int(doc[v]), int(doc[find(v)])) for v in range(len(sets)) if find(v) != v]

    def run(rows: pa.Table) -> pa.Table:
        order = rows.select(["cluster", "i", "j"]).to_pandas()
        by = np.lexsort((order["j"], order["i"], order["cluster"]))
        order = order.to_numpy()[by]
        doc, block, data = rows["doc"].to_numpy()[by], rows["block"].to_numpy()[by], rows["set"].take(pa.array(by)).to_pylist()
        cuts = np.flatnonzero(np.any(order[1:] != order[:-1], axis=1)) + 1
        out = []
        for a, z in zip([0, *cuts], [*cuts, len(order)], strict=True):
            sets = [np.frombuffer(x, np.uint64) for x in data[a:z]]
            if len(sets) < 2:
                continue
            size, _, i, j = np.array([len(x) for x in sets]), *order[a]
            low, high = np.flatnonzero(block[a:z] == i), np.flatnonzero(block[a:z] == j)
            if len(low) and len(high):
                out += forest(doc[a:z], size, low, high, sets)
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return run


def _set_bytes(batches):
    for b in batches:
        buf, off = buffers(b.column(1))
        for i, j in in_groups(off):
            runs, at = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([runs[at[x] : at[x + 1]].tobytes() for x in range(j - i)], pa.binary())], ["doc", "set"])
    release()


def _verified(spark: SparkSession, rows: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Verified links (a, b) of the pairs that rows (doc, cluster, block, i, j) name: block i against block j of a cluster."""
    bundles = max(1, n // 100)
    bundle = F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(bundles)).cast("int").alias("bundle")
    with small_batches(spark):
        return saved(spark, rows.join(sets, "doc").select("*", bundle).groupBy("bundle").applyInArrow(_verify(percent), _LINKS), "links")


def _stars(best: DataFrame) -> DataFrame:
    """Rows for _verified: each set (a) against its hub; the members of a hub in blocks, the hub as block -1 beside each."""
    hubs = best.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    own = best.join(hubs, "hub").select(F.col("a").alias("doc"), F.col("hub").alias("cluster"), F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"))
    own = own.select("doc", "cluster", "block", F.lit(-1).alias("i"), F.col("block").alias("j"))
    centre = hubs.select(F.col("hub").alias("doc"), F.col("hub").alias("cluster"), F.lit(-1).alias("block"), F.lit(-1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    return own.unionByName(centre)


def _between(spark: SparkSession, members: DataFrame) -> DataFrame:
    """Rows for _verified: of clusters with several parts, every two blocks but those of one part. members: (doc, cluster, part).

    A part of BLOCK sets or more has blocks of its own; the others of a cluster share blocks.
    """
    several = members.groupBy("cluster").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("cluster")
    parts = saved(spark, members.join(several, "cluster").groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("c")), "parts")
    large = parts.where(F.col("c") >= BLOCK).select("cluster", "part", F.ceil(F.col("c") / F.lit(BLOCK)).cast("int").alias("blocks"))
    small = parts.where(F.col("c") < BLOCK)
    mixed = small.groupBy("cluster").agg(F.ceil(F.sum("c") / F.lit(BLOCK)).cast("int").alias("blocks"))
    of = large.unionByName(small.join(mixed, "cluster").select("cluster", "part", "blocks"))
    blocks = large.select("cluster", F.lit(True).alias("alone"), "part", "blocks").unionByName(mixed.select("cluster", F.lit(False).alias("alone"), F.lit(0).cast("long").alias("part"), "blocks"))
    blocks = blocks.select("cluster", "alone", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("r"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy("alone", "part", "r"))
    blocks = saved(spark, blocks.withColumn("block", place), "blocks")
    left, right = (blocks.select("cluster", F.col("alone").alias(f"{x}_alone"), F.col("part").alias(f"{x}_part"), F.col("block").alias(x)) for x in "ij")
    met = left.join(right, "cluster").where("i <= j and not (i_alone and j_alone and i_part = j_part)").select("cluster", "i", "j")
    legs = met.withColumn("block", F.col("i")).unionByName(met.where("i <> j").withColumn("block", F.col("j")))
    own = members.join(of, ["cluster", "part"]).select("doc", "cluster", "part", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("r"))
    alone = own.join(large.select("cluster", "part", F.lit(True).alias("alone")), ["cluster", "part"], "left")
    own = alone.select("doc", "cluster", "r", F.coalesce("alone", F.lit(False)).alias("alone"), F.when(F.col("alone"), F.col("part")).otherwise(F.lit(0)).alias("part"))
    own = own.join(blocks, ["cluster", "alone", "part", "r"]).select("doc", "cluster", "block")
    return own.join(legs, ["cluster", "block"]).select("doc", "cluster", "block", "i", "j")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Sets hold distinct runs of SHINGLE words, A-Z lower-cased; a text of fewer words has its whole sequence as one; null
    and empty texts have an empty set and are linked with nothing. Sets with 100 * intersection >= percent * union are
    linked (candidates are complete but for the probability above). component_id is the smallest doc_id reachable. Rows
    that repeat a doc_id each have their own row and n_shingles; those with words are joined through their id. Rows without
    a doc_id are linked with nothing and have no component_id; kept is true for them. Sets count as equal if their sizes
    and two 64-bit sums of hashes agree.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    known = own.where("doc is not null")
    with small_batches(spark):
        signed = saved(spark, known.mapInArrow(_signatures, _SIGNATURES), "signatures")
    # equal sets: the smallest document stands for all; a document that has several sets may stand for several
    same = signed.where("n > 0").groupBy("f1", "f2", "n")
    alone = saved(spark, same.agg(F.min("doc").alias("rep"), F.first("left").alias("left"), F.first("right").alias("right")), "distinct-sets")
    rep = alone.select("f1", "f2", "n", "rep")
    ties = saved(spark, candidate_ties(spark, alone.select(F.col("rep").alias("doc"), "left", "right")).where("a <> b"), "ties")
    cluster = components(spark, ties.select("a", "b")).select(F.col("v").alias("doc"), F.col("label").alias("cluster"))
    cluster = saved(spark, cluster, "clusters")
    n = cluster.count()
    # texts of the candidates; rows that repeat an id and text count once
    texts = lookup(known, cluster.select("doc"), ["doc"], n)
    if signed.where("n > 0").groupBy("doc").count().where("count > 1").limit(1).count():
        texts = texts.groupBy("doc", F.xxhash64("text").alias("h"), F.length("text").alias("k")).agg(F.first("text").alias("text")).select("doc", "text")
    with small_batches(spark):
        sets = saved(spark, texts.mapInArrow(_set_bytes, "doc long, set binary"), "member-sets")
    # the tie in most buckets, of several the smallest
    best = ties.groupBy("a").agg(F.max(F.struct("c", (-F.col("b")).alias("b"))).alias("m")).select("a", (-F.col("m.b")).alias("hub"))
    star = _verified(spark, _stars(saved(spark, best, "stars")), sets, n, percent)
    parts = components(spark, star).select(F.col("v").alias("doc"), F.col("label").alias("part"))
    members = saved(spark, lookup(cluster, parts, ["doc"], n, "left").select("doc", "cluster", F.coalesce("part", "doc").alias("part")), "members")
    links = star.unionByName(_verified(spark, _between(spark, members), sets, n, percent))
    # documents that have several sets
    held = signed.where("n > 0").join(rep, ["f1", "f2", "n"]).select("doc", "rep")
    low = held.groupBy("doc").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("doc", "low")
    links = links.unionByName(held.join(low, "doc").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct())
    label = components(spark, links)
    # back to all rows: representative, then its class
    out = signed.select("doc", "n", "f1", "f2").join(rep, ["f1", "f2", "n"], "left").join(label.withColumnRenamed("v", "rep"), "rep", "left")
    out = out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("label", "rep", "doc").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    lost = own.where("doc is null").mapInArrow(_signatures, _SIGNATURES).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(lost)


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL4 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS p FROM d),
g AS (SELECT doc_id, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS sh FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
s AS (SELECT DISTINCT doc_id, sh FROM g WHERE sh IS NOT NULL UNION ALL SELECT doc_id, array_to_string(words, ' ') AS sh FROM d WHERE len(words) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
r(v, u) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u),
m AS (SELECT v, min(u) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN m ON m.v = d.doc_id LEFT JOIN n USING (doc_id)
"""
