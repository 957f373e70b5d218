"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

The n-grams are hashed. A feature is present or absent; its value is the log ratio of its smoothed counts in toxic and
other texts. A logistic regression is fitted over these values and interpolated with their mean weight. The fit uses a
bounded sample of labelled rows (SAMPLE); the score is computed for every text, whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, buffers, release, saved, small_batches, table

#: n-gram lengths in bytes, hash bits, most labelled rows of each class, passes and step of the fit.
GRAMS = (4, 6)
BITS = 18
SAMPLE = 2500
SAMPLE_BYTES = 8 << 20
EPOCHS = 40
_SALT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5, 0xB55A4F09, 0x8CB92BA7, 0x6C62272F], np.uint32)


def _features(text: np.ndarray, stamp: np.ndarray) -> np.ndarray:
    """The distinct n-gram slots of one text (bytes); stamp: scratch of 2**BITS int32."""
    low = LOWER[text].astype(np.uint32)
    found = []
    for n in GRAMS:
        k = len(low) - n + 1
        if k <= 0:
            continue
        h = np.full(k, n * 0x01000193 & 0xFFFFFFFF, np.uint32)
        for j in range(n):
            h = (h ^ low[j : j + k]) * _SALT[j]
            h ^= h >> np.uint32(15)
        found.append(h >> np.uint32(32 - BITS))
    if not found:
        return np.zeros(0, np.int64)
    slots = np.concatenate(found)
    ordinal = np.arange(len(slots), dtype=np.int32)
    stamp[slots] = ordinal
    return slots[stamp[slots] == ordinal].astype(np.int64)


def _pieces(text: np.ndarray, most: int = 1 << 20):
    """A long text in overlapping pieces, so that scratch memory is bounded."""
    step = most - max(GRAMS) + 1
    return [text[i : i + most] for i in range(0, max(1, len(text) - max(GRAMS) + 1), step)]


def _present(text: np.ndarray, stamp: np.ndarray) -> np.ndarray:
    parts = [_features(p, stamp) for p in _pieces(text)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


class Model:
    """weights of present features, bias; score = sigmoid(sum(weights) / sqrt(features) + bias)."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float64), float(bias)

    def score(self, slots: np.ndarray) -> float:
        z = self.bias + (self.weights[slots].sum() / np.sqrt(len(slots)) if len(slots) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, smooth: float = 1.0, ridge: float = 1e-4, beta: float = 0.9) -> Model:
    """Fit on the driver; texts are bounded by the caller. With one class only, the score is that class's prior for all."""
    stamp = np.zeros(1 << BITS, np.int32)
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros(1 << BITS), np.log(p / (1 - p)))
    rows = [_present(np.frombuffer(t.encode(), np.uint8), stamp).astype(np.int32) for t in texts]
    sizes = np.array([len(r) for r in rows])
    ends = np.cumsum(sizes)
    slots, size = np.concatenate(rows), 1 << BITS
    del rows
    # runs of texts whose features are handled at once, so that temporary arrays stay small
    cuts = np.unique(np.searchsorted(ends, np.arange(0, len(slots) + 1, 1 << 19), "left"))
    runs = [(i, j, ends[i] - sizes[i], ends[j - 1]) for i, j in zip(cuts, [*cuts[1:], len(sizes)], strict=True) if j > i]
    if runs and runs[0][0] > 0:
        runs.insert(0, (0, runs[0][0], 0, runs[0][2]))
    root = np.sqrt(np.maximum(sizes, 1))

    def margins(weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(y))
        for i, j, a, z in runs:
            out[i:j] = np.bincount(np.repeat(np.arange(j - i), sizes[i:j]), weights=weights[slots[a:z]], minlength=j - i)
        return out / root

    def totals(each: np.ndarray) -> np.ndarray:
        out = np.zeros(size)
        for i, j, a, z in runs:
            out += np.bincount(slots[a:z], weights=np.repeat(each[i:j], sizes[i:j]), minlength=size)
        return out

    pos, neg = totals(y) + smooth, totals(1 - y) + smooth
    # share of the texts of a class that have the feature
    ratio = np.log(pos / (y.sum() + 2 * smooth)) - np.log(neg / ((1 - y).sum() + 2 * smooth))
    ratio[(pos + neg) <= 2 * smooth + 2] = 0.0  # seen in two texts or fewer
    per_class = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, bias = np.ones(size) * 0.5, 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, epochs + 1):
        g = (1 / (1 + np.exp(-np.clip(margins(w * ratio) + bias, -40, 40))) - y) * per_class
        gw = totals(g / root) * ratio + ridge * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-12)
        bias -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-12)
    seen = (pos + neg) > 2 * smooth
    mean = np.abs(w[seen]).mean() if seen.any() else 0.0
    w = (1 - beta) * mean + beta * w
    w *= ratio
    z = margins(w)
    for _ in range(60):  # the bias anew, for classes of equal weight
        p = 1 / (1 + np.exp(-np.clip(z + bias, -40, 40)))
        g, h = ((p - y) * per_class).sum(), (p * (1 - p) * per_class).sum()
        bias -= np.clip(g / max(h, 1e-6), -2, 2)
    return Model(w, bias)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list:
    """(text, label) of at most `sample` rows of each class and SAMPLE_BYTES bytes, in order of a hash of the id.

    Rows that repeat an id and text count once. Rows without an id, text or label, and labels other than 0 and 1, are left out; of labels that repeat an id the largest
    counts. A text that does not fit in what is left of its class's bytes is passed over and the sample goes on behind it; one
    above half of SAMPLE_BYTES never fits and takes no place among the `sample` rows.
    """
    own = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("__label"))
    full = docs.select("doc_id", "text", F.xxhash64("text").alias("t")).where("text is not null and text <> ''")
    # before the join: it shuffles numbers, not texts
    rows = full.select("doc_id", "t", F.xxhash64("doc_id").alias("o"), F.octet_length("text").alias("n")).join(own, "doc_id")
    out = []
    for label in (0, 1):
        keys = rows.where((F.col("__label") == label) & (F.col("n") <= SAMPLE_BYTES // 2)).select("doc_id", "o", "t", "n").distinct().orderBy("o", "doc_id", "t").limit(sample)
        size, chosen = 0, []
        for r in keys.collect():  # four numbers a row, at most `sample` rows; their texts come below
            if size + r["n"] <= SAMPLE_BYTES // 2:
                size += r["n"]
                chosen.append(r)
        if not chosen:
            continue
        wanted = docs.sparkSession.createDataFrame(chosen, keys.schema).select("doc_id", "t").distinct()
        found = full.join(F.broadcast(wanted), ["doc_id", "t"]).distinct()
        texts = {(r["doc_id"], r["t"]): r["text"] for r in found.toLocalIterator()}
        out += [(texts[r["doc_id"], r["t"]], label) for r in chosen]
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row. Null and empty texts have no n-gram and get the bias alone. Equal texts, equal scores."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights, model.bias))  # 2**BITS numbers

    def run(batches):
        m, stamp = Model(*shared.value), np.zeros(1 << BITS, np.int32)
        for b in batches:
            buf, off = buffers(b.column(1))
            out = [m.score(_present(buf[off[i] : off[i + 1]], stamp)) for i in range(len(off) - 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])
        release()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with small_batches(spark):  # holds for what runs within
        return saved(spark, own.mapInArrow(run, "doc_id long, score double"), "toxicity-scores")


def held_out(column: str = "doc_id"):
    """Whether a row's label is kept from training; false for a row without an id, which has no label."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows that are not held out."""
    rows = training_rows(docs, labels.where(~held_out()))
    return fit([r[0] for r in rows], [r[1] for r in rows])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents. Null and empty texts get the score of the bias alone; rows that repeat an id are
    scored each by its own text; without labels every score is 0.5, with labels of one class that class's smoothed share."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def rejected(docs: DataFrame, model: Model, bar: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text scores below bar. Rows are scored where they lie: nothing is shuffled. Null
    and empty texts have the score of the bias alone; rows that repeat an id, or have none, are judged by their own text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights, model.bias))
    place = docs.columns.index("text")

    def run(batches):
        m, stamp = Model(*shared.value), np.zeros(1 << BITS, np.int32)
        for b in batches:
            buf, off = buffers(b.column(place))
            yield b.filter(pa.array([m.score(_present(buf[off[i] : off[i + 1]], stamp)) < bar for i in range(len(off) - 1)], pa.bool_()))
        release()

    with small_batches(spark):
        return saved(spark, docs.mapInArrow(run, docs.schema), "toxicity-kept")
