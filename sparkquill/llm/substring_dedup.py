"""Exact substring deduplication: Rabin-Karp hashes of every fixed-length word window, merged into removal intervals.

Rows are dealt into blocks of bounded size by a hash of their id and text. Each block sends, for every window hash that occurs
in it, one entry (hash, smallest document of the block) to the hash's bucket, packed and compressed: a window that a third
of all documents share arrives once a block. A bucket finds the smallest document of every hash and answers each block
with one bit an entry: does a smaller document of another block hold this window? With its bits each block marks the
windows to remove, unites them into maximal intervals of words and drops these. Text crosses the network once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, rolling, table, text_bytes, word_hashes, words

WINDOW = 13
#: Bytes of text in a block and, about, behind a bucket of hashes.
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 12 << 20
_NO_ID = -(1 << 63)


def _pack(x: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _unpack(x: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class _Block:
    """The windows of one block: doc ids in ascending order, hashes in ascending order."""

    def __init__(self, rows: pa.Table, window: int):
        order = np.argsort(rows["doc"].to_numpy(), kind="stable")
        self.ids = rows["doc"].to_numpy()[order]
        text, off = buffers(rows["text"].take(pa.array(order)))
        texts = np.arange(len(off) - 1)
        self.buf = np.full(len(text) + len(texts), 32, np.uint8)  # a space after each text
        self.buf[np.arange(len(text)) + np.repeat(texts, np.diff(off))] = text
        self.off = off + np.arange(len(off))
        self.s, self.e, self.first = words(self.buf, self.off)
        counts = np.diff(self.first)
        doc = np.repeat(np.arange(len(counts)), counts)
        hashes = rolling(word_hashes(self.buf, self.s, self.e), window)
        self.at = np.flatnonzero(doc[: len(hashes)] == doc[window - 1 :]) if len(hashes) else np.zeros(0, np.int64)
        self.doc = doc[self.at]
        hashes = hashes[self.at]
        by = np.argsort(hashes, kind="stable")  # windows are in order of documents: the first of a run has the smallest id
        ordered = hashes[by]
        new = np.ones(len(by), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        self.distinct = ordered[new]
        self.least = self.ids[self.doc[by[new]]] if len(by) else np.zeros(0, np.int64)
        self.which = np.empty(len(by), np.int64)
        self.which[by] = np.cumsum(new) - 1


def _edges(distinct: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket b holds distinct[edges[b] : edges[b + 1]]."""
    step = (1 << 64) // buckets
    bounds = np.array([b * step for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(distinct, bounds), [len(distinct)]]).astype(np.int64)


_ENTRIES = "bucket int, block int, hashes binary, ids binary, least binary"


def _entries(window: int, buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        b = _Block(rows, window)
        block = rows["block"][0].as_py()
        edges = _edges(b.distinct, buckets)
        out = {"bucket": [], "block": [], "hashes": [], "ids": [], "least": []}
        for k in np.flatnonzero(np.diff(edges)):
            own = slice(edges[k], edges[k + 1])
            ids, place = np.unique(b.least[own], return_inverse=True)
            out["bucket"].append(int(k))
            out["block"].append(block)
            out["hashes"].append(_pack(np.diff(b.distinct[own], prepend=np.uint64(0))))
            out["ids"].append(_pack(np.diff(ids, prepend=0)))
            out["least"].append(_pack(place.astype(np.uint16 if len(ids) < 1 << 16 else np.uint32)))
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(out.items(), kinds, strict=True)})

    return run


_BITS = "block int, bucket int, bits binary"


def _losers(rows: pa.Table) -> pa.Table:
    """For each block of the bucket one bit an entry: a smaller document of another block has the window."""
    hashes, least, sizes = [], [], []
    for h, ids, place in zip(rows["hashes"], rows["ids"], rows["least"], strict=True):
        ids = np.cumsum(_unpack(ids.as_py(), np.int64))
        h = np.cumsum(_unpack(h.as_py(), np.uint64), dtype=np.uint64)
        least.append(ids[_unpack(place.as_py(), np.uint16 if len(ids) < 1 << 16 else np.uint32)])
        hashes.append(h)
        sizes.append(len(h))
    h, d = np.concatenate(hashes), np.concatenate(least)
    del hashes, least
    by = np.argsort(h, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], h[by][1:] != h[by][:-1]]))
    low = np.minimum.reduceat(d[by], starts)
    lose = np.empty(len(h), bool)
    lose[by] = d[by] > np.repeat(low, np.diff(starts, append=len(h)))
    cuts = np.cumsum(sizes)[:-1]
    parts = np.split(lose, cuts)
    keep = [i for i, p in enumerate(parts) if p.any()]
    return pa.table({"block": rows["block"].combine_chunks().take(pa.array(keep, pa.int64())), "bucket": rows["bucket"].combine_chunks().take(pa.array(keep, pa.int64())), "bits": pa.array([np.packbits(parts[i]).tobytes() for i in keep], pa.binary())})


_RESULT = "doc_id long, n_words long, n_removed long, intervals array<struct<start:int,end:int>>, kept_text string"


def _removed(window: int, buckets: int, with_text: bool):
    def run(rows: pa.Table, bits: pa.Table) -> pa.Table:
        b = _Block(rows, window)
        edges = _edges(b.distinct, buckets)
        lose = np.zeros(len(b.distinct), bool)
        for k, x in zip(bits["bucket"].to_pylist(), bits["bits"].to_pylist(), strict=True):
            n = edges[k + 1] - edges[k]
            lose[edges[k] : edges[k + 1]] = np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)
        gone = lose[b.which] | (b.ids[b.doc] > b.least[b.which]) if len(b.which) else np.zeros(0, bool)
        n = len(b.s)
        level = np.zeros(n + 1, np.int32)
        np.add.at(level, b.at[gone], 1)
        np.add.at(level, b.at[gone] + window, -1)
        covered = np.cumsum(level)[:n] > 0
        # kept words, each with one space after it
        over = np.zeros(len(b.buf) + 2, np.int8)
        over[b.s[~covered]] += 1
        over[b.e[~covered] + 1] -= 1
        spaced = np.append(b.buf, 32).astype(np.uint8)
        spaced[b.e] = 32
        take = np.cumsum(over)[: len(spaced)] > 0
        chars, where = spaced[take], np.concatenate([[0], np.cumsum(take)])
        lead = np.concatenate([[0], np.cumsum(covered)])
        turn = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
        begins, ends = turn[::2], turn[1::2]
        out = {"doc_id": [], "n_words": [], "n_removed": [], "intervals": [], "kept_text": []}
        for i, doc in enumerate(b.ids):
            w0, w1 = b.first[i], b.first[i + 1]
            if w1 > w0:
                a, z = where[b.s[w0]], where[min(b.e[w1 - 1] + 1, len(where) - 1)]
                kept = chars[a:z].tobytes().removesuffix(b" ") if lead[w1] - lead[w0] < w1 - w0 else b""
            else:
                kept = b""
            lo, hi = np.searchsorted(begins, w1), np.searchsorted(ends, w0, "right")
            spans = [{"start": int(max(x, w0) - w0), "end": int(min(y, w1) - w0)} for x, y in zip(begins[hi:lo], ends[hi:lo], strict=True)]
            out["doc_id"].append(None if doc == _NO_ID else int(doc))
            out["n_words"].append(int(w1 - w0))
            out["n_removed"].append(int(lead[w1] - lead[w0]))
            out["intervals"].append(spans)
            out["kept_text"].append(kept.decode() if with_text else hashlib.sha256(kept).hexdigest())
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), span, pa.string()]
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(out.items(), kinds, strict=True)})

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, intervals, kept_text) for every row; kept_text is its SHA-256 if with_text is false.

    Words are runs without ASCII white space. A word goes if it is in a window of `window` words whose word sequence also
    starts in a document of a smaller doc_id; windows are judged on the input. intervals are the maximal runs of removed
    words (end exclusive; two that touch are one). Kept words are joined by one space. Null and empty texts have no words;
    texts shorter than the window lose none. Rows that repeat a doc_id are one document here: none of them is smaller, and
    they may lie in different blocks. A null doc_id is smaller than all others. Two different windows count as equal if
    their 64-bit hashes agree: of n different windows about n * n / 2**65 pairs do.
    """
    total = text_bytes(docs, text_col)
    blocks, buckets = max(1, -(-total // block_bytes)), max(1, -(-total // bucket_bytes))
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    own = docs.select(doc.alias("doc"), F.col(text_col).alias("text")).select(F.pmod(F.xxhash64("doc", "text"), F.lit(blocks)).cast("int").alias("block"), "doc", "text")
    bits = own.groupBy("block").applyInArrow(_entries(window, buckets), _ENTRIES).groupBy("bucket").applyInArrow(_losers, _BITS)
    return own.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(_removed(window, buckets, with_text), _RESULT)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept_text").alias("kept_sha256"))


SQL1 = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT doc_id, p, array_to_string(words[p + 1 : p + {WINDOW}], ' ') AS win FROM (SELECT doc_id, words, unnest(range(len(words) - {WINDOW - 1})) AS p FROM d WHERE len(words) >= {WINDOW})),
m AS (SELECT win, min(doc_id) AS low FROM w GROUP BY win),
g AS (SELECT DISTINCT doc_id, p + unnest(range({WINDOW})) AS i FROM w JOIN m USING (win) WHERE low < doc_id),
a AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM d),
k AS (SELECT a.doc_id, count(*) AS n, count(g.i) AS gone, string_agg(word, ' ' ORDER BY a.i) FILTER (WHERE g.i IS NULL) AS kept FROM a LEFT JOIN g ON g.doc_id = a.doc_id AND g.i = a.i GROUP BY a.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
