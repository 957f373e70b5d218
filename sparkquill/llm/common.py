"""Shared helpers: table access, the shared work folder, size-checked joins and byte-level hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a two-or-three-column key table that may be broadcast (about 24 bytes a row).
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset, as in local tests, a temporary one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="sparkquill-")
    sc.setCheckpointDir(base)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def saved(spark: SparkSession, df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and a lost executor costs nothing."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of at most so many rows for the jobs within: less memory in the JVM and in Python workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def lookup(big: DataFrame, small: DataFrame, on: list[str], rows: int, how: str = "inner") -> DataFrame:
    """Join a small keyed table to a wide one. Broadcast only when its counted rows are within the bound; shuffle beyond."""
    return big.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def stored_bytes(docs: DataFrame) -> int:
    """About how many bytes docs takes where it is stored, as the optimizer knows from its files; else its texts are counted."""
    known = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 55 else text_bytes(docs)


def release() -> None:
    """Give memory that a Python worker no longer uses back to the system, for the worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such function
        ctypes.CDLL(None).malloc_trim(0)


# ---- bytes, words and rolling hashes

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_Q = 0xD6E8FEB86659FD93
#: Words of more bytes are hashed one by one; shorter ones eight bytes at a time, all words at once.
_LONG_WORD = 256
KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; base is odd."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(max(n, 1), b, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and how many words lie before each text (len(off) values)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~_SPACE[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, off)


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number (little-endian); bytes behind the end are 0."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word. Eight bytes at a time go through a bijective mixer, so no pattern of letters cancels out;
    two words of up to eight bytes and of one length never share a hash."""
    n = e - s
    h = mix(n.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    view = eights(buf)
    own, at, left = np.arange(len(s)), s, n
    long = np.flatnonzero(n > _LONG_WORD)
    if len(long):
        own = np.flatnonzero(n <= _LONG_WORD)
        at, left = s[own], n[own]
    all_words = len(own) == len(s)
    while len(own):
        part = view[at] & KEEP[np.minimum(left, 8)]
        if all_words:
            h = mix(h ^ part)
        else:
            h[own] = mix(h[own] ^ part)
        more = np.flatnonzero(left > 8)
        own, at, left, all_words = own[more], at[more] + 8, left[more] - 8, False
    for k in long.tolist():
        h[k] = xxhash.xxh3_64_intdigest(buf[s[k] : e[k]])
    return h


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of each run of k consecutive values; entry i covers h[i : i + k]."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(_Q, len(h))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up, out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[:n] + np.uint64(k))


def in_groups(off: np.ndarray, most: int = 2 << 20):
    """Ranges of consecutive texts of at most `most` bytes together (a longer text stands alone)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
