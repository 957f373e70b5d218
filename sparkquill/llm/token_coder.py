"""Token-ID output: an adaptive context-mixing range coder over blocks of ids.

A block knows nothing of other blocks. Its ids are cut into lanes that are coded side by side, so each step of the model is
one array operation for all lanes; the model is one for the block and learns from every lane after each step. Three models
predict an id: order 2 (what followed the last two ids), order 1 (what followed the last id) and order 0 (how often each id
has come). A logistic mixer turns what they say of the order-2 guess (hit rates by the confidence of order 2, of order 1,
and by its order-0 frequency) into the probability that the guess is right; then the same for a different order-1 guess. An
id that neither guesses is coded by its order-0 frequency. A 64-bit carry-less range coder takes all decisions. All that
decoding depends on is integer arithmetic, so files do not depend on the machine.

File format of a container: b"CMR3", u32 block count, then for each block u32 ids, u32 bytes, u32 CRC-32 of the block and
then its ids as little-endian u32, then the blocks. A block: u32 lanes, u32 alphabet, u32 bytes of a list of ids (0: none), that list
(zlib, u32 each, ascending: ids are coded as places in it), u32 words of each lane, then the lanes' words.
"""

from __future__ import annotations

import json
import math
import os
import struct
import zlib
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, KEEP, LOWER, buffers, eights, in_groups, mix, release, saved, small_batches, stored_bytes, table, words

MAGIC = b"CMR3"
BLOCK_IDS = 1 << 22
#: Most lanes of a block, and the ids that a lane has at least (where there are so many).
LANES, LANE_IDS = 8192, 256
#: Ids up to this are coded as they are; a block with larger ones lists its ids.
DENSE = 1 << 17
#: Bits of the order-2 table, of a flag's and of an id's frequency total.
SLOT_BITS, _FLAG, _ID, _CELL = 20, 16, 24, 8
_U = np.uint64
_LOW32 = _U(0xFFFFFFFF)

_STRETCH = np.array([round(256 * math.log((p + 0.5) / (4096 - p - 0.5))) for p in range(4096)], np.int64)
_SQUASH = np.array([min(65536 - 24, max(24, round(65536 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], np.int64)


class _Coder:
    """All lanes' range coders. Encoding collects (lane, word) pairs; decoding reads data (a row of words a lane).

    A step narrows every lane twice: by both guesses, then by the order-0 frequency, which is the whole range where a guess was
    right. Arrays stay whole, for picking lanes out costs more than the arithmetic.
    """

    def __init__(self, lanes: int, data: np.ndarray | None = None):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U)
        self.data = data
        self.lanes: list[np.ndarray] = []
        self.words: list[np.ndarray] = []
        if data is not None:
            self.flat = data.ravel()
            self.off = (data[:, 0].astype(_U) << _U(32)) | data[:, 1].astype(_U)  # what was read, less low
            self.place = np.arange(lanes, dtype=np.int64) * data.shape[1] + 2

    def add(self, n: int, below: np.ndarray) -> None:
        """Leave out what lies below the interval of the first n lanes."""
        self.low[:n] += below
        if self.data is not None:
            self.off[:n] -= below

    def narrow(self, n: int, rng: np.ndarray) -> None:
        """Set the ranges of the first n lanes; those that became small take or give a word."""
        self.range[:n] = rng
        small = np.flatnonzero(rng <= _LOW32)
        if not len(small):
            return
        lo, r = self.low.take(small), rng.take(small)
        top = lo >> _U(32)
        cross = top != (lo + r) >> _U(32)  # the range straddles a word: give up its upper part
        r = np.where(cross, (_U(0) - lo) & _LOW32, r)
        if self.data is None:
            self.lanes.append(small.astype(np.uint16))
            self.words.append(top.astype(np.uint32))
        else:
            place = self.place.take(small)
            self.off[small] = (self.off.take(small) << _U(32)) + self.flat.take(place, mode="clip")
            self.place[small] = place + 1
        self.low[small], self.range[small] = lo << _U(32), r << _U(32)

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """How many words each lane has, and the words, lane by lane."""
        n = len(self.low)
        every = np.arange(n, dtype=np.uint16)
        lanes = np.concatenate([*self.lanes, every, every])
        out = np.concatenate([*self.words, (self.low >> _U(32)).astype(np.uint32), (self.low & _LOW32).astype(np.uint32)])
        return np.bincount(lanes, minlength=n), out[np.argsort(lanes, kind="stable")]


class _Mixer:
    """The probability that a guess is right, for each joint context: 5 bits of the guess's order-0 level when it was last
    seen here, 3 of its model's confidence, 3 of the other's, 1 that is set where both agree (second guesses: where there is
    nothing to code). The hit rates by each of these are mixed in the logistic domain with learned weights; what the joint
    context has seen itself refines the mix."""

    SIZE = 1 << 12

    def __init__(self, second: bool):
        j = np.arange(self.SIZE)
        self.second, self.agree = second, j & 1
        self.parts = [(j >> 4 & 7) << 1 | self.agree, (j >> 1 & 7) << 1 | self.agree, j >> 7 << 1 | self.agree]
        self.seen, self.hits = np.zeros(self.SIZE, np.int64), np.zeros(self.SIZE, np.int64)
        self.weights = np.full((2, 3), 30000, np.int64)  # of 65536
        self.held: list[np.ndarray] = []
        self.mix()

    def mix(self):
        """Probabilities anew from the counts."""
        stretched = []
        for part in self.parts:
            # sums of integers far below 2**53: exact in any order
            n = np.bincount(part, weights=self.seen, minlength=64).astype(np.int64)
            h = np.bincount(part, weights=self.hits, minlength=64).astype(np.int64)
            stretched.append(_STRETCH[((2 * h + 1) << 12) // (2 * n + 4)][part])
        self.stretched = stretched
        dot = sum(s * self.weights[self.agree, i] for i, s in enumerate(stretched)) >> 16
        self.mixed = _SQUASH[np.clip(dot, -2047, 2047) + 2047]
        p = (self.mixed * 24 + (self.hits << _FLAG)) // (24 + self.seen)
        self.p = np.clip(p, 24, (1 << _FLAG) - 24).astype(_U)
        if self.second:
            self.p[1::2] = 0

    def hold(self, joint: np.ndarray, hit: np.ndarray) -> None:
        """Keep what was coded; of many lanes every fourth tells as much."""
        by = 4 if len(joint) >= 1024 else 1
        self.held.append((joint[::by] << np.uint32(1) | hit[::by]).astype(np.int16))

    def learn(self) -> None:
        """Take in what has been kept since the last time."""
        if not self.held:
            return
        both = np.bincount(np.concatenate(self.held), minlength=2 * self.SIZE).reshape(-1, 2)
        self.held.clear()
        if self.second:
            both[1::2] = 0
        n, h = both.sum(1), both[:, 1]
        error = ((h << 12) - n * (self.mixed >> 4)).astype(np.int64)
        for a in (0, 1):
            total = int(n[a::2].sum())
            if total:
                for i, s in enumerate(self.stretched):
                    step = int((error[a::2] * s[a::2]).sum()) // total >> 6
                    self.weights[a, i] += max(-4000, min(4000, step))
        self.seen += n
        self.hits += h
        if int(self.seen.max()) > 1 << 16:  # older counts fade
            self.seen >>= 1
            self.hits >>= 1
        self.mix()


class _Model:
    """What a block has learned."""

    def __init__(self, lanes: int, alphabet: int, n: int, reading: bool):
        self.reading = reading
        self.prev, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        bits = min(SLOT_BITS, max(8, (2 * n).bit_length()))
        self.shift = _U(64 - bits)
        # guess << 8 | its level << 3 | how often it was right, 7 at most
        self.one, self.two = np.zeros(alphabet, np.uint32), np.zeros(1 << bits, np.uint32)
        self.first, self.second = _Mixer(False), _Mixer(True)
        self.counts, self.total, self.distinct = np.zeros(alphabet, np.int64), 0, 0
        self.fresh: list[np.ndarray] = []
        self.waiting = self.step = 0
        self.rank()

    def rank(self) -> None:
        """Order-0 frequencies anew: an id not seen yet has its part of the share that new ids had so far."""
        size = len(self.counts)
        mass = (1 << _ID) - size
        if self.total:
            rest = max(1, self.distinct)
            freq = self.counts * mass // (self.total + rest)
            freq += 1 + rest * mass // (self.total + rest) // size
        else:
            freq = np.full(size, 1 + mass // size, np.int64)
        self.cum = np.zeros(size + 1, np.int64)
        np.cumsum(freq, out=self.cum[1:])
        self.spans = np.empty(size + 1, _U)  # cum << 32 | freq; behind the ids the whole range
        self.spans[:size] = self.cum[:-1] << 32 | freq
        self.spans[size] = 1 << _ID
        if self.reading:  # the id at the begin of each cell of frequencies
            cells = (1 << _ID - _CELL) + 2
            self.cells = np.cumsum(np.bincount((self.cum[1:] + ((1 << _CELL) - 1)) >> _CELL, minlength=cells))
        self.level = np.frexp(freq.astype(np.float64))[1].astype(np.uint32) << np.uint32(3)  # the bit length, exactly

    def learn(self, ids: np.ndarray) -> None:
        self.fresh.append(ids)
        self.waiting += len(ids)
        self.step += 1
        if self.waiting * 8 >= self.total:
            self.counts += np.bincount(np.concatenate(self.fresh), minlength=len(self.counts))
            self.fresh.clear()
            self.total += self.waiting
            self.waiting, self.distinct = 0, int(np.count_nonzero(self.counts))
            self.rank()
        if self.step < 8 or self.step % 16 == 0:
            self.first.learn()
            self.second.learn()


def _order0(model: _Model, goal: np.ndarray) -> np.ndarray:
    """The ids whose frequencies lie at these places."""
    goal = np.minimum(goal, _U(int(model.cum[-1]) - 1)).astype(np.int64)
    cell = goal >> _CELL
    ids = model.cells.take(cell)
    several = np.flatnonzero(model.cells.take(cell + 1) != ids)  # ids share the cell
    ids[several] = np.searchsorted(model.cum, goal.take(several), "right") - 1
    return ids


def _entry(old: np.ndarray, sure: np.ndarray, hit: np.ndarray, fresh: np.ndarray, least: int) -> np.ndarray:
    """A guess's entry after a step. One that was right often is given up after some misses only."""
    kept = np.where(sure > least, old - np.uint32(least + 1), fresh)
    return np.where(hit, fresh | np.minimum(sure + np.uint32(1), np.uint32(7)), kept)


def _step(model: _Model, coder: _Coder, n: int, ids: np.ndarray | None) -> np.ndarray:
    p, q = model.prev[:n], model.before[:n]
    slot = ((p.view(_U) * _U(0x9E3779B97F4A7C15) + q.view(_U) * _U(0xC2B2AE3D27D4EB4F)) >> model.shift).view(np.int64)
    e1, e2 = model.one.take(p), model.two.take(slot)
    g1, g2, c1, c2 = e1 >> np.uint32(8), e2 >> np.uint32(8), e1 & np.uint32(7), e2 & np.uint32(7)
    agree = g1 == g2
    guesses = None if ids is None else ids.astype(np.uint32)
    # is the order-2 guess right
    joint = (e2 & np.uint32(255)) << np.uint32(4) | c1 << np.uint32(1) | agree
    rng = coder.range[:n]
    bound = (rng >> _U(_FLAG)) * model.first.p.take(joint)
    hit = coder.off[:n] < bound if ids is None else guesses == g2
    model.first.hold(joint, hit)
    coder.add(n, bound * ~hit)
    # is the order-1 guess, if it differs
    joint = (e1 & np.uint32(255)) << np.uint32(4) | c2 << np.uint32(1) | (agree | hit)
    rng = rng - bound
    other = (rng >> _U(_FLAG)) * model.second.p.take(joint)
    one = coder.off[:n] < other if ids is None else (guesses == g1) & ~(agree | hit)
    model.second.hold(joint, one)
    miss = ~(hit | one)
    coder.add(n, other * miss)
    coder.narrow(n, np.where(hit, bound, np.where(one, other, rng - other)))
    # an id that nobody guesses
    unit = coder.range[:n] >> _U(_ID)
    whole = len(model.counts)
    if ids is None:
        rest = np.flatnonzero(miss)
        found = _order0(model, coder.off.take(rest) // unit.take(rest))
        ids = np.where(hit, g2, g1).astype(np.int64)
        ids[rest] = found
        guesses = ids.astype(np.uint32)
    span = model.spans.take(np.where(miss, ids, whole))
    coder.add(n, unit * (span >> _U(32)))
    coder.narrow(n, unit * (span & _LOW32))
    fresh = guesses << np.uint32(8) | model.level.take(ids)
    model.one[p] = _entry(e1, c1, guesses == g1, fresh, 1)
    model.two[slot] = _entry(e2, c2, hit, fresh, 2)
    model.before[:n] = p
    model.prev[:n] = ids
    model.learn(ids)
    return ids


def _lanes(n: int) -> tuple[int, int]:
    """Lanes of a block of n ids, and the ids of a lane; the last may have fewer, and lanes without ids are none."""
    steps = max(LANE_IDS, -(-n // LANES))
    return -(-n // steps), min(steps, n)


def _narrow(size: int) -> type:
    """The type of numbers below size; most vocabularies fit two bytes."""
    return np.uint16 if size <= 1 << 16 else np.uint32


def _encode_block(ids: np.ndarray) -> bytes:
    own, listed = ids.astype(_narrow(int(ids.max()) + 1), copy=False), b""
    alphabet = int(own.max()) + 1
    if alphabet > DENSE:
        known, own = np.unique(own, return_inverse=True)
        own = own.astype(_narrow(len(known)))
        alphabet, listed = len(known), zlib.compress(known.astype("<u4").tobytes(), 6)
    lanes, steps = _lanes(len(own))
    last = len(own) - (lanes - 1) * steps
    grid = np.zeros((steps, lanes), own.dtype)
    grid[:, : lanes - 1] = own[: (lanes - 1) * steps].reshape(lanes - 1, steps).T
    grid[:last, lanes - 1] = own[(lanes - 1) * steps :]
    model, coder = _Model(lanes, alphabet, len(own), False), _Coder(lanes)
    for t in range(steps):
        n = lanes if t < last else lanes - 1
        _step(model, coder, n, grid[t, :n].astype(np.int64))
    sizes, out = coder.finish()
    return struct.pack("<III", lanes, alphabet, len(listed)) + listed + sizes.astype("<u4").tobytes() + out.astype("<u4").tobytes()


def _decode_block(data: bytes, count: int) -> np.ndarray:
    if len(data) < 12:
        raise ValueError("a block is cut short")
    lanes, alphabet, listed = struct.unpack_from("<III", data)
    if (lanes, listed <= len(data)) != (_lanes(count)[0], True) or not alphabet:
        raise ValueError("a block is damaged")
    steps, at = _lanes(count)[1], 12 + listed
    known = None
    if listed:
        try:
            known = np.frombuffer(zlib.decompress(data[12:at]), "<u4")
        except (zlib.error, ValueError) as e:
            raise ValueError("a block's list of ids is damaged") from e
    if len(data) < at + 4 * lanes or alphabet > (1 << 24 if known is None else len(known)):
        raise ValueError("a block is damaged")
    sizes = np.frombuffer(data, "<u4", lanes, at).astype(np.int64)
    at += 4 * lanes
    if at + 4 * int(sizes.sum()) != len(data) or (sizes < 2).any():
        raise ValueError("a block is damaged")
    words_ = np.frombuffer(data, "<u4", -1, at)
    raw = np.zeros((lanes, int(sizes.max()) + 2), np.uint32)
    raw[np.arange(raw.shape[1]) < sizes[:, None]] = words_
    model, coder = _Model(lanes, alphabet, count, True), _Coder(lanes, raw)
    grid = np.zeros((steps, lanes), _narrow(alphabet))
    last = count - (lanes - 1) * steps
    for t in range(steps):
        n = lanes if t < last else lanes - 1
        grid[t, :n] = _step(model, coder, n, None)
    out = np.ascontiguousarray(grid.T).ravel()[:count]
    return out if known is None else known[out]


def encode(ids: np.ndarray, block: int = BLOCK_IDS) -> bytes:
    """A container of the ids (integers of 32 bits). No ids: a container of no blocks."""
    ids = np.asarray(ids)
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) > 0xFFFFFFFF):
        raise ValueError("ids are integers of 32 bits, not negative")
    heads, bodies = [], []
    for i in range(0, len(ids), block):
        own = ids[i : i + block]
        bodies.append(_encode_block(own))
        heads.append(struct.pack("<III", len(own), len(bodies[-1]), zlib.crc32(own.astype("<u4").tobytes(), zlib.crc32(bodies[-1]))))
    return MAGIC + struct.pack("<I", len(heads)) + b"".join(heads) + b"".join(bodies)


def decode(data: bytes) -> np.ndarray:
    """The ids of a container, as uint32. ValueError if a block is damaged."""
    if data[:4] != MAGIC or len(data) < 8:
        raise ValueError("not a container of ids")
    count = struct.unpack_from("<I", data, 4)[0]
    if len(data) < 8 + 12 * count:
        raise ValueError("the block table is cut short")
    heads = np.frombuffer(data, "<u4", 3 * count, 8).reshape(-1, 3).tolist()
    at, out = 8 + 12 * count, []
    if at + sum(h[1] for h in heads) != len(data):
        raise ValueError("the blocks do not fill the container")
    for i, (n, size, crc) in enumerate(heads):
        ids = _decode_block(data[at : at + size], n) if n else np.zeros(0, np.uint32)
        if zlib.crc32(ids.astype("<u4").tobytes(), zlib.crc32(data[at : at + size])) != crc:
            raise ValueError(f"block {i} is damaged")
        out.append(ids)
        at += size
    return np.concatenate(out).astype(np.uint32) if out else np.zeros(0, np.uint32)


# ---- corpora

END = 2
#: Ids of a container, about: it ends with the texts that fill it.
CONTAINER_IDS = BLOCK_IDS - (1 << 18)
#: Bytes of stored documents that a task encodes, about.
PART_BYTES = 14 << 20


#: A special token of the vocabulary; words that hold "<|" are encoded one by one.
MARK = "<|startoftext|>"


@cache
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: How a tokenizer may prepare texts if words of a-z, parted by spaces, reach its BPE model as they are.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


@cache
def _plain_tokenizer(path: str):
    """The tokenizer for words of a-z, parted by single spaces: without the steps that leave these as they are. None: not for it."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import CharDelimiterSplit

    made = json.loads(_tokenizer(path).to_str())
    added = [x["content"] for x in made["added_tokens"]]
    if made["normalizer"] != {"type": "Sequence", "normalizers": _NORMALIZERS} or made["pre_tokenizer"] != {"type": "Sequence", "pretokenizers": _SPLITS} or not all("<" in x for x in added):
        return None
    made |= {"normalizer": None, "pre_tokenizer": None}
    plain = Tokenizer.from_str(json.dumps(made))
    plain.pre_tokenizer = CharDelimiterSplit(" ")
    return plain


@cache
def _shared_cache(path: str) -> WordCache:
    """One cache for all tasks that a Python worker runs."""
    return WordCache(path)


_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<")
#: Most signs that are split off a word.
_TAIL = 64
_IS_PUNCTUATION, _IS_ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_IS_PUNCTUATION[list(_PUNCTUATION)] = True
_IS_ALNUM[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True


def _word_key(low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of words of up to 16 bytes."""
    return mix(mix(low ^ n.astype(np.uint64) << np.uint64(59)) ^ high)


class WordCache:
    """Encodes texts word by word: each distinct word is encoded once by the library, and texts are put together from these.

    That needs a tokenizer that never looks across ASCII white space, which a probe tells; texts go to any other whole. Where
    another probe shows that the tokenizer always parts letters and digits from ASCII punctuation behind them and takes A-Z
    as a-z, the punctuation at the end of a word counts as a word of its own, and words of ASCII letters are looked up in
    lower case (words with "<", which special tokens begin with, are left whole). A word of up to 16 bytes is known by its
    bytes (two numbers), found by a hash and compared in full; longer words are keys of a dictionary. The memory is bounded:
    a full cache keeps the half that came first, for frequent words come early.
    """

    PROBE = "Ab cd,\tab  it's 1 2\nÉ<x> ab"

    def __init__(self, path: str, most: int = 1 << 20, most_ids: int = 1 << 22):
        self.path, self.most, self.usual, self.most_ids = path, most, most, most_ids
        tokenizer = _tokenizer(path)
        ids = lambda *texts: [i for t in texts for i in tokenizer.encode(t, add_special_tokens=False).ids]
        self.by_word = ids(self.PROBE) == ids(*self.PROBE.split())
        tails = [chr(c) for c in _PUNCTUATION]
        tries = [(w, t) for w in ("ab", "it's", "x1") for t in tails] + [("ab", x + y) for x in tails for y in tails]
        self.parts = self.by_word and all(ids(w.upper() + t) == ids(w, t) for w, t in tries)
        vocabulary = tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that end a run of letters
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.mask = 4 * most - 1
        self._clear()

    def _clear(self):
        self.slot = np.full(self.mask + 1, -1, np.int32)  # by hash: the entry
        # an entry: the word's bytes, its place among the ids, its number of ids
        self.low, self.high = np.zeros(self.most, np.uint64), np.zeros(self.most, np.uint64)
        self.bytes, self.start, self.size = np.zeros(self.most, np.uint8), np.zeros(self.most, np.int32), np.zeros(self.most, np.int32)
        self.n = 0
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 1  # the first is for the end id
        self.long: dict[bytes, tuple[int, int]] = {}
        self.long_bytes = 0

    def _make_room(self, words_: int) -> None:
        """Drop the later half, or all if so many words might not fit beside the rest. One text may hold more than usual."""
        self.most = max(self.usual, words_)
        self.mask = (1 << (4 * self.most - 1).bit_length()) - 1
        keep = min(self.usual // 2, int(np.searchsorted(self.start[: self.n], self.most_ids // 2)))
        if keep + words_ > self.most:
            keep = 0
        old, n, ids = [x[:keep].copy() for x in (self.low, self.high, self.bytes, self.start, self.size)], self.n, self.ids
        end = int(self.start[keep]) if keep < n else self.n_ids
        self._clear()
        if keep:
            for x, y in zip((self.low, self.high, self.bytes, self.start, self.size), old, strict=True):
                x[:keep] = y
            self._store(ids[1:end])
            self.n = keep
            self._place(_word_key(*old[:3]), np.arange(keep))

    def _encode(self, fresh: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """An order of the words, and in that order the number of ids of each and all ids."""
        plain = _plain_tokenizer(self.path)
        kinds = [w.isalpha() and (1 if plain is None or not w.isascii() or not w.islower() else 2) for w in fresh]
        order, sizes, flats = [], [], []
        for kind, run in ((2, partial(self._letters, plain)), (1, partial(self._letters, _tokenizer(self.path))), (0, self._marked)):
            keys = [k for k, x in enumerate(kinds) if x == kind]
            # few words at a time: the library's results take far more memory than the ids in them
            for i in range(0, len(keys), 1000):
                size, flat = run([fresh[k] for k in keys[i : i + 1000]])
                sizes.append(size)
                flats.append(flat)
            order += keys
        return order, np.concatenate(sizes), np.concatenate(flats)

    def _letters(self, tokenizer, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters only, apart by spaces; the last id of each tells where it ends. If that does not add up: as others."""
        flat = np.array(tokenizer.encode_batch_fast([" ".join(fresh)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[flat])
        if len(ends) != len(fresh) or ends[-1] != len(flat) - 1:
            return self._marked(fresh)
        return np.diff(ends, prepend=-1), flat

    def _marked(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Any words, apart by a special token."""
        tokenizer = _tokenizer(self.path)
        mark = tokenizer.token_to_id(MARK)
        if mark is None or any("<|" in w for w in fresh):
            found = [x.ids for x in tokenizer.encode_batch_fast(fresh, add_special_tokens=False)]
            size = np.array([len(x) for x in found], np.int64)
            return size, np.fromiter((i for x in found for i in x), np.uint32, int(size.sum()))
        flat = np.array([*tokenizer.encode_batch_fast([MARK.join(fresh)], add_special_tokens=False)[0].ids, mark], np.uint32)
        ends = np.flatnonzero(flat == mark)
        return np.diff(ends, prepend=-1) - 1, flat[flat != mark]

    def _store(self, flat: np.ndarray) -> int:
        """Room for more ids; where they begin."""
        at = self.n_ids
        if at + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint32)])
        self.ids[at : at + len(flat)] = flat
        self.n_ids += len(flat)
        return at

    def _find(self, h, low, high, n) -> np.ndarray:
        """The entry of each word, or -1."""
        out = np.full(len(h), -1, np.int64)
        open_, at = np.arange(len(h)), (h >> np.uint64(20)).astype(np.int64) & self.mask
        while len(open_):
            e = self.slot.take(at)
            same = (e >= 0) & (self.low.take(e) == low[open_]) & (self.high.take(e) == high[open_]) & (self.bytes.take(e) == n[open_])
            out[open_[same]] = e[same]
            on = np.flatnonzero(~same & (e >= 0))
            open_, at = open_[on], (at[on] + 1) & self.mask
        return out

    def _add(self, h, low, high, n, words_: list[str]) -> None:
        """New, distinct words."""
        order, size, flat = self._encode(words_)
        h, low, high, n = h[order], low[order], high[order], n[order]
        at, e = self._store(flat), np.arange(self.n, self.n + len(h))
        self.low[e], self.high[e], self.bytes[e], self.size[e] = low, high, n, size
        self.start[e] = at + np.cumsum(size) - size
        self.n += len(h)
        self._place(h, e)

    def _place(self, h, e) -> None:
        """Find slots for entries."""
        slot = (h >> np.uint64(20)).astype(np.int64) & self.mask
        while len(e):
            free = self.slot[slot] < 0
            self.slot[slot[free]] = e[free]  # of several that want one slot the last has it
            on = np.flatnonzero(self.slot[slot] != e)
            e, slot = e[on], (slot[on] + 1) & self.mask

    def _units(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """Starts and ends of words and split-off punctuation, how many lie before each text, and the bytes to look them up by."""
        s, e, first = words(buf, off)
        if not self.parts or not len(s):
            return s, e, first, buf
        before = e.copy()  # where the punctuation at the end of each word begins
        tail = np.flatnonzero(_IS_PUNCTUATION[buf[e - 1]])
        for _ in range(_TAIL):
            before[tail] -= 1
            tail = tail[before[tail] > s[tail]]
            tail = tail[_IS_PUNCTUATION[buf[before[tail] - 1]]]
            if not len(tail):
                break
        cut = (before < e) & (before > s)
        cut[tail] = False  # a longer run stays with its word
        cut &= _IS_ALNUM[buf[before - 1]]
        plain = np.maximum.reduceat(buf, s) < 128  # what lies between words is ASCII
        if (buf == ord("<")).any():
            marks = np.concatenate([[0], np.cumsum(buf == ord("<"), dtype=np.int32)])
            plain &= marks[e] == marks[s]
            cut &= marks[e] == marks[s]
        extra = np.concatenate([[0], np.cumsum(cut)])
        place = np.arange(len(s)) + extra[:-1]
        out_s, out_e = np.empty(len(s) + extra[-1], np.int64), np.empty(len(s) + extra[-1], np.int64)
        out_s[place], out_e[place] = s, np.where(cut, before, e)
        tail = place[cut] + 1
        out_s[tail], out_e[tail] = before[cut], e[cut]
        # lower case, but in words with other letters
        low = LOWER[buf]
        if not plain.all():
            inside = np.zeros(len(buf) + 1, np.int8)
            inside[s[~plain]] = 1
            inside[e[~plain]] -= 1  # where the next text's word begins at once, both hold
            low = np.where(np.cumsum(inside, dtype=np.int8)[:-1] > 0, buf, low)
        return out_s, out_e, first + extra[first], low

    def texts(self, buf: np.ndarray, off: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with `end` after each, and each text's number of ids."""
        if not self.by_word:
            raw = buf.tobytes()
            found = [x.ids for x in _tokenizer(self.path).encode_batch_fast([raw[a:z].decode("utf-8", "replace") for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], add_special_tokens=False)]
            counts = np.array([len(x) + 1 for x in found], np.int64)
            return np.fromiter((i for x in found for i in (*x, end)), np.uint32, int(counts.sum())), counts
        s, e, first, buf = self._units(buf, off)
        raw, n = None, e - s
        if self.n + len(s) > self.most or self.n_ids > self.most_ids or self.long_bytes > self.most_ids:
            self._make_room(len(s))  # with this batch's words it might be too full
        # behind the words of each text a place for the end id
        n_docs = len(off) - 1
        place = np.arange(len(s)) + np.repeat(np.arange(n_docs), np.diff(first))
        start, size = np.zeros(len(s) + n_docs, np.int32), np.ones(len(s) + n_docs, np.int32)
        self.ids[0] = end
        short = np.flatnonzero(n <= 16)
        if len(short):
            view, own, m = eights(buf), s[short], n[short]
            low = view[own] & KEEP[np.minimum(m, 8)]
            high = np.zeros(len(own), np.uint64)
            wide = np.flatnonzero(m > 8)
            high[wide] = view[own[wide] + 8] & KEEP[m[wide] - 8]
            h = _word_key(low, high, m)
            at = self._find(h, low, high, m)
            new = np.flatnonzero(at < 0)
            if len(new):
                raw = buf.tobytes()
                where: dict[bytes, int] = {}
                for k, a, z in zip(new.tolist(), own[new].tolist(), (own[new] + m[new]).tolist(), strict=True):
                    where.setdefault(raw[a:z], k)
                got = list(where.values())
                self._add(h[got], low[got], high[got], m[got], [w.decode("utf-8", "replace") for w in where])
                at[new] = self._find(h[new], low[new], high[new], m[new])
            start[place[short]], size[place[short]] = self.start[at], self.size[at]
        if len(short) < len(s):
            raw = buf.tobytes() if raw is None else raw
            others = np.flatnonzero(n > 16)
            found = [raw[a:z] for a, z in zip(s[others].tolist(), e[others].tolist(), strict=True)]
            fresh = [w for w in dict.fromkeys(found) if w not in self.long]
            if fresh:
                order, sizes, flat = self._encode([w.decode("utf-8", "replace") for w in fresh])
                at = self._store(flat) + np.cumsum(sizes) - sizes
                self.long.update(zip([fresh[k] for k in order], zip(at.tolist(), sizes.tolist(), strict=True), strict=True))
                self.long_bytes += sum(map(len, fresh))
            start[place[others]], size[place[others]] = np.array([self.long[w] for w in found], np.int64).reshape(-1, 2).T
        total = np.zeros(len(size) + 1, np.int32)  # a batch holds far fewer ids than 2**31
        np.cumsum(size, out=total[1:])
        counts = np.diff(total[first + np.arange(n_docs + 1)]).astype(np.int64)
        return self.ids.take(np.repeat(start - total[:-1], size) + np.arange(total[-1], dtype=np.int32)), counts


_CONTAINERS = "part int, seq long, n long, docs array<long>, sizes array<long>, data binary"


def _in_order(docs: DataFrame, order_by: tuple[str, ...], id_col: str, text_col: str) -> DataFrame:
    """(part, row, doc, text): range partitions of docs; within each, rows are numbered in order."""
    parts = max(1, -(-stored_bytes(docs) // PART_BYTES))
    own = docs.select(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order_by)], F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    keys = [*(f"o{i}" for i in range(len(order_by))), "doc", "row"]
    own = own.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return own.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), "doc", "text")


def _as_stored(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, row, doc, text) of a table that was read from files: files by their number, rows as they lie. Nothing is shuffled."""
    path = F.col("_metadata.file_path")
    files = docs.select(path.alias("path")).distinct()
    number = F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long")
    part = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(number.asc_nulls_first(), "path"))  # a row a file
    files = saved(docs.sparkSession, files.select("path", part.alias("part")), "token-files")
    own = docs.select(path.alias("path"), F.col("_metadata.row_index").alias("row"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return own.join(F.broadcast(files) if files.count() <= BROADCAST_ROWS else files, "path").select("part", "row", "doc", "text")


def write_tokens(docs: DataFrame, path: str, end: int = END, order_by: tuple[str, ...] | None = ("doc_id",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text with the tokenizer file at `path` and store containers of ids in order of order_by; the table of
    containers (part, seq, n, docs, sizes, data) as stored. Range partitions keep the order; ties are ordered by id, then as
    they lie in docs, so rows of one key may fill several partitions. order_by None: docs is a table read from files, whose
    order stays (files by number, rows as they lie)."""
    spark = docs.sparkSession
    own = _as_stored(docs, id_col, text_col) if order_by is None else _in_order(docs, order_by, id_col, text_col)

    def run(batches):
        cache_, part, first, last = _shared_cache(path), None, 0, 0
        held: tuple[list, list, list] = ([], [], [])  # ids, documents, sizes
        total = 0

        def container():
            ids, docs_, sizes = np.concatenate(held[0]), pa.chunked_array(held[1], pa.int64()).combine_chunks(), np.concatenate(held[2])
            for x in held:
                x.clear()
            lists = [pa.ListArray.from_arrays(pa.array([0, len(docs_)], pa.int32()), v) for v in (docs_, pa.array(sizes, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([total], pa.int64()), *lists, pa.array([encode(ids)], pa.binary())], ["part", "seq", "n", "docs", "sizes", "data"])

        try:
            for whole in batches:
                parts, rows = whole.column(0).to_numpy(), whole.column(1).to_numpy()
                cuts = np.flatnonzero((np.diff(parts) != 0) | (np.diff(rows) != 1)) + 1
                for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True):
                    if a == z:
                        continue
                    if total and (part != parts[a] or rows[a] != last + 1):  # other rows lie between
                        yield container()
                        total = 0
                    b = whole.slice(a, z - a)
                    buf, off = buffers(b.column(3))
                    for i, j in in_groups(off, 1 << 19):
                        if not total:
                            part, first = int(parts[a]), int(rows[a + i])
                        out, counts = cache_.texts(buf[off[i] : off[j]], off[i : j + 1] - off[i], end)
                        held[0].append(out.astype(_narrow(int(out.max()) + 1)))
                        held[1].append(b.column(2).slice(i, j - i))
                        held[2].append(counts)
                        total += len(out)
                        if total >= CONTAINER_IDS:
                            yield container()
                            total = 0
                    last = int(rows[z - 1])
            if total:
                yield container()
        finally:
            release()

    with small_batches(spark):
        return saved(spark, own.mapInArrow(run, _CONTAINERS), "tokens", codec="none")


_INDEX = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Partitions whose sums are added up together.
_RUN = 4096


def read_tokens(spark: SparkSession, stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the decoded containers. start: ids of all documents before."""
    # prefix sums in two levels: over runs of partitions, then within a run (_RUN partitions hold a bounded number of containers)
    sizes = saved(spark, stored.select(F.floor(F.col("part") / _RUN).alias("run"), "part", "seq", "n"), "token-sizes")
    runs = sizes.groupBy("run").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    runs = runs.select("run", before.alias("base"))  # a row for each 100 GB of text
    within = F.sum("n").over(Window.partitionBy("run").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    starts = sizes.withColumn("within", within).join(runs, "run").select("part", "seq", (F.col("base") + F.col("within")).alias("start"))
    bounded = F.broadcast(starts) if sizes.count() <= BROADCAST_ROWS else starts

    def run(batches):
        try:
            for b in batches:
                for k in range(len(b)):
                    ids = decode(b.column(3)[k].as_py())
                    sizes = b.column(2)[k].values.to_numpy()
                    if sizes.sum() != len(ids):
                        raise ValueError("a container does not hold its documents")
                    ends = np.cumsum(sizes)
                    crc = [zlib.crc32(ids[e - n : e]) for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                    base = b.column(0)[k].as_py()
                    yield pa.RecordBatch.from_arrays([b.column(1)[k].values, pa.array(base + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
        finally:
            release()

    return stored.join(bounded, ["part", "seq"]).select("start", "docs", "sizes", "data").mapInArrow(run, _INDEX)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_corpus(spark: SparkSession, docs: DataFrame, order_by: tuple[str, ...] | None = ("doc_id",), tokenizer: str | None = None) -> DataFrame:
    """Write the ids of all documents and read them back (see read_tokens).

    A null or empty text has the end id alone. Rows that repeat an id are documents of their own, in the order in which they
    lie in docs; rows without an id come first and keep a null id. An empty table gives no rows.
    """
    return read_tokens(spark, write_tokens(docs, tokenizer or default_tokenizer(), order_by=order_by))


def op2_token_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(spark, table(spark, sf_dir, "documents"))
