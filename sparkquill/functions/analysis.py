"""Text configurations: how a text becomes terms with positions.

`simple` lower-cases runs of letters, digits and underscores with built-in functions only. The language configurations
drop stop words, which still take a position, and stem the rest; stems are computed once a distinct word of a batch.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QuillError
from . import stopwords
from .stem import STEMMERS, stem

#: The longest term in bytes; longer words are no terms and take no position. Positions have no limit.
MAX_TERM_BYTES = 2046
WORD = "[\\p{L}\\p{N}_]+"
STOP = {"english": stopwords.ENGLISH, "french": stopwords.FRENCH, "german": stopwords.GERMAN, "spanish": stopwords.SPANISH}
CONFIGS = ("simple", *STEMMERS)


def _word_char(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LN"


def _words(text: str) -> list[str]:
    """What WORD finds; the standard library has no \\p classes."""
    if text.isascii():
        return re.findall(r"[A-Za-z0-9_]+", text)
    return "".join(c if _word_char(c) else " " for c in text).split(" ")


def check_config(config: str) -> str:
    if config not in CONFIGS:
        raise QuillError(f"text configuration {config!r} does not exist; there are {', '.join(CONFIGS)}")
    return config


def analyze(config: str, text: str | None) -> list[tuple[str, int]]:
    """(term, position) of one text, on the driver or in a UDF. Positions begin at 1 and count stop words."""
    check_config(config)
    out, at = [], 0
    for w in _words((text or "").lower()):
        if not w or len(w.encode()) > MAX_TERM_BYTES:
            continue
        at += 1
        if config != "simple":
            if w in STOP[config]:
                continue
            w = stem(config, w)
        out.append((w, at))
    return out


def normalise_word(config: str, word: str) -> str | None:
    """The term of one word alone; None for a stop word."""
    if config == "simple":
        return word
    return None if word in STOP[config] else stem(config, word)


TOKENS = "array<struct<term:string,pos:int>>"
POSTING = "struct<term:string,tf:bigint,positions:array<int>>"
POSTINGS = f"array<{POSTING}>"
#: Texts, or tokens, that a Python worker holds as Python or NumPy objects at a time.
SLICE_BYTES, SLICE_TOKENS = 4 << 20, 1 << 18


def slices(sizes: np.ndarray, most: int):
    """(start, end) of runs of rows whose sizes add up to at most `most`, or of one row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        yield at, max(end, at + 1)
        at = max(end, at + 1)


def ragged(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _analysed(config: str, texts: pa.Array) -> pa.Array:
    """TOKENS of texts. A distinct word of a slice is stemmed once; what comes out is never a Python object a token."""
    known: dict[str, int] = {}
    terms: list[str] = []
    ids, at, lengths = array("i"), array("i"), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        n, before = 0, len(ids)
        for w in _words((text.as_py() or "").lower()):
            if not w:
                continue
            k = known.get(w)
            if k is None:
                if len(w.encode()) > MAX_TERM_BYTES:
                    k = -2
                elif w in STOP[config]:
                    k = -1
                else:
                    k = len(terms)
                    terms.append(stem(config, w))
                known[w] = k
            if k == -2:
                continue
            n += 1
            if k >= 0:
                ids.append(k)
                at.append(n)
        lengths[i] = len(ids) - before
    words = pa.array(terms, pa.string()).take(pa.array(np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32)))
    pos = pa.array(np.frombuffer(at, np.int32) if at else np.zeros(0, np.int32))
    return ragged(np.concatenate([[0], np.cumsum(lengths)]), pa.StructArray.from_arrays([words, pos], ["term", "pos"]))


def analysed_texts(config: str, texts: pa.Array) -> pa.Array:
    """TOKENS of texts, a slice at a time."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    parts = [_analysed(config, texts[a:z]) for a, z in slices(sizes, SLICE_BYTES)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.struct([("term", pa.string()), ("pos", pa.int32())])))



def tokens_col(config: str, text: Column) -> Column:
    """The tokens of a text column: of `simple` the terms alone, whose positions are 1, 2 and so on, else TOKENS. Null and empty
    texts have none."""
    if check_config(config) == "simple":
        return terms_col(config, text)

    @F.arrow_udf(TOKENS)
    def run(texts: pa.Array) -> pa.Array:
        return analysed_texts(config, texts)

    return run(text)


def token_terms(config: str, tokens: Column) -> Column:
    """The terms of tokens_col."""
    return tokens if config == "simple" else F.transform(tokens, lambda t: t["term"])


def terms_col(config: str, text: Column) -> Column:
    """The terms of a text column in order, with repeats."""
    if check_config(config) == "simple":
        words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
        return F.filter(words, lambda w: F.octet_length(w) <= MAX_TERM_BYTES)
    return token_terms(config, tokens_col(config, text))


def grouped(tokens: pa.ListArray) -> pa.Array:
    """POSTINGS of rows of tokens, in the byte order of the terms."""
    offsets = tokens.offsets.to_numpy().astype(np.int64)
    offsets, flat = offsets - offsets[0], tokens.flatten()
    words, pos = (flat.field(0), flat.field(1).to_numpy()) if pa.types.is_struct(flat.type) else (flat, None)
    rows = np.repeat(np.arange(len(tokens)), np.diff(offsets))
    pos = np.arange(len(words)) - offsets[rows] + 1 if pos is None else pos
    words = words.dictionary_encode()
    names = words.dictionary.take(pc.sort_indices(words.dictionary)) if len(words.dictionary) else words.dictionary
    rank = np.empty(len(names), np.int64)
    rank[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(len(names))
    key = rows * max(len(names), 1) + rank[words.indices.to_numpy()]
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    ends = np.concatenate([starts, [len(key)]])
    positions = ragged(ends, pa.array(pos[order].astype(np.int32)))
    cells = pa.StructArray.from_arrays([names.take(pa.array(key[starts] % max(len(names), 1))), pa.array(np.diff(ends)), positions], ["term", "tf", "positions"])
    return ragged(np.searchsorted(key[starts], np.arange(len(tokens) + 1) * max(len(names), 1)), cells)


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of bounded tokens."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False)
        for a, z in slices(sizes, SLICE_TOKENS):
            yield batch.slice(a, z - a)


def postings_of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Instead of the tokens of a row, ps: its POSTINGS."""
    for own in in_slices(batches):
        yield own.drop_columns("tokens").append_column("ps", grouped(own.column("tokens")))


def postings_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each posting, with the other columns of its text."""
    for own in in_slices(batches):
        ps = grouped(own.column("tokens"))
        rows = pa.array(np.repeat(np.arange(own.num_rows), pc.list_value_length(ps).to_numpy()))
        flat = ps.flatten()
        yield pa.RecordBatch.from_arrays([*[own.column(c).take(rows) for c in own.schema.names if c != "tokens"], *[flat.field(i) for i in range(3)]], [*[c for c in own.schema.names if c != "tokens"], "term", "tf", "positions"])


def flatten_array(column: Column) -> Column:
    """An array of texts as one text: null and empty elements skipped, the rest joined by one space."""
    return F.array_join(F.filter(column, lambda x: x.isNotNull() & (x != "")), " ")
