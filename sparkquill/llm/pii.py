"""PII with offset-preserving deobfuscation.

Plain identifiers are found in the text as it is. Then transducers rewrite the text, each keeping for every character of
its output the span of source characters it stands for: homoglyphs become ASCII, spelled digits become digits, and
at/dot disguises become @ and a full stop. Identifiers are detected in the normalised text and their spans
are mapped back to the source; those that overlap no plain span, or contain those that they overlap, are added.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits that fails at its first digit fails at all others, and possessive runs never give digits back
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def plain(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the identifiers in the text as it is, sorted."""
    out = [(a, 0, z) for a, z in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p) < 20 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    out.sort()
    return out


# ---- transducers

_SAME = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n", "ɡ": "g",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ѕ": "S",
    "ο": "o", "α": "a", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ", "﹢": "+",
}
_SAME |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}  # full-width forms
_SAME |= {chr(z + d): str(d) for z in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
_GONE = "​‌‍⁠﻿­"
_GLYPH, _INVISIBLE = re.compile("[" + "".join(map(re.escape, _SAME)) + "]"), re.compile(f"[{_GONE}]+")
_TABLE = {ord(k): v for k, v in _SAME.items()}

_SPELLED = {w: str(d) for d, ws in enumerate((
    "zero oh null zéro cero", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco",
    "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve",
)) for w in ws.split()}
_DIGIT = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + ")"
# seven digits or more in a row, at least one of them spelled
_SPELLED_RUN = re.compile(rf"\b(?:plus[\x20-]+)?(?:{_DIGIT}|[0-9])(?:[\x20,.-]{{1,2}}(?:{_DIGIT}|[0-9]+|dash|dot|point)\b){{6,}}", re.I)
_SPELLED_WORD = re.compile(rf"{_DIGIT}\b|plus[\x20-]+|[\x20,.-]*(?:dot|point)\b[\x20,.-]*|[\x20,.-]*dash\b[\x20,.-]*|[\x20,.-]+", re.I)
_HINT_DIGIT = re.compile(rf"\b{_DIGIT}[\x20,.-]{{1,2}}(?:{_DIGIT}|[0-9])", re.I)

_AT = r"\s?(?:[\[({<]\s?(?:at|arroba|arobase|@)\s?[\])}>])\s?|\s@\s|\sarroba\s"
_DOT = r"\s?(?:[\[({<]\s?(?:dot|punto|punkt|point|\.)\s?[\])}>])\s?|\sdot\s"
_HOST_DOT = rf"{_DOT}|\s\.\s|\spunto\s"
# a bare " at " counts only with a disguised dot after it; a bracketed at or a spaced @ also with a plain full stop. At most
# 16 parts before the at and 17 labels behind it
_DISGUISED = re.compile(
    rf"[A-Za-z0-9_%+-]{{1,64}}(?:(?:{_DOT}|\.)[A-Za-z0-9_%+-]{{1,64}}){{0,15}}"
    rf"(?:(?:{_AT})[A-Za-z0-9-]{{1,63}}(?:(?:{_HOST_DOT}|\.)[A-Za-z0-9-]{{1,63}}){{1,16}}|(?:\sat\s|@)[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}}){{0,15}}(?:(?:{_DOT})[A-Za-z0-9-]{{1,63}}){{1,16}})",
    re.I,
)
_HINT_AT = re.compile(r"[\[({<]\s?(?:at|arroba|arobase|dot|punto|punkt|point|@|\.)\s?[\])}>]|\sdot\s|\s@\s|\sarroba\s", re.I)
_AT_PART = re.compile(rf"{_AT}|\sat\s", re.I)
_DOT_PART = re.compile(_HOST_DOT, re.I)


class _Layer:
    """The edits of one rewriting, as sorted places: memory grows with the edits, not with the text."""

    def __init__(self):
        self.begin, self.stop, self.old_begin, self.old_stop = (array("q") for _ in range(4))

    def start(self, i: int) -> int:
        """Where what character i stands for begins in the text before."""
        k = bisect_right(self.begin, i) - 1
        if k < 0:
            return i
        return self.old_begin[k] if i < self.stop[k] else i - self.stop[k] + self.old_stop[k]

    def end(self, i: int) -> int:
        k = bisect_right(self.begin, i) - 1
        return self.old_stop[k] if k >= 0 and i < self.stop[k] else self.start(i) + 1


class Mapped:
    """A text and how it came from its source: layers of edits, the last one first to be undone."""

    def __init__(self, text: str, layers: tuple[_Layer, ...] = ()):
        self.text, self.layers = text, layers

    def source(self, a: int, z: int) -> tuple[int, int]:
        """The source characters of [a, z), which is not empty."""
        for layer in reversed(self.layers):
            a, z = layer.start(a), layer.end(z - 1)
        return a, z

    def rewrite(self, edits: Iterable[tuple[int, int, str]]) -> Mapped:
        """Replace each [a, z) by its string; the replacement stands for all that it replaces."""
        layer, text, at, moved = _Layer(), [], 0, 0
        for a, z, new in edits:
            text += (self.text[at:a], new)
            layer.begin.append(a + moved)
            layer.stop.append(a + moved + len(new))
            layer.old_begin.append(a)
            layer.old_stop.append(z)
            moved += len(new) - (z - a)
            at = z
        return Mapped("".join((*text, self.text[at:])), (*self.layers, layer)) if layer.begin else self


def homoglyphs(m: Mapped) -> Mapped:
    """Characters that look alike are replaced one by one, so no place moves; invisible ones go."""
    if m.text.isascii():
        return m
    if _GLYPH.search(m.text):
        m = Mapped(m.text.translate(_TABLE), m.layers)
    return m.rewrite((x.start(), x.end(), "") for x in _INVISIBLE.finditer(m.text))


def spelled_digits(m: Mapped) -> Mapped:
    if not _HINT_DIGIT.search(m.text):
        return m
    edits = []
    for run in _SPELLED_RUN.finditer(m.text):
        for x in _SPELLED_WORD.finditer(m.text, run.start(), run.end()):
            w = x[0].strip(" ,.-").lower()
            new = _SPELLED.get(w) or {"plus": "+", "dot": ".", "point": ".", "dash": "-"}.get(w, "")
            if x.start() > run.start() or w:
                edits.append((x.start(), x.end(), new))
    return m.rewrite(edits)


def at_dot(m: Mapped) -> Mapped:
    if not _HINT_AT.search(m.text):
        return m
    edits = []
    for run in _DISGUISED.finditer(m.text):
        parts = [(x.start(), x.end(), "@") for x in _AT_PART.finditer(m.text, run.start(), run.end())]
        parts += [(x.start(), x.end(), ".") for x in _DOT_PART.finditer(m.text, run.start(), run.end())]
        last = -1
        for p in sorted(parts):
            if p[0] >= last:
                edits.append(p)
                last = p[1]
    return m.rewrite(edits)


def spelled_phones(m: Mapped) -> list[tuple[int, int]]:
    """Source spans of runs with at least seven spelled digits that stand for 10 to 15 digits: telephone numbers without +."""
    if not _HINT_DIGIT.search(m.text):
        return []
    out = []
    for run in _SPELLED_RUN.finditer(m.text):
        parts = [x.lower() for x in re.findall(r"[A-Za-z]+|[0-9]", run[0])]
        if sum(p in _SPELLED for p in parts) >= 7 and 10 <= sum(p in _SPELLED or p.isdigit() for p in parts) <= 15:
            out.append(m.source(run.start(), run.end()))
    return out


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The plain spans and all spans, both sorted (start, rank, end), in code points of the source."""
    base = plain(text)
    clear = homoglyphs(Mapped(text))
    m = at_dot(spelled_digits(clear))
    if m.text is text:
        return base, base
    more, covered = [], [(a, z) for a, _, z in base]
    # apart from plain spans, or longer than those that it overlaps
    free = lambda s, e: all(y <= s or e <= x or (s <= x and y <= e and (s, e) != (x, y)) for x, y in covered)
    for a, k, z in plain(m.text):
        s, e = m.source(a, z)
        if free(s, e):
            more.append((s, k, e))
    covered += [(a, z) for a, _, z in more]
    more += [(s, 3, e) for s, e in spelled_phones(clear) if free(s, e)]
    return base, sorted(base + more)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, redacted) of every row; counts are of plain spans.

    Offsets are code points, end exclusive, in the source text. redacted is the text with every span replaced by its kind
    in brackets; of spans that overlap the first is replaced, up to the last end. Null and empty texts have no spans and
    redact to the empty text. Rows that repeat an id each get their own result.
    """

    def run(batches):
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                text = text or ""
                base, spans = find(text)
                counts = [0] * 4
                for _, k, _ in base:
                    counts[k] += 1
                safe, at = [], 0
                for a, k, z in spans:
                    if a >= at:
                        safe += (text[at:a], f"[{KINDS[k]}]")
                    at = max(at, z)
                out.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), "".join(safe) + text[at:]))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], _NAMES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SCHEMA)


_NAMES = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "redacted"]
_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_pii(table(spark, sf_dir, "documents")).drop("redacted")
