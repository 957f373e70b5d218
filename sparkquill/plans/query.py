"""Query and vector values, their text and binary forms, and builders."""

from __future__ import annotations

import re
import struct
from collections import Counter
from dataclasses import dataclass, field, replace

from ..errors import QuillError
from ..functions.analysis import analyze

MAX_TEXT = 1_000_000
_FUZZY = re.compile(r"fuzzy\((\d+)\):")
_INDEX = re.compile(r'((?:"(?:[^"]|"")+"|[A-Za-z_][A-Za-z0-9_$]*)(?:\.(?:"(?:[^"]|"")+"|[A-Za-z_][A-Za-z0-9_$]*))?):')


@dataclass(frozen=True)
class BM25Query:
    """A query text with the index that it names, if any. fuzzy: None, or the largest edit distance of a term."""

    text: str
    index: str | None = None
    grammar: bool = False
    fuzzy: int | None = field(default=None)

    def __post_init__(self):
        if len(self.text.encode()) > MAX_TEXT:
            raise QuillError("query text is too long")

    @classmethod
    def parse(cls, value: str) -> BM25Query:
        """`[fuzzy(N):][index:]text`."""
        fuzzy = None
        if m := _FUZZY.match(value):
            fuzzy, value = int(m[1]), value[m.end() :]
        m = _INDEX.match(value)
        return cls(value[m.end() :] if m else value, m[1] if m else None, fuzzy=fuzzy)

    def __str__(self) -> str:
        return (f"fuzzy({self.fuzzy}):" if self.fuzzy is not None else "") + (f"{self.index}:" if self.index else "") + self.text

    def to_bytes(self) -> bytes:
        flags = bool(self.index) | (self.fuzzy is not None) << 1 | self.grammar << 2
        name, text = (self.index or "").encode(), self.text.encode()
        return struct.pack(">BBBH", 3, flags, self.fuzzy or 0, len(name)) + name + text

    @classmethod
    def from_bytes(cls, data: bytes) -> BM25Query:
        """Versions 1 (index and text), 2 (with flags) and 3 (with a fuzzy distance)."""
        if not data:
            raise QuillError("empty query value")
        version, at, flags, fuzzy = data[0], 1, 0, 0
        if version not in (1, 2, 3):
            raise QuillError(f"unsupported query version {version}")
        try:
            if version >= 2:
                flags, at = data[at], at + 1
            if version == 3:
                fuzzy, at = data[at], at + 1
            (n,) = struct.unpack_from(">H", data, at)
        except (IndexError, struct.error):
            raise QuillError("query value is cut short") from None
        name, text = data[at + 2 : at + 2 + n].decode(), data[at + 2 + n :].decode()
        return cls(text, name or None, bool(flags & 4), fuzzy if flags & 2 else None)

    def with_index(self, name: str) -> BM25Query:
        return replace(self, index=name)


def to_bm25query(text: str | None, index: str | None = None, grammar: bool = False, fuzzy_max_distance: int | None = None, most: int = 2) -> BM25Query | None:
    """None for a null text. fuzzy_max_distance 0 is an exact query."""
    if text is None:
        return None
    if fuzzy_max_distance is not None and not 0 <= fuzzy_max_distance <= most:
        raise QuillError(f"fuzzy_max_distance must be between 0 and {most}")
    return BM25Query(text, index, grammar, fuzzy_max_distance or None)


def quote(token: str) -> str:
    return re.sub(r'([\\:*"()])', r"\\\1", token)


def bm25_prefix(prefix: str | None, index: str | None = None) -> BM25Query | None:
    return None if prefix is None else BM25Query(f"{prefix}*", index, True)


def bm25_phrase(words: str | list[str] | None, index: str | None = None) -> BM25Query | None:
    """A phrase of a text, or of the words of a list; an empty list is a phrase that fails when it is used."""
    return None if words is None else BM25Query(f'"{words if isinstance(words, str) else " ".join(words)}"', index, True)


def bm25_phrase_prefix(words: str | list[str] | None, index: str | None = None) -> BM25Query | None:
    return None if words is None else BM25Query(f'"{words if isinstance(words, str) else " ".join(words)}*"', index, True)


@dataclass(frozen=True)
class BM25Vector:
    """Term frequencies under an index's configuration; equal if index and frequencies are."""

    index: str
    terms: tuple[tuple[str, int], ...]

    @classmethod
    def of(cls, index: str, config: str, text: str) -> BM25Vector:
        return cls(index, tuple(sorted(Counter(t for t, _ in analyze(config, text)).items())))

    @classmethod
    def parse(cls, value: str) -> BM25Vector:
        """`index:{term:count,...}`; a count of an unquoted term follows its last colon."""
        name, sep, body = value.partition(":{")
        if not sep or not body.endswith("}"):
            raise QuillError(f"malformed vector {value!r}")
        found: Counter = Counter()
        for part in filter(None, body[:-1].split(",")):
            term, sep, count = part.rpartition(":")
            if not sep or not term or not count.isdigit() or not int(count):
                raise QuillError(f"malformed vector entry {part!r}")
            found[term] += int(count)
        return cls(name, tuple(sorted(found.items())))

    def __str__(self) -> str:
        return f"{self.index}:{{{','.join(f'{t}:{n}' for t, n in self.terms)}}}"

    def to_bytes(self) -> bytes:
        return struct.pack(">B", 1) + str(self).encode()

    @classmethod
    def from_bytes(cls, data: bytes) -> BM25Vector:
        if data[:1] != b"\1":
            raise QuillError("unsupported vector version")
        return cls.parse(data[1:].decode())
