"""Match ranges in a text, snippets and headlines; all offsets are bytes of UTF-8, ends exclusive."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import QuillError
from .analysis import MAX_TERM_BYTES, normalise_word
from .markup import byte_maps

_TOKEN = re.compile(rb"[A-Za-z0-9_\x80-\xff]+")
EXACT, PREFIX, PHRASE, PHRASE_PREFIX = "exact", "prefix", "phrase", "phrase_prefix"


@dataclass(frozen=True)
class Plan:
    """What to mark in one field. exact: terms. prefixes: (raw prefix, expansions to report). phrases: (terms, is the last
    one a prefix)."""

    config: str
    exact: frozenset[str]
    prefixes: tuple[tuple[str, tuple[str, ...]], ...] = ()
    phrases: tuple[tuple[tuple[str, ...], bool], ...] = ()
    fmt: str = "plain"


@dataclass(frozen=True, order=True)
class Range:
    start: int
    end: int
    term: str
    kind: str


def tokens(config: str, data: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, lower-cased word, term); stop words are skipped and leave no gap."""
    out = []
    for m in _TOKEN.finditer(data):
        word = m[0].decode("utf-8", "ignore").lower()
        if word and len(word.encode()) <= MAX_TERM_BYTES and (term := normalise_word(config, word)) is not None:
            out.append((m.start(), m.end(), word, term))
    return out


def ranges(plan: Plan, data: bytes) -> list[Range]:
    toks, out = tokens(plan.config, data), set()
    for a, z, _, term in toks:
        if term in plan.exact:
            out.add(Range(a, z, term, EXACT))
        for prefix, names in plan.prefixes:
            if term.startswith(prefix):
                out.add(Range(a, z, next((n for n in names if term.startswith(n)), prefix), PREFIX))
    for terms, prefix in plan.phrases:
        if None in terms:
            continue
        for i in range(len(toks) - len(terms) + 1):
            own = [t[3] for t in toks[i : i + len(terms)]]
            fits = own[:-1] == list(terms[:-1]) and (own[-1].startswith(terms[-1]) if prefix else own[-1] == terms[-1])
            if fits:  # one range for the whole phrase
                out.add(Range(toks[i][0], toks[i + len(terms) - 1][1], " ".join(terms), PHRASE_PREFIX if prefix else PHRASE))
    return sorted(out)


def _select(found: list[Range], limit: int | None, offset: int) -> list[Range]:
    if offset < 0:
        raise QuillError("offset must not be negative")
    if limit is not None and limit < 0:
        raise QuillError("limit must not be negative")
    return found[offset:] if limit is None else found[offset : offset + limit]


def _boundary(data: bytes, at: int, step: int) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at += step
    return at


def snippet(plan: Plan, text: str | None, start_tag: str = "<b>", end_tag: str = "</b>", max_num_chars: int = 150, limit: int | None = None, offset: int = 0) -> str | None:
    """Normalised text around the first selected match with every selected match tagged; '' without a match."""
    if max_num_chars <= 0:
        raise QuillError("max_num_chars must be positive")
    if text is None:
        return None
    data = byte_maps(plan.fmt, text)[0]
    chosen = _select(ranges(plan, data), limit, offset)
    if not chosen:
        return ""
    low, high = 0, len(data)
    if high > max_num_chars:
        middle = (chosen[0].start + chosen[0].end) // 2
        low = max(0, min(middle - max_num_chars // 2, len(data) - max_num_chars))
        high = _boundary(data, low + max_num_chars, 1)
        low = _boundary(data, low, -1)
    out, at = [], low
    for r in chosen:
        a, z = max(r.start, low), min(r.end, high)
        if z <= a:
            continue
        if a >= at:
            out += (data[at:a], start_tag.encode(), data[a:z], end_tag.encode())
            at = z
        else:  # the same span again, under another type: an empty pair
            out += (start_tag.encode(), data[at:z] if z > at else b"", end_tag.encode())
            at = max(at, z)
    return (b"".join(out) + data[at:high]).decode("utf-8", "ignore")


def _source(maps, r: Range) -> tuple[int, int]:
    _, starts, ends = maps
    return (r.start, r.end) if starts is None else (starts[r.start], ends[r.end - 1])


def positions(plan: Plan, text: str | None, limit: int | None = None, offset: int = 0) -> list[tuple[int, int]] | None:
    """Byte ranges in the source text."""
    if text is None:
        return None
    maps = byte_maps(plan.fmt, text)
    return [_source(maps, r) for r in _select(ranges(plan, maps[0]), limit, offset)]


def headline(plan: Plan, text: str | None) -> dict:
    """Snippet, positions and matches of one field; a null field has no snippet and no matches."""
    if text is None:
        return {"snippet": None, "positions": [], "matches": []}
    maps = byte_maps(plan.fmt, text)
    source = text.encode()
    found = [(r, *_source(maps, r)) for r in ranges(plan, maps[0])]
    return {
        "snippet": snippet(plan, text),
        "positions": [{"start": a, "end": z} for _, a, z in found],
        "matches": [{"start": a, "end": z, "term": r.term, "matched_text": source[a:z].decode("utf-8", "ignore"), "match_type": r.kind} for r, a, z in found],
    }
