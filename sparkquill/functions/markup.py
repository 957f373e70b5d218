"""HTML and Markdown to searchable text, with a map from each output byte back to source bytes."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QuillError

_FORMATS = {"plain": "plain", "html": "html", "markdown": "markdown", "md": "markdown"}
_DROP = {"script", "style", "template"}
_ENTITY = re.compile(r"&(?:#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]{1,31};?)")


def check_format(name: str) -> str:
    try:
        return _FORMATS[name.lower()]
    except KeyError:
        raise QuillError(f"unknown content format {name!r}") from None


class Pieces:
    """Text with the source span of every character, in characters of the source."""

    def __init__(self):
        self.chars: list[str] = []
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str, start: int, end: int | None = None) -> None:
        """A run that stands for source[start:]; with end, every character stands for the whole of [start, end)."""
        for i, c in enumerate(text):
            self.chars.append(c)
            self.spans.append((start + i, start + i + 1) if end is None else (start, end))

    def space(self, at: int) -> None:
        if self.chars:
            self.chars.append(" ")
            self.spans.append((at, at))

    def text(self) -> str:
        return "".join(self.chars)


class Runs:
    """The text of Pieces alone: runs as they come, no spans."""

    def __init__(self):
        self.runs: list[str] = []

    def add(self, text: str, start: int, end: int | None = None) -> None:
        if text:
            self.runs.append(text)

    def space(self, at: int) -> None:
        if self.runs:
            self.runs.append(" ")

    def text(self) -> str:
        return "".join(self.runs)


class _Html(HTMLParser):
    def __init__(self, source: str):
        super().__init__(convert_charrefs=False)
        self.lines = [0]
        for i, c in enumerate(source):
            if c == "\n":
                self.lines.append(i + 1)
        self.out, self.drop, self.fresh = Pieces(), 0, True

    def at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _run(self, text: str, start: int, end: int | None = None) -> None:
        if self.drop:
            return
        if self.fresh:
            self.out.space(start)
        self.fresh = False
        self.out.add(text, start, end)

    def handle_starttag(self, tag, attrs):
        self.fresh = True
        if tag in _DROP:
            self.drop += 1

    def handle_startendtag(self, tag, attrs):
        self.fresh = True

    def handle_endtag(self, tag):
        self.fresh = True
        if tag in _DROP and self.drop:
            self.drop -= 1

    def handle_comment(self, data):
        self.fresh = True

    def handle_data(self, data):
        self._run(data, self.at())

    def handle_entityref(self, name):
        raw = f"&{name};"
        self._run(html.unescape(raw), self.at(), self.at() + len(raw))

    def handle_charref(self, name):
        raw = f"&#{name};"
        self._run(html.unescape(raw), self.at(), self.at() + len(raw))


_TAG = re.compile(r"</?[A-Za-z][^<>]*>")


def html_pieces(source: str) -> Pieces:
    """Text nodes joined by one space; script, style and template are dropped; entities decoded. What decodes to a tag is
    dropped as well, as the text parser behind it would do."""
    p = _Html(source)
    p.feed(source)
    p.close()
    text = p.out.text()
    if "<" not in text:
        return p.out
    out, at = Pieces(), 0
    for m in [*_TAG.finditer(text), None]:
        end = len(text) if m is None else m.start()
        out.chars += p.out.chars[at:end]
        out.spans += p.out.spans[at:end]
        if m is not None:
            out.space(p.out.spans[m.start()][0])
            at = m.end()
    return out


_SIX = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " "}
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[^`]*$")
_LEAD = re.compile(r"(?: {0,3}>[ ]?)*(?: {0,3}(?:[-+*]|[0-9]{1,9}[.)])[ \t]+(?:\[[ xX]\][ \t]+)?)*(?: {0,3}#{1,6}(?:[ \t]+|$))?[ \t]*")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,}|=+[ \t]*)$")
_TABLE_RULE = re.compile(r"[ \t|:-]*-[ \t|:-]*$")
_INLINE = re.compile(
    r"\\(?P<escape>[!-/:-@\[-`{-~])|(?P<ticks>`+)(?P<code>.+?)(?<!`)(?P=ticks)(?!`)|!?\[(?P<label>(?:[^\[\]\\]|\\.)*)\](?:\([^()\s]*(?:\([^()]*\)[^()\s]*)*(?:\s+(?:\"[^\"]*\"|'[^']*'))?\)|\[[^\]]*\])"
    r"|<(?P<auto>(?:https?|ftp|mailto):[^<>\s]+|[^<>\s@]+@[^<>\s]+)>|(?P<entity>&[A-Za-z#][A-Za-z0-9]*;)|(?P<mark>\*+|~~|(?<![A-Za-z0-9_])_+|_+(?![A-Za-z0-9_])|\|)",
    re.S,
)


def _inline(out: Pieces | Runs, text: str, start: int) -> None:
    """Runs of text, each with a space before it."""

    def run(a: int, z: int) -> None:
        if z > a:
            out.space(start + a)
            out.add(text[a:z], start + a)

    at = 0
    for m in _INLINE.finditer(text):
        if m["escape"]:
            run(at, m.start())
            at = m.start("escape")  # the escaped sign begins the next run
            continue
        run(at, m.start())
        at = m.end()
        if m["code"] is not None:
            run(m.start("code"), m.end("code"))
        elif m["label"] is not None:
            _inline(out, m["label"], start + m.start("label"))
        elif m["auto"]:
            run(m.start("auto"), m.end("auto"))
        elif m["entity"] and m[0] in _SIX:
            out.space(start + m.start())
            out.add(_SIX[m[0]], start + m.start(), start + m.end())
    run(at, len(text))


def markdown_pieces(source: str, out: Pieces | Runs | None = None) -> Pieces | Runs:
    """Text, code and formula runs; marks, link targets and unknown entities are dropped. Raw HTML is ordinary text."""
    out, at, fence = Pieces() if out is None else out, 0, None
    for line in source.splitlines(keepends=True):
        body = line.rstrip("\r\n")
        m = _FENCE.match(body)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not body.strip().strip(fence[0]):
                fence = None
            elif body:
                out.space(at)
                out.add(body, at)
        elif m:
            fence = m[1]
        elif not _RULE.match(body) and not (_TABLE_RULE.match(body) and "|" in body):
            lead = _LEAD.match(body).end()
            text = re.sub(r"[ \t]+#+[ \t]*$", "", body[lead:]) if "#" in body[:lead] else body[lead:]
            _inline(out, text.replace("$", " "), at + lead)
        at += len(line)
    return out


def pieces(kind: str, source: str) -> Pieces | None:
    """None for plain text, which stands for itself."""
    kind = check_format(kind)
    return None if kind == "plain" else html_pieces(source) if kind == "html" else markdown_pieces(source)


def normalise(kind: str, source: str | None) -> str | None:
    if source is None:
        return None
    if check_format(kind) == "markdown":
        return markdown_pieces(source, Runs()).text()
    p = pieces(kind, source)
    return source if p is None else p.text()


def byte_maps(kind: str, source: str) -> tuple[bytes, list[int] | None, list[int] | None]:
    """Normalised bytes, and for each the first and the end byte of its source; None where the text is plain."""
    p = pieces(kind, source)
    if p is None:
        return source.encode(), None, None
    at = [0]
    for c in source:
        at.append(at[-1] + len(c.encode()))
    out, starts, ends = [], [], []
    for c, (a, z) in zip(p.chars, p.spans, strict=True):
        raw = c.encode()
        out.append(raw)
        starts += [at[a]] * len(raw)
        ends += [at[z]] * len(raw)
    return b"".join(out), starts, ends


def normalise_col(kind: str, text: Column) -> Column:
    kind = check_format(kind)
    if kind == "plain":
        return text

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: normalise(kind, x))

    return run(text)
