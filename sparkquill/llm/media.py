"""Media columns: interleaved document sequences whose media references are digests into a payload store.

A sequence is an ordered array of parts: text, or a reference to a payload by its SHA-256 with its caption. HTML pages are
parsed into such sequences. Payloads that a page carries itself are stored once a task, keyed by digest, as lossless 8-bit
greyscale PNG images 64 samples wide. References are resolved by a join on the digest; what is read back is decoded and
checked against it. A sequence has a row number of its own, so pages that repeat an id, or have none, stay apart.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, saved, small_batches, table

WIDTH = 64
_SIGN = b"\x89PNG\r\n\x1a\n"

# ---- PNG, 8-bit greyscale


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of WIDTH."""
    return data + b"\0" * (-len(data) % WIDTH or (WIDTH if not data else 0))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 before each line
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGN + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of a PNG that to_png wrote. ValueError if it is damaged."""
    if media[:8] != _SIGN:
        raise ValueError("not a PNG")
    at, data, height = 8, [], 0
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", body)
            if (width, depth, colour, *rest) != (WIDTH, 8, 0, 0, 0, 0):
                raise ValueError("not an 8-bit greyscale PNG of this width")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("a line has a filter")
    return lines[:, 1:].tobytes()


# ---- the payload store

_STORE = "digest string, n_bytes long, media binary"


class _Store:
    """Stored forms of payloads, each digest once a task (as far as a bounded set of digests goes)."""

    def __init__(self, most: int = 1 << 20):
        self.done: set[bytes] = set()
        self.most = most

    def rows(self, payloads: list[bytes]) -> list[dict]:
        out = []
        for data in payloads:
            sha = hashlib.sha256(data).digest()
            if sha not in self.done:
                if len(self.done) < self.most:
                    self.done.add(sha)
                out.append({"digest": sha.hex(), "n_bytes": len(data), "media": to_png(pad(data))})
        return out


def payload_store(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(digest, n_bytes, media): payloads (binary; null: empty) padded and stored, once a task at most. digest: of the unpadded payload."""

    def run(batches):
        store = _Store()
        for b in batches:
            rows = store.rows([x.as_py() or b"" for x in b.column(0)])
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in (("digest", pa.string()), ("n_bytes", pa.int64()), ("media", pa.binary()))], ["digest", "n_bytes", "media"])

    return payloads.select(F.coalesce(F.col(column), F.lit(b"")).alias("payload")).mapInArrow(run, _STORE)


_FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_features(store: DataFrame) -> DataFrame:
    """One row a digest, from the stored bytes: read back, checked against the digest, measured.

    feature: mean and standard deviation of the samples, share of zero samples, and mean step between neighbours, then an
    8-bin histogram, all integers, joined by commas.
    """

    def run(batches):
        for b in batches:
            rows = []
            for digest, n, media in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                payload = from_png(media)
                if hashlib.sha256(payload[:n]).hexdigest() != digest or any(payload[n:]):
                    raise ValueError(f"payload {digest} is damaged")
                x = np.frombuffer(payload, np.uint8)
                total, square = int(x.sum(dtype=np.int64)), int((x.astype(np.uint32) ** 2).sum(dtype=np.int64))
                step = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64))
                bins = np.bincount(x >> 5, minlength=8)
                k = len(x)
                values = [total * 1000 // k, (square * k - total * total) * 1000 // (k * k), int((x == 0).sum()) * 1000 // k, step * 1000 // max(1, k - 1), *(bins * 1000 // k).tolist()]
                rows.append((digest, n, k, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), ",".join(map(str, values))))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in _FEATURES.split(", ")])

    return store.select("digest", "n_bytes", "media").mapInArrow(run, _FEATURES)


# ---- sequences

PART = "struct<pos:int,kind:string,text:string,digest:string,caption:string,source:string>"
_MEDIA = {"img", "video", "audio", "source", "embed"}
_BLOCK = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "table", "tr", "td", "th", "br", "nav", "header", "footer", "figure", "figcaption", "body", "html", "title", "pre", "blockquote"}
_DROP = {"script", "style", "template", "noscript"}


class _Interleave(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.payloads: list[tuple[str, bytes]] = []
        self.run: list[str] = []
        self.drop = self.figure = self.caption = 0
        self.words: list[str] = []
        self.open: list[int] = []

    def flush(self):
        text = " ".join("".join(self.run).split())
        self.run.clear()
        if text:
            self.parts.append({"kind": "text", "text": text, "digest": None, "caption": None, "source": None})

    def handle_starttag(self, tag, attrs):
        if tag in _DROP:
            self.drop += 1
        elif tag == "figure":
            self.flush()
            self.figure += 1
        elif tag == "figcaption" and self.figure:
            self.flush()
            self.caption += 1
            self.words.clear()
        elif tag in _MEDIA and not self.drop:
            a = dict(attrs)
            src = a.get("src") or ""
            if not src:
                return
            self.flush()
            digest = None
            if src[:5].lower() == "data:" and "," in src:
                head, body = src.split(",", 1)
                try:
                    data = base64.b64decode(body) if head.lower().endswith(";base64") else body.encode()
                except (binascii.Error, ValueError):
                    data = b""
                digest = hashlib.sha256(data).hexdigest()
                self.payloads.append((digest, data))
                src = head
            else:
                digest = "at:" + hashlib.sha256(src.encode()).hexdigest()  # an outside payload is looked up by its address
            self.parts.append({"kind": "media", "text": None, "digest": digest, "caption": a.get("alt") or None, "source": src})
            if self.figure:
                self.open.append(len(self.parts) - 1)
        elif tag in _BLOCK:
            self.flush()

    def handle_endtag(self, tag):
        if tag in _DROP:
            self.drop = max(0, self.drop - 1)
        elif tag == "figcaption" and self.caption:
            self.caption -= 1
            text = " ".join("".join(self.words).split())
            for i in self.open:
                self.parts[i]["caption"] = text or self.parts[i]["caption"]
        elif tag == "figure" and self.figure:
            self.figure -= 1
            self.open.clear()
        elif tag in _BLOCK:
            self.flush()

    def handle_data(self, data):
        if not self.drop:
            (self.words if self.caption else self.run).append(data)


def parse_html(html: str | None) -> tuple[list[dict], list[tuple[str, bytes]]]:
    """The parts in order, with positions, and the payloads that the page carries itself (data: addresses)."""
    p = _Interleave()
    p.feed(html or "")
    p.close()
    p.flush()
    return [{"pos": i, **x} for i, x in enumerate(p.parts)], p.payloads


def interleave(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(row, id, parts array<PART>, stored array<struct<digest, n_bytes, media>>) of every row: its sequence, and the payloads
    that it carries and no page of its task before. row tells sequences apart; write the table before using it twice. Null
    and empty pages have no parts."""
    kind = pages.schema[id_col].dataType.simpleString()
    part = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string()), ("source", pa.string())]))
    load = pa.list_(pa.struct([("digest", pa.string()), ("n_bytes", pa.int64()), ("media", pa.binary())]))

    def run(batches):
        store, row = _Store(), TaskContext.get().partitionId() << 33
        try:
            for whole in batches:
                for i in range(0, len(whole), 250):  # few at a time: payloads are held twice
                    b = whole.slice(i, 250)
                    found = [parse_html(x.as_py()) for x in b.column(1)]
                    own = [pa.array(range(row, row + len(b)), pa.int64()), b.column(0), pa.array([f[0] for f in found], part), pa.array([store.rows([x for _, x in f[1]]) for f in found], load)]
                    row += len(b)
                    yield pa.RecordBatch.from_arrays(own, ["row", "id", "parts", "stored"])
        finally:
            release()

    with small_batches(pages.sparkSession):
        return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(run, f"row long, id {kind}, parts array<{PART}>, stored array<struct<digest:string,n_bytes:long,media:binary>>")


def resolve(sequences: DataFrame, found: DataFrame) -> DataFrame:
    """(row, id, parts array<struct<part, media>>): sequences (row, id, parts) with what `found` has for each digest beside
    every media part; order, positions and captions stay. found: (digest, ...), one row a digest or equal rows. A digest
    without a row stays unresolved (null). Sequences that repeat an id stay apart."""
    columns = [c for c in found.columns if c != "digest"]
    one = found.groupBy("digest").agg(*[F.first(c).alias(c) for c in columns]).select("digest", F.struct(*columns).alias("media"))
    # a table of its own: a join with a bare aggregate could not split a digest that very many sequences refer to
    one = saved(found.sparkSession, one, "media-found")
    parts = sequences.select("row", "id", F.posexplode_outer("parts").alias("i", "part"))
    # text parts have no digest and would all meet in one task: only media parts go to the join
    media = parts.where("part.digest is not null").withColumn("digest", F.col("part.digest"))
    media = media.join(one, "digest", "left").select("row", "id", "i", "part", "media")
    text = parts.where("part.digest is null").select("row", "id", "i", "part", F.lit(None).cast(media.schema["media"].dataType).alias("media"))
    both = media.unionByName(text).groupBy("row").agg(F.first("id").alias("id"), F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "part", "media")))).alias("parts"))
    return both.select("row", "id", F.transform("parts", lambda p: F.struct(p["part"].alias("part"), p["media"].alias("media"))).alias("parts"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document becomes a page with one figure: its whole text is the payload, language and source are the caption. The
    pages are parsed into sequences, payloads stored by digest, read back and measured, and joined to the references."""
    docs = table(spark, sf_dir, "documents")
    page = F.concat(F.lit('<figure><img src="data:application/octet-stream;base64,'), F.base64(F.coalesce(F.col("text"), F.lit("")).cast("binary")), F.lit('"><figcaption>'), F.translate(F.concat_ws(" ", "lang", "source"), "<&", "  "), F.lit("</figcaption></figure>"))
    pages = saved(spark, interleave(docs.select("doc_id", page.alias("html")), "doc_id"), "media-sequences", codec="none")
    found = payload_features(pages.select(F.explode("stored").alias("s")).select("s.*"))
    out = resolve(pages.select("row", "id", "parts"), found)
    return out.select(F.col("id").alias("doc_id"), F.element_at("parts", 1)["media"].alias("m")).select("doc_id", "m.*")
