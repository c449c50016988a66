"""Media columns: HTML becomes an ordered sequence of text and media references, and digests lead to the stored payloads.

A sequence holds structs (position, kind, text, ref, caption): runs of text and media references in the order of the page; a figure's
caption, else the reference's alt or title, stays with its reference. References that carry a digest (sha256:<hex>) are resolved by
a join on it; payloads themselves never travel with it, only what was computed from them where they are stored.
"""
from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

MEDIA_TAGS = ("img", "video", "audio", "source", "embed")
SKIPPED = ("script", "style", "template", "noscript")
BLOCKS = ("address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li",
          "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul")
ITEM = "struct<position:int,kind:string,text:string,ref:string,caption:string>"
WIDTH = 576  # samples of a row: a payload is a grey picture of this width
PAD = 255
PNG = b"\x89PNG\r\n\x1a\n"


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.skip, self.figures, self.caption = 0, [], None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag in MEDIA_TAGS:
            a = dict(attrs)
            if ref := a.get("src") or a.get("data-src"):
                self.flush()
                self.items.append({"position": len(self.items), "kind": tag, "text": None, "ref": ref, "caption": a.get("alt") or a.get("title")})
                if self.figures:
                    self.figures[-1].append(len(self.items) - 1)
                    self.items[-1]["caption"] = getattr(self.figures[-1], "caption", "") or self.items[-1]["caption"]
        elif tag == "figure":
            self.flush()
            self.figures.append([])
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in BLOCKS:
            self.flush()

    def handle_startendtag(self, tag, attrs):
        if tag not in SKIPPED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and self.caption is not None:
            caption = " ".join("".join(self.caption).split())
            self.caption = None
            mine = self.figures[-1] if self.figures else []
            for k in mine:
                self.items[k]["caption"] = caption or self.items[k]["caption"]
            if not mine and self.figures:  # a caption before its media
                self.figures[-1] = _Pending(caption)
        elif tag == "figure" and self.figures:
            self.flush()
            self.figures.pop()
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if self.skip:
            return
        (self.text if self.caption is None else self.caption).append(data)


class _Pending(list):
    """Media of a figure whose caption came first: each that is added takes it."""

    def __init__(self, caption: str):
        super().__init__()
        self.caption = caption


def sequence(html: str) -> list[dict]:
    """Text and media references of a page, in order. Broken HTML gives what can be read of it."""
    p = _Sequence()
    p.feed(html)
    p.close()
    if p.caption:
        p.text = p.caption
    p.flush()
    return p.items


def sequences(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, items. Null HTML gives no items; repeated rows give repeated rows."""
    item = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(k, 256) for k in range(0, b.num_rows, 256)):
                items = [sequence(h or "") for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(items, item)], ["id", "items"])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")).mapInArrow(run, f"id long, items array<{ITEM}>")


def digest_of(ref: Column) -> Column:
    """The digest that a reference carries, else null."""
    return F.nullif(F.lower(F.regexp_extract(ref, "sha256:([0-9A-Fa-f]{64})", 1)), F.lit(""))


def resolve(seq: DataFrame, payloads: DataFrame) -> DataFrame:
    """id, position, kind, text, ref, caption and, for references with a digest, the columns of `payloads` (one row for each digest).
    Every item stays, in its place; a digest that is not stored has null payload columns."""
    items = seq.select("id", F.explode("items").alias("i")).select("id", "i.*").withColumn("digest", digest_of(F.col("ref")))
    return items.join(payloads, "digest", "left")


# ---- payloads as pictures -------------------------------------------------------------------------------------------
def payload_of(raw: bytes) -> bytes:
    """The bytes, filled up to a positive multiple of WIDTH."""
    return raw + bytes([PAD]) * (-len(raw) % WIDTH if raw else WIDTH)


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    """A grey 8-bit picture, a sample for each byte."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)  # each line opens with filter 0: samples as they are
    lines[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of a picture that `to_png` wrote; checks its chunks."""
    if media[:8] != PNG:
        raise ValueError("not a PNG file")
    at, width, height, data = 8, 0, 0, []
    while at < len(media):
        size, = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4:at + 8], media[at + 8:at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("only grey pictures of 8 bits")
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only lines without a filter")
    return lines[:, 1:].tobytes()


def features(samples: bytes) -> str:
    """Mean, deviation, share of neighbours that differ, and a histogram of eight equal ranges."""
    a = np.frombuffer(samples, np.uint8)
    edges = np.count_nonzero(a[1:] != a[:-1]) / max(len(a) - 1, 1)
    bins = np.bincount(a >> 5, minlength=8)
    return f"mean={a.mean():.6f};std={a.std():.6f};edges={edges:.6f};hist=" + ",".join(map(str, bins))


def store_texts(docs: DataFrame) -> DataFrame:
    """A table (doc_id, digest, n_bytes, media) in the shared folder: each text's payload as a picture, named by its SHA-256."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(k, 256) for k in range(0, b.num_rows, 256)):
                raw = [(t or "").encode() for t in part.column(1).to_pylist()]
                media = [to_png(payload_of(r)) for r in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array([len(r) for r in raw], pa.int64()),
                                                  pa.array(media, pa.binary())], ["doc_id", "digest", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, digest string, n_bytes long, media binary")
    return written(rows, "media")


def described(stored: DataFrame) -> DataFrame:
    """One row for each digest, computed from the stored bytes: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature."""
    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, m in zip(b.column(0).to_pylist(), b.column(1)):
                media = m.as_py()
                back = from_png(media)
                rows.append((digest, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(back)))
            columns = list(zip(*rows)) or [()] * 7
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in schema.split(", ")])

    return stored.select("digest", "media").mapInArrow(run, schema).dropDuplicates(["digest"])


def document_pages(stored: DataFrame, docs_title: str = "Document") -> DataFrame:
    """doc_id, html: a page for each stored document that shows its picture with a caption."""
    shown = F.coalesce(F.col("doc_id").cast("string"), F.lit("without id"))
    return stored.select("doc_id", F.concat(
        F.lit(f"<article><h1>{docs_title} "), shown, F.lit('</h1><figure><img src="sha256:'), F.col("digest"), F.lit('"><figcaption>'),
        F.col("n_bytes").cast("string"), F.lit(" bytes</figcaption></figure></article>")).alias("html"))
