"""Byte-level BPE by a local rank file with the tiktoken library, and decoding to raw bytes.

A long text is cut before it meets the library, so that neither its pattern engine (whose stack a run of about a million spaces
overflows) nor its ids grow with the text. Cuts stand only where the pattern always ends a match and never looks back: between a
character that is no white space and white space, between a letter or digit and ASCII punctuation, and between letters and digits.
A run of white space too long for the engine is one match of a known extent and is encoded as such, without the pattern. A stretch
without a safe place (one endless word) stays whole: the library merges it by a heap. So ids equal those of the whole text.
"""
from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PIECE_CHARS = 1 << 16  # a text is cut at the first safe place after so many characters
RUN_CHARS = 1 << 15  # runs of white space from this length are encoded without the pattern
WHITE = "\t-\r \x85\xa0  -     　"  # the Unicode property White_Space
LONG_RUN = re.compile(f"[{WHITE}]{{{RUN_CHARS},}}")
SAFE = re.compile(r"(?<=[^\s])(?=[ \t\n\r])|(?<=[A-Za-z0-9一-鿿])(?=[!-/:-@\[-`{-~、。，])"
                  r"|(?<=[A-Za-z一-鿿])(?=[0-9])|(?<=[0-9])(?=[A-Za-z一-鿿])")


def safe_pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[tuple[str, bool]]:
    """(piece, is one match) whose encodings in a row are the encoding of the text."""
    at = 0
    for run in LONG_RUN.finditer(text) if len(text) >= RUN_CHARS else ():
        yield from ((p, False) for p in _cut(text, at, run.start(), limit))
        at = run.end() - (run.end() < len(text))  # the last one belongs to the match after the run
        yield text[run.start():at], True
    yield from ((p, False) for p in _cut(text, at, len(text), limit))


def _cut(text: str, at: int, to: int, limit: int) -> Iterator[str]:
    while to - at > limit and (found := SAFE.search(text, at + limit, to)) and found.start() < to:
        yield text[at:found.start()]
        at = found.start()
    if at < to:
        yield text[at:to]


class RankEncoder:
    """encode, decode and digest with the ranks of a file: lines of base64 bytes, a space, the rank."""

    def __init__(self, path: str, pattern: str):
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
        self.by_pattern = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.one_match = tiktoken.Encoding("ranks-whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def pieces(self, text: str) -> Iterator[list[int]]:
        if len(text) <= RUN_CHARS:
            yield self.by_pattern.encode_ordinary(text)
            return
        for piece, whole in safe_pieces(text):
            yield (self.one_match if whole else self.by_pattern).encode_ordinary(piece)

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.pieces(text) for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        """Raw bytes: a part of a text need not be UTF-8."""
        return self.by_pattern.decode_bytes(ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded bytes; a piece at a time."""
        n, ids_hash, bytes_hash = 0, hashlib.sha256(), hashlib.sha256()
        for ids in self.pieces(text):
            if ids:
                ids_hash.update(("," if n else "").encode() + ",".join(map(str, ids)).encode())
                bytes_hash.update(self.decode(ids))
                n += len(ids)
        return n, ids_hash.hexdigest(), bytes_hash.hexdigest()


_ENCODERS: dict[tuple[str, str], RankEncoder] = {}


def encoder(path: str, pattern: str) -> RankEncoder:
    """One for each file, pattern and Python worker."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = RankEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>): one row per row. Null or empty text: no ids. Repeated rows give repeated rows, an empty table none;
    further columns are not looked at. No shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            for row in range(b.num_rows):  # a row at a time, so that one long text does not share memory with others
                ids = np.fromiter(enc.encode(b.column(1)[row].as_py() or ""), np.int32)
                arr = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, 1), arr], ["doc_id", "ids"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, data (binary) from (doc_id, ids): the raw bytes. Null ids: no bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            for row in range(b.num_rows):
                data = pa.array([enc.decode(b.column(1)[row].as_py() or [])], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, 1), data], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def encoding_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_tokens, ids_sha256, decoded_sha256; the ids themselves stay in the task, a piece of a text at a time.

    Null counts as empty (0 tokens, digests of nothing). Repeated rows give repeated rows, a null id stays null, an empty table gives
    no rows; further columns are not looked at.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            rows = [enc.digest(t.as_py() or "") for t in b.column(1)]
            n, ids, back = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)
