"""Byte-pair encoding and decoding with a given vocabulary file, without the library that wrote it.

A word (a piece of the pre-tokenizer's pattern) is a contiguous array of part boundaries with the rank of each adjacent pair; the
lowest rank is looked up again and again, its boundary deleted and the two neighbouring ranks refreshed. That is quadratic in the
word, and fast for short ones; a word over LONG_BYTES goes through a heap over linked parts, with the same merges in the same
order. Tasks keep the words they have seen, so repeated words cost one look-up.
"""
from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

LONG_BYTES = 256
CACHE_WORDS = 200_000  # of a task, about 60 MB; the cache starts anew when it is full
CACHED_CHARS = 64
NONE = 1 << 60
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level files write each byte: printable bytes stand for themselves, the rest for U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in printable):
        letters[chr(0x100 + n)] = b
    return letters


class BytePairEncoder:
    """Encodes and decodes like the tokenizers library with the same byte-level BPE file (no normalizer, no prefix space)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        raw = {token: bytes(letters[c] for c in token) for token in file["model"]["vocab"]}
        self.ids = {raw[t]: i for t, i in file["model"]["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        as_bytes = lambda t: raw.get(t) or bytes(letters[c] for c in t)
        # joined bytes -> (rank, bytes of the left part): a merge holds only for its own two parts
        self.ranks = {as_bytes(a) + as_bytes(b): (n, len(as_bytes(a))) for n, (a, b) in enumerate(merges)}
        self.tokens = {i: t for t, i in self.ids.items()}
        added = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        self.tokens |= {i: c.encode() for c, i in added.items()}
        self.special = added
        self.cut = regex.compile("(" + "|".join(regex.escape(c) for c in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.words = regex.compile(PATTERN)
        self.cache: dict[str, tuple[str, int, bytes]] = {}

    # -- one word
    def merge(self, word: bytes) -> list[bytes]:
        return self._by_array(word) if len(word) <= LONG_BYTES else self._by_heap(word)

    def _by_array(self, word: bytes) -> list[bytes]:
        n = len(word)
        bounds = list(range(n + 1))
        get = self.ranks.get
        ranks = [r[0] if (r := get(word[i:i + 2])) else NONE for i in range(n - 1)]
        while ranks and (low := min(ranks)) != NONE:
            i = ranks.index(low)
            del bounds[i + 1], ranks[i]  # parts i and i + 1 are one now
            start, end = bounds[i], bounds[i + 1]
            if i < len(ranks):
                r = get(word[start:bounds[i + 2]])
                ranks[i] = r[0] if r and r[1] == end - start else NONE
            if i:
                left = bounds[i - 1]
                r = get(word[left:end])
                ranks[i - 1] = r[0] if r and r[1] == start - left else NONE
        return [word[a:b] for a, b in zip(bounds, bounds[1:])]

    def _by_heap(self, word: bytes) -> list[bytes]:
        n = len(word)
        end = list(range(1, n + 1))  # of the part that starts here; 0: no part starts here
        before = list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (r := self.ranks.get(word[i:end[j]])) and r[1] == j - i:
                heapq.heappush(heap, (r[0], i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if end[i] != j or end[j] != k:  # one of the two has changed since
                continue
            end[i], end[j] = k, 0
            if k < n:
                before[k] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [word[i:e] for i, e in enumerate(end) if e]

    def _word(self, word: str) -> tuple[str, int, bytes]:
        """Ids joined by commas, their number, and the bytes they decode to."""
        ids = [self.ids[p] for p in self.merge(word.encode("utf-8"))]
        found = ",".join(map(str, ids)), len(ids), b"".join([self.tokens[i] for i in ids])
        if len(word) <= CACHED_CHARS:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = found
        return found

    # -- a text
    def _pieces(self, text: str) -> Iterator[tuple[str, int, bytes]]:
        """In order, for each word; special tokens that stand in the text are one id."""
        get, word = self.cache.get, self._word
        special = self.cut is not None and any(c in text for c in self.special)
        for part in self.cut.split(text) if special else (text,):
            if special and part in self.special:
                i = self.special[part]
                yield str(i), 1, self.tokens[i]
            elif part:
                for w in self.words.findall(part):
                    yield get(w) or word(w)

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _, _ in self._pieces(text) for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        """Bytes that are no UTF-8 become U+FFFD."""
        return b"".join([self.tokens[i] for i in ids]).decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text."""
        if any(c in text for c in self.special):
            pieces = list(self._pieces(text))
        else:
            get, word = self.cache.get, self._word
            pieces = [get(w) or word(w) for w in self.words.findall(text)]
        ids = ",".join([p[0] for p in pieces])
        back = b"".join([p[2] for p in pieces]).decode("utf-8", "replace")
        return sum([p[1] for p in pieces]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


_ENCODERS: dict[str, BytePairEncoder] = {}


def encoder(path: str) -> BytePairEncoder:
    """One for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BytePairEncoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>). Null text: no ids. No shuffle; one row at a time is held besides the batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [enc.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from (doc_id, ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [enc.decode(i or []) for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encoding_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_tokens, ids_sha256, decoded_sha256, without the ids themselves leaving the task.

    Null counts as empty (0 tokens, digests of nothing). Repeated rows give repeated rows; further columns are not looked at.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            rows = [enc.digest(t.as_py() or "") for t in b.column(1)]
            n, ids, back = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)
