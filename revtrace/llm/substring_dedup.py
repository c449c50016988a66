"""Removal of passages that repeat across documents: compressed FM-indexes per shard, searched backward for streamed passages.

A window of WINDOW words is filed under its least 5-word shingle. Equal windows have equal shingles, so
only shingles filed by two documents can matter, and a shard holds all occurrences of its shingles' windows. From the documents
that have such shingles the passages around them go to the shingle's shard. The shard indexes its distinct passages and streams
them through the index; where the matching statistics reach WINDOW, the smallest document of the match's range tells whether the
window also starts in an earlier document. A shingle with very many passages goes by its distinct ones, dealt out in blocks, and
each pair of blocks has an index of its own.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix64, slices, written
from .fm_index import FMIndex
from .near_dedup import _SALT

WINDOW = 50
SHINGLE = 5
SHARD_PASSAGES = 4000
PIECE = 60  # window starts of a streamed piece
FAR = np.iinfo(np.int64).max


def filed(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text number, first window start within the text, windows) of each run of windows filed under one shingle."""
    n, none = len(w.hash), np.zeros(0, np.int64)
    if n < window:
        return none.view(np.uint64), none, none, none
    low = np.zeros(n - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        low += w.hash[k:n - SHINGLE + 1 + k] * _SALT[k]
    low = mix64(low)
    span, width = 1, window - SHINGLE + 1
    while span < width:
        step = min(span, width - span)
        low = np.minimum(low[step:], low[:-step])
        span += step
    # window j covers shingles j .. j + width - 1; it has to end in the text where it starts
    start = np.flatnonzero(w.doc[:n - window + 1] == w.doc[window - 1:])
    if not len(start):
        return none.view(np.uint64), none, none, none
    key, doc = low[start], w.doc[start]  # in periodic text the place moves with the window, the key does not
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
    runs = np.flatnonzero(new)
    return key[runs], doc[runs], start[runs] - w.first[doc[runs]], np.diff(np.append(runs, len(start)))


def marks(docs: DataFrame, window: int) -> DataFrame:
    """(key, doc_id, at, windows): the runs of windows of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, w in slices(b.column(1)):
                key, doc, start, count = filed(w, window)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0).take(pa.array(doc + at)), pa.array(start.astype(np.int32)),
                                                  pa.array(count.astype(np.int32))], ["key", "doc_id", "at", "windows"])

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(
        run, "key long, doc_id long, at int, windows int")


def sha(words: list[bytes]) -> tuple[bytes, str]:
    joined = b" ".join(words)
    return joined, hashlib.sha256(joined).hexdigest()


def cut_out(docs: DataFrame, marked: DataFrame, window: int) -> DataFrame:
    """For documents without marks the final row (kind 0); for others their words (kind 2) and the marked passages (kind 1)."""
    schema = "kind int, doc_id long, n_words long, kept_sha256 string, words binary, key long, hot boolean, at int, passage binary"
    columns = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            size = 0
            for doc_id, text, own in zip(b.column(0), b.column(1), b.column(2)):
                words = (text.as_py() or "").encode().split()  # bytes split at 0x09-0x0D and 0x20 only
                found = own.as_py()
                joined, name = sha(words)
                doc_id = doc_id.as_py()
                if not found:
                    rows.append((0, doc_id, len(words), name, None, None, None, None, None))
                    continue
                rows.append((2, doc_id, len(words), name, joined, None, None, None, None))
                for m in found:
                    passage = b" ".join(words[m["at"]:m["at"] + m["windows"] + window - 1])
                    rows.append((1, doc_id, None, None, None, m["key"], m["hot"], m["at"], passage))
                    size += len(passage)
                size += len(joined)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], columns)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], columns)

    by_doc = marked.groupBy("doc_id").agg(F.collect_set(F.struct("key", "hot", "at", "windows")).alias("marks"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(by_doc, "doc_id", "left").select("doc_id", "text", "marks").mapInArrow(run, schema)


def spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def search_shard(owner_of: np.ndarray, passages: list[bytes], window: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The number of each passage's distinct text, and for each distinct text the smallest owner of the windows that start at its
    words. The distinct passages are indexed, and streamed through the index."""
    ids: dict[bytes, int] = {}
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(p, len(number)) for p in passages])
    sequences = [np.array([ids.setdefault(x, len(ids) + 1) for x in p.split(b" ")], np.int64) for p in number]
    owner = np.full(len(number), FAR)
    np.minimum.at(owner, which, owner_of)
    index = FMIndex(sequences, owner, len(ids) + 1, window)
    least = index.least_owner(window)
    cut = np.concatenate([[0], np.cumsum([max(len(s) - window + 1, 0) for s in sequences])])
    flat = np.full(cut[-1], FAR)
    # long passages are streamed in pieces that overlap by a window less one
    pieces = [(k, a) for k, s in enumerate(sequences) for a in range(0, max(len(s) - window + 1, 0), PIECE)]
    begin = np.array([cut[k] + a for k, a in pieces], np.int64)
    for k, position, length, low in index.stream([sequences[k][a:a + PIECE + window - 1] for k, a in pieces], window):
        hit = length >= window
        flat[begin[k[hit]] + position[hit]] = least[low[hit]]
    return which, [flat[x:y] for x, y in zip(cut, cut[1:])]


def _of_members(passages: DataFrame, window: int, shards: int) -> DataFrame:
    """Passages of shingles with few of them: many shingles to a shard."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        which, earliest = search_shard(g.doc_id.values, g.passage.tolist(), window)
        found = [(d, a + x, a + y + window - 1) for d, a, k in zip(g.doc_id.tolist(), g["at"].tolist(), which.tolist()) for x, y in spans(earliest[k] < d)]
        return pd.DataFrame(found, columns=["doc_id", "from", "to"], dtype="int64")

    dealt = passages.select(F.pmod("key", F.lit(shards)).alias("shard"), "doc_id", "at", "passage")
    return dealt.groupBy("shard").applyInPandas(run, "doc_id long, from long, to long")


def _of_distinct(passages: DataFrame, window: int, per_shard: int) -> DataFrame:
    """Passages of shingles with very many: distinct texts first, in blocks, each pair of blocks in an index of its own."""
    named = passages.withColumn("h", F.xxhash64("passage")).withColumn("h2", F.xxhash64(F.lit(1), "passage"))
    texts = written(named.groupBy("key", "h", "h2").agg(F.min("doc_id").alias("owner"), F.first("passage").alias("passage")), "hot-passages")
    dealt = texts.join(texts.groupBy("key").agg(F.ceil(F.count("*") / per_shard).alias("blocks")), "key")
    dealt = dealt.withColumn("block", F.pmod("h", "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "h", "h2", "owner", "passage")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        which, earliest = search_shard(g.owner.values, g.passage.tolist(), window)
        found = []
        for key, h, h2, k in zip(g.key.tolist(), g.h.tolist(), g.h2.tolist(), which.tolist()):
            e = earliest[k]
            cut = [0, *(np.flatnonzero(e[1:] != e[:-1]) + 1).tolist(), len(e)]
            found += [(key, h, h2, x, y, int(e[x])) for x, y in zip(cut, cut[1:])]
        return pd.DataFrame(found, columns=["key", "h", "h2", "x", "y", "earliest"], dtype="int64")

    runs = dealt.groupBy("key", "i", "j").applyInPandas(run, "key long, h long, h2 long, x long, y long, earliest long")
    return named.select("key", "h", "h2", "doc_id", "at").join(runs, ["key", "h", "h2"]).where("earliest < doc_id").select(
        "doc_id", (F.col("at") + F.col("x")).alias("from"), (F.col("at") + F.col("y") + window - 1).alias("to"))


def repeated_intervals(passages: DataFrame, window: int, per_shard: int) -> DataFrame:
    """(doc_id, from, to) of words to remove, from passages (key, hot, doc_id, at, passage)."""
    shards = passages.count() // per_shard + 1
    return _of_members(passages.where("not hot"), window, shards).unionByName(_of_distinct(passages.where("hot"), window, per_shard))


def remove(docs: DataFrame, covered: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of documents given as words joined by one space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(k, 256) for k in range(0, b.num_rows, 256)):
                rows = []
                for doc_id, n, joined, own in zip(*(c.to_pylist() for c in part.columns)):
                    gone = np.zeros(n + 1, np.int64)
                    for s in own or ():
                        gone[s["from"]] += 1
                        gone[s["to"]] -= 1
                    stay = np.cumsum(gone[:-1]) == 0
                    words = joined.split()
                    text, name = sha([words[k] for k in np.flatnonzero(stay)] if own else words)
                    rows.append((doc_id, n, int(n - stay.sum()), name, text.decode("utf-8", "replace")))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                                                 ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    by_doc = covered.groupBy("doc_id").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    return docs.join(by_doc, "doc_id", "left").select("doc_id", "n_words", "words", "spans").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def substring_dedup(docs: DataFrame, window: int = WINDOW, per_shard: int = SHARD_PASSAGES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by one space; null where nothing
    was removed).

    Null and empty texts have no words. A row without id is neither judged nor a source of repeats. Windows within one document, or
    in rows that repeat an id, are no repeats. An empty table gives no rows; further columns are not looked at.
    """
    docs = docs.select("doc_id", "text")
    all_marks = written(marks(docs, window), "marks")
    keys = all_marks.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    keys = keys.select("key", (F.col("n") > per_shard).alias("hot"))
    parts = written(cut_out(docs, all_marks.join(keys, "key"), window), "passages")
    passages = parts.where("kind = 1").select("key", "hot", "doc_id", "at", "passage")
    touched = parts.where("kind = 2").select("doc_id", "n_words", "words")
    done = parts.where("kind = 0").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept"))
    return done.unionByName(remove(touched, written(repeated_intervals(passages, window, per_shard), "intervals")))
