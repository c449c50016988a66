"""An inverted index in shards: terms of texts as numpy arrays, block-compressed posting lists, and Block-Max MaxScore over one shard.

A shard holds the documents of about SHARD_BYTES of text that one task has read, so building it moves no text. A list holds its
documents in blocks of BLOCK postings: gaps and counts as variable-length bytes, and beside each block its last document, its
largest count and its shortest document, from which a bound of every score in the block follows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import _FOLD

SHARD_BYTES = 16 << 20
PIECE_BYTES = 2 << 20  # text that is cut into terms at once; a longer text goes on in the next piece
BLOCK = 128
SCALE = 1_000_000_000

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def lengths(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """m of a document with n terms, where `docs` documents hold `terms` terms."""
    return 25 + (75 * n.astype(np.int64) * docs) // max(terms, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds to a score; grows with tf, falls with m."""
    tf = tf.astype(np.int64)
    return (SCALE * tf) // (1000 * tf + 8 * m)


# ---- bytes ----------------------------------------------------------------------------------------------------------
def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each value ends): seven bits a byte, low ones first, the high bit on all but the last."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 5):
        size += values >= 1 << (7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    at, rest = ends - size, values.astype(np.int64)
    live = np.arange(len(values))
    while len(live):
        low = rest[live] & 127
        more = rest[live] > 127
        out[at[live]] = low | (more << 7)
        at[live] += 1
        rest[live] >>= 7
        live = live[more]
    return out, ends


def unpack(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    values = (data[starts] & 127).astype(np.int64)
    for k in range(1, 5):
        longer = np.flatnonzero(ends - starts >= k)
        if not len(longer):
            break
        values[longer] |= (data[starts[longer] + k] & 127).astype(np.int64) << (7 * k)
    return values


# ---- building -------------------------------------------------------------------------------------------------------
class ShardBuilder:
    """Takes arrays of texts; rows() gives the shard's record batches once it is full or the input has ended."""

    def __init__(self):
        self.ids, self.lens, self.parts, self.bytes, self.docs = [], [], [], 0, 0

    def add(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        """Texts data[offsets[i]:offsets[i + 1]]."""
        lens = np.zeros(len(ids), np.int64)
        inside = _TERM[data]
        at, end = int(offsets[0]), int(offsets[-1])
        while at < end:
            to = min(at + PIECE_BYTES, end)
            if to < end:  # on to the end of the term or of the text
                gap = np.flatnonzero(~inside[to:to + PIECE_BYTES])
                to = min(to + int(gap[0]) if len(gap) else end, int(offsets[np.searchsorted(offsets, to)]))
            self._piece(data[at:to], inside[at:to], offsets - at, lens)
            at = to
        self.ids.append(ids)
        self.lens.append(lens)
        self.docs += len(ids)
        self.bytes += end - int(offsets[0])

    def _piece(self, data: np.ndarray, inside: np.ndarray, offsets: np.ndarray, lens: np.ndarray) -> None:
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        begins[cuts] |= inside[cuts]
        ends[cuts - 1] |= inside[cuts - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if not len(start):
            return
        where = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
        terms = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(where), pa.py_buffer(_FOLD[data[inside]])]).dictionary_encode()
        doc = np.searchsorted(offsets, start, "right") - 1
        lens += np.bincount(doc, minlength=len(lens))
        key, count = np.unique(terms.indices.to_numpy().astype(np.int64) * len(lens) + doc, return_counts=True)
        self.parts.append((terms.dictionary, key // len(lens), self.docs + key % len(lens), count))

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The shard's documents (a row without term) and its posting lists by term."""
        lens = np.concatenate(self.lens)
        yield _batch([shard], [None], [None], [None] * 5, pa.concat_arrays(self.ids), lens)
        if not self.parts:
            return
        names = pa.concat_arrays([p[0] for p in self.parts]).dictionary_encode()
        order = pc.array_sort_indices(names.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        code, at = rank[names.indices.to_numpy()], 0
        term = []
        for p in self.parts:
            term.append(code[at:at + len(p[0])][p[1]])
            at += len(p[0])
        key = np.concatenate(term) * self.docs + np.concatenate([p[2] for p in self.parts])
        tf = np.concatenate([p[3] for p in self.parts])
        by = np.argsort(key, kind="stable")
        key, first = np.unique(key[by], return_index=True)
        tf = np.add.reduceat(tf[by], first)
        term, doc = key // self.docs, key % self.docs

        lists = np.flatnonzero(np.diff(term, prepend=-1))
        df = np.diff(lists, append=len(term))
        place = np.arange(len(term)) - np.repeat(lists, df)
        blocks = np.flatnonzero(place % BLOCK == 0)
        size = np.diff(blocks, append=len(term))
        gap = np.diff(doc, prepend=0)
        gap[blocks] = doc[blocks]
        values = np.empty(2 * len(term), np.int64)
        inner = np.arange(len(term)) - np.repeat(blocks, size)
        base = np.repeat(2 * blocks, size) + inner
        values[base], values[base + np.repeat(size, size)] = gap, tf
        data, ends = pack(values)
        block_end = ends[2 * (blocks + size) - 1]
        list_of = np.searchsorted(lists, blocks, "right") - 1
        list_start = np.concatenate([[0], block_end[np.searchsorted(blocks, lists[1:]) - 1]])
        of = np.searchsorted(blocks, np.append(lists, len(term))).astype(np.int32)
        nested = lambda v: pa.ListArray.from_arrays(pa.array(of), pa.array(v.astype(np.int32)))
        meta = [nested(doc[blocks + size - 1]), nested(np.maximum.reduceat(tf, blocks)), nested(np.minimum.reduceat(lens[doc], blocks)),
                nested(block_end - list_start[list_of])]
        blob = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(np.append(list_start, len(data)).astype(np.int32)), pa.py_buffer(data)])
        named = names.dictionary.take(pa.array(order)).cast(pa.string())
        for k in range(0, len(lists), 4096):
            part = slice(k, min(k + 4096, len(lists)))
            cut = lambda a: a.slice(part.start, part.stop - part.start)  # noqa: B023, E731
            yield _batch(np.full(part.stop - part.start, shard), cut(named), df[part], [*map(cut, meta), cut(blob)], None, None)


COLUMNS = {"shard": pa.int64(), "term": pa.string(), "df": pa.int64(), "last": pa.list_(pa.int32()), "top_tf": pa.list_(pa.int32()),
           "least_n": pa.list_(pa.int32()), "ends": pa.list_(pa.int32()), "blob": pa.binary(), "ids": pa.list_(pa.int64()),
           "lens": pa.list_(pa.int32()), "docs": pa.int64(), "terms": pa.int64()}
SCHEMA = ("shard long, term string, df long, last array<int>, top_tf array<int>, least_n array<int>, ends array<int>, blob binary, "
          "ids array<long>, lens array<int>, docs long, terms long")


def _batch(shard, term, df, meta, ids, lens) -> pa.RecordBatch:
    n = len(shard)
    if ids is None:
        extra = [pa.nulls(n, t) for t in (COLUMNS["ids"], COLUMNS["lens"], pa.int64(), pa.int64())]
    else:
        extra = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(pa.int64())),
                 pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(lens.astype(np.int32))),
                 pa.array([int((lens > 0).sum())], pa.int64()), pa.array([int(lens.sum())], pa.int64())]
        meta = [pa.nulls(1, t) for t in list(COLUMNS.values())[3:8]]
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), term if isinstance(term, pa.Array) else pa.array(term, pa.string()),
                                       pa.array(df, pa.int64()), *meta, *extra], list(COLUMNS))


# ---- searching ------------------------------------------------------------------------------------------------------
class PostingList:
    """A list of one shard. Blocks are decompressed when first needed; until then a block's places hold its last document, so that
    the array stays sorted."""

    def __init__(self, df: int, last: np.ndarray, top_tf: np.ndarray, least_n: np.ndarray, ends: np.ndarray, blob: bytes, m: np.ndarray,
                 docs: int, terms: int):
        self.df, self.last, self.m = df, last, m
        self.data, self.ends = np.frombuffer(blob, np.uint8), np.concatenate([[0], ends])
        self.bounds = impact(top_tf, lengths(least_n, docs, terms))
        self.bound = int(self.bounds.max())
        self.doc = self.adds = None
        self.open = np.zeros(len(last), bool)

    def need(self, blocks: np.ndarray) -> None:
        """Decompresses those of the blocks (ascending) that are not yet."""
        blocks = blocks[~self.open[blocks]]
        if not len(blocks):
            return
        if self.doc is None:
            sizes = np.full(len(self.last), BLOCK)
            sizes[-1] = self.df - BLOCK * (len(self.last) - 1)
            self.doc, self.adds = np.repeat(self.last, sizes).astype(np.int64), np.zeros(self.df, np.int64)
        self.open[blocks] = True
        breaks = np.flatnonzero(np.diff(blocks) > 1) + 1
        for run in np.split(blocks, breaks):
            a, b = int(run[0]), int(run[-1]) + 1
            values = unpack(self.data[self.ends[a]:self.ends[b]])
            at, to = a * BLOCK, min(b * BLOCK, self.df)
            full = (to - at) // BLOCK
            grid = values[:2 * BLOCK * full].reshape(full, 2, BLOCK)
            tail = values[2 * BLOCK * full:].reshape(2, -1)
            self.doc[at:to] = np.concatenate([grid[:, 0].cumsum(1).ravel(), tail[0].cumsum()])
            tf = np.concatenate([grid[:, 1].ravel(), tail[1]])
            self.adds[at:to] = impact(tf, self.m[self.doc[at:to]])

    def between(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, what the term adds) for documents from lo to below hi."""
        a, b = np.searchsorted(self.last, [lo, hi - 1])
        b = min(int(b) + 1, len(self.last))
        if a >= b:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.need(np.arange(a, b))
        x, y = a * BLOCK + np.searchsorted(self.doc[a * BLOCK:b * BLOCK], [lo, hi])
        return self.doc[x:y], self.adds[x:y]

    def of(self, docs: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """What the term adds for each of docs, which lie in the given blocks if anywhere."""
        self.need(np.unique(blocks))
        at = np.searchsorted(self.doc, docs)
        return np.where(self.doc[at] == docs, self.adds[at], 0)


class Best:
    """The k best (score, id) seen so far: higher scores first, then smaller ids, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.score = self.id = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    @property
    def least(self) -> int:
        """A score below this one cannot enter."""
        return max(int(self.score[-1]), 1) if len(self.score) == self.k else 1

    def offer(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = (np.concatenate(x) for x in ((self.score, score), (self.id, ids), (self.null, null)))
        by = np.lexsort((ids, null, -score))[:self.k]
        self.score, self.id, self.null = score[by], ids[by], null[by]


def search_shard(query: list[tuple[PostingList, int]], ids: np.ndarray, null: np.ndarray, best: Best, window: int = 512) -> None:
    """Offers the shard's documents that can be among the best. query: lists with their weights.

    Lists stand by their bounds. Those whose bounds together stay below the least score that can enter are not essential: a document
    in none of the others is never looked at. A candidate meets the others from the largest down; it goes once what it has and the
    bounds of the rest fall short, and before a block is decompressed the block's own bound is tried.
    """
    query = sorted(((x, w) for x, w in query if w > 0), key=lambda q: q[0].bound * q[1])
    bounds = np.array([x.bound * w for x, w in query], np.int64)
    total = np.cumsum(bounds)
    lo = 0
    while lo < len(ids):
        hi = min(lo + window, len(ids))
        window *= 2
        least = best.least
        essential = int(np.searchsorted(total, least))
        if essential == len(query):
            return
        score = np.zeros(hi - lo, np.int64)
        for x, w in query[essential:]:
            docs, adds = x.between(lo, hi)
            score[docs - lo] += w * adds
        found = np.flatnonzero(score)
        score = score[found]
        found += lo
        for j in range(essential - 1, -1, -1):
            keep = score + total[j] >= least
            found, score = found[keep], score[keep]
            if not len(found):
                break
            x, w = query[j]
            block = np.searchsorted(x.last, found)
            there = block < len(x.last)
            block = np.minimum(block, len(x.last) - 1)
            keep = score + np.where(there, x.bounds[block] * w, 0) + (total[j - 1] if j else 0) >= least
            found, score, block, there = found[keep], score[keep], block[keep], there[keep]
            score = score.copy()
            score[there] += w * x.of(found[there], block[there]) if there.any() else 0
        keep = score >= least
        if keep.any():
            best.offer(score[keep], ids[found[keep]], null[found[keep]])
        lo = hi
