"""Exact top-k ranking: BM25 over an inverted index, cosine over vectors. Both keep a running best k of each query in a task, rule out
what cannot enter it by bounds, and hand over k rows a query and task."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, broadcast_if_small, steady_unions, written

BM25_K1, BM25_B = 1.2, 0.75
SHARD_DOCS, SHARD_POSTINGS, QUERY_BLOCK = 1 << 12, 1 << 23, 1 << 15  # documents of a cell, postings and queries that meet in one group
WIDE = 1 << 26  # bytes for lists that are held as a number for each document
LEAST_BLOCK = 1 << 9  # a block of queries is not made smaller to have more tasks
TILE = 1 << 20  # scores that a task holds at once
PIVOTS = 16


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _top(scored: DataFrame, k: int) -> DataFrame:
    """Best k per query; Spark cuts every partition to k rows per query before the shuffle."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class Best:
    """The k best documents of a query so far: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def least(self) -> float:
        """A lower score cannot enter."""
        return self.rows[-1][0] if len(self.rows) == self.k else -np.inf

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            keep = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[keep], ids[keep]
        self.rows = sorted([*self.rows, *zip(scores.tolist(), ids.tolist())], key=lambda r: (-r[0], r[1]))[:self.k]


# ---- keywords -----------------------------------------------------------------------------------------------------------
def bm25(queries: DataFrame, docs: DataFrame, k: int = 100, places: int = 6, shard_docs: int = SHARD_DOCS, query_block: int = QUERY_BLOCK,
         shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """queries(query_id, text), docs(doc_id, text) -> (query_id, doc_id, score, rank) by BM25, k1 = 1.2, b = 0.75, equal scores by doc_id.

    Documents that hold terms of the queries are packed in cells of `shard_docs` at most, one row each. A shard is as many cells as hold
    about `shard_postings` postings; it meets a block of queries in one group, where its cells become one index (`Postings`) that every query
    of the block asks. So an index is sent once per block of queries, and a query meets few indexes however many documents there are.
    Nothing that grows with queries or documents comes to the driver. A query without terms, or without a document that holds one, has
    no rows."""
    spark = docs.sparkSession
    steady_unions(spark)
    d = docs.select("doc_id", tokens(F.col("text")).alias("t"))
    n_docs, n_tokens = d.agg(F.count("*"), F.sum(F.size("t"))).first()
    avg_len = (n_tokens or 0) / max(1, n_docs)
    q = written(queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")), "query-terms")
    vocabulary = broadcast_if_small(written(q.select("term").distinct().withColumn("term_no", F.monotonically_increasing_id()), "terms"), 64)
    n_cells = max(1, -(-n_docs // shard_docs), -(-(n_tokens or 0) // (shard_postings // 4)))
    held = d.filter("doc_id IS NOT NULL").select("doc_id", F.size("t").alias("length"), F.explode("t").alias("term")).join(vocabulary, "term").select(
        F.pmod(F.xxhash64("doc_id"), F.lit(n_cells)).alias("cell"), "term_no", "doc_id", "length")
    doc_type, query_type = dict(docs.dtypes)["doc_id"], dict(queries.dtypes)["query_id"]
    cells = written(held.repartition(n_cells, "cell").sortWithinPartitions("cell").mapInArrow(_packed, (
        f"cell long, n int, docs array<{doc_type}>, lengths array<int>, terms array<long>, sizes array<int>, at array<int>, tf array<int>")), "postings")
    df = cells.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy(F.col("x.terms").alias("term_no")).agg(F.sum("x.sizes").alias("df"))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = written(q.join(vocabulary, "term").join(df, "term_no").groupBy("query_id").agg(
        F.collect_list("term_no").alias("terms"), F.collect_list(F.col("qtf") * idf).alias("weights")), "asked")
    shards = max(1, -(-(cells.agg(F.sum("n")).first()[0] or 0) // shard_postings))
    n, cores = asked.count(), spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n // query_block), min(-(-n // LEAST_BLOCK), -(-4 * cores // shards)))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    rows = cells.withColumn("block", each(blocks)).withColumn("shard", (F.col("cell") % shards).cast("int")).withColumn("asks", F.lit(False)).drop("cell", "n").unionByName(
        asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", each(shards)).withColumn("asks", F.lit(True)), allowMissingColumns=True)
    groups = rows.repartitionById(blocks * shards, F.col("block") * shards + F.col("shard")).sortWithinPartitions("block", "shard", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        index = key = None
        for b in batches:
            for part in _runs(b, "block", "shard", "asks"):
                here = part.column("block")[0].as_py(), part.column("shard")[0].as_py()
                if here != key:
                    held, index, key = [], None, here
                if not part.column("asks")[0].as_py():
                    held.append(part)
                elif held:
                    index = index or Postings(held, avg_len)
                    for i in range(0, part.num_rows, LEAST_BLOCK):
                        yield index.best(part.slice(i, LEAST_BLOCK), k, places)

    found = groups.mapInArrow(run, f"query_id {query_type}, doc_id {doc_type}, score double")
    return _top(found, k).select("query_id", "doc_id", "score", "rank")


def _runs(b: pa.RecordBatch, *names: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch in which the named columns do not change."""
    at = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in names])
    cuts = (np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist()
    for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
        if hi > lo:
            yield b.slice(lo, hi - lo)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences (cell, term_no, doc_id, length), in order of cells, to a row for a cell: its documents and their lengths; its terms in
    ascending order with their numbers of documents; for each of these the place among the cell's documents and the term's count there."""
    held: list[pa.RecordBatch] = []

    def row() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        docs = t["doc_id"].combine_chunks().dictionary_encode()
        n, doc = len(docs.dictionary), docs.indices.to_numpy().astype(np.int64)
        lengths = np.zeros(n, np.int32)
        lengths[doc[::-1]] = t["length"].to_numpy()[::-1]  # the first one of a document
        terms, term = np.unique(t["term_no"].to_numpy(), return_inverse=True)
        pairs, tf = np.unique(term * n + doc, return_counts=True)
        lists = {"docs": docs.dictionary, "lengths": lengths, "terms": terms, "sizes": np.bincount(pairs // n).astype(np.int32), "at": (pairs % n).astype(np.int32), "tf": tf.astype(np.int32)}
        columns = [pa.array([held[0].column("cell")[0].as_py()], pa.int64()), pa.array([len(pairs)], pa.int32())]
        columns += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in lists.values()]
        return pa.RecordBatch.from_arrays(columns, ["cell", "n", *lists])

    for b in batches:
        for part in _runs(b, "cell"):
            if held and held[0].column("cell")[0] != part.column("cell")[0]:
                yield row()
                held = []
            held.append(part)
    if held:
        yield row()


class Postings:
    """An index over the documents of packed cells: by term the documents in ascending order of their ids and what the term adds there for
    weight 1.

    A query's lists are read by their bounds, the highest first, into an array with a sum for each document. After each list the k documents
    that lead are scored in full; documents that stand only in lists whose bounds together cannot reach the k-th of these scores are
    never looked at, and of the others only those are looked up in the remaining lists that still have a chance."""

    def __init__(self, cells: list[pa.RecordBatch], avg_len: float):
        flat = lambda name: pa.concat_arrays([c.column(name).flatten() for c in cells])
        number = lambda name: flat(name).to_numpy(zero_copy_only=False)
        sizes_of = lambda name: np.concatenate([np.diff(c.column(name).offsets.to_numpy()) for c in cells])
        ids = flat("docs")
        order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
        self.ids, self.n, lengths = ids.take(pa.array(order)), len(ids), number("lengths")[order]
        place = np.empty(self.n, np.int64)
        place[order] = np.arange(self.n)
        of_cell = sizes_of("docs")
        doc = place[number("at") + np.repeat(np.cumsum(of_cell) - of_cell, sizes_of("at"))]
        self.terms, term = np.unique(number("terms"), return_inverse=True)
        doc += np.repeat(term * self.n, number("sizes"))
        order = np.argsort(doc)
        self.pairs = np.append(doc.take(order), -1)  # by term and document; the last one is met by nothing
        tf = number("tf").take(order)
        del doc, order
        self.of = self.pairs[:-1] % self.n
        norm = (BM25_K1 * (1 - BM25_B + BM25_B * lengths / avg_len)).take(self.of)
        norm += tf
        self.adds = np.append(tf * (BM25_K1 + 1) / norm, 0.0)
        self.first = np.searchsorted(self.pairs[:-1], np.arange(len(self.terms) + 1) * self.n)
        self.most = np.maximum.reduceat(self.adds[:-1], self.first[:-1])
        self.sums = np.zeros(self.n)
        self.wide = {t: np.zeros(self.n) for t in np.argsort(-np.diff(self.first))[:WIDE // (8 * self.n)].tolist()}  # the longest lists
        for t, adds in self.wide.items():
            adds[self.of[self.first[t]:self.first[t + 1]]] = self.adds[self.first[t]:self.first[t + 1]]

    def best(self, asked: pa.RecordBatch, k: int, places: int) -> pa.RecordBatch:
        """asked(query_id, terms, weights) -> (query_id, doc_id, score), the k best documents of each query."""
        terms, weights = (asked.column(c).flatten().to_numpy() for c in ("terms", "weights"))
        query = np.repeat(np.arange(asked.num_rows), np.diff(asked.column("terms").offsets.to_numpy()))
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[at] == terms
        query, at, weights = query[known], at[known], weights[known]
        bounds = weights * self.most[at]
        order = np.lexsort((bounds, query))
        query, at, weights, bounds = query[order], at[order], weights[order], bounds[order]
        ends = np.searchsorted(query, np.arange(asked.num_rows + 1)).tolist()
        found = [self._best(at[lo:hi], weights[lo:hi], np.cumsum(bounds[lo:hi]).tolist(), k, places) for lo, hi in zip(ends, ends[1:])]
        query = np.repeat(np.arange(asked.num_rows), [len(d) for d, _ in found])
        docs, scores = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([asked.column("query_id").take(pa.array(query)), self.ids.take(pa.array(docs)), pa.array(scores)], ["query_id", "doc_id", "score"])

    def _best(self, terms: np.ndarray, weights: np.ndarray, reach: list[float], k: int, places: int) -> tuple[np.ndarray, np.ndarray]:
        """Terms by ascending bounds; reach: the sums of these."""
        sums, least, lead, seen, j = self.sums, 0.0, None, [], len(terms)
        slack = 2 * 10.0 ** -places  # scores are compared after rounding
        while j and reach[j - 1] >= least - slack:
            j -= 1
            lo, hi = self.first[terms[j]], self.first[terms[j] + 1]
            docs, here = self.of[lo:hi], weights[j] * self.adds[lo:hi]
            if seen:
                here += sums.take(docs)
            sums[docs] = here
            seen.append(docs)
            if j:
                first = docs if len(docs) <= k else docs[np.argpartition(here, len(docs) - k)[len(docs) - k:]]
                lead = first if lead is None else np.union1d(lead, first)
                if len(lead) >= k:
                    full = self._scores(lead, terms, weights)
                    top = np.argpartition(full, len(lead) - k)[len(lead) - k:]
                    lead, least = lead[top], max(least, full[top].min())
        left, scores = [], []
        enough = least - slack - (reach[j - 1] if j else 0.0)
        for docs in seen:
            here = sums.take(docs)
            keep = np.flatnonzero((here > 0) & (here >= enough))
            left.append(docs[keep])
            scores.append(here[keep])
            sums[docs] = 0.0  # so a document is taken once
        docs, score = np.concatenate(left or [self.of[:0]]), np.concatenate(scores or [sums[:0]])
        for i in range(j - 1, -1, -1):
            score += weights[i] * self._adds(terms[i], docs)
            keep = np.flatnonzero(score >= least - slack - (reach[i - 1] if i else 0.0))
            docs, score = docs[keep], score[keep]
        score = np.round(score, places)
        keep = score > 0 if len(score) <= k else score >= max(np.partition(score, len(score) - k)[len(score) - k], 10.0 ** -places / 2)
        docs, score = docs[keep], score[keep]
        order = np.lexsort((docs, -score))[:k]
        return docs[order], score[order]

    def _adds(self, term: int, docs: np.ndarray) -> np.ndarray:
        if term in self.wide:
            return self.wide[term].take(docs)
        lo, hi = self.first[term], self.first[term + 1]
        at = np.searchsorted(self.of[lo:hi], docs) + lo
        at[at == hi] = lo
        return np.where(self.of[at] == docs, self.adds[at], 0.0)

    def _scores(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        wanted = terms[:, None] * self.n + docs
        at = np.searchsorted(self.pairs[:-1], wanted)
        return (weights[:, None] * np.where(self.pairs[at] == wanted, self.adds[at], 0.0)).sum(0)


# ---- vectors ------------------------------------------------------------------------------------------------------------
def _unit_rows(vectors: pd.Series) -> np.ndarray:
    m = np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def vector_rank(queries: DataFrame, docs: DataFrame, k: int = 100, places: int = 6, block_bytes: int = BROADCAST_BYTES, tile: int = TILE) -> DataFrame:
    """queries(query_id, embedding), docs(doc_id, embedding) -> exact cosine ranking, equal scores by doc_id.

    Queries come in blocks of a checked size, one pass over the documents each. In a task documents are dealt to the pivot they are
    nearest to; angles obey the triangle inequality, so no document of a pivot is nearer to a query than the angle between query and
    pivot less the pivot's radius, and pivots that cannot reach a query's best k are not compared with it. At most `tile` scores are held at
    once. A vector of zeros has score 0 with every other."""
    dim = queries.agg(F.max(F.size("embedding"))).first()[0] or 1
    n = max(1, -(-queries.count() * 8 * dim // block_bytes))
    names = ["query_id", "doc_id", "score"]
    out = None
    for i in range(n):
        block = queries if n == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)
        rows = block.select("query_id", "embedding").toPandas()
        shared = queries.sparkSession.sparkContext.broadcast((rows["query_id"].to_numpy(), _unit_rows(rows["embedding"])))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qids, q = shared.value
            best = [Best(k) for _ in qids]
            pivots = to_pivots = None
            for pdf in batches:
                step = max(1, tile // max(1, len(qids)))
                for part in (pdf[a:a + step] for a in range(0, len(pdf) if len(qids) else 0, step)):
                    d, ids = _unit_rows(part["embedding"]), part["doc_id"].to_numpy()
                    zero = ~d.any(axis=1)
                    if pivots is None:
                        live = d[~zero]
                        if not len(live):
                            live = np.eye(1, d.shape[1])
                        pivots = live[np.linspace(0, len(live) - 1, min(PIVOTS, len(live))).astype(int)]
                        to_pivots = _angles(q, pivots)
                    away = _angles(d, pivots)
                    nearest = away.argmin(1)
                    for p in range(len(pivots)):
                        cell = np.flatnonzero((nearest == p) & ~zero)
                        if len(cell):
                            radius = away[cell, p].max()
                            reach = np.cos(np.maximum(to_pivots[:, p] - radius - 1e-9, 0))  # the best that the cell can hold
                            _offer(best, q, d, ids, cell, np.flatnonzero((reach + 10.0 ** -places >= [b.least for b in best]) | ~q.any(axis=1)))
                    if zero.any():
                        _offer(best, q, d, ids, np.flatnonzero(zero), np.arange(len(qids)))
            rows = [(query_id, doc, s) for query_id, b in zip(qids.tolist(), best) for s, doc in b.rows]
            yield pd.DataFrame(rows, columns=names)

        def _offer(best: list, q: np.ndarray, d: np.ndarray, ids: np.ndarray, cell: np.ndarray, wanted: np.ndarray) -> None:
            scores = np.round(d[cell] @ q[wanted].T, places)
            for c, w in enumerate(wanted):
                b = best[w]
                keep = scores[:, c] >= b.least
                if keep.any():
                    b.offer(scores[keep, c], ids[cell[keep]])

        got = docs.select("doc_id", "embedding").mapInPandas(run, f"query_id {dict(queries.dtypes)['query_id']}, doc_id {dict(docs.dtypes)['doc_id']}, score double")
        out = got if out is None else out.unionByName(got)
    return _top(out, k)
