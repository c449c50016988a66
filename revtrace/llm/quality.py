"""Quality by ordinal regression (cumulative links) on graded ratings: one weight for each hashed text feature, ordered thresholds.

P(grade > k) = sigmoid(f(text) - threshold[k]), f being the sum of the weights of the text's features: its distinct words, the
written shapes of its words with their share, and the share of words that repeat the one before. Only the fit is bounded, by
SAMPLE labelled texts of each grade with weights that restore the grades' shares; every text is scored whole.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, mix64, slices

BITS = 18
SAMPLE = 3000  # labelled texts of a grade that the fit sees
ROUNDS, RATE, SPARSE, LEAST_TEXTS = 200, 0.1, 2.5e-4, 3
GOOD, FLOOR = 2, 0.5  # a text is selected if P(grade >= GOOD) >= FLOOR
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = 48, 65, 97, 97
_SHAPE[9:14] = 32


def grade(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 poor, 2 good; null where a rating is missing."""
    return F.when(toxic == 1, 0).when((toxic == 0) & (quality == 0), 1).when((toxic == 0) & (quality == 1), 2)


def _bucket(share: np.ndarray) -> np.ndarray:
    """0 for a share over one half, then one step for each halving, up to 10."""
    return np.clip(-np.log2(np.maximum(share, 2.0 ** -10)), 0, 10).astype(np.uint64)


def features(w: Words, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature), distinct and sorted, of a slice."""
    n_docs = len(w.first) - 1
    doc, words = w.doc, np.maximum(np.diff(w.first), 1)
    found = [(doc, w.hash)]
    shape = _SHAPE[w.raw]
    keep = np.concatenate([[True], shape[1:] != shape[:-1]]) if len(shape) else np.zeros(0, bool)
    keep[offsets[:-1][offsets[:-1] < len(shape)]] = True
    shapes = Words(shape[keep], np.concatenate([[0], np.cumsum(keep)])[offsets], False)
    key, count = np.unique((shapes.doc.astype(np.uint64) << np.uint64(40)) | (shapes.hash >> np.uint64(24)), return_counts=True)
    d = (key >> np.uint64(40)).astype(np.int64)
    shape_hash = key & np.uint64((1 << 40) - 1)
    found.append((d, mix64(shape_hash | (_bucket(count / words[d]) + np.uint64(1)) << np.uint64(56))))
    again = np.bincount(doc[1:][(w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])], minlength=n_docs) if len(doc) else np.zeros(n_docs)
    has = np.flatnonzero(np.diff(w.first))
    found.append((has, mix64(_bucket(again[has] / words[has]) + np.uint64(0x7E9EA7ED << 8))))
    d = np.concatenate([f[0] for f in found])
    f = (np.concatenate([f[1] for f in found]) >> np.uint64(64 - BITS)).astype(np.int64)
    both = np.unique(d << BITS | f)
    return both >> BITS, both & ((1 << BITS) - 1)


def text_features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(texts, text number, feature) by slice."""
    for at, to, w in slices(texts, fold=True):
        d, f = features(w, w.offsets)
        yield to - at, d, f


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, latent: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... by column."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - latent[:, None], -40, 40)))


def fit(doc: np.ndarray, feature: np.ndarray, grades: np.ndarray, weight: np.ndarray, levels: int = 3) -> OrdinalModel:
    """Maximum likelihood with an absolute penalty, full batches, steps scaled by past gradients: features that a few texts share by
    chance keep weight 0."""
    share = (np.bincount(grades, weight, levels) + 1e-3) / (weight.sum() + levels * 1e-3)
    below = np.cumsum(share)[:-1]
    thresholds = np.log(below / (1 - below))
    common = np.bincount(feature, minlength=1 << BITS) >= LEAST_TEXTS
    doc, feature = doc[common[feature]], feature[common[feature]]
    w, past = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    t_past = np.full(levels - 1, 1e-6)
    weight = weight / weight.sum()
    for _ in range(ROUNDS):
        f = np.bincount(doc, w[feature], len(grades))
        cut = np.concatenate([[-np.inf], thresholds, [np.inf]])
        upper, lower = (1 / (1 + np.exp(-np.clip(cut[grades + k] - f, -40, 40))) for k in (1, 0))
        p = np.maximum(upper - lower, 1e-9)
        g = np.bincount(feature, (weight * (upper + lower - 1))[doc], 1 << BITS)
        past += g * g
        step = RATE / np.sqrt(past)
        w += step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * SPARSE, 0)
        t = np.zeros(levels + 1)
        np.add.at(t, grades + 1, weight * upper * (1 - upper) / p)
        np.add.at(t, grades, -weight * lower * (1 - lower) / p)
        t_past += t[1:-1] ** 2
        thresholds = np.maximum.accumulate(thresholds + RATE * t[1:-1] / np.sqrt(t_past))
    return OrdinalModel(w.astype(np.float32), thresholds)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel | None:
    """Fits on up to `sample` labelled texts of each grade, chosen by a hash of the id. None where fewer than two grades are labelled."""
    rated = labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade")).where("doc_id is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    rated = rated.where("grade is not null")
    shares = {r.grade: r["count"] for r in rated.groupBy("grade").count().collect()}
    if len(shares) < 2:
        return None
    least = lambda g: rated.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = reduce(DataFrame.unionByName, [least(g) for g in sorted(shares)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for n, d, f in text_features(b.column(1)):
                cut = np.searchsorted(d, np.arange(n + 1))
                parts = [f[x:y].astype("<i4").tobytes() for x, y in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), b.column(2).slice(at, n), pa.array(parts, pa.binary())], ["doc_id", "grade", "features"])
                at += n

    # the chosen rows are 3 * sample at most
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "grade").mapInArrow(
        run, "doc_id long, grade int, features binary").dropDuplicates(["doc_id"]).collect()
    if len({r.grade for r in rows}) < 2:
        return None
    rows.sort(key=lambda r: r.doc_id)
    grades = np.array([r.grade for r in rows])
    lists = [np.frombuffer(r.features, "<i4") for r in rows]
    doc = np.repeat(np.arange(len(rows)), [len(x) for x in lists])
    drawn = np.bincount(grades, minlength=3)
    return fit(doc, np.concatenate(lists).astype(np.int64), grades, np.array([shares[g] / drawn[g] for g in grades.tolist()]))


def select_good(docs: DataFrame, model: OrdinalModel | None) -> DataFrame:
    """The selected rows with all their columns: rated where they stand, so no row is looked up by its id."""
    schema = docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [part.column(4) for part in _rated(pa.nulls(b.num_rows, pa.int64()), b.column(place), shared.value)]
            yield b.filter(pa.chunked_array(keep, pa.bool_()).combine_chunks()) if keep else b

    return docs.mapInArrow(run, schema)


def _rated(ids: pa.Array, texts: pa.Array, m: OrdinalModel | None) -> Iterator[pa.RecordBatch]:
    at = 0
    for n, d, f in text_features(texts):
        full = np.bincount(d, minlength=n) > 0
        if m is None:
            none = pa.nulls(n, pa.float64())
            columns = [none, none, none, pa.array(full)]
        else:
            p = m.tails(np.bincount(d, m.weights[f], n))
            columns = [pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(full & (p[:, GOOD - 1] >= FLOOR))]
        yield pa.RecordBatch.from_arrays([ids.slice(at, n), *columns], ["doc_id", "expected_grade", "p_fair", "p_good", "selected"])
        at += n


def rate(docs: DataFrame, model: OrdinalModel | None) -> DataFrame:
    """One row per row: doc_id, expected_grade, p_fair (P(grade >= 1)), p_good (P(grade >= 2)), selected.

    A text without words (or null) is rated by the thresholds alone and not selected. Without a model the ratings are null and every
    text with words is selected. Repeated rows give repeated rows; further columns are not looked at; no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB, fixed by the number of features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _rated(b.column(0), b.column(1), shared.value)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, expected_grade double, p_fair double, p_good double, selected boolean")
