"""Near-duplicates by HyperMinHash: compressed registers, banded, a collision-corrected estimate, and confirmation on full sets.

1. One pass over the texts gives each document the number of its distinct 5-word shingles, a 128-bit name of the set and REGISTERS
   registers of 16 bits: of the smallest hash in a bucket the leading zeros (6 bits) and the next MANTISSA bits. Documents with the
   same set become one class.
2. Bands of ROWS registers are keys. In each bucket every class meets the bucket's smallest class. Pairs whose sizes or estimated
   similarity rule a link out go; the rest is confirmed on the full sets, and the links give first components.
3. Only a bucket whose other classes still lie in several components can hide a link. There all pairs across components are compared
   by sketch. Those that could be links are confirmed on full sets, all of them where they are few for the bucket's members, else a
   spanning forest of the components, strongest estimates first.
4. A bucket that withheld pairs and still has several components comes again with the full sets of its members, in blocks of bounded
   size. There every pair across components that could be a link is confirmed where the sets stand, and only links that join two
   components leave the task. So no such pair is left out, and a group of near copies makes at most a row for each member and bucket.

At similarity 0.75 a band of 4 equal registers has probability 0.316; all 48 miss with probability 1e-8.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .common import Words, mix64, slices, written
from .components import components

SHINGLE = 5
SIMILARITY = 0.75
REGISTERS, ROWS, MANTISSA, TAIL_BITS = 192, 4, 10, 48
BANDS = REGISTERS // ROWS
EMPTY = 0xFFFF
COLLISION = 0.1699 * 2.0 ** -MANTISSA  # chance that registers of different hashes agree, sets of like size
SIGMAS = 6.0  # of the estimate, below the threshold, that a pair may lie and still be confirmed
BLOCK = 4096
FEW = 8  # pairs for each member, up to which a bucket gives all its pairs at once
BLOCK_SHINGLES = 2 << 20  # of the sets that a block holds
GATHER = 1 << 22  # shingles that are looked up at once
SMALL = 8 << 20

_SALT = np.array([0x9AE16A3B2F90404F, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each shingle of a slice; a text with fewer words has its whole sequence as one."""
    n = len(w.hash)
    counts = np.diff(w.first)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(max(n - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE):
        total += w.hash[k:n - SHINGLE + 1 + k] * _SALT[k] if len(total) else total
    ok = w.doc[:len(total)] == w.doc[SHINGLE - 1:] if len(total) else np.zeros(0, bool)
    docs, hashes = w.doc[:len(total)][ok], mix64(total[ok])
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            has = counts[short] > k
            whole[has] += w.hash[w.first[short[has]] + k] * _SALT[k]
        docs = np.concatenate([docs, short])
        hashes = np.concatenate([hashes, mix64(whole + counts[short].astype(np.uint64))])
        order = np.argsort(docs, kind="stable")
        docs, hashes = docs[order], hashes[order]
    return docs, hashes


def distinct_sets(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(number of texts, sorted distinct shingle hashes of each) by slice."""
    for at, to, w in slices(texts, fold=True):
        docs, hashes = shingles(w)
        cut = np.searchsorted(docs, np.arange(to - at + 1))
        yield to - at, [np.unique(hashes[a:b]) for a, b in zip(cut, cut[1:])]


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, REGISTERS) uint16."""
    sizes = np.array([len(s) for s in sets])
    low = np.full(len(sets) * REGISTERS, 1 << TAIL_BITS, np.uint64)
    if sizes.sum():
        t = mix64(np.concatenate(sets) ^ np.uint64(0x5851F42D4C957F2D))
        bucket = ((t >> np.uint64(TAIL_BITS)) * np.uint64(REGISTERS)) >> np.uint64(64 - TAIL_BITS)
        np.minimum.at(low, np.repeat(np.arange(len(sets)), sizes) * REGISTERS + bucket.astype(np.int64), t & np.uint64((1 << TAIL_BITS) - 1))
    fraction, exponent = np.frexp(low.astype(np.float64))
    zeros = np.where(low == 0, TAIL_BITS, TAIL_BITS - exponent)
    mantissa = np.where(low == 0, 0, (fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    regs = np.where(low == 1 << TAIL_BITS, EMPTY, (zeros << MANTISSA) | mantissa)
    return regs.astype(np.uint16).reshape(len(sets), REGISTERS)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (the set's name), regs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for n, sets in distinct_sets(b.column(1)):
                regs = registers(sets)
                names = [(int(s.sum(dtype=np.uint64)), int(mix64(s ^ np.uint64(0xA24BAED4963EE407)).sum(dtype=np.uint64))) for s in sets]
                a, c = (np.array([x[i] for x in names], np.uint64).view(np.int64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(at, n), pa.array([len(s) for s in sets], pa.int64()), pa.array(a), pa.array(c),
                    pa.array([r.tobytes() for r in regs], pa.binary())], ["doc_id", "n_shingles", "set_a", "set_b", "regs"])
                at += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, set_a long, set_b long, regs binary")


def _keys(packed: np.ndarray, band: np.ndarray) -> np.ndarray:
    return mix64(mix64(packed) + band.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def band_keys(classes: DataFrame) -> DataFrame:
    """(key, rep) for each band of a class with a register in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            regs = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS)
            packed = np.ascontiguousarray(regs).view(np.uint64).reshape(-1, BANDS)
            keys = _keys(packed, np.arange(BANDS))
            row, band = np.nonzero(packed != np.uint64((1 << 64) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(keys[row, band].view(np.int64)), b.column(0).take(pa.array(row))], ["key", "rep"])

    return classes.select("rep", "regs").mapInArrow(run, "key long, rep long")


def estimate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity by equal registers, less the collisions to be expected, and the number of registers that either uses."""
    used = ((x != EMPTY) | (y != EMPTY)).sum(-1)
    same = ((x == y) & (x != EMPTY)).sum(-1)
    used = np.maximum(used, 1)
    return (same - COLLISION * used) / used, used


def may_link(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether sizes and sketches allow a link, the estimate)."""
    j, used = estimate(x, y)
    near = j >= SIMILARITY - SIGMAS * np.sqrt(SIMILARITY * (1 - SIMILARITY) / used)
    return near & (100 * np.minimum(nx, ny) >= 75 * np.maximum(nx, ny)), j


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that size and sketch don't rule out."""
    side = lambda c, x: classes.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    both = pairs.join(side("a", "a"), "a").join(side("b", "b"), "b").where(
        "100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b)").select("a", "b", "n_a", "n_b", "regs_a", "regs_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
                keep, _ = may_link(x, y, b.column(2).to_numpy(), b.column(3).to_numpy())
                yield b.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set) of the documents in ids (one column, id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for n, sets in distinct_sets(b.column(1)):
                sizes = np.cumsum([0, *[len(s) for s in sets]])
                values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                arr = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), arr], ["id", "set"])
                at += n

    few = broadcast_if_small(ids, 16, SMALL)
    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(few, "id", "left_semi")
    return wanted.mapInArrow(run, "id long, set array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs with 100 * |intersection| >= 75 * |union| on the full shingle sets."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-ids")
    sets = written(full_sets(docs, ids).dropDuplicates(["id"]), "near-sets")
    side = lambda c: sets.select(F.col("id").alias(c), F.col("set").alias(f"set_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(100 * common >= 75 * (F.size("set_a") + F.size("set_b") - common)).select("a", "b")


def forest(bucket: np.ndarray, x: np.ndarray, y: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Numbers of the edges (x, y: components within a bucket) of a spanning forest of each bucket, strongest edges first."""
    nodes, flat = np.unique(np.stack([np.concatenate([bucket, bucket]), np.concatenate([x, y])]), axis=1, return_inverse=True)
    flat = flat.reshape(-1)
    u, v = flat[:len(x)], flat[len(x):]
    order = np.argsort(-strength, kind="stable")
    u, v = u[order], v[order]
    label, taken, live = np.arange(nodes.shape[1]), [], np.arange(len(u))
    while len(live):
        live = live[label[u[live]] != label[v[live]]]
        if not len(live):
            break
        best = np.full(len(label), len(u))  # of each component, its strongest edge out
        for end in (u, v):
            np.minimum.at(best, label[end[live]], live)
        chosen = np.unique(best[best < len(u)])
        taken.append(chosen)
        while True:  # the joined components take the smallest label
            a, b = label[u[chosen]], label[v[chosen]]
            low = label.copy()
            np.minimum.at(low, np.concatenate([a, b]), np.concatenate([np.minimum(a, b)] * 2))
            low = low[low]
            if np.array_equal(low[label], label):
                break
            label = low[label]
    return order[np.concatenate(taken)] if taken else np.zeros(0, np.int64)


def in_blocks(members: DataFrame, weight: str = "0") -> DataFrame:
    """members(key, rep, component, ...) with bucket and side. A key over BLOCK members (or BLOCK_SHINGLES of weight) is dealt to blocks, those
    of its most frequent component, which need not meet each other, apart from the others. A block of that component meets each block of
    the others, and these meet each other, in a bucket of two sides; members meet the other side only. Side -1 meets all of its bucket."""
    sums = members.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum(F.expr(weight)).alias("w")).groupBy("key").agg(
        F.max_by(F.struct("component", "n", "w"), F.struct("n", "component")).alias("most"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    needed = lambda n, w: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(w / BLOCK_SHINGLES))
    sizes = written(sums.where((F.col("n") > BLOCK) | (F.col("w") > BLOCK_SHINGLES)).select("key", F.col("most.component").alias("most"), needed(
        F.col("most.n"), F.col("most.w")).alias("firsts"), needed(F.col("n") - F.col("most.n"), F.col("w") - F.col("most.w")).alias("others")), "near-large")
    if sizes.isEmpty():
        return members.select(*members.columns, F.col("key").alias("bucket"), F.lit(-1).alias("side"))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    place = lambda kind, x, y, side: F.struct(F.xxhash64("key", F.lit(kind), x, y).alias("bucket"), side.cast("int").alias("side"))
    large = members.join(sizes, "key").withColumn("first", F.col("component") == F.col("most"))
    large = large.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("first"), F.col("firsts")).otherwise(F.col("others"))))
    own = F.col("own")
    among = F.transform(upto("others"), lambda j: place(1, F.least(own, j), F.greatest(own, j), F.when(own == j, -1).when(own < j, 0).otherwise(1)))
    places = F.when(F.col("first"), F.transform(upto("others"), lambda j: place(0, own, j, F.lit(0)))).otherwise(
        F.concat(F.transform(upto("firsts"), lambda i: place(0, i, own, F.lit(1))), among))
    split = large.withColumn("place", F.explode(places)).select(*members.columns, "place.bucket", "place.side")
    whole = members.join(sizes, "key", "left_anti").select(*members.columns, F.col("key").alias("bucket"), F.lit(-1).alias("side"))
    return whole.unionByName(split)


def with_sketches(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows(key, rep, component, bucket, side) with n_shingles and regs. A class meets its sketch once, not for each of its buckets."""
    places = rows.groupBy("rep", "component").agg(F.collect_list(F.struct("key", "bucket", "side")).alias("places"))
    return places.join(classes.select("rep", "n_shingles", "regs"), "rep").select("rep", "component", "n_shingles", "regs", F.inline("places"))


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows again, a bucket never cut in two. Buckets stand one after another."""
    rest = None  # the last bucket of a batch may go on in the next
    for b in batches:
        table = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        last = np.searchsorted(table.column("bucket").to_numpy(), table.column("bucket")[-1].as_py()) if len(table) else 0
        if last:
            yield table.slice(0, last)
        rest = table.slice(last)
    if rest is not None and len(rest):
        yield rest


def in_first_bucket(packed: np.ndarray, x: np.ndarray, y: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether key is that of the first band which members x and y share."""
    shared = (packed[x] == packed[y]) & (packed[x] != np.uint64((1 << 64) - 1))
    first = shared.argmax(1)
    return _keys(packed[x, first], first).view(np.int64) == key


def across(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Of the pairs of different components in one bucket that could be links, each pair in the first bucket that it shares: (a, b) of all
    where they are few, else of a spanning forest; and (key) of the buckets that withhold others. members: key, rep, component. Buckets
    stand one after another in a partition, their members by size, so that a member's partners of like size follow it."""
    rows = with_sketches(in_blocks(members), classes).repartition("bucket").sortWithinPartitions("bucket", "n_shingles")

    def compare(table: pa.Table) -> pa.RecordBatch:
        bucket, key, side, component, rep, n = (table.column(c).to_numpy() for c in ("bucket", "key", "side", "component", "rep", "n_shingles"))
        regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        packed = np.ascontiguousarray(regs).view(np.uint64).reshape(-1, BANDS)
        left, right, strength, live, lag = [], [], [], np.arange(len(rep)), 0
        while len(live):
            lag += 1
            live = live[live + lag < len(rep)]
            live = live[(bucket[live] == bucket[live + lag]) & (100 * n[live] >= 75 * n[live + lag])]
            test = live[(component[live] != component[live + lag]) & ((side[live] < 0) | (side[live] != side[live + lag]))]
            for part in (test[k:k + 4096] for k in range(0, len(test), 4096)):
                near, j = may_link(regs[part], regs[part + lag], n[part], n[part + lag])
                ok, j = part[near], j[near]
                own = in_first_bucket(packed, ok, ok + lag, key[ok])
                left.append(ok[own])
                right.append(ok[own] + lag)
                strength.append(j[own])
        left, right = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (left, right))
        strength = np.concatenate(strength) if strength else np.zeros(0)
        names, of = np.unique(bucket, return_inverse=True)
        few = np.bincount(of[left], minlength=len(names)) <= FEW * np.bincount(of, minlength=len(names))
        take = np.union1d(np.flatnonzero(few[of[left]]), forest(bucket[left], component[left], component[right], strength))
        held = np.ones(len(left), bool)
        held[take] = False
        more = np.unique(key[left[held]])
        a, b = np.minimum(rep[left[take]], rep[right[take]]), np.maximum(rep[left[take]], rep[right[take]])
        none = [None] * len(more)
        return pa.RecordBatch.from_arrays([pa.array([*a.tolist(), *none], pa.int64()), pa.array([*b.tolist(), *none], pa.int64()),
                                           pa.array([*[None] * len(a), *more.tolist()], pa.int64())], ["a", "b", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches):
            yield compare(table)

    return rows.mapInArrow(run, "a long, b long, key long")


def joining(key: int, component: np.ndarray, side: np.ndarray, n: np.ndarray, regs: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (numbers of members of one bucket, in order of n) that join its components as all links of the bucket do."""
    packed = np.ascontiguousarray(regs).view(np.uint64).reshape(-1, BANDS)
    sizes = np.array([len(s) for s in sets])
    start = np.concatenate([[0], np.cumsum(sizes)])
    number = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    mark = np.zeros(int(number.max(initial=-1)) + 1, bool)
    label = np.unique(component, return_inverse=True)[1]
    found = []
    for x in range(len(n)):
        y = np.arange(x + 1, np.searchsorted(75 * n, 100 * n[x], "right"))
        y = y[(label[y] != label[x]) & ((side[x] < 0) | (side[y] != side[x]))]
        y = y[may_link(regs[y], regs[x], n[y], n[x])[0]]
        y = y[in_first_bucket(packed, np.full(len(y), x), y, np.full(len(y), key))]
        if not len(y):
            continue
        mark[number[start[x]:start[x + 1]]] = True
        common, total = np.zeros(len(y), np.int64), np.cumsum(sizes[y])
        for part in np.split(np.arange(len(y)), np.searchsorted(total, np.arange(GATHER, total[-1], GATHER))):
            ends = np.cumsum(sizes[y[part]])
            begins = ends - sizes[y[part]]
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[y[part]] - begins, sizes[y[part]])
            hits = np.concatenate([[0], np.cumsum(mark[number[at]])])
            common[part] = hits[ends] - hits[begins]
        mark[number[start[x]:start[x + 1]]] = False
        y = y[100 * common >= 75 * (sizes[x] + sizes[y] - common)]
        labels, one = np.unique(label[y], return_index=True)
        found += [(x, int(k)) for k in y[one]]
        label[np.isin(label, labels)] = label[x]
    return found


def linked_within(members: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): links between the components of each bucket, confirmed on full sets in its task, at most a row for each member of a bucket.
    members: key, rep, component."""
    ids = written(members.select(F.col("rep").alias("id")).distinct(), "near-ids")
    sets = full_sets(docs, ids).dropDuplicates(["id"]).withColumnRenamed("id", "rep")
    sets = written(sets.join(classes.select("rep", "regs"), "rep"), "near-sets")
    sized = members.join(classes.select("rep", "n_shingles"), "rep").select("key", "rep", "component", "n_shingles")
    rows = in_blocks(sized, "n_shingles").join(sets, "rep").repartition("bucket").sortWithinPartitions("bucket", "n_shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches):
            bucket, key, side, component, rep, n = (table.column(c).to_numpy() for c in ("bucket", "key", "side", "component", "rep", "n_shingles"))
            regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            cut = np.flatnonzero(np.diff(bucket, prepend=~bucket[:1], append=~bucket[-1:]))
            for p, q in zip(cut, cut[1:]):
                sets = [s.values.to_numpy() for s in table.column("set")[p:q]]
                found = np.array(joining(key[p], component[p:q], side[p:q], n[p:q], regs[p:q], sets), np.int64).reshape(-1, 2) + p
                yield pa.RecordBatch.from_arrays([pa.array(rep[found[:, 0]]), pa.array(rep[found[:, 1]])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def mixed_buckets(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows(key, rep) of the buckets with several components, with the component. found: (node, component)."""
    labelled = rows.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    return written(labelled.join(mixed, "key"), "mixed")


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) with further links (a, b)."""
    return found if links.isEmpty() else components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    A text without words (or null) has no shingles and is linked with nothing. doc_id is the key: rows that repeat a document share
    its component, and different texts under one id count as linked. A row without id is linked with nothing and kept
    (component null). An empty table gives no rows; further columns are not looked at.
    """
    docs = docs.select("doc_id", "text")
    rows = written(sketches(docs), "sketches")
    named = rows.where("doc_id is not null and n_shingles > 0")
    classes = written(named.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "n_shingles", "regs")).alias("c")).select(
        "set_a", "set_b", F.col("c.doc_id").alias("rep"), F.col("c.n_shingles").alias("n_shingles"), F.col("c.regs").alias("regs")), "classes")
    keys = band_keys(classes).repartition("key")  # one shuffle for both uses
    shared = keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("n")).where("low < high")
    members = written(keys.join(shared.select("key", "low", "n"), "key").where("rep <> low"), "buckets")
    star = written(members.select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct(), "near-star")
    last = components(written(confirmed(written(likely(star, classes), "pairs"), docs), "links"))
    mixed = mixed_buckets(members.where("n > 2").select("key", "rep"), last)  # the smallest of a bucket has met all others
    if not mixed.isEmpty():
        out = written(across(mixed, classes), "near-forest")
        pairs = written(out.where("a is not null").select("a", "b").distinct().join(star, ["a", "b"], "left_anti"), "pairs")
        last = joined(last, written(confirmed(pairs, docs), "links"))
        more = out.where("key is not null").select("key").distinct()
        mixed = mixed_buckets(mixed.select("key", "rep").join(more, "key", "left_semi"), last)
        if not mixed.isEmpty():
            last = joined(last, written(linked_within(mixed, classes, docs).distinct(), "links"))
    of_class = classes.select("set_a", "set_b", "rep").join(last.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_a", "set_b", F.coalesce("component", "rep").alias("component_id"))
    found = named.join(of_class, ["set_a", "set_b"]).select("doc_id", "n_shingles", "component_id")
    alone = rows.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay: the smallest id of each component."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("_doc"))
    return rows.join(kept, F.col("_doc").eqNullSafe(F.col("_id")), "left_semi").select("row.*")
