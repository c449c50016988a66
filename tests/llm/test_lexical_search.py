"""Ranked search against a plain scoring of every document, with small shards and blocks so that lists are skipped and cut."""
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from revtrace.llm import lexical_index, lexical_search

from .edge import folded, frame, texts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, k=10):
    terms = [(d, Counter(TERM.findall(folded(t)))) for d, t in docs]
    size = [sum(c.values()) for _, c in terms]
    n, total = sum(s > 0 for s in size), sum(size)
    df = Counter(t for _, c in terms for t in c)
    queries = {}
    for item, text in dict.fromkeys(items):
        queries.setdefault(item, Counter()).update(TERM.findall(folded(text)))
    out = []
    for item, q in queries.items():
        scored = []
        for (d, c), s in zip(terms, size):
            m = 25 + (75 * s * n) // total if total else 25
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in q.items() if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, tmp, shard_bytes):
    lexical_search.build_index(docs, shard_bytes=shard_bytes).write.mode("overwrite").parquet(tmp)
    rows = lexical_search.search(spark.read.parquet(tmp), spark.createDataFrame(items, "item_id long, text string, score string")).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=str)


@given(st.lists(st.integers(0, 2**31 - 1), max_size=50))
def test_bytes_round_trip(values):
    data, ends = lexical_index.pack(np.array(values, np.int64))
    assert lexical_index.unpack(data).tolist() == values and len(ends) == len(values)


@pytest.mark.parametrize("shard_bytes", [200, 60_000, 16 << 20])
def test_edge_table(spark, tmp_path, monkeypatch, shard_bytes):
    monkeypatch.setattr(lexical_index, "PIECE_BYTES", 1000)
    items = [(1, "The quick brown fox, the FOX"), (2, None), (3, ""), (4, "absent words only xyzzy"), (5, "a b fox 漢字 é"), (5, "lazy dog"), (1, "The quick brown fox, the FOX"),
             (None, "river bank"), (7, " ".join(["evening light"] * 40)), (8, "x" * 50000)]
    want = plain(texts(), items)
    assert run(spark, frame(spark), [(*i, "s") for i in items], str(tmp_path / "i"), shard_bytes) == want
    assert len(want) > 20


def test_empty_tables(spark, tmp_path):
    assert run(spark, frame(spark).limit(0), [(1, "fox", "s")], str(tmp_path / "a"), 1000) == []
    docs = frame(spark)
    lexical_search.build_index(docs).write.parquet(str(tmp_path / "b"))
    none = spark.createDataFrame([], "item_id long, text string")
    assert lexical_search.search(spark.read.parquet(str(tmp_path / "b")), none).count() == 0


def test_skewed_terms_and_pruning(spark, tmp_path, monkeypatch):
    """Common terms with long lists, rare ones that decide, and many ties. Blocks of the common lists stay compressed."""
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(60_000)]
    docs = [(i, " ".join(words[rng.randrange(59_000):][: rng.choice([3, 20, 60, 400])])) for i in range(2500)] + [(5000 + i, "w1 w2 tie") for i in range(300)]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.sample(words, 25))) for i in range(30)] + [(99, "w1 w2 tie"), (98, "w1"), (97, "w1 w1 w2 rare")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert run(spark, table, [(*i, "s") for i in items], str(tmp_path / "i"), 100_000) == plain(docs, items)


def test_blocks_stay_compressed():
    """Once ten documents with the rare term are known, blocks of the common one are opened only where the rare one stands."""
    data = [b"rare common" if i < 20 or i == 2000 else b"common and others" for i in range(3000)]
    builder = lexical_index.ShardBuilder()
    builder.add(pa.array(range(3000), pa.int64()), np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    head, *batches = builder.rows(0)
    m = lexical_index.lengths(np.array(head.column("lens")[0].as_py()), 3000, head.column("terms")[0].as_py())
    lists = {r["term"]: lexical_index.PostingList(r["df"], *(np.array(r[c]) for c in ("last", "top_tf", "least_n", "ends")), r["blob"], m, 3000, 9000)
             for b in batches for r in b.to_pylist()}
    best = lexical_index.Best(10)
    lexical_index.search_shard([(lists["common"], 1), (lists["rare"], 5000)], np.arange(3000), np.zeros(3000, bool), best)
    assert best.id.tolist() == list(range(10))
    assert np.flatnonzero(lists["common"].open).tolist() == [0, 1, 2, 3, 2000 // 128]
