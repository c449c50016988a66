"""Rankings against plain scoring of every document."""
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from revtrace.operators import ranking


def plain_bm25(queries, docs, k):
    words = {d: t.lower().split() for d, t in docs}
    n, avg = len(docs), sum(map(len, words.values())) / len(docs)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = []
    for q, text in queries:
        scored = []
        for d, ws in words.items():
            tf, s = Counter(ws), 0.0
            for w in text.lower().split():
                if tf[w]:
                    s += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / avg))
            if round(s, 6) > 0:
                scored.append((-round(s, 6), d))
        out += [(q, d, r) for r, (_, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_docs,query_block", [(1 << 14, 1 << 10), (40, 3)])
def test_keywords(spark, shard_docs, query_block):
    rng = random.Random(4)
    pool = [f"w{int(rng.paretovariate(0.8))}" for _ in range(4000)]
    docs = [(f"d{i:04}", " ".join(rng.sample(pool, rng.choice([2, 8, 30])))) for i in range(400)] + [(f"t{i}", "w1 tie") for i in range(50)] + [("z", "")]
    queries = [(i, " ".join(rng.sample(pool, 8))) for i in range(10)] + [(98, "w1 tie tie"), (99, "absent"), (100, "")]
    got = ranking.bm25(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(docs, "doc_id string, text string").repartition(3), 7,
                       shard_docs=shard_docs, query_block=query_block).collect()
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in got) == plain_bm25(queries, docs, 7)


@pytest.mark.parametrize("tile,block_bytes", [(1 << 20, 1 << 26), (16, 100)])
def test_vectors(spark, tile, block_bytes):
    """Clusters, copies (ties), opposite and zero vectors, and vectors on a line, for which bounds rule out little."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 5))
    docs = [c + rng.normal(scale=0.05, size=5) for c in centre for _ in range(30)] + [centre[0]] * 8 + [-centre[0], np.zeros(5)] + [np.array([1, i / 50, 0, 0, 0]) for i in range(40)]
    queries = [*centre, -centre[1], np.zeros(5), np.array([1, 0.3, 0, 0, 0.0])]
    unit = lambda v: v / max(np.linalg.norm(v), 1e-300)
    want = []
    for q, v in enumerate(queries):
        scored = sorted((-round(float(unit(d) @ unit(v)), 6) + 0.0, i) for i, d in enumerate(docs))[:9]
        want += [(q, i, r) for r, (_, i) in enumerate(scored, 1)]
    table = lambda rows, c: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], f"{c} long, embedding array<double>")
    got = ranking.vector_rank(table(queries, "query_id"), table(docs, "doc_id").repartition(3), 9, tile=tile, block_bytes=block_bytes).collect()
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in got) == sorted(want)


def test_postings_are_sent_by_cell_and_block(spark, monkeypatch):
    """Groups get a row for a cell and block and one for a query and shard, not one for every term, shard and block."""
    kind, rows, real = type(spark.range(0)), [], type(spark.range(0)).mapInArrow

    def counted(self, *a, **b):
        rows.append(self.count())
        return real(self, *a, **b)

    monkeypatch.setattr(kind, "mapInArrow", counted)
    text = F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * p) % 300) for p in (1, 7, 11, 13)])
    docs, queries = spark.range(1000).select(F.col("id").alias("doc_id"), text.alias("text")), spark.range(500).select(F.col("id").alias("query_id"), text.alias("text"))
    got = ranking.bm25(queries, docs, 3, shard_docs=50, query_block=50).collect()
    assert rows[-1] <= 20 * 10 + 500 and len(got) == 1500


def test_lists_in_several_shards(spark):
    """Few postings a shard: every query meets many shards; common terms, copies and repeated words."""
    rng = random.Random(7)
    docs = [(i, " ".join(["the"] * rng.choice([0, 1, 3]) + rng.choices([f"w{j}" for j in range(40)], k=rng.choice([1, 3, 9])))) for i in range(300)] + [(300 + i, "the same words here") for i in range(30)]
    queries = [(i, t) for i, (_, t) in enumerate(docs[::9])] + [(900, "the"), (901, "same words the the here none")]
    table = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    for shard_postings in (1 << 23, 200):
        got = ranking.bm25(table(queries, "query_id"), table(docs, "doc_id").repartition(3), 10, shard_postings=shard_postings).collect()
        assert sorted((r.query_id, r.doc_id, r["rank"]) for r in got) == plain_bm25(queries, docs, 10)
