"""The pipeline's stages, each against brute force on what the one before kept, on a small table of labelled documents."""
import collections
import hashlib

import pytest

import corpus_pipeline
from revtrace.llm.q_bpe import vocabulary

from .edge import PROSE, folded, texts, words
from .test_edges import components_by_force


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    w = PROSE.split()
    rows = [(i, " ".join(w[(i * k) % len(w)] for k in range(1, 60 + i)), f"s{i % 3}") for i in range(100, 120)]
    rows += [(200, rows[0][1].upper(), "s1"), (201, rows[1][1] + " tail", None), (202, rows[1][1] + " tail", None)]
    rows += [(i, f"you idiot loser {rows[i % 20][1]}", "s0") for i in range(300, 310)] + [(i, "$$$ ### " * 30 + str(i), "s2") for i in range(400, 410)]
    rows += [(d, t, "s0") for d, t in texts() if d in (5, 6, 7, 8)]
    spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(d, int(d < 400), int(300 <= d < 400)) for d, _, _ in rows if d >= 100]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    from tokenizers import Tokenizer
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        rows = out.collect()
        if name == "quality classifier":
            kept = {r.doc_id for r in rows}
            assert kept - {8} == {r.doc_id for r in before if 100 <= r.doc_id < 300}  # 8: one word, not labelled
        elif name == "exact dedup":
            keep = {}
            for r in before:
                keep[folded(r.text)] = max(keep.get(folded(r.text), r.doc_id), r.doc_id)
            assert sorted(r.doc_id for r in rows) == sorted(keep.values())
        elif name == "MinHash near-dedup":
            groups = components_by_force([(r.doc_id, r.text) for r in before])
            assert sorted(r.doc_id for r in rows) == sorted(d for d, (_, c) in groups.items() if c == d)
        elif name == "mixing sources to target weights":
            total = sum(len(words(r.text)) for r in before)
            sizes = {r.doc_id: len(words(r.text)) for r in before}
            taken = collections.Counter()
            for r in rows:
                taken[r.doc_id] += len(words(r.text))
            assert abs(sum(taken.values()) - total) <= 32 and all(n <= 3 * sizes[d] for d, n in taken.items())
        else:
            t = Tokenizer.from_file(vocabulary())
            want = []
            for r in before:
                ids = t.encode(r.text or "", add_special_tokens=False).ids
                want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
            assert sorted(map(tuple, rows)) == sorted(want)
            assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(want)
            return
        assert out.columns == columns
        docs, before = spark.createDataFrame(rows, docs.schema), rows
