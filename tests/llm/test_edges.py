"""Every operator on the edge table and on an empty one, against plain computations."""
import collections
import hashlib
import math
import random
import zlib

import pytest

import __spark_entry__ as entry
from revtrace.llm import bpe, exact_dedup, line_dedup, licenses, lm_scoring, media, mixing, near_dedup, quality, substring_dedup
from revtrace.llm.q_bpe import vocabulary

from .edge import SCHEMA, folded, frame, texts, words


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_exact(spark, docs, empty):
    rows = exact_dedup.new_index(spark).admit(docs, "b").collect()
    groups = collections.defaultdict(list)
    for d, t in texts():
        groups[folded(t)].append(d)
    by_digest = {bytes.fromhex(sha(t.encode())): ids for t, ids in groups.items()}
    assert len(rows) == len(texts())
    for r in rows:
        ids = by_digest[bytes(r.digest)]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
    assert exact_dedup.new_index(spark).admit(empty, "b").count() == 0
    kept = exact_dedup.drop_copies(docs, exact_dedup.new_index(spark), "b")
    assert kept.columns == docs.columns and sorted(folded(r.text) for r in kept.collect()) == sorted(groups)


def test_index_across_batches(spark):
    index = exact_dedup.new_index(spark)
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A")], "doc_id long, text string")
    second = spark.createDataFrame([(4, "a"), (5, "c")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in index.admit(first, "1").collect()} == {1: False, 2: True, 3: True}
    for _ in range(2):  # a batch that comes again changes nothing
        assert {r.doc_id: (r.keep_id, r.kept) for r in index.admit(second, "2").collect()} == {4: (3, False), 5: (5, True)}
    assert index.table().count() == 3


def test_index_opened_with_other_settings(spark, tmp_path):
    """The number of buckets stays that of the folder: known texts are known in a session with other settings too."""
    path, before = str(tmp_path / "index"), spark.conf.get("spark.sql.shuffle.partitions")
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    index = exact_dedup.DigestIndex(spark, path, 4)
    assert index.admit(docs, "1").where("kept").count() == 400
    try:
        spark.sql(f"DROP TABLE {index.name}")  # as in a session whose catalog does not know it
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        again = exact_dedup.DigestIndex(spark, path)
        assert again.buckets == 4 and again.admit(docs, "2").where("kept").count() == 0 and again.table().count() == 400
        with pytest.raises(ValueError):
            exact_dedup.DigestIndex(spark, path, 7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def components_by_force(rows):
    sets, keys = {}, []
    for d, t in rows:
        w = folded(t)
        w = words(w)
        s = frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        if d is not None:
            sets[d] = s
            keys.append(d)
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (len(sets[k]), find(k)) for k in ids}


def test_near(spark, docs, empty):
    want = components_by_force(texts())
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == len(texts())
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.one_of_each(docs).columns == docs.columns


def test_near_links_across_bucket_leaders(spark, monkeypatch):
    """Chains of edits: links that do not touch a bucket's smallest class, compared in blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    base = [f"w{i}" for i in range(60)]
    rows, at = [], 0
    for chain in range(3):
        w = [f"c{chain}x{x}" for x in base]
        for step in range(12):
            rows.append((at := at + 1, " ".join(w)))
            w = w[:step * 4] + [f"n{chain}_{step}"] + w[step * 4 + 1:]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == components_by_force(rows)


def removed_by_force(rows, window):
    first, out = {}, []
    for d, t in rows:
        w = words(t)
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i:i + window])
                first[k] = min(first.get(k, d), d)
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i:i + window])] < d:
                    gone[i:i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d if d is not None else -1, len(w), sum(gone), sha(" ".join(kept).encode())))
    return sorted(out)


@pytest.mark.parametrize("window,per_shard", [(50, 4000), (8, 2)])
def test_substrings(docs, window, per_shard):
    rows = substring_dedup.substring_dedup(docs, window, per_shard).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == removed_by_force(texts(), window)


def test_substrings_of_nothing(empty):
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_bpe(docs, empty):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary())
    want = []
    for d, x in texts():
        e = t.encode(x or "", add_special_tokens=False)
        want.append((d or -1, len(e.ids), sha(",".join(map(str, e.ids)).encode()), sha(t.decode(e.ids, skip_special_tokens=False).encode())))
    got = [(r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encoding_digests(docs, vocabulary()).collect()]
    assert sorted(got) == sorted(want)
    assert bpe.encoding_digests(empty, vocabulary()).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(docs, vocabulary()), vocabulary()).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((d or -1, x or "") for d, x in texts())


def test_long_words_merge_like_short_ones():
    e = bpe.encoder(vocabulary())
    for w in (b" thethethe" * 30, bytes(range(256)) * 2, b"aaaa" * 100):
        assert e._by_array(w) == e._by_heap(w)


def test_media(spark, docs, empty):
    stored = media.store_texts(docs)
    found = media.described(stored)
    assert found.count() == len({t or "" for _, t in texts()})
    got = {r.digest: r for r in found.collect()}
    for r in stored.collect():
        raw = dict((d, t) for d, t in texts()).get(r.doc_id) if r.doc_id is not None else None
        if r.doc_id is None:
            continue
        raw = (raw or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        g = got[r.digest]
        assert (r.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-32:]))
        assert media.from_png(bytes(r.media)) == payload and (g.media_bytes, g.media_sha256) == (len(r.media), sha(bytes(r.media)))
    seq = media.sequences(media.document_pages(stored), "doc_id", "html")
    items = media.resolve(seq, found).collect()
    assert len(items) == 2 * len(texts()) and all((i.payload_bytes is None) == (i.kind == "text") for i in items)
    assert media.described(media.store_texts(empty)).count() == 0


def test_html_sequence():
    items = media.sequence('<h1>T</h1><p>a &amp; b<br>c<figure><figcaption>First</figcaption><img src="x.png" alt="q"></figure>t'
                           '<figure><img src=y><img data-src=z title=U><figcaption>Cap <b>x</b></figcaption></figure><script>no</script>end<img alt=none>')
    assert [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in items] == [
        ("text", "T", None), ("text", "a & b", None), ("text", "c", None), ("img", "x.png", "First"), ("text", "t", None), ("img", "y", "Cap x"),
        ("img", "z", "Cap x"), ("text", "end", None)]
    assert [i["position"] for i in items] == list(range(8)) and media.sequence("") == [] and media.sequence("a<p")[0]["text"] == "a<p"


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts())
    size = collections.Counter()
    for r in rows:
        size[r.source] += r.size
    names = sorted((n for n in size if n is not None)) + [None] * (None in size)
    w = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    full, total = set(), sum(size.values())
    while True:
        left, sum_w = total - sum(3 * size[n] for n in full), sum(w[n] for n in names if n not in full)
        want = {n: 3 * size[n] if n in full else left * w[n] / sum_w for n in names}
        over = {n for n in names if want[n] > 3 * size[n]}
        if not over:
            break
        full |= over
    taken = collections.Counter()
    for r in rows:
        assert r.source_size == size[r.source] and math.isclose(r.target, want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[n] - want[n]) <= 2 * mixing.BLOCK_WORDS for n in names)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(empty).count() == 0
    out = mixing.taken_texts(docs.dropDuplicates(["doc_id", "text"]).where("doc_id is not null"))
    plan = {r.doc_id: r.taken for r in mixing.mix(docs.dropDuplicates(["doc_id", "text"]).where("doc_id is not null")).collect()}
    got = collections.Counter()
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
    assert out.columns == docs.columns and all(got[d] == n for d, n in plan.items())


@pytest.mark.parametrize("cap", [1, 40])
def test_apportion_is_sainte_lague(spark, cap):
    votes = [(g, p, v, s) for g, s, vs in (("a", 101, [7, 90, 1, 33, 0, 33]), ("b", 7, [5, 5, 5]), ("c", 0, [3, 4])) for p, v in enumerate(vs)]
    df = spark.createDataFrame([(g, p, v, s, v * cap) for g, p, v, s in votes], "g string, p long, v long, s long, most long")
    got = {(r.g, r.p): r.quota for r in mixing.apportion(df, ["g"], ["p"], "v", "s", "most").collect()}
    for g in "abc":
        parties = [(p, v) for h, p, v, _ in votes if h == g]
        seats = next(s for h, _, _, s in votes if h == g)
        best = sorted(((-v / (2 * k + 1), p) for p, v in parties if v for k in range(v * cap)))[:seats]
        won = collections.Counter(p for _, p in best)
        assert {p: got[g, p] for p, _ in parties} == {p: won[p] for p, _ in parties}


def test_scores(docs, empty):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = [(d, [*words(folded(t)), None]) for d, t in texts()]
    c = collections.Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((d or -1, held(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for d, ws in tokens)
    rows = lm_scoring.score(docs).collect()
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert lm_scoring.score(empty).count() == 0
    only_held = docs.where("doc_id in (" + ",".join(str(d) for d, _ in texts() if held(d)) + ")")
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in lm_scoring.score(only_held).collect())


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(d, q, t) for d, q, t in [(1, 1, 0), (2, 0, 0), (3, 1, 0), (4, None, 0), (14, 0, 0), (24, 0, 1), (None, 1, 0), (99, 1, 1)]],
                                   "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    rows = quality.rate(docs, model).collect()
    assert len(rows) == len(texts())
    for r in rows:
        assert 0 <= r.p_good <= r.p_fair <= 1 and math.isclose(r.expected_grade, r.p_good + r.p_fair)
        assert not (r.selected and r.doc_id in (5, 6, 7))
    assert quality.select_good(docs, model).count() == sum(r.selected for r in rows) and quality.select_good(docs, model).columns == docs.columns
    assert quality.train(docs, labels.limit(0)) is None and quality.select_good(docs, None).count() == sum(bool(words(t)) for _, t in texts())
    assert quality.rate(empty, model).count() == 0 and quality.select_good(empty, model).count() == 0


def test_licenses(spark, docs, empty):
    notices = spark.createDataFrame([(100, "Intro text of a page.\n\nPlease note: Licensed under the Apache License, Version 2.0. Thank you."),
                                     (101, "We were released under pressure by the general public.\nThis work is hard.")], "doc_id long, text string")
    model = licenses.train(docs)
    rows = {(r.doc_id, r.n_paragraphs): r for r in licenses.license_scan(docs.select("doc_id", "text").unionByName(notices), model).collect()}
    assert {k[0]: r.licenses for k, r in rows.items() if r.licenses} == {22: "MIT", 100: "Apache"}
    assert rows[(100, 2)].first_license == 2 and rows[(18, 3)].n_license == 0 and rows[(5, 0)].n_license == 0
    assert licenses.license_scan(empty, model).count() == 0


def test_lines(docs, empty):
    occurrences, links = line_dedup.line_dedup(docs)
    got = {r.doc_id: r for r in line_dedup.per_document(docs, occurrences).collect()}
    assert (got[17].n_lines, got[17].n_removed, got[17].n_linked) == (2, 0, 1)
    assert (got[18].n_lines, got[18].n_removed, got[18].n_linked) == (3, 2, 1)
    assert got[18].lines[0].near_doc_id == 17 and [x.position for x in got[18].lines] == [0, 2, 3]
    assert (got[19].n_lines, got[19].n_removed) == (3, 3) and (got[5].n_lines, got[7].n_lines) == (0, 0)
    kept = {r.doc_id: r.text for r in line_dedup.without_copies(docs, occurrences).collect()}
    assert kept[18] == "\nshort" and kept[5] is None and kept[1] == texts()[0][1]
    assert line_dedup.per_document(docs, occurrences).count() == len(texts())
    occurrences, _ = line_dedup.line_dedup(empty)
    assert line_dedup.per_document(empty, occurrences).count() == 0


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_forest():
    import numpy as np
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = 200
        bucket, x, y = rng.integers(0, 3, n), rng.integers(0, 15, n), rng.integers(0, 15, n)
        keep = x != y
        bucket, x, y, j = bucket[keep], x[keep], y[keep], rng.random(keep.sum())
        take = near_dedup.forest(bucket, x, y, j)
        want, parent = set(), {}  # Kruskal

        def find(v):
            while parent.setdefault(v, v) != v:
                v = parent[v]
            return v

        for i in np.argsort(-j, kind="stable"):
            a, b = find((bucket[i], x[i])), find((bucket[i], y[i]))
            if a != b:
                parent[a] = b
                want.add(i)
        assert set(take.tolist()) == want and len(take) == len(want)


def test_near_copies_that_fall_short(spark, monkeypatch):
    """Pairs under the threshold are confirmed in growing numbers until none that could be a link is left."""
    monkeypatch.setattr(near_dedup, "BLOCK", 6)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(30):
        w = list(base)
        for k in range(3 + i % 2):
            w[(i * 7 + k * 23) % 80] = f"n{i}_{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == components_by_force(rows)


def test_pairs_that_fall_short_do_not_become_rows(spark, monkeypatch):
    """A group of texts that all nearly link: the pairs handed on grow with the members of buckets, not with the pairs of the group."""
    monkeypatch.setattr(near_dedup, "FEW", 1)
    plain, handed = near_dedup.confirmed, []

    def counted(pairs, docs):
        handed.append(pairs.count())
        return plain(pairs, docs)

    monkeypatch.setattr(near_dedup, "confirmed", counted)
    rng = random.Random(5)
    base, rows = [f"w{i}" for i in range(400)], []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(400), 8):
            w[k] = f"n{i}_{k}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[i][1].replace(f"w{i * 9 + 3} ", "", 1)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == components_by_force(rows)
    assert sum(handed) < 6000


def test_joining_a_bucket_in_blocks(spark, monkeypatch):
    """Every pair of a key meets in one bucket of blocks, but for pairs of its most frequent component."""
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    rows = [(1, i, min(i, 12), 10) for i in range(30)] + [(2, i, i, 10) for i in range(4)] + [(3, i, i, 1 << 20) for i in range(4)]
    members = spark.createDataFrame(rows, "key long, rep long, component long, n_shingles long")
    found = collections.defaultdict(list)
    for r in near_dedup.in_blocks(members, "n_shingles").collect():
        found[r.key, r.bucket].append(r)
    met = collections.Counter()
    for (key, _), own in found.items():
        assert len(own) < 30
        for i, x in enumerate(own):
            for y in own[i + 1:]:
                if x.component != y.component and (x.side < 0 or x.side != y.side):
                    met[key, min(x.rep, y.rep), max(x.rep, y.rep)] += 1
    want = {(k, i, j) for k, i, a, _ in rows for q, j, b, _ in rows if k == q and i < j and a != b}
    assert set(met) == want and set(met.values()) == {1}


def test_buckets_meet_sketches_by_class(spark):
    """A class joins its sketch once, not in each of its buckets; buckets that fit a block are not joined with the sizes of larger ones."""
    members = spark.createDataFrame([(k, r, r % 2) for k in range(6) for r in range(k, 9)], "key long, rep long, component long")
    classes = spark.createDataFrame([(r, r + 5, bytes([r])) for r in range(12)], "rep long, n_shingles long, regs binary")
    rows = near_dedup.in_blocks(members)
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = near_dedup.with_sketches(rows, classes)
    assert sorted((r.key, r.rep, r.component, r.bucket, r.side, r.n_shingles, bytes(r.regs)) for r in got.collect()) == sorted(
        (k, r, r % 2, k, -1, r + 5, bytes([r])) for k in range(6) for r in range(k, 9))
    joined = got._jdf.queryExecution().optimizedPlan().toString()
    assert joined.index("Generate") < joined.index("Join")  # above it
