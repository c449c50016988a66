"""Near-duplicate lines against the edit distance of all pairs of lines."""
import random

import pytest

from revtrace.llm import line_dedup

SCHEMA = "doc_id long, text string, position int, id long"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def edits(n):
    return 0 if n < 8 else 1 if n < 20 else 2


def plain(rows):
    """By row number: the cleaned text."""
    spots, lines = [], {}
    for r, (doc, text) in enumerate(rows):
        for p, line in enumerate((text or "").split("\n")):
            if line := line.strip(" \t\n\x0b\x0c\r"):
                spots.append(((doc is None, doc or 0, r, p), line))
    for place, line in sorted(spots):
        lines.setdefault(line, place)
    near = {x: [y for y in lines if y != x and distance(x, y) <= edits(min(len(x), len(y)))] for x in lines}
    stay = {lines[x] for x in lines if all(lines[x] < lines[y] for y in near[x])}
    out = []
    for r, (doc, text) in enumerate(rows):
        gone = {place[3] for place, _ in spots if place[2] == r and place not in stay}
        out.append((doc, None if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if p not in gone)))
    return out, {(min(x, y), max(x, y)) for x in near for y in near[x]}


def mutated(rng, line, times):
    s = list(line)
    for _ in range(times):
        at = rng.randrange(len(s) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            s.insert(at, rng.choice("aeé漢 z"))
        elif s and kind == 1:
            del s[min(at, len(s) - 1)]
        elif s:
            s[min(at, len(s) - 1)] = rng.choice("xoß字")
    return "".join(s)


@pytest.mark.parametrize("heavy", [200, 2])
def test_links_equal_all_pairs(spark, monkeypatch, heavy):
    monkeypatch.setattr(line_dedup, "HEAVY", heavy)
    rng = random.Random(heavy)
    base = ["".join(rng.choice("aeinorst lduhéß漢字") for _ in range(n)) for n in (3, 6, 7, 8, 9, 12, 17, 18, 19, 20, 21, 22, 30, 45, 70)]
    base += ["Share this article", "the same beginning of a line and " + "q" * 20, "x" * 40]
    texts = [x for x in base] + [mutated(rng, x, k) for x in base for k in (0, 1, 1, 2, 2, 3, 4)] + ["Share this article!", "the same beginning of a line and " + "r" * 20]
    rows = [(i, "\n".join(rng.sample(texts, 5))) for i in range(60)] + [(100 + i, x) for i, x in enumerate(texts)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], SCHEMA)
    occurrences, links = line_dedup.line_dedup(docs)
    want, pairs = plain(rows)
    lines = {r.id: r.line for r in line_dedup.lines(docs).selectExpr("xxhash64(line) AS id", "line").distinct().collect()}
    assert {tuple(sorted((lines[r.a], lines[r.b]))) for r in links.collect()} == pairs and len(pairs) > 50
    assert sorted((r.doc_id, r.text) for r in line_dedup.without_copies(docs, occurrences).collect()) == sorted(want)


def test_repeated_ids_lose_their_own_lines_only(spark):
    rows = [(1, "A line that stands in two places.\nfirst"), (2, "A line that stands in two places.\nSome words"), (2, "Precious line that stands nowhere else\nother things"),
            (3, "twice the same row\n\n and more"), (3, "twice the same row\n\n and more"), (None, "first"), (None, None)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], SCHEMA)
    occurrences, _ = line_dedup.line_dedup(docs)
    got = sorted((r.text for r in line_dedup.without_copies(docs, occurrences).collect()), key=str)
    assert got == sorted(["A line that stands in two places.\nfirst", "Some words", "Precious line that stands nowhere else\nother things",
                          "twice the same row\n\n and more", "", "", None], key=str)
    rows = {(r.n_lines, r.n_removed) for r in line_dedup.per_document(docs, occurrences).where("doc_id = 2").collect()}
    assert rows == {(2, 1), (2, 0)}


def test_probes_are_few_small_expressions_and_ask_for_all_segments(spark):
    """Of lines around the limits, in one and in more bytes a character; a long expression in a lambda took a third of the whole job."""
    rows = [("abcdefghij klmnopqrstuvwxyz 0123456789" * 2)[:n] for n in (3, 7, 8, 9, 10, 19, 20, 21, 22, 23, 45)]
    rows += [x.replace("b", "é").replace("f", "漢") for x in rows]
    found = line_dedup.asked_keys(spark.createDataFrame([(x, len(x)) for x in rows], "line string, n int"), "line")
    want = []
    for x in rows:
        for shorter in range(edits(len(x)) + 1):
            n = len(x) - shorter
            e = edits(n)
            if shorter <= e:
                at, sizes = 0, [n // (e + 1) + (i >= e + 1 - n % (e + 1)) for i in range(e + 1)]
                for i, size in enumerate(sizes if e else ()):
                    places = {at + off for off in range(max(-i, shorter - (e - i)), min(i, shorter + e - i) + 1)}
                    want += [(x, n, i, x[p:p + size]) for p in places if 0 <= p and p + size <= len(x)]
                    at += size
    keys = spark.createDataFrame(want, "line string, n int, i int, part string").selectExpr("line", "xxhash64(n, i, part) AS key")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, keys.collect())) and len(want) > 100
    assert "lambda" not in found._jdf.queryExecution().toString()


def test_a_group_of_near_lines_makes_no_row_for_each_pair(spark, monkeypatch):
    """120 lines within two edits of each other have 7,140 links; lines that differ in the middle meet under two segments."""
    tables, plain_written = [], line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name, *rest: tables.append((name, plain_written(df, name, *rest))) or tables[-1][1])
    rows = [(i, f"Page {i:03d} of the same report, read it on the next screen") for i in range(0, 100)]
    rows += [(100 + i, f"Page {i:03d} of the same reports, read it on the next screen"[:60]) for i in range(0, 200, 10)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], SCHEMA)
    occurrences, links = line_dedup.line_dedup(docs)
    texts = [t for _, t in rows]
    near = {d: [e for e, u in rows if e != d and distance(t, u) <= 2] for d, t in rows}
    got = {r.doc_id: (r.links, r.near_doc_id, r.kept) for r in occurrences.collect()}
    assert got == {d: (len(v), min(v, default=None), all(e > d for e in v)) for d, v in near.items()} and len(set(texts)) == 120
    assert links.count() == sum(map(len, near.values())) / 2 > 4000
    assert all(t.count() < 3000 for _, t in tables), [(n, t.count()) for n, t in tables]
