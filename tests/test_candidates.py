"""Exact candidates, and the best events of each sentence, against plain comparison."""
import random

import duckdb
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from revtrace.operators import retrieval as rt

NAMES = ["li", "wu", "o'neil", "phone"]
VALUES = ["1 days", "2 days", "1", "2", "50%", "7 cases", "7"]


def tables(spark, n_sentences, n_events, seed, repeats=False):
    rng = random.Random(seed)
    text = lambda: rng.choice(["", f"{rng.choice(['Li', 'Wu', 'iPhone', 'O' + chr(39) + 'Neil', 'nobody'])} et al. "]) + rng.choice(["", f"see 10.1101/{rng.randrange(1, 40)}. "])
    sents = [(i // 2 if repeats else i, text() + "said", rng.sample(VALUES, rng.choice([0, 1, 1, 2, 3]))) for i in range(n_sentences)]
    index = []
    for e in range(n_events):
        author, doi = rng.choice([*NAMES, None]), rng.choice([f"10.1101/{e}", f"10.1101/{e}", None, ""] if e % 9 == 0 else [f"10.1101/{e}"])
        for k in range(2):
            mixed = rng.sample(VALUES, rng.choice([0, 1, 2, 3]))
            old, new, shared = mixed[:1], mixed[1:2], mixed[2:]
            index.append((f"{e % 30 if repeats else e}::{k}", e % 30 if repeats else e, author, doi, f"10.1016/p{e}", old, new, shared))
    s = spark.createDataFrame(sents, "query_id long, sentence string, values array<string>")
    i = spark.createDataFrame(index, "change_id string, event_id long, first_author string, preprint_doi string, published_doi string, old_values array<string>, new_values array<string>, shared_values array<string>")
    return s, i


def plain_pairs(s, i):
    """The three joins on one field each."""
    names = F.transform(F.regexp_extract_all("sentence", F.lit(r"[A-Z][A-Za-z'\-]+"), F.lit(0)), F.lower)
    dois = F.transform(F.regexp_extract_all("sentence", F.lit(r"10\.1101/\d+"), F.lit(0)), F.lower)
    out = set()
    for a, b in ((names, F.array("first_author")), (F.col("values"), F.concat("old_values", "new_values", "shared_values")), (dois, F.array("preprint_doi", "published_doi"))):
        met = s.select("query_id", F.explode(a).alias("k")).join(i.select("change_id", F.explode(b).alias("k")), "k")
        out |= {(r.query_id, r.change_id) for r in met.collect()}
    return out


def test_each_pair_once(spark):
    for repeats in (False, True):
        s, i = tables(spark, 40, 60, 3, repeats)
        got = [(r.query_id, r.change_id) for r in rt.exact_candidates(s, i).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_pairs(s, i)


def test_each_pair_once_in_small_blocks(spark, monkeypatch):
    """Blocks of three ids, met by broadcast and by shuffle."""
    s, i = tables(spark, 40, 60, 3, repeats=True)
    want = plain_pairs(s, i)
    for limit in (rt.BROADCAST_BYTES, 0):
        monkeypatch.setattr(rt, "BROADCAST_BYTES", limit)
        got = [(r.query_id, r.change_id) for r in rt.exact_candidates(s, i, block=3).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_pairs_of_a_common_field_meet_in_blocks(spark, monkeypatch):
    """400 sentences and 800 changes share a value: all 320,000 pairs come out of some hundred join rows in several tasks."""
    rows, real = [], rt._streamed

    def counted(df):
        rows.append(df.count())
        return real(df)

    monkeypatch.setattr(rt, "_streamed", counted)
    text = lambda v: F.array(F.lit(v)).cast("array<string>")
    none, of = F.array().cast("array<string>"), F.lit(None).cast("string")
    s = spark.range(400).select(F.col("id").alias("query_id"), F.lit("said").alias("sentence"), text("1 days").alias("values"))
    i = spark.range(800).select(F.concat("id", F.lit("::0")).alias("change_id"), of.alias("first_author"), of.alias("preprint_doi"), of.alias("published_doi"),
                                text("1 days").alias("old_values"), none.alias("new_values"), none.alias("shared_values"))
    got = rt.exact_candidates(s, i, block=50)
    by_task = got.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in by_task) == 320_000 and len(by_task) > 4 and rows[0] <= 400


def best(pairs, s, i, seen):
    """Best events of all pairs, as the windows of `candidates` order them."""
    p = rt.hints(pairs.join(i, "change_id").join(s, "query_id")).filter(F.size("hints") > 0)
    rows = p.select("query_id", "event_id", "change_id", (F.array_contains("hints", "author") | F.array_contains("hints", "doi")).alias("a"), "n_values").collect()
    by_event: dict = {}
    for r in rows:
        if (r.query_id, r.event_id) not in seen:
            key = (not r.a, -r.n_values, r.change_id)
            by_event[r.query_id, r.event_id] = min(key, by_event.get((r.query_id, r.event_id), key))
    out: dict = {}
    for (q, e), key in by_event.items():
        out.setdefault(q, []).append((*key[:2], e, key[2]))
    return {q: [(e, c) for _, _, e, c in sorted(v)[:rt.MAX_EXACT]] for q, v in out.items()}


def test_best_events_of_a_sentence(spark):
    for seed, repeats in ((1, False), (5, True)):
        s, i = tables(spark, 60, 150, seed, repeats)
        s, i = s.cache(), i.cache()
        ranks = {q: list(range(q % 7, 25, 3)) for q in range(0, 30, 2)}
        seen = {(q, e) for q, es in ranks.items() for e in es[:rt.TOP_EVENTS]}
        want = best(rt.exact_candidates(s, i), s, i, seen)
        ranked = spark.createDataFrame([(q, f"{e}::0", r, 0.0) for q, es in ranks.items() for r, e in enumerate(es, 1)], "query_id long, change_id string, fused_rank int, rrf double")
        got: dict = {}
        for r in rt.candidates(s, i, ranked).filter("retrieval_rank IS NULL").orderBy("candidate_no").collect():
            got.setdefault(r.query_id, []).append((r.event_id, r.change_id))
        assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in want.items()}


def test_a_common_value_is_not_joined_pair_by_pair(spark):
    """400 sentences and 800 changes share a value and a name: a few changes a sentence are left, not all 320,000 pairs."""
    s = spark.range(400).select(F.col("id").alias("query_id"), F.lit("Li said").alias("sentence"), F.array(F.lit("1 days")).alias("values"))
    text = lambda v: F.array(F.lit(v)).cast("array<string>")
    none = F.array().cast("array<string>")
    i = spark.range(800).select(F.concat("id", F.lit("::0")).alias("change_id"), F.col("id").alias("event_id"), F.lit("li").alias("first_author"), F.concat(F.lit("10.1101/"), "id").alias("preprint_doi"),
                                F.lit(None).cast("string").alias("published_doi"), text("1 days").alias("old_values"), none.alias("new_values"), none.alias("shared_values"))
    room = spark.createDataFrame([], "query_id long, room long")
    got = rt.leading_candidates(s, i, room)
    assert {r["count"] for r in got.groupBy("query_id").count().collect()} == {rt.MAX_EXACT}


def test_query_asks_every_sentence(spark, tmp_path):
    """Ids that are not divisible by 50 are asked too; the rows are those of the SQL."""
    docs = spark.range(1, 120).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries()["exact_candidates"](spark, str(tmp_path)).select("query_id", "change_id").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(got) == sorted(con.execute(oracle_sql()["exact_candidates"]).fetchall())
    assert {q for q, _ in got} >= {q for q in range(1, 120) if q % 4 == 0 or q % 4 == 2 or q % 4 == 1 and q % 41}
