from pyspark.sql import functions as F

from revtrace.operators import pairing, records, review, rollups
from revtrace.sources import tables


def test_tiers_and_mismatch(spark):
    d = spark.createDataFrame([("0.29", "minor"), ("0.3", "medium"), ("0.6", "significant"), ("0.89", "significant"), ("0.9", "major"), ("7", "major"), ("-1", "minor"), ("high", None)], "m string, want string")
    assert d.withColumn("got", review.tier_of(F.col("m"))).filter("NOT (got <=> want)").collect() == []
    m = spark.createDataFrame([("no_change", "major", True), ("major", "minor", True), ("no_change", "medium", False), (None, "major", False), ("minor", None, False)], "a string, f string, want boolean")
    assert m.withColumn("got", review.severity_mismatch(F.col("a"), F.col("f"))).filter("got <> want").collect() == []


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    up = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, t int")
    once = tables.upsert(base, up, ["k"], ["t"])
    twice = tables.upsert(once, up, ["k"], ["t"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a", 1), (2, "d", 2), (3, "e", 1)]


def test_visible_ignores_missing_columns_and_nulls(spark):
    d = spark.createDataFrame([(1, None), (2, "rejected"), (3, "pending")], "i int, review_status string")
    assert sorted(r.i for r in tables.visible(d).collect()) == [1, 3]


def test_dashboard_with_missing_table(spark):
    e = spark.createDataFrame([(1, 0.8, "pending"), (2, 0.2, "approved")], "event_id int, materiality_score double, review_status string")
    r = rollups.dashboard_stats(e, None, None).first()
    assert (r.drift_events_total, r.high_severity_count, r.avg_materiality_score, r.notifications_total, r.review_pending_total) == (2, 1, 0.5, 0, 1)
    assert rollups.dashboard_stats(e.limit(0), None, None).first().avg_materiality_score == 0.0


def test_decisions_keep_the_first_machine_value(spark):
    d = spark.createDataFrame([("x", "superseded", "background", True, "pending", None, None, {"cites": "unclear"}, ["role"])],
                              "id string, cites string, role string, needs_notification boolean, review_status string, reviewer string, review_note string, machine_verdict map<string,string>, corrected_fields array<string>")
    k = spark.createDataFrame([("x", "approved", " ann ", "", {"cites": "current", "role": "model_input"})], "id string, decision string, reviewer string, note string, corrected map<string,string>")
    done, bad = review.decide_citations(d, k)
    r = done.first()
    assert r.machine_verdict == {"cites": "unclear", "role": "background"} and r.corrected_fields == ["cites", "role"]
    assert (r.cites, r.role, r.needs_notification, r.reviewer, r.review_note) == ("current", "model_input", False, "ann", None) and bad.count() == 0


def test_notice_draft_must_hold_both_texts(spark):
    c = spark.createDataFrame([("a", 1, 0, "W1", "indirect", "model_input", "Chen", "We used 5.8 days.", False), ("b", 1, 0, "W2", "superseded", "unknown", None, "5.8 days", True)],
                              "affected_citation_id string, drift_event_id int, claim_diff_idx int, work_id string, cites string, role string, relayed_by string, sentence string, sentence_verified boolean")
    c = c.withColumn("citing_paper_title", F.lit("T")).withColumn("citing_paper_doi", F.lit(None).cast("string")).withColumn("citing_paper_authors", F.array(F.struct(F.lit("Smith, J").alias("name"))))
    diff = F.array(F.struct(F.lit("mean 5.8 days").alias("preprint_text"), F.lit("mean 6.4 days").alias("published_text"), F.lit("changed {new}").alias("change_description")))
    e = spark.createDataFrame([(1, "10.1101/a", "10.1/b", "Li", "s")], "event_id int, preprint_doi string, published_doi string, first_author string, drift_summary string").withColumn("claim_diffs", diff)
    dr = spark.createDataFrame([("a", "S", "Mean 5.8-days became mean 6.4 days!"), ("b", "S", "only mean 5.8 days")], "affected_citation_id string, subject string, body string")
    r = {x.affected_citation_id: x for x in review.render_notices(c, e, dr).collect()}
    assert r["a"].from_draft and not r["b"].from_draft
    assert r["b"].body.startswith("Dear Dr Smith,\n\n") and "What changed: changed {new}\n\nThis" in r["b"].body and "(W2) cites the preprint by Li et al." in r["b"].body
    plain = {x.affected_citation_id: x for x in review.render_notices(c, e).collect()}
    assert "via Chen was revised" in plain["a"].subject and "(as identified automatically):" in plain["a"].body and "model input" in plain["a"].body


def test_first_versions_never_fall_back(spark):
    h = spark.createDataFrame([("a", "1", "new", "x"), ("a", "2", "withdrawn", "x"), ("b", "2", "new", "x"), ("c", "1", "withdrawn", "x"), ("d", "1", "new", None)], "doi string, version string, type string, own_text string")
    h = h.withColumn("title", F.lit("t")).withColumn("authors", F.lit("Li Q, Wu")).withColumn("published", F.lit("10.1/P"))
    own = spark.createDataFrame([("d", "v1", "jats")], "doi string, version string, text_source string")
    r = {x.doi: (x.source_of_v1, x.withdrawn_versions) for x in pairing.first_versions(h, own).collect()}
    assert r == {"a": ("own_text", ["v2"]), "b": (None, []), "c": (None, ["v1"]), "d": ("library", [])}


def test_replies(spark):
    rows = [("1", '```json\n{"k": 1}\n```', 1), ("2", 'Sure: {"k": 2,} bye', 2), ("3", "no json", None), ("4", '{"k": 1', None)]
    d = spark.createDataFrame(rows, "request_id string, text string, want int")
    assert records.parse_replies(d, "k int").filter("NOT (parsed.k <=> want)").collect() == []


def test_coverage_complete(spark):
    s = spark.createDataFrame([(1, 10, 10, False, 5, 0, 2000, [], 0, 2, 3), (2, 9, 4, True, 5, 0, 2000, ["x"], 1, 0, 3)],
                              "run_id int, hit_count int, fetched int, search_truncated boolean, matching int, screen_capped int, screen_limit int, later_truncated array<string>, download_failed int, no_open_full_text int, candidates int")
    u = spark.createDataFrame([(2, "w", False), (2, "v", True)], "run_id int, work_id string, dispatched boolean")
    r = {x.run_id: x for x in rollups.coverage(s, u).collect()}
    assert r[1].coverage_complete and len(r[1].notes) == 1 and not r[2].coverage_complete and len(r[2].notes) == 5 and r[2].judged == 1


def test_notices_are_worded_after_the_join(spark):
    """The notice of each gated citation once; the body is not among what is shuffled, and only what can pass the gate meets log and events."""
    c = spark.createDataFrame([("a", 1, "w1", "superseded", "pending"), ("b", 1, "w2", "current", "pending"), ("c", 1, "w3", "indirect", "rejected"), ("d", 2, "w4", "indirect", None), ("e", 3, "w5", "indirect", None),
                               ("f", 1, "w6", "superseded", None)], "affected_citation_id string, drift_event_id int, work_id string, cites string, review_status string")
    c = c.selectExpr("*", "0 AS claim_diff_idx", "'T' AS citing_paper_title", "'10.1/x' AS citing_paper_doi", "array(named_struct('name', 'Li Q')) AS citing_paper_authors", "'model_input' AS role", "'' AS relayed_by", "'s' AS sentence",
                     "true AS sentence_verified")
    e = spark.createDataFrame([(1, None), (2, "pending"), (3, "rejected")], "event_id int, review_status string").selectExpr(
        "*", "'10.1101/a' AS preprint_doi", "'10.1/p' AS published_doi", "'Fan' AS first_author", "'sum' AS drift_summary", "array(named_struct('preprint_text', 'old', 'published_text', 'new', 'change_description', 'ch')) AS claim_diffs")
    log = spark.createDataFrame([("f",)], "affected_citation_id string")
    n = review.build_notifications(c, e, log, "x@example.org")
    got = {r.affected_citation_id: r for r in n.collect()}
    assert set(got) == {"a", "d"} and got["a"].citing_work_id == "w1" and got["a"].drift_event_id == 1 and got["d"].intended_for.citing_paper_title == "T"
    assert "Dear Dr Li," in got["a"].body and "    old\n" in got["a"].body and "via another paper" in got["d"].subject
    plan = n._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("I am writing on behalf") < plan.index("Join")  # above the joins


def test_large_joins_are_dealt_out(spark):
    """A task gets so many rows, whatever the session's shuffle partitions; small inputs stay as they are."""
    from revtrace.session import dealt
    a, b = spark.range(5000).select((F.col("id") % 700).alias("k")), spark.range(300).select(F.col("id").alias("k"))
    x, y = dealt("k", a, b, rows=100)
    assert x.rdd.getNumPartitions() == y.rdd.getNumPartitions() == 50 and x.join(y, "k", "left_semi").count() == a.join(b, "k", "left_semi").count()
    assert dealt("k", a, b)[0] is a
