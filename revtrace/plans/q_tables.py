"""Queries of table operations, pairing, review, roll-ups and scoring."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import pairing, records, review, rollups
from ..sources import tables
from .book import Book
from .q_text import KEY, OLD_TERMS, RAW
from .views import AUTHOR, load, view, with_views

Q = Book()
VISIBLE = ("(suspected_false_positive IS DISTINCT FROM true) AND (review_status IS DISTINCT FROM 'rejected') "
           "AND (record_source IS DISTINCT FROM 'demo_seed')")
SHOWN = "(review_status IS DISTINCT FROM 'rejected') AND (record_source IS DISTINCT FROM 'demo_seed')"
ELIGIBLE = "published_doi IS NOT NULL AND is_final_preprint AND version <> 'published' AND record_source IS DISTINCT FROM 'demo_seed'"
LIT_TIERS = "['minor', 'medium', 'significant', 'major']"


def _l(*cols):
    return [F.col(c).cast("long").alias(c) for c in cols]


# ---- tables ------------------------------------------------------------------------------------------------------------
@Q.add("keyed_upsert", """SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id""")
def keyed_upsert(spark, sf):
    e = load(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    base = e.filter("event_type = 'signup'").dropDuplicates(["user_id"]).withColumn("ts", F.lit("1970-01-01").cast("timestamp_ntz"))
    return tables.upsert(base, e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@Q.add("partial_update", """SELECT o_orderkey, CASE WHEN n.c >= 5 THEN 'busy' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN n.c >= 5 THEN n.c END AS n_lines, o_totalprice
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1) n ON n.l_orderkey = o_orderkey""")
def partial_update(spark, sf):
    busy = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines")).filter("n_lines >= 5")
    patch = busy.select("o_orderkey", F.lit("busy").alias("o_orderstatus"), "n_lines")
    return tables.update_where(load(spark, sf, "orders"), patch, ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "n_lines", "o_totalprice")


@Q.add("pair_backfill", with_views("preprints") + """ SELECT row_no, CASE WHEN published_doi IS NULL THEN concat('10.1038/', substr(doi, 9)) ELSE published_doi END AS published_doi,
  CASE WHEN published_doi IS NULL THEN true ELSE is_final_preprint END AS is_final_preprint,
  CASE WHEN published_doi IS NULL THEN TIMESTAMP '2030-01-01' ELSE ingested_at END AS ingested_at FROM preprints""")
def pair_backfill(spark, sf):
    p = view(spark, sf, "preprints")
    found = p.filter("published_doi IS NULL").select("doi", F.concat(F.lit("10.1038/"), F.substring("doi", 9, 99)).alias("published_doi")).distinct()
    out = tables.pair_found(p, found, F.lit("2030-01-01").cast("timestamp_ntz"))
    return out.select("row_no", "published_doi", "is_final_preprint", "ingested_at")


@Q.add("delete_by_key", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_by_key(spark, sf):
    gone = load(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return tables.delete_keys(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), gone, ["l_orderkey"])


@Q.add("copy_with_counts", """SELECT 'documents' AS table_name, count(*) AS source_rows, count(*) AS target_rows FROM documents
  UNION ALL SELECT 'orders', count(*), count(*) FROM orders UNION ALL SELECT 'events', count(*), count(*) FROM events""")
def copy_with_counts(spark, sf):
    import os
    import uuid

    from ..session import checkpoint_dir
    dst = os.path.join(checkpoint_dir(spark), f"copy-{uuid.uuid4().hex}")
    out = None
    for t, k in (("documents", "doc_id"), ("orders", "o_orderkey"), ("events", "event_id")):
        one = tables.copy_tables(spark, sf, dst, [f"{t}.parquet"], {f"{t}.parquet": [k]}).withColumn("table_name", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out


CURSOR = ("2024-01-10 00:00:00", "")


@Q.add("keyset_page", f"""SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '{CURSOR[0]}' OR (ts = TIMESTAMP '{CURSOR[0]}' AND event_id > -1) ORDER BY ts, event_id LIMIT 500""")
def keyset_page(spark, sf):
    import datetime as dt
    return tables.keyset_page(load(spark, sf, "events"), (dt.datetime(2024, 1, 10), -1), 500, ("ts", "event_id")).select("event_id", "ts")


@Q.add("contract_projection", """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(NULL AS VARCHAR) AS note FROM events""")
def contract_projection(spark, sf):
    return tables.project_contract(load(spark, sf, "events"), "props", "k int, note string", ["event_id"])


@Q.add("schema_audit", """SELECT event_type AS table_name, 'k' AS key, CASE WHEN event_type = 'view' THEN 'only_in_data' ELSE 'ok' END AS status, event_type = 'view' AS is_error
  FROM events GROUP BY event_type UNION ALL SELECT DISTINCT event_type, 'note', 'only_in_contract', event_type = 'error' FROM events""")
def schema_audit(spark, sf):
    e = load(spark, sf, "events").select(F.col("event_type").alias("table_name"), F.col("props").alias("doc"))
    names = e.select("table_name").distinct()
    contract = names.select("table_name", F.explode(F.array(F.lit("k"), F.lit("note"))).alias("key")).filter("NOT (table_name = 'view' AND key = 'k')")
    return tables.audit_schema(contract.withColumn("required", F.expr("key = 'note' AND table_name = 'error'")), e)


# ---- labels and rules ----------------------------------------------------------------------------------------------------
@Q.add("severity_tiers", f"SELECT l_orderkey, l_linenumber, l_partkey, {LIT_TIERS}[CASE WHEN l_discount * 10 >= 0.9 THEN 4 WHEN l_discount * 10 >= 0.6 THEN 3 WHEN l_discount * 10 >= 0.3 THEN 2 ELSE 1 END] AS tier FROM lineitem")
def severity_tiers(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", review.tier_of(F.col("l_discount") * 10).alias("tier"))


RULES = """CASE {k} % 3 WHEN 0 THEN 'method_change' WHEN 1 THEN 'made_up' ELSE NULL END"""


@Q.add("label_validation", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE {LIT_TIERS}[CASE WHEN o_totalprice / 600000.0 >= 0.9 THEN 4 WHEN o_totalprice / 600000.0 >= 0.6 THEN 3
   WHEN o_totalprice / 600000.0 >= 0.3 THEN 2 ELSE 1 END] END AS severity_tier, CAST(o_orderkey % 2 AS BIGINT) AS n_evidence,
  concat_ws('|', CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'root_cause ''made_up'' not in the closed set' ELSE 'root_cause None not in the closed set' END,
   CASE WHEN o_orderkey % 4 = 0 THEN 'diff_type ''odd'' not in the closed set' END) AS problems FROM orders""")
def label_validation(spark, sf):
    k = F.col("o_orderkey")
    d = load(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 5 == 0, "high").otherwise((F.col("o_totalprice") / 600000.0).cast("string")).alias("materiality"),
        F.expr(RULES.replace("{k}", "o_orderkey")).alias("root_cause"), F.when(k % 4 == 0, "odd").otherwise("numerical_shift").alias("diff_type"),
        F.array(F.struct(F.lit("published").alias("doc_id"), F.lit("s").alias("section"), F.when(k % 2 == 1, "q").otherwise("").alias("quote"))).alias("evidence"))
    v = review.validate_labels(d)
    return v.select("o_orderkey", "severity_tier", F.size("evidence").cast("long").alias("n_evidence"), F.array_join("label_problems", "|").alias("problems"))


@Q.add("verdict_validation", with_views("affected_citations") + """ SELECT affected_citation_id, CASE WHEN cites = 'not_relying' THEN 'unclear' ELSE cites END AS cites,
  CASE WHEN role = 'background' THEN 'unknown' ELSE role END AS role, CASE WHEN cites = 'not_relying' THEN 'invalid class ''relies''' END AS label_problem FROM affected_citations""")
def verdict_validation(spark, sf):
    c = view(spark, sf, "affected_citations").select(
        "affected_citation_id", F.expr("CASE WHEN cites = 'not_relying' THEN 'relies' ELSE cites END").alias("cites"),
        F.expr("CASE WHEN role = 'background' THEN NULL ELSE role END").alias("role"))
    return review.validate_verdicts(c)


@Q.add("severity_mismatch", with_views("drift_events") + """ SELECT event_id, coalesce((abstract_class = 'no_change' AND fulltext_tier IN ('significant', 'major'))
  OR (abstract_class = 'major' AND fulltext_tier = 'minor'), false) AS mismatch FROM drift_events""")
def severity_mismatch(spark, sf):
    return view(spark, sf, "drift_events").select("event_id", review.severity_mismatch(F.col("abstract_class"), F.col("fulltext_tier")).alias("mismatch"))


@Q.add("notification_priority", with_views("affected_citations") + """ SELECT affected_citation_id, CASE WHEN cites = 'superseded' AND role = 'model_input' THEN 'high'
  WHEN cites = 'superseded' THEN 'normal' WHEN cites = 'indirect' THEN 'low' END AS priority, cites IN ('superseded', 'indirect') AS needs,
  CASE WHEN source IS NULL THEN 'prefetch' ELSE split_part(source, ':', 1) END AS via FROM affected_citations""")
def notification_priority(spark, sf):
    return view(spark, sf, "affected_citations").select(
        "affected_citation_id", review.notify_priority(F.col("cites"), F.col("role")).alias("priority"),
        review.needs_notification(F.col("cites")).alias("needs"), review.found_via(F.col("source")).alias("via"))


@Q.add("visible_rows", with_views("drift_events") + f" SELECT event_id, materiality_score FROM drift_events WHERE {VISIBLE}")
def visible_rows(spark, sf):
    return tables.visible(view(spark, sf, "drift_events")).select("event_id", "materiality_score")


@Q.add("eligible_pairs", with_views("preprints") + f" SELECT row_no, doi, published_doi FROM preprints WHERE {ELIGIBLE}")
def eligible_pairs(spark, sf):
    return pairing.eligible_pairs(view(spark, sf, "preprints")).select("row_no", "doi", "published_doi")


@Q.add("numeric_deltas", """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity - l_extendedprice AS absolute_delta, round((l_quantity - l_extendedprice) / l_extendedprice, 3) AS relative_delta FROM lineitem""")
def numeric_deltas(spark, sf):
    d = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("preprint_value"), F.col("l_quantity").alias("published_value"))
    return records.numeric_delta(d).select("l_orderkey", "l_linenumber", "l_partkey", "absolute_delta", "relative_delta")


@Q.add("recent_events", with_views("drift_events") + f""", v AS (SELECT * FROM drift_events WHERE {VISIBLE})
  SELECT event_id, detected_at, (SELECT count(*) FROM v) AS total FROM v ORDER BY detected_at DESC NULLS LAST, event_id LIMIT 100""")
def recent_events(spark, sf):
    return review.recent_events(view(spark, sf, "drift_events")).select("event_id", "detected_at", "total")


PRIORITY_SQL = "CASE WHEN cites = 'superseded' AND role = 'model_input' THEN 'high' WHEN cites = 'superseded' THEN 'normal' WHEN cites = 'indirect' THEN 'low' END"


@Q.add("review_queue", with_views("drift_events", "affected_citations") + f""", e AS (SELECT * FROM drift_events WHERE review_status = 'pending' ),
  c AS (SELECT *, {PRIORITY_SQL} AS p FROM affected_citations WHERE review_status = 'pending' )
  SELECT 'event' AS kind, CAST(event_id AS VARCHAR) AS id FROM e UNION ALL SELECT 'citation', affected_citation_id FROM c""")
def review_queue(spark, sf):
    c = view(spark, sf, "affected_citations").withColumn("notify_priority", review.notify_priority(F.col("cites"), F.col("role")))
    e, c = review.review_queue(view(spark, sf, "drift_events"), c, "pending")
    return e.select(F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("id")).unionByName(
        c.select(F.lit("citation").alias("kind"), F.col("affected_citation_id").alias("id")))


@Q.add("dashboard_stats", with_views("drift_events", "affected_citations", "notification_log") + f""", e AS (SELECT * FROM drift_events WHERE {VISIBLE}),
  c AS (SELECT * FROM affected_citations WHERE {SHOWN}), n AS (SELECT * FROM notification_log WHERE record_source IS DISTINCT FROM 'demo_seed')
  SELECT (SELECT count(*) FROM e) AS drift_events_total, (SELECT count(*) FROM e WHERE materiality_score >= 0.7) AS high_severity_count,
   (SELECT coalesce(avg(materiality_score), 0.0) FROM e) AS avg_materiality_score, (SELECT count(*) FROM c) AS affected_citations_total,
   (SELECT count(*) FROM n) AS notifications_total, (SELECT count(*) FROM n WHERE status = 'sent') AS notifications_sent,
   (SELECT count(*) FROM e WHERE review_status = 'pending') + (SELECT count(*) FROM c WHERE review_status = 'pending') AS review_pending_total,
   (SELECT count(*) FROM e WHERE review_status = 'approved') + (SELECT count(*) FROM c WHERE review_status = 'approved') AS human_confirmed_total,
   (SELECT count(*) FROM c WHERE cites = 'superseded') AS superseded_citations_total""".replace("avg(materiality_score), 0.0)", "round(avg(materiality_score), 9), 0.0)"))
def dashboard_stats(spark, sf):
    d = rollups.dashboard_stats(view(spark, sf, "drift_events"), view(spark, sf, "affected_citations"), view(spark, sf, "notification_log"))
    return d.withColumn("avg_materiality_score", F.round("avg_materiality_score", 9))


# ---- pairing -----------------------------------------------------------------------------------------------------------
@Q.add("first_versions", with_views("preprints") + """, f AS (SELECT *, CAST(substr(version, 2) AS BIGINT) AS n FROM preprints),
  g AS (SELECT doi, arg_min(type, n) AS t1, arg_min(text_source, n) AS s1, string_agg(version, '|' ORDER BY n) AS versions, count(*) FILTER (WHERE type = 'withdrawn') AS n_withdrawn FROM f GROUP BY doi)
  SELECT doi, CASE WHEN s1 = 'jats' THEN 'library' WHEN t1 <> 'withdrawn' THEN 'own_text' END AS source_of_v1, versions, n_withdrawn FROM g""")
def first_versions(spark, sf):
    p = view(spark, sf, "preprints")
    h = p.select("doi", "version", "type", F.lit("t").alias("title"), F.lit("Li Q, Wu J").alias("authors"), F.col("published_doi").alias("published"), F.lit("abstract").alias("own_text"))
    out = pairing.first_versions(h, p.select("doi", "version", "text_source"))
    return out.select("doi", "source_of_v1", F.array_join("versions", "|").alias("versions"), F.size("withdrawn_versions").cast("long").alias("n_withdrawn"))


@Q.add("pair_published", with_views("preprints") + """, c AS (SELECT DISTINCT doi, source FROM preprints WHERE published_doi IS NULL)
  SELECT 'pair' AS part, doi, concat('10.1038/', substr(doi, 9)) AS published_doi, source FROM c WHERE CAST(substr(doi, 9) AS BIGINT) % 2 = 0
  UNION ALL SELECT 'published', concat('10.1038/', substr(doi, 9)), concat('10.1038/', substr(doi, 9)), source FROM c WHERE CAST(substr(doi, 9) AS BIGINT) % 2 = 0
  UNION ALL SELECT 'no match', doi, NULL, NULL FROM c WHERE CAST(substr(doi, 9) AS BIGINT) % 2 = 1""")
def pair_published(spark, sf):
    c = view(spark, sf, "preprints").filter("published_doi IS NULL").select("doi", "source").distinct()
    n = F.substring("doi", 9, 99)
    cross = c.select("doi", F.when(n.cast("long") % 2 == 0, F.concat(F.lit("10.1038/"), n)).alias("published_doi"), F.lit("A title").alias("title"),
                     F.lit(None).cast("string").alias("abstract"), F.array(F.lit("A B")).alias("authors"), F.lit("2020-01-02").alias("published_date"))
    pairs, published, missing = pairing.pair_published(c, cross)
    none = F.lit(None).cast("string")
    return (pairs.select(F.lit("pair").alias("part"), F.col("preprint_doi").alias("doi"), "published_doi", F.col("preprint_source").alias("source"))
            .unionByName(published.select(F.lit("published").alias("part"), "doi", "published_doi", "source"))
            .unionByName(missing.select(F.lit("no match").alias("part"), "doi", none.alias("published_doi"), none.alias("source"))))


@Q.add("unpaired_candidates", with_views("preprints") + """ SELECT doi, version, ingested_at FROM preprints WHERE published_doi IS NULL AND record_source IS DISTINCT FROM 'demo_seed'
  AND source = 'medrxiv' ORDER BY ingested_at ASC NULLS LAST, doi, version LIMIT 25""")
def unpaired_candidates(spark, sf):
    return pairing.unpaired(view(spark, sf, "preprints"), "medrxiv", 25).select("doi", "version", "ingested_at")


EVENTS_OF_PAIRS = "SELECT concat('10.1101/', c_custkey) AS preprint_doi, concat('10.1016/P', c_custkey) AS published_doi FROM customer WHERE c_mktsegment <> 'BUILDING'"


@Q.add("pending_pairs", with_views("preprints") + f""", done AS ({EVENTS_OF_PAIRS})
  SELECT row_no, doi FROM preprints p WHERE {ELIGIBLE} AND NOT EXISTS (SELECT 1 FROM done d WHERE lower(d.preprint_doi) = lower(p.doi) AND lower(d.published_doi) = lower(p.published_doi))""")
def pending_pairs(spark, sf):
    load(spark, sf, "customer").createOrReplaceTempView("customer")
    return pairing.pending_pairs(view(spark, sf, "preprints"), spark.sql(EVENTS_OF_PAIRS)).select("row_no", "doi")


@Q.add("watermark_rewind", with_views("preprints") + f""", done AS ({EVENTS_OF_PAIRS}), o AS (SELECT min(ingested_at) AS t FROM preprints p WHERE {ELIGIBLE}
    AND NOT EXISTS (SELECT 1 FROM done d WHERE lower(d.preprint_doi) = lower(p.doi) AND lower(d.published_doi) = lower(p.published_doi)))
  SELECT least(TIMESTAMP '1999-01-01', t - INTERVAL 1 SECOND) AS watermark, t - INTERVAL 1 SECOND < TIMESTAMP '1999-01-01' AS changed FROM o""")
def watermark_rewind(spark, sf):
    from ..streaming.dispatch import rewind
    load(spark, sf, "customer").createOrReplaceTempView("customer")
    return rewind(view(spark, sf, "preprints"), spark.sql(EVENTS_OF_PAIRS), F.lit("1999-01-01").cast("timestamp_ntz")).select("watermark", "changed")


@Q.add("dispatch_tick", with_views("preprints") + f""" SELECT doi, row_no, ingested_at FROM preprints WHERE {ELIGIBLE} AND ingested_at > TIMESTAMP '1996-01-01' ORDER BY ingested_at, doi, row_no LIMIT 20""")
def dispatch_tick(spark, sf):
    from ..streaming.dispatch import dispatch_tick as tick
    return tick(view(spark, sf, "preprints"), F.lit("1996-01-01").cast("timestamp_ntz"), 20, ["doi", "row_no"]).select("doi", "row_no", "ingested_at")


@Q.add("analysability", with_views("preprints") + """, h AS (SELECT doi, arg_min(type, CAST(substr(version, 2) AS BIGINT)) AS t1, any_value(published_doi) AS pub FROM preprints GROUP BY doi),
  asked AS (SELECT concat('10.1101/', c_custkey) AS doi, c_custkey FROM customer)
  SELECT a.doi, CASE WHEN h.doi IS NULL THEN 'doi_not_found' WHEN t1 = 'withdrawn' THEN 'v1_unavailable' WHEN pub IS NULL THEN 'not_published_yet'
   WHEN c_custkey % 4 = 0 THEN 'no_open_full_text' ELSE 'ready' END AS status FROM asked a LEFT JOIN h ON h.doi = a.doi""")
def analysability(spark, sf):
    p = view(spark, sf, "preprints")
    c = load(spark, sf, "customer")
    dois = c.select(F.concat(F.lit("10.1101/"), "c_custkey").alias("doi"))
    ft = c.select(F.concat(F.lit("10.1016/P"), "c_custkey").alias("doi"), F.when(F.col("c_custkey") % 4 != 0, F.lit("PMC1")).alias("pmcid"))
    return pairing.analysability(dois, p.select("doi", "version", "type", F.col("published_doi").alias("published")), ft).select("doi", "status")


@Q.add("event_bundles", with_views("drift_events", "affected_citations", "notification_log", "citation_runs") + """, n1 AS (SELECT drift_event_id, count(*) AS c FROM affected_citations GROUP BY 1),
  n2 AS (SELECT drift_event_id, count(*) AS c FROM notification_log GROUP BY 1), n3 AS (SELECT drift_event_id, count(*) AS c FROM citation_runs GROUP BY 1)
  SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat('claim ', event_id, '|claim ', event_id + 1) ELSE concat('claim ', event_id) END AS claims, coalesce(n1.c, 0) AS n_citations,
   coalesce(n2.c, 0) AS n_notices, coalesce(n3.c, 0) AS n_runs FROM drift_events e LEFT JOIN n1 ON n1.drift_event_id = event_id LEFT JOIN n2 ON n2.drift_event_id = event_id
   LEFT JOIN n3 ON n3.drift_event_id = event_id""")
def event_bundles(spark, sf):
    e = view(spark, sf, "drift_events")
    nxt = F.when(F.col("event_id") % 2 == 0, F.lpad((F.col("event_id") + 1).cast("string"), 12, "0"))
    ev_ = e.select("event_id", F.array(F.struct(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("preprint_claim_id"), nxt.alias("published_claim_id"))).alias("claim_diffs"))
    ids = ev_.select(F.explode(F.array_compact(F.array("claim_diffs.preprint_claim_id", "claim_diffs.published_claim_id"))).alias("a")).select(F.explode("a").alias("claim_id")).filter("claim_id IS NOT NULL").distinct()
    claims = ids.select("claim_id", F.concat(F.lit("claim "), F.col("claim_id").cast("long")).alias("text"))
    b = pairing.event_bundle(ev_, claims, view(spark, sf, "affected_citations"), view(spark, sf, "notification_log"), view(spark, sf, "citation_runs"))
    return b.select("event_id", F.array_join(F.transform("claims", lambda x: x["text"]), "|").alias("claims"), "n_citations", "n_notices", "n_runs")


@Q.add("event_drill_down", with_views("drift_events", "affected_citations", "notification_log", "citation_runs") + f""", v AS (SELECT event_id FROM drift_events WHERE {VISIBLE})
  SELECT drift_event_id AS event_id, 'citation' AS part, affected_citation_id AS id, cites AS state FROM affected_citations WHERE coalesce(review_status, '') <> 'rejected' AND coalesce(record_source, '') <> 'demo_seed' AND drift_event_id IN (SELECT event_id FROM v)
  UNION ALL SELECT drift_event_id, 'notice', affected_citation_id, status FROM notification_log WHERE coalesce(record_source, '') <> 'demo_seed' AND drift_event_id IN (SELECT event_id FROM v)
  UNION ALL SELECT drift_event_id, 'run', CAST(run_id AS VARCHAR), status FROM citation_runs WHERE drift_event_id IN (SELECT event_id FROM v)""")
def event_drill_down(spark, sf):
    c, n, r = pairing.event_parts(view(spark, sf, "drift_events"), view(spark, sf, "affected_citations"), view(spark, sf, "notification_log"), view(spark, sf, "citation_runs"))
    part = lambda df, name, key, state: df.select(F.col("drift_event_id").alias("event_id"), F.lit(name).alias("part"), F.col(key).cast("string").alias("id"), F.col(state).alias("state"))
    return part(c, "citation", "affected_citation_id", "cites").unionByName(part(n, "notice", "affected_citation_id", "status")).unionByName(part(r, "run", "run_id", "status"))


@Q.add("pending_notifications", with_views("drift_events", "affected_citations", "notification_log") + """ SELECT affected_citation_id,
  CASE WHEN cites NOT IN ('superseded', 'indirect') THEN 'class is not notified' WHEN c.review_status = 'rejected' THEN 'citation rejected' WHEN e.event_id IS NULL THEN 'event not found'
   WHEN e.review_status = 'rejected' THEN 'event rejected' END AS gate_reason FROM affected_citations c LEFT JOIN drift_events e ON e.event_id = c.drift_event_id
  WHERE affected_citation_id NOT IN (SELECT affected_citation_id FROM notification_log)""")
def pending_notifications(spark, sf):
    return review.pending_notifications(view(spark, sf, "affected_citations"), view(spark, sf, "drift_events"), view(spark, sf, "notification_log")).select("affected_citation_id", "gate_reason")


@Q.add("human_decisions_kept", with_views("affected_citations") + """ SELECT affected_citation_id, drift_event_id FROM affected_citations
  WHERE affected_citation_id NOT IN (SELECT affected_citation_id FROM affected_citations WHERE review_status IN ('approved', 'rejected'))""")
def human_decisions_kept(spark, sf):
    c = view(spark, sf, "affected_citations")
    return review.keep_human(c, c).select("affected_citation_id", "drift_event_id")


@Q.add("rerun_due", with_views("citation_runs") + """, r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY queued_at DESC, run_id DESC) AS rn FROM citation_runs WHERE status IN ('done', 'queued', 'running'))
  SELECT target_id, run_id, checked_until AS since FROM r WHERE rn = 1 AND status = 'done' AND checked_until <= DATE '2000-01-31' - 7""")
def rerun_due(spark, sf):
    return pairing.rerun_due(view(spark, sf, "citation_runs"), 7, F.lit("2000-01-31").cast("date")).select("target_id", "run_id", "since")


@Q.add("claimable_runs", with_views("citation_runs") + """ SELECT run_id FROM citation_runs WHERE status = 'queued' OR (status = 'running' AND coalesce(step_at, started_at) < TIMESTAMP '1999-01-01 00:20:00' - INTERVAL 30 MINUTE)
  ORDER BY queued_at, run_id LIMIT 5""")
def claimable_runs(spark, sf):
    return pairing.claimable(view(spark, sf, "citation_runs"), F.lit("1999-01-01 00:20:00").cast("timestamp_ntz")).select("run_id")


# ---- roll-ups ------------------------------------------------------------------------------------------------------------
CLASSES = ["superseded", "current", "flagged_as_previous", "indirect", "not_relying", "unclear"]


@Q.add("verdict_counts", with_views("affected_citations") + " SELECT drift_event_id, " + ", ".join(f"count(*) FILTER (WHERE cites = '{c}') AS n_{c}" for c in CLASSES)
       + ", count(*) FILTER (WHERE cites IN ('indirect', 'unclear')) AS n_uncertain, count(*) FILTER (WHERE review_status = 'pending') AS n_pending FROM affected_citations GROUP BY 1")
def verdict_counts(spark, sf):
    return rollups.verdict_counts(view(spark, sf, "affected_citations"), "drift_event_id")


@Q.add("notice_counts", with_views("notification_log") + " SELECT drift_event_id, " + ", ".join(f"count(*) FILTER (WHERE status = '{c}') AS n_{c}" for c in ("sent", "drafted", "skipped", "failed"))
       + " FROM notification_log GROUP BY 1")
def notice_counts(spark, sf):
    return rollups.notice_counts(view(spark, sf, "notification_log"), "drift_event_id")


@Q.add("run_rollup", with_views("citation_runs", "affected_citations") + """, r AS (SELECT drift_event_id, bool_or(status IN ('queued', 'running')) AS a, bool_or(status = 'failed') AS f,
   coalesce(bool_and(coverage_complete) FILTER (WHERE status = 'done'), true) AS coverage_complete, count(*) AS n_runs FROM citation_runs GROUP BY 1),
  c AS (SELECT drift_event_id, count(*) FILTER (WHERE cites = 'superseded') AS n FROM affected_citations GROUP BY 1)
  SELECT r.drift_event_id, CASE WHEN a THEN 'running' WHEN f THEN 'failed' ELSE 'done' END AS status, coalesce(c.n, 0) AS n_superseded, coverage_complete, n_runs FROM r LEFT JOIN c USING (drift_event_id)""")
def run_rollup(spark, sf):
    return rollups.rollup_runs(view(spark, sf, "citation_runs"), view(spark, sf, "affected_citations")).withColumn("n_runs", F.size("run_ids").cast("long")).drop("run_ids")


@Q.add("severity_rollup", f"""WITH d AS (SELECT l_orderkey, max(CASE WHEN l_tax > 0 THEN l_tax * 12 END) AS m, max(CASE WHEN l_tax * 12 >= 0.9 THEN 4 WHEN l_tax * 12 >= 0.6 THEN 3 WHEN l_tax * 12 >= 0.3 THEN 2 WHEN l_tax > 0 THEN 1 END) AS r
   FROM lineitem GROUP BY 1) SELECT CAST(o_orderkey AS BIGINT) AS event_id, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 600000.0 ELSE m END AS materiality_score,
  CASE WHEN d.l_orderkey IS NULL THEN 'minor' ELSE {LIT_TIERS}[r] END AS fulltext_tier FROM orders LEFT JOIN d ON d.l_orderkey = o_orderkey""")
def severity_rollup(spark, sf):
    score = F.when(F.col("l_tax") > 0, F.col("l_tax") * 12)
    diffs = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event_id"), score.alias("materiality")).withColumn("severity_tier", review.tier_of(F.col("materiality")))
    e = load(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("event_id"), F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_totalprice") / 600000.0).cast("string"))
                                         .when(F.col("o_orderkey") % 3 == 1, "n/a").alias("materiality_score"))
    return review.rollup_severity(e, diffs)


@Q.add("coverage_records", with_views("citation_runs", "affected_citations") + """, u AS (SELECT drift_event_id AS run_id, count(*) AS n, count(*) FILTER (WHERE role = 'background') AS cut FROM affected_citations WHERE cites = 'unclear' GROUP BY 1),
  s AS (SELECT run_id, n_unjudged AS k, run_id % 5 = 0 AS st, run_id % 3 AS sc, run_id % 4 AS df FROM citation_runs)
  SELECT s.run_id, CAST(k + 50 AS BIGINT) AS candidates, k + 50 - coalesce(n, 0) AS judged, coalesce(n, 0) AS unjudged,
   concat_ws('|', CASE WHEN st THEN concat('Europe PMC reported ', k + 100, ' citing papers containing the old value, but only the first ', k, ' could be retrieved (page limit); the rest were not examined.') END,
    CASE WHEN sc > 0 THEN concat(sc, ' of ', k + 60, ' matching papers were not screened (limit 2000 per run; papers citing the preprint and older papers were screened first).') END,
    CASE WHEN df = 3 THEN 'The search of search_more x hit the page limit; part of its results was not examined.' END,
    CASE WHEN cut > 0 THEN concat(cut, ' candidate(s) were not judged: the run''s worker capacity (120 papers) was used up.') END,
    CASE WHEN n > cut THEN concat(n - cut, ' candidate(s) were sent to a worker but got no verdict.') END,
    CASE WHEN df > 0 THEN concat(df, ' matching paper(s) had no downloadable full text and could not be read.') END) AS notes,
   st OR sc > 0 OR df = 3 OR coalesce(n, 0) > 0 AS truncated FROM s LEFT JOIN u ON u.run_id = s.run_id""")
def coverage_records(spark, sf):
    k = F.col("n_unjudged")
    stats = view(spark, sf, "citation_runs").select(
        "run_id", (k + 100).alias("hit_count"), k.alias("fetched"), (F.col("run_id") % 5 == 0).alias("search_truncated"), (k + 60).alias("matching"),
        (F.col("run_id") % 3).alias("screen_capped"), F.lit(2000).alias("screen_limit"),
        F.when(F.col("run_id") % 4 == 3, F.array(F.lit("search_more x"))).otherwise(F.array().cast("array<string>")).alias("later_truncated"),
        (F.col("run_id") % 4).alias("download_failed"), F.lit(0).alias("no_open_full_text"), (k + 50).alias("candidates"))
    un = view(spark, sf, "affected_citations").filter("cites = 'unclear'").select(F.col("drift_event_id").alias("run_id"), "work_id", (F.col("role") != "background").alias("dispatched"))
    return rollups.coverage(stats, un).select("run_id", "candidates", "judged", "unjudged", F.array_join("notes", "|").alias("notes"), "truncated")


@Q.add("coverage_panel", with_views("citation_runs") + """, p AS (SELECT drift_event_id, status, run_id, n_unjudged, NOT coverage_complete AND status = 'done' AS part FROM citation_runs)
  SELECT drift_event_id, CAST(sum(CASE WHEN part THEN CASE WHEN run_id % 8 = 0 THEN 2 ELSE n_unjudged END ELSE 0 END) AS BIGINT) AS n_unjudged,
   2 * count(*) FILTER (WHERE part) AS n_list, count(DISTINCT n_unjudged) FILTER (WHERE part) AS n_notes, bool_or(status IN ('queued', 'running')) AS active FROM p GROUP BY 1""")
def coverage_panel(spark, sf):
    r = view(spark, sf, "citation_runs").withColumn("coverage_notes", F.array(F.concat(F.lit("note "), "n_unjudged"))).withColumn(
        "unjudged", F.array(F.lit("a"), F.lit("b"))).withColumn("n_unjudged", F.when(F.col("run_id") % 8 != 0, F.col("n_unjudged")))
    return rollups.coverage_panel(r).select("drift_event_id", "n_unjudged", F.size("unjudged").cast("long").alias("n_list"), F.size("notes").cast("long").alias("n_notes"), "active")


@Q.add("counter_map_sums", """SELECT l_suppkey, concat_ws('|', concat('A=', sum(l_quantity) FILTER (WHERE l_returnflag = 'A')), concat('N=', sum(l_quantity) FILTER (WHERE l_returnflag = 'N')),
  concat('R=', sum(l_quantity) FILTER (WHERE l_returnflag = 'R'))) AS sums FROM (SELECT l_suppkey, l_returnflag, CAST(l_quantity AS BIGINT) AS l_quantity FROM lineitem) GROUP BY 1""".replace("concat('A=', sum", "'A=' || CAST(sum")
       .replace("concat('N=', sum", "'N=' || CAST(sum").replace("concat('R=', sum", "'R=' || CAST(sum").replace("'A'))", "'A') AS VARCHAR)").replace("'N'))", "'N') AS VARCHAR)").replace("'R'))", "'R') AS VARCHAR)"))
def counter_map_sums(spark, sf):
    d = load(spark, sf, "lineitem").select("l_suppkey", F.create_map("l_returnflag", F.col("l_quantity").cast("long")).alias("calls"))
    s = rollups.sum_maps(d, ["l_suppkey"], "calls")
    return s.select("l_suppkey", F.array_join(F.transform(F.array_sort(F.map_entries("calls")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "|").alias("sums"))


@Q.add("strongest_verdicts", with_views("affected_citations") + """, r AS (SELECT drift_event_id AS paper_id, work_id % 50 AS work_id, cites, row_number() OVER (PARTITION BY drift_event_id, work_id % 50 ORDER BY
   CASE cites WHEN 'superseded' THEN 1 WHEN 'indirect' THEN 2 WHEN 'flagged_as_previous' THEN 3 WHEN 'unclear' THEN 4 WHEN 'current' THEN 5 ELSE 6 END) AS rn FROM affected_citations)
  SELECT paper_id, work_id, cites FROM r WHERE rn = 1""")
def strongest_verdicts(spark, sf):
    v = view(spark, sf, "affected_citations").select(F.col("drift_event_id").alias("paper_id"), (F.col("work_id") % 50).alias("work_id"), "cites", F.col("affected_citation_id").alias("target_no"))
    best, _ = rollups.merge_verdicts(v, v)
    return best.select("paper_id", "work_id", "cites")


@Q.add("citation_scores", with_views("affected_citations") + """, p AS (SELECT drift_event_id % 20 AS target_id, affected_citation_id AS work_id, cites AS p, work_id % 2 = 0 AS ok FROM affected_citations),
  g AS (SELECT target_id, work_id, CASE WHEN length(work_id) % 3 = 0 THEN 'superseded' ELSE p END AS g FROM p WHERE p <> 'not_relying' AND p <> 'current'),
  j AS (SELECT p.target_id, p.p, coalesce(g.g, 'not_relying') AS g, ok FROM p LEFT JOIN g ON g.target_id = p.target_id AND g.work_id = p.work_id)
  SELECT target_id, count(*) FILTER (WHERE g = 'superseded') AS gold_superseded, count(*) FILTER (WHERE p = 'superseded') AS predicted_superseded, count(*) FILTER (WHERE p = g AND p = 'superseded') AS tp,
   count(*) AS n_judged, count(*) FILTER (WHERE p = 'superseded' AND NOT ok) AS unverified_superseded,
   round(count(*) FILTER (WHERE p = g AND p = 'superseded') / count(*) FILTER (WHERE g = 'superseded'), 3) AS recall,
   round(count(*) FILTER (WHERE p = g AND p = 'superseded') / count(*) FILTER (WHERE p = 'superseded'), 3) AS precision, round(count(*) FILTER (WHERE p = g) / count(*), 3) AS accuracy_over_judged,
   count(*) FILTER (WHERE g = 'superseded' AND p <> 'superseded') AS n_missed FROM j GROUP BY 1""")
def citation_scores(spark, sf):
    c = view(spark, sf, "affected_citations")
    p = c.select((F.col("drift_event_id") % 20).alias("target_id"), F.col("affected_citation_id").alias("work_id"), "cites", (F.col("work_id") % 2 == 0).alias("sentence_verified"))
    g = p.filter("cites NOT IN ('not_relying', 'current')").select("target_id", "work_id", F.expr("CASE WHEN length(work_id) % 3 = 0 THEN 'superseded' ELSE cites END").alias("cites"))
    s = ev.score_citations(p, g)
    return s.withColumn("n_missed", F.size("missed").cast("long")).drop("missed", "false_superseded")


@Q.add("confusion_matrix", """SELECT concat(quality, '->', CASE WHEN doc_id % 9 = 0 THEN 'invalid' ELSE CAST((toxic + doc_id) % 2 AS VARCHAR) END) AS cell, count(*) AS n FROM labels GROUP BY 1""")
def confusion_matrix(spark, sf):
    return ev.confusion(_labels(spark, sf), "gold", "pred")


def _labels(spark, sf):
    return load(spark, sf, "labels").select("doc_id", F.col("quality").alias("gold"), F.when(F.col("doc_id") % 9 != 0, (F.col("toxic") + F.col("doc_id")) % 2).alias("pred"))


@Q.add("label_accuracy", """SELECT count(*) AS n, round(count(*) FILTER (WHERE doc_id % 9 <> 0 AND quality = (toxic + doc_id) % 2) / count(*), 3) AS accuracy FROM labels""")
def label_accuracy(spark, sf):
    return ev.accuracy(_labels(spark, sf), "gold", "pred")


@Q.add("drift_scores", """SELECT count(*) FILTER (WHERE doc_id % 4 <> 0) AS subdrifts, count(*) FILTER (WHERE doc_id % 4 <> 0 AND quality = 1) AS detected, count(*) FILTER (WHERE doc_id % 4 <> 0 AND toxic = 0) AS root_cause_ok,
  count(*) FILTER (WHERE doc_id % 4 <> 0 AND quality = 1) AS tier_exact, CAST(sum(doc_id % 7) FILTER (WHERE doc_id % 4 <> 0) AS BIGINT) AS quotes, CAST(sum(doc_id % 3) FILTER (WHERE doc_id % 4 <> 0) AS BIGINT) AS quotes_grounded,
  concat(count(*) FILTER (WHERE doc_id % 4 = 0 AND toxic = 0), '/', count(*) FILTER (WHERE doc_id % 4 = 0)) AS negatives_ok FROM labels""")
def drift_scores(spark, sf):
    d = load(spark, sf, "labels").select(
        F.concat(F.when(F.col("doc_id") % 4 == 0, "N0").otherwise("D"), "doc_id").alias("subdrift"), (F.col("quality") == 1).alias("detected"), (F.col("toxic") == 0).alias("root_cause_ok"),
        (F.col("quality") == 1).alias("tier_ok"), (F.col("doc_id") % 7).alias("n_evidence"), (F.col("doc_id") % 3).alias("grounded"))
    return ev.drift_summary(d)


@Q.add("ingest_summary", """SELECT source, 'apply' AS mode, count(*) FILTER (WHERE doc_id % 6 > 0) AS fetched, count(*) FILTER (WHERE doc_id % 6 = 0) AS skipped, count(*) FILTER (WHERE doc_id % 6 > 0) AS upserted,
  CAST(0 AS BIGINT) AS would_upsert, count(*) FILTER (WHERE doc_id % 12 = 0) AS errors FROM documents GROUP BY 1""")
def ingest_summary(spark, sf):
    d = load(spark, sf, "documents").select("source", (F.col("doc_id") % 6 > 0).alias("ok"), F.when(F.col("doc_id") % 12 == 0, "timeout").alias("error"))
    return rollups.ingest_summary(d, "apply")


@Q.add("library_counts", with_views("preprints") + f""", done AS ({EVENTS_OF_PAIRS}) SELECT (SELECT count(*) FROM preprints WHERE record_source IS DISTINCT FROM 'demo_seed') AS preprint_rows,
  (SELECT count(*) FROM preprints WHERE {ELIGIBLE}) AS pairs, (SELECT count(*) FROM preprints p WHERE {ELIGIBLE} AND NOT EXISTS (SELECT 1 FROM done d WHERE lower(d.preprint_doi) = lower(p.doi)
   AND lower(d.published_doi) = lower(p.published_doi))) AS waiting""")
def library_counts(spark, sf):
    load(spark, sf, "customer").createOrReplaceTempView("customer")
    return rollups.library_counts(view(spark, sf, "preprints"), spark.sql(EVENTS_OF_PAIRS))


@Q.add("rows_by_source", "SELECT source, count(*) AS rows FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def rows_by_source(spark, sf):
    return rollups.count_by_source(load(spark, sf, "documents"))


@Q.add("run_progress", with_views("citation_runs") + """ SELECT run_id, CASE run_id % 5 WHEN 0 THEN concat('pre-screen: ', n_unjudged, '/', n_unjudged + 3, ' full texts screened, 7 candidate(s)')
  WHEN 1 THEN 'orchestrator turn 2: 7 candidate(s), 4 judged' WHEN 2 THEN 'orchestrator finished: 7 candidate(s), 4 judged' WHEN 3 THEN 'overflow judged: 4/7' ELSE 'verification done' END AS line,
  n_unjudged + 3 AS to_screen FROM citation_runs""")
def run_progress(spark, sf):
    phases = F.array(*[F.lit(p) for p in ("prescreen", "orchestrate", "overflow", "verify", "done")])
    st = view(spark, sf, "citation_runs").select("run_id", F.get(phases, (F.col("run_id") % 5).cast("int")).alias("phase"), F.col("n_unjudged").alias("screened"), F.lit(3).alias("pending"),
                                                 F.lit(7).alias("candidates"), F.lit(4).alias("judged"), F.lit(2).alias("turns"))
    return rollups.run_progress(st).select("run_id", "line", "to_screen")


@Q.add("full_run_summary", with_views("affected_citations") + """, t AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY o_orderkey) AS rn FROM (SELECT o_orderkey, o_custkey AS paper FROM orders)),
  w AS (SELECT drift_event_id, count(*) FILTER (WHERE cites IN ('superseded', 'indirect')) AS n FROM affected_citations GROUP BY 1)
  SELECT paper AS event_id, count(*) AS n_targets, count(*) AS traced, 0 AS skipped, CAST(coalesce(sum(w.n), 0) AS BIGINT) AS n_affected,
   CAST(coalesce(sum(w.n), 0) AS BIGINT) AS n_alerts FROM t LEFT JOIN w ON w.drift_event_id = o_orderkey GROUP BY 1""")
def full_run_summary(spark, sf):
    t = load(spark, sf, "orders").select(F.col("o_custkey").alias("event_id"), F.col("o_orderkey").cast("long").alias("target_id"), F.col("o_orderkey").alias("target_no"), F.lit(1).alias("candidates"), F.lit(1).alias("judged"))
    r = view(spark, sf, "affected_citations").select(F.col("drift_event_id").alias("target_id"), F.col("affected_citation_id").alias("work_no"), "work_id", "cites")
    per, alerts = rollups.run_summary(t, r)
    n = alerts.groupBy("event_id").agg(F.count("*").alias("n_alerts"))
    return per.join(n, "event_id", "left").select("event_id", "n_targets", "traced", "skipped", "n_affected", F.coalesce("n_alerts", F.lit(0)).alias("n_alerts"))


# ---- records and decisions -----------------------------------------------------------------------------------------------
@Q.add("model_replies", """SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events""")
def model_replies(spark, sf):
    m = F.col("event_id") % 4
    text = (F.when(m == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(m == 1, F.concat(F.lit("Here: "), F.regexp_replace("props", r"\}", ",}"), F.lit(" done")))
            .when(m == 2, F.col("props")).otherwise(F.regexp_replace("props", ":", "")))
    return records.parse_replies(load(spark, sf, "events").select("event_id", text.alias("text")), "k int").select("event_id", F.col("parsed.k").alias("k"))


@Q.add("judgement_rows", """SELECT event_id AS request_id, 2 AS candidate_no, 'yes' AS refers, 'uses_old_value' AS value_use FROM events WHERE event_id % 3 < 2
  UNION ALL SELECT event_id, 1, 'no', 'cannot_tell' FROM events WHERE event_id % 3 < 2 UNION ALL SELECT event_id, 0, 'unusable', '' FROM events WHERE event_id % 3 = 2""")
def judgement_rows(spark, sf):
    good = '{"judgements": [{"id": "c2", "refers": "no"}, {"id": "c2", "refers": "yes", "value_use": "uses_old_value"}, {"id": "c9", "refers": "yes"}, {"id": "c1", "refers": "maybe", "value_use": "?"},]}'
    r = load(spark, sf, "events").select(F.col("event_id").alias("request_id"), F.when(F.col("event_id") % 3 < 2, good).otherwise("no JSON here").alias("text"), F.lit(2).alias("n_candidates"))
    rows, bad = records.parse_judgements(r)
    return rows.drop("reason").unionByName(bad.select("request_id", F.lit(0).alias("candidate_no"), F.lit("unusable").alias("refers"), F.lit("").alias("value_use")))


def statement_events(spark, sf):
    s = view(spark, sf, "statements")
    diff = F.struct(F.when(F.col("doc_id") % 5 == 0, "wording_only").otherwise("data_revision").alias("root_cause"), F.col("old_text").alias("preprint_text"),
                    F.col("new_text").alias("published_text"), F.lit("changed").alias("change_description"), F.lit("major").alias("severity_tier"))
    return s.select(F.col("doc_id").alias("event_id"), F.concat(F.lit("p"), "doc_id").alias("paper_id"), F.concat(F.lit("10.1101/"), "doc_id").alias("preprint_doi"),
                    F.concat(F.lit("10.1016/p"), "doc_id").alias("published_doi"), F.expr(AUTHOR).alias("first_author"),
                    F.concat(F.lit("Study "), "doc_id", F.lit(" of revised incubation values in "), "lang", F.lit(" cohorts over time")).alias("preprint_title"),
                    F.array(diff.withField("root_cause", F.lit("wording_only")), diff).alias("claim_diffs"), F.lit("not_queued").alias("citation_status"),
                    F.lit("drifted").alias("drift_summary"), F.when(F.col("doc_id") % 41 == 0, "rejected").otherwise("pending").alias("review_status"), F.lit("major").alias("fulltext_tier"))


@Q.add("citation_targets", f"SELECT concat(doc_id, '::1') AS target_id, {AUTHOR} AS first_author, {OLD_TERMS} AS terms, concat('Study ', doc_id, ' of revised incubation values in ', lang, ' cohorts over time') AS title_fragment FROM documents WHERE doc_id % 5 <> 0 AND {OLD_TERMS} <> ''")
def citation_targets(spark, sf):
    return records.build_targets(statement_events(spark, sf)).select("target_id", "first_author", F.array_join("terms", "|").alias("terms"), "title_fragment")


@Q.add("missing_runs", f"SELECT doc_id AS event_id, CAST(CASE WHEN doc_id % 5 <> 0 AND {OLD_TERMS} <> '' THEN 1 ELSE 0 END AS BIGINT) AS targets FROM documents WHERE doc_id <> 7")
def missing_runs(spark, sf):
    per, _ = records.missing_runs(statement_events(spark, sf), ["p7"])
    return per.select("event_id", "targets")


@Q.add("event_rows", """WITH h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat('v1-vs-published:10.1101/', doc_id, ':10.1016/p', doc_id))) AS s FROM documents)
  SELECT doc_id, substr(s, 1, 8) AS id_start, CAST(1 + doc_id % 3 AS BIGINT) AS n_diffs, concat('change ', doc_id % 3) AS last_change, CASE WHEN doc_id % 2 = 0 THEN 'partial' ELSE 'unsupported' END AS status FROM h""")
def event_rows(spark, sf):
    d = load(spark, sf, "documents")
    pid = F.concat(F.lit("p"), "doc_id").alias("paper_id")
    pairs = d.select(pid, F.concat(F.lit("10.1101/"), "doc_id").alias("preprint_doi"), F.concat(F.lit("10.1016/p"), "doc_id").alias("published_doi"), F.lit("t").alias("title"), F.lit("pt").alias("published_title"),
                     F.lit("Li").alias("first_author"), F.array(F.lit("v1")).alias("versions"), F.array().cast("array<string>").alias("withdrawn_versions"))
    an = d.select(pid, F.lit("s").alias("drift_summary"), F.lit(0.5).alias("materiality_score"), F.lit("medium").alias("fulltext_tier"))
    diffs = d.select(pid, F.col("doc_id"), F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))).alias("claim_diff_idx")).select(
        "paper_id", "claim_diff_idx", F.concat(F.lit("change "), "claim_diff_idx").alias("change_description"))
    ver = d.filter("doc_id % 2 = 0").select(pid, F.lit(2).cast("long").alias("quotes_total"), F.lit(1).cast("long").alias("quotes_verified"), F.lit("partial").alias("status"))
    e = records.build_events(pairs, an, diffs, ver, d.select(pid, F.lit("minor").alias("abstract_class")))
    return e.select(F.substring("paper_id", 2, 99).cast("long").alias("doc_id"), F.substring("event_id", 1, 8).alias("id_start"), F.size("claim_diffs").cast("long").alias("n_diffs"),
                    F.element_at("claim_diffs", -1)["change_description"].alias("last_change"), F.col("verification_status").alias("status"))


@Q.add("claim_rows", """SELECT concat(conv_id, '::', CASE WHEN turn % 2 = 0 THEN concat('pre', turn) ELSE concat('published', turn) END) AS claim_id, CASE WHEN conv_id % 2 = 0 THEN concat('10.1101/', conv_id) ELSE concat('10.1016/', conv_id) END AS parent_doi,
  CASE WHEN conv_id % 2 = 0 THEN 'v1' ELSE 'published' END AS parent_version, text FROM conversations""".replace("concat('published', turn)", "concat(CASE WHEN conv_id % 2 = 0 THEN 'preprint_v1' ELSE 'published' END, turn)"))
def claim_rows(spark, sf):
    c = load(spark, sf, "conversations")
    doc = F.when(F.col("conv_id") % 2 == 0, "preprint_v1").otherwise("published").alias("doc_id")
    packed = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    claims = packed.select(F.col("conv_id").alias("paper_id"), doc, F.transform("t", lambda x: F.struct(
        F.when(x["turn"] % 2 == 0, F.concat(F.lit("pre"), x["turn"])).alias("id"), F.lit("Results").alias("section"), x["text"].alias("text"), x["role"].alias("kind"))).alias("claims"))
    events = packed.select(F.col("conv_id").alias("event_id"), F.col("conv_id").alias("paper_id"), F.concat(F.lit("10.1101/"), "conv_id").alias("preprint_doi"), F.concat(F.lit("10.1016/"), "conv_id").alias("published_doi"))
    return records.build_claims(events, claims).select("claim_id", "parent_doi", "parent_version", "text")


@Q.add("numbered_claims", """SELECT conv_id, string_agg(concat('pre', rn - 1), '|' ORDER BY rn) AS ids, count(*) AS n FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '') GROUP BY 1""")
def numbered_claims(spark, sf):
    r = load(spark, sf, "conversations").select(F.col("conv_id").alias("paper_id"), F.lit("preprint_v1").alias("doc_id"), F.col("turn").alias("chunk"),
                                                F.array(F.struct(F.lit("s").alias("section"), F.col("text").alias("text"), F.lit("finding").alias("kind"))).alias("claims"))
    return records.number_claims(r).select(F.col("paper_id").alias("conv_id"), F.array_join(F.transform("claims", lambda c: c["id"]), "|").alias("ids"), F.size("claims").cast("long").alias("n"))


@Q.add("citation_rows", with_views("affected_citations") + """ SELECT concat(drift_event_id, '::', work_id) AS affected_citation_id, CASE WHEN work_id % 3 = 0 THEN NULL ELSE concat(1990 + work_id % 30, '-05') END AS citing_paper_date,
  cites IN ('superseded', 'indirect') AS needs_notification, CASE WHEN cites = 'unclear' THEN 'pending' ELSE 'not_required' END AS review_status,
  CASE WHEN source IS NULL THEN 'prefetch' ELSE split_part(source, ':', 1) END AS found_via, CAST(2 AS BIGINT) AS n_authors FROM affected_citations""")
def citation_rows(spark, sf):
    c = view(spark, sf, "affected_citations")
    w = c.select(F.col("drift_event_id").alias("event_id"), F.lit("t").alias("target_id"), F.lit(0).alias("claim_diff_idx"), F.lit("r").alias("run_id"), "work_id", F.lit("T").alias("title"),
                 F.lit("Smith J, Li Q.").alias("authors"), F.expr("CASE WHEN work_id % 3 = 0 THEN 'n.d.' ELSE concat(1990 + work_id % 30, '-05') END").alias("date"), F.lit("J").alias("journal"),
                 F.lit(None).cast("string").alias("doi"), "cites", "role", F.lit("s").alias("sentence"), F.lit(True).alias("sentence_verified"), "source", F.lit("").alias("relayed_by"), F.lit(None).cast("array<string>").alias("flags"))
    return records.build_citations(w).select("affected_citation_id", "citing_paper_date", "needs_notification", "review_status", "found_via", F.size("citing_paper_authors").cast("long").alias("n_authors"))


@Q.add("review_triggers", with_views("drift_events") + """ SELECT event_id, concat_ws('|', CASE WHEN event_id % 6 = 0 THEN 'earlier' END, CASE WHEN event_id % 4 > 0 AND event_id % 3 < event_id % 4 THEN 'quote_unverified' END,
   CASE WHEN coalesce((abstract_class = 'no_change' AND fulltext_tier IN ('significant', 'major')) OR (abstract_class = 'major' AND fulltext_tier = 'minor'), false) THEN 'severity_mismatch' END,
   CASE WHEN event_id % 8 = 0 THEN 'withdrawn_version' END) AS reasons FROM drift_events""")
def review_triggers(spark, sf):
    k = F.col("event_id")
    e = view(spark, sf, "drift_events").withColumn("quotes_total", k % 4).withColumn("quotes_verified", k % 3).withColumn(
        "withdrawn_versions", F.when(k % 8 == 0, F.array(F.lit("v2"))).otherwise(F.array().cast("array<string>"))).withColumn("review_reasons", F.when(k % 6 == 0, F.array(F.lit("earlier"))))
    return review.apply_review(e).select("event_id", F.array_join("review_reasons", "|").alias("reasons"))


@Q.add("reanalysis_carry_over", with_views("drift_events") + """ SELECT event_id, CASE WHEN review_status IN ('approved', 'rejected') THEN 'pending' ELSE 'not_required' END AS review_status,
  CASE WHEN review_status IN ('approved', 'rejected') THEN concat('previous decision ', review_status, ' by ann at None') END AS review_note FROM drift_events""")
def reanalysis_carry_over(spark, sf):
    old = view(spark, sf, "drift_events").select("event_id", "review_status", F.lit("ann").alias("reviewer"), F.lit(None).cast("string").alias("reviewed_at"))
    new = old.select("event_id", F.lit("not_required").alias("review_status"), F.array().cast("array<string>").alias("review_reasons"))
    return review.carry_over(new, old).select("event_id", "review_status", "review_note")


@Q.add("citation_decisions", """SELECT o_orderkey AS id, 'doc' AS part, CASE WHEN o_orderkey % 5 = 0 THEN 'current' ELSE 'superseded' END AS cites, CASE WHEN o_orderkey % 5 < 2 THEN 'approved' WHEN o_orderkey % 5 = 2 THEN 'rejected' ELSE 'pending' END AS status,
   CASE WHEN o_orderkey % 5 = 0 THEN 'superseded' END AS machine, o_orderkey % 5 <> 0 AS needs FROM orders
  UNION ALL SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN 'field cannot be corrected' ELSE 'unknown value' END, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 5 > 2""")
def citation_decisions(spark, sf):
    k = F.col("o_orderkey") % 5
    o = load(spark, sf, "orders")
    no_map = F.lit(None).cast("map<string,string>")
    d = o.select(F.col("o_orderkey").alias("id"), F.lit("superseded").alias("cites"), F.lit("background").alias("role"), F.lit(True).alias("needs_notification"), F.lit("pending").alias("review_status"),
                 F.lit(None).cast("string").alias("reviewer"), F.lit(None).cast("string").alias("review_note"), no_map.alias("machine_verdict"), F.lit(None).cast("array<string>").alias("corrected_fields"))
    corr = (F.when(k == 0, F.create_map(F.lit("cites"), F.lit("current"))).when(k == 3, F.create_map(F.lit("title"), F.lit("x"))).when(k == 4, F.create_map(F.lit("cites"), F.lit("odd"))))
    dec = o.select(F.col("o_orderkey").alias("id"), F.when(k == 2, "rejected").otherwise("approved").alias("decision"), F.lit(" ann ").alias("reviewer"), F.lit("").alias("note"), corr.alias("corrected"))
    done, bad = review.decide_citations(d, dec)
    null = F.lit(None).cast("string")
    return done.select("id", F.lit("doc").alias("part"), "cites", F.col("review_status").alias("status"), F.element_at("machine_verdict", "cites").alias("machine"), F.col("needs_notification").alias("needs")).unionByName(
        bad.select("id", F.col("error").alias("part"), null.alias("cites"), null.alias("status"), null.alias("machine"), F.lit(None).cast("boolean").alias("needs")))


@Q.add("event_decisions", """SELECT o_orderkey AS id, 'doc' AS part, CASE WHEN o_orderkey % 4 = 0 THEN 'major' ELSE 'minor' END AS abstract_class, CASE WHEN o_orderkey % 4 = 0 THEN 'significant' ELSE 'minor' END AS tier0,
   CASE WHEN o_orderkey % 4 = 0 THEN 'abstract_class|claim_diffs[0].severity_tier' END AS fields FROM orders
  UNION ALL SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'idx out of range' WHEN 2 THEN 'value not allowed' ELSE 'a rejected item is not corrected' END, NULL, NULL, NULL FROM orders WHERE o_orderkey % 4 > 0""")
def event_decisions(spark, sf):
    k = F.col("o_orderkey") % 4
    o = load(spark, sf, "orders")
    diff = "array<struct<root_cause:string,severity_tier:string>>"
    d = o.select(F.col("o_orderkey").alias("id"), F.lit("minor").alias("abstract_class"), F.lit("minor").alias("fulltext_tier"), F.from_json(F.lit('[{"root_cause": "method_change", "severity_tier": "minor"}]'), diff).alias("claim_diffs"),
                 F.lit("pending").alias("review_status"), F.lit(None).cast("map<string,string>").alias("machine_verdict"), F.lit(None).cast("array<string>").alias("corrected_fields"))
    wish = F.from_json(F.when(k == 0, '[{"idx": 0, "severity_tier": "significant", "root_cause": "method_change"}]').when(k == 1, '[{"idx": 3, "severity_tier": "major"}]').when(
        k == 2, '[{"idx": 0, "severity_tier": "odd"}]'), "array<struct<idx:int,root_cause:string,severity_tier:string>>")
    dec = o.select(F.col("o_orderkey").alias("id"), F.when(k == 3, "rejected").otherwise("approved").alias("decision"), F.when(k != 1, "major").alias("abstract_class"), F.lit("minor").alias("fulltext_tier"), wish.alias("claim_diffs"))
    done, bad = review.decide_events(d, dec)
    null = F.lit(None).cast("string")
    return done.select("id", F.lit("doc").alias("part"), "abstract_class", F.get("claim_diffs", F.lit(0))["severity_tier"].alias("tier0"), F.array_join("corrected_fields", "|").alias("fields")).unionByName(
        bad.select("id", F.col("error").alias("part"), null.alias("abstract_class"), null.alias("tier0"), null.alias("fields")))


NOTICE_SQL = with_views("affected_citations", "drift_events", "notification_log") + """, c AS (SELECT a.*, e.event_id FROM affected_citations a JOIN drift_events e ON e.event_id = a.drift_event_id
   WHERE cites IN ('superseded', 'indirect') AND a.review_status IS DISTINCT FROM 'rejected' AND e.review_status IS DISTINCT FROM 'rejected' AND affected_citation_id NOT IN (SELECT affected_citation_id FROM notification_log))
  SELECT affected_citation_id, CASE WHEN cites = 'indirect' THEN '[revtrace] A value your paper cites via another paper was revised by its original authors'
    ELSE '[revtrace] A value your paper cites from Li et al. was revised in the published version' END AS subject,
   CASE WHEN work_id % 2 = 0 THEN 'Dear Dr Smith and co-authors,' ELSE 'Dear authors,' END AS greeting, role <> 'unknown' AS has_note, 'drafted' AS status FROM c"""


@Q.add("notices", NOTICE_SQL)
def notices(spark, sf):
    names = F.when(F.col("work_id") % 2 == 0, F.array(F.struct(F.lit("Smith J").alias("name")), F.struct(F.lit("Li Q").alias("name")))).otherwise(F.array().cast("array<struct<name:string>>"))
    c = view(spark, sf, "affected_citations").withColumn("citing_paper_authors", names).withColumn("claim_diff_idx", F.lit(0)).withColumn("citing_paper_title", F.lit("A study")).withColumn(
        "citing_paper_doi", F.lit("10.1/x")).withColumn("relayed_by", F.lit("")).withColumn("sentence", F.lit("We used 5.8 days.")).withColumn("sentence_verified", F.lit(True))
    diff = F.struct(F.lit("mean 5.8 days").alias("preprint_text"), F.lit("mean 6.4 days").alias("published_text"), F.lit("revised").alias("change_description"))
    e = view(spark, sf, "drift_events").withColumn("first_author", F.lit("Li")).withColumn("drift_summary", F.lit("s")).withColumn("claim_diffs", F.array(diff))
    n = review.build_notifications(c, e, view(spark, sf, "notification_log"), "inbox@example.org")
    return n.select("affected_citation_id", "subject", F.substring_index("body", "\n", 1).alias("greeting"), (F.contains("body", F.lit("Your paper appears")) | F.contains("body", F.lit("Your paper reports this"))
                    | F.contains("body", F.lit("Your paper mentions"))).alias("has_note"), "status")


@Q.add("record_rows", """SELECT doc_id, 'feed' AS kind, concat('10.1101/', doc_id) AS doi, doc_id % 3 > 0 AS is_final, 'v2' AS version, false AS abstract_missing FROM documents
  UNION ALL SELECT doc_id, 'published', concat('10.1016/p', doc_id), false, 'published', doc_id % 2 = 0 FROM documents""")
def record_rows(spark, sf):
    d = load(spark, sf, "documents")
    s = lambda e, n: F.expr(e).alias(n)
    now = F.lit("2026-01-01T00:00:00Z")
    feed = d.select("source", s("concat('https://doi.org/10.1101/', doc_id)", "doi"), F.lit("2").alias("version"), s("CASE WHEN doc_id % 3 > 0 THEN concat('10.1016/P', doc_id) ELSE '' END", "published_doi"),
                    F.lit("<b>T</b>").alias("title"), F.col("text").alias("abstract"), F.lit(None).cast("string").alias("conclusion"), F.array(F.lit("A")).alias("authors"), F.lit("2020-01-02").alias("posted_date"))
    a = pairing.to_preprint_rows(feed, now)
    works = d.select(s("concat('10.1016/P', doc_id)", "doi"), F.lit("T").alias("title"), s("CASE WHEN doc_id % 2 = 0 THEN ' <p> </p>' ELSE text END", "abstract"), F.array(F.lit("A")).alias("authors"), F.lit("2020-01-02").alias("published_date"), "source")
    b = pairing.to_published_rows(works, F.col("source"), now)
    return a.select(F.regexp_extract("doi", r"(\d+)$", 1).cast("long").alias("doc_id"), F.lit("feed").alias("kind"), "doi", F.col("is_final_preprint").alias("is_final"), "version", F.lit(False).alias("abstract_missing")).unionByName(
        b.select(F.regexp_extract("doi", r"(\d+)$", 1).cast("long").alias("doc_id"), F.lit("published").alias("kind"), "doi", F.col("is_final_preprint").alias("is_final"), "version", "abstract_missing"))
