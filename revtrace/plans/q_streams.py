"""Queries of scans of landed files and of the streaming operators. Files are derived from the given tables first."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_dir, written
from ..sources import scans
from ..streaming import dispatch, events, ingest
from .book import Book
from .views import load, view, with_views

Q = Book()


def folder(spark, name):
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def land(spark, df, name):
    """One JSON text per row into files."""
    path = folder(spark, name)
    df.write.text(path)
    return path


def feed_pages(spark, sf):
    """The versions of a preprint as one landed page, one line per page, with a record without DOI and one twice."""
    p = view(spark, sf, "preprints")
    rec = F.struct(F.concat(F.lit("https://doi.org/"), F.upper("doi")).alias("doi"), F.lit("A <b>title</b>").alias("title"), F.lit("Li Q; Wu J").alias("authors"), F.lit("text").alias("abstract"),
                   F.regexp_replace("version", "v", "").alias("version"), F.coalesce("published_doi", F.lit("NA")).alias("published"), F.lit("2020-01-02").alias("date"), "type")
    g = p.groupBy("doi").agg(F.array_sort(F.collect_list(rec)).alias("r"))
    extra = F.array(F.get("r", F.lit(0)), F.get("r", F.lit(0)).withField("doi", F.lit("")))
    return g.select(F.to_json(F.struct(F.concat("r", extra).alias("collection"))).alias("value"))


@Q.add("version_feed", with_views("preprints") + " SELECT doi, substr(version, 2) AS version, lower(published_doi) AS published_doi, type FROM preprints")
def version_feed(spark, sf):
    path = land(spark, feed_pages(spark, sf).repartition(8), "feed")
    rows, _ = scans.read_version_feed(spark, path, "biorxiv", multi_line=False)
    return rows.select("doi", "version", "published_doi", "type")


@Q.add("crossref_works", """SELECT concat('10.1101/', doc_id) AS doi, concat('Part one ', lang) AS title, concat('Ann ', source, '|Lee') AS authors, 'Uni A; Uni B' AS affiliation,
  CASE doc_id % 3 WHEN 0 THEN concat('10.1016/p', doc_id) WHEN 1 THEN concat('10.1016/q', doc_id) ELSE NULL END AS published_doi, '2020|3' AS published_date FROM documents""")
def crossref_works(spark, sf):
    rel = F.expr("""CASE doc_id % 3 WHEN 0 THEN concat('"is-preprint-of": {"id": "10.1016/P', doc_id, '"}') WHEN 1 THEN concat('"x-is-preprint-of": [{"id": " "}, {"id": "https://doi.org/10.1016/q', doc_id, '"}]')
      ELSE '"cites": {"id": "10.1/x"}' END""")
    text = F.concat(F.lit('{"message": {"DOI": "10.1101/'), "doc_id", F.lit('", "title": ["Part one", "'), "lang", F.lit('"], "author": [{"given": "Ann", "family": "'), "source",
                    F.lit('", "affiliation": [{"name": "Uni A"}, {"name": ""}, {"name": "Uni B"}]}, {"family": "Lee"}, {"ORCID": "x"}], "relation": {'), rel, F.lit('}, "issued": {"date-parts": [[2020, 3]]}}}'))
    path = land(spark, load(spark, sf, "documents").select(text.alias("value")), "works")
    m = scans.crossref_rows(spark.read.schema(scans.WORK_SCHEMA).json(path))
    return m.select("doi", "title", F.array_join(F.transform("authors", lambda a: a["name"]), "|").alias("authors"), F.get("authors", F.lit(0))["affiliation"].alias("affiliation"), "published_doi",
                    F.array_join(F.transform("published_date", lambda x: x.cast("string")), "|").alias("published_date"))


@Q.add("citing_works", """SELECT concat('10.5555/w', doc_id) AS citing_paper_doi, CASE WHEN doc_id % 2 = 0 THEN 'T' ELSE 'D' END AS citing_paper_title, CAST(1 AS BIGINT) AS n_authors FROM documents WHERE doc_id % 5 <> 0""")
def citing_works(spark, sf):
    work = F.concat(F.lit('{"id": "W'), "doc_id", F.lit('", "doi": '), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit('"https://doi.org/10.5555/W'), "doc_id", F.lit('"'))).otherwise(F.lit("null")),
                    F.when(F.col("doc_id") % 2 == 0, F.lit(', "title": "T"')).otherwise(F.lit(', "display_name": "D"')), F.lit(', "authorships": [{"author": {"display_name": "A B"}}, {"author": {}}]}'))
    pages = load(spark, sf, "documents").withColumn("w", work).groupBy((F.col("doc_id") % 50).alias("p")).agg(F.array_join(F.collect_list("w"), ", ").alias("ws"))
    path = land(spark, pages.select(F.concat(F.lit('{"results": ['), "ws", F.lit("]}")).alias("value")), "citing")
    rows, _ = scans.citing_rows(spark.read.schema(scans.CITING_SCHEMA).json(path))
    return rows.select("citing_paper_doi", "citing_paper_title", F.size("citing_paper_authors").cast("long").alias("n_authors"))


@Q.add("literature_hits", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('PMC', doc_id) WHEN doc_id % 3 = 1 THEN concat('PPR', doc_id) END AS work_id, text AS title, CASE WHEN doc_id % 2 = 0 THEN '2020-01-01' ELSE '2019' END AS date,
  CASE WHEN doc_id % 4 = 0 THEN 'J One' WHEN doc_id % 4 = 1 THEN 'J1' WHEN doc_id % 3 = 1 THEN 'preprint' END AS journal, concat('10.1/x', doc_id) AS doi FROM documents""")
def literature_hits(spark, sf):
    r = load(spark, sf, "documents").selectExpr(
        "concat(CASE WHEN doc_id % 3 = 1 THEN 'PPR' ELSE 'MED' END, doc_id) AS id", "CASE WHEN doc_id % 3 = 1 THEN 'PPR' ELSE 'MED' END AS source", "CASE WHEN doc_id % 3 = 0 THEN concat('PMC', doc_id) END AS pmcid", "text AS title",
        "CASE WHEN doc_id % 2 = 0 THEN '2020-01-01' END AS firstPublicationDate", "'2019' AS pubYear", "CASE WHEN doc_id % 4 = 0 THEN 'J One' END AS journalTitle", "CASE WHEN doc_id % 4 = 1 THEN 'J1' END AS journalAbbreviation",
        "'A B' AS authorString", "concat('10.1/X', doc_id) AS doi")
    path = land(spark, r.select(F.to_json(F.struct(F.struct(F.array(F.struct(*r.columns)).alias("result")).alias("resultList"))).alias("value")), "hits")
    h = scans.lit_hits(spark.read.schema(scans.HIT_SCHEMA).json(path).select(F.explode("resultList.result").alias("r")).select("r.*"))
    return h.select(F.regexp_extract("doi", r"(\d+)$", 1).cast("long").alias("doc_id"), "work_id", "title", "date", "journal", "doi")


@Q.add("seed_rows", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'case_bank' ELSE 'demo_seed' END AS record_source FROM orders")
def seed_rows(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "case_bank").alias("record_source"))
    pages = o.groupBy((F.col("o_orderkey") % 40).alias("p")).agg(F.to_json(F.collect_list(F.struct("o_orderkey", "record_source"))).alias("value")).select("value")
    path = land(spark, pages, "seed")
    return scans.seed_rows(spark.read.schema("o_orderkey bigint, record_source string").json(path))


ARTICLE = """concat('<article><front><article-title>T ', doc_id, '</article-title><abstract><title>Background</title><p>We saw ', doc_id, '.</p></abstract></front><body><p>Loose.</p><sec><title>Methods</title><p>Own <b>text</b> ', doc_id,
  '</p><sec><title>Sub</title><p>Deep</p></sec><table-wrap><label>Table 1</label><caption>Cap</caption><table><tr><td>a</td><td>', lang, '</td></tr></table></table-wrap></sec></body></article>')"""


@Q.add("article_units", """SELECT CAST(doc_id AS VARCHAR) AS doc_key, concat('T ', doc_id) AS doc_title, CAST(i AS INTEGER) AS unit_no, CASE i WHEN 0 THEN 'abstract' WHEN 4 THEN 'table' ELSE 'section' END AS kind,
  ['Abstract', 'Body', 'Methods', 'Methods > Sub', 'Table 1'][i + 1] AS title, [concat('Background We saw ', doc_id, '.'), 'Loose.', concat('Own text ', doc_id), 'Deep', concat('Cap', chr(10), 'a | ', lang)][i + 1] AS text FROM documents, unnest(range(5)) AS u(i)""")
def article_units(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.expr(ARTICLE).alias("xml"))
    return scans.parse_articles(d, "doc_id", "xml").drop("error")


TABLE = """concat('<p>x</p><table-wrap id="t"><label>Table 2</label><caption><title>Liver &amp; ', lang, '</title></caption><table><thead><tr><th>Study</th><th>N</th></tr></thead><tbody><tr><td>Fan</td><td> ', doc_id,
  ' </td></tr><tr><td> </td><td></td></tr><tr><td>Cai</td><td>44</td></tr></tbody></table></table-wrap><table-wrap><table><tr><td>Head</td></tr><tr><td>R', doc_id, '</td></tr></table></table-wrap>')"""


@Q.add("table_rows", """SELECT doc_id, 0 AS table_no, 0 AS row_no, concat('Fan | ', doc_id) AS sentence, concat('Table 2 Liver & ', lang, ' Study | N') AS context FROM documents
  UNION ALL SELECT doc_id, 0, 2, 'Cai | 44', concat('Table 2 Liver & ', lang, ' Study | N') FROM documents UNION ALL SELECT doc_id, 1, 0, concat('R', doc_id), 'Head' FROM documents""")
def table_rows(spark, sf):
    return scans.table_rows(load(spark, sf, "documents").select("doc_id", F.expr(TABLE).alias("xml")), "xml", ["doc_id"])


@Q.add("ingest_stream", with_views("preprints") + " SELECT doi, version, lower(published_doi) AS published_doi, published_doi IS NOT NULL AS is_final FROM preprints")
def ingest_stream(spark, sf):
    src = folder(spark, "pages")
    feed_pages(spark, sf).repartition(200, "value").write.text(src)
    sink = folder(spark, "log")
    q = ingest.ingest_stream(spark, src, "biorxiv", sink, folder(spark, "ckpt"), multi_line=False)
    q.awaitTermination()
    return ingest.latest(spark, sink).select("doi", "version", "published_doi", F.col("is_final_preprint").alias("is_final"))


def requests(spark, sf):
    o = load(spark, sf, "orders").filter("o_custkey IS NOT NULL")
    return o.select(F.col("o_orderkey").cast("long").alias("request_no"), F.concat(F.lit("10.1101/"), "o_custkey").alias("preprint_doi"), F.concat(F.lit("10.1016/p"), "o_custkey").alias("published_doi"),
                    (F.col("o_orderkey") % 10 == 0).alias("force"))


DISPATCH_SQL = """r AS (SELECT o_orderkey AS no, o_custkey AS p, o_orderkey % 10 = 0 AS force, o_custkey % 4 = 1 AS done, o_custkey % 6 = 2 AS bad FROM orders),
  c AS (SELECT *, CASE WHEN done AND NOT force THEN 'already_processed' WHEN bad THEN 'not_analysable' ELSE 'enqueued' END AS outcome FROM r),
  f AS (SELECT p, min(no) AS no FROM c WHERE outcome = 'enqueued' GROUP BY 1), l AS (SELECT no FROM f ORDER BY no LIMIT 300), k AS (SELECT CASE WHEN count(*) = 300 THEN max(no) END AS last FROM l)"""


@Q.add("dispatch_outcomes", "WITH " + DISPATCH_SQL + " SELECT CAST(no AS BIGINT) AS request_no, CASE WHEN last IS NOT NULL AND no > last THEN 'paused_budget_exhausted' ELSE outcome END AS outcome FROM c, k")
def dispatch_outcomes(spark, sf):
    c = load(spark, sf, "customer")
    ev = c.filter("c_custkey % 4 = 1").select(F.concat(F.lit("10.1101/"), "c_custkey").alias("preprint_doi"), F.concat(F.lit("10.1016/P"), "c_custkey").alias("published_doi"))
    st = c.filter("c_custkey % 6 = 2").select(F.concat(F.lit("10.1101/"), "c_custkey").alias("preprint_doi"), F.lit("not_published_yet").alias("status"))
    none = spark.createDataFrame([], "pair_key string")
    return dispatch.dispatch_batch(requests(spark, sf), ev, st, none, 300).select("request_no", "outcome")


@Q.add("dispatch_stream", "WITH " + DISPATCH_SQL + " SELECT CAST(no AS BIGINT) AS request_no, CASE WHEN last IS NOT NULL AND no > last THEN 'paused_budget_exhausted' ELSE outcome END AS outcome FROM c, k")
def dispatch_stream(spark, sf):
    """The same requests in five files, in order, one for each micro-batch."""
    c = load(spark, sf, "customer")
    ev = c.filter("c_custkey % 4 = 1").select(F.concat(F.lit("10.1101/"), "c_custkey").alias("preprint_doi"), F.concat(F.lit("10.1016/P"), "c_custkey").alias("published_doi"))
    st = c.filter("c_custkey % 6 = 2").select(F.concat(F.lit("10.1101/"), "c_custkey").alias("preprint_doi"), F.lit("not_published_yet").alias("status"))
    r, src, out = requests(spark, sf), folder(spark, "requests"), folder(spark, "outcomes")
    top = r.agg(F.max("request_no")).first()[0]
    for i in range(5):
        r.filter((F.col("request_no") > (top * i // 5 if i else -1)) & (F.col("request_no") <= top * (i + 1) // 5)).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(src)
    dispatch.dispatch_stream(s, ev, st, out, folder(spark, "ckpt"), 300).awaitTermination()
    return spark.read.option("basePath", out).parquet(out).select("request_no", "outcome")


@Q.add("pair_stream", with_views("preprints") + " SELECT row_no, doi FROM preprints WHERE published_doi IS NOT NULL AND is_final_preprint AND version <> 'published' AND record_source IS DISTINCT FROM 'demo_seed'")
def pair_stream(spark, sf):
    src, out = folder(spark, "preprints"), folder(spark, "pairs")
    p = view(spark, sf, "preprints")
    p.repartition(6).write.parquet(src)
    s = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 2).parquet(src)
    q = dispatch.pair_stream(s).writeStream.format("parquet").option("checkpointLocation", folder(spark, "ckpt")).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(p.schema).parquet(out).select("row_no", "doi")


def agent_events(spark, sf):
    """Conversation turns as agent events: calls, replies, final texts, errors."""
    agents = F.array(*[F.lit(a) for a in [*events.AGENTS, "supervisor"]])
    m = F.col("turn") % 4
    reply = '{"results": [{"type": "query"}, {"type": "esql_results", "data": {"columns": [{"name": "pattern_id"}, {"name": "_score"}], "values": [["p1", "0.5"], [null, "1"]]}}]}'
    part = F.struct(F.when(m == 0, "search").alias("call_name"), F.when(m == 0, '{"q": 1}').alias("call_args"), F.when(m == 1, events.SEARCH_TOOL).alias("response_name"), F.when(m == 1, reply).alias("response_text"),
                    F.when(m == 2, F.lit('```json\n{"claims": [1, 2], "claim_diffs": [1], "total_found": 4, "action": "kept"}\n```')).when(m == 3, "thinking aloud").alias("text"))
    return load(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("event_no"), F.get(agents, (F.col("conv_id") % 6).cast("int")).alias("author"), F.concat(F.lit("inv"), F.floor(F.col("conv_id") / 2)).alias("invocation_id"),
        (F.lit(1767225600.0) + F.col("conv_id")).alias("timestamp"), F.when(F.col("turn") == 5, "E1").alias("error_code"), F.lit(None).cast("string").alias("error_message"), F.array(part).alias("parts"))


@Q.add("event_translation", """WITH e AS (SELECT conv_id * 1000 + turn AS no, ['claim_extractor', 'drift_analyzer', 'citation_finder', 'notifier', 'memory_synthesizer', 'supervisor'][conv_id % 6 + 1] AS a, floor(conv_id / 2) AS inv, turn, conv_id FROM conversations WHERE conv_id % 6 <> 5)
  SELECT min(no) AS event_no, 'agent.started' AS event_type, a AS agent_id, NULL AS summary FROM e GROUP BY a, inv
  UNION ALL SELECT no, CASE WHEN turn = 5 THEN 'agent.failed' WHEN turn % 4 = 0 THEN 'agent.tool_call' WHEN turn % 4 = 1 THEN 'agent.pattern_retrieved' ELSE 'agent.completed' END, a,
   CASE WHEN turn <> 5 AND turn % 4 = 2 THEN CASE a WHEN 'claim_extractor' THEN '2 claims extracted.' WHEN 'drift_analyzer' THEN 'Drift analyzed: 1 claim diffs.' WHEN 'citation_finder' THEN '4 affected citations scored.'
    WHEN 'notifier' THEN 'Notification drafted.' ELSE 'Memory pattern kept.' END END FROM e WHERE turn = 5 OR turn % 4 <> 3""")
def event_translation(spark, sf):
    t = events.translate_events(agent_events(spark, sf))
    return t.select("event_no", "event_type", "agent_id", F.get_json_object("payload", "$.output_summary").alias("summary"))


@Q.add("event_tail", "SELECT event_id, event_type FROM events WHERE user_id = 8 AND event_id > 100 ORDER BY event_id LIMIT 200")
def event_tail(spark, sf):
    e = load(spark, sf, "events").withColumn("event_seq", F.col("event_id"))
    return events.tail(e, F.col("user_id") == 8, 100).select("event_id", "event_type")


# every user is a stream of envelopes; users that are multiples of three go on after event 100
@Q.add("tail_stream", "SELECT event_id, user_id, event_type FROM events WHERE user_id % 3 <> 0 OR event_id > 100")
def tail_stream(spark, sf):
    src, out = folder(spark, "envelopes"), folder(spark, "tail")
    e = load(spark, sf, "events").select(F.col("event_id").cast("long").alias("event_seq"), F.col("user_id").cast("long").alias("user_id"), "event_type", F.lit("notifier").alias("agent_id"))
    top = e.agg(F.max("event_seq")).first()[0]
    resume = written(e.filter("user_id % 3 = 0").select("user_id").distinct().withColumn("after_seq", F.lit(100).cast("long")), "resume")
    ckpt = folder(spark, "ckpt")
    for i in (0, 1, 1, 2):  # in order, the middle part twice; the query goes on as each part has landed
        part = e.filter((F.col("event_seq") > top * i // 3) & (F.col("event_seq") <= top * (i + 1) // 3)) if i else e.filter(F.col("event_seq") <= top // 3)
        part.write.mode("append").parquet(src)
        t = events.tail_stream(spark.readStream.schema(e.schema).parquet(src), "user_id", resume)
        t.writeStream.format("parquet").option("checkpointLocation", ckpt).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(t.schema).parquet(out).select(F.col("event_seq").alias("event_id"), "user_id", "event_type")


# sessions of steps per run; the last step of a run only counts once the watermark has passed it
@Q.add("stale_runs", """WITH s AS (SELECT user_id AS run_id, ts, event_type, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
  g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ts) AS n FROM s), x AS (SELECT run_id, max(ts) AS last_step, arg_max(event_type, ts) AS phase FROM g GROUP BY run_id, n)
  SELECT run_id, last_step, phase FROM x WHERE phase <> 'purchase' AND last_step < (SELECT max(ts) FROM events) - INTERVAL 40 MINUTE""")
def stale_runs(spark, sf):
    src, out = folder(spark, "steps"), folder(spark, "stale")
    e = load(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("step_at"), F.when(F.col("event_type") == "purchase", "done").otherwise(F.col("event_type")).alias("phase"))
    e.repartitionByRange(4, "step_at").write.parquet(src)
    s = spark.readStream.schema(e.schema).parquet(src)
    q = events.stale_runs_stream(s).writeStream.format("parquet").option("checkpointLocation", folder(spark, "ckpt")).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema("run_id bigint, last_step timestamp, stale_at timestamp, phase string").parquet(out).select("run_id", F.col("last_step").cast("timestamp_ntz").alias("last_step"), "phase")
