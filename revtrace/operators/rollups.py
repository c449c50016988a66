"""Roll-ups: dashboard, counts per class, run state, coverage, ingest and self-check summaries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import CITES, STRENGTH_ORDER
from ..sources.tables import visible

MAX_WORKER_PAPERS = 120


def _measures(df: DataFrame | None, **wanted: tuple[str, Column] | None) -> list[Column]:
    """Measures of one table; 0 where the column they need is missing."""
    out = []
    for name, need in wanted.items():
        if need is None:
            out.append(F.count("*").alias(name))
        elif df is not None and need[0] in df.columns:
            out.append(F.coalesce(need[1], F.lit(0)).alias(name))
        else:
            out.append(F.lit(0).cast("long").alias(name))
    return out


def dashboard_stats(events: DataFrame | None, citations: DataFrame | None, log: DataFrame | None, include_demo: bool = False) -> DataFrame:
    """One row of nine measures over visible rows. A missing table or column gives 0, not a failure."""
    def one_row(df: DataFrame | None, **wanted) -> DataFrame | None:
        return None if df is None else visible(df, include_demo).agg(*_measures(df, **wanted))

    status = lambda v: ("review_status", F.count_if(F.col("review_status") == v))
    parts = [
        one_row(events, drift_events_total=None,
                high_severity_count=("materiality_score", F.count_if(F.col("materiality_score") >= 0.7)),
                avg_materiality_score=("materiality_score", F.avg("materiality_score")),
                e_pending=status("pending"), e_confirmed=status("approved")),
        one_row(citations, affected_citations_total=None, c_pending=status("pending"), c_confirmed=status("approved"),
                superseded_citations_total=("cites", F.count_if(F.col("cites") == "superseded"))),
        one_row(log, notifications_total=None, notifications_sent=("status", F.count_if(F.col("status") == "sent"))),
    ]
    row = None
    for p in parts:
        if p is not None:  # each part is one row
            row = p if row is None else row.join(F.broadcast(p))
    get = lambda c: F.col(c) if row is not None and c in row.columns else F.lit(0).cast("long")
    return row.select(
        get("drift_events_total").alias("drift_events_total"), get("high_severity_count").alias("high_severity_count"),
        get("avg_materiality_score").cast("double").alias("avg_materiality_score"),
        get("affected_citations_total").alias("affected_citations_total"), get("notifications_total").alias("notifications_total"),
        get("notifications_sent").alias("notifications_sent"),
        (get("e_pending") + get("c_pending")).alias("review_pending_total"),
        (get("e_confirmed") + get("c_confirmed")).alias("human_confirmed_total"),
        get("superseded_citations_total").alias("superseded_citations_total"))


def verdict_counts(citations: DataFrame, by: str) -> DataFrame:
    """Rows per class in fixed order, with indirect + unclear and pending rows."""
    per = [F.count_if(F.col("cites") == c).alias(f"n_{c}") for c in CITES]
    return citations.groupBy(by).agg(
        *per, F.count_if(F.col("cites").isin("indirect", "unclear")).alias("n_uncertain"),
        F.count_if(F.col("review_status") == "pending").alias("n_pending"))


def notice_counts(log: DataFrame, by: str) -> DataFrame:
    return log.groupBy(by).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("sent", "drafted", "skipped", "failed")])


def rollup_runs(runs: DataFrame, citations: DataFrame) -> DataFrame:
    """Run state per event: running, else failed, else done; superseded count; complete when every done run is."""
    r = runs.groupBy("drift_event_id").agg(
        F.bool_or(F.col("status").isin("queued", "running")).alias("active"), F.bool_or(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.every(F.when(F.col("status") == "done", F.coalesce("coverage_complete", F.lit(False)))), F.lit(True)).alias("coverage_complete"),
        F.array_sort(F.collect_set("run_id")).alias("run_ids"))
    c = citations.groupBy("drift_event_id").agg(F.count_if(F.col("cites") == "superseded").alias("n_superseded"))
    status = F.when(F.col("active"), "running").when(F.col("failed"), "failed").otherwise("done")
    return r.join(c, "drift_event_id", "left").select(
        "drift_event_id", status.alias("status"), F.coalesce("n_superseded", F.lit(0)).alias("n_superseded"), "coverage_complete", "run_ids")


def coverage(stats: DataFrame, unjudged: DataFrame, capacity: int = MAX_WORKER_PAPERS) -> DataFrame:
    """stats(run_id, hit_count, fetched, search_truncated, matching, screen_capped, screen_limit, later_truncated
    array<string>, download_failed, no_open_full_text, candidates), unjudged(run_id, work_id, dispatched) -> counts,
    notes in order, truncated, complete."""
    u = unjudged.groupBy("run_id").agg(F.count("*").alias("unjudged"), F.count_if(~F.col("dispatched")).alias("cut"))
    j = stats.join(u, "run_id", "left").fillna(0, ["unjudged", "cut"])
    say = lambda cond, fmt, *cols: F.when(cond, F.format_string(fmt, *[F.col(c) for c in cols]))
    later = F.transform("later_truncated", lambda x: F.concat(
        F.lit("The search of "), x, F.lit(" hit the page limit; part of its results was not examined.")))
    head = F.array_compact(F.array(
        say(F.col("search_truncated"), "Europe PMC reported %d citing papers containing the old value, but only the first %d could be "
            "retrieved (page limit); the rest were not examined.", "hit_count", "fetched"),
        say(F.col("screen_capped") > 0, "%d of %d matching papers were not screened (limit %d per run; papers citing the preprint and "
            "older papers were screened first).", "screen_capped", "matching", "screen_limit")))
    j = j.withColumn("silent", F.col("unjudged") - F.col("cut"))
    tail = F.array_compact(F.array(
        say(F.col("cut") > 0, f"%d candidate(s) were not judged: the run's worker capacity ({capacity} papers) was used up.", "cut"),
        say(F.col("silent") > 0, "%d candidate(s) were sent to a worker but got no verdict.", "silent"),
        say(F.col("download_failed") > 0, "%d matching paper(s) had no downloadable full text and could not be read.", "download_failed"),
        say(F.col("no_open_full_text") > 0, "%d citing paper(s) matched only in metadata without an open full text in Europe PMC "
            "(outside the method's reach).", "no_open_full_text")))
    truncated = F.col("search_truncated") | (F.col("screen_capped") > 0) | (F.size("later_truncated") > 0) | (F.col("unjudged") > 0)
    return j.select("run_id", "candidates", (F.col("candidates") - F.col("unjudged")).alias("judged"), "unjudged",
                    F.concat(head, later, tail).alias("notes"), truncated.alias("truncated"),
                    (~truncated & (F.col("unjudged") == 0)).alias("coverage_complete"))


def coverage_panel(runs: DataFrame) -> DataFrame:
    """Per event over its incomplete runs: unjudged papers (the list's size where the count is missing), the flat list,
    the distinct notes in order of first appearance; whether any run is active."""
    partial = ~F.coalesce("coverage_complete", F.lit(False)) & (F.col("status") == "done")
    r = runs.groupBy("drift_event_id").agg(
        F.sum(F.when(partial, F.coalesce("n_unjudged", F.size("unjudged").cast("long"))).otherwise(0)).alias("n_unjudged"),
        F.array_sort(F.collect_list(F.when(partial, F.struct("run_id", F.col("unjudged").alias("u"), F.col("coverage_notes").alias("c"))))).alias("p"),
        F.bool_or(F.col("status").isin("queued", "running")).alias("active"))
    return r.select("drift_event_id", "n_unjudged", F.flatten(F.transform("p", lambda x: F.coalesce(x["u"], F.array().cast("array<string>")))).alias("unjudged"),
                    F.array_distinct(F.flatten(F.transform("p", lambda x: F.coalesce(x["c"], F.array().cast("array<string>"))))).alias("notes"), "active")


def sum_maps(df: DataFrame, keys: list[str], map_col: str) -> DataFrame:
    """Counter maps added key by key. Keys meet in a partial sum before any map is built again."""
    flat = df.select(*keys, F.explode(map_col).alias("k", "v")).groupBy(*keys, "k").agg(F.sum("v").alias("v"))
    return flat.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(map_col))


def merge_verdicts(verdicts: DataFrame, unjudged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """verdicts(paper_id, target_no, work_id, cites, ...): the strongest class per work over a paper's targets, the first
    target on ties. Works of unjudged(paper_id, work_id) count only when judged for no target."""
    rank = F.array_position(F.array(*[F.lit(c) for c in STRENGTH_ORDER]), F.col("cites"))
    rest = [c for c in verdicts.columns if c not in ("paper_id", "work_id")]
    best = verdicts.groupBy("paper_id", "work_id").agg(F.min_by(F.struct(*rest), F.struct(rank, "target_no")).alias("b"))
    best = best.select("paper_id", "work_id", "b.*")
    left = unjudged.select("paper_id", "work_id").distinct().join(best, ["paper_id", "work_id"], "left_anti")
    return best, left


def ingest_summary(rows: DataFrame, mode: str) -> DataFrame:
    """rows(source, doc_key, ok, error): per source fetched, skipped, upserted or would-upsert, errors."""
    keep = F.count_if("ok")
    return rows.groupBy("source").agg(
        F.lit(mode).alias("mode"), keep.alias("fetched"), F.count_if(~F.col("ok")).alias("skipped"),
        (keep if mode == "apply" else F.lit(0).cast("long")).alias("upserted"),
        (F.lit(0).cast("long") if mode == "apply" else keep).alias("would_upsert"), F.count("error").alias("errors"))


def library_counts(preprints: DataFrame, events: DataFrame) -> DataFrame:
    """Real preprint rows, real pairs, and pairs still waiting for an event."""
    from .pairing import eligible_pairs, pending_pairs
    real = preprints.filter(~F.col("record_source").eqNullSafe(F.lit("demo_seed")) & ~F.col("version").eqNullSafe(F.lit("published")))
    n1 = real.agg(F.count("*").alias("preprint_rows"))
    n2 = eligible_pairs(preprints).agg(F.count("*").alias("pairs"))
    n3 = pending_pairs(preprints, events).agg(F.count("*").alias("waiting"))
    return n1.join(F.broadcast(n2)).join(F.broadcast(n3))


def count_by_source(preprints: DataFrame, n: int = 10) -> DataFrame:
    return preprints.groupBy("source").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "source").limit(n)


def sentence_summary(results: DataFrame) -> DataFrame:
    """results(sentence_id, match, any_old): matched, unmatched, sentences using an old value."""
    return results.agg(F.count_if("any_old").alias("uses_old_value"), F.count_if(F.col("match") != "no_match").alias("matched"),
                       F.count_if(F.col("match") == "no_match").alias("no_match"))


def reference_summary(results: DataFrame) -> DataFrame:
    """results(status, doi, fulltext_tier, needs_confirmation) -> seven counters; missing preprints count once per DOI."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    found = F.col("status") == "drift_found"
    return results.agg(
        is_("drift_found").alias("drift_found"),
        F.count_if(found & F.col("fulltext_tier").isin("significant", "major")).alias("significant_or_major"),
        F.count_if(F.coalesce("needs_confirmation", F.lit(False))).alias("needs_confirmation"),
        F.count_distinct(F.when(F.col("status") == "not_in_library", F.col("doi"))).alias("not_in_library"),
        is_("not_tracked").alias("not_tracked"), is_("no_match").alias("no_match"), is_("skipped").alias("skipped"))


def run_progress(states: DataFrame) -> DataFrame:
    """states(run_id, phase, screened, pending, candidates, judged, turns) -> progress fields and a text line."""
    s, p, c, j = (F.coalesce(x, F.lit(0)) for x in ("screened", "pending", "candidates", "judged"))
    line = (
        F.when(F.col("phase") == "prescreen", F.format_string("pre-screen: %d/%d full texts screened, %d candidate(s)", s, s + p, c))
        .when(F.col("phase") == "orchestrate", F.format_string("orchestrator turn %d: %d candidate(s), %d judged", F.coalesce("turns", F.lit(0)), c, j))
        .when(F.col("phase") == "overflow", F.format_string("orchestrator finished: %d candidate(s), %d judged", c, j))
        .when(F.col("phase") == "verify", F.format_string("overflow judged: %d/%d", j, c))
        .when(F.col("phase") == "done", F.lit("verification done")).otherwise(F.lit("")))
    return states.select("run_id", "phase", s.alias("screened"), (s + p).alias("to_screen"), c.alias("candidates"), j.alias("judged"),
                         F.coalesce("turns", F.lit(0)).alias("orchestrator_turns"), line.alias("line"))


def run_summary(targets: DataFrame, results: DataFrame, max_targets: int | None = None, max_alerts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """targets(event_id, target_id, target_no, candidates, judged), results(target_id, work_no, work_id, cites) -> per
    event: targets, traced, skipped, candidates, judged, works relying on an old value; and those to alert. The limits, if given, leave out later targets and alerts."""
    w = W.partitionBy("event_id").orderBy("target_no")
    t = targets.withColumn("_rn", F.row_number().over(w)).withColumn("traced", F.lit(True) if max_targets is None else F.col("_rn") <= max_targets)
    relying = (results.filter(F.col("cites").isin("superseded", "indirect"))
               .join(t.filter("traced").select("event_id", "target_id", "target_no"), "target_id"))
    n = relying.groupBy("event_id").agg(F.count("*").alias("n_affected"))
    per = t.groupBy("event_id").agg(
        F.count("*").alias("n_targets"), F.count_if("traced").alias("traced"), F.count_if(~F.col("traced")).alias("skipped"),
        F.sum(F.when(F.col("traced"), F.col("candidates")).otherwise(0)).alias("candidates"),
        F.sum(F.when(F.col("traced"), F.col("judged")).otherwise(0)).alias("judged"))
    order = W.partitionBy("event_id").orderBy("target_no", "work_no")
    alerts = relying.withColumn("lane", F.row_number().over(order) - 1)
    if max_alerts is not None:
        alerts = alerts.filter(F.col("lane") < max_alerts)
    alerts = alerts.select("event_id", "lane", "target_id", "work_id")
    return per.join(n, "event_id", "left").withColumn("n_affected", F.coalesce("n_affected", F.lit(0))), alerts
