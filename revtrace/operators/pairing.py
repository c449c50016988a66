"""Preprint versions, pairs of preprint and published paper, pending work."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import normalize_doi, normalize_version, parse_date, version_num
from ..functions.text import clean_text
from ..session import dealt
from ..sources.tables import visible


def to_preprint_rows(feed: DataFrame, ingested_at: Column, keep: list[str] | None = None) -> DataFrame:
    """feed(doi, source, version, published_doi, title, abstract, conclusion, authors, posted_date) -> preprint records;
    the final flag says that a published DOI is known. keep: further columns that stay."""
    pub = normalize_doi(F.col("published_doi"))
    return feed.select(
        normalize_doi(F.col("doi")).alias("doi"), "source", normalize_version(F.col("version")).alias("version"),
        pub.isNotNull().alias("is_final_preprint"), pub.alias("published_doi"), clean_text(F.col("title")).alias("title"),
        clean_text(F.col("abstract")).alias("abstract"), clean_text(F.col("conclusion")).alias("conclusion"), "authors",
        parse_date(F.col("posted_date")).alias("posted_date"), ingested_at.alias("ingested_at"), *(keep or []))


def to_published_rows(works: DataFrame, source: Column, ingested_at: Column) -> DataFrame:
    """works(doi, title, abstract, authors, published_date) -> published records. The abstract never falls back to the
    title; abstract_missing says that it is missing."""
    doi = normalize_doi(F.col("doi"))
    rows = works.select(
        doi.alias("doi"), source.alias("source"), F.lit("published").alias("version"), F.lit(False).alias("is_final_preprint"),
        doi.alias("published_doi"), clean_text(F.col("title")).alias("title"), clean_text(F.col("abstract")).alias("abstract"),
        F.lit(None).cast("string").alias("conclusion"), "authors", parse_date(F.col("published_date")).alias("posted_date"),
        ingested_at.alias("ingested_at"))
    return rows.withColumn("abstract_missing", F.col("abstract").isNull())


def eligible_pairs(preprints: DataFrame) -> DataFrame:
    """Final preprint rows with a published DOI; no published rows, no demo rows."""
    return preprints.filter(
        F.col("published_doi").isNotNull() & F.coalesce("is_final_preprint", F.lit(False))
        & ~F.col("version").eqNullSafe(F.lit("published")) & ~F.col("record_source").eqNullSafe(F.lit("demo_seed")))


def first_versions(history: DataFrame, own: DataFrame) -> DataFrame:
    """history(doi, version, type, title, authors, published, own_text), own(doi, version, text_source): per DOI whether
    the first version can be used. The lowest version must be number 1, not withdrawn, and have its own text; an own-text
    row of the library comes first. There is no fallback to a later version."""
    num = version_num(F.col("version"))
    h = history.withColumn("n", num)
    label = F.concat(F.lit("v"), F.regexp_replace(F.col("version").cast("string"), "^v", ""))
    facts = h.groupBy("doi").agg(
        F.min_by(F.struct("n", "type", "title", "authors", "own_text"), F.col("n")).alias("first"),
        F.max_by("published", "n").alias("published_doi"),
        F.array_sort(F.collect_list(F.struct("n", label.alias("v"), (F.lower("type") == "withdrawn").alias("gone")))).alias("vs"))
    mine = (own.filter(~F.col("version").eqNullSafe(F.lit("published"))).withColumn("n", num).groupBy("doi")
            .agg(F.min_by(F.struct("n", "text_source"), F.col("n")).alias("o")))
    j = facts.join(mine, "doi", "full_outer")
    in_library = F.coalesce((F.col("o.n") == 1) & (F.col("o.text_source") == "jats"), F.lit(False))
    usable = F.coalesce((F.col("first.n") == 1) & (F.lower(F.coalesce("first.type", F.lit(""))) != "withdrawn")
                        & (F.coalesce("first.own_text", F.lit("")) != ""), F.lit(False))
    return j.select(
        "doi", F.when(in_library, "library").when(usable, "own_text").alias("source_of_v1"),
        F.col("first.title").alias("title"),
        F.trim(F.substring_index(F.substring_index("first.authors", ",", 1), ";", 1)).alias("first_author"),
        F.lower("published_doi").alias("published_doi"), F.transform("vs", lambda v: v["v"]).alias("versions"),
        F.transform(F.filter("vs", lambda v: v["gone"]), lambda v: v["v"]).alias("withdrawn_versions"))


def unpaired(preprints: DataFrame, source: str | None = None, n: int = 25) -> DataFrame:
    """Rows still without a published DOI, oldest ingest first, missing dates last."""
    rows = preprints.filter(
        F.col("doi").isNotNull() & F.col("published_doi").isNull() & ~F.col("version").eqNullSafe(F.lit("published"))
        & ~F.col("record_source").eqNullSafe(F.lit("demo_seed")))
    if source:
        rows = rows.filter(F.col("source") == source)
    return rows.orderBy(F.asc_nulls_last("ingested_at"), "doi", "version").limit(n)


def pair_published(candidates: DataFrame, crossref: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """candidates(doi, source, ...), crossref(doi, published_doi, title, abstract, authors, published_date) -> pairs
    (preprint DOI, source, published DOI), published rows to write, DOIs without a match. A published row without a record
    of its own is made from the matched one."""
    known = crossref.filter(F.col("published_doi").isNotNull()).select("doi", "published_doi", "title", "abstract", "authors", "published_date")
    j = candidates.select("doi", "source").join(known, "doi")
    pairs = j.select(F.col("doi").alias("preprint_doi"), F.coalesce("source", F.lit("unknown")).alias("preprint_source"), "published_doi")
    record = crossref.select(F.col("doi").alias("published_doi"), *[F.col(c).alias(f"r_{c}") for c in ("title", "abstract", "authors", "published_date")],
                             F.lit(True).alias("has_record"))
    p = j.join(record, "published_doi", "left")
    own = lambda c: F.when(F.col("has_record"), F.col(f"r_{c}")).otherwise(F.col(c)).alias(c)
    works = p.select(F.col("published_doi").alias("doi"), F.coalesce("source", F.lit("unknown")).alias("source"),
                     own("title"), own("abstract"), own("authors"), own("published_date"))
    published = to_published_rows(works, F.col("source"), F.current_timestamp().cast("string"))
    missing = candidates.select("doi").join(known.select("doi"), "doi", "left_anti")
    return pairs, published, missing


def pending_pairs(preprints: DataFrame, events: DataFrame) -> DataFrame:
    """Eligible pairs without an event, compared in lower case."""
    done = events.select(F.lower("preprint_doi").alias("_a"), F.lower("published_doi").alias("_b"))
    p = eligible_pairs(preprints).withColumn("_a", F.lower("doi")).withColumn("_b", F.lower("published_doi"))
    return p.join(done, ["_a", "_b"], "left_anti").drop("_a", "_b")


def oldest_pending(preprints: DataFrame, events: DataFrame) -> DataFrame:
    return pending_pairs(preprints, events).filter("ingested_at IS NOT NULL").orderBy("ingested_at", "doi").limit(1)


def analysability(dois: DataFrame, history: DataFrame, fulltext: DataFrame) -> DataFrame:
    """dois(doi), history(doi, version, type, published), fulltext(doi, pmcid): the first status that holds."""
    h = history.withColumn("n", version_num(F.col("version"))).groupBy("doi").agg(
        F.min_by(F.struct("n", "type"), F.col("n")).alias("f"), F.max_by("published", "n").alias("published"))
    ft = fulltext.filter("pmcid IS NOT NULL").select(F.lower("doi").alias("published_doi"), F.lit(True).alias("open")).distinct()
    no_v1 = (F.col("f.n") != 1) | (F.lower(F.coalesce("f.type", F.lit(""))) == "withdrawn")
    j = (dois.select(F.lower("doi").alias("doi")).join(h.withColumn("doi", F.lower("doi")), "doi", "left")
         .withColumn("published_doi", F.nullif(F.lower("published"), F.lit(""))).join(ft, "published_doi", "left"))
    status = (F.when(F.col("f").isNull(), "doi_not_found").when(no_v1, "v1_unavailable")
              .when(F.col("published_doi").isNull(), "not_published_yet").when(F.col("open").isNull(), "no_open_full_text").otherwise("ready"))
    return j.select("doi", status.alias("status"), "published_doi")


def event_bundle(events: DataFrame, claims: DataFrame, citations: DataFrame, notices: DataFrame, runs: DataFrame) -> DataFrame:
    """Per event its claims (ids named in its changes), and counts of citations, notices and runs; every event stays."""
    ids = events.select("event_id", F.explode_outer(F.array_distinct(F.array_compact(F.flatten(F.transform(
        "claim_diffs", lambda d: F.array(d["preprint_claim_id"], d["published_claim_id"])))))).alias("claim_id"))
    named = ids.join(claims.select("claim_id", "text"), "claim_id").groupBy("event_id").agg(
        F.array_sort(F.collect_list(F.struct("claim_id", "text"))).alias("claims"))

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col("drift_event_id").alias("event_id")).agg(F.count("*").alias(name))

    out = events.join(named, "event_id", "left")
    for df, name in ((citations, "n_citations"), (notices, "n_notices"), (runs, "n_runs")):
        out = out.join(count(df, name), "event_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def event_parts(events: DataFrame, citations: DataFrame, notices: DataFrame, runs: DataFrame,
                include_demo: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows behind the counts of event_bundle: visible citations, notices and runs of the visible events, with all their columns."""
    ids = visible(events, include_demo).select(F.col("event_id").alias("drift_event_id"))
    parts = dealt("drift_event_id", ids, *(visible(df, include_demo) for df in (citations, notices, runs)))
    return tuple(part.join(parts[0], "drift_event_id", "left_semi") for part in parts[1:])


def citation_detail(citations: DataFrame, events: DataFrame) -> DataFrame:
    """A citation with the change it concerns; both stay null when the event or the change is not there."""
    e = events.select(F.col("event_id").alias("drift_event_id"), "drift_summary", "claim_diffs")
    return (citations.join(e, "drift_event_id", "left").withColumn("claim_diff", F.get("claim_diffs", F.col("claim_diff_idx")))
            .drop("claim_diffs"))


def rerun_due(runs: DataFrame, days: int, today: Column) -> DataFrame:
    """Latest done, queued or running run per target; due when it is done and was checked up to `days` ago or earlier. The
    next run starts at that date."""
    live = runs.filter(F.col("status").isin("done", "queued", "running"))
    last = W.partitionBy("target_id").orderBy(F.desc_nulls_last("queued_at"), F.desc("run_id"))
    newest = live.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn")
    due = (F.col("status") == "done") & (F.col("checked_until") <= F.date_sub(today, days))
    return newest.filter(due).withColumn("since", F.col("checked_until"))


def claimable(runs: DataFrame, now: Column, minutes: int = 30, n: int = 5) -> DataFrame:
    """Queued runs, and running ones without a step (or start) for the given time; oldest queued first."""
    limit = now - F.make_interval(mins=F.lit(minutes))
    stale = F.when(F.col("step_at").isNotNull(), F.col("step_at") < limit).otherwise(F.col("started_at") < limit)
    return (runs.filter((F.col("status") == "queued") | ((F.col("status") == "running") & stale))
            .orderBy(F.asc_nulls_last("queued_at"), "run_id").limit(n))
