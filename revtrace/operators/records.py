"""Records built from parsed model output: replies, events, claims, targets, citations."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.keys import citing_authors, event_id
from ..functions.quantity import old_value_terms
from ..functions.text import let, strip
from .review import citation_review, found_via, needs_notification, notify_priority

JUDGEMENTS = "judgements array<struct<id:string,refers:string,value_use:string,reason:string>>"


def reply_json(c: Column) -> Column:
    """JSON object text inside a reply: from the first { to the last }, trailing commas removed when needed; null when it
    is no JSON."""
    def valid(t: Column) -> Column:
        return F.when(F.try_parse_json(t).isNotNull(), t)

    chunk = F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\{.*\}", 0), F.lit(""))
    return let(chunk, lambda t: F.coalesce(valid(t), valid(F.regexp_replace(t, r",\s*([}\]])", "$1"))))


def parse_replies(replies: DataFrame, schema: str, text_col: str = "text") -> DataFrame:
    """Adds `parsed`: the reply through a schema, null when it holds no JSON object."""
    j = replies.withColumn("_json", reply_json(F.col(text_col)))
    return j.withColumn("parsed", F.when(F.col("_json").isNotNull(), F.from_json("_json", schema))).drop("_json")


def parse_judgements(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """replies(request_id, text, n_candidates) -> judgement rows (candidate_no from 1, refers, value_use, reason) and the
    ids of replies that could not be used. Unknown labels become no / cannot_tell; ids outside the list are ignored; the
    last entry of an id counts."""
    p = parse_replies(replies, JUDGEMENTS)
    usable = F.col("parsed.judgements").isNotNull()
    rows = p.filter(usable).select("request_id", "n_candidates", F.posexplode("parsed.judgements").alias("pos", "j"))
    no = F.regexp_extract(F.coalesce("j.id", F.lit("")), r"^c(\d+)$", 1).try_cast("int")
    rows = rows.withColumn("candidate_no", no).filter((F.col("candidate_no") >= 1) & (F.col("candidate_no") <= F.col("n_candidates")))
    last = W.partitionBy("request_id", "candidate_no").orderBy(F.desc("pos"))
    rows = rows.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1")
    out = rows.select(
        "request_id", "candidate_no",
        F.when(F.col("j.refers").isin("yes", "possible", "no"), F.col("j.refers")).otherwise("no").alias("refers"),
        F.when(F.col("j.value_use").isin(*S.VALUE_USES), F.col("j.value_use")).otherwise("cannot_tell").alias("value_use"),
        F.coalesce("j.reason", F.lit("")).alias("reason"))
    return out, p.filter(~usable | F.col("parsed").isNull()).select("request_id")


def numeric_delta(df: DataFrame) -> DataFrame:
    """preprint_value, published_value -> absolute and relative change (three places; null for an old value of 0)."""
    gap = F.col("published_value") - F.col("preprint_value")
    return df.withColumn("absolute_delta", gap).withColumn(
        "relative_delta", F.when(F.col("preprint_value") != 0, F.round(gap / F.col("preprint_value"), 3)))


def build_targets(events: DataFrame, identities: DataFrame | None = None) -> DataFrame:
    """events(event_id, paper_id, preprint_doi, published_doi, first_author, preprint_title, claim_diffs) -> one target per
    change with a traceable old value. Changes in wording or reporting only have none. identities(paper_id, first_author,
    title) fill in what an event lacks."""
    text = lambda c: F.nullif(c, F.lit(""))
    e = events
    author, title = text(F.col("first_author")), text(F.col("preprint_title"))
    if identities is not None:
        e = e.join(identities.select("paper_id", F.col("first_author").alias("_a"), F.col("title").alias("_t")), "paper_id", "left")
        author, title = F.coalesce(author, text(F.col("_a"))), F.coalesce(title, text(F.col("_t")))
    d = e.select("event_id", "paper_id", "preprint_doi", "published_doi", F.coalesce(author, F.lit("")).alias("first_author"),
                 F.coalesce(title, F.lit("")).alias("title_fragment"), F.posexplode("claim_diffs").alias("claim_diff_idx", "d"))
    d = d.filter(~F.coalesce(F.col("d.root_cause").isin(*S.UNTRACED_ROOT_CAUSES), F.lit(False)))
    d = d.withColumn("terms", old_value_terms(F.col("d.preprint_text"), F.col("d.published_text"))).filter(F.size("terms") > 0)
    return d.select(
        F.concat_ws("::", F.col("event_id").cast("string"), F.col("claim_diff_idx").cast("string")).alias("target_id"), "event_id",
        "claim_diff_idx", "paper_id", "preprint_doi", "published_doi", "first_author", "title_fragment", "terms",
        F.coalesce("d.preprint_text", F.lit("")).alias("old_claim"),
        F.coalesce(text(F.col("d.published_text")), F.lit("(no counterpart in the published paper)")).alias("current_claim"))


def missing_runs(events: DataFrame, exclude: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Events never queued -> counts of their targets, and the targets to queue."""
    open_ = events.filter(F.col("citation_status") == "not_queued")
    if exclude:
        open_ = open_.filter(~F.coalesce(F.col("paper_id").isin(*exclude), F.lit(False)))
    targets = build_targets(open_)
    n = targets.groupBy("event_id").agg(F.count("*").alias("targets"))
    return open_.select("event_id", "paper_id").join(n, "event_id", "left").withColumn("targets", F.coalesce("targets", F.lit(0))), targets


def build_events(pairs: DataFrame, analysis: DataFrame, diffs: DataFrame, verification: DataFrame, abstract_class: DataFrame) -> DataFrame:
    """pairs(paper_id, preprint_doi, published_doi, title, published_title, first_author, versions, withdrawn_versions),
    analysis(paper_id, drift_summary, materiality_score, fulltext_tier), diffs(paper_id, claim_diff_idx, contract fields),
    verification(paper_id, quotes_total, quotes_verified, status), abstract_class(paper_id, abstract_class) -> one event
    per analysed pair with its changes in order."""
    fields = [c for c in diffs.columns if c not in ("paper_id", "claim_diff_idx")]
    d = diffs.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("claim_diff_idx", F.to_json(F.struct(*fields)).alias("j")))).alias("d"))
    shape = diffs.select(*fields).schema.simpleString().replace("struct<", "array<struct<", 1) + ">"
    packed = F.from_json(F.concat(F.lit("["), F.array_join(F.transform("d", lambda x: x["j"]), ","), F.lit("]")), shape)
    j = (pairs.join(analysis, "paper_id").join(d, "paper_id", "left").join(verification, "paper_id", "left")
         .join(abstract_class, "paper_id", "left"))
    return j.select(
        event_id(F.col("preprint_doi"), F.col("published_doi")).alias("event_id"), "paper_id", "preprint_doi", "published_doi",
        F.col("title").alias("preprint_title"), "published_title", "first_author", F.lit("v1").alias("preprint_version_compared"),
        "drift_summary", F.coalesce(packed, F.from_json(F.lit("[]"), shape)).alias("claim_diffs"), "materiality_score", "fulltext_tier",
        "abstract_class", F.col("versions").alias("preprint_versions"), "withdrawn_versions",
        F.coalesce("quotes_total", F.lit(0)).alias("quotes_total"), F.coalesce("quotes_verified", F.lit(0)).alias("quotes_verified"),
        F.coalesce("status", F.lit("unsupported")).alias("verification_status"))


def build_claims(events: DataFrame, claims: DataFrame) -> DataFrame:
    """claims(paper_id, doc_id, claims array<struct<id, section, text, kind>>) of both documents -> one row per claim. The
    key ends in the claim's id, else in document and index; parent DOI and version follow the document."""
    c = claims.join(events.select("event_id", "paper_id", "preprint_doi", "published_doi"), "paper_id")
    c = c.select("event_id", "doc_id", "preprint_doi", "published_doi", F.posexplode("claims").alias("claim_idx", "c"))
    pre = F.col("doc_id").startswith("preprint")
    local = F.coalesce(F.nullif("c.id", F.lit("")), F.concat("doc_id", F.col("claim_idx").cast("string")))
    return c.select(
        F.concat_ws("::", F.col("event_id").cast("string"), local).alias("claim_id"), "event_id", "doc_id",
        F.when(pre, F.col("preprint_doi")).otherwise(F.col("published_doi")).alias("parent_doi"),
        F.when(pre, F.regexp_replace("doc_id", "^preprint_", "")).otherwise("published").alias("parent_version"),
        F.col("c.section").alias("section"), "claim_idx", F.col("c.text").alias("text"), F.col("c.kind").alias("kind"))


def number_claims(replies: DataFrame) -> DataFrame:
    """replies(paper_id, doc_id, chunk, claims array<struct<section, text, kind>>) of an extractor -> claims of a document
    in chunk order with program-assigned ids: three letters of the document and a running number. Claims without text go."""
    kept = F.filter("claims", lambda c: F.coalesce(strip(c["text"]) != "", F.lit(False)))
    rows = replies.groupBy("paper_id", "doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(
        F.struct("chunk", kept.alias("c")))), lambda x: x["c"])).alias("all"))
    return rows.select("paper_id", "doc_id", F.transform("all", lambda c, i: F.struct(
        F.concat(F.substring("doc_id", 1, 3), i.cast("string")).alias("id"), c["section"].alias("section"), c["text"].alias("text"),
        c["kind"].alias("kind"))).alias("claims"))


def build_citations(works: DataFrame) -> DataFrame:
    """works(event_id, target_id, claim_diff_idx, run_id, work_id, title, authors, date, journal, doi, cites, role, sentence,
    sentence_verified, source, relayed_by, flags) -> one citation row per judged work."""
    date = F.when(F.col("date").rlike(r"^\d{4}"), F.col("date"))
    rows = works.select(
        F.concat_ws("::", F.col("event_id").cast("string"), F.col("work_id").cast("string")).alias("affected_citation_id"),
        F.col("event_id").alias("drift_event_id"), "target_id", "claim_diff_idx", "run_id", "work_id", F.col("doi").alias("citing_paper_doi"),
        F.col("title").alias("citing_paper_title"), citing_authors(F.col("authors")).alias("citing_paper_authors"),
        date.alias("citing_paper_date"), F.col("journal").alias("citing_paper_journal"), "cites", "role", "sentence",
        F.coalesce("sentence_verified", F.lit(False)).alias("sentence_verified"), found_via(F.col("source")).alias("found_via"),
        F.col("source").alias("found_via_detail"), F.nullif("relayed_by", F.lit("")).alias("relayed_by"),
        F.coalesce("flags", F.array().cast("array<string>")).alias("flags"))
    rows = rows.withColumn("needs_notification", needs_notification(F.col("cites"))).withColumn(
        "notify_priority", notify_priority(F.col("cites"), F.col("role")))
    return citation_review(rows)
