"""Labels, review rules, human decisions, notices."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import let

_STRINGS = "array<string>"
REPLACEMENT_NEW = "(no counterpart in the published version)"
REPLACEMENT_OLD = "(see the preprint's first version)"


def tier_of(score: Column) -> Column:
    """Severity tier of a score with steps at 0.3, 0.6 and 0.9; null for no number."""
    def step(x: Column) -> Column:
        whole = F.round((x - F.pmod(x, F.lit(0.3))) / 0.3).cast("int")
        at = F.when(x >= 0.9, 3).otherwise(F.greatest(F.lit(0), F.least(F.lit(3), whole)))
        return F.when(x.isNotNull(), F.get(F.array(*[F.lit(t) for t in S.TIERS]), at))

    return let(score.try_cast("double"), step)


def tier_rank(tier: Column) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(t) for t in S.TIERS]), tier), F.lit(0).cast("long")) - 1


def _repr(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("None")).otherwise(F.concat(F.lit("'"), c, F.lit("'")))


def validate_labels(diffs: DataFrame) -> DataFrame:
    """diffs(materiality string, root_cause, diff_type, evidence array<struct>): the score as a number with its tier,
    evidence without a quote dropped, labels outside the sets kept and listed in label_problems."""
    def problem(col: str, allowed: list[str]) -> Column:
        ok = F.coalesce(F.col(col).isin(*allowed), F.lit(False))
        return F.when(~ok, F.concat(F.lit(col + " "), _repr(F.col(col)), F.lit(" not in the closed set")))

    return (diffs.withColumn("materiality", F.col("materiality").try_cast("double"))
            .withColumn("severity_tier", tier_of(F.col("materiality")))
            .withColumn("evidence", F.filter("evidence", lambda e: F.coalesce(e["quote"] != "", F.lit(False))))
            .withColumn("label_problems", F.array_compact(F.array(
                problem("root_cause", S.ROOT_CAUSES), problem("diff_type", S.DIFF_TYPES)))))


def validate_verdicts(verdicts: DataFrame) -> DataFrame:
    """An unknown class becomes unclear with a note, an unknown role becomes unknown."""
    known = F.coalesce(F.col("cites").isin(*S.CITES), F.lit(False))
    note = F.when(~known, F.concat(F.lit("invalid class "), _repr(F.col("cites"))))
    return (verdicts.withColumn("label_problem", note)
            .withColumn("cites", F.when(known, F.col("cites")).otherwise("unclear"))
            .withColumn("role", F.when(F.col("role").isin(*S.ROLES), F.col("role")).otherwise("unknown")))


def severity_mismatch(abstract_class: Column, fulltext_tier: Column) -> Column:
    """Clear contradictions of the two scales only; a missing label is none."""
    quiet = (abstract_class == "no_change") & fulltext_tier.isin("significant", "major")
    loud = (abstract_class == "major") & (fulltext_tier == "minor")
    return F.coalesce(quiet | loud, F.lit(False))


def needs_notification(cites: Column) -> Column:
    return F.coalesce(cites.isin(*S.NOTIFY_CLASSES), F.lit(False))


def notify_priority(cites: Column, role: Column) -> Column:
    return (F.when((cites == "superseded") & (role == "model_input"), "high").when(cites == "superseded", "normal")
            .when(cites == "indirect", "low"))


def found_via(source: Column) -> Column:
    """The part of a source tag in front of the colon; prefetch without one."""
    return F.coalesce(F.nullif(F.substring_index(source, ":", 1), F.lit("")), F.lit("prefetch"))


def rollup_severity(events: DataFrame, diffs: DataFrame) -> DataFrame:
    """events(event_id, materiality_score string), diffs(event_id, materiality, severity_tier): event score = its own
    number, else the highest of its changes; tier = highest tier; no changes is minor; changes without a tier give null."""
    d = diffs.groupBy("event_id").agg(F.max("materiality").alias("m"), F.max(tier_rank(F.col("severity_tier"))).alias("r"),
                                      F.count("*").alias("n"))
    tiers = F.array(*[F.lit(t) for t in S.TIERS])
    return (events.join(d, "event_id", "left")
            .withColumn("materiality_score", F.coalesce(F.col("materiality_score").try_cast("double"), "m"))
            .withColumn("fulltext_tier", F.when(F.col("n").isNull(), "minor").otherwise(F.get(tiers, F.col("r").cast("int"))))
            .drop("m", "r", "n"))


def _words(*pairs) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(label)) for label, cond in pairs]))


def apply_review(events: DataFrame) -> DataFrame:
    """events(quotes_total, quotes_verified, abstract_class, fulltext_tier, withdrawn_versions, review_status,
    review_reasons): reasons as a sorted set with the earlier ones; pending with a reason, else not_required; a human
    decision stays."""
    reasons = _words(
        ("quote_unverified", (F.col("quotes_total") > 0) & (F.coalesce("quotes_verified", F.lit(0)) < F.col("quotes_total"))),
        ("severity_mismatch", severity_mismatch(F.col("abstract_class"), F.col("fulltext_tier"))),
        ("withdrawn_version", F.size("withdrawn_versions") > 0))
    all_reasons = F.array_sort(F.array_union(reasons, F.coalesce("review_reasons", F.array().cast(_STRINGS))))
    human = F.coalesce(F.col("review_status").isin("approved", "rejected"), F.lit(False))
    return events.withColumn("review_reasons", all_reasons).withColumn(
        "review_status", F.when(human, F.col("review_status")).when(F.size("review_reasons") > 0, "pending").otherwise("not_required"))


def citation_review(verdicts: DataFrame) -> DataFrame:
    """An undecided citation waits for review."""
    unclear = F.coalesce(F.col("cites") == "unclear", F.lit(False))
    return (verdicts.withColumn("review_status", F.when(unclear, "pending").otherwise("not_required"))
            .withColumn("review_reasons", F.when(unclear, F.array(F.lit("unclear"))).otherwise(F.array().cast(_STRINGS))))


def carry_over(new: DataFrame, old: DataFrame) -> DataFrame:
    """A re-analysed event that a human had decided on says so; its review starts again from that reason."""
    prev = old.filter(F.col("review_status").isin("approved", "rejected")).select(
        "event_id", F.col("review_status").alias("_s"), F.col("reviewer").alias("_r"), F.col("reviewed_at").cast("string").alias("_t"))
    text = lambda c: F.coalesce(F.col(c), F.lit("None"))
    hit = F.col("_s").isNotNull()
    joined = new.join(prev, "event_id", "left")
    note = F.concat(F.lit("previous decision "), F.col("_s"), F.lit(" by "), text("_r"), F.lit(" at "), text("_t"))
    n_targets = F.col("n_targets") if "n_targets" in new.columns else F.lit(0)
    return (joined.withColumn("review_reasons", F.when(hit, F.array_sort(F.array_union(
                F.coalesce("review_reasons", F.array().cast(_STRINGS)), F.array(F.lit("reanalyzed_after_review")))))
                .otherwise(F.col("review_reasons")))
            .withColumn("review_note", F.when(hit, note))
            .withColumn("review_status", F.when(hit, "pending").otherwise(F.col("review_status")))
            .withColumn("citation_status", F.when(n_targets > 0, "queued").otherwise("no_target"))
            .drop("_s", "_r", "_t"))


def review_queue(events: DataFrame, citations: DataFrame, status: str, n_events: int | None = None, n_citations: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Events newest first; citations by the priority word in alphabetical order, then newest scored, nulls last. With limits, the first ones."""
    ev = events.filter(F.col("review_status") == status).orderBy(F.desc_nulls_last("detected_at"), "event_id")
    ci = (citations.filter(F.col("review_status") == status)
          .orderBy(F.asc_nulls_last("notify_priority"), F.desc_nulls_last("scored_at"), "affected_citation_id"))
    return ev if n_events is None else ev.limit(n_events), ci if n_citations is None else ci.limit(n_citations)


# ---- Human decisions ---------------------------------------------------------------------------------------------------
def _keep_first(machine: Column, field: str, changed: Column) -> Column:
    """Remember the machine's value of a field the first time a human changes it."""
    return let(machine, lambda m: F.when(changed & ~F.array_contains(F.map_keys(m), field), F.map_concat(
        m, F.create_map(F.lit(field), F.col(field)))).otherwise(m))


def decide_citations(docs: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(id, cites, role, needs_notification, review fields, machine_verdict map, corrected_fields), decisions(id,
    decision, reviewer, note, corrected map) -> (updated docs, rejected decisions with a reason). A correction may name
    cites and role only; the first machine value is kept; a rejected item is not corrected."""
    c = F.coalesce("corrected", F.map_from_arrays(F.array().cast(_STRINGS), F.array().cast(_STRINGS)))
    keys = F.map_keys(c)
    wish = lambda k: F.nullif(F.element_at(c, k), F.lit(""))
    error = (
        F.when(~F.coalesce(F.col("decision").isin("approved", "rejected"), F.lit(False)), "decision must be approved or rejected")
        .when((F.size(c) > 0) & (F.col("decision") == "rejected"), "a rejected item is not corrected")
        .when(F.size(F.array_except(keys, F.array(F.lit("cites"), F.lit("role")))) > 0, "field cannot be corrected")
        .when(wish("cites").isNotNull() & ~wish("cites").isin(*S.CITES), "unknown value")
        .when(wish("role").isNotNull() & ~wish("role").isin(*S.ROLES), "unknown value"))
    checked = decisions.withColumn("error", error).withColumn("to_cites", wish("cites")).withColumn("to_role", wish("role"))
    valid = checked.filter("error IS NULL").select("id", "decision", F.col("reviewer").alias("by"), "note", "to_cites", "to_role")
    j = docs.join(valid, "id", "left")
    hit = F.col("decision").isNotNull()
    changed = {k: F.coalesce(F.col(f"to_{k}").isNotNull() & ~F.col(f"to_{k}").eqNullSafe(F.col(k)), F.lit(False)) for k in ("cites", "role")}
    machine = F.coalesce("machine_verdict", F.map_from_arrays(F.array().cast(_STRINGS), F.array().cast(_STRINGS)))
    for k in ("cites", "role"):
        machine = _keep_first(machine, k, changed[k])
    fields = F.array_compact(F.array(*[F.when(changed[k], F.lit(k)) for k in ("cites", "role")]))
    # before the select: a column named inside a lambda would read the select's new `cites`, not the old one
    j = j.withColumn("_machine", machine)
    done = j.select(
        "id",
        F.when(changed["cites"], F.col("to_cites")).otherwise(F.col("cites")).alias("cites"),
        F.when(changed["role"], F.col("to_role")).otherwise(F.col("role")).alias("role"),
        F.when(changed["cites"], needs_notification(F.col("to_cites"))).otherwise(F.col("needs_notification")).alias("needs_notification"),
        F.coalesce("decision", "review_status").alias("review_status"),
        F.when(hit, F.nullif(F.trim("by"), F.lit(""))).otherwise(F.col("reviewer")).alias("reviewer"),
        F.when(hit, F.nullif("note", F.lit(""))).otherwise(F.col("review_note")).alias("review_note"),
        F.col("_machine").alias("machine_verdict"),
        F.when(F.size(fields) > 0, F.array_sort(F.array_union(F.coalesce("corrected_fields", F.array().cast(_STRINGS)), fields)))
        .otherwise(F.col("corrected_fields")).alias("corrected_fields"))
    return done, checked.filter("error IS NOT NULL").select("id", "decision", "error")


def decide_events(docs: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(id, abstract_class, fulltext_tier, claim_diffs array<struct<root_cause, severity_tier>>, review_status,
    machine_verdict map, corrected_fields), decisions(id, decision, abstract_class, fulltext_tier, claim_diffs
    array<struct<idx, root_cause, severity_tier>>) -> (updated docs, invalid decisions with a reason)."""
    sized = docs.select("id", F.size("claim_diffs").alias("n"), F.col("claim_diffs").alias("cur"))
    wishes = F.coalesce("claim_diffs", F.array().cast("array<struct<idx:int,root_cause:string,severity_tier:string>>"))
    bad = lambda v, allowed: v.isNotNull() & (v != "") & ~v.isin(*allowed)
    none = (F.coalesce("abstract_class", F.lit("")) == "") & (F.coalesce("fulltext_tier", F.lit("")) == "") & (F.size(wishes) == 0)
    error = (
        F.when(~F.coalesce(F.col("decision").isin("approved", "rejected"), F.lit(False)), "decision must be approved or rejected")
        .when((F.col("decision") == "rejected") & ~none, "a rejected item is not corrected")
        .when(bad(F.col("abstract_class"), S.ABSTRACT_CLASSES) | bad(F.col("fulltext_tier"), S.TIERS), "unknown value")
        .when(F.exists(wishes, lambda w: w["idx"].isNull() | (w["idx"] < 0) | (w["idx"] >= F.col("n"))), "idx out of range")
        .when(F.exists(wishes, lambda w: F.coalesce(bad(w["root_cause"], S.ROOT_CAUSES), F.lit(False))
                       | F.coalesce(bad(w["severity_tier"], S.TIERS), F.lit(False))), "value not allowed"))
    checked = decisions.join(sized, "id").withColumn("wish", wishes).withColumn("error", error)
    valid = checked.filter("error IS NULL").select(
        "id", "decision", F.nullif("abstract_class", F.lit("")).alias("to_abstract_class"),
        F.nullif("fulltext_tier", F.lit("")).alias("to_fulltext_tier"), "wish")
    j = docs.join(valid, "id", "left")
    top = {k: F.coalesce(F.col(f"to_{k}").isNotNull() & ~F.col(f"to_{k}").eqNullSafe(F.col(k)), F.lit(False))
           for k in ("abstract_class", "fulltext_tier")}

    wish_type = "array<struct<idx:int,root_cause:string,severity_tier:string>>"

    def wanted(d: Column, i: Column, k: str) -> Column:
        """Wishes that change field k of change i."""
        return F.coalesce(F.filter(F.col("wish"), lambda w: (w["idx"] == i) & w[k].isNotNull() & (w[k] != "")
                                   & ~w[k].eqNullSafe(d[k])), F.array().cast(wish_type))

    def pick(d: Column, i: Column, k: str) -> Column:
        return F.try_element_at(F.transform(wanted(d, i, k), lambda w: w[k]), F.lit(-1))

    def change(d: Column, i: Column, k: str) -> Column:
        return F.when(F.size(wanted(d, i, k)) > 0, F.struct(
            F.concat(F.lit("claim_diffs["), i.cast("string"), F.lit(f"].{k}")).alias("field"), d[k].alias("was")))

    entry = "struct<field:string,was:string>"
    diff_changes = F.flatten(F.transform(F.col("claim_diffs"), lambda d, i: F.array_compact(F.array(
        change(d, i, "root_cause"), change(d, i, "severity_tier")))))
    top_changes = F.array_compact(F.array(*[F.when(top[k], F.struct(F.lit(k).alias("field"), F.col(k).alias("was"))) for k in top]))
    j = j.withColumn("changes", F.concat(top_changes.cast(f"array<{entry}>"), diff_changes.cast(f"array<{entry}>")))
    machine = F.coalesce("machine_verdict", F.map_from_arrays(F.array().cast(_STRINGS), F.array().cast(_STRINGS)))
    fresh = let(machine, lambda m: F.map_concat(m, F.map_from_entries(F.filter(
        F.col("changes"), lambda x: ~F.array_contains(F.map_keys(m), x["field"])))))
    fields = F.transform("changes", lambda x: x["field"])
    new_diffs = F.transform("claim_diffs", lambda d, i: d.withField("root_cause", F.coalesce(pick(d, i, "root_cause"), d["root_cause"]))
                            .withField("severity_tier", F.coalesce(pick(d, i, "severity_tier"), d["severity_tier"])))
    done = j.select(
        "id",
        *[F.when(top[k], F.col(f"to_{k}")).otherwise(F.col(k)).alias(k) for k in top],
        F.when(F.col("wish").isNull(), F.col("claim_diffs")).otherwise(new_diffs).alias("claim_diffs"),
        F.coalesce("decision", "review_status").alias("review_status"),
        fresh.alias("machine_verdict"),
        F.when(F.size(fields) > 0, F.array_sort(F.array_union(F.coalesce("corrected_fields", F.array().cast(_STRINGS)), fields)))
        .otherwise(F.col("corrected_fields")).alias("corrected_fields"))
    return done, checked.filter("error IS NOT NULL").select("id", "decision", "error")


# ---- Notices -----------------------------------------------------------------------------------------------------------
def gate_reason(has_event: Column) -> Column:
    """Why a citation is not notified; null when it passes. Expects cites, review_status, event_review_status."""
    return (
        F.when(~needs_notification(F.col("cites")), F.lit("class is not notified"))
        .when(F.col("review_status").eqNullSafe(F.lit("rejected")), F.lit("citation rejected"))
        .when(~has_event, F.lit("event not found"))
        .when(F.col("event_review_status").eqNullSafe(F.lit("rejected")), F.lit("event rejected")))


def pending_notifications(citations: DataFrame, events: DataFrame, log: DataFrame) -> DataFrame:
    """Citations not yet in the log, with gate_reason null for those to notify now."""
    ev = events.select(F.col("event_id").alias("drift_event_id"), F.col("review_status").alias("event_review_status"), F.lit(True).alias("_ev"))
    todo = citations.join(log.select("affected_citation_id"), "affected_citation_id", "left_anti")
    return (todo.join(ev, "drift_event_id", "left")
            .withColumn("gate_reason", gate_reason(F.col("_ev").isNotNull())).drop("_ev", "event_review_status"))


def _greeting() -> Column:
    names = F.filter(F.transform("citing_paper_authors", lambda a: a["name"]), lambda n: n.isNotNull() & (n != ""))
    surname = F.regexp_replace(F.regexp_extract(F.get(names, F.lit(0)), r"^\s*(\S+)", 1), r"^[,.]+|[,.]+$", "")
    return F.when(F.size(names) > 0, F.concat(
        F.lit("Dear Dr "), surname, F.when(F.size(names) > 1, " and co-authors").otherwise(""), F.lit(","))).otherwise("Dear authors,")


# ---- Fixed values: the wording of a notice. Names in braces are filled in per citation. -------------------------------
SUBJECTS = {
    "direct": "[{sender}] A value your paper cites from {target} was revised in the published version",
    "indirect": "[{sender}] A value your paper cites via {via} was revised by its original authors",
}
LEADS = {
    "direct": 'Your paper "{title}" ({ref}) cites the preprint by {target} ({preprint}). One value it relies on was revised '
              "between the preprint's first version and the published version ({published}).",
    "indirect": 'Your paper "{title}" ({ref}) uses a value that it credits to {via}. That value comes originally from the '
                "preprint by {target} ({preprint}), and the authors revised it when the work was published ({published}).",
}
ROLE_NOTES = {
    "model_input": "Your paper appears to use this value as a model input or parameter, so results that depend on it may "
                   "shift with the revised value.",
    "reported_as_fact": "Your paper reports this value as a finding.",
    "background": "Your paper mentions this value as background.",
}
BODY = """{greeting}

I am writing on behalf of {sender}, a project that tracks how findings change between a preprint's first version and its published version.

{lead}

The passage in your paper{unsure}:
    "{passage}"

Preprint, first version:
    {old}
Published version:
    {new}

What changed: {change}{note}

This is an automated, factual notice, and the comparison may be imperfect. You are best placed to judge whether anything in your work needs updating; no reply is needed.

Best regards,
{sender}"""
# ----------------------------------------------------------------------------------------------------------------------------


def _fill(template: str, places: dict[str, Column]) -> Column:
    """A fixed text with its places filled. The text is cut at the places, so a filled-in value is never read as one."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[places[x] if i % 2 else F.lit(x) for i, x in enumerate(parts) if x])


def render_notices(citations: DataFrame, events: DataFrame, drafts: DataFrame | None = None, sender: str = "revtrace") -> DataFrame:
    """Subject and body per citation. citations(affected_citation_id, drift_event_id, claim_diff_idx, work_id,
    citing_paper_title, citing_paper_doi, citing_paper_authors, cites, role, relayed_by, sentence, sentence_verified),
    events(event_id, preprint_doi, published_doi, first_author, drift_summary, claim_diffs). A draft(affected_citation_id,
    subject, body) is kept only when it holds both quoted versions; otherwise the fixed wording is used."""
    return _worded(_with_change(citations, events), drafts, sender).drop("_row")


def _with_change(citations: DataFrame, events: DataFrame) -> DataFrame:
    """What a notice is filled with; the texts are not written out yet, so that little is shuffled."""
    e = events.select(F.col("event_id").alias("drift_event_id"), "preprint_doi", "published_doi", "first_author", "drift_summary", "claim_diffs")
    return citations.join(e, "drift_event_id").withColumn("_diff", F.get("claim_diffs", F.col("claim_diff_idx"))).drop("claim_diffs").withColumn("_row", F.lit(None))


def _worded(d: DataFrame, drafts: DataFrame | None, sender: str) -> DataFrame:
    """Subject and body of the rows of _with_change; the column _row is passed on."""
    def text(name: str, otherwise: Column | str = "") -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(otherwise) if isinstance(otherwise, str) else otherwise)

    def link(name: str) -> Column:
        return F.concat(F.lit("https://doi.org/"), F.nullif(F.col(name), F.lit("")))

    work = F.col("work_id").cast("string")
    notes = F.create_map(*[F.lit(x) for pair in ROLE_NOTES.items() for x in pair])
    places = {
        "sender": F.lit(sender), "greeting": _greeting(), "title": text("citing_paper_title", work),
        "ref": F.coalesce(link("citing_paper_doi"), work), "via": text("relayed_by", "another paper"),
        "target": F.coalesce(F.concat(F.nullif("first_author", F.lit("")), F.lit(" et al.")), F.lit("a preprint")),
        "preprint": F.coalesce(link("preprint_doi"), F.lit("")), "published": F.coalesce(link("published_doi"), F.lit("")),
        "unsure": F.when(F.coalesce("sentence_verified", F.lit(False)), "").otherwise(" (as identified automatically)"),
        "passage": text("sentence"), "old": text("_diff.preprint_text", REPLACEMENT_OLD), "new": text("_diff.published_text", REPLACEMENT_NEW),
        "change": text("_diff.change_description", text("drift_summary")),
        "note": F.coalesce(F.concat(F.lit("\n"), F.try_element_at(notes, F.col("role"))), F.lit("")),
    }
    indirect = F.col("cites") == "indirect"
    pick = lambda kinds: F.when(indirect, _fill(kinds["indirect"], places)).otherwise(_fill(kinds["direct"], places))
    places["lead"] = pick(LEADS)
    out = d.withColumn("_subject", pick(SUBJECTS)).withColumn("_body", _fill(BODY, places))
    if drafts is None:
        return out.select("affected_citation_id", "_row", F.col("_subject").alias("subject"), F.col("_body").alias("body"), F.lit(False).alias("from_draft"))
    bare = lambda c: F.regexp_replace(F.lower(c), r"(?U)\W+", "")
    dr = drafts.select("affected_citation_id", F.trim("subject").alias("_ds"), F.trim("body").alias("_db"))
    holds = lambda name: F.contains(bare(F.col("_db")), bare(text(name)))
    use = F.coalesce((F.col("_ds") != "") & (F.col("_db") != "") & holds("_diff.preprint_text") & holds("_diff.published_text"), F.lit(False))
    return out.join(dr, "affected_citation_id", "left").select(
        "affected_citation_id", "_row", F.when(use, F.col("_ds")).otherwise(F.col("_subject")).alias("subject"),
        F.when(use, F.col("_db")).otherwise(F.col("_body")).alias("body"), use.alias("from_draft"))


def build_notifications(citations: DataFrame, events: DataFrame, log: DataFrame, recipient: str, drafts: DataFrame | None = None,
                        sender: str = "revtrace") -> DataFrame:
    """Log rows for the gated citations: a fixed recipient, whom the notice is meant for, and status drafted."""
    due = citations.filter(needs_notification(F.col("cites")) & ~F.col("review_status").eqNullSafe(F.lit("rejected")))  # the part of the gate that needs no join
    go = pending_notifications(due, events, log).filter("gate_reason IS NULL").drop("gate_reason")
    meant = F.struct("citing_paper_title", "citing_paper_doi", F.transform("citing_paper_authors", lambda a: a["name"]).alias("authors"), "relayed_by")
    row = F.struct("drift_event_id", F.col("work_id").alias("citing_work_id"), "cites", meant.alias("intended_for"))
    both = _with_change(go, events).drop("_row").join(go.select("affected_citation_id", row.alias("_row")), "affected_citation_id")
    return _worded(both, drafts, sender).select(
        "affected_citation_id", "_row.*",
        F.lit(recipient).alias("recipient_email"), "subject", "body", F.lit("drafted").alias("status"), F.lit("draft_only").alias("delivery"))


def keep_human(new: DataFrame, existing: DataFrame, key: str = "affected_citation_id") -> DataFrame:
    """New rows whose key a human has already decided on are left out before an upsert."""
    decided = existing.filter(F.col("review_status").isin("approved", "rejected")).select(key)
    return new.join(decided, key, "left_anti")


def recent_events(events: DataFrame, n: int = 100) -> DataFrame:
    """The newest visible events, missing dates last, with the true total alongside."""
    from ..sources.tables import visible
    v = visible(events)
    top = v.orderBy(F.desc_nulls_last("detected_at"), "event_id").limit(n)
    total = v.agg(F.count("*").alias("total"))
    return top.join(F.broadcast(total))
