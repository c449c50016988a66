"""Queries of the citation operators. Every document is a citing work, every statement a target."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quantity
from ..functions.text import sentence_array
from ..operators import citations as ci
from ..session import written
from .book import Book
from .q_text import KEY, OLD_TERMS, RAW, SENTENCES, STRIP, norm_sql, squash_sql
from .views import load, view, with_views

Q = Book()
SENTS_SQL = f"""sents AS (SELECT work_id, i AS pos, parts[i + 1] AS sentence FROM (SELECT work_id, [x FOR x IN [{STRIP.replace('{x}', 'y')} FOR y IN {SENTENCES.replace('{x}', 'text')}] IF x <> ''] AS parts
  FROM works), unnest(range(len(parts))) AS u(i))"""


def sents(spark, sf):
    w = view(spark, sf, "works")
    return w.select("work_id", F.posexplode(sentence_array(F.col("text"))).alias("pos", "sentence"))


def targets(spark, sf):
    """One target per statement whose text has a traceable value; each is the whole old value of its document."""
    s = view(spark, sf, "statements")
    return s.select(F.col("doc_id").alias("target_id"), F.concat(F.lit("10.1101/"), "doc_id").alias("preprint_doi"), F.concat(F.lit("10.1016/p"), "doc_id").alias("published_doi"),
                    F.concat(F.lit("Author"), F.col("doc_id") % 50).alias("first_author"), F.lit("Study of revised values").alias("title_fragment"),
                    quantity.old_value_terms(F.col("old_text"), F.lit("")).alias("terms"), F.lit("now 6.4 days").alias("current_claim"))


PAIRS_SQL = "pairs AS (SELECT DISTINCT work_id, CAST(regexp_extract(cited_doi, '([0-9]+)$', 1) AS BIGINT) AS target_id FROM cites)"


def pairs(spark, sf):
    return cited_pairs(view(spark, sf, "cites"))


# The old value of target k as a pattern without look-around: the characters around a number are captured instead.
B, E = "(^|[^0-9.·])", "($|[^0-9.·∙⋅]|[.·∙⋅]($|[^0-9]))"
DEC = "[.·∙⋅]"


def _num(expr_int: str, expr_dec: str | None = None) -> str:
    """SQL text of a number pattern from an integer part and one decimal digit (0 means none)."""
    if expr_dec is None:
        return f"concat({expr_int}, '(?:{DEC}0+)?')"
    return f"CASE WHEN {expr_dec} = 0 THEN concat({expr_int}, '(?:{DEC}0+)?') ELSE concat({expr_int}, '{DEC}', {expr_dec}, '0*') END"


N, T_ = "target_id % 97", "target_id % 10"
RANGE = "\\s*(?:-?\\s*to|and|[-–—−])\\s*"
PATTERN_SQL = f"""pats AS (SELECT target_id, CASE target_id % 8
  WHEN 2 THEN [concat('{B}', {_num("0")}, '{RANGE}', {_num(N + " + 2")}, '{E}')]
  WHEN 3 THEN [concat('(?i)', {N} + 1, ',500'), concat('{B}', {_num(N, T_)}, '{E}')]
  WHEN 6 THEN [concat('{B}', {_num(N, T_)}, '{RANGE}', {N} + 1, '{DEC}50*', '{E}')]
  WHEN 7 THEN ['{B}50{DEC}70*{E}'] ELSE [concat('{B}', {_num(N, T_)}, '{E}')] END AS ps FROM (SELECT doc_id AS target_id FROM documents))"""
BASE = with_views("works", "cites") + ", " + SENTS_SQL + ", " + PAIRS_SQL + ", " + PATTERN_SQL
MATCH = BASE + """, hits AS (SELECT DISTINCT p.work_id, p.target_id, s.pos, s.sentence FROM pairs p JOIN pats USING (target_id) JOIN sents s ON s.work_id = p.work_id
  AND len([x FOR x IN ps IF regexp_matches(s.sentence, x)]) > 0)"""


@Q.add("value_matches", MATCH + " SELECT work_id, target_id, pos FROM hits")
def value_matches(spark, sf):
    return ci.match_terms(pairs(spark, sf), sents(spark, sf), ci.with_rules(targets(spark, sf))).withColumn("pos", F.col("pos").cast("long"))


@Q.add("citer_listing", MATCH + """, c AS (SELECT work_id, CAST(regexp_extract(cited_doi, '([0-9]+)$', 1) AS BIGINT) AS target_id, CASE WHEN cited_doi LIKE '10.1101/%' THEN 'preprint' ELSE 'published' END AS version FROM cites),
  ok AS (SELECT * FROM c JOIN works USING (work_id) WHERE date >= '2005' AND work_id % 10 <> 3),
  x AS (SELECT work_id, target_id FROM pairs WHERE (work_id + target_id) % 7 = 0)
  SELECT ok.work_id, ok.target_id, string_agg(DISTINCT version, '|' ORDER BY version) AS versions FROM ok WHERE EXISTS (SELECT 1 FROM hits h WHERE h.work_id = ok.work_id AND h.target_id = ok.target_id)
   AND (ok.work_id + ok.target_id) % 7 <> 0 GROUP BY 1, 2""")
def citer_listing(spark, sf):
    works = view(spark, sf, "works").select("work_id", "date", (F.col("work_id") % 10 != 3).alias("has_text"))
    p = pairs(spark, sf)
    hits, _ = ci.list_citers(view(spark, sf, "cites"), works, sents(spark, sf), targets(spark, sf), "2005", p.filter((F.col("work_id") + F.col("target_id")) % 7 == 0))
    return hits.select("work_id", "target_id", F.array_join("versions", "|").alias("versions"))


@Q.add("citer_counts", MATCH + """, c AS (SELECT DISTINCT work_id, CAST(regexp_extract(cited_doi, '([0-9]+)$', 1) AS BIGINT) AS target_id, cited_doi LIKE '10.1101/%' AS pre FROM cites),
  h AS (SELECT target_id, count(DISTINCT work_id) AS n FROM hits WHERE work_id % 10 <> 3 GROUP BY 1)
  SELECT c.target_id, count(*) AS n_citing, count(*) FILTER (WHERE work_id % 10 = 3) AS no_open_full_text, coalesce(any_value(h.n), 0) AS citing_works_with_value FROM c
   JOIN documents d ON d.doc_id = c.target_id LEFT JOIN h ON h.target_id = c.target_id GROUP BY 1""")
def citer_counts(spark, sf):
    works = view(spark, sf, "works").select("work_id", "date", (F.col("work_id") % 10 != 3).alias("has_text"))
    return ci.list_citers(view(spark, sf, "cites"), works, sents(spark, sf), targets(spark, sf))[1]


# The sentence test of a target without quantity: a bare value counts only for terms without a unit, a value with a
# unit next to it counts when the units agree; ends of ranges do not count.
UNIT_AFTER = "(?i)^\\s*-?\\s*(?:%|per ?cent\\b|percent\\b|days?\\b|d\\b|hours?\\b|hrs?\\b|h\\b|weeks?\\b|wks?\\b|months?\\b|mos?\\b|years?\\b|yrs?\\b|y\\b)"
KEPT = BASE + f""", q AS (SELECT p.work_id, p.target_id, s.pos, s.sentence, pt.ps, p.target_id % 8 AS form FROM pairs p JOIN pats pt USING (target_id) JOIN sents s ON s.work_id = p.work_id),
  kept AS (SELECT work_id, target_id, pos, sentence FROM q WHERE CASE form
   WHEN 0 THEN regexp_matches(sentence, concat(replace(ps[1], '{E}', ''), '\\s*-?\\s*(?i:days?|d)\\b'))
   WHEN 1 THEN regexp_matches(sentence, concat(replace(ps[1], '{E}', ''), '($|[^0-9.·∙⋅]|[.·∙⋅]($|[^0-9]))'))
   WHEN 2 THEN regexp_matches(sentence, concat(replace(ps[1], '{E}', ''), '\\s*-?\\s*(?i:days?|d)\\b'))
   WHEN 3 THEN regexp_matches(sentence, ps[1]) OR regexp_matches(sentence, concat(replace(ps[2], '{E}', ''), '\\s*-?\\s*(?i:%|per ?cent\\b)'))
   WHEN 4 THEN regexp_matches(sentence, concat(replace(ps[1], '{E}', ''), '\\s*-?\\s*(?i:days?|d)\\b'))
   WHEN 5 THEN regexp_matches(sentence, ps[1])
   WHEN 6 THEN regexp_matches(sentence, concat(replace(ps[1], '{E}', ''), '\\s*-?\\s*(?i:weeks?|wks?)\\b'))
   ELSE regexp_matches(sentence, concat(replace(ps[1], '{E}', ''), '\\s*-?\\s*(?i:%|per ?cent\\b)')) END
   AND NOT (form IN (0, 1, 3, 4, 5, 7) AND (regexp_matches(sentence, concat('[0-9]\\s*(?:-?\\s*to|[-–—−])\\s*', replace(ps[len(ps)], '{B}', '')))
    OR regexp_matches(sentence, concat(replace(ps[len(ps)], '{E}', ''), '\\s*(?:-?\\s*to|[-–—−])\\s*[0-9]')))))"""


@Q.add("quantity_sentences", KEPT + " SELECT work_id, target_id, pos FROM kept")
def quantity_sentences(spark, sf):
    return ci.quantity_sentences(pairs(spark, sf), sents(spark, sf), ci.with_rules(targets(spark, sf))).select(*ci.PAIR, F.col("pos").cast("long").alias("pos"))


# the statement itself is always the last sentence of its work, so the last sentence of each work is its citing sentence
CITED_SQL = """, lastpos AS (SELECT work_id, max(pos) AS pos FROM sents GROUP BY 1)"""


def refs(cites):
    n = F.regexp_extract("cited_doi", r"(\d+)$", 1).cast("long")
    return cites.filter("cited_doi LIKE '10.1101/%'").filter((n != F.col("work_id")) | (F.col("work_id") % 4 != 1)).select(
        "work_id", F.concat(F.lit("B"), n).alias("ref_id"), F.concat(F.lit("Someone A. A study. doi:"), F.col("cited_doi"), F.lit(";")).alias("ref_text"))


def pointed(spark, sf):
    """Sentences with pointers: the last one to the work's own reference, every fifth one to that of half its number."""
    parts = view(spark, sf, "works").select("work_id", sentence_array(F.col("text")).alias("parts"))
    s = parts.select("work_id", (F.size("parts") - 1).alias("last"), F.posexplode("parts").alias("pos", "sentence"))
    own = F.concat(F.lit("B"), F.col("work_id"))
    half = F.concat(F.lit("B"), F.floor(F.col("work_id") / 2))
    return s.select("work_id", "pos", "sentence", F.array_compact(F.array(
        F.when(F.col("pos") == F.col("last"), own), F.when(F.col("pos") % 5 == 1, half))).alias("ref_ids"))


def cited_pairs(cites):
    return cites.select("work_id", F.regexp_extract("cited_doi", r"(\d+)$", 1).cast("long").alias("target_id")).distinct()


def exact_targets(spark, sf):
    """Targets whose DOI text ends the reference, so that no DOI is a prefix of another one."""
    return targets(spark, sf).withColumn("preprint_doi", F.concat("preprint_doi", F.lit(";")))


CITING = BASE + """, lastpos AS (SELECT work_id, max(pos) AS last FROM sents GROUP BY 1),
  r AS (SELECT work_id, target_id FROM pairs WHERE work_id <> target_id OR work_id % 4 <> 1),
  pt AS (SELECT s.work_id, s.pos, s.work_id AS target_id FROM sents s JOIN lastpos l ON l.work_id = s.work_id AND s.pos = l.last
    UNION SELECT work_id, pos, CAST(floor(work_id / 2) AS BIGINT) FROM sents WHERE pos % 5 = 1),
  f AS (SELECT DISTINCT pt.work_id, pt.target_id, pt.pos FROM pt JOIN r ON r.work_id = pt.work_id AND r.target_id = pt.target_id),
  n AS (SELECT *, row_number() OVER (PARTITION BY work_id, target_id ORDER BY pos) AS rank, count(*) OVER (PARTITION BY work_id, target_id) AS n_sentences FROM f)
"""


@Q.add("citing_sentences", CITING + """ SELECT n.work_id, n.target_id, n.pos, n.rank, n.n_sentences, string_agg(s.sentence, ' ' ORDER BY s.pos) AS ctx FROM n
  JOIN sents s ON s.work_id = n.work_id AND s.pos BETWEEN n.pos - 1 AND n.pos + 1 GROUP BY ALL""")
def citing_sentences(spark, sf):
    cites = written(view(spark, sf, "cites"), "cites")
    c = ci.citing_sentences(refs(cites), pointed(spark, sf), cited_pairs(cites), exact_targets(spark, sf))
    return c.select(*ci.PAIR, F.col("pos").cast("long").alias("pos"), F.col("rank").cast("long").alias("rank"), "n_sentences", F.col("with_neighbours").alias("ctx"))


@Q.add("citer_screening", KEPT + """, rk AS (SELECT *, row_number() OVER (PARTITION BY work_id, target_id ORDER BY pos) AS rn FROM kept WHERE work_id % 10 <> 3)
  SELECT work_id, target_id, string_agg(sentence, '|' ORDER BY rn) FILTER (WHERE rn <= 3) AS sentences,
   bool_and(length(sentence) > 600 OR length(sentence) - length(replace(sentence, '|', '')) > 2 OR len(regexp_extract_all(sentence, '[0-9]+\\.[0-9]+')) > 6) AS f2, bool_or(contains(sentence, '6.4')) AS f3 FROM rk GROUP BY 1, 2""")
def citer_screening(spark, sf):
    hits = pairs(spark, sf).withColumn("has_text", F.col("work_id") % 10 != 3)
    c, _ = ci.screen_citers(hits, sents(spark, sf), None, targets(spark, sf))
    return c.select(*ci.PAIR, F.array_join("sentences", "|").alias("sentences"), F.array_contains("flags", "F2").alias("f2"), F.array_contains("flags", "F3").alias("f3"))


@Q.add("screening_counts", KEPT + """, k AS (SELECT target_id, count(DISTINCT work_id) AS n FROM kept WHERE work_id % 10 <> 3 GROUP BY 1)
  SELECT p.target_id, count(*) AS screened, count(*) FILTER (WHERE work_id % 10 = 3) AS no_full_text, count(*) FILTER (WHERE work_id % 10 <> 3) - coalesce(any_value(k.n), 0) AS no_sentence
  FROM pairs p LEFT JOIN k ON k.target_id = p.target_id GROUP BY 1""")
def screening_counts(spark, sf):
    hits = pairs(spark, sf).withColumn("has_text", F.col("work_id") % 10 != 3)
    return ci.screen_citers(hits, sents(spark, sf), None, targets(spark, sf))[1]


# Flag F1 with citing sentences: the last sentence of every work is its statement and points to its own reference
@Q.add("candidate_flags", KEPT.replace(PATTERN_SQL, PATTERN_SQL) + CITING[len(BASE):] + """, ctx AS (SELECT n.work_id, n.target_id, n.pos, string_agg(s.sentence, ' ' ORDER BY s.pos) AS c FROM n
   JOIN sents s ON s.work_id = n.work_id AND s.pos BETWEEN n.pos - 1 AND n.pos + 1 GROUP BY 1, 2, 3),
  att AS (SELECT work_id, target_id, bool_or(len([x FOR x IN ps IF regexp_matches(c, x)]) > 0) AS a FROM ctx JOIN pats USING (target_id) GROUP BY 1, 2),
  kk AS (SELECT DISTINCT work_id, target_id FROM kept)
  SELECT kk.work_id, kk.target_id, NOT coalesce(a, false) AS f1, r.work_id IS NOT NULL AS reference_matched FROM kk LEFT JOIN att ON att.work_id = kk.work_id AND att.target_id = kk.target_id
   LEFT JOIN (SELECT DISTINCT work_id, target_id FROM r) r ON r.work_id = kk.work_id AND r.target_id = kk.target_id""")
def candidate_flags(spark, sf):
    cites = written(view(spark, sf, "cites"), "cites")
    hits = cited_pairs(cites).withColumn("has_text", F.lit(True))
    c, _ = ci.screen_citers(hits, pointed(spark, sf), None, written(exact_targets(spark, sf), "targets"), refs(cites))
    return c.select(*ci.PAIR, F.array_contains("flags", "F1").alias("f1"), "reference_matched")


HITS_SQL = with_views("affected_citations") + """, hits AS (SELECT drift_event_id % 5 AS target_id, affected_citation_id AS work_id, CAST(scored_at AS DATE) AS d, CASE WHEN work_id % 3 = 0 THEN 'preprint' ELSE 'published' END AS v FROM affected_citations)"""


def hits_view(spark, sf):
    return view(spark, sf, "affected_citations").select(
        (F.col("drift_event_id") % 5).alias("target_id"), F.col("affected_citation_id").alias("work_id"), F.date_format("scored_at", "yyyy-MM-dd").alias("date"),
        F.array(F.when(F.col("work_id") % 3 == 0, "preprint").otherwise("published")).alias("versions"))


@Q.add("screening_plan", HITS_SQL + """, r AS (SELECT target_id, work_id, row_number() OVER (PARTITION BY target_id ORDER BY v <> 'preprint', coalesce(strftime(d, '%Y-%m-%d'), ''), work_id) AS rank FROM hits)
  SELECT target_id, work_id, rank, CAST(floor((rank - 1) / 20) AS BIGINT) AS batch FROM r""")
def screening_plan(spark, sf):
    plan, _ = ci.screening_plan(hits_view(spark, sf))
    return plan.select("target_id", "work_id", F.col("rank").cast("long").alias("rank"), "batch")


@Q.add("screening_capped", HITS_SQL + " SELECT target_id, greatest(count(*) - 2000, 0) AS screen_capped FROM hits GROUP BY 1")
def screening_capped(spark, sf):
    return ci.screening_plan(hits_view(spark, sf), 2000)[1]


@Q.add("incremental_hits", HITS_SQL + " SELECT target_id, work_id FROM hits WHERE v = 'published' AND strftime(d, '%Y-%m-%d') >= '1998-01-01'")
def incremental_hits(spark, sf):
    h = hits_view(spark, sf)
    return ci.incremental_hits(h, h.filter("array_contains(versions, 'preprint')"), "1998-01-01").select("target_id", "work_id")


@Q.add("union_versions", with_views("cites") + """ SELECT work_id, CAST(regexp_extract(cited_doi, '([0-9]+)$', 1) AS BIGINT) AS target_id,
  string_agg(DISTINCT CASE WHEN cited_doi LIKE '10.1101/%' THEN 'preprint' ELSE 'published' END, '|' ORDER BY CASE WHEN cited_doi LIKE '10.1101/%' THEN 'preprint' ELSE 'published' END) AS versions FROM cites GROUP BY 1, 2""")
def union_versions(spark, sf):
    c = view(spark, sf, "cites").select("work_id", F.regexp_extract("cited_doi", r"(\d+)$", 1).cast("long").alias("target_id"), "cited_doi")
    pre, pub = F.col("cited_doi").startswith("10.1101/"), F.lit(True)
    a = c.filter(pre).select("work_id", "target_id", F.lit("preprint").alias("version"))
    b = c.filter(~pre).select("work_id", "target_id", F.lit("published").alias("version"))
    return ci.union_versions(a, b).select("work_id", "target_id", F.array_join("versions", "|").alias("versions"))


CANDS_SQL = with_views("affected_citations") + """, cands AS (SELECT drift_event_id % 40 AS target_id, affected_citation_id AS work_id, affected_citation_id AS position, cites, role, review_status FROM affected_citations)"""


def cands_view(spark, sf):
    return view(spark, sf, "affected_citations").select((F.col("drift_event_id") % 40).alias("target_id"), F.col("affected_citation_id").alias("work_id"),
                                                        F.col("affected_citation_id").alias("position"), "cites", "role", "review_status")


@Q.add("candidate_overview", CANDS_SQL + """, u AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY position) AS rn FROM cands WHERE review_status <> 'approved'),
  n AS (SELECT target_id, count(*) AS n_candidates, count(*) FILTER (WHERE review_status = 'approved') AS n_judged FROM cands GROUP BY 1)
  SELECT u.target_id, work_id, rn, n_candidates, n_judged FROM u JOIN n ON n.target_id = u.target_id WHERE rn BETWEEN 81 AND 120""")
def candidate_overview(spark, sf):
    c = cands_view(spark, sf)
    o = ci.overview(c.drop("cites"), c.filter("review_status = 'approved'"), 3, True)
    return o.select("target_id", "work_id", F.col("rn").cast("long").alias("rn"), "n_candidates", "n_judged")


@Q.add("worker_groups", CANDS_SQL + """, s AS (SELECT target_id, count(*) AS used FROM cands WHERE role = 'background' AND cites = 'current' GROUP BY 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY position) AS rn FROM cands WHERE NOT (role = 'background' AND cites = 'current'))
  SELECT r.target_id, work_id, CAST(floor((rn - 1) / 40) AS BIGINT) AS step, CAST(floor((rn - 1) / 5) AS BIGINT) % 8 AS "group" FROM r""")
def worker_groups(spark, sf):
    c = cands_view(spark, sf)
    return ci.assign_groups(c, c.filter("role = 'background' AND cites = 'current'")).select("target_id", "work_id", "step", "group")


@Q.add("trimmed_groups", CANDS_SQL + """, g AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY length(work_id), position) AS rn FROM cands) SELECT target_id, work_id FROM g WHERE rn <= target_id % 9""")
def trimmed_groups(spark, sf):
    c = cands_view(spark, sf).withColumn("group_no", F.length("work_id"))
    room = c.select("target_id").distinct().withColumn("room", F.col("target_id") % 9)
    return ci.fit_groups(c, room).select("target_id", "work_id")


@Q.add("last_verdict_wins", with_views("affected_citations") + """ SELECT drift_event_id AS target_id, work_id % 20 AS work_id, arg_max(cites, (length(affected_citation_id), affected_citation_id)) AS cites FROM affected_citations GROUP BY 1, 2""")
def last_verdict_wins(spark, sf):
    v = view(spark, sf, "affected_citations").select(F.col("drift_event_id").alias("target_id"), (F.col("work_id") % 20).alias("work_id"), "cites",
                                                     F.length("affected_citation_id").alias("group_no"), F.col("affected_citation_id").alias("position"))
    return ci.dedupe_verdicts(v, v).select("target_id", "work_id", "cites")


@Q.add("verdict_checks", CANDS_SQL + """ SELECT target_id, work_id, CASE WHEN cites = 'superseded' AND role = 'background' THEN 'current' ELSE cites END AS cites,
  CASE WHEN cites = 'superseded' AND role = 'background' THEN 'superseded' END AS was, CASE WHEN cites = 'superseded' AND review_status = 'pending' AND role IN ('background', 'unknown') THEN 'checked' ELSE 'own' END AS sentence,
  CASE WHEN cites = 'superseded' THEN CASE WHEN role IN ('background', 'unknown') THEN 'r' ELSE 'verifier returned no check' END END AS reason FROM cands""")
def verdict_checks(spark, sf):
    c = cands_view(spark, sf)
    v = c.select("target_id", "work_id", "cites", "role", F.lit("own").alias("sentence"), (F.col("review_status") != "pending").alias("sentence_verbatim"), F.lit("").alias("relayed_by"))
    k = c.filter("role IN ('background', 'unknown')").select("target_id", "work_id", F.when(F.col("role") == "background", "current").otherwise("superseded").alias("verdict"), F.lit("r").alias("reason"),
                                                             F.lit("checked").alias("sentence"), F.lit("").alias("relayed_by"))
    return ci.apply_checks(v, k).select("target_id", "work_id", "cites", F.col("verdict_before_verification.cites").alias("was"), "sentence", F.col("verification.reason").alias("reason"))


@Q.add("verdict_evidence", MATCH + CITING[len(BASE):] + """, hc AS (SELECT work_id, target_id, count(*) AS n, md5(string_agg(sentence, '|' ORDER BY pos)) AS shown FROM hits GROUP BY 1, 2),
  near AS (SELECT f.work_id, f.target_id, f.pos, string_agg(s.sentence, ' ' ORDER BY s.pos) AS ctx FROM f JOIN sents s ON s.work_id = f.work_id AND s.pos BETWEEN f.pos - 1 AND f.pos + 1 GROUP BY ALL),
  c AS (SELECT work_id, target_id, count(*) AS n, md5(string_agg(ctx, '|' ORDER BY pos)) AS shown FROM near GROUP BY 1, 2)
  SELECT p.work_id, p.target_id, coalesce(c.n, 0) AS n_citing, coalesce(c.shown, md5('')) AS citing_md5, coalesce(hc.n, 0) AS n_value, coalesce(hc.shown, md5('')) AS value_md5, p.work_id % 2 = 0 AS verbatim,
   EXISTS (SELECT 1 FROM r WHERE r.work_id = p.work_id AND r.target_id = p.target_id) AS reference_matched FROM pairs p
   LEFT JOIN hc ON hc.work_id = p.work_id AND hc.target_id = p.target_id LEFT JOIN c ON c.work_id = p.work_id AND c.target_id = p.target_id""")
def verdict_evidence(spark, sf):
    w = view(spark, sf, "works").select("work_id", "text")
    cites = written(view(spark, sf, "cites"), "cites")
    v = cited_pairs(cites).join(w.select("work_id", F.when(F.col("work_id") % 2 == 0, F.concat(F.lit(" "), F.substring_index("text", ". ", -1))).otherwise("an invented sentence of no work").alias("sentence")), "work_id")
    v = written(v, "verdicts")
    e = ci.evidence(v, refs(cites), pointed(spark, sf), w, exact_targets(spark, sf))
    return e.select(*ci.PAIR, "reference_matched", F.size("sentences_citing_target").cast("long").alias("n_citing"), F.md5(F.array_join("sentences_citing_target", "|")).alias("citing_md5"),
                    F.size("sentences_with_old_value").cast("long").alias("n_value"), F.md5(F.array_join("sentences_with_old_value", "|")).alias("value_md5"),
                    F.col("sentence_verbatim").alias("verbatim"))


@Q.add("search_again", "SELECT doc_id AS work_id, doc_id AS target_id, 'search_more:75 out of 148' AS source FROM documents WHERE doc_id % 8 = 7 AND doc_id % 97 = 75")
def search_again(spark, sf):
    t = targets(spark, sf)
    ask = t.select("target_id", F.concat(F.col("target_id") % 97, F.lit(" out of 148, "), F.get("terms", F.lit(0))).alias("terms"))
    h = pairs(spark, sf).withColumn("has_text", F.lit(True))
    _, found = ci.search_more(ask, t, h, sents(spark, sf), h.limit(0))
    return found.select(*ci.PAIR, "source")


@Q.add("covered_spellings", f"""SELECT doc_id AS target_id, concat('about ', {OLD_TERMS.replace("CASE CAST(floor(doc_id / 8) AS BIGINT) % 3 WHEN 0 THEN ''", "CASE 2 WHEN 0 THEN ''")}) AS spelling FROM documents WHERE doc_id % 8 <> 3""")
def covered_spellings(spark, sf):
    t = targets(spark, sf)
    ask = t.select("target_id", F.concat(F.lit("one half, about "), F.get("terms", F.lit(0))).alias("terms"))
    covered, _ = ci.split_proposed(ask, t)
    return covered


@Q.add("citation_chains", KEPT.replace(PAIRS_SQL, """pairs AS (SELECT doc_id AS work_id, CAST(floor(doc_id / 2) AS BIGINT) AS target_id FROM documents WHERE doc_id > 0
   UNION SELECT doc_id, CAST(floor(doc_id / 4) AS BIGINT) FROM documents WHERE doc_id > 0)""") + """, k AS (SELECT DISTINCT work_id, target_id FROM kept),
  h1 AS (SELECT * FROM k WHERE floor(work_id / 2) = target_id), h2 AS (SELECT k.* FROM k JOIN h1 ON h1.work_id = floor(k.work_id / 2) AND h1.target_id = k.target_id WHERE floor(k.work_id / 2) <> k.target_id)
  SELECT work_id, target_id, 1 AS hop FROM h1 UNION ALL SELECT work_id, target_id, 2 FROM h2""")
def citation_chains(spark, sf):
    t = targets(spark, sf)
    citing = view(spark, sf, "works").select("work_id", F.floor(F.col("work_id") / 2).alias("cited_work"))
    relays = t.select("target_id", F.col("target_id").alias("work_id"))
    return ci.follow_chain(citing, relays, sents(spark, sf), t, relays).select("work_id", "target_id", "hop")
