"""Queries of the text, key, quantity and document operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, quantity, text
from ..operators import documents as docs
from .book import Book
from .views import load, view, with_views

Q = Book()

NORM = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
SQUASH = "regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"
STRIP = "regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def norm_sql(x: str) -> str:
    return NORM.replace("{x}", x)


def squash_sql(x: str) -> str:
    return SQUASH.replace("{x}", x)


SENTENCES = """string_split(regexp_replace({x}, '([.!?])\\s+([A-Z\\[(])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"""
# number and key of a statement: n.t with t = 0 dropped
KEY = "concat(doc_id % 97, CASE WHEN doc_id % 10 = 0 THEN '' ELSE concat('.', doc_id % 10) END)"
RAW = "concat(doc_id % 97, '.', doc_id % 10)"

UNITS_SQL = """units AS (SELECT source AS paper_id, CAST(doc_id AS VARCHAR) AS doc_id, i AS unit_no,
  CASE WHEN i = 0 THEN 'abstract' WHEN i % 5 = 4 THEN 'table' ELSE 'section' END AS kind,
  CASE WHEN i = 0 THEN 'Abstract' WHEN i % 5 = 4 THEN concat('T', i) ELSE concat('Part ', i) END AS title, parts[i + 1] AS text
  FROM (SELECT source, doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(len(parts))) AS u(i)),
blocks AS (SELECT *, CASE WHEN kind = 'table' THEN 'Table: ' || title ELSE title END AS shown,
  '## ' || CASE WHEN kind = 'table' THEN 'Table: ' || title ELSE title END || chr(10) || text AS block FROM units)"""


def units(spark, sf):
    """The lines of every document as its units."""
    lines = load(spark, sf, "documents").select(
        F.col("source").alias("paper_id"), F.col("doc_id").cast("string").alias("doc_id"),
        F.posexplode(F.split("text", "\n")).alias("unit_no", "text"))
    i = F.col("unit_no")
    return lines.select(
        "paper_id", "doc_id", "unit_no",
        F.when(i == 0, "abstract").when(i % 5 == 4, "table").otherwise("section").alias("kind"),
        F.when(i == 0, F.lit("Abstract")).when(i % 5 == 4, F.concat(F.lit("T"), i)).otherwise(F.concat(F.lit("Part "), i)).alias("title"),
        "text")


@Q.add("normalize_doi", """SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE concat('10.1101/', lang, '.', doc_id) END AS doi
  FROM documents""")
def normalize_doi(spark, sf):
    raw = F.expr("""CASE doc_id % 5 WHEN 0 THEN concat(' https://doi.org/10.1101/', upper(lang), '.', doc_id)
      WHEN 1 THEN concat('DOI:10.1101/', lang, '.', doc_id, '  ') WHEN 2 THEN concat('http://doi.org/10.1101/', lang, '.', doc_id)
      WHEN 3 THEN concat('10.1101/', upper(lang), '.', doc_id) ELSE ' doi: ' END""")
    return load(spark, sf, "documents").select("doc_id", keys.normalize_doi(F.regexp_replace(raw, "doi: $", "doi:")).alias("doi"))


@Q.add("composite_keys", """SELECT o_orderkey, concat(o_custkey, '::v', o_orderkey % 4) AS row_key,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat(o_custkey, '::v1::abstract::', o_orderkey % 9) END AS claim_key FROM orders""")
def composite_keys(spark, sf):
    o = load(spark, sf, "orders")
    version = F.concat(F.lit("v"), F.col("o_orderkey") % 4)
    section = F.when(F.col("o_orderkey") % 3 != 0, F.lit("abstract"))
    return o.select("o_orderkey", keys.key_of(F.col("o_custkey"), version).alias("row_key"),
                    keys.key_of(F.col("o_custkey"), F.lit("v1"), section, F.col("o_orderkey") % 9).alias("claim_key"))


@Q.add("event_ids", """WITH d AS (SELECT o_orderkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') ||
   encode(concat('v1-vs-published:10.1101/a', o_orderkey, ':10.1016/p', o_custkey))) AS h FROM orders)
  SELECT o_orderkey, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-',
   substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1), substr(h, 18, 3), '-', substr(h, 21, 12)) AS event_id FROM d""")
def event_ids(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", keys.event_id(
        F.concat(F.lit("10.1101/A"), F.col("o_orderkey")), F.concat(F.lit("10.1016/P"), F.col("o_custkey"))).alias("event_id"))


@Q.add("normalize_versions", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'v1' WHEN 1 THEN concat('v', doc_id) WHEN 2 THEN 'published'
   WHEN 3 THEN concat('v', doc_id % 7, 'b') ELSE 'v1' END AS version,
  CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN doc_id WHEN 2 THEN 1000000 WHEN 3 THEN doc_id % 7 ELSE 1 END AS number FROM documents""")
def normalize_versions(spark, sf):
    raw = F.expr("""CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN concat(' ', doc_id) WHEN 2 THEN 'published'
      WHEN 3 THEN concat('v', doc_id % 7, 'b') ELSE '  ' END""")
    d = load(spark, sf, "documents").select("doc_id", keys.normalize_version(raw).alias("version"))
    return d.withColumn("number", keys.version_num(F.col("version")).cast("long"))


@Q.add("parse_dates", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00Z')
   WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT10:00:00') WHEN 2 THEN strftime(o_orderdate, '%m/%Y') ELSE NULL END AS iso,
  CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-01')
   WHEN 2 THEN strftime(o_orderdate, '%Y-01-01') ELSE NULL END AS from_parts FROM orders""")
def parse_dates(spark, sf):
    o = load(spark, sf, "orders")
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    raw = (F.when(k == 0, F.date_format(d, "yyyy-M-d")).when(k == 1, F.date_format(d, "yyyy-MM-dd'T10:00:00'"))
           .when(k == 2, F.date_format(d, "MM/yyyy")))
    parts = (F.when(k == 0, F.array(F.year(d), F.month(d), F.dayofmonth(d))).when(k == 1, F.array(F.year(d), F.month(d)))
             .when(k == 2, F.array(F.year(d), F.lit(None).cast("int"))))
    return o.select("o_orderkey", keys.parse_date(raw).alias("iso"), keys.date_parts_to_iso(parts).alias("from_parts"))


@Q.add("normalize_authors", """SELECT doc_id, concat('Ann A', doc_id, '|', source, '|Bo Li') AS feed_authors, CAST(3 AS BIGINT) AS n_feed,
  concat('Smith J|O''Neil, b|', upper(lang), ' K') AS citing FROM documents""")
def normalize_authors(spark, sf):
    d = load(spark, sf, "documents")
    feed = keys.normalize_authors(F.concat(F.lit(" Ann A"), F.col("doc_id"), F.lit("; ;"), F.col("source"), F.lit(" and Bo Li ;")))
    cite = keys.citing_authors(F.concat(F.lit("Smith J, O'Neil, b, "), F.upper("lang"), F.lit(" K.")))
    return d.select("doc_id", F.array_join(F.transform(feed, lambda a: a["name"]), "|").alias("feed_authors"),
                    F.size(feed).cast("long").alias("n_feed"),
                    F.array_join(F.transform(cite, lambda a: a["name"]), "|").alias("citing"))


@Q.add("classify_refs", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pmcid' WHEN 1 THEN 'ppr' WHEN 2 THEN 'doi' ELSE 'invalid' END AS kind,
  CASE doc_id % 4 WHEN 0 THEN concat('PMC', doc_id) WHEN 1 THEN concat('PPR', doc_id) WHEN 2 THEN concat('10.1101/X', doc_id) ELSE NULL END AS ref
  FROM documents""")
def classify_refs(spark, sf):
    raw = F.expr("""CASE doc_id % 4 WHEN 0 THEN concat(' pmc', doc_id) WHEN 1 THEN concat('PPR', doc_id, ' ')
      WHEN 2 THEN concat('see (doi 10.1101/X', doc_id, ').') ELSE concat('PMC ', doc_id) END""")
    r = keys.classify_ref(raw)
    return load(spark, sf, "documents").select("doc_id", r.alias("r")).select("doc_id", "r.kind", "r.ref")


DECODE = "replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
TAGLESS = "regexp_replace(html, '<[^>]+>', ' ', 'g')"


@Q.add("clean_text", f"""SELECT page_id, {STRIP.replace('{x}', "regexp_replace(regexp_replace(" + DECODE.replace('{x}', 'html') + ", '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')")} AS cleaned,
  regexp_replace({DECODE.replace('{x}', TAGLESS)}, '\\s+', ' ', 'g') AS plain FROM pages""")
def clean_text(spark, sf):
    return load(spark, sf, "pages").select("page_id", text.clean_text(F.col("html")).alias("cleaned"),
                                           text.plain(F.col("html")).alias("plain"))


@Q.add("sentences", f"""WITH s AS (SELECT doc_id, [x FOR x IN [{STRIP.replace('{x}', 'y')} FOR y IN {SENTENCES.replace('{x}', 'text')}] IF x <> ''] AS parts
  FROM documents) SELECT doc_id, i AS pos, parts[i + 1] AS sentence FROM s, unnest(range(len(parts))) AS u(i)""")
def sentences(spark, sf):
    out = docs.sentences(load(spark, sf, "documents").select("doc_id", "text"))
    return out.withColumn("pos", F.col("pos").cast("long"))


@Q.add("norm_squash", f"SELECT doc_id, {norm_sql('text')} AS spaced, md5({squash_sql('text')}) AS squashed FROM documents")
def norm_squash(spark, sf):
    return load(spark, sf, "documents").select("doc_id", text.norm(F.col("text")).alias("spaced"),
                                               F.md5(text.squash(F.col("text"))).alias("squashed"))


@Q.add("number_normalisation", """WITH t AS (SELECT work_id, regexp_replace(text, '([^0-9.,·∙⋅])', '\\1\\1', 'g') AS x FROM works),
m AS (SELECT work_id, regexp_extract_all(x, '(?:^|[^0-9.·])([0-9]+(?:[.,·∙⋅][0-9]+)?)', 1) AS ns FROM t)
SELECT work_id, array_to_string([CASE WHEN regexp_full_match(n, '[0-9]{1,3}(,[0-9]{3})+') THEN replace(n, ',', '')
  WHEN regexp_matches(n, '[.,·∙⋅]') THEN regexp_replace(regexp_replace(regexp_replace(n, '[,·∙⋅]', '.'), '0+$', ''), '\\.$', '') ELSE n END
  FOR n IN ns], '|') AS numbers FROM m""".replace("WITH t", with_views("works") + ", t"))
def number_normalisation(spark, sf):
    return view(spark, sf, "works").select("work_id", F.array_join(quantity.numbers(F.col("text")), "|").alias("numbers"))


@Q.add("strip_noise", with_views("statements") + f""" SELECT doc_id, trim(CASE doc_id % 8
  WHEN 0 THEN concat('The mean incubation period was ', {RAW}, ' days .') WHEN 1 THEN concat('Incubation was set to ', doc_id % 97, '·', doc_id % 10, ' .')
  WHEN 2 THEN concat('The range was 0 to ', doc_id % 97 + 2, ' days in .') WHEN 3 THEN concat('In total ', doc_id % 97 + 1, ',500 cases (', {RAW}, '%) had .')
  WHEN 4 THEN concat('We saw ', {RAW}, '0-day delays; .') WHEN 5 THEN concat('The severity score was ', {RAW}, ' in .')
  WHEN 6 THEN old_text ELSE old_text END) AS cleaned FROM statements""")
def strip_noise(spark, sf):
    return view(spark, sf, "statements").select("doc_id", F.trim(quantity.strip_noise(F.col("old_text"))).alias("cleaned"))


STATED = f"""CASE doc_id % 8 WHEN 0 THEN concat({RAW}, ' days') WHEN 1 THEN {RAW} WHEN 2 THEN concat('0 to ', doc_id % 97 + 2, ' days')
  WHEN 3 THEN concat(doc_id % 97 + 1, ',500|', {RAW}, '%') WHEN 4 THEN concat({RAW}, '0 days') WHEN 5 THEN {RAW}
  WHEN 6 THEN concat({RAW}, ' to ', doc_id % 97 + 1, '.5 weeks') ELSE '50.7%' END"""


@Q.add("stated_values", f"SELECT doc_id, {STATED} AS terms FROM documents")
def stated_values(spark, sf):
    v = quantity.stated_values(F.col("old_text"))
    return view(spark, sf, "statements").select("doc_id", F.array_join(F.transform(v, lambda x: x["term"]), "|").alias("terms"))


@Q.add("claim_values", f"""SELECT doc_id, array_to_string(list_sort(list_distinct(CASE doc_id % 8 WHEN 0 THEN [concat({KEY}, ' days'), '4.6', '7.9'] WHEN 1 THEN [{KEY}]
  WHEN 2 THEN ['0 days', concat(doc_id % 97 + 2, ' days')] WHEN 3 THEN [concat(doc_id % 97 + 1, '500 cases'), concat({KEY}, '%')]
  WHEN 4 THEN [concat({KEY}, ' days')] WHEN 5 THEN [{KEY}] WHEN 6 THEN [concat({KEY}, ' weeks'), concat(doc_id % 97 + 1, '.5 weeks')]
  ELSE [concat(doc_id % 97, ''), '148 patients', '50.7%'] END)), '|') AS values FROM documents""")
def claim_values(spark, sf):
    return view(spark, sf, "statements").select("doc_id", F.array_join(quantity.claim_values(F.col("old_text")), "|").alias("values"))


OLD_TERMS = f"""CASE CAST(floor(doc_id / 8) AS BIGINT) % 3 WHEN 0 THEN '' WHEN 1 THEN
  CASE WHEN doc_id % 8 IN (0, 1, 4, 5) AND {KEY} = '6.4' THEN '' WHEN doc_id % 8 = 3 AND {KEY} = '6.4' THEN concat(doc_id % 97 + 1, ',500')
  ELSE {STATED} END ELSE {STATED} END"""


@Q.add("revised_value_terms", f"SELECT doc_id, {OLD_TERMS} AS terms FROM documents")
def revised_value_terms(spark, sf):
    return view(spark, sf, "statements").select(
        "doc_id", F.array_join(quantity.old_value_terms(F.col("old_text"), F.col("new_text")), "|").alias("terms"))


@Q.add("unit_canonicalisation", """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'days' WHEN 1 THEN '%' WHEN 2 THEN 'hours' WHEN 3 THEN 'weeks'
  WHEN 4 THEN 'months' WHEN 5 THEN 'years' WHEN 6 THEN NULL ELSE 'days' END AS unit, concat(doc_id % 97, '.5') AS bare,
  CASE doc_id % 8 WHEN 0 THEN 'days' WHEN 1 THEN '%' WHEN 2 THEN 'hours' WHEN 3 THEN 'weeks' WHEN 4 THEN 'months' WHEN 5 THEN 'years'
  WHEN 6 THEN NULL ELSE 'days' END AS written FROM documents""".replace("concat(doc_id % 97, '.5') AS bare",
      "CASE WHEN doc_id % 8 = 6 THEN concat(doc_id % 97, '.5 kg') ELSE concat(doc_id % 97, '.5') END AS bare"))
def unit_canonicalisation(spark, sf):
    unit = F.expr("""CASE doc_id % 8 WHEN 0 THEN ' d' WHEN 1 THEN ' per cent' WHEN 2 THEN ' hrs' WHEN 3 THEN '-week' WHEN 4 THEN ' mos'
      WHEN 5 THEN ' Yr' WHEN 6 THEN ' kg' ELSE '-Day' END""")
    term = F.concat(F.col("doc_id") % 97, F.lit(".5"), unit)
    return load(spark, sf, "documents").select(
        "doc_id", quantity.term_unit(term).alias("unit"), quantity.value_term(term).alias("bare"),
        quantity.unit_after(F.concat(unit, F.lit(" incubation"))).alias("written"))


@Q.add("spelling_expansion", """WITH t AS (SELECT doc_id, concat(doc_id % 97, '.', doc_id % 9 + 1) AS n FROM documents),
  s AS (SELECT doc_id, n, [n, replace(n, '.', '·'), n || '0'] AS forms FROM t),
  x AS (SELECT doc_id, list_concat([n || ' days'], flatten([[f || ' days', f || '-day', f || ' d'] FOR f IN forms])) AS all_forms FROM s)
  SELECT doc_id, spelling FROM (SELECT DISTINCT doc_id, unnest(all_forms) AS spelling FROM x)""")
def spelling_expansion(spark, sf):
    term = F.concat(F.col("doc_id") % 97, F.lit("."), F.col("doc_id") % 9 + 1, F.lit(" days"))
    return load(spark, sf, "documents").select("doc_id", F.explode(quantity.term_spellings(term)).alias("spelling"))


# a value in four surroundings: alone, at either end of a range, and in a fraction
AROUND = """CASE doc_id % 4 WHEN 0 THEN concat('it was ', doc_id % 97 + 1, '.5 days') WHEN 1 THEN concat('from ', doc_id % 97 + 1, '.5 to 200 days') WHEN 2 THEN concat('CI 0.5–', doc_id % 97 + 1, '.5')
  ELSE concat(doc_id % 97 + 1, ' out of 148 improved') END"""


def around(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.expr(AROUND).alias("s"), F.concat(F.col("doc_id") % 97 + 1, F.when(F.col("doc_id") % 4 < 3, ".5").otherwise("")).alias("term"))
    return d.withColumn("m", F.explode(text.find_all(F.col("s"), quantity.value_pattern(F.col("term")))))


@Q.add("range_ends", "SELECT doc_id, doc_id % 4 IN (1, 2) AS is_end FROM documents WHERE NOT (doc_id % 4 = 3 AND doc_id % 97 + 1 = 148)")
def range_ends(spark, sf):
    m = around(spark, sf).filter("NOT (doc_id % 4 = 3 AND doc_id % 97 + 1 = 148)")
    return m.select("doc_id", quantity.in_range(F.col("s"), F.col("m.start"), F.col("m.end")).alias("is_end"))


@Q.add("whole_quantities", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id % 97 + 1.5 WHEN 1 THEN doc_id % 97 + 1.5 WHEN 2 THEN 0.5 ELSE 100.0::DOUBLE * (doc_id % 97 + 1) / 148 END::DOUBLE AS first,
  CASE doc_id % 4 WHEN 1 THEN 200.0 WHEN 2 THEN doc_id % 97 + 1.5 END::DOUBLE AS second, doc_id % 4 = 3 AS computed FROM documents""")
def whole_quantities(spark, sf):
    q = around(spark, sf).select("doc_id", quantity.quantity_at(F.col("s"), F.col("m.start"), F.col("m.end")).alias("q"))
    return q.select("doc_id", F.get("q.values", F.lit(0)).alias("first"), F.get("q.values", F.lit(1)).alias("second"), "q.computed")


@Q.add("property_matches", """SELECT doc_id, doc_id % 5 IN (0, 1, 2) AS holds FROM documents""")
def property_matches(spark, sf):
    s = F.expr("""CASE doc_id % 5 WHEN 0 THEN concat('The R 0 of ', doc_id) WHEN 1 THEN concat('an Incubation-period of ', doc_id) WHEN 2 THEN concat(doc_id, ' for incubation  period.')
      WHEN 3 THEN concat('preincubation period ', doc_id) ELSE concat('the r01 of ', doc_id) END""")
    p = quantity.property_pattern(F.array(F.lit("incubation period"), F.lit(" R0 "), F.lit("")))
    return load(spark, sf, "documents").select("doc_id", F.regexp_like(s, p).alias("holds"))


@Q.add("old_or_new_verdicts", f"""WITH k AS (SELECT doc_id, {KEY} AS key, CAST(floor(doc_id / 8) AS BIGINT) % 4 AS s FROM documents)
  SELECT doc_id, CASE WHEN s = 3 THEN 'cannot_tell' WHEN key = '6.4' THEN 'unchanged_value' WHEN s = 0 THEN 'uses_old_value'
   WHEN s = 1 THEN 'uses_current_value' ELSE 'mentions_both' END AS verdict,
  CASE WHEN s IN (0, 2) AND key <> '6.4' THEN concat(key, ' days') ELSE '' END AS old_found,
  CASE WHEN s IN (1, 2) AND key <> '6.4' THEN '6.4 days' ELSE '' END AS new_found FROM k""")
def old_or_new_verdicts(spark, sf):
    d = load(spark, sf, "documents")
    num = F.concat(F.col("doc_id") % 97, F.lit("."), F.col("doc_id") % 10)
    s = F.floor(F.col("doc_id") / 8) % 4
    sent = (F.when(s == 0, F.concat(F.lit("we assumed "), num, F.lit(" days [12]"))).when(s == 1, F.lit("now 6·4 (95% CI)"))
            .when(s == 2, F.concat(num, F.lit(" days, later 6.40 days"))).otherwise(F.concat(num, F.lit("% of them"))))
    rows = d.select("doc_id", quantity.claim_values(sent).alias("s"),
                    quantity.claim_values(F.concat(F.lit("mean "), num, F.lit(" days"))).alias("o"),
                    quantity.claim_values(F.lit("mean 6.4 days")).alias("n"))
    v = rows.select("doc_id", quantity.old_or_new(F.col("s"), F.col("o"), F.col("n")).alias("v"))
    return v.select("doc_id", "v.verdict", F.array_join("v.old_values_found", "|").alias("old_found"),
                    F.array_join("v.new_values_found", "|").alias("new_found"))


@Q.add("document_sizes", "WITH " + UNITS_SQL + """, d AS (SELECT paper_id, doc_id, CAST(sum(length(block)) + 2 * (count(*) - 1) AS BIGINT) AS n_chars
  FROM blocks GROUP BY ALL) SELECT paper_id, doc_id, n_chars, CAST(floor(sum(n_chars) OVER (PARTITION BY paper_id) / 4) AS BIGINT) AS est_tokens FROM d""")
def document_sizes(spark, sf):
    return docs.doc_sizes(units(spark, sf))


@Q.add("paper_ids", "SELECT page_id, regexp_replace(lower(trim(url)), '[^A-Za-z0-9.\\-]+', '_', 'g') AS paper_id FROM pages")
def paper_ids(spark, sf):
    return load(spark, sf, "pages").select("page_id", keys.paper_id(F.col("url")).alias("paper_id"))


# the oracle follows the definition literally: a recursive walk over the units of each document
@Q.add("chunk_units", "WITH RECURSIVE " + UNITS_SQL + """, s AS (SELECT paper_id, doc_id, unit_no, row_number() OVER (PARTITION BY doc_id ORDER BY unit_no, p) - 1 AS k, substr(block, p * 2000 + 1, 2000) AS piece
    FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil(length(block) / 2000.0) AS BIGINT)))) AS p FROM blocks)),
  walk AS (SELECT doc_id, k, 0 AS chunk, length(piece) AS size FROM s WHERE k = 0
   UNION ALL SELECT s.doc_id, s.k, w.chunk + CASE WHEN w.size + length(s.piece) > 2000 THEN 1 ELSE 0 END,
    CASE WHEN w.size + length(s.piece) > 2000 THEN 0 ELSE w.size END + length(s.piece) FROM walk w JOIN s ON s.doc_id = w.doc_id AND s.k = w.k + 1)
  SELECT s.paper_id, w.doc_id, CAST(chunk AS BIGINT) AS chunk, count(DISTINCT unit_no) AS n_units, string_agg(piece, chr(10) || chr(10) ORDER BY w.k) AS text
  FROM walk w JOIN s ON s.doc_id = w.doc_id AND s.k = w.k GROUP BY 1, 2, 3""")
def chunk_units(spark, sf):
    return docs.chunk_units(units(spark, sf), 2000).withColumn("chunk", F.col("chunk").cast("long"))


@Q.add("search_in_documents", "WITH " + UNITS_SQL + """, h AS (SELECT doc_id, sum(len(regexp_extract_all(text, '(?i)the|es'))) AS n,
  min(unit_no) FILTER (WHERE regexp_matches(text, '(?i)the|es')) AS u FROM blocks GROUP BY doc_id)
  SELECT h.doc_id, CAST(n AS BIGINT) AS total_hits, CAST(least(n, 8) AS BIGINT) AS n_snippets, b.shown AS first_section,
   CAST(length(regexp_extract(b.text, '(?is)^(.*?)(the|es)', 1)) AS BIGINT) AS first_offset FROM h LEFT JOIN blocks b ON b.doc_id = h.doc_id AND b.unit_no = h.u""")
def search_in_documents(spark, sf):
    u = units(spark, sf)
    asks = u.select("paper_id", "doc_id").distinct().select(F.col("doc_id").alias("query_id"), "paper_id", "doc_id", F.lit("the, es").alias("query"))
    first = F.get("snippets", F.lit(0))
    return docs.search_text(u, asks).select(
        "doc_id", "total_hits", F.coalesce(F.size("snippets"), F.lit(0)).cast("long").alias("n_snippets"),
        first["section"].alias("first_section"), first["offset"].cast("long").alias("first_offset"))


@Q.add("search_sentences", f"""WITH s AS (SELECT doc_id, [x FOR x IN [{STRIP.replace('{x}', 'y')} FOR y IN {SENTENCES.replace('{x}', 'text')}] IF x <> ''] AS parts FROM documents),
  h AS (SELECT doc_id, [x FOR x IN parts IF contains(lower(x), 'th') AND contains(lower(x), 're.')] AS f FROM s)
  SELECT doc_id, CAST(len(f) AS BIGINT) AS n_sentences, array_to_string(f, '|') AS found FROM h""")
def search_sentences(spark, sf):
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("work_id"), "text")
    asks = d.select(F.col("work_id").alias("query_id"), "work_id", F.lit("th , Re.").alias("terms"))
    return docs.search_sentences(docs.sentences(d), asks).select(
        F.col("work_id").alias("doc_id"), "n_sentences", F.array_join("sentences", "|").alias("found"))


@Q.add("read_section", "WITH " + UNITS_SQL + """, a AS (SELECT paper_id, CAST(doc_id AS VARCHAR) AS doc_id, CASE doc_id % 4 WHEN 0 THEN ' part 2' WHEN 1 THEN '6' WHEN 2 THEN 'some part' ELSE 'zz' END AS asked
    FROM (SELECT DISTINCT paper_id, CAST(doc_id AS BIGINT) AS doc_id FROM units)),
  m AS (SELECT a.*, u.unit_no, u.title, u.text, CASE WHEN lower(u.title) = trim(asked) THEN 1 WHEN contains(lower(u.title), trim(asked)) THEN 2
    WHEN asked IN ('some part', ' part 2') AND contains(lower(u.title), 'part') THEN 3 END AS c FROM a LEFT JOIN units u ON u.doc_id = a.doc_id AND u.kind = 'section'),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c NULLS LAST, unit_no) AS rn FROM m)
  SELECT doc_id, CASE WHEN c IS NOT NULL THEN title END AS section, CASE WHEN c IS NULL THEN NULL ELSE text END AS text,
   CASE WHEN c IS NULL THEN (SELECT coalesce(string_agg(title, '|' ORDER BY unit_no), '') FROM units u WHERE u.doc_id = r.doc_id AND kind = 'section') END AS available FROM r WHERE rn = 1""")
def read_section(spark, sf):
    u = units(spark, sf)
    k = F.col("doc_id").cast("long") % 4
    asks = u.select("paper_id", "doc_id").distinct().select(
        F.col("doc_id").alias("request_id"), "paper_id", "doc_id",
        F.when(k == 0, " Part 2").when(k == 1, "6").when(k == 2, "some part").otherwise("zz").alias("title"))
    return docs.read_section(u, asks).select("doc_id", "section", "text", F.array_join("available", "|").alias("available"))


@Q.add("list_documents", "WITH " + UNITS_SQL + """ SELECT paper_id, doc_id, count(*) FILTER (WHERE kind = 'section') AS n_sections,
  count(*) FILTER (WHERE kind = 'table') AS n_tables, CAST(sum(length(block)) + 2 * (count(*) - 1) AS BIGINT) AS n_chars FROM blocks GROUP BY ALL""")
def list_documents(spark, sf):
    return docs.list_documents(units(spark, sf))


@Q.add("list_sections", "WITH " + UNITS_SQL + """ SELECT paper_id, doc_id, kind, row_number() OVER (PARTITION BY doc_id, kind ORDER BY unit_no) - 1 AS index,
  title, CAST(length(text) AS BIGINT) AS n_chars FROM units WHERE kind <> 'abstract'""")
def list_sections(spark, sf):
    return docs.list_sections(units(spark, sf)).withColumn("index", F.col("index").cast("long")).withColumn("n_chars", F.col("n_chars").cast("long"))


@Q.add("get_table", "WITH " + UNITS_SQL + """, t AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY unit_no) - 1 AS index, title AS label,
   text FROM units WHERE kind = 'table')
  SELECT d.doc_id, d.index, label, text FROM (SELECT DISTINCT doc_id, CAST(doc_id AS BIGINT) % 3 AS index FROM units) d LEFT JOIN t ON t.doc_id = d.doc_id AND t.index = d.index""")
def get_table(spark, sf):
    u = units(spark, sf)
    asks = u.select("paper_id", "doc_id").distinct().withColumn("index", F.col("doc_id").cast("long") % 3)
    return docs.get_table(u, asks).select("doc_id", "index", "label", "text")


@Q.add("find_quotes", f"""WITH q AS (SELECT item_id, {norm_sql('text')} AS qn, {squash_sql('text')} AS qs FROM benchmark),
  d AS (SELECT doc_id, {norm_sql('text')} AS dn, {squash_sql('text')} AS ds FROM documents)
  SELECT doc_id, item_id FROM q JOIN d ON length(qn) >= 15 AND (contains(dn, qn) OR contains(ds, qs))""")
def find_quotes(spark, sf):
    quotes = load(spark, sf, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    texts = load(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return docs.find_quotes(quotes, texts).select(F.col("text_id").alias("doc_id"), F.col("quote_id").alias("item_id"))


# each document's own quote from a place anywhere in its text, and one of all benchmark passages
PLACE = "CAST(1 + doc_id * 7919 % greatest(1, length(text) - 90) AS INT)"
EVIDENCE_SQL = f"""quotes AS (SELECT source AS paper_id, CAST(doc_id AS VARCHAR) AS doc_id, 0 AS k, substr(text, {PLACE}, 90) AS quote FROM documents
  UNION ALL SELECT d.source, CAST(d.doc_id AS VARCHAR), 1, b.text FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"""
VERIFIED_SQL = "WITH " + UNITS_SQL + ", " + EVIDENCE_SQL + f""", f AS (SELECT doc_id, string_agg(block, chr(10) || chr(10) ORDER BY unit_no) AS full_text FROM blocks GROUP BY doc_id),
  fn AS (SELECT doc_id, {norm_sql('full_text')} AS dn, {squash_sql('full_text')} AS ds FROM f),
  un AS (SELECT doc_id, unit_no, shown, {norm_sql('text')} AS t FROM blocks),
  v AS (SELECT q.doc_id, q.k, q.quote, {norm_sql('quote')} AS qn, length({norm_sql('quote')}) >= 15 AND (contains(dn, {norm_sql('quote')}) OR contains(ds, {squash_sql('quote')})) AS verified
   FROM quotes q JOIN fn ON fn.doc_id = q.doc_id),
  p AS (SELECT v.doc_id, v.k, min(unit_no) AS unit_no FROM v JOIN un ON un.doc_id = v.doc_id AND verified AND contains(t, qn) GROUP BY 1, 2)"""


def evidence(spark, sf):
    d = load(spark, sf, "documents")
    own = d.select(F.col("source").alias("paper_id"), F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("k"),
                   F.expr(f"substring(text, {PLACE}, 90)").alias("quote"))
    b = load(spark, sf, "benchmark").withColumnRenamed("text", "quote")
    other = d.join(b, b.item_id == d.doc_id % b.count()).select(
        F.col("source").alias("paper_id"), F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("k"), "quote")
    return own.unionByName(other)


@Q.add("quote_verification", VERIFIED_SQL + """ SELECT v.doc_id, v.k, v.verified, un.shown AS section, instr(un.t, v.qn) - 1 AS "offset"
  FROM v LEFT JOIN p ON p.doc_id = v.doc_id AND p.k = v.k LEFT JOIN un ON un.doc_id = p.doc_id AND un.unit_no = p.unit_no""")
def quote_verification(spark, sf):
    out = docs.verify_quotes(evidence(spark, sf), units(spark, sf))
    return out.select("doc_id", "k", "verified", "section", F.col("offset").cast("long").alias("offset"))


@Q.add("flat_quote_verification", with_views("works") + f""" SELECT w.work_id, length({norm_sql('b.text')}) >= 15 AND (contains({norm_sql('w.text')}, {norm_sql('b.text')})
   OR contains({squash_sql('w.text')}, {squash_sql('b.text')})) AS verified FROM works w JOIN benchmark b ON b.item_id = w.work_id % (SELECT count(*) FROM benchmark)""")
def flat_quote_verification(spark, sf):
    b = load(spark, sf, "benchmark")
    w = view(spark, sf, "works")
    quotes = w.join(b, b.item_id == w.work_id % b.count()).select("work_id", b.text.alias("quote"))
    return docs.verify_flat_quotes(quotes, w.select("work_id", "text")).select("work_id", "verified")


@Q.add("verification_summary", VERIFIED_SQL + """ SELECT CAST(doc_id AS BIGINT) AS event_id, count(*) AS quotes_total, count(*) FILTER (WHERE verified) AS quotes_verified,
  CASE WHEN count(*) FILTER (WHERE verified) = count(*) THEN 'verified' WHEN count(*) FILTER (WHERE verified) > 0 THEN 'partial' ELSE 'unsupported' END AS status FROM v GROUP BY doc_id""")
def verification_summary(spark, sf):
    prov = docs.verify_quotes(evidence(spark, sf), units(spark, sf)).select(F.col("doc_id").cast("long").alias("event_id"), "verified")
    events = load(spark, sf, "documents").select(F.col("doc_id").alias("event_id"))
    return docs.verification_summary(events, prov)


@Q.add("provenance_rows", VERIFIED_SQL + """ SELECT CAST(v.doc_id AS BIGINT) AS event_id, v.k AS evidence_idx, '10.1016/p' || v.doc_id AS doi, 'published' AS version,
  coalesce(un.shown, 'Claimed') AS section, instr(un.t, v.qn) - 1 AS "offset", v.verified FROM v LEFT JOIN p ON p.doc_id = v.doc_id AND p.k = v.k
  LEFT JOIN un ON un.doc_id = p.doc_id AND un.unit_no = p.unit_no""")
def provenance_rows(spark, sf):
    e = evidence(spark, sf).groupBy("paper_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "quote"))).alias("q"))
    diffs = e.select(
        F.col("doc_id").cast("long").alias("event_id"), "paper_id", F.lit(0).alias("claim_diff_idx"),
        F.concat(F.lit("10.1101/"), F.col("doc_id")).alias("preprint_doi"), F.concat(F.lit("10.1016/p"), F.col("doc_id")).alias("published_doi"),
        F.transform("q", lambda x: F.struct(F.col("doc_id").alias("doc_id"), F.lit("Claimed").alias("section"), x["quote"].alias("quote"))).alias("evidence"))
    return docs.build_provenance(diffs, units(spark, sf)).select(
        "event_id", F.col("evidence_idx").cast("int").alias("evidence_idx"), "doi", "version", "section", F.col("offset").cast("long").alias("offset"), "verified")
