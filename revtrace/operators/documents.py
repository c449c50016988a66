"""Documents as units (abstract, sections, tables): catalogue, lookup, search, chunking and quote verification.

A unit table has the columns paper_id, doc_id, unit_no, kind (abstract, section, table), title, text."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import after, before, escape_regex, find_all, let, norm, sentence_array, squash, strip, MIN_QUOTE_CHARS

DOC = ["paper_id", "doc_id"]
CHUNK_CHARS = 24_000
CUT_MARK = " …[truncated]"
# key grams per tier, from rare to every position of a text
AUTOMATON_CHARS = 1 << 20  # of all needles together, about 100 MB in a Python worker
ANCHORS = [r"[bgkpvwy0-9].{11}", r".{8}", r".{3}", r"."]


def _heading() -> Column:
    name = F.when(F.col("kind") == "table", F.concat(F.lit("Table: "), F.col("title"))).otherwise(F.col("title"))
    return F.concat(F.lit("## "), name, F.lit("\n"), F.coalesce(F.col("text"), F.lit("")))


def sentences(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per sentence with its position; the text column gives way to `sentence`."""
    keep = [c for c in df.columns if c != text_col]
    return df.select(*keep, F.posexplode(sentence_array(F.col(text_col))).alias("pos", "sentence"))


def full_texts(units: DataFrame) -> DataFrame:
    """One row per document: its text with headings, and its units in order."""
    unit = F.struct("unit_no", F.when(F.col("kind") == "table", F.concat(F.lit("Table: "), F.col("title")))
                    .otherwise(F.col("title")).alias("title"), "text", _heading().alias("block"))
    return (units.groupBy(*DOC).agg(F.array_sort(F.collect_list(unit)).alias("units"))
            .withColumn("full_text", F.array_join(F.transform("units", lambda u: u["block"]), "\n\n")))


def doc_sizes(units: DataFrame) -> DataFrame:
    """Per document characters of the text with headings; per paper tokens = characters over its documents div 4."""
    per_doc = units.groupBy(*DOC).agg(
        (F.sum(F.length(_heading()).cast("long")) + 2 * (F.count("*") - 1)).alias("n_chars"))
    tokens = per_doc.groupBy("paper_id").agg(F.floor(F.sum("n_chars") / 4).alias("est_tokens"))
    return per_doc.join(tokens, "paper_id")


def list_documents(units: DataFrame) -> DataFrame:
    """Per document: sections, tables, characters."""
    return units.groupBy(*DOC).agg(
        F.count_if(F.col("kind") == "section").alias("n_sections"),
        F.count_if(F.col("kind") == "table").alias("n_tables"),
        (F.sum(F.length(_heading()).cast("long")) + 2 * (F.count("*") - 1)).alias("n_chars"))


def list_sections(units: DataFrame) -> DataFrame:
    """Per section and table: its number within its kind, title and length (the abstract is not listed)."""
    w = W.partitionBy(*DOC, "kind").orderBy("unit_no")
    return (units.filter(F.col("kind") != "abstract")
            .select(*DOC, "kind", (F.row_number().over(w) - 1).alias("index"), "title",
                    F.length(F.coalesce("text", F.lit(""))).alias("n_chars")))


def _cut(c: Column, n: int | None) -> Column:
    return c if n is None else F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n), F.lit(CUT_MARK)))


def get_table(units: DataFrame, requests: DataFrame, max_chars: int | None = None) -> DataFrame:
    """requests(paper_id, doc_id, index) -> label and text of the n-th table; null when out of range."""
    w = W.partitionBy(*DOC).orderBy("unit_no")
    wanted = requests.select(*DOC).distinct()
    tables = (units.filter("kind = 'table'").join(wanted, DOC, "left_semi")
              .select(*DOC, (F.row_number().over(w) - 1).alias("index"), F.col("title").alias("label"),
                      _cut(F.col("text"), max_chars).alias("text")))
    return requests.join(tables, [*DOC, "index"], "left")


def read_section(units: DataFrame, requests: DataFrame, max_chars: int | None = None) -> DataFrame:
    """requests(request_id, paper_id, doc_id, title) -> the section: exact title, else the title contains the request,
    else it contains a word of it longer than three; first in document order. A miss lists the titles."""
    ask = F.lower(strip(F.col("asked")))
    name = F.lower(F.col("title"))
    words = F.filter(F.split(ask, r"(?U)\s+"), lambda w: F.length(w) > 3)
    rank = (F.when(name == ask, 1).when(F.contains(name, ask), 2)
            .when(F.exists(words, lambda w: F.contains(name, w)), 3))
    pairs = (requests.withColumnRenamed("title", "asked")
             .join(units.filter("kind = 'section'"), DOC, "left").withColumn("match_class", rank))
    picked = F.min_by(F.struct("title", "text"), F.when(F.col("match_class").isNotNull(), F.struct("match_class", "unit_no")))
    got = pairs.groupBy("request_id", *DOC, "asked").agg(
        picked.alias("hit"), F.array_sort(F.collect_list(F.when(F.col("title").isNotNull(), F.struct("unit_no", "title")))).alias("all"))
    return got.select("request_id", *DOC, "asked", F.col("hit.title").alias("section"), _cut(F.col("hit.text"), max_chars).alias("text"),
                      F.when(F.col("hit").isNull(), F.transform("all", lambda u: u["title"])).alias("available"))


def search_text(units: DataFrame, queries: DataFrame, max_snippets: int = 8, half: int = 220) -> DataFrame:
    """queries(query_id, paper_id, doc_id, query) -> total hits over all units and the first snippets (section, offset,
    match, snippet). The query is an OR of its words; no hit is a result as well."""
    words = F.filter(F.split(strip(F.col("query")), r"(?U)[\s,;]+"), lambda w: w != "")
    asked = queries.withColumn("pattern", F.concat(F.lit("(?iuU)"), F.array_join(F.transform(words, escape_regex), "|")))
    asked = asked.filter(F.size(words) > 0)
    hits = (asked.join(units.select(*DOC, "unit_no", "kind", "title", "text"), DOC)
            .withColumn("n", F.regexp_count(F.coalesce("text", F.lit("")), F.col("pattern")))
            .withColumn("ms", find_all(F.coalesce("text", F.lit("")), F.col("pattern"), max_snippets)))
    name = F.when(F.col("kind") == "table", F.concat(F.lit("Table: "), F.col("title"))).otherwise(F.col("title"))
    per_unit = hits.select(
        "query_id", "unit_no", "n",
        F.transform("ms", lambda m: F.struct(
            F.col("unit_no").alias("unit_no"), m["start"].alias("offset"), name.alias("section"), m["match"].alias("match"),
            F.concat(before(F.col("text"), m["start"], half), m["match"], after(F.col("text"), m["end"], half)).alias("snippet"),
        )).alias("first"))
    found = per_unit.groupBy("query_id").agg(
        F.sum("n").cast("long").alias("total_hits"),
        F.slice(F.array_sort(F.flatten(F.collect_list(F.when(F.size("first") > 0, F.col("first"))))), 1, max_snippets).alias("snippets"))
    return asked.drop("pattern").join(found, "query_id", "left").withColumn("total_hits", F.coalesce("total_hits", F.lit(0)))


def search_sentences(sents: DataFrame, queries: DataFrame, keep: int | None = None) -> DataFrame:
    """sents(work_id, pos, sentence), queries(query_id, work_id, terms) -> sentences holding every comma-separated term
    (literal, any case): all counted; with `keep` the first ones returned, else all."""
    terms = F.filter(F.transform(F.split("terms", ","), lambda t: F.lower(strip(t))), lambda t: t != "")
    hit = F.forall("wanted", lambda t: F.contains(F.lower("sentence"), t))
    pairs = queries.withColumn("wanted", terms).join(sents, "work_id").filter(hit)
    w = W.partitionBy("query_id").orderBy("pos")
    ranked = pairs.withColumn("rn", F.row_number().over(w))
    top = ranked if keep is None else ranked.filter(F.col("rn") <= keep)
    first = top.groupBy("query_id").agg(F.array_sort(F.collect_list(
        F.struct("rn", "sentence"))).alias("s"))
    n = pairs.groupBy("query_id").agg(F.count("*").alias("n_sentences"))
    return (queries.join(n, "query_id", "left").join(first, "query_id", "left")
            .select("query_id", "work_id", "terms", F.coalesce("n_sentences", F.lit(0)).alias("n_sentences"),
                    F.coalesce(F.transform("s", lambda x: x["sentence"]), F.array().cast("array<string>")).alias("sentences")))


def chunk_units(units: DataFrame, limit: int = CHUNK_CHARS) -> DataFrame:
    """Consecutive units of a document packed into chunks: a new one starts when the running size would pass the limit.
    A unit over the limit goes on over as many pieces of that size as it needs. One row per chunk with its text and unit count (a unit
    counts in every chunk that has a piece of it)."""
    whole = units.withColumn("block", _heading())
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.length("block") / limit) - 1))
    pieces = whole.withColumn("piece", F.explode(starts)).withColumn("block", F.expr(f"substring(block, CAST(piece * {limit} AS INT) + 1, {limit})"))
    sized = pieces.withColumn("unit_no", F.struct(F.col("unit_no").cast("int").alias("unit"), F.col("piece").cast("int").alias("piece"))).withColumn("size", F.length("block"))
    # the running size passes over a document's unit lengths in order (numbers only; the texts join back afterwards)
    lengths = sized.select(*DOC, "unit_no", "size").repartition(*DOC).sortWithinPartitions(*DOC, "unit_no")
    schema = T.StructType([*lengths.drop("size").schema.fields, T.StructField("chunk", T.IntegerType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, chunk, filled, n = None, 0, 0, 0
        for b in batches:
            chunks = []
            for *here, size in zip(*(b.column(c).to_pylist() for c in (*DOC, "size"))):
                if here != doc:
                    doc, chunk, filled, n = here, 0, 0, 0
                if n and filled + size > limit:
                    chunk, filled, n = chunk + 1, 0, 0
                filled, n = filled + size, n + 1
                chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*DOC, "unit_no")), pa.array(chunks, pa.int32())], [*DOC, "unit_no", "chunk"])

    placed = lengths.mapInArrow(pack, schema)
    part = F.struct("unit_no", "block")
    return (sized.join(placed, [*DOC, "unit_no"]).groupBy(*DOC, "chunk")
            .agg(F.count_distinct("unit_no.unit").alias("n_units"), F.array_sort(F.collect_list(part)).alias("p"))
            .select(*DOC, "chunk", "n_units", F.array_join(F.transform("p", lambda x: x["block"]), "\n\n").alias("text")))


# ---- Quotes -----------------------------------------------------------------------------------------------------------
def verify_quotes(quotes: DataFrame, units: DataFrame) -> DataFrame:
    """quotes(paper_id, doc_id, quote, ...) plus verified, section, offset. The check runs over the whole document with
    headings; the place is the first single unit that holds the quote, so a match over a unit border or only without
    spaces is verified with no place. An unknown document verifies nothing."""
    wanted = quotes.select(*DOC).distinct()
    docs = full_texts(units.join(wanted, DOC, "left_semi")).select(
        *DOC, norm(F.col("full_text")).alias("doc_norm"), squash(F.col("full_text")).alias("doc_squash"),
        F.transform("units", lambda u: F.struct(u["title"].alias("title"), norm(u["text"]).alias("text"))).alias("unit_norms"))
    q = quotes.withColumn("q_norm", norm(F.col("quote"))).withColumn("q_squash", squash(F.col("quote")))
    long_enough = F.length("q_norm") >= MIN_QUOTE_CHARS
    found = F.contains(F.col("doc_norm"), F.col("q_norm")) | F.contains(F.col("doc_squash"), F.col("q_squash"))
    place = F.get(F.filter("unit_norms", lambda u: F.contains(u["text"], F.col("q_norm"))), F.lit(0))
    return (q.join(docs, DOC, "left")
            .withColumn("verified", F.coalesce(long_enough & found, F.lit(False)))
            .withColumn("hit", F.when(F.col("verified"), place))
            .withColumn("section", F.col("hit.title"))
            .withColumn("offset", F.expr("CASE WHEN hit IS NOT NULL THEN locate(q_norm, hit.text) - 1 END"))
            .drop("hit", "q_norm", "q_squash", "doc_norm", "doc_squash", "unit_norms"))


def verify_flat_quotes(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """quotes(work_id, quote, ...) against flat texts(work_id, text): adds verified."""
    t = texts.join(quotes.select("work_id").distinct(), "work_id", "left_semi").select(
        "work_id", norm(F.col("text")).alias("t_norm"), squash(F.col("text")).alias("t_squash"))
    q = norm(F.col("quote"))
    ok = (F.length(q) >= MIN_QUOTE_CHARS) & (F.contains(F.col("t_norm"), q) | F.contains(F.col("t_squash"), squash(F.col("quote"))))
    return quotes.join(t, "work_id", "left").withColumn("verified", F.coalesce(ok, F.lit(False))).drop("t_norm", "t_squash")


def _grams(c: Column, pattern: str) -> Column:
    """Overlapping grams of a text that fit a pattern, as hashes."""
    return F.transform(F.regexp_extract_all(c, F.lit(rf"(?s)(?=({pattern}))"), F.lit(1)), lambda g: F.xxhash64(g))


def contains_pairs(needles: DataFrame, texts: DataFrame, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """needles(needle), texts(text_id, hay) -> (needle, text_id) of every text that contains a needle; equal needles are searched once,
    a null or empty needle never.

    Needles whose letters together stay within `automaton_chars` become one automaton, and every text is read once, without a shuffle.
    More needles meet the texts in a join on the grams that they share."""
    sought = needles.select("needle").filter(F.length("needle") > 0).distinct()
    if (sought.agg(F.sum(F.length("needle"))).first()[0] or 0) <= automaton_chars:
        return _by_automaton([r.needle for r in sought.collect()], texts)
    return _by_grams(sought, texts)


def _by_automaton(sought: list[str], texts: DataFrame) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(sought)
    schema = T.StructType([T.StructField("needle", T.StringType()), texts.schema["text_id"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        automaton = ahocorasick.Automaton()
        for needle in shared.value:
            automaton.add_word(needle, needle)
        if len(automaton):
            automaton.make_automaton()
        for b in batches:
            at, found = [], []
            for i, hay in enumerate(b.column(1)):
                if len(automaton) and (text := hay.as_py()):
                    hits = {needle for _, needle in automaton.iter(text)}
                    found.extend(hits)
                    at.extend([i] * len(hits))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), b.column(0).take(pa.array(at, pa.int64()))], ["needle", "text_id"])

    return texts.select("text_id", "hay").mapInArrow(run, schema)


def _by_grams(sought: DataFrame, texts: DataFrame) -> DataFrame:
    """Needles and texts meet in an equi-join on the hash of one gram of the needle and `contains` decides on the pairs left.
    Whether a gram is a key depends on its own characters only, so a text that contains the needle has the key as well and
    no match is lost. The first tier keys only grams that start with a rarer character (about one position in eight);
    needles without such a gram, and short ones, take a denser tier, which is computed only when there are any. Of a
    needle's grams the one that fewest needles have is used, so a phrase common to many needles is no hot key."""
    tier = F.coalesce(*[F.when(F.col("needle").rlike(f"(?s){p}"), F.lit(i)) for i, p in enumerate(ANCHORS)])
    sought = sought.withColumn("tier", tier)
    hay = texts.select("text_id", "hay")
    pairs = None
    for i in sorted(sought.agg(F.collect_set("tier")).first()[0]) or [0]:  # at most one number per tier
        each = sought.filter(F.col("tier") == i).select("needle", F.explode(F.array_distinct(_grams(F.col("needle"), ANCHORS[i]))).alias("anchor"))
        often = each.groupBy("anchor").agg(F.count("*").alias("n"))
        part = each.join(often, "anchor").groupBy("needle").agg(F.min_by("anchor", F.struct("n", "anchor")).alias("anchor"))
        posted = hay.select("text_id", F.explode(F.array_distinct(_grams(F.col("hay"), ANCHORS[i]))).alias("anchor"))
        got = posted.join(part, "anchor").select("text_id", "needle")
        pairs = got if pairs is None else pairs.unionByName(got)
    return pairs.distinct().join(hay, "text_id").filter(F.contains("hay", F.col("needle"))).select("needle", "text_id")


def find_quotes(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """quotes(quote_id, quote), texts(text_id, text) -> (quote_id, text_id) of every verbatim match, with no document
    named. A quote stands in a text exactly when its squashed form does (and it is long enough). Equal quotes are searched
    once."""
    q = (quotes.withColumn("needle", squash(F.col("quote"))).filter(F.length(norm(F.col("quote"))) >= MIN_QUOTE_CHARS))
    hits = contains_pairs(q, texts.select("text_id", squash(F.col("text")).alias("hay")))
    return q.join(hits, "needle").select("quote_id", "text_id")


def build_provenance(diffs: DataFrame, units: DataFrame) -> DataFrame:
    """diffs(event_id, paper_id, claim_diff_idx, preprint_doi, published_doi, evidence array<struct<doc_id, section,
    quote>>) -> one row per quote with DOI and version by document, section found else claimed, offset, verified."""
    ev = diffs.select("event_id", "paper_id", "claim_diff_idx", "preprint_doi", "published_doi",
                      F.posexplode("evidence").alias("evidence_idx", "e"))
    flat = ev.select("*", F.coalesce("e.doc_id", F.lit("")).alias("doc_id"), F.coalesce("e.quote", F.lit("")).alias("quote"),
                     F.col("e.section").alias("section_claimed")).drop("e")
    is_pre = F.col("doc_id").startswith("preprint")
    return (verify_quotes(flat, units)
            .withColumn("doi", F.when(is_pre, F.col("preprint_doi")).otherwise(F.col("published_doi")))
            .withColumn("version", F.when(is_pre, F.regexp_replace("doc_id", "^preprint_", "")).otherwise(F.lit("published")))
            .withColumn("section", F.coalesce(F.nullif("section", F.lit("")), "section_claimed"))
            .select("event_id", "claim_diff_idx", "evidence_idx", "doc_id", "doi", "version", "section", "section_claimed",
                    "quote", "offset", "verified"))


def verification_summary(events: DataFrame, provenance: DataFrame) -> DataFrame:
    """Per event: quotes in total and verified, and verified / partial / unsupported (no quotes is unsupported)."""
    n = provenance.groupBy("event_id").agg(F.count("*").alias("quotes_total"), F.count_if("verified").alias("quotes_verified"))
    total, ok = F.coalesce("quotes_total", F.lit(0)), F.coalesce("quotes_verified", F.lit(0))
    status = (F.when((total > 0) & (ok == total), "verified").when(ok > 0, "partial").otherwise("unsupported"))
    return (events.select("event_id").join(n, "event_id", "left")
            .select("event_id", total.alias("quotes_total"), ok.alias("quotes_verified"), status.alias("status")))
