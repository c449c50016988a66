"""Finding the revised claims a sentence or a reference line is about: keyword and vector ranking, rank fusion, exact
candidates, hints, and matching of reference lists."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import DOI_PATTERN, doi_in
from ..functions.quantity import claim_values, old_or_new
from ..functions.text import content_words, let, strip
from ..session import BROADCAST_BYTES, broadcast_if_small, steady_unions, written
from .documents import contains_pairs
from .ranking import bm25, vector_rank
from .records import build_targets

# ---- Fixed values ------------------------------------------------------------------------------------------------------
STOP_WORDS = ("a an the of in on for and or to with from by at as is are among between during its their after into versus vs").split()
RRF_K, DEPTH, TOP_EVENTS, MAX_EXACT, MAX_WEAK = 60, 100, 10, 5, 3
PAIR_BLOCK, SALTS = 1 << 10, 64  # ids of a block of exact candidates, and tasks that a common field is dealt out to beyond a broadcast
TITLE_ACCEPT, TITLE_POSSIBLE, SHORT_PRECISION = 0.85, 0.6, 0.8
# ---------------------------------------------------------------------------------------------------------------------------
_STRINGS = "array<string>"


# ---- the index of changes -------------------------------------------------------------------------------------------------
def build_change_index(events: DataFrame) -> DataFrame:
    """One row per change with text: author and title in front; values only in the old text, only in the new
    one, and in both. Rejected events and events without a tier are left out."""
    e = events.filter(~F.col("review_status").eqNullSafe(F.lit("rejected")) & F.col("fulltext_tier").isNotNull())
    d = e.select("event_id", "paper_id", "preprint_doi", "published_doi", "first_author", "preprint_title", F.posexplode("claim_diffs").alias("claim_diff_idx", "d"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    body = F.trim(F.array_join(F.filter(F.array(text("d.preprint_text"), text("d.change_description")), lambda x: x != ""), " "))
    known = (text("first_author") != "") | (text("preprint_title") != "")
    prefix = F.when(known, F.concat(text("first_author"), F.lit(" et al. "), text("preprint_title"), F.lit(". "))).otherwise("")
    rows = d.withColumn("body", body).filter("body <> ''").withColumn("o", claim_values(F.col("d.preprint_text"))).withColumn(
        "n", claim_values(F.col("d.published_text")))
    return rows.select(
        F.concat_ws("::", F.col("event_id").cast("string"), F.col("claim_diff_idx").cast("string")).alias("change_id"), "event_id", "claim_diff_idx",
        "paper_id", F.lower("preprint_doi").alias("preprint_doi"), F.lower("published_doi").alias("published_doi"),
        F.nullif(F.lower(text("first_author")), F.lit("")).alias("first_author"),
        F.array_except("o", "n").alias("old_values"), F.array_except("n", "o").alias("new_values"), F.array_intersect("o", "n").alias("shared_values"),
        F.col("d.root_cause").alias("root_cause"), F.col("d.severity_tier").alias("severity_tier"),
        F.concat(prefix, "body").alias("text"), F.col("d.preprint_text").alias("preprint_text"),
        F.col("d.published_text").alias("published_text"), F.col("d.change_description").alias("change_description"))


# ---- fusion -----------------------------------------------------------------------------------------------------------------
def rrf(rankings: list[tuple[str, DataFrame]], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of named rankings(query_id, doc_id, rank, score), in the given order of precedence: the sum of
    1 / (k + rank), raw scores kept; ties by first appearance."""
    steady_unions(rankings[0][1].sparkSession)
    every = None
    for i, (name, r) in enumerate(rankings):
        one = r.select("query_id", "doc_id", "rank", "score", F.lit(i).alias("i"), F.lit(name).alias("name"))
        every = one if every is None else every.unionByName(one)
    raw = [F.coalesce(F.max(F.when(F.col("name") == n, F.col("score"))), F.lit(0.0)).alias(f"{n}_score") for n, _ in rankings]
    fused = every.groupBy("query_id", "doc_id").agg(
        F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("s"), F.min(F.struct("i", "rank")).alias("seen"), *raw)
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("s", 12)), "seen")
    return fused.withColumn("fused_rank", F.row_number().over(w)).withColumn("rrf", F.round("s", 5)).drop("s", "seen")


def best_per_event(ranked: DataFrame, k: int = TOP_EVENTS) -> DataFrame:
    """ranked(query_id, event_id, fused_rank, ...): the best change per event, then the first k events with a dense rank."""
    a = W.partitionBy("query_id", "event_id").orderBy("fused_rank")
    b = W.partitionBy("query_id").orderBy("fused_rank")
    first = ranked.withColumn("_a", F.row_number().over(a)).filter("_a = 1").drop("_a")
    return first.withColumn("retrieval_rank", F.row_number().over(b)).filter(F.col("retrieval_rank") <= k)


# ---- exact candidates and hints ------------------------------------------------------------------------------------------------
def prepare_sentences(sents: DataFrame, per_request: int | None = None, max_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """sents(request_id, pos, sentence): blank ones dropped; with limits the first ones of a request are checked, each up to so many
    characters. And per request how many were submitted and ignored."""
    s = sents.withColumn("sentence", strip(F.col("sentence"))).filter("sentence <> ''")
    w = W.partitionBy("request_id").orderBy("pos")
    kept = s if per_request is None else s.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_request).drop("rn")
    ignored = F.lit(0).cast("long") if per_request is None else F.greatest(F.count("*") - per_request, F.lit(0))
    n = s.groupBy("request_id").agg(F.count("*").alias("n_submitted"), ignored.alias("n_ignored"))
    if max_chars is None:
        return kept.withColumn("truncated", F.lit(False)), n
    return kept.withColumn("truncated", F.length("sentence") > max_chars).withColumn("sentence", F.substring("sentence", 1, max_chars)), n


def with_values(sents: DataFrame) -> DataFrame:
    return sents.withColumn("values", claim_values(F.col("sentence")))


def _names(sentence: Column) -> Column:
    return F.transform(F.regexp_extract_all(sentence, F.lit(r"[A-Z][A-Za-z'\-]+"), F.lit(0)), F.lower)


def _dois(sentence: Column) -> Column:
    return F.transform(F.regexp_extract_all(sentence, F.lit(DOI_PATTERN), F.lit(0)), lambda d: F.regexp_replace(F.lower(d), r"\.+$", ""))


def exact_candidates(sents: DataFrame, index: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """sents(query_id, sentence, values): changes whose author is a capitalised word of the sentence, that share a value, or
    whose DOI stands in it: (query_id, change_id). There are as many rows as pairs: a value that many sentences and many changes state
    gives all of them.

    Ids meet in an equi-join of blocks, which hold about `block` ids that share a field; so a join row stands for many pairs, and those
    of a common field are dealt out over the tasks. A pair comes out where the first of its shared fields meets, so it comes out once and
    pairs are not shuffled; whether a field is the first one is asked once for all ids of a block with the same fields before it."""
    steady_unions(sents.sparkSession)
    none = F.array().cast(_STRINGS)

    def keyed(of: DataFrame, key: str, *fields: Column) -> DataFrame:
        # in the order of authors, values, DOIs: so a DOI, which hardly two changes share, does not tell changes apart before values
        of_kind = lambda kind, c: F.coalesce(F.transform(F.array_compact(c), lambda x: F.concat(F.lit(kind), x)), none)
        each = [of_kind(kind, c) for kind, c in zip(("a:", "v:", "w:"), fields)]
        return written(of.select(F.struct(F.col(key)).alias("id"), F.explode(F.array_distinct(F.concat(*each))).alias("k")), f"{key}-fields")

    def units(rows: DataFrame, other: DataFrame) -> DataFrame:
        """By field and the fields before it: ids, at most about a block of them."""
        rows = rows.join(broadcast_if_small(other.select("k").distinct(), 64), "k", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("k")).alias("all"))
        before = F.filter("all", lambda x: x < F.col("k"))
        rows = written(rows.select("id", "all", F.explode("all").alias("k")).select("id", "k", before.alias("before")), "by-field")
        parts = rows.groupBy("k", "before").agg(F.ceil(F.count("*") / block).alias("n")).filter("n > 1")  # few: one for a block of rows
        part = F.coalesce(F.pmod(F.xxhash64("id"), F.col("n")), F.lit(0))
        return written(rows.join(F.broadcast(parts), ["k", "before"], "left").groupBy("k", "before", part.alias("part")).agg(F.collect_list("id").getField(rows.schema["id"].dataType.names[0]).alias("ids")), "units")

    def blocks(of: DataFrame, name: str, tasks: int) -> DataFrame:
        n = of.groupBy("k").agg(F.ceil(F.sum(F.size("ids")) / block).alias("n")).filter("n > 1")
        dealt = of.join(F.broadcast(n), "k", "left").withColumn("b", F.coalesce(F.pmod(F.xxhash64("before", "part"), F.col("n")), F.lit(0)))
        return dealt.repartition(tasks, "k", "b").groupBy("k", "b").agg(F.collect_list(F.struct("before", "ids")).alias(name))

    s = keyed(sents, "query_id", _names(F.col("sentence")), F.col("values"), _dois(F.col("sentence")))
    c = keyed(index, "change_id", F.array("first_author"), F.concat("old_values", "new_values", "shared_values"), F.array("preprint_doi", "published_doi"))
    size = lambda u: u.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    asked = units(s, c)
    n_units, n_ids = size(asked)
    if not n_ids:
        return sents.select("query_id").crossJoin(index.select("change_id")).limit(0)
    s, c = asked, units(c, asked)
    tasks = max(4 * s.sparkSession.sparkContext.defaultParallelism, -(-size(c)[1] // (64 * block)))
    s, c = blocks(s, "of_sentences", tasks).drop("b"), blocks(c, "of_changes", tasks)
    if 256 * n_units + 32 * n_ids <= BROADCAST_BYTES:
        met = c.join(F.broadcast(s), "k")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        met = c.withColumn("salt", (F.col("b") % SALTS).cast("int")).join(s.withColumn("salt", salts), ["k", "salt"])
    met = _streamed(_streamed(met).select("of_changes", F.explode("of_sentences").alias("s"))).select("s", F.explode("of_changes").alias("c"))
    met = _streamed(met.filter((F.size("s.before") == 0) | (F.size("c.before") == 0) | ~F.arrays_overlap("s.before", "c.before")))
    return _streamed(met.select(F.col("s.ids").alias("s"), F.explode("c.ids").alias("change_id"))).select(F.explode("s").alias("query_id"), "change_id")


def _streamed(df: DataFrame) -> DataFrame:
    """The same rows and partitions. Compiled stages keep all rows that come of one row until they are read; this ends a stage."""
    return df.coalesce(1 << 20)


def _told_apart(of: DataFrame, key: str, *cols: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key stands for one content, and those whose key stands for several."""
    several = of.groupBy(key).agg((F.min(F.struct(*cols)) != F.max(F.struct(*cols))).alias("_n")).filter("_n").select(F.col(key).alias("_k"))
    same = F.col(key).eqNullSafe(F.col("_k"))
    return of.join(several, same, "left_anti"), of.join(several, same, "left_semi")


def leading_candidates(sents: DataFrame, index: DataFrame, room: DataFrame, most: int = MAX_EXACT + TOP_EVENTS) -> DataFrame:
    """Of the exact candidates those that can be among the best events of a sentence: (query_id, change_id). room(query_id, room): how
    many events of a sentence are wanted, at most `most`; without a row MAX_EXACT.

    Candidates are ordered by author or DOI hint, by number of values, then by event. Sentences with the same values (and changes with the
    same values) are compared once, each side kept as its first `most` events, and so are the changes of an author; so a value or name
    common to many sentences and changes costs their sum, not their product. A DOI that stands in a sentence gives all its changes."""
    one, odd_s = _told_apart(sents, "query_id", "sentence")
    sig, odd_c = _told_apart(index, "change_id", "event_id", "first_author", "preprint_doi", "published_doi", "old_values", "new_values", "shared_values")
    empty = F.coalesce(F.col("preprint_doi") == "", F.lit(False)) | F.coalesce(F.col("published_doi") == "", F.lit(False))  # stands in every sentence
    change = sig.select("change_id", "event_id", "first_author", empty.alias("any_doi"), F.concat("old_values", "shared_values").alias("old"), F.concat("new_values", "shared_values").alias("new"))

    def first(of: DataFrame, keys: list[str]) -> DataFrame:
        """By class of changes: its first events, each with its first change."""
        each = of.groupBy(*keys, "event_id").agg(F.min("change_id").alias("change_id"))
        return each.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy("event_id"))).filter(F.col("rn") <= most)

    # names: which of them the sentence's hint confirms
    word = F.concat(F.lit(r"(?i)(?<![A-Za-z])\Q"), F.col("tag"), F.lit(r"\E(?![A-Za-z])"))
    names = (one.select("query_id", "sentence", F.explode(F.array_distinct(_names(F.col("sentence")))).alias("tag"))
             .join(change.select(F.col("first_author").alias("tag")).distinct(), "tag", "left_semi")
             .select("query_id", "tag", (F.contains(F.lower("sentence"), F.col("tag")) & F.regexp_like("sentence", word)).alias("named")).distinct())
    of_author = first(change.filter("first_author IS NOT NULL").withColumnRenamed("first_author", "tag"), ["tag", "any_doi"])
    by_name = names.join(of_author, "tag").filter("named OR any_doi").select("query_id", "change_id", "rn")

    # values, of all changes (no tag) and of those of an author in the sentence; only values that a change states can count
    number = lambda v: F.substring_index(v, " ", 1)
    tags = F.array_distinct(F.array(F.lit(""), F.coalesce("first_author", F.lit(""))))
    kinds = first(change.filter(F.size("old") + F.size("new") > 0).withColumn("tag", F.explode(tags)), ["tag", "any_doi", "old", "new"])
    kinds = kinds.groupBy("tag", "any_doi", "old", "new").agg(F.collect_list(F.struct("event_id", "change_id")).alias("first"))
    keys = F.concat("old", "new")
    stated = one.select("query_id", F.explode("values").alias("k")).join(
        change.select(F.explode(F.concat(keys, F.transform(keys, number))).alias("k")).distinct(), "k", "left_semi").groupBy("query_id").agg(F.array_sort(F.collect_set("k")).alias("stated"))
    none = stated.select("query_id", F.lit("").alias("tag"), F.lit(False).alias("named"), "stated")
    asked = none.unionByName(stated.join(names, "query_id").select(none.columns))
    posted = kinds.withColumn("k", F.explode(F.array_distinct(F.when(F.col("tag") == "", keys).otherwise(F.concat(keys, F.transform(keys, number))))))
    met = asked.select("tag", "named", "stated").distinct().withColumn("k", F.explode("stated")).join(posted, ["tag", "k"]).drop("k").distinct()
    met = met.withColumn("numeric", old_or_new(F.col("stated"), F.col("old"), F.col("new"))).withColumn("n", F.size("numeric.old_values_found") + F.size("numeric.new_values_found"))
    met = met.filter((F.col("n") > 0) | (F.col("numeric.verdict") == "unchanged_value") | F.col("any_doi"))
    later = F.struct((~(F.col("any_doi") | F.col("named"))).alias("hint"), (-F.col("n")).alias("n"), F.col("c.change_id").alias("change_id"))
    best = met.withColumn("c", F.explode("first")).groupBy("tag", "named", "stated", F.col("c.event_id").alias("event_id")).agg(F.min(later).alias("b"))
    best = best.withColumn("rn", F.row_number().over(W.partitionBy("tag", "named", "stated").orderBy("b.hint", "b.n", "event_id"))).filter(F.col("rn") <= most)
    by_value = asked.join(best, ["tag", "named", "stated"]).select("query_id", "b.change_id", "rn")
    ranked = by_name.unionByName(by_value).join(room, "query_id", "left").filter(F.col("rn") <= F.coalesce("room", F.lit(MAX_EXACT))).select("query_id", "change_id")

    # DOIs: those read from the sentence, and those that stand in it beside another shared field
    doi = sig.select("*", F.explode(F.array_distinct(F.array_compact(F.array("preprint_doi", "published_doi")))).alias("needle")).filter("needle <> ''")
    read = one.select("query_id", F.explode(F.array_distinct(_dois(F.col("sentence")))).alias("needle")).join(doi.select("needle", "change_id"), "needle").select("query_id", "change_id")
    inside = contains_pairs(doi, one.select(F.col("query_id").alias("text_id"), F.lower("sentence").alias("hay"))).withColumnRenamed("text_id", "query_id")
    shared = F.array_contains(_names(F.col("sentence")), F.col("first_author")) | F.arrays_overlap("values", F.concat("old_values", "new_values", "shared_values"))
    inside = inside.join(doi, "needle").join(one.select("query_id", "sentence", "values"), "query_id").filter(F.coalesce(shared, F.lit(False))).select("query_id", "change_id")
    # a key with several contents: all its pairs
    rest = exact_candidates(odd_s, index).unionByName(exact_candidates(one, odd_c))
    return ranked.unionByName(read).unionByName(inside).unionByName(rest).distinct()


def hints(pairs: DataFrame) -> DataFrame:
    """pairs of a sentence (sentence, values) and a change: adds hints (author, doi, value or shared_value) and the numeric
    comparison."""
    low = F.lower("sentence")
    name = F.concat(F.lit(r"(?i)(?<![A-Za-z])\Q"), F.col("first_author"), F.lit(r"\E(?![A-Za-z])"))
    author = F.coalesce(F.contains(low, F.col("first_author")) & F.regexp_like("sentence", name), F.lit(False))
    doi = F.coalesce(F.contains(low, F.col("preprint_doi")), F.lit(False)) | F.coalesce(F.contains(low, F.col("published_doi")), F.lit(False))
    old_keys, new_keys = F.concat("old_values", "shared_values"), F.concat("new_values", "shared_values")
    p = pairs.withColumn("numeric", old_or_new(F.col("values"), old_keys, new_keys))
    n = F.size("numeric.old_values_found") + F.size("numeric.new_values_found")
    value = F.when(n > 0, "value").when(F.col("numeric.verdict") == "unchanged_value", "shared_value")
    return p.withColumn("hints", F.array_compact(F.array(F.when(author, "author"), F.when(doi, "doi"), value))).withColumn("n_values", n)


def candidates(sents: DataFrame, index: DataFrame, ranked: DataFrame) -> DataFrame:
    """sents(query_id, sentence, values), ranked(query_id, change_id, fused_rank, rrf): the first ten events of the ranking
    (best change each) and up to five events found only by an exact field, best hints first. candidate_no counts from 1."""
    steady_unions(sents.sparkSession)
    sents, index = written(sents, "sentences"), written(index, "change-index")
    top = written(best_per_event(ranked.join(index, "change_id")), "ranked-candidates")
    a = hints(top.join(sents.select("query_id", "sentence", "values"), "query_id"))
    seen = a.select("query_id", "event_id")
    room = seen.distinct().groupBy("query_id").agg((F.count("*") + MAX_EXACT).alias("room"))
    ex = leading_candidates(sents, index, room).join(index, "change_id").join(seen, ["query_id", "event_id"], "left_anti")
    b = hints(ex.join(sents.select("query_id", "sentence", "values"), "query_id")).filter(F.size("hints") > 0)
    key = F.struct((F.array_contains("hints", "author") | F.array_contains("hints", "doi")).alias("a"),
                   F.array_contains("hints", "value").alias("v"), F.col("n_values").alias("n"))
    per_event = W.partitionBy("query_id", "event_id").orderBy(F.desc("key"), "change_id")
    per_query = W.partitionBy("query_id").orderBy(F.desc("key"), "event_id")
    b = (b.withColumn("key", key).withColumn("_e", F.row_number().over(per_event)).filter("_e = 1")
         .withColumn("_q", F.row_number().over(per_query)).filter(F.col("_q") <= MAX_EXACT))
    out = a.withColumn("_q", F.lit(0)).drop("fused_rank").unionByName(b.drop("_e", "key"), allowMissingColumns=True)
    order = W.partitionBy("query_id").orderBy("_q", F.asc_nulls_last("retrieval_rank"))
    return out.withColumn("candidate_no", F.row_number().over(order)).drop("_q")


def assemble_matches(cands: DataFrame, judgements: DataFrame | None, failed: DataFrame | None = None) -> DataFrame:
    """cands with candidate_no, judgements(query_id, candidate_no, refers, value_use, reason): strength and value verdict of
    every candidate, ordered by tier and rank, with weak ones kept up to three per sentence. Sentences without a usable
    reply (all, or those in `failed`) keep their first three candidates as possible."""
    if judgements is None:
        j = cands.withColumn("refers", F.lit(None).cast("string")).withColumn("value_use", F.lit(None).cast("string")).withColumn(
            "reason", F.lit(None).cast("string")).withColumn("_failed", F.lit(True))
    else:
        j = cands.join(judgements, ["query_id", "candidate_no"], "left")
        j = (j.join(failed.select("query_id", F.lit(True).alias("_failed")).distinct(), "query_id", "left") if failed is not None
             else j.withColumn("_failed", F.lit(False)))
    bad = F.coalesce("_failed", F.lit(False))
    refers = F.when(bad, F.when(F.col("candidate_no") <= MAX_WEAK, "possible").otherwise("no")).otherwise(F.coalesce("refers", F.lit("no")))
    use = F.when(bad, F.col("numeric.verdict")).otherwise(F.coalesce("value_use", F.lit("cannot_tell")))
    why = F.when(bad, "judge unavailable").otherwise(F.coalesce("reason", F.lit("not judged")))
    strength = F.when(F.col("refers") == "yes", "strong").when(F.col("refers") == "possible", "possible").otherwise("weak")
    tier = F.when(F.col("strength") == "strong", 0).when(F.col("strength") == "possible", 1).otherwise(2)
    rows = j.withColumn("refers", refers).withColumn("value_use", use).withColumn("reason", why).withColumn("strength", strength)
    rows = rows.withColumn("_t", tier).withColumn("_r", F.coalesce("retrieval_rank", F.lit(TOP_EVENTS + 1)))
    w = W.partitionBy("query_id").orderBy("_t", "_r", "candidate_no")
    in_tier = W.partitionBy("query_id", "_t").orderBy("_r", "candidate_no")
    return (rows.withColumn("position", F.row_number().over(w)).withColumn("_w", F.row_number().over(in_tier))
            .filter((F.col("strength") != "weak") | (F.col("_w") <= MAX_WEAK)).drop("_t", "_r", "_w", "_failed"))


def sentence_results(sents: DataFrame, matches: DataFrame) -> DataFrame:
    """Per sentence the best strength (strong, possible, no_match) and whether a match uses an old value."""
    rel = matches.filter("strength <> 'weak'").groupBy("query_id").agg(
        F.bool_or(F.col("strength") == "strong").alias("strong"), F.bool_or(F.col("value_use").isin("uses_old_value", "mentions_both")).alias("any_old"))
    best = F.when(F.col("strong"), "strong").when(F.col("strong").isNotNull(), "possible").otherwise("no_match")
    return sents.select("query_id").join(rel, "query_id", "left").select("query_id", best.alias("match"), F.coalesce("any_old", F.lit(False)).alias("any_old"))


# ---- reference lists ---------------------------------------------------------------------------------------------------------------
def reference_lines(texts: DataFrame) -> DataFrame:
    """texts(request_id, text): one row per non-empty line with its DOI."""
    lines = texts.select("request_id", F.posexplode(F.filter(F.transform(F.split("text", r"\n+"), strip), lambda x: x != "")).alias("line_no", "full"))
    return lines.select("request_id", "line_no", F.col("full").alias("line"), doi_in(F.col("full")).alias("doi"))


def _library(events: DataFrame) -> DataFrame:
    return events.filter(~F.col("review_status").eqNullSafe(F.lit("rejected")))


def _by_doi(events: DataFrame) -> DataFrame:
    """One row per DOI of the library; the latest event id stands for a DOI shared by several."""
    return (_library(events).select("event_id", F.explode(F.array(F.lower("preprint_doi"), F.lower("published_doi"))).alias("doi"))
            .filter("doi IS NOT NULL").groupBy("doi").agg(F.max("event_id").alias("event_id")))


def check_references(lines: DataFrame, events: DataFrame) -> DataFrame:
    """Lines with a DOI: drift_found, not_in_library (a preprint server's DOI) or not_tracked. Lines without one go through
    the titles."""
    d = lines.filter("doi IS NOT NULL").join(_by_doi(events), "doi", "left")
    status = F.when(F.col("event_id").isNotNull(), "drift_found").when(F.col("doi").startswith("10.1101/"), "not_in_library").otherwise("not_tracked")
    with_doi = d.select("request_id", "line_no", "doi", status.alias("status"), F.when(F.col("event_id").isNotNull(), "doi").alias("matched_by"), "event_id",
                        F.lit(None).cast("double").alias("title_coverage"), F.lit(False).alias("needs_confirmation"))
    t = match_titles(lines.filter("doi IS NULL"), events)
    titled = t.select("request_id", "line_no", F.lit(None).cast("string").alias("doi"),
                      F.when(F.col("kind") == "none", "no_match").otherwise("drift_found").alias("status"), F.when(F.col("kind") != "none", "title").alias("matched_by"),
                      F.when(F.col("kind") != "none", F.col("event_id")).alias("event_id"), "title_coverage", (F.col("kind") == "confirm").alias("needs_confirmation"))
    return with_doi.unionByName(titled)


def title_scores(pairs: DataFrame) -> DataFrame:
    """pairs(line, title, first_author): coverage of the title's content words, precision of the typed words (the last one
    may be a prefix, the author's name counts), title words matched, author match."""
    words = lambda c: content_words(F.col(c), STOP_WORDS)
    p = pairs.withColumn("tw", words("title")).withColumn("lw", words("line")).withColumn("au", F.lower(F.coalesce("first_author", F.lit(""))))
    p = p.withColumn("typed", F.filter("lw", lambda w: ~w.isin("et", "al") & (F.length(w) > 1)))
    cov = F.when(F.size("tw") > 0, F.round(F.size(F.filter("tw", lambda w: F.array_contains("lw", w))) / F.size("tw"), 3)).otherwise(0.0)
    n = F.size("typed")

    def kind(w: Column, i: Column) -> Column:
        """2 for a title word (or a prefix at the end of the line), 1 for the author, else 0."""
        cut = (i == n - 1) & (F.length(w) >= 3) & F.exists("tw", lambda t: F.startswith(t, w))
        return F.when(F.array_contains("tw", w), 2).when((F.col("au") != "") & (w == F.col("au")), 1).when(cut, 2).otherwise(0)

    p = p.withColumn("kinds", F.transform("typed", kind))
    hit = F.size(F.filter("kinds", lambda x: x > 0))
    return p.withColumn("title_coverage", cov).withColumn("line_precision", F.when(n > 0, F.round(hit / n, 3)).otherwise(0.0)).withColumn(
        "title_words_matched", F.size(F.filter("kinds", lambda x: x == 2))).withColumn(
        "author_match", (F.col("au") != "") & F.array_contains("lw", F.col("au"))).drop("tw", "lw", "au", "typed", "kinds")


def match_titles(lines: DataFrame, events: DataFrame, depth: int = 10) -> DataFrame:
    """Per line the best event with kind match, confirm or none, and up to three suggestions when there is none. Candidates
    are the first ten events of the keyword ranking over both titles and the author, so a common name opens no large group."""
    lib = _library(events)
    key = F.concat_ws("#", F.col("request_id").cast("string"), F.col("line_no").cast("string"))
    asked = lines.withColumn("query_id", key)
    q = asked.select("query_id", F.col("line").alias("text"))
    docs = lib.select(F.col("event_id").alias("doc_id"), F.concat_ws(" ", "preprint_title", "published_title", "first_author").alias("text"))
    found = bm25(q, docs, depth).select("query_id", F.col("doc_id").alias("event_id"))
    pairs = found.join(lib.select("event_id", "first_author", "preprint_title", "published_title"), "event_id").join(
        asked.select("query_id", "line"), "query_id")
    fields = F.array(F.struct(F.lit("preprint_title").alias("title_field"), F.col("preprint_title").alias("title")),
                     F.struct(F.lit("published_title").alias("title_field"), F.col("published_title").alias("title")))
    each = pairs.select("query_id", "event_id", "first_author", "line", F.posexplode(F.filter(fields, lambda f: F.coalesce(f["title"] != "", F.lit(False)))).alias("f", "t"))
    s = title_scores(each.select("query_id", "event_id", "first_author", "line", "f", "t.title_field", "t.title"))
    facts = F.struct("title_coverage", "line_precision", (-F.col("f")).alias("o"), "title_field", "title_words_matched", "author_match")
    best = s.groupBy("query_id", "event_id").agg(F.max(facts).alias("b")).select("query_id", "event_id", "b.*")
    order = W.partitionBy("query_id").orderBy(
        F.desc(F.col("title_coverage") >= TITLE_ACCEPT), F.desc(F.round(F.col("line_precision") * F.least("title_words_matched", F.lit(4)), 6)), F.desc("title_coverage"), "event_id")
    useful = F.col("author_match") | ((F.col("title_words_matched") >= 2) & (F.col("title_coverage") >= 0.25))
    r = best.withColumn("rn", F.row_number().over(order)).withColumn("useful", useful)
    top = r.groupBy("query_id").agg(
        F.max(F.when(F.col("rn") == 1, F.struct("event_id", "title_coverage", "line_precision", "title_words_matched", "title_field"))).alias("b"),
        F.slice(F.array_sort(F.collect_list(F.when(F.col("useful"), F.struct("rn", "event_id")))), 1, 3).alias("s"))
    kind = (F.when(F.col("b.title_coverage") >= TITLE_ACCEPT, "match").when(F.col("b.title_coverage") >= TITLE_POSSIBLE, "confirm")
            .when((F.col("b.line_precision") >= SHORT_PRECISION) & (F.col("b.title_words_matched") >= 2), "confirm").otherwise("none"))
    return (asked.join(top, "query_id", "left").withColumn("kind", kind)
            .select("request_id", "line_no", "line", "kind", F.when(F.col("kind") != "none", F.col("b.event_id")).alias("event_id"),
                    F.coalesce("b.title_coverage", F.lit(0.0)).alias("title_coverage"), F.col("b.title_field").alias("title_field"),
                    F.when(F.col("kind") == "none", F.transform("s", lambda x: x["event_id"])).alias("suggestions")))


def cited_events(reflists: DataFrame, events: DataFrame) -> DataFrame:
    """reflists(work_id, refs in lower case): library events (not rejected, with a tier) whose DOI stands in the list, or
    whose author and first 35 title characters do: (work_id, event_id)."""
    lib = _library(events).filter("fulltext_tier IS NOT NULL")
    hay = reflists.select(F.col("work_id").alias("text_id"), F.col("refs").alias("hay"))
    dois = lib.select("event_id", F.explode(F.array(F.lower("preprint_doi"), F.lower("published_doi"))).alias("needle")).filter("needle <> ''")
    by_doi = contains_pairs(dois, hay).join(dois, "needle").select(F.col("text_id").alias("work_id"), "event_id")
    titles = lib.filter("first_author <> '' AND preprint_title <> ''").select(
        "event_id", F.lower("first_author").alias("author"), F.substring(F.lower("preprint_title"), 1, 35).alias("needle"))
    by_title = (contains_pairs(titles, hay).join(titles, "needle").join(hay, "text_id").filter(F.contains("hay", F.col("author")))
                .select(F.col("text_id").alias("work_id"), "event_id"))
    return by_doi.unionByName(by_title).distinct()


def unknown_preprints(reflists: DataFrame, events: DataFrame) -> DataFrame:
    """Preprint-server DOIs of a list that no library event has, version suffix and trailing marks dropped, in order of
    first appearance: (work_id, pos, doi)."""
    found = F.filter(F.regexp_extract_all("refs", F.lit(DOI_PATTERN), F.lit(0)), lambda d: F.startswith(d, F.lit("10.1101/")))
    bare = F.array_distinct(F.transform(found, lambda d: F.regexp_replace(F.regexp_replace(d, r"[.)]+$", ""), r"v\d+$", "")))
    rows = reflists.select("work_id", F.posexplode(bare).alias("pos", "doi"))
    return rows.join(_by_doi(events).select("doi"), "doi", "left_anti").select("work_id", "pos", "doi")


def check_published(works: DataFrame, reflists: DataFrame, events: DataFrame, verdicts: DataFrame, texts: DataFrame,
                    max_targets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Works against the events they cite and those events' targets (with a limit, so many per paper): no_traceable_value,
    not_judged, or judged with old and new text, sentence and whether it is verbatim; and per work the summary."""
    from .documents import verify_flat_quotes
    cited = cited_events(reflists, events).join(works.select("work_id"), "work_id", "left_semi")
    t = build_targets(events).select("event_id", "target_id", "claim_diff_idx", "old_claim", "current_claim")
    jobs = cited.join(t, "event_id", "left")
    if max_targets is not None:
        w = W.partitionBy("work_id").orderBy("event_id", F.asc_nulls_first("claim_diff_idx"))
        jobs = jobs.withColumn("job", F.row_number().over(w)).filter(F.col("job") <= max_targets).drop("job")
    v = verdicts.select("work_id", "target_id", "cites", "role", "sentence", F.lit(True).alias("judged"))
    j = jobs.join(v, ["work_id", "target_id"], "left").withColumn("quote", F.coalesce("sentence", F.lit("")))
    status = F.when(F.col("target_id").isNull(), "no_traceable_value").when(F.col("judged").isNull(), "not_judged").otherwise("judged")
    rows = verify_flat_quotes(j, texts).withColumn("status", status).withColumnRenamed("verified", "sentence_verified").drop("quote", "judged")
    per = rows.groupBy("work_id").agg(
        F.count_distinct("event_id").alias("n_library_preprints_cited"), F.count_if(F.col("status") == "judged").alias("judged"),
        F.count_if(F.col("cites").isin("superseded", "indirect")).alias("relies_on_old_value"))
    return rows, works.select("work_id").join(per, "work_id", "left").fillna(0)
