"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, first to sources, then to their shards.

A source is cut into shards by a hash of the document id; a shard's documents stand in a seeded order on one line of words, cut
into blocks of equal size. Highest quotients give each source, and then each of its shards, a whole number of blocks; a shard
takes that many consecutive blocks of its line from a seeded start on, round and round. So nearly all documents are taken whole,
a whole number of times, and a few at a seam in part.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

BLOCK_WORDS = 8
MAX_PASSES = 3  # a source's target stops at so many times its size
SHARD_WORDS = 1_000_000
MAX_SHARDS = 4096  # of one source; beyond it shards grow, by narrow rows only
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(*parts: Column) -> Column:
    """32 hex digits that depend on the seed and the parts."""
    return F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def seeded_number(hexes: Column) -> Column:
    return F.conv(F.substring(hexes, 1, 12), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), passes: int = MAX_PASSES) -> DataFrame:
    """source, size -> and target: shares by weight (cycled over the sources in code-point order, null last) of the total size,
    none above `passes` times its source's size. With sources in the order of capacity per weight, those are full whose capacity
    lies below the level that the words left over give the sources left over."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    n = F.row_number().over(order) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (n % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", w).withColumn("ratio", F.col("size") * float(passes) / F.col("weight"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("level", (F.sum("size").over(everything) - passes * F.coalesce(F.sum("size").over(before), F.lit(0)))
                           / F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    level = F.max("level").over(everything)  # it rises up to the first source that is not full and falls from there
    share = F.least(F.col("size") * float(passes), F.col("weight") * level)
    return rows.withColumn("target", share).drop("weight", "ratio", "level")


def apportion(parties: DataFrame, group: list[str], party: list[str], votes: str, seats: str, most: str) -> DataFrame:
    """Sainte-Lague within each group: `seats` (a number of the group) go to the highest quotients votes / (2k + 1); a party
    gets no more than `most`. Adds `quota`.

    Only quotients near a party's fair share are ranked. Rounding all fair shares misses the seats by half a seat for each party
    at most, and caps (fair shares never exceed them by a seat) by one more; quotients fall in step, so a party with a part p of
    the votes moves by no more than 3 + 3 * p * parties. So about 12 rows for each party are ranked, whatever the seats.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    p = parties.withColumn("_all", F.sum(votes).over(whole)).withColumn("_n", F.count("*").over(whole))
    fair = F.when(F.col("_all") > 0, F.col(seats) * F.col(votes) / F.col("_all")).otherwise(0.0)
    reach = 3 + 3 * F.ceil(F.when(F.col("_all") > 0, F.col(votes) * F.col("_n") / F.col("_all")).otherwise(0.0))
    p = p.withColumn("_sure", F.least(F.col(most), F.greatest(F.lit(0), F.floor(fair) - reach)).cast("long"))
    p = p.withColumn("_last", F.least(F.col(most), (F.ceil(fair) + reach).cast("long")) - 1)
    p = p.withColumn("_left", F.col(seats) - F.sum("_sure").over(whole))
    asked = p.where("_last >= _sure and " + votes + " > 0").select(
        *group, *party, "_left", F.col(votes).alias("_v"), F.explode(F.sequence("_sure", "_last")).alias("_k"))
    best = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(
        (F.col("_v") / (2 * F.col("_k") + 1)).desc(), *[F.col(c).asc_nulls_last() for c in party])
    won = (asked.withColumn("_rank", F.row_number().over(best)).where("_rank <= _left")
           .groupBy(*group, *party).agg(F.count("*").alias("_won")))
    keys = [*group, *party]
    w = won.select(*[F.col(c).alias(f"_w_{c}") for c in keys], "_won")
    on = [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in keys]
    out = p.join(w, on, "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0)))
    return out.select(*parties.columns, "quota")


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), block_words: int = BLOCK_WORDS, passes: int = MAX_PASSES,
        shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and where the taken part starts: passes_whole (times the
    whole text is taken) and [part_from, part_to) and [0, part_wrap) (words taken once more).

    Null texts have size 0 and are taken 0 times; a null source is a source of its own. Rows that repeat a document are counted
    and taken like others. A source without words has target 0. Rows of equal id and size share their order by chance, so the
    result as a set of rows does not depend on it. An empty table gives no rows.
    """
    if "source" not in docs.columns:
        docs = docs.withColumn("source", F.lit(None).cast("string"))
    rows = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("size")), weights, passes)
    whole = Window.partitionBy(F.lit(0))
    sources = sources.withColumn("seats", F.round(F.sum("target").over(whole) / block_words).cast("long"))
    sources = sources.withColumn("most", F.floor(F.col("size") * passes / block_words).cast("long"))
    quotas = apportion(sources, [], ["source"], "target", "seats", "most").withColumn(
        "shards", F.greatest(F.lit(1), F.least(F.lit(MAX_SHARDS), F.ceil(F.col("size") / shard_words))).cast("long"))
    quotas = written(quotas.select(F.col("source").alias("s"), F.col("size").alias("source_size"), "target",
                                   F.col("quota").alias("source_quota"), "shards"), "mix-sources")
    placed = rows.join(quotas, rows.source.eqNullSafe(quotas.s)).drop("s").withColumn("key", seeded(F.col("doc_id")))
    placed = placed.withColumn("shard", F.pmod(seeded_number("key"), F.col("shards")))
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("source_quota").alias("source_quota"))
    shards = shards.withColumn("most", F.floor(F.col("words") * passes / block_words).cast("long"))
    shards = apportion(shards, ["source"], ["shard"], "words", "source_quota", "most")
    start = F.pmod(seeded_number(seeded(F.col("source"), F.col("shard"))), F.greatest(F.col("words"), F.lit(1)))
    shards = shards.select(
        F.col("source").alias("s"), F.col("shard").alias("h"), "words", start.alias("begin"),
        F.when(F.col("words") > 0, F.floor(F.col("quota") * block_words / F.col("words"))).otherwise(0).cast("long").alias("whole"),
        F.when(F.col("words") > 0, F.pmod(F.col("quota") * block_words, F.col("words"))).otherwise(0).cast("long").alias("part"))
    line = Window.partitionBy("source", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("to", F.sum("size").over(line)).withColumn("from", F.col("to") - F.col("size"))
    d = placed.join(shards, placed.source.eqNullSafe(shards.s) & (placed.shard == shards.h))
    end = F.col("begin") + F.col("part")
    part = overlap(F.col("from"), F.col("to"), F.col("begin"), end)
    wrap = overlap(F.col("from"), F.col("to"), F.lit(0), end - F.col("words"))
    d = d.select("doc_id", "source", "size", "source_size", "target", F.col("whole").alias("passes_whole"), part.alias("part_words"), wrap.alias("part_wrap"),
                 F.greatest(F.lit(0), F.col("begin") - F.col("from")).alias("_first"))
    part_from = F.when(F.col("part_words") > 0, F.col("_first")).otherwise(0)
    return d.select("doc_id", "source", "size", "source_size", "target", "passes_whole", part_from.alias("part_from"), (part_from + F.col("part_words")).alias("part_to"),
                    "part_wrap", (F.col("passes_whole") * F.col("size") + F.col("part_words") + F.col("part_wrap")).alias("taken"))


def taken_texts(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """The mix as rows of the columns of `docs`: a document's text as often as it is taken whole, and the words taken in part, joined by
    one space. Documents that are not taken are gone. Rows that repeat an id and have the same text come out as often as one of them."""
    plan = mix(docs, weights).select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), "passes_whole", "part_from", "part_to", "part_wrap").where(
        "passes_whole > 0 or part_to > part_from or part_wrap > 0").dropDuplicates(["_id", "_size"])
    text = F.col("row.text")
    d = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("_doc"), n_words(F.col("text")).alias("_n"))
    d = d.join(plan, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_n") == F.col("_size")))
    # a part that covers all words is the text itself, as it is written
    whole = F.col("passes_whole") + ((F.col("part_to") - F.col("part_from")) == F.col("_size")).cast("long")
    rest = F.when((F.col("part_to") - F.col("part_from")) < F.col("_size"), F.col("part_to") - F.col("part_from")).otherwise(0)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    piece = lambda begin, n: F.array_join(F.slice(words, (begin + 1).cast("int"), n.cast("int")), " ")
    texts = F.concat(F.array_repeat(text, whole.cast("int")),
                     F.when(rest > 0, F.array(piece(F.col("part_from"), rest))).otherwise(F.array().cast("array<string>")),
                     F.when(F.col("part_wrap") > 0, F.array(piece(F.lit(0), F.col("part_wrap")))).otherwise(F.array().cast("array<string>")))
    return d.withColumn("_taken", F.explode(texts)).select(F.col("row").withField("text", F.col("_taken")).alias("row")).select("row.*")
