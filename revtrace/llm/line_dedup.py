"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

Two lines are linked if they are within the edits that the shorter one allows: none below 8 characters, one from 8, two from 20. A line
within e edits of another keeps at least one of its e + 1 segments. Each distinct line files its segments under (length, segment number,
content), and probes the substrings where a segment of a line up to e shorter can stand (the positions that a match's left and right
parts leave open). A segment that many lines share is split by letter counts: two edits change at most four of them by one, so of
five groups of letters one has the same counts in both lines, and only lines that share a segment and such a group meet. They meet in
tiles, some lines that file it against some that ask for it, which hand on a row for a line with its links, not one for a pair. Pairs that
meet have their equal ends cut off and are verified by a banded bit-parallel edit distance: one word of 2 * e + 2 bits of vertical
differences, moved along the diagonal.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import let
from ..session import broadcast_if_small
from .common import written

FROM_CHARS = {1: 8, 2: 20}  # edits that a line of so many characters allows
EDITS = max(FROM_CHARS)
BLANKS = "\x20\x09\x0A\x0B\x0C\x0D"
LETTERS = "aeinorstlduh"  # counted modulo 32; an edit changes their counts by two at most
GROUPS = 2 * EDITS + 1  # of letters, one of which has the same counts in lines within EDITS edits
HEAVY = 16  # lines filed under one key, beyond which it is split by groups of letters and its pairs are confirmed in tiles
TILE = 32  # lines on a side of a tile, about
BLOCK = 16
SMALL = 8 << 20


def edits_of(n: Column) -> Column:
    """Edits that a line of n characters allows."""
    out = F.lit(0)
    for edits, least in sorted(FROM_CHARS.items()):
        out = F.when(n >= least, edits).otherwise(out)
    return out


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, position, line: lines that are not blank, without blanks around them. text_key tells apart texts under one id."""
    cut = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("position", "line"))
    return cut.withColumn("line", F.btrim("line", F.lit(BLANKS))).where("line <> ''")


def _segment(length: Column, edits: int | Column, i: int | Column) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 0) of a line; the last ones are a character longer where it does not divide."""
    parts, i = F.lit(edits) + 1, F.lit(i)
    base, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    shorter = parts - longer
    start = base * i + F.greatest(F.lit(0), i - shorter) + 1
    return start, base + F.when(i >= shorter, 1).otherwise(0)


def _key(line: Column, length: Column, i: int | Column, at: Column, size: Column) -> Column:
    """Hash of a segment's length class, number and content."""
    return F.xxhash64(length, F.lit(i), F.substring(line, at, size))


def segment_keys(line: Column, n: Column) -> Column:
    """Keys under which a line is filed."""
    out = F.array().cast("array<bigint>")
    for edits, least in sorted(FROM_CHARS.items()):
        keys = [_key(line, n, i, *_segment(n, edits, i)) for i in range(edits + 1)]
        out = F.when(n >= least, F.array(*keys)).otherwise(out)
    return out


def probes(longest: int) -> Column:
    """What a line that allows `longest` edits asks for, as structs: segment i of lines that allow `edits` and have `shorter` characters
    less, `off` characters from where it stands in them."""
    found = []
    for edits in (e for e in FROM_CHARS if e <= longest):
        for shorter in range(edits + 1):
            if edits == longest or FROM_CHARS[longest] - shorter < FROM_CHARS[edits + 1]:
                for i in range(edits + 1):
                    found += [(edits, shorter, i, off) for off in range(max(-i, shorter - (edits - i)), min(i, shorter + edits - i) + 1)]
    return F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("edits", "shorter", "i", "off"), x)]) for x in found])


def asked_keys(rows: DataFrame, *names: str) -> DataFrame:
    """rows(line, n) to the columns of that name, and key: of the substrings at which segments of a line of up to its edits fewer
    characters can stand. One small expression for all, on a row for each: long ones are not compiled."""
    wanted = F.lit(None)
    for edits, least in sorted(FROM_CHARS.items()):
        wanted = F.when(F.col("n") >= least, probes(edits)).otherwise(wanted)
    asked = rows.select(*names, "line", "n", (F.octet_length("line") == F.col("n")).alias("plain"), F.inline(wanted))
    length = F.col("n") - F.col("shorter")
    start, size = _segment(length, F.col("edits"), F.col("i"))
    asked = asked.where(edits_of(length) == F.col("edits")).select(*names, "line", "n", "plain", "i", length.alias("length"), (start + F.col("off")).alias("at"), size.alias("size"))
    of = lambda line: _key(line, F.col("length"), F.col("i"), F.col("at"), F.col("size"))  # noqa: E731  the same for a text and its bytes
    return asked.where((F.col("at") >= 1) & (F.col("at") + F.col("size") - 1 <= F.col("n"))).select(
        *names, F.when(F.col("plain"), of(F.col("line").cast("binary"))).otherwise(of(F.col("line"))).alias("key"))


def letter_counts(line: Column) -> Column:
    """How often each of LETTERS stands in the line, five bits for each."""
    total = F.lit(0).cast("long")
    for k, c in enumerate(LETTERS):
        n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))
        total = total + F.shiftleft((n % 32).cast("long"), 5 * k)
    return total


def counts_differ(a: Column, b: Column) -> Column:
    """By how much the counts of two lines differ in sum, at least (counts are compared modulo 32)."""
    total = F.lit(0).cast("long")
    for k in range(len(LETTERS)):
        d = F.pmod(F.shiftright(a, 5 * k).bitwiseAND(F.lit(31)) - F.shiftright(b, 5 * k).bitwiseAND(F.lit(31)), F.lit(32))
        total = total + F.least(d, 32 - d)
    return total


def group_masks() -> list[int]:
    """The bits of each group of letters in the counts of a line."""
    return [sum(31 << (5 * k) for k in range(len(LETTERS)) if k % GROUPS == g) for g in range(GROUPS)]


def group_keys(key: Column, counts: Column) -> Column:
    """The keys that a heavy key is split into: by group, the counts of its letters."""
    return F.array(*[F.xxhash64(key, F.lit(g), counts.bitwiseAND(F.lit(mask))) for g, mask in enumerate(group_masks())])


def candidates(distinct: DataFrame) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """(a, b), a < b: ids of distinct lines that share a segment which at most HEAVY lines file. And (id, key) of the lines that file and
    that ask for the others, if there are any. distinct: id, line."""
    long_ = distinct.withColumn("n", F.char_length("line")).where(F.col("n") >= min(FROM_CHARS.values()))
    filed = long_.select("id", F.explode(segment_keys(F.col("line"), F.col("n"))).alias("key"))
    asked = asked_keys(long_.withColumnRenamed("id", "other"), "other")
    heavy = written(filed.groupBy("key").count().where(F.col("count") > HEAVY).select("key"), "line-heavy")
    pair = [F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")]
    if heavy.isEmpty():
        return written(filed.join(asked, "key").where("id <> other").select(*pair).distinct(), "line-pairs"), None
    few = broadcast_if_small(heavy, 8, SMALL)
    # a heavy key stands once among the filed ones, without a line, so that those who ask for it come along with the pairs
    once = filed.join(few, "key", "left_anti").unionByName(heavy.select(F.lit(None).cast("long").alias("id"), "key"))
    alone = F.col("id").isNull()
    met = once.join(asked, "key").where(alone | (F.col("id") != F.col("other"))).select(
        pair[0], F.when(~alone, F.greatest("id", "other")).alias("b"), F.when(alone, F.col("key")).alias("key"))
    met = written(met.distinct(), "line-pairs")
    asking = met.where("b IS NULL").select(F.col("a").alias("id"), "key")
    filing = written(filed.join(few, "key", "left_semi").select("id", "key"), "line-filing")
    return met.where("b IS NOT NULL").select("a", "b"), (filing, asking)


def _common_blocks(x: Column, y: Column) -> Column:
    """Characters of the equal blocks that two lines begin with."""
    blocks = lambda c: F.regexp_extract_all(c, F.lit(f"(?s).{{{BLOCK}}}"), F.lit(0))
    same = F.zip_with(blocks(x), blocks(y), lambda p, q: F.coalesce(p == q, F.lit(False)))
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first > 0, first - 1).otherwise(F.size(same)) * BLOCK


def cores(x: Column, y: Column) -> Column:
    """struct(x, y) without the equal blocks at both ends, the longer one as x."""
    def from_right(v: Column) -> Column:
        return let(F.struct(v.x.alias("x"), v.y.alias("y"), _common_blocks(F.reverse(v.x), F.reverse(v.y)).alias("r")), lambda w: F.struct(
            F.substring(w.x, F.lit(1), F.char_length(w.x) - w.r).alias("x"), F.substring(w.y, F.lit(1), F.char_length(w.y) - w.r).alias("y")))

    longer = F.char_length(x) >= F.char_length(y)
    sides = F.struct(F.when(longer, x).otherwise(y).alias("x"), F.when(longer, y).otherwise(x).alias("y"))
    cut = let(sides, lambda v: let(_common_blocks(v.x, v.y) + 1, lambda at: F.struct(
        F.substring(v.x, at, F.char_length(v.x)).alias("x"), F.substring(v.y, at, F.char_length(v.y)).alias("y"))))
    return let(cut, from_right)


def _walk(s: Column, t: Column, edits: int) -> Column:
    """Edit distance of two arrays of characters, len(t) <= len(s) <= len(t) + edits, where it is at most `edits`; else more. Bits of
    a word stand for the rows of a band around the diagonal: vp and vn where a cell is one more or one less than the one above."""
    width = 2 * edits + 2
    mask = (1 << width) - 1
    inverted = lambda c: c.bitwiseXOR(F.lit(mask))  # noqa: E731  of a word that has no bits beyond the mask

    def step(acc: Column, i: Column) -> Column:
        """One column of the matrix: the i-th character (from 0) of t against the band of s."""
        start = i + (edits + 1 - width)
        x = F.lit(0)
        for b in range(width):
            x = x + F.when(F.get(s, start + b) == F.get(t, i), F.lit(1 << b)).otherwise(F.lit(0))

        def crossed(v: Column) -> Column:
            d0 = (v.x.bitwiseAND(v.vp) + v.vp).bitwiseXOR(v.vp).bitwiseOR(v.x).bitwiseOR(v.vn).bitwiseAND(F.lit(mask))
            return let(F.struct(d0.alias("d0"), v.vp.alias("vp"), v.d.alias("d")), lambda w: let(F.struct(
                w.d0.alias("d0"), w.d.alias("d"), w.d0.bitwiseAND(w.vp).alias("hn"), acc.vn.bitwiseOR(inverted(w.d0.bitwiseOR(w.vp))).alias("hp")), closed))

        def closed(v: Column) -> Column:
            down = F.shiftright(v.d0, 1)
            diagonal = F.when(v.d0.bitwiseAND(F.lit(1 << (width - 1))) == 0, 1).otherwise(0)
            # after the band has met the last row, the distance is followed along that row, a bit lower each time
            moved = i - (F.size(s) - edits)
            row = F.get(F.array(*[F.lit(1 << b).cast("long") for b in range(width)]), F.greatest(F.lit(0), F.lit(width - 2) - moved))
            side = F.when(v.hp.bitwiseAND(row) != 0, 1).otherwise(0) - F.when(v.hn.bitwiseAND(row) != 0, 1).otherwise(0)
            return F.struct(v.hn.bitwiseOR(inverted(down.bitwiseOR(v.hp))).alias("vp"), down.bitwiseAND(v.hp).alias("vn"),
                            (v.d + F.when(moved < 0, diagonal).otherwise(side)).cast("int").alias("d"))

        # the distance on the band's edge only grows along it, and shrinks by one a step at most on the last row: too far is final
        hopeless = (i < F.size(s) - edits) & (acc.d > 2 * edits + F.size(t) - F.size(s))
        return F.when(hopeless, acc).otherwise(let(F.struct(x.cast("long").alias("x"), acc.vp.alias("vp"), acc.vn.alias("vn"), acc.d.alias("d")), crossed))

    begin = F.struct(F.lit((mask << (width - edits - 1)) & mask).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(edits).alias("d"))
    columns = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(columns, begin, step, lambda acc: acc.d)


def distance_within(x: Column, y: Column, edits: int) -> Column:
    """The edit distance of x and y where it is at most `edits`, else more than `edits`."""
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")

    def distance(v: Column) -> Column:
        # a core with no more characters than edits is within them, or nearly; the band would not fit
        return F.when(F.size(v.s) - F.size(v.t) > edits, F.lit(edits + 1)).when(
            F.size(v.s) <= edits, F.levenshtein(F.array_join(v.s, ""), F.array_join(v.t, ""))).otherwise(_walk(v.s, v.t, edits))

    return let(cores(x, y), lambda v: let(F.struct(letters(v.x).alias("s"), letters(v.y).alias("t")), distance))


def line_links(distinct: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, distance): those of the pairs that are within the edits that the shorter line allows."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = written(distinct.select("id", "line").join(broadcast_if_small(ids, 16, SMALL), "id", "left_semi"), "line-texts")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    allowed = edits_of(F.least(F.char_length("x"), F.char_length("y")))
    both = both.where(counts_differ(letter_counts(F.col("x")), letter_counts(F.col("y"))) <= 2 * allowed)
    return both.withColumn("distance", distance_within(F.col("x"), F.col("y"), EDITS)).where(F.col("distance") <= allowed).select("a", "b", "distance")


def _tiles(members: DataFrame, lines_: DataFrame, side: str) -> DataFrame:
    """part, group and number of the tile, and its lines as an array named `side`. members: id, key."""
    rows = members.join(lines_, "id").select("id", "line", "n", "counts", "first", F.posexplode(group_keys(F.col("key"), F.col("counts"))).alias("group", "part"))
    sizes = rows.groupBy("part").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    placed = rows.join(sizes, "part").withColumn(f"{side}_tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    return placed.groupBy("part", f"{side}_tile").agg(F.min("group").alias(f"{side}_group"), F.collect_list(F.struct("id", "line", "n", "counts", "first")).alias(side))


def _tile_links(filing: Column, asking: Column, group: Column) -> Column:
    """For the lines of a tile that have links in it: id, others (linked lines), distances (on one of the two sides of a link, else null)
    and earliest, the least `first` of the others. A line asks for shorter ones, or equally long ones with a smaller id; a pair that more
    groups bring together is looked at in the first of them."""
    def meets(x: Column, y: Column) -> Column:
        changed = x.counts.bitwiseXOR(y.counts)
        out = (x.n < y.n) | ((x.n == y.n) & (x.id < y.id))
        for g, mask in enumerate(group_masks()[:-1]):
            out = out & ((group <= g) | (changed.bitwiseAND(F.lit(mask)) != 0))
        return out & (counts_differ(x.counts, y.counts) <= 2 * edits_of(x.n))

    def found(y: Column) -> Column:
        every = F.transform(filing, lambda x: F.struct(x.id.alias("id"), x.first.alias("first"), edits_of(x.n).alias("allowed"), F.when(
            meets(x, y), distance_within(x.line, y.line, EDITS)).alias("distance")))
        return F.filter(every, lambda v: F.coalesce(v.distance <= v.allowed, F.lit(False)))

    def sides(m: Column) -> Column:
        longer = F.transform(m, lambda v: F.struct(v.id.alias("id"), v.found.id.alias("others"), v.found.distance.alias("distances"), F.array_min(v.found["first"]).alias("earliest")))
        shorter = F.transform(filing, lambda x: let(F.filter(m, lambda v: F.array_contains(v.found.id, x.id)), lambda got: F.struct(
            x.id.alias("id"), got.id.alias("others"), F.lit(None).cast("array<int>").alias("distances"), F.array_min(got["first"]).alias("earliest"))))
        return F.filter(F.concat(longer, shorter), lambda v: F.size(v.others) > 0)

    return let(F.transform(asking, lambda y: F.struct(y.id.alias("id"), y.first.alias("first"), found(y).alias("found"))), sides)


def tile_links(distinct: DataFrame, filing: DataFrame, asking: DataFrame, spots: DataFrame) -> DataFrame:
    """Links of lines that share a heavy segment, without a row for a pair: id, others, distances, earliest, as in _tile_links, for each
    tile. spots: id, first (places of a line)."""
    ids = broadcast_if_small(written(filing.select("id").union(asking.select("id")).distinct(), "line-members"), 16, SMALL)
    firsts = spots.join(ids, "id", "left_semi").groupBy("id").agg(F.min("first").alias("first"))
    lines_ = distinct.join(ids, "id", "left_semi").join(firsts, "id").select(
        "id", "line", F.char_length("line").alias("n"), letter_counts(F.col("line")).alias("counts"), "first")
    lines_ = written(lines_, "line-texts")
    both = _tiles(filing, lines_, "filing").join(_tiles(asking, lines_, "asking"), "part")
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(tasks, "part", "filing_tile", "asking_tile")
    return both.select(F.inline(_tile_links(F.col("filing"), F.col("asking"), F.col("filing_group"))))


def _numbered(rows: DataFrame, docs: DataFrame, *within_row: str) -> DataFrame:
    """Adds copy: 0, and 1, 2, ... on further rows of docs with the same id and text. Only such rows are shuffled for it."""
    repeated = docs.groupBy(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key")).count().where("count > 1").select("_id", "_key")
    same = rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["text_key"] == F.col("_key"))
    once = rows.join(repeated, same, "left_anti").withColumn("copy", F.lit(0))
    order = W.partitionBy("doc_id", "text_key", *within_row).orderBy(F.lit(0))
    return once.unionByName(rows.join(repeated, same, "left_semi").withColumn("copy", F.row_number().over(order) - 1))


def line_dedup(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences (doc_id, text_key, copy, position, id, links, near_doc_id, kept) of all lines that are not blank, and the links (a, b,
    distance) between distinct texts; occurrences are found without a row for each link of a heavy segment.

    A line goes if its text, or a text linked with it, stands in a document with a smaller id or earlier in its own; else it is kept.
    links: other texts linked with it; near_doc_id: the smallest id of a document that holds one of them. A null text has no lines. A null
    id counts as larger than all others. Different texts under one id stand one after the other, by text_key. Of rows that repeat an id
    and its text the first keeps what is new, the others (copy > 0) keep nothing. Very long lines are compared whole. Further columns are
    not looked at. Distinct texts are told apart by a 64-bit hash, texts under one id too.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_lines = lines(docs)
    distinct = written(all_lines.select("line").distinct().select(F.xxhash64("line").alias("id"), "line"), "lines")
    pairs, heavy = candidates(distinct)
    links = written(line_links(distinct, pairs), "line-links")
    # the place of each text's first occurrence
    spots = written(_numbered(all_lines.select("doc_id", "text_key", "position", F.xxhash64("line").alias("id")), docs, "position"), "line-spots")
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "text_key", "copy", "position")
    first = spots.groupBy("id").agg(F.min(place).alias("first"))
    sides = links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other")))
    earliest = first.select(F.col("id").alias("other"), F.col("first").alias("earliest"))
    near, count = sides.join(earliest, "other"), F.count("*")
    if heavy:
        tiles = written(tile_links(distinct, *heavy, spots.select("id", place.alias("first"))), "line-tiles")
        near = near.select("id", F.array("other").alias("others"), "earliest").unionByName(tiles.select("id", "others", "earliest"))
        count = F.size(F.array_distinct(F.flatten(F.collect_list("others")))).cast("long")  # the same link can show in several tiles
        one = tiles.where("distances IS NOT NULL").select("id", F.inline(F.arrays_zip("others", "distances")))
        links = links.unionByName(one.select(F.least("id", "others").alias("a"), F.greatest("id", "others").alias("b"), F.col("distances").alias("distance"))).distinct()
    near = near.groupBy("id").agg(count.alias("links"), F.min("earliest").alias("near_first"))
    known = written(first.join(near, "id", "left").select("id", "first", F.coalesce("links", F.lit(0)).alias("links"), "near_first"), "line-known")
    # a text that many lines repeat: its row is joined by broadcast, a line in a hundred at most
    heavy = F.broadcast(spots.groupBy("id").count().where(F.col("count") > spots.count() / 100).select("id").join(known, "id"))
    seen = spots.join(heavy, "id").unionByName(spots.join(heavy, "id", "left_anti").join(known, "id"))
    stays = (place == F.col("first")) & (F.col("near_first").isNull() | (F.col("first") < F.col("near_first")))
    near_id = F.nullif(F.col("near_first.doc_id"), F.lit((1 << 63) - 1))
    return seen.select("doc_id", "text_key", "copy", "position", "id", "links", near_id.alias("near_doc_id"), stays.alias("kept")), links


def without_copies(docs: DataFrame, occurrences: DataFrame) -> DataFrame:
    """The documents with the lines that go cut out; blank lines stay. Each row loses its own lines only, also where ids repeat."""
    gone = occurrences.where("not kept").groupBy(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), F.col("copy").alias("_c")).agg(
        F.collect_set("position").alias("_gone"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    rows = _numbered(rows, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k")) & (F.col("copy") == F.col("_c")), "left")
    parts = F.split("row.text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.col("row.text")).otherwise(let(parts, lambda p: F.array_join(F.transform(stay, lambda k: F.get(p, k)), "\n")))
    return found.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def per_document(docs: DataFrame, occurrences: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_removed, n_linked (lines linked with another text), and lines in order: position,
    line_id, links, near_doc_id (see line_dedup), kept."""
    one = F.struct("position", F.col("id").alias("line_id"), "links", "near_doc_id", "kept")
    counts = occurrences.groupBy("doc_id", "text_key", "copy").agg(
        F.count("*").alias("n_lines"), F.sum((~F.col("kept")).cast("long")).alias("n_removed"), F.sum((F.col("links") > 0).cast("long")).alias("n_linked"),
        F.array_sort(F.collect_list(one)).alias("lines"))
    none = docs.where(F.forall(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) == "")).select(
        F.col("doc_id").cast("long").alias("doc_id"), *[F.lit(0).cast("long").alias(c) for c in ("n_lines", "n_removed", "n_linked")])
    return counts.select("doc_id", "n_lines", "n_removed", "n_linked", "lines").unionByName(
        none.withColumn("lines", F.array().cast(counts.schema["lines"].dataType)))
