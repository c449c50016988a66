"""Faults of conversations and their cheapest repair.

1. Rows get their place by one range sort over (conversation, turn, role, digest of the text), so that a conversation of any size is
   spread over tasks; places are kept with the rows in a table.
2. Rows of one conversation in one run of CHUNK places become a code of a letter each, with their counts. Chunks that touch the
   end of a run, whose conversation may go on, get their cost matrix here, spread over all tasks.
3. Chunks of a conversation from the last to the first, a few numbers each: what the rows behind a chunk cost from each state.
4. Every chunk is traced by itself from each state in which it can be entered.
5. The conversation's rows in order: the state in which a chunk is entered chooses its edits, and the repaired lines go through the
   digest one by one. SHA-256 cannot be split, so a conversation's lines pass through one task, which holds one row at a time.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .auction import END, END_CLOSED, INF, ROLES, START, TURN, behind, illegal, matrix_of, trace
from .common import written

CHUNK_BITS = 10  # rows of a chunk: 1,024 places
BLANK = " \t\n\x0b\x0c\r"
COUNTS = ["blank", "duplicate", "truncated"]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy: the rows damaged by crc32(conv_id:turn) % 20. Null role and text become one space, and so does
    a null conv_id or turn in that key; the columns conv_id and turn keep their nulls."""
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", space(F.col("role")).alias("role"), space(F.col("text")).alias("text"))
    kind = F.crc32(F.concat(space(F.col("conv_id")), F.lit(":"), space(F.col("turn"))).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("kind", kind).where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def placed(rows: DataFrame) -> DataFrame:
    """The rows with their text's digest and a place that grows with (conv_id, turn, role, digest), nulls first."""
    order = ["conv_id", "turn", "role", "digest"]
    return rows.withColumn("digest", F.md5("text")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "place", F.monotonically_increasing_id())


def lettered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, place, letter (see auction) and the row's first fault in blank, duplicate, truncated (0 or 1)."""
    end = F.rtrim(F.col("text"), F.lit(BLANK))
    faults = rows.select("conv_id", "turn", "role", "digest", "place", (end == "").alias("is_blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("is_cut"))
    again = rows.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    both = faults.join(again, faults["conv_id"].eqNullSafe(F.col("c")) & (faults["role"] == F.col("r")) & (faults["digest"] == F.col("d")), "left")
    seen = F.coalesce(F.col("first") < F.col("place"), F.lit(False))
    initial = F.left("role", F.lit(1))
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    gone = F.col("is_blank") | F.col("seen")
    return both.withColumn("seen", seen).select(
        "conv_id", "turn", "place", F.when(gone, F.translate(letter, "suao", "1234")).when(F.col("is_cut"), F.upper(letter)).otherwise(letter).alias("letter"),
        F.col("is_blank").cast("long").alias("blank"), (~F.col("is_blank") & F.col("seen")).cast("long").alias("duplicate"),
        (~gone & F.col("is_cut")).cast("long").alias("truncated"))


def chunk_of(place: Column) -> Column:
    return F.shiftright(place, CHUNK_BITS)


def chunks(letters: DataFrame) -> DataFrame:
    """conv_id, chunk, code, the counts, low and high turn, distinct turns, and the cost matrix where the conversation may go on."""
    edge = (1 << CHUNK_BITS) - 1
    rows = letters.groupBy("conv_id", chunk_of(F.col("place")).alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "letter"))), lambda x: x["letter"]), "").alias("code"),
        *[F.sum(c).alias(c) for c in COUNTS], F.min("turn").alias("low"), F.max("turn").alias("high"),
        F.size(F.collect_set("turn")).alias("turns"), F.min("place").alias("p"), F.max("place").alias("q"))
    rows = rows.withColumn("edge", (F.col("p").bitwiseAND(F.lit(edge)) == 0) | (F.col("q").bitwiseAND(F.lit(edge)) == edge)).drop("p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = [[x for row in matrix_of(code) for x in row] if on else None
                 for code, on in zip(b.column("code").to_pylist(), b.column("edge").to_pylist())]
            wrong = [illegal(code) for code in b.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(wrong, pa.int64()), pa.array(m, pa.list_(pa.int64()))], [*b.schema.names[:-1], "illegal", "matrix"])

    schema = T.StructType(rows.drop("edge").schema.fields + T.DataType.fromDDL("illegal long, matrix array<long>").fields)
    return rows.mapInArrow(run, schema)


def with_costs_behind(found: DataFrame) -> DataFrame:
    """Adds to each chunk: exits (cost from each state after it to the end), first and last (of its conversation)."""
    ordered = found.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.desc("chunk"))
    add = T.DataType.fromDDL("exits array<long>, first boolean, last boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the chunk behind: (conv_id, code, matrix, exits, last), whose row waits for its `first`
        row = None
        for b in batches:
            out = []
            for at, (conv, code, matrix) in enumerate(zip(*(b.column(c).to_pylist() for c in ("conv_id", "code", "matrix")))):
                more = held is not None and held[0] == conv
                if more:
                    m = tuple(zip(*[iter(held[2])] * 4)) if held[2] else matrix_of(held[1])
                    exits = behind(m, END_CLOSED if held[4] else held[3])
                else:
                    exits = END
                if row is not None:
                    out.append((row, held[3], not more, held[4]))
                held, row = (conv, code, matrix, exits, not more), b.slice(at, 1)
            if out:
                yield finish(out)
        if row is not None:
            yield finish([(row, held[3], True, held[4])])

    def finish(out: list) -> pa.RecordBatch:
        table = pa.Table.from_batches([r for r, *_ in out]).drop_columns(["matrix"]).combine_chunks().to_batches()[0]
        cols = [pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out]), pa.array([o[3] for o in out])]
        return pa.RecordBatch.from_arrays([*table.columns, *cols], [*table.schema.names, *add.names])

    return ordered.mapInArrow(run, T.StructType(found.drop("matrix").schema.fields + add.fields))


def traced(found: DataFrame) -> DataFrame:
    """Adds to each chunk, for each state in which it may be entered: audits, leaves (exit state), costs."""
    add = T.DataType.fromDDL("audits array<string>, leaves array<int>, costs array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ways = [[trace(code, entry, tuple(exits), last) for entry in range(1 if first else 4)]
                    for code, exits, first, last in zip(*(b.column(c).to_pylist() for c in ("code", "exits", "first", "last")))]
            cols = [pa.array([[w[k] for w in x] for x in ways], t) for k, t in enumerate((pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())))]
            keep = [c for c in b.schema.names if c not in ("exits", "first", "last")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], [*keep, *add.names])

    return found.repartition("conv_id", "chunk").mapInArrow(run, T.StructType(found.drop("exits", "first", "last").schema.fields + add.fields))


class _Conversation:
    """One conversation while its chunks and rows pass by in order."""

    def __init__(self, conv):
        self.conv, self.state, self.cost, self.audit = conv, START, 0, []
        self.sums, self.illegal, self.role = [0, 0, 0], 0, ""
        self.low = self.high = None
        self.turns, self.lines, self.sha = 0, 0, hashlib.sha256()
        self.edits, self.pattern = iter(()), START

    def line(self, text: str) -> None:
        self.sha.update(("\n" * (self.lines > 0) + text).encode())
        self.lines += 1

    def turn(self) -> str:
        self.pattern = TURN[self.pattern]
        return "user" if self.pattern == TURN[START] else "assistant"

    def chunk(self, r: dict) -> None:
        self.finish_edits()
        way = self.state if len(r["audits"]) > 1 else 0
        self.pattern, self.edits = self.state, iter(r["audits"][way])
        self.audit.append(r["audits"][way])
        self.state, self.cost = r["leaves"][way], self.cost + r["costs"][way]
        self.sums = [a + r[c] for a, c in zip(self.sums, COUNTS)]
        self.illegal += r["illegal"] + (self.role != "" and illegal(self.role + r["code"][0]))
        self.role = r["code"][-1].translate(ROLES)
        if r["low"] is not None:
            self.turns += r["turns"] - (r["low"] == self.high)
            self.low, self.high = r["low"] if self.low is None else self.low, r["high"]

    def row(self, role: str, text: str) -> None:
        for edit in self.edits:
            if edit == "I":
                self.line(f"{self.turn()}:")
                continue
            if edit == "K":
                initial = role[:1]
                self.pattern = {"s": 1, "u": 2, "a": 3}[initial]
                self.line(f"{role}:{text}")
            elif edit == "R":
                self.line(f"{self.turn()}:{text}")
            return

    def finish_edits(self) -> None:
        for _ in self.edits:  # inserts after the last row
            self.line(f"{self.turn()}:")

    def result(self) -> tuple:
        self.finish_edits()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.sums, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conv_id (null is one of them): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Null role or text is one space. Rows of equal turn stand by role, then by the text's digest; repeated rows stand side by side and the
    second one is a duplicate. A role whose first letter is none of s, u, a (an empty one too) can only be given a new role or
    deleted. A conversation without rows after the damage has zeros, no audit and the digest of nothing; an empty table gives no rows.
    Further columns are not looked at. Long conversations and texts pass in chunks, see above.
    """
    rows = written(placed(damaged(conversations)), "conversation-rows")
    found = written(chunks(lettered(rows)), "conversation-chunks")
    ways = traced(with_costs_behind(found))
    heads = conversations.groupBy("conv_id").agg(F.lit(-1).cast("long").alias("chunk"))
    texts = rows.select("conv_id", chunk_of(F.col("place")).alias("chunk"), "place", "role", "text")
    stream = ways.unionByName(texts, allowMissingColumns=True).unionByName(heads, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), "chunk", F.asc_nulls_first("place"))
    schema = T.StructType([conversations.schema["conv_id"], *T.DataType.fromDDL(
        "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string").fields])
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(out: list, conv_type: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate([conv_type, *kinds])], schema.names)

        one, conv_type = None, None
        for b in batches:
            out, conv_type = [], b.schema.field("conv_id").type
            ways_of = ["audits", "leaves", "costs", "code", "illegal", "low", "high", "turns", *COUNTS]
            for at, (conv, chunk, place) in enumerate(zip(*(b.column(c).to_pylist() for c in ("conv_id", "chunk", "place")))):
                if chunk < 0:
                    if one is not None:
                        out.append(one.result())
                    one = _Conversation(conv)
                elif place is None:
                    one.chunk({c: b.column(c)[at].as_py() for c in ways_of})
                else:
                    one.row(b.column("role")[at].as_py(), b.column("text")[at].as_py())
            if out:
                yield batch(out, conv_type)
        if one is not None:
            yield batch([one.result()], conv_type)

    return stream.mapInArrow(run, schema)
