"""Ranked lexical search: an index in shards (lexical_index), Block-Max MaxScore over each, and the shards' best merged.

1. Every task indexes the documents it reads, in shards of bounded text. Counts of documents and terms of the whole corpus are sums
   over shards. The index is a table that can be kept and searched again.
2. A term's weight needs its document frequency in the whole corpus: a sum over the lists of the queries' terms.
3. The lists of the queries' terms meet in groups of one shard and one block of queries. A task goes through its groups one after the
   other and keeps the best of each query, so that what one shard has found already rules out blocks of the next.
4. The tasks' best are merged by query. Scores are integers, so the result does not depend on shards or tasks.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .common import lower_az, written
from .lexical_index import SCHEMA, SHARD_BYTES, Best, PostingList, ShardBuilder, lengths, search_shard

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
QUERY_BLOCK = 1024  # queries whose best a task holds at once
USE_BYTES = 64  # of a query's use of a term, for the broadcast check


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The posting lists of all terms and a row of documents for each shard; write it where it is to be kept.

    Every row is a document of its own, also where ids repeat or are null. A null, empty or very long text is taken as it is (none or
    all of its terms); an empty table gives an empty index. Further columns are not looked at.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, shard = TaskContext.get().partitionId(), 0, ShardBuilder()
        for b in batches:
            texts = b.column(1).fill_null("").cast(pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
            raw = texts.buffers()[2]
            data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
            at = 0
            while at < len(texts):
                room = offsets[at] + shard_bytes - shard.bytes
                to = min(max(at + 1, int(np.searchsorted(offsets, room, "right")) - 1), len(texts))
                shard.add(b.column(0).slice(at, to - at), data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
                at = to
                if shard.bytes >= shard_bytes or at < len(texts):
                    yield from shard.rows(task << 32 | number)
                    number, shard = number + 1, ShardBuilder()
        if shard.docs:
            yield from shard.rows(task << 32 | number)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(term, block, uses): the queries of a block that hold the term, with its occurrences."""
    rows = queries.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).distinct()
    terms = rows.select("item_id", F.explode(F.regexp_extract_all(lower_az(F.col("text")), F.lit(TERM), F.lit(0))).alias("term"))
    counted = terms.groupBy("item_id", "term").agg(F.count("*").alias("times"))
    blocks = max(1, -(-rows.select("item_id").distinct().count() // QUERY_BLOCK))
    return counted.groupBy("term", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")).agg(
        F.collect_list(F.struct("item_id", "times")).alias("uses"))


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each query with a score above 0, equal scores by ascending doc_id (null
    last). index: a table written from build_index.

    Rows that repeat a query count once; different texts under one id are one query with all their terms. A query without terms, or
    none of whose terms stands in a document, gives no rows; a null id is an id like others. Further columns are not looked at.
    """
    wanted = written(query_terms(queries, id_col, text_col), "query-terms")
    uses = wanted.agg(F.sum(F.size("uses"))).first()[0] or 0
    near = broadcast_if_small(wanted, USE_BYTES * max(1, uses // max(1, wanted.count())))
    docs, terms = index.where("term is null").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    lists = index.where("term is not null")
    df = lists.select("term", "df").join(near.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("n"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * docs + 2) / (2 * F.col("n") + 1)))
    weighted = written(near.join(df, "term").select("term", "block", "uses", weight.cast("long").alias("weight")), "query-weights")
    blocks = wanted.select("block").distinct()
    heads = index.where("term is null").select("shard", "ids", "lens").join(broadcast_if_small(blocks, 16))
    parts = lists.join(broadcast_if_small(weighted, USE_BYTES * max(1, uses // max(1, wanted.count()))), "term").select(
        "block", "shard", "term", "df", "last", "top_tf", "least_n", "ends", "blob", "uses", "weight")
    groups = parts.unionByName(heads, allowMissingColumns=True).repartition("block", "shard").sortWithinPartitions("block", "shard", F.asc_nulls_first("term"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        held: list[pa.RecordBatch] = []
        key = None

        def flush() -> pa.RecordBatch:
            rows = [(q, None if null else int(i), int(s)) for q, b in best.items() for s, i, null in zip(b.score, b.id, b.null)]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["item_id", "doc_id", "score"])

        for b in batches:
            block, shard = (b.column(c).to_numpy() for c in ("block", "shard"))
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(shard) != 0)) + 1
            for at, to in zip([0, *cuts], [*cuts, b.num_rows]):
                if to > at:
                    if key != (here := (block[at], shard[at])):
                        _search_group(held, docs, terms, k, best)
                        if key is not None and key[0] != here[0]:
                            yield flush()
                        held, key = [], here
                    held.append(b.slice(at, to - at))
        _search_group(held, docs, terms, k, best)
        yield flush()

    found = groups.mapInArrow(run, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_group(held: list[pa.RecordBatch], docs: int, terms: int, k: int, best: dict) -> None:
    """One shard and one block of queries."""
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    ids = rows["ids"][0].values
    null = np.asarray(ids.is_null())
    ids, m = ids.fill_null(0).to_numpy(), lengths(rows["lens"][0].values.to_numpy(), docs, terms)
    queries: dict = {}
    ints = lambda c, i: rows[c][i].values.to_numpy()
    for i in range(1, len(rows)):
        found = PostingList(rows["df"][i].as_py(), ints("last", i), ints("top_tf", i), ints("least_n", i), ints("ends", i), rows["blob"][i].as_py(),
                            m, docs, terms)
        weight = rows["weight"][i].as_py()
        uses = rows["uses"][i].values
        for item, times in zip(uses.field(0).to_pylist(), uses.field(1).to_pylist()):
            queries.setdefault(item, []).append((found, weight * times))
    for item, query in queries.items():
        search_shard(query, ids, null, best.setdefault(item, Best(k)))
