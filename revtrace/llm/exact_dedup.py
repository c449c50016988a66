"""Exact dedup against a persistent digest index, bucketed and sorted by digest.

New rows are grouped by digest, the groups meet the index in a sort-merge anti-join, and what is new is appended. The index
outlives the session: it is a table in a folder, and a batch that is admitted again finds its own rows and changes nothing.
"""
from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, lower_az, written

HEAVY_SHARE = 100  # a group with more than 1/100 of all rows is joined by broadcast: there are at most 100 of them


def digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with A-Z in lower case; null counts as empty."""
    return F.unhex(F.sha2(lower_az(text).cast("binary"), 256))


class DigestIndex:
    """Table (digest, keep_id, batch) in `path`. The number of buckets is fixed when the folder is made, kept in it, and read again by
    whoever opens it later, in whatever session; asking for another number is an error. One writer at a time: a second one that appends
    at the same moment would not see the first one's digests."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark = spark
        about = f"{path.rstrip('/')}/_about"  # a name that Spark does not take for data
        try:
            self.buckets = spark.read.schema("buckets int").json(about).first().buckets
        except AnalysisException:  # no such folder yet
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.json(about)
        if buckets not in (None, self.buckets):
            raise ValueError(f"the index in {path} has {self.buckets} buckets, not {buckets}")
        self.name = "digest_index_" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def admit(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Adds the new digests of `docs` and returns one row per document: doc_id, keep_id, group_size (rows of this batch with
        the text), kept, digest.

        Of equal texts the largest id of the first batch that had it stays (null only if all ids are null). A null or missing
        text counts as empty. Rows that repeat an id and its text share one decision. Further columns are not looked at; an
        empty table adds nothing. Only digests are shuffled, never texts.
        """
        rows = written(docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest")), "digests")
        groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        new = groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        (new.select("digest", "keep_id", F.lit(batch).alias("batch")).repartition(self.buckets, "digest")
         .write.insertInto(self.name))
        known = written(groups.drop("keep_id").join(self.table().hint("merge"), "digest"), "digest-groups")
        limit = rows.count() / HEAVY_SHARE
        heavy, light = F.broadcast(known.where(F.col("group_size") > limit)), known.where(F.col("group_size") <= limit)
        joined = rows.join(heavy, "digest").unionByName(rows.join(heavy, "digest", "left_anti").join(light, "digest"))
        return joined.select("doc_id", "keep_id", "group_size",
                             (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("batch") == batch)).alias("kept"), "digest")


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder, with as many buckets as the session has shuffle partitions."""
    return DigestIndex(spark, fresh_path(spark, "digest-index"))


def drop_copies(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """The documents that stay, with all their columns. Rows that repeat a document whole count as copies: one stays."""
    kept = index.admit(docs, batch).where("kept")
    once = kept.groupBy("digest", "doc_id").agg(F.count("*").alias("_rows"))
    keys = once.select(F.col("digest").alias("_digest"), F.col("doc_id").alias("_id"), "_rows")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("_doc"), digest(F.col("text")).alias("_text"))
    found = rows.join(keys, (F.col("_text") == F.col("_digest")) & F.col("_doc").eqNullSafe(F.col("_id")))
    single = found.where("_rows = 1")
    if not once.where("_rows > 1").isEmpty():
        single = single.unionByName(found.where("_rows > 1").dropDuplicates(["_digest", "_id"]))
    return single.select("row.*")
