"""Continuous ingest of feed files into a keyed table.

The table is kept in buckets by key, a bucket in parts. A micro-batch adds a part of its own rows to the buckets that it touches; PARTS
parts of one level become one of the next level, so a row is written again a few times however many batches follow. A manifest for each
batch names the parts of every bucket; it is made from the one before. So a batch costs what it holds, a repeated batch makes the same
parts and manifest again, and readers see a whole batch or nothing of it."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import normalize_authors
from ..operators.pairing import to_preprint_rows
from ..sources.scans import FEED_SCHEMA, feed_rows

KEYS = ["doi", "version"]
BUCKETS = 16
PARTS = 8  # of one level, that become one of the next
MANIFEST = "bucket int, written long, level int"
PLACE = ["file_time", "file_path", "record_no"]


def ingest_stream(spark: SparkSession, path: str, source: str, sink: str, checkpoint: str, multi_line: bool = True, buckets: int = BUCKETS):
    """Feed files -> preprint records, the last record of a key wins: by batch, then by the file's time and name, then by its place in the
    file. Records without DOI are left out. `latest` reads the table."""
    pages = spark.readStream.schema(FEED_SCHEMA).option("multiLine", multi_line).option("maxFilesPerTrigger", 64).json(path).select(
        "collection", F.col("_metadata.file_modification_time").alias("file_time"), F.col("_metadata.file_path").alias("file_path"))

    def write(batch: DataFrame, batch_id: int) -> None:
        records = feed_rows(batch, source, PLACE[:2]).withColumn("conclusion", F.lit(None).cast("string")).withColumn("authors", normalize_authors(F.col("authors")))
        rows = to_preprint_rows(records, F.current_timestamp(), PLACE).filter("doi IS NOT NULL")
        upsert_batch(rows, sink, batch_id, buckets)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_batch(rows: DataFrame, sink: str, batch_id: int, buckets: int = BUCKETS) -> None:
    """Batches must come in order, a repeated one with the same rows. rows: records with PLACE."""
    spark = rows.sparkSession
    values = [c for c in rows.columns if c not in PLACE]
    last = rows.groupBy(*KEYS).agg(F.max_by(F.struct(*values), F.struct(*PLACE)).alias("r")).select("r.*")
    last = last.withColumn("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int"))
    fresh = f"{sink}/data/batch={batch_id}"
    last.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(fresh)
    touched = [r.bucket for r in spark.read.schema(last.schema).parquet(fresh).select("bucket").distinct().collect()]  # at most `buckets` numbers
    if not touched:  # the columns, should the table stay empty
        spark.createDataFrame([], last.schema).write.mode("overwrite").parquet(f"{sink}/_fresh/batch={batch_id}")
    parts = _manifest(spark, sink, batch_id - 1) if batch_id else {}
    merged = []
    for b in touched:
        parts[b], gone = _with_part(parts.get(b, ()), batch_id)
        merged += [(b, *part) for part in gone]
    if merged:
        _newest(_read(spark, sink, merged)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{sink}/merged/batch={batch_id}")
    rows = [(b, *part) for b, own in parts.items() for part in own]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{sink}/_manifest/batch={batch_id}")


def _with_part(parts: tuple, batch_id: int) -> tuple[tuple, list]:
    """A bucket's parts (batch, level), oldest first, after a batch; and those that become one, if any."""
    parts, gone = (*parts, (batch_id, 0)), []
    while len(parts) >= PARTS and len({level for _, level in parts[-PARTS:]}) == 1:
        gone = [*parts[-PARTS:-1], *(gone or parts[-1:])]  # what is to be one part now stands in its own parts
        parts = (*parts[:-PARTS], (batch_id, parts[-1][1] + 1))
    return parts, gone


def _read(spark: SparkSession, sink: str, parts: list[tuple[int, int, int]]) -> DataFrame:
    """Rows of parts (bucket, batch, level), with batch and bucket."""
    found = None
    for kind, own in (("data", [p for p in parts if not p[2]]), ("merged", [p for p in parts if p[2]])):
        if own:
            rows = spark.read.option("basePath", f"{sink}/{kind}").parquet(*(f"{sink}/{kind}/batch={n}/bucket={b}" for b, n, _ in own))
            found = rows if found is None else found.unionByName(rows)
    return found


def _newest(rows: DataFrame) -> DataFrame:
    """Of each key the rows of its last batch."""
    key = W.partitionBy("bucket", *[F.coalesce(k, F.lit("")) for k in KEYS])
    return rows.withColumn("_last", F.max("batch").over(key)).where(F.col("batch") == F.col("_last")).drop("_last", "batch")


def _manifest(spark: SparkSession, sink: str, batch_id: int) -> dict[int, tuple]:
    """The parts (batch, level) of each bucket, oldest first, as of a batch."""
    parts: dict[int, tuple] = {}
    for r in sorted(spark.read.schema(MANIFEST).parquet(f"{sink}/_manifest/batch={batch_id}").collect(), key=lambda r: r.written):
        parts[r.bucket] = (*parts.get(r.bucket, ()), (r.written, r.level or 0))
    return parts


def latest(spark: SparkSession, sink: str) -> DataFrame:
    """The keyed table as of the last whole batch: a read of its buckets, and of those in several parts the last rows by key."""
    every = spark.read.parquet(f"{sink}/_manifest")
    now = _manifest(spark, sink, every.agg(F.max("batch")).first()[0] or 0) if "batch" in every.columns else {}
    one, more = ([(b, *part) for b, own in now.items() if (len(own) > 1) == several for part in own] for several in (False, True))
    found = [df.drop("bucket", "batch") for df in ([_read(spark, sink, one)] if one else []) + ([_newest(_read(spark, sink, more))] if more else [])]
    return reduce(lambda x, y: x.unionByName(y), found) if found else spark.read.parquet(f"{sink}/_fresh").drop("bucket", "batch")
