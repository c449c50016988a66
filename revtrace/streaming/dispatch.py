"""Watermark ticks and dispatch of new pairs, as batch steps and as Structured Streaming queries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.pairing import eligible_pairs, oldest_pending


def dispatch_tick(preprints: DataFrame, cursor: Column, n: int = 20, tie: list[str] | None = None) -> DataFrame:
    """Eligible pairs strictly newer than the cursor, oldest first. The cursor then moves to the last row returned; with no
    row it stays."""
    return eligible_pairs(preprints).filter(F.col("ingested_at") > cursor).orderBy("ingested_at", *(tie or ["doi"])).limit(n)


def rewind(preprints: DataFrame, events: DataFrame, cursor: Column) -> DataFrame:
    """One row: the watermark moved to one second before the oldest pending pair, only if that is earlier."""
    oldest = oldest_pending(preprints, events).agg(F.min("ingested_at").alias("t"))
    new = F.col("t") - F.make_interval(secs=F.lit(1))
    earlier = F.coalesce(new < cursor, F.lit(False)) | (cursor.isNull() & new.isNotNull())
    return oldest.select(F.when(earlier, new).otherwise(cursor).alias("watermark"), earlier.alias("changed"))


def pair_stream(preprints: DataFrame) -> DataFrame:
    """Streaming form of the tick: the source's checkpoint is the watermark, so every eligible row passes once. Limit the
    rows of a tick with the source's own rate option (maxFilesPerTrigger)."""
    return eligible_pairs(preprints)


def dispatch_batch(requests: DataFrame, events: DataFrame, analysable: DataFrame, used: DataFrame, budget: int | None) -> DataFrame:
    """requests(request_no, preprint_doi, published_doi, force), analysable(preprint_doi, status), used(pair_key) -> outcome
    per request in order of request_no: paused_budget_exhausted, already_processed, not_analysable or enqueued.

    The budget is tested first and is used once per distinct pair. The request that uses its last unit is found by a
    bounded top-n, so no window runs over all requests."""
    key = lambda a, b: F.concat_ws("|", F.lower(a), F.lower(F.coalesce(b, F.lit(""))))
    done = events.select(key(F.col("preprint_doi"), F.col("published_doi")).alias("pair_key"), F.lit(True).alias("_done")).distinct()
    ready = analysable.select(F.lower("preprint_doi").alias("_d"), F.col("status").alias("_status"))
    r = requests.withColumn("pair_key", key(F.col("preprint_doi"), F.col("published_doi"))).withColumn("_d", F.lower("preprint_doi"))
    j = r.join(done, "pair_key", "left").join(ready, "_d", "left")
    skip = F.coalesce("_done", F.lit(False)) & ~F.coalesce("force", F.lit(False))
    usable = F.coalesce("_status", F.lit("check_failed")).isin("ready", "check_failed")
    j = j.withColumn("outcome", F.when(skip, "already_processed").when(~usable, "not_analysable").otherwise("enqueued")).drop("_done", "_d", "_status")
    if budget is None:
        return j
    left = budget - used.select("pair_key").distinct().count()
    if left <= 0:
        return j.withColumn("outcome", F.lit("paused_budget_exhausted"))
    costing = (j.filter("outcome = 'enqueued'").groupBy("pair_key").agg(F.min("request_no").alias("no"))
               .join(used.select("pair_key"), "pair_key", "left_anti"))
    # the request that uses the last unit, or none when the budget is not used up
    last = costing.orderBy("no").limit(left).agg(F.count("*").alias("n"), F.max("no").alias("last")).select(
        F.when(F.col("n") == left, F.col("last")).alias("last_no"))
    over = F.coalesce(F.col("request_no") > F.col("last_no"), F.lit(False))
    return j.join(F.broadcast(last)).withColumn("outcome", F.when(over, "paused_budget_exhausted").otherwise(F.col("outcome"))).drop("last_no")


def dispatch_stream(requests: DataFrame, events: DataFrame, analysable: DataFrame, out: str, checkpoint: str, budget: int | None):
    """Outcome log of a stream of requests, a folder for each micro-batch, so a repeated batch replaces itself. Beside it stands the
    table of the pairs that have used the budget, a version for each batch, made from the version before: at most as many pairs as the
    budget allows, so a batch costs the same however many came before. Without a budget there is nothing to keep."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        used = spark.createDataFrame([], "pair_key string") if batch_id == 0 or budget is None else spark.read.parquet(_used(out, batch_id - 1))
        dispatch_batch(batch, events, analysable, used, budget).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if budget is not None:
            new = spark.read.parquet(f"{out}/batch={batch_id}").filter("outcome = 'enqueued'").select("pair_key")
            used.unionByName(new).distinct().coalesce(1).write.mode("overwrite").parquet(_used(out, batch_id))

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _used(out: str, batch_id: int) -> str:
    return f"{out}/_used/version={batch_id}"  # a name that Spark does not take for data of the log


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))
