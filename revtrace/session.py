"""Session defaults and the checkpoint folder."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
TASK_ROWS = 1 << 21  # rows that a task of a large join holds


def local_session(cpus: str = "*", name: str = "revtrace") -> SparkSession:
    """A session for one machine (tests, bench). On a cluster, use the session the cluster gives."""
    n = "8" if cpus == "*" else cpus
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def steady_unions(spark: SparkSession) -> None:
    """Spark 4.1 may zip the partitions of a union's inputs when both are partitioned alike; adaptive execution can then
    give them different partition counts and the query fails. The setting turns that shortcut off."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. A local session without the setting (tests) gets a temporary folder; on a
    cluster a missing setting is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="revtrace-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the checkpoint folder: computed once, read by column, and there if an executor is lost."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Text work is bound by CPU: an input with fewer splits than the cluster has cores is dealt out to all of them. A large
    input has more splits than cores and is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(key: str, *dfs: DataFrame, rows: int = TASK_ROWS) -> list[DataFrame]:
    """Inputs of a join on a key, dealt out by it alike, so that a task sorts about `rows` rows of the largest however large it is (adaptive
    execution does not merge such partitions). Small inputs are left alone."""
    n = -(-max(df.count() for df in dfs) // rows)
    at_least = int(dfs[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return [df.repartition(max(n, at_least), key) for df in dfs] if n > 1 else list(dfs)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only when a count shows the side is within the limit; beyond it Spark joins by shuffle.
    The count stops at one row over the limit, so the check itself stays small."""
    max_rows = max(1, limit // max(1, row_bytes))
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
