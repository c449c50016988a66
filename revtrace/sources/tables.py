"""Keyed table operations: upsert, partial update, delete, copy with counts, keyset pages, contracts and audits."""
from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """Last write per key wins; an update beats the base row, later updates beat earlier ones."""
    both = base.withColumn("_w", F.lit(0)).unionByName(updates.withColumn("_w", F.lit(1)), allowMissingColumns=True)
    latest = W.partitionBy(*keys).orderBy(F.desc("_w"), *[F.desc_nulls_last(c) for c in order_by])
    return both.withColumn("_rn", F.row_number().over(latest)).filter("_rn = 1").drop("_rn", "_w")


def update_where(df: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of the patch replace those of the rows with its key; other columns and rows stay. One patch row per key."""
    cols = [c for c in patch.columns if c not in keys]
    p = patch.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in cols], F.lit(True).alias("_hit"))
    joined = df.join(p, keys, "left")
    out = [F.when(F.col("_hit"), F.col(f"_p_{c}")).otherwise(F.col(c) if c in df.columns else F.lit(None)).alias(c) for c in cols]
    return joined.select(*[c for c in df.columns if c not in cols], *out)


def pair_found(preprints: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """found(doi, published_doi): sets the published DOI and the final flag and moves ingested_at, so that the pair passes
    a watermark again. Of several DOIs found for a preprint the smallest counts."""
    one = found.groupBy("doi").agg(F.min("published_doi").alias("published_doi"))
    patch = one.select("doi", "published_doi", F.lit(True).alias("is_final_preprint"), now.alias("ingested_at"))
    return update_where(preprints, patch, ["doi"])


def delete_keys(df: DataFrame, keys_df: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(keys_df.select(*keys).distinct(), keys, "left_anti")


def copy_tables(spark: SparkSession, src: str, dst: str, names: list[str], keys: dict[str, list[str]] | None = None) -> DataFrame:
    """Copy tables by key: source rows replace target rows of their key, other target rows stay; a table without a key is replaced
    whole. Of source rows with one key one is kept. Returns source and target counts."""
    report = None
    for name in names:
        rows, target = spark.read.parquet(os.path.join(src, name)), os.path.join(dst, name)
        key = (keys or {}).get(name)
        kept = rows.dropDuplicates(key) if key else rows
        old = _table_if_there(spark, target) if key else None
        if old is not None:  # the target is read for its other rows, so the union is written beside it first
            staged = os.path.join(dst, f"_staged-{uuid.uuid4().hex[:12]}")
            kept.unionByName(delete_keys(old, rows, key), allowMissingColumns=True).write.parquet(staged)
            kept = spark.read.parquet(staged)
        kept.write.mode("overwrite").parquet(target)
        written = spark.read.parquet(target)
        line = (rows.agg(F.count("*").alias("source_rows")).join(written.agg(F.count("*").alias("target_rows")))
                .select(F.lit(name).alias("table_name"), "source_rows", "target_rows"))
        report = line if report is None else report.unionByName(line)
    return report


def _table_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def keyset_page(df: DataFrame, cursor: tuple | None, n: int, cols: tuple[str, str] = ("ingested_at", "doi")) -> DataFrame:
    """The next n rows strictly after the cursor, ascending; the cursor for the next page is the last row."""
    a, b = cols
    rows = df.filter(F.col(a).isNotNull())
    if cursor is not None:
        rows = rows.filter((F.col(a) > F.lit(cursor[0])) | ((F.col(a) == F.lit(cursor[0])) & (F.col(b) > F.lit(cursor[1]))))
    return rows.orderBy(a, b).limit(n)


def project_contract(df: DataFrame, json_col: str, schema: str, keep: list[str]) -> DataFrame:
    """JSON text through a fixed schema: contract fields at every level, missing ones null, extra ones dropped."""
    return df.select(*keep, F.from_json(json_col, schema).alias("_r")).select(*keep, "_r.*")


def audit_schema(contract: DataFrame, observed: DataFrame, json_col: str = "doc") -> DataFrame:
    """contract(table_name, key, required), observed(table_name, json): keys only in the contract or only in the data.
    An extra data key is an error, a missing required key too; a missing optional key is not."""
    seen = (observed.select("table_name", F.explode(F.json_object_keys(json_col)).alias("key")).distinct()
            .withColumn("in_data", F.lit(True)))
    want = contract.withColumn("in_contract", F.lit(True))
    status = (F.when(F.col("in_contract").isNull(), "only_in_data").when(F.col("in_data").isNull(), "only_in_contract")
              .otherwise("ok"))
    out = want.join(seen, ["table_name", "key"], "full_outer").withColumn("status", status)
    error = (F.col("status") == "only_in_data") | ((F.col("status") == "only_in_contract") & F.coalesce("required", F.lit(False)))
    return out.select("table_name", "key", "status", error.alias("is_error"))


def visible(df: DataFrame, include_demo: bool = False) -> DataFrame:
    """Rows a reader may see: no false positives, no rejected rows, no demo rows unless asked. A null hides nothing, and
    a table without the column is not filtered by it."""
    hidden = {"suspected_false_positive": True, "review_status": "rejected"}
    if not include_demo:
        hidden["record_source"] = "demo_seed"
    for column, value in hidden.items():
        if column in df.columns:
            df = df.filter(~F.col(column).eqNullSafe(F.lit(value)))
    return df
