"""op1_quality. Tests hold it against held-out labels."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .quality import rate, train


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, rated by a model of the labelled ones."""
    docs = documents(spark, sf_dir)
    return rate(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).withColumnRenamed("selected", "kept")
