"""op2_license_scan. Tests hold it against the notices that stand in the texts, and against framings it was not trained on."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .licenses import license_scan


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scanned by a model of the templates and a sample of the documents."""
    return license_scan(documents(spark, sf_dir))
