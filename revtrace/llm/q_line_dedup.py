"""op3_line_dedup. Tests hold it against the edit distance of all pairs of lines."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .line_dedup import line_dedup, per_document


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents: how many of each document go, how many have a near text, and for each line its id, its links, the
    smallest id of a document with a near text, and whether it stays."""
    docs = documents(spark, sf_dir)
    occurrences, _ = line_dedup(docs)
    return per_document(docs, occurrences)
