"""op7_media_columns. Tests hold it against a plain computation and exact round trips."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written
from .media import described, document_pages, resolve, sequences, store_texts


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every document's text as a picture, shows it on a page, and resolves the page's sequence by digest."""
    stored = store_texts(documents(spark, sf_dir))
    pages = document_pages(stored)
    found = resolve(sequences(pages, "doc_id", "html"), written(described(stored), "media-described")).where("kind = 'img'")
    n = F.regexp_extract("caption", r"^(\d+) bytes$", 1).cast("long")
    return found.select(F.col("id").alias("doc_id"), n.alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
                        "position", "caption")
