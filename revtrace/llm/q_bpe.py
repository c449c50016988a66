"""op8_bpe. SQL cannot express it; tests hold it against the tokenizers library."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bpe import encoding_digests
from .common import documents


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    return encoding_digests(documents(spark, sf_dir), vocabulary())
