"""op13_rank_bpe. SQL cannot express it; tests hold it against the tiktoken library on whole texts."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .rank_bpe import encoding_digests


def vocabulary() -> tuple[str, str]:
    """Rank file and pattern."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by ranks and decoded again."""
    return encoding_digests(documents(spark, sf_dir), *vocabulary())
