"""A training corpus from the table documents: rate, drop exact and near copies, mix the sources, encode.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of
documents. run() writes each stage's rows to the shared folder and reads them again as the next one's docs. The stages take null
values, empty texts, repeated rows, empty tables and further columns as their operators do; see there. No SQL expresses the trained
stage, the sketches and the encoding, so ORACLE_SQL is None and tests hold run() against a brute-force version.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revtrace.llm import bpe, exact_dedup, mixing, near_dedup, quality
from revtrace.llm.common import documents, written
from revtrace.llm.q_bpe import vocabulary

ORACLE_SQL = None


def rate_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are rated poor or toxic, and texts without words."""
    return quality.select_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact_dedup.drop_copies(docs, exact_dedup.new_index(spark), "pipeline")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays."""
    return near_dedup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time a text is taken, whole or in part; sources by weight 5, 2, 1."""
    return mixing.taken_texts(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    return bpe.encoding_digests(docs, vocabulary())


STAGES = [("quality classifier", rate_quality), ("exact dedup", drop_exact_copies), ("MinHash near-dedup", drop_near_copies),
          ("mixing sources to target weights", mix_sources), ("BPE encoding and decoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
