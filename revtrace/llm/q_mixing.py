"""op4_mix_sources and its SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .mixing import BLOCK_WORDS, MAX_PASSES, MAX_SHARDS, SEED, SHARD_WORDS, mix

SQL = fr"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s0),
s2 AS (SELECT *, size * {MAX_PASSES}.0::DOUBLE / w AS ratio FROM s1),
s3 AS (SELECT *, (sum(size) OVER () - {MAX_PASSES} * coalesce(sum(size) OVER (ORDER BY ratio, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(w) OVER (ORDER BY ratio, source NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM s2),
s4 AS (SELECT source, size, least(size * {MAX_PASSES}.0::DOUBLE, w * (SELECT max(level) FROM s3)) AS target FROM s3),
s5 AS (SELECT *, CAST(round((SELECT sum(target) FROM s4) / {BLOCK_WORDS}) AS BIGINT) AS seats,
      CAST(floor(size * {MAX_PASSES} / {BLOCK_WORDS}.0) AS BIGINT) AS most,
      greatest(1, least({MAX_SHARDS}, CAST(ceil(size / {SHARD_WORDS}.0) AS BIGINT))) AS shards FROM s4),
q1 AS (SELECT source, target / (2 * k + 1) AS q, seats FROM s5, range(0, most) t(k) WHERE target > 0),
q2 AS (SELECT source, row_number() OVER (ORDER BY q DESC, source NULLS LAST) AS r, seats FROM q1),
q3 AS (SELECT source, count(*) AS quota FROM q2 WHERE r <= seats GROUP BY source),
src AS (SELECT s5.*, coalesce(quota, 0) AS quota FROM s5 LEFT JOIN q3 ON s5.source IS NOT DISTINCT FROM q3.source),
p AS (SELECT d.*, src.size AS source_size, target, quota, CAST('0x' || key[1:12] AS BIGINT) % shards AS shard
      FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source),
h1 AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS words, any_value(quota) AS seats FROM p GROUP BY ALL),
h2 AS (SELECT source, shard, seats, words::DOUBLE / (2 * k + 1) AS q
      FROM h1, range(0, CAST(floor(words * {MAX_PASSES} / {BLOCK_WORDS}.0) AS BIGINT)) t(k) WHERE words > 0),
h3 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY q DESC, shard) AS r FROM h2),
h4 AS (SELECT source, shard, count(*) AS quota FROM h3 WHERE r <= seats GROUP BY ALL),
h AS (SELECT h1.source, h1.shard, words, coalesce(h4.quota, 0) * {BLOCK_WORDS} AS takes,
      CAST('0x' || md5('{SEED}|' || coalesce(h1.source, 'null') || '|' || h1.shard)[1:12] AS BIGINT) % greatest(words, 1) AS start
      FROM h1 LEFT JOIN h4 ON h1.source IS NOT DISTINCT FROM h4.source AND h1.shard = h4.shard),
l AS (SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM p)
SELECT doc_id, l.source, l.size, source_size, target,
  CAST(CASE WHEN words = 0 THEN 0 ELSE l.size * (takes // words)
    + greatest(0, least(upto, start + takes % words) - greatest(upto - l.size, start))
    + greatest(0, least(upto, start + takes % words - words) - (upto - l.size)) END AS BIGINT) AS taken
FROM l JOIN h ON l.source IS NOT DISTINCT FROM h.source AND l.shard = h.shard"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by weights 5, 2, 1."""
    return mix(documents(spark, sf_dir)).select("doc_id", "source", "size", "source_size", "target", "taken")
