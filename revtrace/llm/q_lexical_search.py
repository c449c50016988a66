"""op12_lexical_search and its SQL, which scores every document that shares a term with an item."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import LOWER, UPPER, documents, written
from .lexical_search import TERM, build_index, search

SQL = fr"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM documents),
c AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, text FROM benchmark),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS t FROM i) GROUP BY ALL),
p AS (SELECT r, doc_id, len(w)::BIGINT AS n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, w, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * (SELECT n FROM c) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p GROUP BY t),
s AS (SELECT item_id, r, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * p.n * c.n) // c.l))))::BIGINT AS score
      FROM p JOIN f USING (t) JOIN q USING (t), c GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= 10"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents ranked for each benchmark item."""
    index = written(build_index(documents(spark, sf_dir)), "lexical-index")
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
