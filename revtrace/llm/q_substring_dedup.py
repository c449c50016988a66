"""op6_substring_dedup and its SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .substring_dedup import WINDOW, substring_dedup

SQL = fr"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM d, range(1, len(w) - {WINDOW - 2}) t(i)),
f AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN f USING (h), range(0, {WINDOW}) r(k) WHERE least < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, windows of 50 words."""
    return substring_dedup(documents(spark, sf_dir)).drop("kept")
