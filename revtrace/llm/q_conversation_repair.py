"""op11_conversation_repair and its SQL, which keeps the cheapest edits to each state row by row."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .conversation_repair import repair


# CRC-32 by its table of 256; the state '' is the start. Two inserts in a row cover all that can be cheapest.
SQL = r"""WITH RECURSIVE
k AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, i: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY n) AS t FROM range(256) r(n)),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
h AS (SELECT s, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(s, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) % 20 AS h
      FROM (SELECT DISTINCT s FROM c), k),
g AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
      unnest(CASE h WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM c JOIN h USING (s) WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM g),
f AS (SELECT *, rtrim(text, E' \t\n\x0b\x0c\r') AS x, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM o),
a AS (SELECT *, CASE WHEN x = '' THEN 'b' WHEN again THEN 'd' WHEN right(x, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, left(role, 1) AS r,
      lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM f),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
      count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
      FROM a GROUP BY conv_id),
w(p, e, q) AS (VALUES ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
ins(p, q, cost, e, l) AS (SELECT p, p, 0, '', []::VARCHAR[] FROM w UNION ALL SELECT p, q, 5, 'I', [CASE e WHEN 'u' THEN 'user:' ELSE 'assistant:' END] FROM w
  UNION ALL SELECT p, CASE e WHEN 'u' THEN 'a' ELSE 'u' END, 10, 'II', CASE e WHEN 'u' THEN ['user:', 'assistant:'] ELSE ['assistant:', 'user:'] END FROM w),
step AS (SELECT conv_id, i, p, q, cost, e, l FROM (
  SELECT conv_id, i, p, p AS q, 2 AS cost, 'D' AS e, []::VARCHAR[] AS l FROM a, w
  UNION ALL SELECT conv_id, i, p, r, CASE fault WHEN 't' THEN 5 ELSE 0 END, 'K', [role || ':' || text] FROM a, w
    WHERE fault NOT IN ('b', 'd') AND ((p = '' AND r IN ('s', 'u')) OR (p = 's' AND r = 'u') OR (p = 'u' AND r = 'a') OR (p = 'a' AND r = 'u'))
  UNION ALL SELECT conv_id, i, p, q, CASE fault WHEN 't' THEN 6 ELSE 1 END, 'R', [CASE q WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] FROM a, w WHERE fault NOT IN ('b', 'd'))),
edits AS (SELECT s.conv_id, s.i, ins.p, s.q, ins.cost + s.cost AS cost, ins.e || s.e AS e, ins.l || s.l AS l FROM step s JOIN ins ON ins.q = s.p),
best AS (SELECT conv_id, n, 0 AS i, '' AS q, 0 AS cost, '' AS e, []::VARCHAR[] AS l FROM n
  UNION ALL SELECT conv_id, n, i, q, m.cost, m.e, m.l FROM (SELECT b.conv_id, b.n, b.i + 1 AS i, s.q,
    min({'cost': b.cost + s.cost, 'e': b.e || s.e, 'l': b.l || s.l}) AS m FROM best b JOIN edits s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.i = b.i + 1 AND s.p = b.q GROUP BY ALL)),
fin AS (SELECT conv_id, min({'cost': b.cost + ins.cost, 'e': b.e || ins.e, 'l': b.l || ins.l}) AS m FROM best b JOIN ins ON ins.p = b.q WHERE b.i = b.n AND ins.q IN ('', 'a') GROUP BY conv_id)
SELECT x.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(m.cost, 0)::BIGINT AS cost, coalesce(m.e, '') AS audit, sha256(coalesce(array_to_string(m.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM x.conv_id"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations."""
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
