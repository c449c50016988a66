"""Views of the given tables in the shape of the domain. Each is one SQL text that Spark and DuckDB both run."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..session import spread, steady_unions

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

_STATEMENT = """CASE {k} % 8
  WHEN 0 THEN concat('The mean incubation period was ', {k} % 97, '.', {k} % 10, ' days (95% CI 4.6-7.9).')
  WHEN 1 THEN concat('Incubation was set to ', {k} % 97, '·', {k} % 10, ' [12].')
  WHEN 2 THEN concat('The range was 0 to ', {k} % 97 + 2, ' days in 2020.')
  WHEN 3 THEN concat('In total ', {k} % 97 + 1, ',500 cases (', {k} % 97, '.', {k} % 10, '%) had COVID-19.')
  WHEN 4 THEN concat('We saw ', {k} % 97, '.', {k} % 10, '0-day delays; p < 0.05.')
  WHEN 5 THEN concat('The severity score was ', {k} % 97, '.', {k} % 10, ' in Table 2.')
  WHEN 6 THEN concat('Values of ', {k} % 97, '.', {k} % 10, '–', {k} % 97 + 1, '.5 weeks were reported.')
  ELSE concat({k} % 97, ' out of 148 patients (50.7 %) improved.') END"""


def statement(key: str) -> str:
    """SQL of the claim sentence a key stands for: eight forms of values, units, ranges and noise."""
    return _STATEMENT.replace("{k}", key)


# first author of a key: letters only, because a name in a sentence is read without digits
AUTHOR = "concat('Author', translate(concat('', doc_id % 50), '0123456789', 'abcdefghij'))"

VIEWS: dict[str, str] = {
    # one revised claim per document: old text, and a new text that keeps, changes or drops the value
    "statements": f"""SELECT doc_id, lang, source, {statement('doc_id')} AS old_text,
  CASE CAST(floor(doc_id / 8) AS BIGINT) % 3 WHEN 0 THEN {statement('doc_id')}
       WHEN 1 THEN 'The value was 6.4 days.' ELSE NULL END AS new_text FROM documents""",
    # citing works: the whole document text followed by the statement of its own key
    "works": f"""SELECT doc_id AS work_id, lang AS journal, source,
  concat('10.5555/w', doc_id) AS doi, concat('Work ', doc_id) AS title,
  concat('20', lpad(CAST(doc_id % 24 AS {{str}}), 2, '0')) AS date,
  concat(text, '. ', {statement('doc_id')}) AS text FROM documents""",
    # who cites whose versions
    "cites": """SELECT doc_id AS work_id, {each}concat('10.1101/', doc_id), concat('10.1016/p', doc_id),
  concat('10.1101/', CAST(floor(doc_id / 2) AS BIGINT)){end} AS cited_doi FROM documents""",
    "drift_events": """SELECT CAST(o_orderkey AS BIGINT) AS event_id, concat('10.1101/', o_orderkey) AS preprint_doi,
  concat('10.1016/p', o_orderkey) AS published_doi, o_custkey AS paper_no, o_totalprice / 600000.0 AS materiality_score,
  o_orderdate AS detected_at,
  CASE WHEN o_orderkey % 17 = 0 THEN 'rejected' WHEN o_orderstatus = 'P' THEN 'pending'
       WHEN o_orderstatus = 'F' THEN 'approved' WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'not_required' END AS review_status,
  CASE WHEN o_orderkey % 7 = 0 THEN 'demo_seed' WHEN o_orderkey % 7 = 1 THEN NULL ELSE 'pipeline' END AS record_source,
  CASE WHEN o_orderkey % 13 = 0 THEN true WHEN o_orderkey % 13 = 1 THEN NULL ELSE false END AS suspected_false_positive,
  CASE o_orderkey % 4 WHEN 0 THEN 'no_change' WHEN 1 THEN 'minor' WHEN 2 THEN 'major' ELSE NULL END AS abstract_class,
  CASE o_orderkey % 5 WHEN 0 THEN 'minor' WHEN 1 THEN 'medium' WHEN 2 THEN 'significant' WHEN 3 THEN 'major'
       ELSE NULL END AS fulltext_tier FROM orders""",
    "affected_citations": """SELECT concat(l_orderkey, '::', l_linenumber, '::', l_partkey, '::', l_suppkey) AS affected_citation_id,
  CAST(l_orderkey AS BIGINT) AS drift_event_id, CAST(l_partkey AS BIGINT) AS work_id,
  CASE (l_orderkey + l_linenumber) % 6 WHEN 0 THEN 'superseded' WHEN 1 THEN 'indirect' WHEN 2 THEN 'flagged_as_previous'
       WHEN 3 THEN 'unclear' WHEN 4 THEN 'current' ELSE 'not_relying' END AS cites,
  CASE l_linenumber % 4 WHEN 0 THEN 'model_input' WHEN 1 THEN 'reported_as_fact' WHEN 2 THEN 'background'
       ELSE 'unknown' END AS role,
  CASE l_returnflag WHEN 'A' THEN 'pending' WHEN 'R' THEN 'approved' ELSE
       CASE WHEN l_suppkey % 9 = 0 THEN 'rejected' ELSE 'not_required' END END AS review_status,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_shipdate END AS scored_at,
  CASE WHEN l_partkey % 19 = 0 THEN 'demo_seed' ELSE 'pipeline' END AS record_source,
  CASE l_suppkey % 4 WHEN 0 THEN concat('chain:', l_suppkey) WHEN 1 THEN 'search_more:5.8' WHEN 2 THEN 'prefetch'
       ELSE NULL END AS source FROM lineitem""",
    "notification_log": """SELECT concat(l_orderkey, '::', l_linenumber, '::', l_partkey, '::', l_suppkey) AS affected_citation_id,
  CAST(l_orderkey AS BIGINT) AS drift_event_id,
  CASE l_orderkey % 3 WHEN 0 THEN 'sent' WHEN 1 THEN 'drafted' ELSE 'failed' END AS status,
  CASE WHEN l_partkey % 19 = 0 THEN 'demo_seed' ELSE 'pipeline' END AS record_source FROM lineitem WHERE l_linenumber = 1""",
    "citation_runs": """SELECT CAST(o_orderkey AS BIGINT) AS run_id, CAST(o_custkey AS BIGINT) AS target_id,
  CAST(floor(o_custkey / 3) AS BIGINT) AS drift_event_id,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN CASE o_orderkey % 3 WHEN 0 THEN 'failed' ELSE 'running' END
       ELSE CASE o_orderkey % 2 WHEN 0 THEN 'queued' ELSE 'done' END END AS status,
  o_orderdate AS queued_at, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 4 > 1 THEN o_orderdate ELSE NULL END AS step_at,
  CASE WHEN o_orderstatus = 'P' THEN o_orderdate ELSE NULL END AS started_at,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS checked_until,
  CASE WHEN o_orderkey % 4 = 0 THEN false ELSE true END AS coverage_complete,
  CAST(o_orderkey % 40 AS BIGINT) AS n_unjudged FROM orders""",
    # every order is a version of its customer's preprint
    "preprints": """SELECT concat('10.1101/', o_custkey) AS doi,
  concat('v', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS version,
  CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE concat('10.1016/p', o_custkey) END AS published_doi,
  o_custkey % 3 > 0 AND o_custkey % 10 < 8 AS is_final_preprint,
  CASE WHEN o_custkey % 2 = 0 THEN 'biorxiv' ELSE 'medrxiv' END AS source,
  CASE WHEN o_custkey % 23 = 0 THEN 'demo_seed' WHEN o_custkey % 23 = 1 THEN NULL ELSE 'pipeline' END AS record_source,
  CASE WHEN o_orderkey % 50 = 0 THEN 'withdrawn' ELSE 'new results' END AS type,
  CASE WHEN o_orderkey % 4 = 0 THEN 'jats' ELSE 'api' END AS text_source,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderdate END AS ingested_at,
  CAST(o_orderkey AS BIGINT) AS row_no FROM orders""",
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    steady_unions(spark)
    df = spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))
    return spread(df) if table in ("documents", "pages") else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view as a DataFrame over the given tables."""
    sql = VIEWS[name].replace("{str}", "STRING").replace("{each}", "explode(array(").replace("{end}", "))")
    used = [t for t in TABLES if f" {t}" in sql]
    for t in used:
        load(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)


def with_views(*names: str) -> str:
    """The same views as a WITH clause for the oracle."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].replace('{str}', 'VARCHAR').replace('{each}', 'unnest([').replace('{end}', '])')})" for n in names)
