"""Registered queries against their SQL on the smallest tables. ALL_ORACLES=1 runs every one of them."""
import os

import pytest

import __spark_entry__ as entry
from tests.check_oracles import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = """find_quotes quote_verification citer_screening quantity_sentences candidate_flags citation_chains bm25_ranking rank_fusion
exact_candidates reference_lines cited_library_events dashboard_stats review_queue run_rollup coverage_records event_decisions notices
dispatch_outcomes event_translation stale_runs strip_noise revised_value_terms chunk_units table_rows""".split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ALL_ORACLES") else SAMPLE


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = connect(SF)
    got, want = compare(spark, con, SF, entry.queries()[name], entry.oracle_sql()[name])
    assert got == want


def test_every_query_has_sql_or_a_reason():
    from revtrace.plans import registry
    assert set(registry.QUERIES) == set(registry.ORACLES) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    if os.path.isdir(SF):
        assert entry.entry(spark).columns == ["doc_id", "item_id"]
