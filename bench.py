"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Names given as arguments replace the list."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = """find_quotes quote_verification sentences norm_squash number_normalisation strip_noise stated_values claim_values
revised_value_terms chunk_units search_in_documents value_matches quantity_sentences citer_listing citing_sentences
citer_screening candidate_flags screening_plan bm25_ranking vector_ranking rank_fusion change_index exact_candidates
candidate_sets title_matches cited_library_events dashboard_stats review_queue verdict_counts run_rollup pending_pairs
pending_notifications keyed_upsert strongest_verdicts dispatch_outcomes event_translation""".split()


def main() -> None:
    from revtrace.plans.registry import QUERIES
    from revtrace.session import local_session
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = sorted(QUERIES)
    spark = local_session(cpus)
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
