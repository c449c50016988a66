"""The queries of this package with their SQL, where SQL can express them."""
from __future__ import annotations

from . import q_bpe, q_conversation_repair, q_exact_dedup, q_lexical_search, q_licenses, q_line_dedup, q_lm_scoring, q_media, q_mixing, q_near_dedup, q_quality, q_rank_bpe, q_substring_dedup

QUERIES = {"op1_quality": q_quality.query, "op2_license_scan": q_licenses.query, "op3_line_dedup": q_line_dedup.query,
           "op9_exact_dedup": q_exact_dedup.query, "op4_mix_sources": q_mixing.query, "op8_bpe": q_bpe.query,
           "op5_near_dedup": q_near_dedup.query, "op6_substring_dedup": q_substring_dedup.query,
           "op7_media_columns": q_media.query, "op10_lm_score": q_lm_scoring.query,
           "op11_conversation_repair": q_conversation_repair.query,
           "op12_lexical_search": q_lexical_search.query, "op13_rank_bpe": q_rank_bpe.query}
ORACLES = {"op9_exact_dedup": q_exact_dedup.SQL, "op4_mix_sources": q_mixing.SQL, "op5_near_dedup": q_near_dedup.SQL,
           "op6_substring_dedup": q_substring_dedup.SQL, "op11_conversation_repair": q_conversation_repair.SQL,
           "op12_lexical_search": q_lexical_search.SQL}
