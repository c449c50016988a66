"""All registered queries with their SQL."""
from __future__ import annotations

from . import q_citations, q_retrieval, q_streams, q_tables, q_text

QUERIES: dict = {}
ORACLES: dict = {}

for _module in (q_text, q_tables, q_citations, q_retrieval, q_streams):
    QUERIES.update(_module.Q.queries)
    ORACLES.update(_module.Q.oracles)
