"""The registered queries, with an SQL text for each that SQL can express."""

from __future__ import annotations

from . import composed_q, graphs_q, pairs_q, prune_q, stats_q, text_q

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (text_q, graphs_q, pairs_q, prune_q, stats_q, composed_q):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
