"""Named queries over the test tables, with SQL that gives the same rows."""

from __future__ import annotations

from . import aggregate_queries, architecture_queries, insight_queries, kernel_queries, model_queries, operator_queries, sequence_queries, source_queries, state_queries, table_queries

FLAGSHIP = "state_islands"
QUERIES: dict = {}
ORACLES: dict = {}

for _part in (sequence_queries, aggregate_queries, table_queries, insight_queries, architecture_queries, kernel_queries, operator_queries, source_queries, state_queries, model_queries):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
