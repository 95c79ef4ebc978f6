"""The registered queries and the SQL each is compared with."""

from __future__ import annotations

from workload import alert_queries, check_queries, history_queries, profile_queries

_PARTS = (check_queries, history_queries, profile_queries, alert_queries)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
