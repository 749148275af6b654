"""All registered queries with the SQL that gives the same rows."""

from __future__ import annotations

from .plans import queries_graph, queries_search, queries_text

_GROUPS = [queries_search, queries_graph, queries_text]

QUERIES = {k: v for g in _GROUPS for k, v in g.QUERIES.items()}
SQL = {k: v for g in _GROUPS for k, v in g.SQL.items()}
#: Their tables hold nothing that they look for.
MAY_BE_EMPTY = {"graph_edges_contain"}
FLAGSHIP = QUERIES["hybrid_search"]
