"""All registered queries and the reference SQL of those SQL can state."""

from __future__ import annotations

from scriptorium.plans import (
    edit_queries,
    package_queries,
    page_queries,
    stream_queries,
    text_queries,
)

_GROUPS = (text_queries, edit_queries, page_queries, package_queries, stream_queries)

QUERIES = {name: query for group in _GROUPS for name, query in group.QUERIES.items()}
SQL = {name: sql for group in _GROUPS for name, sql in group.SQL.items()}
