"""Named queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from . import queries as _queries
from . import queries_hooks, queries_more, queries_recall, queries_state  # noqa: F401  (register their queries)


def queries() -> dict:
    return dict(_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_queries.ORACLE)
