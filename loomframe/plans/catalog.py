"""All registered queries and their DuckDB twins."""

from __future__ import annotations

from . import batch_queries, select_queries, token_queries  # noqa: F401  (they register themselves)
from .views import ORACLE_SQL, QUERIES  # noqa: F401
