"""All registered queries of the library, by the identifier of the operator they show."""

from __future__ import annotations

from . import aggregates, bar_windows, companies, contests, fundamentals, histories, joins, ledgers, mood, quality, research, scalars, screening, screens, strategies, streams  # noqa: F401  (registration)
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
