"""Every query of the library by name, with its DuckDB equivalent."""

from __future__ import annotations

from . import relational, scalar

FLAGSHIP = relational.status_totals


def queries() -> dict:
    return scalar.queries() | relational.queries()


def oracle_sql() -> dict[str, str]:
    return scalar.oracle_sql() | relational.oracle_sql()
