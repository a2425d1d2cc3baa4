"""All registered queries of the library and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from .plans import edges, models, text, upkeep

MODULES = (text, edges, models, upkeep)


def queries() -> dict:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
