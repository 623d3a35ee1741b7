"""All queries by name, each with the SQL that must give the same rows, where there is any."""

from __future__ import annotations

from tinctura.plans import arena, files, graphs, series, silver, streams, texts, training
from tinctura.plans.base import Query

_MODULES = (silver, texts, arena, training, graphs, series, streams, files)


def queries() -> dict[str, Query]:
    return {name: f for m in _MODULES for name, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.oracle_sql().items()}
