"""Every query of the engine by name, with its SQL."""

from __future__ import annotations

from ledgerloom.plans import analysis, answers, assist, catalog, holdings, knowledge, scoring, search, series, stored, streaming, upkeep

PARTS = (search, stored, series, holdings, catalog, scoring, knowledge, analysis, answers, upkeep, assist, streaming)


def queries() -> dict:
    return {name: f for part in PARTS for name, (f, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, (_, sql) in part.QUERIES.items() if sql is not None}
