"""All queries of the match-tracking operators."""

from __future__ import annotations

from pitchflow.plans import events, hygiene, identity, play, report, scalars, teams, tracks

MODULES = (play, scalars, identity, teams, tracks, hygiene, report, events)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
