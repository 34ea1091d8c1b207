"""All core queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

from sozmill.plans import corpus, feeds, intervals, sampling, scoring, texts

FLAGSHIP = "prepare_summary"
_MODULES = (corpus, feeds, intervals, sampling, scoring, texts)


def queries() -> dict:
    return {name: f for module in _MODULES for name, f in module.CATALOG.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.CATALOG.sql.items()}
