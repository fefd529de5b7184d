"""All registered queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from . import evidence, relational, textual

MODULES = [relational, textual, evidence]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}


def cases() -> dict:
    """Operators over inline records, with their SQL: not registered, but tested like queries."""
    return {k: (f, m.CASE_SQL[k]) for m in (textual, evidence) for k, f in m.CASES.items()}
