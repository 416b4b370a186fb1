"""All queries of the engine itself and the SQL that gives the same rows."""

from __future__ import annotations

from docketry.queries import base, classification, conclusions, documents, evaluation, extraction, fulltext, insights, presentation, relational, retrieval, rules, state

MODULES = (classification, conclusions, documents, evaluation, extraction, fulltext, insights, presentation, relational, retrieval, rules, state)
FLAGSHIP = "retrieve_e2e"


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
