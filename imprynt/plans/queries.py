"""All queries of the library, except those for training text."""

from __future__ import annotations

from imprynt.plans import q_collection, q_graph, q_stats, q_text  # noqa: F401
from imprynt.plans.registry import QUERIES


def queries() -> dict:
    return {k: q for k, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in QUERIES.items() if s}
