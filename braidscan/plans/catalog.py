"""Every registered query of the reference's operators, with its SQL."""

from __future__ import annotations

from braidscan.plans import q_eval, q_graph, q_infer, q_more, q_text, q_vector  # noqa: F401  they register their queries
from braidscan.plans.register import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
