"""All queries of the core, gathered from the modules that register them."""

from __future__ import annotations

from millrace.plans import catalog_data, catalog_governance, catalog_graph, catalog_relational, catalog_search, catalog_text  # noqa: F401
from millrace.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
