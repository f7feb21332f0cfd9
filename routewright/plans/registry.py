"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from routewright.plans import (
    catalog,
    context,
    cost,
    cover_chain,
    evaluation,
    graph,
    rendering,
    retrieval,
    schema_search,
    sources,
    synthesis,
)

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = [
    retrieval, schema_search, cover_chain, evaluation, catalog, graph, synthesis, rendering, context, cost, sources,
]


def queries() -> dict[str, Query]:
    return {name: q for module in _MODULES for name, q in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
