"""All registered queries of the library but those of symweave.llm."""

from __future__ import annotations

from symweave import catalog_context, catalog_extract, catalog_graph, catalog_more, catalog_search

PARTS = (catalog_graph, catalog_search, catalog_context, catalog_extract, catalog_more)


def queries() -> dict:
    return {name: run for part in PARTS for name, run in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
