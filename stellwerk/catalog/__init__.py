"""Registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register


def build() -> Catalog:
    from stellwerk.catalog import enrichment, files, journey, lifecycle, links, pages, planning, portals, reports, terms

    catalog = Catalog()
    for module in (enrichment, reports, planning, links, lifecycle, pages, portals, files, journey, terms):
        module.register(catalog)
    return catalog
