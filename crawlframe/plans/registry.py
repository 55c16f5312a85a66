"""All registered queries and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MODULES = ("text_queries", "backlink_queries", "graph_queries", "keyword_queries", "event_queries", "page_queries", "markup_queries", "audit_queries", "score_queries", "site_queries", "stream_queries", "io_queries", "policy_queries", "block_queries", "robots_queries", "entity_queries", "site_audit_queries")


def query(sql: str | None = None):
    """Register a query ``(spark, sf_dir) -> DataFrame`` under its function's name, with its SQL if there is one."""

    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_of(select_list: str) -> list[str]:
    """Columns of a select list, cut at commas outside of brackets and quotes, for ``selectExpr``."""
    out, depth, quoted, own = [], 0, False, ""
    for c in select_list:
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out, own = [*out, own], ""
        else:
            own += c
    return [*out, own]


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"crawlframe.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
