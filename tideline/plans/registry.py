"""Where the query modules enter their queries and oracle texts."""

from __future__ import annotations

from collections.abc import Callable

from tideline.plans.views_sql import with_views

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None, views: str = ""):
    """Register a ``(spark, sf_dir) -> DataFrame`` function, with its DuckDB text where there is one."""

    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = with_views(views, sql) if views else sql.strip()
        return fn

    return register
