"""Registered queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weir.plans.landed import AS_OF, duck

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` is its oracle, with landed views by name."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


def oracle_sql() -> dict[str, str]:
    """Oracle text per query, landed views written out."""
    return {name: duck(sql) for name, sql in ORACLE.items()}


def record_sql(source: str, keep: str, **fields: str) -> str:
    """Oracle select of the flat record; ``fields`` are SQL expressions over ``source``."""
    url = fields.get("url", "''")
    columns = {
        "source_type": "''", "source_name": "''", "title": "''", "content": "''", "url": url,
        "id": f"substr(md5({url}), 1, 12)", "fetched_at": f"'{AS_OF}'", "media_type": "'text'",
        "media_url": "cast(null as varchar)", "score": "0", "priority": "'normal'", "category": "''",
        "processed": "false", "digest_date": "cast(null as varchar)", "title_cn": "cast(null as varchar)",
        "content_cn": "cast(null as varchar)", "tags": "''", "extra": "'{}'",
    }
    columns.update(fields)
    return f"select {keep}, " + ", ".join(f"{e} as {c}" for c, e in columns.items()) + f" from {source}"
