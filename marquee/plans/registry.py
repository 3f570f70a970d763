"""Registry of named queries and the SQL each one is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from marquee.plans.views import SQL_VIEWS, Tables
from marquee.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def naive(df: DataFrame) -> DataFrame:
    """Zone-less timestamps, so that results compare with plain SQL timestamps."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def with_views(body: str) -> str:
    """Prefix ``body`` with the derived views it uses, in dependency order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in SQL_VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(SQL_VIEWS[name])

    visit(body)
    parts = [f"{name} AS ({SQL_VIEWS[name].strip()})" for name in SQL_VIEWS if name in needed]
    body = body.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[len("WITH RECURSIVE"):]
    if body.upper().startswith("WITH"):
        return "WITH " + ",\n".join(parts) + ",\n" + body[len("WITH"):]
    return "WITH " + ",\n".join(parts) + "\n" + body


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return naive(fn(Tables(spark, sf_dir)))

        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return wrap
