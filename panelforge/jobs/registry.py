"""Queries by name, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Common table expressions of the SQL twins: name -> (names it reads, text).
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, text: str, *needs: str) -> None:
    VIEWS[name] = (needs, text)


def with_views(sql: str, needs: tuple[str, ...]) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS[name][0]:
            add(other)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    return f"WITH {', '.join(f'{n} AS ({VIEWS[n][1]})' for n in order)} {sql}" if order else sql


def query(name: str, sql: str | None = None, *needs: str):
    """Registers a function of (spark, sf_dir) under ``name``; ``sql`` may read the views it ``needs``."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_views(sql, needs)
        return f

    return register


def rnd(x: Column | str, digits: int = 9) -> Column:
    """Rounded for comparison, never minus zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def shown(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    """``columns`` (all if none), with times as dates and doubles rounded."""
    kinds = dict(df.dtypes)
    out = []
    for c in columns or df.columns:
        kind = kinds[c]
        out.append(F.to_date(c).alias(c) if kind == "timestamp" else rnd(c, digits).alias(c) if kind == "double" else F.col(c))
    return df.select(*out)
