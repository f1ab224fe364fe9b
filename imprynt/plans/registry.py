"""The registry that query modules fill: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from imprynt.plans.fixtures import oracle

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Registers the decorated (spark, sf_dir) function; sql may name the views of fixtures."""

    def add(f):
        assert name not in QUERIES, name
        QUERIES[name] = (f, oracle(sql) if sql else None)
        return f

    return add


def r6(c: str | Column, name: str | None = None) -> Column:
    """Rounded to six places, under its own name."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


def joined(c: str | Column, name: str | None = None) -> Column:
    """An array as text, so that both engines compare it alike."""
    col = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.transform(col, lambda x: x.cast("string")), "|").alias(name or c)
