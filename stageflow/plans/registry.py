"""Registry of runnable queries: a Spark plan and, where SQL can say it, the equivalent SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from stageflow.session import configure
from stageflow.sources.tables import Data


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}

# Shared SQL sub-queries: name -> (sub-queries it needs, text).
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def as_doubles(text: str) -> str:
    """Write decimal literals in exponent form, so that SQL arithmetic is double precision as in Spark."""
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", text)


def half_up(x: str, digits: int) -> str:
    """SQL text of ``scalar.round_half_up``."""
    return f"CAST(round(CAST({x} AS DECIMAL(18, 10)), {digits}) AS DOUBLE)"


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``fn(data)`` under ``name``."""

    def wrap(fn: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Data(configure(spark), sf_dir))

        REGISTRY[name] = Query(run, as_doubles(sql) if sql else None)
        return fn

    return wrap


def cte(name: str, text: str, needs: Iterable[str] = ()) -> None:
    CTES[name] = (tuple(needs), text)


def sql(needs: str, body: str) -> str:
    """Prefix ``body`` with the named shared sub-queries and everything they need."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in CTES[n][0]:
            visit(dep)
        order.append(n)

    for n in needs.split():
        visit(n)
    if not order:
        return body
    return "WITH " + ", ".join(f"{n} AS ({CTES[n][1]})" for n in order) + " " + body
