"""Helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stageflow.session import materialize, work_dir

__all__ = ["fresh", "materialize", "pin", "remainder", "table", "work_dir"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text modulo n: the fold of a row. Null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % n


def fresh(df: DataFrame, name: str) -> str:
    """``name``, prefixed until no column of ``df`` has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def pin(c: Column) -> Column:
    """``c``, computed once a row where it stands. The optimiser copies a plain definition into later lambdas and pushed filters, where
    an array would be built anew for each of its elements; it doesn't copy what depends on the row's place."""
    return F.when(F.monotonically_increasing_id() >= 0, c)
