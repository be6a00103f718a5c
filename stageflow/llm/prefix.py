"""Prefix sums over a global order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stageflow.llm.common import materialize


def prefix_sums(rows: DataFrame, order: list[str], size: str, name: str) -> tuple[DataFrame, int]:
    """Adds ``at`` (sum of ``size`` before the row) and ``row`` (rows before it) in the order of the columns ``order``; and the total.

    The rows are dealt by range over all of ``order``, so rows that tie in the first columns are spread by the others, and written, since a
    range partitioning that is computed twice may cut at other places. Totals by partition reach the driver; they are the starts of the sums
    inside the partitions. Pass narrow rows."""
    dealt = materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), f"{name}-order")
    starts, total, count = [], 0, 0
    for part, size_, n in sorted(dealt.groupBy("_part").agg(F.sum(size).cast("long"), F.count("*")).collect()):
        starts.append((part, total, count))
        total, count = total + size_, count + n
    base = rows.sparkSession.createDataFrame(starts, "_part int, _total long, _count long")  # one row a partition
    w = Window.partitionBy("_part").orderBy(*order)
    out = (
        dealt.withColumn("_n", F.row_number().over(w))
        .withColumn("_upto", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .join(F.broadcast(base), "_part")
        .withColumn("at", (F.col("_total") + F.col("_upto") - F.col(size)).cast("long"))
        .withColumn("row", (F.col("_count") + F.col("_n") - 1).cast("long"))
    )
    return out.drop("_part", "_n", "_upto", "_total", "_count"), total
