"""Visits: derivation from raw rows or wide tables, labels, transits, pivots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def derive_visits(
    rows: DataFrame, entity: str, stage: str, t: str, carry: Sequence[str] = (), maxima: Sequence[str] = ()
) -> DataFrame:
    """AGG5 over long rows: first and last time per (entity, stage); rows without a time give no visit."""
    return (
        rows.where(F.col(t).isNotNull())
        .groupBy(entity, stage, *carry)
        .agg(
            F.min(t).alias("entry"),
            F.max(t).alias("exit"),
            (F.max(t) - F.min(t)).alias("duration"),
            *[F.max(c).alias(c) for c in maxima],
        )
    )


def visits_from_wide(wide: DataFrame, entity: str, dates: Mapping[int, Sequence[str]]) -> DataFrame:
    """AGG5 over a wide table: min and max inside the row, so no shuffle is needed."""
    per_stage = [
        F.struct(
            F.lit(stage).alias("stage"),
            F.array_min(F.array(*cols)).alias("entry"),
            F.array_max(F.array(*cols)).alias("exit"),
        )
        for stage, cols in dates.items()
    ]
    return (
        wide.select(entity, F.explode(F.array(*per_stage)).alias("v"))
        .where(F.col("v.entry").isNotNull())
        .select(entity, "v.stage", "v.entry", "v.exit", (F.col("v.exit") - F.col("v.entry")).alias("duration"))
    )


def entity_span(wide: DataFrame, entity: str, dates: Sequence[str]) -> DataFrame:
    """AGG6: first and last time of an entity over all date columns; null if it has none."""
    cols = F.array(*dates)
    return wide.select(entity, F.array_min(cols).alias("first_t"), F.array_max(cols).alias("last_t")).withColumn(
        "cycle", F.col("last_t") - F.col("first_t")
    )


def attach_label(visits: DataFrame, labels: DataFrame, entity: str = "entity", label: str = "label") -> DataFrame:
    """Left join of the outcome; an unlabelled entity counts as 0."""
    return visits.join(labels, entity, "left").withColumn(label, F.coalesce(F.col(label), F.lit(0)))


def sensors_long(visits: DataFrame, sensors: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per reading; null readings are dropped."""
    return visits.select(*keep, *sensors).unpivot(list(keep), list(sensors), "feature", "value").where(
        F.col("value").isNotNull()
    )


def sensor_map(sensors: Sequence[str]) -> Column:
    """SHP4: map of the non-null readings of a row."""
    entries = F.map_from_arrays(F.array(*[F.lit(s) for s in sensors]), F.array(*[F.col(s) for s in sensors]))
    return F.map_filter(entries, lambda _, v: v.isNotNull())


def transit_from_previous(
    visits: DataFrame, entity: str, rank: str, entry: str, minutes: float, previous_end: str | None = None,
    stage: str = "stage",
) -> DataFrame:
    """WIN1: clipped minutes since the previous visit in (rank, time) order, 0 for the first visit.

    The window is per entity and a visit table holds at most one row per stage of an entity.
    """
    w = Window.partitionBy(entity).orderBy(rank, entry, stage)
    moved = visits.withColumn("prev_stage", F.lag(stage).over(w)).withColumn(
        "_prev", F.lag(previous_end or entry).over(w)
    )
    return moved.withColumn(
        "transit_minutes",
        F.coalesce(F.greatest(F.lit(0.0), (F.col(entry) - F.col("_prev")) * F.lit(minutes)), F.lit(0.0)),
    ).drop("_prev")


def pivot_stages(
    visits: DataFrame, entity: str, stage: str, stages: Sequence[int], columns: Mapping[str, str]
) -> DataFrame:
    """SHP1 / JN6: one row per entity with a column per stage, as conditional maxima in one aggregation.

    ``columns`` maps a source column to the prefix of its output columns.
    """
    aggs = [
        F.max(F.when(F.col(stage) == s, F.col(src))).alias(f"{prefix}_{s}")
        for src, prefix in columns.items()
        for s in stages
    ]
    return visits.where(F.col(stage).isin(list(stages))).groupBy(entity).agg(*aggs)


def core_flow(
    pivoted: DataFrame, required: Sequence[int], fork: tuple[int, int], prefix: str = "entry"
) -> DataFrame:
    """SHP2: all required stages visited and exactly one stage of the fork; adds ``branch`` (0 or 1)."""
    a, b = (F.col(f"{prefix}_{s}").isNotNull() for s in fork)
    keep: Column = (a & ~b) | (~a & b)
    for s in required:
        keep = keep & F.col(f"{prefix}_{s}").isNotNull()
    return pivoted.where(keep).withColumn("branch", F.when(b, 1).otherwise(0))


def stage_presence(visits: DataFrame, entity: str, stage: str, members: Sequence[int]) -> DataFrame:
    """Entities that visited all of ``members``."""
    return (
        visits.where(F.col(stage).isin(list(members)))
        .groupBy(entity)
        .agg(F.count_distinct(stage).alias("n"))
        .where(F.col("n") == len(set(members)))
        .select(entity)
    )
