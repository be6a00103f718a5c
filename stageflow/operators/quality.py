"""Failure rates by line, stage, period, route and cohort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stageflow.functions import scalar as S
from stageflow.functions.timescale import TimeScale
from stageflow.operators import primitives as P


def overall(labels: DataFrame, label: str = "label") -> DataFrame:
    """AGG19."""
    return labels.agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("defects")).select(
        "n",
        "defects",
        S.ratio(F.col("defects"), F.col("n")).alias("rate"),
        F.round(S.ratio(F.col("n"), F.col("defects"))).cast("long").alias("one_in"),
    )


def base_rate(labels: DataFrame, label: str = "label"):
    """Overall failure rate as a scalar sub-query."""
    return P.total(labels, rate=F.avg(label)).getField("rate")


def by_group(
    members: DataFrame, labels: DataFrame, group: str, entity: str = "entity", label: str = "label", min_n: int = 0
) -> DataFrame:
    """AGG20-21: volume, failures, rate and relative risk per group of (entity, group) pairs."""
    joined = members.join(labels, entity, "left").withColumn(label, F.coalesce(F.col(label), F.lit(0)))
    base = base_rate(labels, label)
    whole = P.total(labels, n=F.count(F.lit(1))).getField("n")
    out = joined.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("defects")).select(
        group,
        "n",
        "defects",
        (F.col("n") * 100.0 / whole).alias("share_pct"),
        (F.col("defects") / F.col("n")).alias("rate"),
        S.ratio(F.col("defects") / F.col("n"), base).alias("relative_risk"),
    )
    return out.where(F.col("n") >= min_n) if min_n else out


def by_period(
    first: DataFrame, labels: DataFrame, t: str, scale: TimeScale, min_n: int, spike: float,
    entity: str = "entity", label: str = "label",
) -> DataFrame:
    """AGG22 / WIN3: rate per period, centred 3-row mean of the rates, ratio to the base rate, spike flag.

    The window runs over the aggregated period table, one row per period that has entities.
    """
    base = base_rate(labels, label)
    weekly = (
        first.join(labels, entity, "left")
        .groupBy(scale.bucket(F.col(t)).alias("period"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(label, F.lit(0))).cast("long").alias("defects"))
        .withColumn("rate", F.col("defects") / F.col("n"))
    )
    near = Window.partitionBy(F.lit(0)).orderBy("period").rowsBetween(-1, 1)
    ratio = S.ratio(F.col("rate"), base)
    return weekly.select(
        "period", "n", "defects", "rate",
        F.avg("rate").over(near).alias("rolling_rate"),
        ratio.alias("relative_rate"),
        ((F.col("n") >= min_n) & (ratio >= spike)).alias("is_spike"),
    )


def line_comparison(visits: DataFrame, labels: DataFrame, sensors: Sequence[str], entity="entity", stage="stage", line="line") -> DataFrame:
    """AGG30: per line the stages, entities, sensor columns with data, failures and rate."""
    per_line = visits.groupBy(line).agg(
        F.count_distinct(stage).alias("stages"),
        sum((F.max(F.col(s).isNotNull().cast("int")) for s in sensors[1:]), F.max(F.col(sensors[0]).isNotNull().cast("int"))).alias("sensors"),
    )
    pairs = visits.select(entity, line).distinct()
    return per_line.join(by_group(pairs, labels, line, entity), line).select(
        line, "stages", "sensors", F.col("n").alias("entities"), "defects", "rate"
    )


def stage_profile(quality: DataFrame, timing: DataFrame, features: DataFrame, stage: str = "stage") -> DataFrame:
    """AGG31: stage quality, timing and feature counts side by side (three tables of one row per stage)."""
    return quality.join(timing, stage, "left").join(features, stage, "left")


def cohort(
    first: DataFrame, members: DataFrame, labels: DataFrame, t: str, scale: TimeScale, entity="entity", label="label"
) -> DataFrame:
    """AGG32: failure rate of members, all and non-members within the periods in which members occur."""
    marked = (
        first.join(members.select(entity, F.lit(1).alias("_m")), entity, "left")
        .join(labels, entity, "left")
        .select(
            scale.bucket(F.col(t)).alias("period"),
            F.coalesce("_m", F.lit(0)).alias("_m"),
            F.coalesce(label, F.lit(0)).alias("_y"),
        )
    )
    per = marked.groupBy("period").agg(
        F.sum("_m").alias("mn"),
        F.sum(F.col("_m") * F.col("_y")).alias("md"),
        F.count(F.lit(1)).alias("n"),
        F.sum("_y").alias("d"),
    )
    one = per.where(F.col("mn") > 0).agg(*[F.sum(c).cast("long").alias(c) for c in ("mn", "md", "n", "d")])
    parts = F.array(
        F.struct(F.lit("members").alias("cohort"), F.col("mn").alias("n"), F.col("md").alias("defects")),
        F.struct(F.lit("all").alias("cohort"), F.col("n").alias("n"), F.col("d").alias("defects")),
        F.struct(F.lit("others").alias("cohort"), (F.col("n") - F.col("mn")).alias("n"), (F.col("d") - F.col("md")).alias("defects")),
    )
    return one.select(F.inline(parts)).withColumn("rate", S.ratio(F.col("defects"), F.col("n")))


def active_span(visits: DataFrame, stage: str, t: str, scale: TimeScale) -> DataFrame:
    """AGG33: time range, first and last period, number of periods and the busiest period count per stage."""
    weekly = visits.groupBy(stage, scale.bucket(F.col(t)).alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.min(t).alias("lo"), F.max(t).alias("hi")
    )
    return weekly.groupBy(stage).agg(
        F.min("lo").alias("first_t"),
        F.max("hi").alias("last_t"),
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
        F.count(F.lit(1)).alias("periods"),
        F.max("n").alias("max_n"),
        F.sum("n").alias("visits"),
    )
