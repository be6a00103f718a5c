"""Measurement drift per stage and period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stageflow.functions import scalar as S
from stageflow.functions.timescale import TimeScale


def period_values(values: DataFrame, t: str, scale: TimeScale, label: str | None = None) -> DataFrame:
    """Weekly mean, sample deviation and failures per (stage, feature, period)."""
    extra = [F.sum(label).cast("long").alias("defects")] if label else []
    return values.groupBy("stage", "feature", scale.bucket(F.col(t)).alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), *extra
    )


def global_moments(values: DataFrame, min_rows: int) -> DataFrame:
    """Mean and population deviation per feature; an undefined or zero deviation counts as 1."""
    return (
        values.groupBy("stage", "feature")
        .agg(F.count(F.lit(1)).alias("total"), F.avg("value").alias("mu"), F.stddev_pop("value").alias("sigma"))
        .where(F.col("total") >= min_rows)
        .withColumn("sigma", F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(F.lit(1.0)))
    )


def stage_drift(values: DataFrame, t: str, scale: TimeScale, label: str = "label", min_rows: int = 50) -> DataFrame:
    """AGG27: largest weekly shift in deviations, peak weekly failure rate and its ratio to the overall rate."""
    weekly = period_values(values, t, scale, label)
    joined = weekly.join(global_moments(values, min_rows), ["stage", "feature"])
    return (
        joined.withColumn("z", (F.col("mean") - F.col("mu")) / F.col("sigma"))
        .groupBy("stage", "feature")
        .agg(
            F.max("total").alias("n"),
            F.max("mu").alias("mu"),
            F.max("sigma").alias("sigma"),
            F.max(F.abs("z")).alias("max_abs_z"),
            F.max(F.col("defects") / F.col("n")).alias("peak_rate"),
            (F.sum("defects") / F.sum("n")).alias("rate"),
        )
        .withColumn("spike_ratio", S.ratio(F.col("peak_rate"), F.col("rate")))
    )


def period_z(values: DataFrame, t: str, scale: TimeScale) -> DataFrame:
    """AGG34: z of every weekly mean against the overall mean and sample deviation of the feature."""
    moments = values.groupBy("stage", "feature").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sigma"))
    return period_values(values, t, scale).join(moments, ["stage", "feature"]).select(
        "stage", "feature", "period", "n", "mean", "std", ((F.col("mean") - F.col("mu")) / F.col("sigma")).alias("z")
    )
