"""Arrival rates, batches, period throughput and stage pacing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stageflow.functions.timescale import TimeScale
from stageflow.operators import primitives as P


def percentiles(col: str | Column, points: Sequence[float], approx: bool = False, accuracy: int = 100000) -> Column:
    """Exact linear-interpolation percentiles, or approximate ones for continuous columns of huge groups."""
    arr = F.array(*[F.lit(float(p)) for p in points])
    return F.percentile_approx(col, arr, accuracy) if approx else F.percentile(col, arr)


def weighted_percentiles(col: str | Column, points: Sequence[float], weight: str | Column) -> Column:
    """Exact percentiles of a value that stands for ``weight`` rows."""
    return F.percentile(col, F.array(*[F.lit(float(p)) for p in points]), F.col(weight) if isinstance(weight, str) else weight)


def arrival_gaps(events: DataFrame, t: str, keys: Sequence[str] = (), **kw) -> DataFrame:
    """WIN2: distinct times with the number of events and the gap to the preceding distinct time."""
    return P.previous_position(events, t, keys, **kw).withColumn("gap", F.col(t) - F.col("prev"))


def arrival_summary(events: DataFrame, t: str, scale: TimeScale, **kw) -> DataFrame:
    """AGG14: rates per hour, day and period, mean inter-arrival, gaps and the share of zero gaps.

    n events at d distinct times have n - d zero gaps and d - 1 positive ones, so no row-level diff is needed.
    """
    gaps = arrival_gaps(events, t, **kw)
    one = gaps.agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("d"),
        F.min(t).alias("t0"),
        F.max(t).alias("t1"),
        F.avg("gap").alias("mean_positive_gap"),
        F.expr("percentile(gap, 0.5)").alias("median_positive_gap"),
    )
    span = F.col("t1") - F.col("t0")
    return one.select(
        "n",
        span.alias("span"),
        (F.col("n") / (span * scale.hours)).alias("per_hour"),
        (F.col("n") / (span * scale.hours) * 24.0).alias("per_day"),
        (F.col("n") / span * scale.period).alias("per_period"),
        (span / (F.col("n") - 1)).alias("mean_interarrival"),
        "mean_positive_gap",
        "median_positive_gap",
        ((F.col("n") - F.col("d")) / (F.col("n") - 1)).alias("zero_gap_share"),
    )


def batch_sizes(events: DataFrame, t: str, keys: Sequence[str] = ()) -> DataFrame:
    """AGG15: how many entities share one timestamp, and the gaps between distinct times."""
    gaps = arrival_gaps(events, t, keys)
    p = percentiles("n", (0.5, 0.9))
    return gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("batches"),
        F.avg("n").alias("mean_size"),
        p.getItem(0).alias("median_size"),
        p.getItem(1).alias("p90_size"),
        F.max("n").alias("max_size"),
        F.avg("gap").alias("mean_gap"),
        F.expr("percentile(gap, 0.5)").alias("median_gap"),
    )


def per_period(events: DataFrame, t: str, scale: TimeScale, keys: Sequence[str] = ()) -> DataFrame:
    """AGG16: events per period."""
    return events.groupBy(*keys, scale.bucket(F.col(t)).alias("period")).agg(F.count(F.lit(1)).alias("n"))


def first_event(visits: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    return visits.groupBy(*keys).agg(F.min(t).alias(t))


def period_crosstab(
    first: DataFrame, t: str, column: str, values: Sequence[int], scale: TimeScale, prefix: str
) -> DataFrame:
    """AGG17 / SHP3: entities per period and line, one column per line, empty cells 0."""
    return (
        first.withColumn("period", scale.bucket(F.col(t)))
        .groupBy("period")
        .agg(*[F.count_if(F.col(column) == v).alias(f"{prefix}_{v}") for v in values])
    )


def stage_throughput(visits: DataFrame, stage: str, t: str, scale: TimeScale) -> DataFrame:
    """AGG18: statistics of the per-period counts of every stage."""
    weekly = per_period(visits, t, scale, (stage,))
    return weekly.groupBy(stage).agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("periods"),
        F.avg("n").alias("mean_n"),
        F.expr("percentile(n, 0.5)").alias("median_n"),
        F.max("n").alias("max_n"),
        F.min("n").alias("min_n"),
        F.stddev_samp("n").alias("std_n"),
        (F.avg("n") / (scale.period * scale.hours)).alias("per_hour"),
    )


def duration_summary(visits: DataFrame, stage: str, scale: TimeScale) -> DataFrame:
    """AGG7: dwell statistics per stage.

    Durations are counted first, so the exact percentiles run over distinct values with frequencies.
    """
    counted = visits.groupBy(stage, "duration").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("entry").alias("lo"),
        F.max("entry").alias("hi"),
        F.sum("entry").alias("entry_sum"),
    )
    p = weighted_percentiles("duration", (0.5, 0.9, 0.99), "n")
    return counted.groupBy(stage).agg(
        F.sum("n").alias("visits"),
        (F.sum(F.col("duration") * F.col("n")) / F.sum("n")).alias("mean_d"),
        p.getItem(0).alias("median_d"),
        p.getItem(1).alias("p90_d"),
        p.getItem(2).alias("p99_d"),
        F.max("duration").alias("max_d"),
        (F.sum(F.when(F.col("duration") == 0, F.col("n")).otherwise(0)) * 100.0 / F.sum("n")).alias("zero_pct"),
        F.min("lo").alias("entry_min"),
        F.max("hi").alias("entry_max"),
        (F.sum("entry_sum") / F.sum("n")).alias("entry_mean"),
        (F.sum(F.col("duration") * F.col("n")) / F.sum("n") * scale.minutes).alias("mean_minutes"),
    )


def duration_percentiles(visits: DataFrame, stage: str, stages: Sequence[int]) -> DataFrame:
    """AGG25: dwell percentiles of selected stages."""
    counted = visits.where(F.col(stage).isin(list(stages))).groupBy(stage, "duration").agg(F.count(F.lit(1)).alias("n"))
    p = weighted_percentiles("duration", (0.5, 0.9, 0.95, 0.99), "n")
    return counted.groupBy(stage).agg(
        *[p.getItem(i).alias(n) for i, n in enumerate(("p50", "p90", "p95", "p99"))],
        (F.sum(F.col("duration") * F.col("n")) / F.sum("n")).alias("mean_d"),
        F.max("duration").alias("max_d"),
    )


def segment_gaps(
    pivoted: DataFrame, segments: Sequence[tuple[int, int]], start: str = "entry", stop: str = "entry",
    keep: Sequence[str | Column] = (),
) -> DataFrame:
    """Long table of stage-to-stage gaps from a pivoted visit table; pairs not both visited are dropped."""
    pairs = F.array(*[
        F.struct(
            F.lit(f"S{a}->S{b}").alias("segment"),
            (F.col(f"{stop}_{b}") - F.col(f"{start}_{a}")).alias("gap"),
            F.col(f"entry_{b}").alias("arrived"),
        )
        for a, b in segments
    ])
    return pivoted.select(*keep, F.explode(pairs).alias("p")).where(F.col("p.gap").isNotNull()).select(
        *keep, "p.segment", "p.gap", "p.arrived"
    )


def segment_transits(gaps: DataFrame, minutes: float) -> DataFrame:
    """AGG24: percentiles over gaps >= 0, zero share over all gaps including negative ones."""
    counted = gaps.groupBy("segment", "gap").agg(F.count(F.lit(1)).alias("n"))
    ok = F.col("gap") >= 0
    value = F.when(ok, F.col("gap"))
    p = F.percentile(value, F.array(*[F.lit(x) for x in (0.5, 0.9, 0.95, 0.99)]), F.col("n"))
    return counted.groupBy("segment").agg(
        F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("n"),
        *[(p.getItem(i) * minutes).alias(c) for i, c in enumerate(("median_min", "p90_min", "p95_min", "p99_min"))],
        (F.sum(value * F.col("n")) / F.sum(F.when(ok, F.col("n"))) * minutes).alias("mean_min"),
        (F.sum(F.when(F.col("gap") == 0, F.col("n")).otherwise(0)) * 100.0 / F.sum("n")).alias("zero_pct"),
    )


def period_segment_transits(gaps: DataFrame, scale: TimeScale, segments: Sequence[str]) -> DataFrame:
    """AGG26: p90, p99 and zero share per period and segment, one column group per segment."""
    counted = gaps.withColumn("period", scale.bucket(F.col("arrived"))).groupBy("period", "segment", "gap").agg(
        F.count(F.lit(1)).alias("n")
    )
    p = weighted_percentiles("gap", (0.9, 0.99), "n")
    per = counted.groupBy("period", "segment").agg(
        p.getItem(0).alias("p90"),
        p.getItem(1).alias("p99"),
        (F.sum(F.when(F.col("gap") == 0, F.col("n")).otherwise(0)) * 100.0 / F.sum("n")).alias("zero_pct"),
    )
    return per.groupBy("period").agg(*[
        F.max(F.when(F.col("segment") == s, F.col(m))).alias(f"{s.replace('->', '_')}_{m}")
        for s in segments
        for m in ("p90", "p99", "zero_pct")
    ])


def cycle_distribution(spans: DataFrame, scale: TimeScale, limit_hours: float, width_hours: float, bins: int) -> DataFrame:
    """AGG43: histogram of cycle hours clipped into the last bin, with the share within the limit."""
    hours = F.col("cycle") * scale.hours
    slot = F.least(F.floor(hours / width_hours), F.lit(bins - 1)).cast("int")
    counted = spans.where(F.col("cycle").isNotNull()).groupBy(slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hours <= limit_hours).alias("within")
    )
    whole = P.total(counted, n=F.sum("n"), within=F.sum("within"))
    return counted.select("bin", "n", (whole.getField("within") * 100.0 / whole.getField("n")).alias("within_pct"))
