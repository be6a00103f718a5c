"""Dashboard and alert queries over the point table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stageflow.operators import primitives as P
from stageflow.operators.points import series

ORDER = F.struct


def latest(df: DataFrame, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """``last()``: value of the newest point per key; the message number decides between equal times."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct("ts", "seq")).alias(value))


def windowed(df: DataFrame, every: str, keys: Sequence[str] = (), **aggs: Column) -> DataFrame:
    """``aggregateWindow(createEmpty: false)``: aggregates per time window, labelled by the window end."""
    return (
        df.groupBy(F.window("ts", every), *keys)
        .agg(*[e.alias(n) for n, e in aggs.items()])
        .select(F.col("window.end").alias("ts"), *keys, *aggs)
    )


def line_kpis(points: DataFrame) -> DataFrame:
    """MON1: newest value of four overview fields, in one pass."""
    names = ("line_average_health", "rolling_throughput_per_hr", "cumulative_defect_rate", "total_parts_completed")
    at = F.struct("ts", "seq")
    return points.where(F.col("measurement") == "line_overview").agg(*[F.max_by(F.col("fields")[n], at).alias(n) for n in names])


def health_series(points: DataFrame, every: str) -> DataFrame:
    """MON2."""
    return windowed(series(points, "station_health", "health_score", ["station_id"]), every, ["station_id"], value=F.avg("value"))


def latest_health(points: DataFrame) -> DataFrame:
    """MON3."""
    return latest(series(points, "station_health", "health_score", ["station_id"]), ["station_id"])


def stage_detail(points: DataFrame, station: str) -> DataFrame:
    """MON4: newest health, sub-scores and observed rate of one stage."""
    names = ("health_score", "feature_drift_score", "transit_pacing_score", "observed_defect_rate")
    mine = points.where((F.col("measurement") == "station_health") & (F.col("tags")["station_id"] == station))
    at = F.struct("ts", "seq")
    return mine.agg(*[F.max_by(F.col("fields")[n], at).alias(n) for n in names])


def sensor_series(points: DataFrame, station: str, pattern: str, every: str) -> DataFrame:
    """MON5: all sensor fields whose name matches, averaged per window."""
    mine = points.where((F.col("measurement") == "station_telemetry") & (F.col("tags")["station_id"] == station))
    long = mine.select("ts", F.explode("fields").alias("field", "value")).where(F.col("field").rlike(pattern))
    return windowed(long, every, ["field"], value=F.avg("value"))


def transit_series(points: DataFrame, station: str) -> DataFrame:
    """MON6."""
    return series(points, "station_telemetry", "transit_minutes", ["station_id"]).where(F.col("station_id") == station)


def risk_counts(points: DataFrame) -> DataFrame:
    """MON7: points of high and medium risk and confirmed failures."""
    level = F.col("tags")["risk_level"]
    risk = F.col("measurement") == "part_risk"
    bad = (F.col("measurement") == "station_telemetry") & (F.col("fields")["response"] == 1)
    return points.where(F.col("measurement").isin("part_risk", "station_telemetry")).agg(
        F.count_if(risk & (level == "HIGH")).alias("high"), F.count_if(risk & (level == "MEDIUM")).alias("medium"), F.count_if(bad).alias("confirmed")
    )


def risk_trend(points: DataFrame, every: str) -> DataFrame:
    """MON8."""
    return windowed(series(points, "part_risk", "cumulative_risk"), every, mean_risk=F.avg("value"), peak_risk=F.max("value"))


def watchlist(points: DataFrame, floor: float = 0.5, n: int = 20) -> DataFrame:
    """MON9: the newest n points above the floor."""
    s = series(points, "part_risk", "cumulative_risk", ["part_id", "current_station", "risk_level"]).where(F.col("value") > floor)
    return s.orderBy(F.desc("ts"), F.desc("seq")).limit(n).select(
        "ts", "part_id", F.col("current_station").alias("station"), "risk_level", F.col("value").alias("risk_score")
    )


def model_status(points: DataFrame) -> DataFrame:
    """MON10: newest decision per model variant and the number of predictions."""
    mine = points.where((F.col("measurement") == "ai_part_risk") & F.col("fields")["predicted_defect_prob"].isNotNull())
    return mine.groupBy(F.col("tags")["scenario_model"].alias("scenario_model")).agg(
        F.max_by(F.col("fields")["decision_time"], F.struct("ts", "seq")).alias("last_decision"), F.count(F.lit(1)).alias("predictions")
    )


def predicted_vs_observed(points: DataFrame, every: str) -> DataFrame:
    """MON11: windowed mean prediction next to the observed rate as a fraction."""
    pred = windowed(series(points, "ai_part_risk", "predicted_defect_prob"), every, value=F.avg("value"))
    seen = series(points, "line_overview", "cumulative_defect_rate").select("ts", (F.col("value") / 100.0).alias("value"))
    return pred.select(F.lit("Predicted Risk (P)").alias("field"), "ts", "value").unionByName(
        seen.select(F.lit("Line Observed Defect Rate").alias("field"), "ts", "value")
    )


def high_risk_by_stage(points: DataFrame) -> DataFrame:
    """MON12: predictions flagged as high risk, by stage."""
    s = series(points, "ai_part_risk", "predicted_defect_prob", ["station_id", "is_high_risk"]).where(F.col("is_high_risk") == "True")
    return s.groupBy("station_id").agg(F.count(F.lit(1)).alias("predictions"), F.max("value").alias("peak"))


def anomaly_vs_threshold(points: DataFrame) -> DataFrame:
    """MON13: anomaly score and threshold as two series."""
    mine = points.where(F.col("measurement") == "ai_anomaly")
    pairs = F.array(
        F.struct(F.lit("Reconstruction Error (MSE)").alias("field"), F.col("fields")["anomaly_score"].alias("value")),
        F.struct(F.lit("Threshold (p99 Normal Windows)").alias("field"), F.col("fields")["threshold_p99"].alias("value")),
    )
    return mine.select("ts", F.inline(pairs))


def latest_attribution(points: DataFrame) -> DataFrame:
    """MON14."""
    long = points.where(F.col("measurement") == "ai_anomaly").select("ts", "seq", F.explode("fields").alias("field", "value"))
    return latest(long.where(F.col("field").startswith("attr_")), ["field"])


def window_series(points: DataFrame) -> DataFrame:
    """MON15: throughput and zero share of every emitted window."""
    return points.where(F.col("measurement") == "ai_window").select(
        "ts", F.col("tags")["station_id"].alias("station_id"), F.col("fields")["throughput"].alias("throughput"), F.col("fields")["zero_delta_share"].alias("zero_delta_share")
    )


def point_counts(points: DataFrame) -> DataFrame:
    """MON16."""
    return points.select("measurement", F.explode(F.map_keys("fields")).alias("field")).groupBy("measurement", "field").agg(F.count(F.lit(1)).alias("n"))


def evaluations(events: DataFrame, sec: str, back: int, aggs: Mapping[str, Column], keys: Sequence[str] = (), every: int = 60) -> DataFrame:
    """Alert input: aggregates over [g - back, g) for every evaluation time g of a dense grid, empty ones null.

    Events are first collapsed per evaluation slot; a slot then feeds the back / every evaluations after it.
    ``aggs`` must combine (sum, max, min) under their own name.
    """
    keys = list(keys)
    slot = F.floor(F.col(sec) / F.lit(every)).cast("long")
    slots = events.groupBy(*keys, slot.alias("_slot")).agg(*[e.alias(n) for n, e in aggs.items()])
    span = slots.groupBy(*keys).agg(F.min("_slot").alias("_a"), F.max("_slot").alias("_b"))
    grid = P.dense_grid(span, "_a", "_b", 1, "g").select(*keys, "g")
    spread = slots.withColumn("g", F.explode(F.sequence(F.col("_slot") + 1, F.col("_slot") + back // every)))
    merged = spread.groupBy(*keys, "g").agg(*[(F.max(n) if n.startswith("max") else F.sum(n)).alias(n) for n in aggs])
    return grid.join(merged, [*keys, "g"], "left")


def hold(evals: DataFrame, condition: Column, held: int, keys: Sequence[str] = ()) -> DataFrame:
    """ALR5: evaluations at which the condition has been true for ``held`` evaluations before as well.

    A true evaluation supports itself and the next ``held`` ones; an alert fires where all ``held + 1`` supports meet.
    """
    keys = list(keys)
    true = evals.where(condition).select(*keys, F.explode(F.sequence(F.col("g"), F.col("g") + held)).alias("g"))
    last = evals.select(*keys, "g")
    counted = true.groupBy(*keys, "g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == held + 1)
    return counted.select(*keys, "g").join(last, [*keys, "g"], "left_semi")


def alert(
    events: DataFrame, sec: str, back: int, held: int, aggs: Mapping[str, Column], condition: Column, keys: Sequence[str] = (), every: int = 60
) -> DataFrame:
    """ALR1-4: windowed condition on the evaluation grid, held for a while."""
    return hold(evaluations(events, sec, back, aggs, keys, every), condition, held, keys)
