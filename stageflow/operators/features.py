"""Training tables: causally safe entity features, window metrics, sequences, imputation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stageflow.functions import scalar as S
from stageflow.functions.timescale import TimeScale
from stageflow.operators import joins as J
from stageflow.operators import primitives as P
from stageflow.operators import visits as V
from stageflow.session import dictionary, materialize

METRICS = ("max_abs_z", "mean_abs_z", "p90_transit", "zero_delta_share", "throughput")
# What an empty or gap window contributes.
NEUTRAL = {"max_abs_z": 0.0, "mean_abs_z": 0.0, "p90_transit": 0.0, "zero_delta_share": 1.0, "throughput": 0.0}


@dataclass(frozen=True)
class FlowSpec:
    """Stages of the decision problem; the decision is taken on entering one of the two fork stages."""

    required: tuple[int, ...]
    fork: tuple[int, int]
    chain: tuple[int, ...]
    entry_stage: int
    exit_stage: int
    sensor_stages: tuple[int, ...]
    sensors: tuple[str, ...]
    back_ticks: int = 9
    last: int = 500
    base_rate: float = 0.005069

    @property
    def stages(self) -> tuple[int, ...]:
        return tuple(sorted({*self.required, *self.fork, *self.chain, self.entry_stage, self.exit_stage, *self.sensor_stages}))

    @property
    def transits(self) -> list[str]:
        return [f"transit_{a}_{b}" for a, b in zip(self.chain, self.chain[1:])] + [f"transit_{self.chain[-1]}_branch"]

    @property
    def sensor_columns(self) -> list[str]:
        return [f"{s}_{st}" for s in self.sensors for st in self.sensor_stages]

    @property
    def feature_columns(self) -> list[str]:
        return ["branch", *self.transits, "arrivals", "recent_rate", *self.sensor_columns, *[f"{c}_isna" for c in self.sensor_columns]]


def entity_table(visits: DataFrame, labels: DataFrame, spec: FlowSpec, scale: TimeScale, entity: str = "entity") -> DataFrame:
    """ML1: one row per core-flow entity with features known at the decision time, and the label.

    Arrivals and the recent failure rate only use events up to the decision time; the outcome of an entity counts
    once its exit stage was entered.
    """
    columns = {"entry": "entry", **{s: s for s in spec.sensors}}
    piv = V.pivot_stages(visits, entity, "stage", spec.stages, columns)
    core = V.core_flow(piv, spec.required, spec.fork).join(labels, entity, "left")
    a, b = spec.fork
    decision = F.when(F.col("branch") == 1, F.col(f"entry_{b}")).otherwise(F.col(f"entry_{a}"))
    steps = [
        S.clipped_transit(F.col(f"entry_{y}"), F.col(f"entry_{x}"), scale.minutes).alias(f"transit_{x}_{y}")
        for x, y in zip(spec.chain, spec.chain[1:])
    ]
    base = core.select(
        entity,
        decision.alias("decision_time"),
        F.col(f"entry_{spec.exit_stage}").alias("exit_time"),
        scale.bucket(decision).alias("week"),
        "branch",
        *steps,
        S.clipped_transit(decision, F.col(f"entry_{spec.chain[-1]}"), scale.minutes).alias(spec.transits[-1]),
        *spec.sensor_columns,
        *[S.missing_flag(F.col(c)).alias(f"{c}_isna") for c in spec.sensor_columns],
        F.coalesce("label", F.lit(0)).alias("label"),
    )
    base = materialize(base, "core_flow")
    arrivals = visits.where(F.col("stage") == spec.entry_stage).select(F.col("entry").alias("_t"))
    with_load = J.range_count(base, arrivals, "_t", spec.back_ticks, "arrivals", "decision_time")
    return J.recent_rate(
        with_load, base.select(F.col("exit_time").alias("_t"), entity, "label").where(F.col("_t").isNotNull()),
        "decision_time", "_t", entity, "label", spec.last, spec.base_rate,
    )


def impute_and_scale(df: DataFrame, columns: Sequence[str], train: Column) -> DataFrame:
    """ML6: fill with the training median, then centre and scale by training mean and population deviation (0 -> 1)."""
    fit = df.where(train)
    long = fit.unpivot([], list(columns), "_c", "_v")
    med = P.quantiles(long.select("_c", F.col("_v").cast("double").alias("_v")), "_v", (0.5,), ["_c"])
    med = materialize(med.groupBy().pivot("_c", list(columns)).agg(F.first("quantile")), "medians")
    m = P.total(med, **{c: F.first(f"`{c}`") for c in columns})
    filled = lambda c: F.coalesce(F.col(c).cast("double"), m.getField(c), F.lit(0.0))
    stats = P.total(
        fit, **{f"m_{c}": F.avg(filled(c)) for c in columns}, **{f"s_{c}": F.stddev_pop(filled(c)) for c in columns}
    )
    for c in columns:
        sd = stats.getField(f"s_{c}")
        df = df.withColumn(f"{c}_std", (filled(c) - stats.getField(f"m_{c}")) / F.when(sd > 0, sd).otherwise(F.lit(1.0)))
    return df


def scaled_array(df: DataFrame, columns: Sequence[str], group: str, train: Column) -> DataFrame:
    """ML6 for all groups (folds, variants) at once: adds the array ``x`` of the columns, nulls filled with the median of the group's training rows, centred and
    scaled by their mean and population deviation (0 -> 1). A column without a training value is 0."""
    fit = df.where(train)
    long = fit.unpivot([group], list(columns), "_c", "_v")
    med = P.quantiles(long.select(group, "_c", F.col("_v").cast("double").alias("_v")), "_v", (0.5,), [group, "_c"])
    med = med.groupBy(F.col(group).alias("_g")).agg(F.map_from_entries(F.collect_list(F.struct("_c", "quantile"))).alias("_med"))
    med = dictionary(med, "medians")
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.col("_med")[c], F.lit(0.0)) for c in columns])
    filled = lambda d: d.join(med, F.col(group) == F.col("_g"), "left").withColumn("_f", values).drop("_g", "_med")
    at = range(len(columns))
    moments = filled(fit).groupBy(F.col(group).alias("_g")).agg(
        F.array(*[F.avg(F.col("_f")[i]) for i in at]).alias("_m"), F.array(*[F.stddev_pop(F.col("_f")[i]) for i in at]).alias("_s")
    )
    out = filled(df).join(dictionary(moments, "moments"), F.col(group) == F.col("_g"), "left")
    scaled = lambda v, i: (v - F.col("_m")[i]) / F.when(F.col("_s")[i] > 0, F.col("_s")[i]).otherwise(F.lit(1.0))
    return out.withColumn("x", F.transform("_f", lambda v, i: F.coalesce(scaled(v, i), F.lit(0.0)))).drop("_f", "_g", "_m", "_s")


def window_metrics(
    entries: DataFrame, readings: DataFrame, transits: DataFrame, width: int, scale: TimeScale, entry_stage: int,
    stages: Sequence[int], min_parts: int = 20, t: str = "t",
) -> DataFrame:
    """AGG39: per dense window and stage, max and mean |z|, p90 transit, zero share and throughput.

    ``entries`` (stage, t): arrivals; ``readings`` (stage, t, abs_z); ``transits`` (stage, t, transit).  A window with
    fewer than ``min_parts`` arrivals at the entry stage is a gap and gets neutral values, as does an empty cell.
    """
    win = F.floor(F.col(t) / F.lit(width)).cast("long").alias("window_id")
    counts = entries.groupBy("stage", win).agg(F.count(F.lit(1)).alias("throughput"))
    zs = readings.groupBy("stage", win).agg(F.max("abs_z").alias("max_abs_z"), F.avg("abs_z").alias("mean_abs_z"))
    counted = transits.groupBy("stage", win, "transit").agg(F.count(F.lit(1)).alias("_n"))
    pace = counted.groupBy("stage", "window_id").agg(
        F.percentile("transit", F.lit(0.9), F.col("_n")).alias("p90_transit"),
        (F.sum(F.when(F.col("transit") <= 0.001, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("zero_delta_share"),
    )
    counts = materialize(counts, "window_counts")
    span = counts.agg(F.min("window_id").alias("_a"), F.max("window_id").alias("_b"))
    gates = counts.where(F.col("stage") == entry_stage).select("window_id", F.col("throughput").alias("part_count"))
    grid = (
        P.dense_grid(span, "_a", "_b", 1, "window_id").select("window_id")
        .join(gates, "window_id", "left")
        .withColumn("part_count", F.coalesce("part_count", F.lit(0)))
        .withColumn("is_gap", F.col("part_count") < min_parts)
        .withColumn("stage", F.explode(F.array(*[F.lit(s) for s in stages])))
    )
    keys = ["stage", "window_id"]
    joined = grid.join(counts, keys, "left").join(zs, keys, "left").join(pace, keys, "left")
    value = lambda c: F.when(F.col("is_gap"), F.lit(NEUTRAL[c])).otherwise(F.coalesce(F.col(c).cast("double"), F.lit(NEUTRAL[c])))
    start = F.col("window_id") * F.lit(width)
    return joined.select(
        "window_id", start.alias("t_start"), (start + width).alias("t_end"), scale.bucket(start).alias("week"), "part_count", "is_gap",
        "stage", *[F.round(value(c), 4).alias(c) for c in METRICS],
    )


def window_table(metrics: DataFrame, stages: Sequence[int]) -> DataFrame:
    """Wide window table: 6 base columns and 5 metrics per stage."""
    base = ["window_id", "t_start", "t_end", "week", "part_count", "is_gap"]
    cells = [F.max(F.when(F.col("stage") == s, F.col(m))).alias(f"S{s}_{m}") for s in stages for m in METRICS]
    return metrics.groupBy(*base).agg(*cells)


def window_vector(table: DataFrame, stages: Sequence[int]) -> DataFrame:
    """SHP5: the metric columns of a window as one array, stage by stage."""
    return table.withColumn("vec", F.array(*[F.col(f"S{s}_{m}") for s in stages for m in METRICS]))


def entry_histogram(entries: DataFrame, t: str, start: int, width: int, bins: int) -> DataFrame:
    """AGG40: counts per bin of [start, start + bins * width]; the last bin is closed on the right."""
    slot = F.least(F.floor((F.col(t) - start) / F.lit(width)), F.lit(bins - 1)).cast("int")
    inside = S.in_interval(F.col(t), F.lit(start), F.lit(start + bins * width))
    return entries.where(inside).groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def sequences(table: DataFrame, length: int, vec: str = "vec", block: int = 4096) -> DataFrame:
    """WIN11: vectors of ``length`` consecutive non-gap windows ending at each window, sliding by one.

    Runs are islands of window numbers; the frame is cut into blocks of consecutive windows, so a long history
    does not end up in one task.
    """
    runs = P.islands(table.where(~F.col("is_gap")), "window_id").withColumn("_rank", F.col("window_id"))
    low = P.total(runs, lo=F.min("window_id")).getField("lo")
    numbered = runs.withColumn("_rank", F.col("window_id") - low + 1)
    framed = P.trailing(
        numbered, "_rank", length,
        {
            "_vecs": lambda w: F.collect_list(F.struct("window_id", "island", vec)).over(w),
        },
        (), block,
    )
    same = F.filter("_vecs", lambda x: (x["island"] == F.col("island")) & (x["window_id"] > F.col("window_id") - length))
    return (
        framed.withColumn("_same", same)
        .where(F.size("_same") == length)
        .withColumn("sequence", F.transform("_same", lambda x: x[vec]))
        .drop("_vecs", "_same", "_rank")
    )
