"""Joins that need more than an equi-join: as-of, range counts, sliding grids, interval masks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stageflow.operators import primitives as P
from stageflow.session import dictionary


def lookup_with_default(df: DataFrame, table: DataFrame, on: Sequence[str], defaults: Mapping[str, float]) -> DataFrame:
    """JN5: left join to a dictionary of checked size, missing entries filled."""
    out = df.join(dictionary(table), list(on), "left")
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out


def full_by_period(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """JN7: full outer join with empty cells 0."""
    return left.join(right, on, "full").fillna(0)


def range_count(
    probes: DataFrame, events: DataFrame, t: str, back: int, name: str, probe_t: str, keys: Sequence[str] = (), **kw
) -> DataFrame:
    """JN8: number of events in the closed tick range [t - back, t] for every probe row.

    Two as-of reads of one running count replace the range join.
    """
    keys = list(keys)
    edges = probes.select(*keys, F.explode(F.array(F.col(probe_t), F.col(probe_t) - (back + 1))).alias("_at"))
    counted = P.cumulative_at(
        events.withColumnRenamed(t, "_at"), "_at", {"k": F.lit(1)}, edges, keys, **kw
    )
    hi = counted.select(*keys, F.col("_at").alias(probe_t), F.col("cum_k").alias("_hi"))
    lo = counted.select(*keys, (F.col("_at") + (back + 1)).alias(probe_t), F.col("cum_k").alias("_lo"))
    both = hi.join(lo, [*keys, probe_t]).select(*keys, probe_t, (F.col("_hi") - F.col("_lo")).alias(name))
    return probes.join(both, [*keys, probe_t], "left")


def recent_rate(
    probes: DataFrame, outcomes: DataFrame, probe_t: str, t: str, tie: str, label: str, last: int, default: float,
    name: str = "recent_rate", **kw,
) -> DataFrame:
    """JN9: mean of the last ``last`` outcomes with time <= the probe time, ``default`` before the first one.

    Outcomes are ordered by (t, tie).  With k outcomes known, the sum is C(k) - C(k - last), where C is the
    running label count; both come from equi-joins on the outcome number.
    """
    ordered = P.running_rows(
        outcomes.select(t, tie, label), t, tie, {"k": F.lit(1), "c": F.col(label)}, **kw
    ).select(F.col("cum_k").alias("_k"), F.col("cum_c").alias("_c0"))
    known = P.cumulative_at(
        outcomes.withColumnRenamed(t, "_at"), "_at", {"k": F.lit(1), "c": F.col(label)},
        probes.select(F.col(probe_t).alias("_at")), **kw,
    )
    rate = (
        known.withColumn("_k", F.col("cum_k") - last)
        .join(ordered, "_k", "left")
        .select(
            F.col("_at").alias(probe_t),
            F.when(
                F.col("cum_k") > 0,
                (F.col("cum_c") - F.coalesce("_c0", F.lit(0))) / F.least(F.col("cum_k"), F.lit(last)),
            ).otherwise(F.lit(default)).alias(name),
        )
    )
    return probes.join(rate, probe_t)


def sliding_grid(
    values: DataFrame, bounds: DataFrame, keys: Sequence[str], t: str, widths: Sequence[tuple[str, int]], step: int,
    aggs: Mapping[str, Column],
) -> DataFrame:
    """JN10: aggregates over windows [g, g + width) for g on a grid from each key's first time.

    ``values`` should already be collapsed per (keys, t); ``bounds`` has (keys, t_min, t_max) and ``widths``
    lists (window, width).  A value is copied to the ceil(width / step) windows that hold it, and partial sums
    are combined before the shuffle.
    """
    sizes = F.array(*[F.struct(F.lit(n).alias("window"), F.lit(w).cast("long").alias("width")) for n, w in widths])
    with_bounds = values.join(bounds, list(keys)).select("*", F.inline(sizes))
    offset = F.col(t) - F.col("t_min")
    last = F.ceil((F.col("t_max") - F.col("width") - F.col("t_min")) / F.lit(step)).cast("long") - 1
    first_slot = F.greatest(F.lit(0).cast("long"), F.floor((offset - F.col("width")) / F.lit(step)).cast("long") + 1)
    last_slot = F.least(last, F.floor(offset / F.lit(step)).cast("long"))
    slots = with_bounds.withColumn("_lo", first_slot).withColumn("_hi", last_slot).where(F.col("_lo") <= F.col("_hi"))
    exploded = slots.withColumn("slot", F.explode(F.sequence("_lo", "_hi")))
    return (
        exploded.groupBy(*keys, "window", "width", "slot")
        .agg(F.min("t_min").alias("_t0"), *[expr.alias(n) for n, expr in aggs.items()])
        .withColumn("t_start", F.col("_t0") + F.col("slot") * F.lit(step))
        .withColumn("t_end", F.col("t_start") + F.col("width"))
        .drop("_t0", "slot")
    )


def interval_array(intervals: Sequence[tuple[str, int, int]], margin: int = 0) -> Column:
    """Configured intervals (name, start, stop) as an array of structs, optionally widened."""
    return F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(a - margin).cast("long").alias("t_start"), F.lit(b + margin).cast("long").alias("t_end"))
        for n, a, b in intervals
    ])


def in_intervals(df: DataFrame, t: str, intervals: Sequence[tuple[str, int, int]], margin: int = 0) -> DataFrame:
    """One row per configured closed interval that holds the row's time; a projection, not a join."""
    hits = F.filter(interval_array(intervals, margin), lambda i: (F.col(t) >= i["t_start"]) & (F.col(t) <= i["t_end"]))
    return df.select("*", F.inline(hits))


def outside_intervals(df: DataFrame, t: str, intervals: Sequence[tuple[str, int, int]], margin: int = 0) -> DataFrame:
    """JN11 / ML15: rows whose time lies in none of the configured intervals widened by ``margin``."""
    hit = F.exists(interval_array(intervals, margin), lambda i: (F.col(t) >= i["t_start"]) & (F.col(t) <= i["t_end"]))
    return df.where(~hit)


def outside_interval_table(
    df: DataFrame, intervals: DataFrame, t: str, start: str = "t_start", stop: str = "t_end", margin: int = 0, slot: int = 4096
) -> DataFrame:
    """JN11 for an interval table of any size: intervals are cut into time slots and anti-joined on the slot."""
    cuts = lambda c: P.cut(c, slot)
    wide = intervals.select((F.col(start) - margin).alias("_a"), (F.col(stop) + margin).alias("_b"))
    slotted = wide.withColumn("_s", F.explode(F.sequence(cuts(F.col("_a")), cuts(F.col("_b"))))).alias("i")
    left = df.withColumn("_s", cuts(F.col(t))).alias("d")
    inside = (F.col(f"d.{t}") >= F.col("i._a")) & (F.col(f"d.{t}") <= F.col("i._b"))
    return left.join(slotted, (F.col("d._s") == F.col("i._s")) & inside, "left_anti").drop("_s")


def predecessor(messages: DataFrame, topology: DataFrame, stage: str = "stage", previous: str = "prev_stage") -> DataFrame:
    """JN13: previous stage of the entity, else the static predecessor of the stage, else none."""
    return messages.join(dictionary(topology, "topology"), stage, "left").withColumn("incoming", F.coalesce(F.col(previous), F.col("static_prev"))).drop("static_prev")
