"""Metrics for rare outcomes, computed for all (fold, model) keys at once.

Everything that needs an order works on the score curve: one row per (keys, distinct score) with running counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stageflow.operators import primitives as P
from stageflow.session import materialize

# 80 percentiles from 50 to 99.8 are tried as thresholds.
THRESHOLD_POINTS = tuple((50.0 + 49.8 * i / 79) / 100.0 for i in range(80))


@dataclass(frozen=True)
class Scored:
    """A scored table: key columns, row id, outcome and score."""

    df: DataFrame
    keys: tuple[str, ...]
    row: str
    label: str = "label"
    score: str = "score"


def curve(s: Scored) -> DataFrame:
    """Counts per distinct score, running from the highest score down."""
    neg = s.df.select(*s.keys, (-F.col(s.score)).alias("_neg"), F.col(s.label).cast("long").alias("_y"))
    run = P.running(
        neg, "_neg", {"n": ("sum", F.lit(1)), "pos": ("sum", F.col("_y"))}, s.keys, P.double_code(F.col("_neg")), levels=P.DOUBLE_LEVELS
    )
    return materialize(run.withColumn("score", -F.col("_neg")).drop("_neg"), "curve")


def totals(curve_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return curve_df.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum("pos").alias("positives"))


def roc_auc(curve_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MET1: rank-sum AUC with average ranks for tied scores; 0.5 if one class is missing."""
    t = totals(curve_df, keys)
    joined = curve_df.join(t, list(keys))
    mean_rank = F.col("total") - F.col("cum_n") + (F.col("n") + 1) / 2.0
    sums = joined.groupBy(*keys).agg(
        F.sum(F.col("pos") * mean_rank).alias("_r"), F.max("total").alias("_n"), F.max("positives").alias("_p")
    )
    p, q = F.col("_p"), F.col("_n") - F.col("_p")
    return sums.select(*keys, F.when((p > 0) & (q > 0), (F.col("_r") - p * (p + 1) / 2.0) / (p * q)).otherwise(0.5).alias("roc_auc"))


def average_precision(curve_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MET2: sum of precision times recall gain over distinct scores; 0 without positives."""
    gain = F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n"))
    p = F.sum("pos")
    return curve_df.groupBy(*keys).agg(F.when(p > 0, gain / p).otherwise(0.0).alias("pr_auc"))


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    den = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return F.when(den > 0, (tp * tn - fp * fn) / den).otherwise(0.0)


def mcc_at(s: Scored, threshold: Column) -> DataFrame:
    """MET3: Matthews correlation at a given threshold from four conditional counts."""
    y, hit = F.col(s.label) == 1, F.col(s.score) >= threshold
    counts = s.df.groupBy(*s.keys).agg(
        F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"), F.count_if(~y & ~hit).alias("tn")
    )
    return counts.withColumn("mcc", mcc(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def best_threshold(s: Scored, curve_df: DataFrame, points: Sequence[float] = THRESHOLD_POINTS) -> DataFrame:
    """MET4: the percentile threshold with the best MCC; the lowest one wins a tie.

    Each curve row is assigned to the number of thresholds it reaches, so a key ends with at most
    ``len(points) + 1`` partial counts, which are then accumulated.
    """
    keys = list(s.keys)
    whole = totals(curve_df, keys)
    rising = curve_df.join(whole, keys).select(
        *keys, "score", F.col("total").alias("_total"), (F.col("total") - F.col("cum_n")).alias("before_n"), (F.col("total") - F.col("before_n")).alias("cum_n")
    )
    ths = P.select_quantiles(rising, "score", points, keys).groupBy(*keys).agg(F.array_sort(F.collect_set("quantile")).alias("ths"))
    reach = F.size(F.filter("ths", lambda t: t <= F.col("score"))).alias("_k")
    parts = curve_df.join(ths, keys).groupBy(*keys, reach).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.first("ths").alias("ths"))
    down = Window.partitionBy(*keys).orderBy(F.desc("_k"))
    grid = (
        ths.select(*keys, F.posexplode("ths").alias("_i", "threshold"))
        .withColumn("_k", F.col("_i") + 1)
        .join(parts.select(*keys, "_k", "n", "pos"), [*keys, "_k"], "left")
        .fillna(0, ["n", "pos"])
        .withColumn("_hit", F.sum("n").over(down))
        .withColumn("_tp", F.sum("pos").over(down))
        .join(whole, keys)
    )
    tp, fp = F.col("_tp"), F.col("_hit") - F.col("_tp")
    fn = F.col("positives") - tp
    tn = F.col("total") - F.col("_hit") - fn
    scored = grid.withColumn("_m", F.round(mcc(tp, fp, fn, tn), 12))
    best = F.max(F.struct(F.col("_m"), (-F.col("threshold")).alias("_t")))
    return scored.groupBy(*keys).agg(best.alias("_b")).select(*keys, (-F.col("_b._t")).alias("threshold"), F.col("_b._m").alias("mcc"))


def recall_at(s: Scored, curve_df: DataFrame, share: float, name: str) -> DataFrame:
    """MET5: share of positives among the top ceil(share * n) rows, ties cut by row id.

    Only the rows tied at the cut are ordered; everything above comes from the curve.
    """
    keys = list(s.keys)
    m = F.ceil(F.col("total") * share)
    cut = curve_df.join(totals(curve_df, keys), keys).where((F.col("before_n") < m) & (F.col("cum_n") >= m)).select(
        *keys, F.col("score").alias("_s"), (m - F.col("before_n")).alias("_need"), F.col("before_pos").alias("_above"), "positives"
    )
    tied = s.df.join(cut, [s.df[k] == cut[k] for k in keys] + [s.df[s.score] == cut["_s"]]).select(
        *[cut[k] for k in keys], F.col(s.row).alias("_id"), F.col(s.label).cast("long").alias("_y")
    )
    ordered = P.running(tied, "_id", {"c": ("sum", F.lit(1)), "y": ("sum", F.col("_y"))}, keys, levels=2)
    taken = ordered.select(*keys, "cum_c", "y").join(cut, keys).where(F.col("cum_c") <= F.col("_need"))
    return taken.groupBy(*keys).agg(
        F.when(F.max("positives") > 0, (F.max("_above") + F.sum("y")) / F.max("positives")).otherwise(0.0).alias(name)
    )


def brier(s: Scored) -> DataFrame:
    """MET6."""
    return s.df.groupBy(*s.keys).agg(F.avg(F.pow(F.col(s.label) - F.col(s.score), 2)).alias("brier"))


def metric_table(s: Scored) -> DataFrame:
    """MET7: all metrics per key, rounded as in a report."""
    keys = list(s.keys)
    s = replace(s, df=materialize(s.df, "scored"))
    c = curve(s)
    r1 = recall_at(s, c, 0.01, "recall_at_1pct")
    out = roc_auc(c, keys).join(average_precision(c, keys), keys).join(best_threshold(s, c), keys)
    out = out.join(r1, keys).join(recall_at(s, c, 0.05, "recall_at_5pct"), keys).join(brier(s), keys)
    return out.select(
        *keys,
        F.round("pr_auc", 5).alias("pr_auc"), F.round("roc_auc", 5).alias("roc_auc"), F.round("mcc", 5).alias("mcc"),
        F.round("threshold", 5).alias("optimal_threshold"), F.round("recall_at_1pct", 5).alias("recall_at_1pct"),
        F.round("recall_at_5pct", 5).alias("recall_at_5pct"), F.round(F.col("recall_at_1pct") / 0.01, 2).alias("lift_at_1pct"),
        F.round("brier", 6).alias("brier_score"),
    )


def alarm_lead(flags: DataFrame, surges: Sequence[tuple[str, int, int]], t: str, look_back: int, flagged: str = "is_anomaly") -> DataFrame:
    """MET8: time from the first alarm in the look-back range of a surge to its start, per scenario; computed."""
    starts = F.array(*[
        F.struct(F.lit(n).alias("scenario"), F.lit(a).cast("long").alias("surge_start"), F.lit(b).cast("long").alias("surge_end")) for n, a, b in surges
    ])
    near = F.filter(starts, lambda s: (F.col(t) >= s["surge_start"] - look_back) & (F.col(t) <= s["surge_end"]))
    return (
        flags.select(t, flagged, F.inline(near))
        .groupBy("scenario", "surge_start")
        .agg(F.min(F.when(F.col(flagged), F.col(t))).alias("first_alarm"), F.count_if(flagged).alias("alarms"), F.count(F.lit(1)).alias("windows"))
        .withColumn("lead", F.col("surge_start") - F.col("first_alarm"))
    )
