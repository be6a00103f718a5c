"""Time-based splits as long tables (fold, role, row)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stageflow.operators import primitives as P


def forward_chaining(df: DataFrame, week: str, folds: Sequence[tuple[int, tuple[int, int], tuple[int, int]]]) -> DataFrame:
    """ML3: folds (number, train weeks, validation weeks), ranges inclusive."""
    ranges = F.array(*[
        F.struct(F.lit(k).alias("fold"), F.lit(role).alias("role"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
        for k, train, val in folds
        for role, (lo, hi) in (("train", train), ("val", val))
    ])
    mine = F.filter(ranges, lambda r: (F.col(week) >= r["lo"]) & (F.col(week) <= r["hi"]))
    return df.select("*", F.inline(F.transform(mine, lambda r: F.struct(r["fold"].alias("fold"), r["role"].alias("role")))))


def leave_window_out(df: DataFrame, t: str, windows: Sequence[tuple[str, int, int]], margin: int) -> DataFrame:
    """ML4: per window, rows inside are the test set, rows outside the widened window are the training set."""

    def one(name: str, a: int, b: int):
        inside = (F.col(t) >= a) & (F.col(t) <= b)
        outside = (F.col(t) < a - margin) | (F.col(t) > b + margin)
        role = F.when(inside, "test").when(outside, "train")
        return F.struct(F.lit(name).alias("fold"), role.alias("role"))

    roles = F.filter(F.array(*[one(*w) for w in windows]), lambda r: r["role"].isNotNull())
    return df.select("*", F.inline(roles))


def chronological(df: DataFrame, t: str, tie: str, share: float = 0.8, **kw) -> DataFrame:
    """ML5: the first ``share`` of the rows in time order are for training, the rest for validation."""
    n = P.total(df, n=F.count(F.lit(1))).getField("n")
    ranked = P.ranked(df, t, tie, name="_rank", **kw)
    return ranked.withColumn("role", F.when(F.col("_rank") <= F.floor(n * share), "train").otherwise("val")).drop("_rank")


def time_ranges(df: DataFrame, t: str, tie: str, cuts: Sequence[tuple[str, float]], rest: str, **kw) -> DataFrame:
    """Disjoint consecutive ranges in time order: each (role, share) takes the rows up to its share, ``rest`` the others."""
    n = P.total(df, n=F.count(F.lit(1))).getField("n")
    ranked = P.ranked(df, t, tie, name="_rank", **kw)
    role = F.lit(rest)
    for name, share in reversed(list(cuts)):
        role = F.when(F.col("_rank") <= F.floor(n * share), name).otherwise(role)
    return ranked.withColumn("role", role).drop("_rank")


def keep_positives(df: DataFrame, label: str, key: str, size: int, floor: int = 1000, seed: int = 42) -> DataFrame:
    """ML2: all positives and max(floor, size - positives) negatives, chosen by the hash of their key.

    The choice depends on the key and the seed only, not on the partitioning.
    """
    positives = P.total(df, n=F.count_if(F.col(label) == 1)).getField("n")
    quota = F.greatest(F.lit(floor), F.lit(size) - positives)
    hashed = df.where(F.col(label) == 0).withColumn("_h", F.shiftright(F.xxhash64(F.col(key), F.lit(seed)), 24))
    ranked = P.ranked(hashed, "_h", key, name="_rank", levels=P.DOUBLE_LEVELS)
    return df.where(F.col(label) == 1).unionByName(ranked.where(F.col("_rank") <= quota).drop("_h", "_rank"))
