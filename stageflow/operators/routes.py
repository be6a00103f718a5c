"""Routes: ordered stage lists per entity and their ranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stageflow.functions import scalar as S
from stageflow.operators import primitives as P


def build_routes(visits: DataFrame, entity: str = "entity", stage: str = "stage", t: str = "entry", line: str = "line") -> DataFrame:
    """AGG8-9: route in (time, stage) order, its length and its distinct lines.

    The collected list is bounded by the number of stages: a visit table has one row per (entity, stage).
    """
    return (
        visits.groupBy(entity)
        .agg(
            F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(stage).alias("s")))).alias("_steps"),
            F.array_sort(F.collect_set(line)).alias("_lines"),
        )
        .select(
            entity,
            F.array_join(F.transform("_steps", lambda x: F.concat(F.lit("S"), x["s"].cast("string"))), "->").alias("route"),
            F.size("_steps").alias("num_stages"),
            F.array_join(F.transform("_lines", lambda x: F.concat(F.lit("L"), x.cast("string"))), "->").alias("line_sequence"),
        )
    )


def rank_routes(routes: DataFrame, label: str = "label", by: str = "route") -> DataFrame:
    """AGG10-11: count, length, failures, failure rate and share of volume per route or line sequence."""
    per = routes.groupBy(by).agg(
        F.count(F.lit(1)).alias("entities"),
        F.min("num_stages").alias("num_stages"),
        F.sum(label).cast("long").alias("defects"),
        F.avg(label).alias("defect_rate"),
    )
    whole = P.total(per, n=F.sum("entities"))
    return per.withColumn("volume_pct", F.col("entities") * 100.0 / whole.getField("n"))


def route_lengths(routes: DataFrame) -> DataFrame:
    """AGG12."""
    return routes.groupBy("num_stages").agg(F.count(F.lit(1)).alias("entities"))


def pattern_coverage(
    routes: DataFrame, patterns: Mapping[str, Sequence[str]], label: str = "label", route: str = "route"
) -> DataFrame:
    """AGG13: coverage of each pattern set (a set matches if any of its sub-paths occurs), in one pass."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for name, paths in patterns.items():
        hit = F.lit(False)
        for p in paths:
            hit = hit | S.contains_path(F.col(route), p)
        aggs += [F.count_if(hit).alias(f"{name}_n"), F.sum(F.when(hit, F.col(label)).otherwise(0)).alias(f"{name}_d")]
    one = routes.agg(*aggs)
    stack = F.explode(
        F.array(*[
            F.struct(F.lit(n).alias("pattern"), F.col(f"{n}_n").alias("entities"), F.col(f"{n}_d").cast("long").alias("defects"))
            for n in patterns
        ])
    )
    return one.select("_n", stack.alias("p")).select(
        "p.pattern",
        "p.entities",
        "p.defects",
        (F.col("p.entities") * 100.0 / F.col("_n")).alias("share_pct"),
        S.ratio(F.col("p.defects"), F.col("p.entities")).alias("defect_rate"),
    )
