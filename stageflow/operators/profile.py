"""Column and feature profiles of wide and long sensor tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stageflow.functions import scalar as S
from stageflow.operators import primitives as P


def column_profile(wide: DataFrame, columns: Sequence[str], source: str) -> DataFrame:
    """AGG1: rows, non-null and missing counts and missing rate of every column, in one pass."""
    one = wide.agg(F.count(F.lit(1)).alias("total_rows"), *[F.count(c).alias(c) for c in columns])
    long = one.unpivot(["total_rows"], list(columns), "col_name", "non_null")
    meta = S.parse_column(F.col("col_name"))
    return long.select(
        F.lit(source).alias("source"),
        "col_name",
        "total_rows",
        "non_null",
        (F.col("total_rows") - F.col("non_null")).alias("missing"),
        ((F.col("total_rows") - F.col("non_null")) / F.col("total_rows")).alias("missing_rate"),
        *[expr.alias(n) for n, expr in meta.items()],
    )


def by_type(profile: DataFrame) -> DataFrame:
    """AGG2."""
    return profile.groupBy("source", "kind").agg(
        F.count(F.lit(1)).alias("columns"), F.avg("missing_rate").alias("mean_missing_rate")
    )


def stage_missingness(profile: DataFrame) -> DataFrame:
    """AGG3: column counts per kind, filled cells, coverage and cell missing rate per stage."""
    return (
        profile.where(F.col("station").isNotNull())
        .groupBy("line", "station")
        .agg(
            F.count_if(F.col("kind") == "Feature").alias("feature_cols"),
            F.count_if(F.col("kind") == "Date").alias("date_cols"),
            F.sum("non_null").alias("filled"),
            F.sum("total_rows").alias("cells"),
            F.max("non_null").alias("max_non_null"),
            F.avg("non_null").alias("mean_non_null"),
            F.max("total_rows").alias("_rows"),
        )
        .select(
            "line", "station", "feature_cols", "date_cols", "filled", "max_non_null", "mean_non_null",
            (F.lit(1.0) - F.col("filled") / F.col("cells")).alias("cell_missing_rate"),
            (F.col("max_non_null") * 100.0 / F.col("_rows")).alias("coverage_pct"),
        )
    )


def functional_dependency(df: DataFrame, key: str, value: str) -> DataFrame:
    """AGG4: distinct values per key and whether the dependency key -> value is violated."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n_values")).withColumn("violated", F.col("n_values") > 1)


def feature_profile(values: DataFrame, totals: DataFrame, keys: Sequence[str], approx: bool = False) -> DataFrame:
    """AGG29: count, missing share, moments, range and distinct values per feature.

    ``values`` is the long reading table, ``totals`` gives ``total`` rows per stage.  The distinct count is
    exact by default; ``approx`` trades it for a sketch on continuous readings of huge tables.
    """
    distinct = F.approx_count_distinct("value") if approx else F.count_distinct("value")
    stats = values.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.var_samp("value").alias("variance"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        distinct.alias("n_distinct"),
    )
    return stats.join(totals, keys[0]).withColumn(
        "missing_pct", (F.col("total") - F.col("n")) * 100.0 / F.col("total")
    ).drop("total")


def informative(profile: DataFrame, min_std: float = 0.01, min_distinct: int = 10) -> DataFrame:
    return profile.where((F.col("std") >= min_std) & (F.col("n_distinct") >= min_distinct))


def best_feature(profile: DataFrame, stage: str, feature: str) -> DataFrame:
    """AGG28: the feature with most readings per stage among those that vary (profile rows only)."""
    w = Window.partitionBy(stage).orderBy(F.desc("n"), feature)
    return profile.where(F.col("variance") > 0).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def top_features(profile: DataFrame, limits: DataFrame, stage: str, feature: str, limit: str = "keep") -> DataFrame:
    """SRT3: the ``keep`` best covered features of each stage; stages without a limit keep all."""
    w = Window.partitionBy(stage).orderBy(F.desc("n"), feature)
    ranked = profile.withColumn("k", F.row_number().over(w)).join(limits, stage, "left")
    return ranked.where(F.col(limit).isNull() | (F.col("k") <= F.col(limit))).drop(limit)


def baselines(values: DataFrame, keys: Sequence[str], floor: float = 0.01) -> DataFrame:
    """SRC7: mean and sample deviation per feature; a deviation that is not positive becomes ``floor``."""
    return values.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")).withColumn(
        "std", F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(floor))
    )


def medians(values: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """AGG42: exact median per feature by rank selection, so continuous readings never meet in one task."""
    return P.quantiles(values, value, (0.5,), keys).select(*keys, F.col("quantile").alias("median"))


def header_check(tables: dict[str, tuple[DataFrame, bool]], label: str) -> DataFrame:
    """SRC11: the label column must be present in some tables and absent from the others; counts its nulls."""
    out = None
    for name, (df, wanted) in tables.items():
        present = label in df.columns
        nulls = F.count_if(F.col(label).isNull()) if present else F.lit(None).cast("long")
        row = df.agg(F.count(F.lit(1)).alias("rows"), nulls.alias("null_labels")).select(
            F.lit(name).alias("table_name"), F.lit(wanted).alias("label_expected"), F.lit(present).alias("label_present"),
            F.lit(wanted == present).alias("ok"), F.lit(len(df.columns)).alias("columns"), "rows", "null_labels",
        )
        out = row if out is None else out.unionByName(row)
    return out


def total_rows(visits: DataFrame, stage: str) -> DataFrame:
    return visits.groupBy(stage).agg(F.count(F.lit(1)).alias("total"))


