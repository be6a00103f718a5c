"""Classifiers, calibration, importance, and the sequence anomaly model on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stageflow.functions import scalar as S
from stageflow.operators import metrics as M
from stageflow.operators import primitives as P
from stageflow.session import dictionary, materialize

DEFAULT_PROB = 0.005069


def class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight negatives / positives on positive rows, 1 on the others."""
    t = P.total(df, p=F.count_if(F.col(label) == 1), n=F.count_if(F.col(label) == 0))
    w = F.when(t.getField("p") > 0, t.getField("n") / t.getField("p")).otherwise(F.lit(1.0))
    return df.withColumn("weight", F.when(F.col(label) == 1, w).otherwise(F.lit(1.0)))


def assembler(columns: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep")


def prevalence_score(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """ML7: every row gets the training prevalence."""
    return test.withColumn("score", P.total(train, p=F.avg(label)).getField("p"))


def column_score(test: DataFrame, column: str) -> DataFrame:
    """ML8: a single feature as score."""
    return test.withColumn("score", F.col(column).cast("double"))


def fit_logistic(train: DataFrame, columns: Sequence[str], label: str = "label", reg: float = 1e-3, iterations: int = 50) -> PipelineModel:
    """ML9: class-weighted logistic regression."""
    lr = LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", regParam=reg, maxIter=iterations)
    return Pipeline(stages=[assembler(columns), lr]).fit(class_weight(train, label))


def fit_boosted(train: DataFrame, columns: Sequence[str], label: str = "label", rounds: int = 10, depth: int = 3, seed: int = 42) -> PipelineModel:
    """ML10: class-weighted gradient-boosted trees."""
    gbt = GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxIter=rounds, maxDepth=depth, seed=seed)
    return Pipeline(stages=[assembler(columns), gbt]).fit(class_weight(train, label))


def probability(model: PipelineModel, df: DataFrame) -> DataFrame:
    out = model.transform(df).withColumn("raw_prob", vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "probability", "prediction")


def fit_platt(scored: DataFrame, label: str = "label") -> tuple[float, float]:
    """ML11: slope and intercept of an unregularised logistic regression on the logit of the raw probability."""
    x = scored.select(F.col(label).cast("double").alias("label"), S.logit(F.col("raw_prob")).alias("x"))
    lr = LogisticRegression(featuresCol="features", labelCol="label", regParam=0.0, maxIter=50)
    model = Pipeline(stages=[assembler(["x"]), lr]).fit(x).stages[1]
    return float(model.coefficients[0]), float(model.intercept)


def calibrated(prob: Column, slope: float, intercept: float) -> Column:
    return S.sigmoid(S.logit(prob) * F.lit(slope) + F.lit(intercept))


def score_table(model: PipelineModel | None, df: DataFrame, platt: tuple[float, float] | None = None) -> DataFrame:
    """ML12 / STR9: score a table or a stream; without a model every row gets the default probability."""
    if model is None:
        return df.withColumn("score", F.lit(DEFAULT_PROB))
    out = probability(model, df)
    p = calibrated(F.col("raw_prob"), *platt) if platt else F.col("raw_prob")
    return out.withColumn("score", F.round(p, 5))


def ablation(train: DataFrame, test: DataFrame, columns: Sequence[str], drop: Sequence[str], row: str, fit=fit_logistic) -> DataFrame:
    """ML13: metrics with all columns and without one of them at a time."""
    out = None
    for name in [None, *drop]:
        used = [c for c in columns if c != name]
        scored = score_table(fit(train, used), test).select(F.lit(name or "none").alias("dropped"), row, "label", "score")
        out = scored if out is None else out.unionByName(scored)
    return M.metric_table(M.Scored(materialize(out, "ablation"), ("dropped",), row))


def permuted(df: DataFrame, columns: Sequence[str], row: str, seed: int) -> DataFrame:
    """Adds ``_p_<column>``: the row ranked k by id receives the values of the row ranked k by a hash of its id.  One pair of ranks serves all columns."""
    hashed = df.select(row, *[F.col(c).alias(f"_p_{c}") for c in columns]).withColumn("_h", F.shiftright(F.xxhash64(F.col(row), F.lit(seed)), 24))
    by_id = P.ranked(df.withColumn("_o", F.col(row)), "_o", row, name="_k", levels=2).drop("_o")
    by_hash = P.ranked(hashed, "_h", row, name="_k", levels=P.DOUBLE_LEVELS).select("_k", *[f"_p_{c}" for c in columns])
    return by_id.join(by_hash, "_k").drop("_k")


def permutation_importance(
    model: PipelineModel, test: DataFrame, columns: Sequence[str], row: str, platt: tuple[float, float] | None = None, repeats: int = 3, seed: int = 42
) -> DataFrame:
    """ML14: mean and deviation of the average-precision drop when a column is shuffled, on calibrated scores."""
    keep = lambda df, rep: df.select("feature", F.lit(rep).alias("rep"), row, "label", "score")
    out = keep(score_table(model, test, platt).withColumn("feature", F.lit("none")), 0)
    for r in range(repeats):
        shuffled = materialize(permuted(test, columns, row, seed + r), "shuffled")
        each = shuffled.withColumn("feature", F.explode(F.array(*[F.lit(c) for c in columns])))
        swapped = each.select(row, "label", "feature", *[F.when(F.col("feature") == c, F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) for c in columns])
        out = out.unionByName(keep(score_table(model, swapped, platt), r))
    table = materialize(out, "permuted")
    ap = M.average_precision(M.curve(M.Scored(table, ("feature", "rep"), row)), ("feature", "rep"))
    base = P.total(ap.where("feature = 'none'"), b=F.max("pr_auc")).getField("b")
    return ap.where("feature <> 'none'").groupBy("feature").agg(
        F.avg(base - F.col("pr_auc")).alias("mean_drop"), F.stddev_pop(base - F.col("pr_auc")).alias("std_drop")
    )


def fit_sequence_model(train: DataFrame, k: int = 8, seq: str = "sequence") -> PipelineModel:
    """ML16: standardise the flattened sequence and keep its first k principal components."""
    flat = train.select(array_to_vector(F.flatten(seq)).alias("flat"))
    scaler = StandardScaler(inputCol="flat", outputCol="z", withMean=True, withStd=True)
    return Pipeline(stages=[scaler, PCA(k=k, inputCol="z", outputCol="pcs")]).fit(flat)


def reconstruct(model: PipelineModel, df: DataFrame, dims: int, seq: str = "sequence") -> DataFrame:
    """Standardised latest step and its reconstruction from the components, as arrays of ``dims`` values."""
    scaled = model.transform(df.withColumn("flat", array_to_vector(F.flatten(seq))))
    basis = model.stages[-1].pc.toArray()[-dims:, :]
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in basis])
    pcs = vector_to_array("pcs")
    dot = lambda r: F.aggregate(F.zip_with(r, F.col("_pcs"), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return (
        scaled.withColumn("_pcs", pcs)
        .withColumn("actual", F.slice(vector_to_array("z"), -dims, dims))
        .withColumn("rebuilt", F.transform(rows, dot))
        .drop("flat", "z", "pcs", "_pcs")
    )


def anomaly_score(df: DataFrame, stages: Sequence[int], metrics: int, actual: str = "actual", rebuilt: str = "rebuilt") -> DataFrame:
    """ML18 (without the flag): mean squared error of the latest step and every stage's share of it."""
    err = F.zip_with(actual, rebuilt, lambda a, b: (a - b) * (a - b))
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    out = df.withColumn("_e", err).withColumn("_sum", add(F.col("_e")))
    shares = [
        F.when(F.col("_sum") > 0, add(F.slice("_e", i * metrics + 1, metrics)) / F.col("_sum")).otherwise(0.0) for i in range(len(stages))
    ]
    parts = F.map_from_arrays(F.array(*[F.lit(f"S{s}") for s in stages]), F.array(*shares))
    return out.withColumn("anomaly_score", F.col("_sum") / F.size("_e")).withColumn("contributions", parts).drop("_e", "_sum")


def error_threshold(scored: DataFrame, point: float = 0.99, score: str = "anomaly_score") -> DataFrame:
    """ML17: the p99 of the validation errors."""
    return P.quantiles(scored, score, (point,)).select(F.col("quantile").alias("threshold"))


def flag(scored: DataFrame, threshold: Column, score: str = "anomaly_score") -> DataFrame:
    return scored.withColumn("threshold_p99", threshold).withColumn("is_anomaly", F.col(score) >= threshold)


def lookup_variant(registry: DataFrame, scenario: Column, df: DataFrame) -> DataFrame:
    """Registry lookup with the general model as fallback."""
    names = registry.select(F.col("variant").alias("_v"))
    return df.withColumn("_s", scenario).join(dictionary(names, "variants"), F.col("_s") == F.col("_v"), "left").withColumn(
        "variant", F.coalesce("_v", F.lit("general"))
    ).drop("_s", "_v")
