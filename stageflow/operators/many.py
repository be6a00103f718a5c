"""Many weighted logistic regressions in one pass over the rows an iteration.

Rows belong to a group (a fold, a scenario variant); a group has one model for every variant of left-out columns. Newton steps of all models
are taken together: a task adds up gradient and second moments of every model over its rows, the sums meet in ``SLOTS`` places a model, and the driver
solves one small system a model. What comes to the driver is groups x variants x ``SLOTS`` matrices of the number of columns squared.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stageflow.functions import scalar as S
from stageflow.operators import metrics as M
from stageflow.session import dictionary, materialize

SLOTS = 8
#: Longest step of a coefficient in one iteration.
STEP = 2.0
ALL: Mapping[str, Sequence[int]] = {"all": ()}


def _chances(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x @ beta.T, -500, 500)))


def _sums(train: DataFrame, group: str, betas: dict, weights: dict) -> dict:
    """(group, variant) -> (second moments, gradient) of the weighted log loss at ``betas``."""
    shared = train.sparkSession.sparkContext.broadcast((betas, weights))

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        betas, weights = shared.value
        held: dict = {}
        for frame in frames:
            for g, part in frame.groupby(group):
                x = np.column_stack([np.ones(len(part)), np.stack(part.x)])
                y = part.label.to_numpy(float)
                w = np.where(y == 1, weights[g], 1.0)
                chance = _chances(x, betas[g])
                for v in range(chance.shape[1]):
                    p = chance[:, v]
                    moments, gradient = (x * (w * p * (1 - p))[:, None]).T @ x, x.T @ (w * (p - y))
                    if (g, v) in held:
                        moments, gradient = moments + held[g, v][0], gradient + held[g, v][1]
                    held[g, v] = moments, gradient
        slot = TaskContext.get().partitionId() % SLOTS
        yield pd.DataFrame([(g, v, slot, np.vstack([h, d]).tobytes()) for (g, v), (h, d) in held.items()], columns=[group, "v", "slot", "sums"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(s) for s in frame.sums)
        return frame.iloc[:1].assign(sums=[total.tobytes()])

    schema = f"{group} {train.schema[group].dataType.simpleString()}, v int, slot int, sums binary"
    out: dict = {}
    for r in train.select(group, "x", "label").mapInPandas(partial, schema).groupBy(group, "v", "slot").applyInPandas(add, schema).collect():
        width = betas[r[group]].shape[1]
        out[r[group], r.v] = out.get((r[group], r.v), 0) + np.frombuffer(r.sums).reshape(width + 1, width)
    return {k: (s[:-1], s[-1]) for k, s in out.items()}


def fit_many(train: DataFrame, group: str, variants: Mapping[str, Sequence[int]] = ALL, reg: float = 1e-3, weighted: bool = True, iterations: int = 40, tol: float = 1e-9) -> DataFrame:
    """One model for each group of ``train`` (group, x, label) and each variant: (group, variant, beta, gradient, n, positives).

    Minimised is the mean log loss, positives weighted by negatives / positives if ``weighted``, plus ``reg`` / 2 times the squares of the
    coefficients. ``beta`` has the intercept first, which has no penalty unless a group has one outcome only; left-out columns are 0. ``gradient`` is the
    largest partial derivative there. Rows without an outcome or with a null group aren't used; an empty table gives no models.
    """
    spark = train.sparkSession
    schema = f"{group} {train.schema[group].dataType.simpleString()}, variant string, beta array<double>, gradient double, n long, positives long"
    rows = materialize(train.where(F.col(group).isNotNull() & F.col("label").isNotNull()).select(group, "x", F.col("label").cast("int").alias("label")), "many")
    counts = {r[group]: r for r in rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("p"), F.max(F.size("x")).alias("d")).collect()}
    weight = {g: (r.n - r.p) / r.p if weighted and 0 < r.p < r.n else 1.0 for g, r in counts.items()}
    total = {g: r.n - r.p + r.p * weight[g] for g, r in counts.items()}
    betas = {g: np.zeros((len(variants), r.d + 1)) for g, r in counts.items()}
    largest: dict = {}
    for step in range(iterations if counts else 0):
        for (g, v), (moments, gradient) in _sums(rows, group, betas, weight).items():
            beta, r = betas[g][v], counts[g]
            penalty = np.full(len(beta), reg)
            penalty[0] = 0.0 if 0 < r.p < r.n else max(reg, 1e-6)
            slope, curve = gradient / total[g] + penalty * beta, moments / total[g] + np.diag(penalty + 1e-12)
            out = np.array(list(variants.values())[v], int) + 1
            slope[out], curve[out], curve[:, out] = 0.0, 0.0, 0.0
            curve[out, out] = 1.0
            largest[g, v] = float(np.abs(slope).max())
            if largest[g, v] > tol and step < iterations - 1:
                move = np.linalg.solve(curve, slope)
                betas[g][v] = beta - move * min(1.0, STEP / max(np.abs(move).max(), 1e-300))
        if all(x <= tol for x in largest.values()):
            break
    found = [(g, name, [float(b) for b in betas[g][v]], largest[g, v], r.n, r.p) for g, r in counts.items() for v, name in enumerate(variants)]
    return spark.createDataFrame(found, schema)


def score_many(df: DataFrame, models: DataFrame, group: str, name: str = "score") -> DataFrame:
    """A row for each row of ``df`` and each variant of its group, with the chance by that model."""
    known = dictionary(models.select(F.col(group).alias("_g"), "variant", F.col("beta").alias("_beta")), "models")
    products = F.zip_with("x", F.slice("_beta", 2, F.size("x")), lambda a, b: a * b)
    return df.join(known, F.col(group) == F.col("_g")).withColumn(name, S.sigmoid(F.aggregate(products, F.col("_beta")[0], lambda s, v: s + v))).drop("_g", "_beta")


def registry(table: DataFrame, group: str, row: str, reg: float = 1e-3) -> DataFrame:
    """ML19: a calibrated model for each group of ``table`` (group, role, row, x, label), roles train, cal and test disjoint.

    Fitted on ``train``; slope and intercept of the calibration and the decision threshold (best MCC of the calibrated score) come from ``cal``, the metrics
    from ``test``. A group without rows to calibrate keeps slope 1, intercept 0 and has no threshold; one without test rows has no metrics.
    """
    table = materialize(table, "roles")
    models = materialize(fit_many(table.where("role = 'train'"), group, reg=reg), "fitted")
    raw = materialize(score_many(table.where("role <> 'train'"), models, group, "raw_prob"), "raw").withColumn("x", F.array(S.logit(F.col("raw_prob"))))
    platt = fit_many(raw.where("role = 'cal'"), group, reg=1e-6, weighted=False)
    models = models.join(platt.select(group, F.col("beta")[1].alias("slope"), F.col("beta")[0].alias("intercept")), group, "left").fillna({"slope": 1.0, "intercept": 0.0})
    models = materialize(models, "calibrated")
    line = models.select(group, F.array("intercept", "slope").alias("beta"), "variant")
    scored = materialize(score_many(raw.drop("variant"), line, group).select(group, "role", row, "label", "score"), "scored")
    cal = M.Scored(scored.where("role = 'cal'"), (group,), row)
    chosen = M.best_threshold(cal, M.curve(cal)).select(group, F.col("threshold").alias("decision_threshold"))
    tested = M.metric_table(M.Scored(scored.where("role = 'test'"), (group,), row))
    return models.drop("variant").join(chosen, group, "left").join(tested, group, "left")
