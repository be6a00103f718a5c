import numpy as np
import pytest
from pyspark.sql import functions as F

from stageflow.operators import features as FE
from stageflow.operators import many as MM


def rows_of(rng, n, true):
    x = rng.normal(size=(n, len(true)))
    y = rng.random(n) < 1 / (1 + np.exp(-(x @ true - 2)))
    return x, y.astype(int)


@pytest.fixture(scope="module")
def folds(spark):
    """Two ordinary groups, one with one outcome only, and rows that don't count."""
    rng = np.random.default_rng(2)
    parts = {1: rows_of(rng, 400, np.array([1.0, -0.5, 0.0])), 2: rows_of(rng, 90, np.array([0.0, 2.0, 1.0])), 3: (rng.normal(size=(20, 3)), np.zeros(20, int))}
    data = [(g, [float(v) for v in r], int(k)) for g, (x, y) in parts.items() for r, k in zip(x, y, strict=True)]
    odd = [(None, [0.0, 0.0, 0.0], 1), (1, [9.0, 9.0, 9.0], None)]
    return parts, spark.createDataFrame(data + odd, "fold int, x array<double>, label int")


def test_models_are_the_optimum_of_their_rows(spark, folds):
    parts, df = folds
    got = {(r.fold, r.variant): r for r in MM.fit_many(df.repartition(5), "fold", {"all": (), "no_second": (1,)}, reg=0.01).collect()}
    assert set(got) == {(g, v) for g in parts for v in ("all", "no_second")}
    for (g, v), r in got.items():
        x, y = parts[g]
        assert (r.n, r.positives) == (len(y), y.sum()) and r.gradient < 1e-9
        beta = np.array(r.beta)
        assert (beta[2] == 0) == (v == "no_second")
        w = np.where(y == 1, (len(y) - y.sum()) / max(y.sum(), 1), 1.0) if y.any() else np.ones(len(y))

        def loss(b):
            z = b[0] + x @ b[1:]
            return (w * np.logaddexp(0, np.where(y == 1, -z, z))).sum() / w.sum() + 0.005 * (b[1:] ** 2).sum() + (0 if y.any() else 0.005 * b[0] ** 2)

        for k in range(4):
            if not (v == "no_second" and k == 2):
                for e in (1e-3, -1e-3):
                    assert loss(beta + e * np.eye(4)[k]) >= loss(beta)


def test_models_of_no_rows(spark, folds):
    empty = folds[1].limit(0)
    models = MM.fit_many(empty, "fold")
    assert models.count() == 0 and MM.score_many(empty, models, "fold").count() == 0


def test_scores_are_chances_by_variant(spark, folds):
    parts, df = folds
    models = MM.fit_many(df, "fold", {"all": (), "first": (1, 2)})
    beta = {(r.fold, r.variant): np.array(r.beta) for r in models.collect()}
    got = MM.score_many(df.where("fold = 2 AND label IS NOT NULL"), models, "fold").collect()
    assert len(got) == 2 * len(parts[2][1])
    for r in got:
        b = beta[2, r.variant]
        assert abs(r.score - 1 / (1 + np.exp(-(b[0] + np.dot(r.x, b[1:]))))) < 1e-9


def test_scaling_uses_training_rows_of_the_group(spark):
    data = [("a", "train", 1.0, None), ("a", "train", 3.0, None), ("a", "train", None, None), ("a", "test", None, 5.0), ("b", "train", 100.0, 1.0), ("b", "test", 102.0, 3.0)]
    df = spark.createDataFrame(data, "g string, role string, u double, v double")
    got = {(r.g, r.role, r.u): r.x for r in FE.scaled_array(df, ["u", "v"], "g", F.col("role") == "train").collect()}
    sd = np.sqrt(2 / 3)  # 1, 3 and the median 2
    assert got["a", "train", 1.0] == pytest.approx([-1 / sd, 0.0]) and got["a", "test", None] == pytest.approx([0.0, 5.0])
    assert got["b", "test", 102.0] == pytest.approx([2.0, 2.0])


def test_registry_calibrates_on_its_own_rows(spark):
    """The positives' weight moves the raw score; the calibrated one is near the true chance. A group that can't be calibrated keeps its scores."""
    rng = np.random.default_rng(8)
    x, y = rows_of(rng, 3000, np.array([1.5, 0.0]))
    role = np.array(["train", "cal", "test"])[np.arange(3000) % 3]
    data = [("g", str(r), n, [float(v) for v in row], int(k)) for n, (r, row, k) in enumerate(zip(role, x, y, strict=True))]
    data += [("only", "train", 10_000 + n, [float(v) for v in row], int(k)) for n, (row, k) in enumerate(zip(x[:50], y[:50], strict=True))]
    got = {r.variant: r for r in MM.registry(spark.createDataFrame(data, "variant_name string, role string, entity long, x array<double>, label int"), "variant_name", "entity").withColumnRenamed("variant_name", "variant").collect()}
    assert set(got) == {"g", "only"}
    g, only = got["g"], got["only"]
    base = y[role == "test"].mean()
    assert g.intercept < -0.5 and 0 < g.decision_threshold < 1 and g.brier_score < base * (1 - base) and g.roc_auc > 0.75
    assert (only.slope, only.intercept, only.decision_threshold, only.roc_auc) == (1.0, 0.0, None, None)
