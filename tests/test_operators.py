import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stageflow.functions import stats as ST
from stageflow.functions.timescale import DAY_SCALE, LINE_SCALE
from stageflow.operators import features as FE
from stageflow.operators import joins as J
from stageflow.operators import metrics as M
from stageflow.operators import monitor as MN
from stageflow.operators import scan as SC
from stageflow.operators import scoring as SCO
from stageflow.operators import splits as SP


# ---- statistics --------------------------------------------------------------------------------------------

def test_erfc_relative_error(spark):
    xs = [-3.0, -1.0, 0.0, 0.5, 2.0, 5.0, 12.0, 17.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(ST.erfc(F.col("x"))).collect()]
    for x, g in zip(xs, got):
        assert g == pytest.approx(math.erfc(x), rel=2e-7)


def test_bh_hand_case(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.005,)], "raw_p double")
    got = {r["raw_p"]: round(r["adj_p"], 10) for r in SC.adjust_p(df).collect()}
    assert got == {0.01: 0.02, 0.04: 0.04, 0.03: 0.04, 0.005: 0.02}


def test_bh_with_ties(spark):
    rnd = random.Random(3)
    ps = [round(rnd.random() ** 4, 3) for _ in range(400)] + [0.0] * 5 + [1.0] * 5
    df = spark.createDataFrame(list(enumerate(ps)), "i int, raw_p double")
    got = {r["i"]: r["adj_p"] for r in SC.adjust_p(df).collect()}
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    want, best = {}, 1.0
    for rank in range(len(ps), 0, -1):
        best = min(best, ps[order[rank - 1]] * len(ps) / rank)
        want[order[rank - 1]] = best
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=1e-12)


@pytest.mark.parametrize("top", [None, 5])
def test_separate_windows_is_greedy(spark, top):
    rnd = random.Random(5)
    rows = [(k, round(rnd.uniform(0, 300), 2), round(rnd.random(), 4)) for k in ("a", "b") for _ in range(60)]
    rows += [("c", 0.0, 0.1), ("c", 9.99, 0.2), ("c", 10.0, 0.3)]
    df = spark.createDataFrame(rows, "key string, t_start double, p double").withColumn("t_start", F.round(F.col("t_start") * 100).cast("long"))
    got = {(r["key"], r["t_start"]) for r in SC.separate_windows(df, ("key",), [F.col("p"), F.col("t_start")], 1000, top).collect()}
    want: set = set()
    for k, t, _ in sorted(((k, round(t * 100), p) for k, t, p in rows), key=lambda x: (x[2], x[1])):
        if all(k != k2 or abs(t - t2) >= 1000 for k2, t2 in want) and (top is None or len(want) < top):
            want.add((k, t))
    assert got == want
    if top is None:
        assert ("c", 0) in got and ("c", 1000) in got and ("c", 999) not in got


# ---- joins ---------------------------------------------------------------------------------------------------

def test_range_count_edges(spark):
    ev = spark.createDataFrame([(100 - 10,), (100 - 9,), (100,), (101,)], "e long")
    pr = spark.createDataFrame([(1, 100), (2, 100), (3, 89)], "id int, t long")
    got = {r["id"]: r["n"] for r in J.range_count(pr, ev, "e", 9, "n", "t").collect()}
    assert got == {1: 2, 2: 2, 3: 0}


def test_recent_rate_with_equal_times(spark):
    out = spark.createDataFrame([(10, 1, 1), (10, 2, 0), (10, 3, 1), (20, 4, 0)], "t long, id long, y int")
    pr = spark.createDataFrame([(9,), (10,), (20,)], "d long")
    got = {r["d"]: r["recent_rate"] for r in J.recent_rate(pr, out, "d", "t", "id", "y", 2, 0.25).collect()}
    assert got == {9: 0.25, 10: 0.5, 20: 0.5}


# ---- scoring -------------------------------------------------------------------------------------------------

def _messages(spark, rows):
    return spark.createDataFrame(
        rows, "entity long, stage int, stage_rank int, t long, transit_minutes double, features map<string,double>, is_entry boolean, is_exit boolean, response int, prev_stage int"
    )


def _score(spark, rows, window=100):
    from dataclasses import replace

    cfg = replace(SCO.CFG, window=window)
    base = spark.createDataFrame([(s, "f", 0.0, 0.1) for s in (1, 2)], "stage int, feature string, mean double, std double")
    bench = spark.createDataFrame([(1, 2, 6.0, 36.0)], "prev_stage int, stage int, p90 double, p99 double")
    topo = spark.createDataFrame([(1, None), (2, 1), (3, None)], "stage int, static_prev int")
    return SCO.stage_health(_messages(spark, rows), base, bench, topo, cfg)


def test_three_messages(spark):
    rows = [
        (7, 1, 1, 0, 0.0, {"f": 0.55}, True, False, None, None),
        (7, 2, 2, 1, 6.0, {"f": 0.01}, False, False, None, 1),
        (7, 3, 3, 2, 6.0, {}, False, True, 1, 2),
    ]
    h = _score(spark, rows)
    got = {r["stage"]: r for r in h.collect()}
    assert got[1]["health_score"] < 80 and got[1]["anomalous_features"] == ["f"]
    assert got[3]["feature_drift_score"] == 100.0
    o = SCO.line_overview(h, 24.0, 3).collect()
    assert [(r["total_entered"], r["total_completed"], r["total_defects"], r["active_parts"]) for r in o] == [(1, 1, 1, 1)]
    risk = {r["stage"]: r for r in SCO.part_risk(h).collect()}
    assert risk[3]["stages_visited"] == [1, 2, 3] and risk[3]["cumulative_anomalies"] == 1
    assert risk[3]["top_deviations"][0]["z_score"] == 5.5


def test_rolling_outcomes_against_sequential_run(spark):
    rnd = random.Random(11)
    rows, window = [], 3
    for p in range(60):
        t = rnd.randrange(40)
        for s, rank in ((1, 1), (2, 2), (3, 3)):
            if s == 3 or rnd.random() < 0.9:
                rows.append((p, s, rank, t, float(rnd.randrange(50)), {"f": rnd.uniform(-0.3, 0.3)}, s == 1, s == 3, int(rnd.random() < 0.4) if s == 3 else None, None))
                t += rnd.randrange(6)
    got = {(r["entity"], r["stage"]): r for r in _score(spark, rows, window).collect()}
    recent: dict = {1: [], 2: [], 3: []}
    zs: dict = {1: [], 2: [], 3: []}
    known: dict = {1: [], 2: [], 3: []}
    visited: dict = {}
    for r in sorted(rows, key=lambda r: (r[3], r[2], r[0])):
        p, s = r[0], r[1]
        visited.setdefault(p, []).append(s)
        recent[s] = (recent[s] + [p])[-window:]
        zs[s] = (zs[s] + [abs(r[5]["f"] / 0.1) if s < 3 else 0.0])[-window:]
        rate = sum(known[s]) / len(known[s]) if known[s] else SCO.CFG.base_rate
        assert got[p, s]["observed_defect_rate"] == pytest.approx(round(rate * 100, 4), abs=1e-4), (p, s)
        assert got[p, s]["window_parts"] == len(recent[s])
        drift = max(0.0, min(100.0, 100 - (sum(zs[s]) / len(zs[s]) - 1) * 100 / 3))
        assert got[p, s]["feature_drift_score"] == pytest.approx(drift, abs=0.006)
        if r[7]:
            for v in visited.pop(p):
                if p in recent[v]:
                    known[v] = (known[v] + [r[8]])[-window:]


# ---- features, splits ----------------------------------------------------------------------------------------

def test_sequences_reset_on_gap_and_hole(spark):
    ids = [i for i in range(1, 31) if i != 20]
    df = spark.createDataFrame([(i, i == 12, [float(i)]) for i in ids], "window_id long, is_gap boolean, vec array<double>")
    for block in (4, 8, 4096):
        got = sorted((r["window_id"], [v[0] for v in r["sequence"]]) for r in FE.sequences(df, 4, block=block).collect())
        want = [w for w in ids if all(x in ids and x != 12 for x in range(w - 3, w + 1))]
        assert [g[0] for g in got] == want
        assert all(vals == [float(x) for x in range(w - 3, w + 1)] for w, vals in got)


def test_entity_features_are_causal(data):
    """Later arrivals and later outcomes never change an earlier row."""
    from stageflow.plans.learning import SPEC

    cut = 1500
    full = FE.entity_table(data.visits, data.labels, SPEC, DAY_SCALE)
    later = full.where(F.col("exit_time") > cut).select("entity", F.lit(1).alias("late"))
    flipped = data.labels.join(later, "entity", "left").select(
        "entity", F.when(F.col("late") == 1, 1 - F.col("label")).otherwise(F.col("label")).alias("label")
    )
    extra = data.visits.where((F.col("stage") == 1) & (F.col("entry") > cut)).withColumn("entity", F.col("entity") + 10**9)
    changed = FE.entity_table(data.visits.unionByName(extra), flipped, SPEC, DAY_SCALE)
    cols = ["entity", "arrivals", "recent_rate"]
    a = {tuple(r) for r in full.where(F.col("decision_time") <= cut).select(*cols).collect()}
    b = {tuple(r) for r in changed.where(F.col("decision_time") <= cut).select(*cols).collect()}
    assert a == b and len(a) > 5 and all(0.0 <= r[2] <= 1.0 for r in a)


def test_splits_are_disjoint(spark):
    df = spark.range(1001).select(F.col("id"), (F.col("id") * 1.7).cast("long").alias("t"), (F.col("id") / 16.75).cast("int").alias("week"))
    folds = ((1, (0, 20), (21, 25)), (2, (0, 25), (26, 30)))
    f = SP.forward_chaining(df, "week", folds).groupBy("fold").agg(
        F.max(F.when(F.col("role") == "train", F.col("week"))).alias("a"), F.min(F.when(F.col("role") == "val", F.col("week"))).alias("b")
    )
    assert all(r["a"] < r["b"] for r in f.collect())
    lw = SP.leave_window_out(df, "t", [("A", 300, 400)], 50)
    r = lw.groupBy("role").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).collect()
    test = next(x for x in r if x["role"] == "test")
    assert test["lo"] >= 300 and test["hi"] <= 400
    assert lw.where("role = 'train' AND t BETWEEN 250 AND 450").count() == 0
    ch = SP.chronological(df, "t", "id")
    assert ch.where("role = 'train'").count() == 800
    assert ch.where("role = 'train'").agg(F.max("t")).first()[0] <= ch.where("role = 'val'").agg(F.min("t")).first()[0]


def test_sample_does_not_depend_on_partitioning(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 50 == 0).cast("int").alias("y"))
    a = {r["id"] for r in SP.keep_positives(df.repartition(3), "y", "id", 1500, 1000).collect()}
    b = {r["id"] for r in SP.keep_positives(df.repartition(7), "y", "id", 1500, 1000).collect()}
    assert a == b and len(a) == 1500 and all(i in a for i in range(0, 5000, 50))


# ---- metrics, alerts, time -----------------------------------------------------------------------------------

def test_metrics_against_brute_force(spark):
    rng = np.random.default_rng(2)
    y = (rng.random(500) < 0.2).astype(int)
    score = np.round(np.clip(0.3 * y + rng.random(500) * 0.7, 0, 1), 2)
    rows = [("a", i, int(y[i]), float(score[i])) for i in range(500)] + [("const", i, int(y[i]), 0.5) for i in range(500)]
    s = M.Scored(spark.createDataFrame(rows, "m string, row long, label int, score double"), ("m",), "row")
    got = {r["m"]: r for r in M.metric_table(s).collect()}
    assert got["const"]["roc_auc"] == 0.5
    pos, neg = score[y == 1], score[y == 0]
    auc = np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])
    assert got["a"]["roc_auc"] == pytest.approx(auc, abs=1e-5)
    order = sorted(range(500), key=lambda i: (-score[i], i))
    assert got["a"]["recall_at_5pct"] == pytest.approx(sum(y[i] for i in order[:25]) / y.sum(), abs=1e-5)
    assert got["a"]["brier_score"] == pytest.approx(np.mean((y - score) ** 2), abs=1e-6)
    best = max(
        (np.corrcoef(y, score >= th)[0, 1] if 0 < (score >= th).sum() < 500 else 0.0)
        for th in np.unique(np.percentile(score, np.linspace(50, 99.8, 80)))
    )
    assert got["a"]["mcc"] == pytest.approx(best, abs=1e-5)


def test_hold_needs_consecutive_evaluations(spark):
    df = spark.createDataFrame([(1, 9), (2, 0), (3, 9), (4, 9), (5, 9), (6, 0)], "g long, n int")
    assert sorted(r["g"] for r in MN.hold(df, F.col("n") > 5, 1).collect()) == [4, 5]
    assert sorted(r["g"] for r in MN.hold(df, F.col("n") > 5, 2).collect()) == [5]


def test_time_scale():
    assert LINE_SCALE.hours * 16.75 == pytest.approx(168.0)
    assert LINE_SCALE.minutes == pytest.approx(601.791, abs=1e-3)
