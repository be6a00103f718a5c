"""Training tables, splits, metrics and model queries."""

from pyspark.sql import functions as F

from stageflow.functions import scalar as S
from stageflow.functions.timescale import DAY_SCALE
from stageflow.operators import features as FE
from stageflow.operators import joins as J
from stageflow.operators import many as MM
from stageflow.operators import metrics as M
from stageflow.operators import models as MO
from stageflow.operators import profile as PR
from stageflow.operators import splits as SP
from stageflow.plans.flow import rounded
from stageflow.plans.profile_quality import SCENARIO_TIMES
from stageflow.plans.registry import cte, query, sql
from stageflow.session import dictionary, materialize
from stageflow.sources.tables import STAGES

SPEC = FE.FlowSpec(
    required=(1, 2, 7), fork=(5, 6), chain=(1, 2), entry_stage=1, exit_stage=7, sensor_stages=STAGES, sensors=("qty", "price", "disc", "tax")
)
WINDOW, MIN_PARTS, LENGTH = 7, 15, 4
FOLDS = ((1, (0, 150), (151, 200)), (2, (0, 200), (201, 260)), (3, (0, 260), (261, 360)))


def entity_table(d):
    d.stored("visits")
    return FE.entity_table(d.visits, d.labels, SPEC, DAY_SCALE)


_SC = [(s, st) for s in SPEC.sensors for st in SPEC.sensor_stages]
cte("core", f"""SELECT p.*, CASE WHEN e6 IS NOT NULL THEN 1 ELSE 0 END AS branch, coalesce(e6, e5) AS decision_time, e7 AS exit_time, coalesce(lab.label, 0) AS label FROM (
  SELECT entity, {", ".join(f"max(CASE WHEN stage = {s} THEN entry END) AS e{s}" for s in STAGES)}, {", ".join(f"max(CASE WHEN stage = {st} THEN {s} END) AS {s}_{st}" for s, st in _SC)}
  FROM v GROUP BY entity) p LEFT JOIN lab USING (entity) WHERE e1 IS NOT NULL AND e2 IS NOT NULL AND e7 IS NOT NULL AND ((e5 IS NULL) <> (e6 IS NULL))""", ["v", "lab"])
cte("etab", f"""SELECT core.entity, core.decision_time, exit_time, CAST(floor(core.decision_time / 7.0) AS INTEGER) AS week, branch,
  greatest(0.0, (e2 - e1) * 1440.0) AS transit_1_2, greatest(0.0, (core.decision_time - e2) * 1440.0) AS transit_2_branch,
  {", ".join(f"{s}_{st}" for s, st in _SC)}, {", ".join(f"CAST({s}_{st} IS NULL AS INTEGER) AS {s}_{st}_isna" for s, st in _SC)}, label, arrivals, recent_rate FROM core
  JOIN (SELECT q.decision_time, (SELECT count(*) FROM v WHERE stage = 1 AND entry BETWEEN q.decision_time - 9 AND q.decision_time) AS arrivals,
    CASE WHEN k > 0 THEN (c - coalesce((SELECT o.c FROM co o WHERE o.k = q.k - 500), 0)) / least(k, 500) ELSE 0.005069 END AS recent_rate
    FROM (SELECT decision_time, coalesce((SELECT max(k) FROM co WHERE co.t <= p.decision_time), 0) AS k, coalesce((SELECT max(c) FROM co WHERE co.t <= p.decision_time), 0) AS c
      FROM (SELECT DISTINCT decision_time FROM core) p) q) z USING (decision_time)""", ["core", "co", "v"])
cte("co", "SELECT exit_time AS t, row_number() OVER (ORDER BY exit_time, entity) AS k, CAST(sum(label) OVER (ORDER BY exit_time, entity ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c FROM core", ["core"])


@query("ml1_entity_training_table", sql("etab", "SELECT * REPLACE (round(recent_rate, 6) AS recent_rate) FROM etab"))
def ml1(d):
    return rounded(entity_table(d), "recent_rate")


@query("ml2_keep_positives_sample")
def ml2(d):
    out = SP.keep_positives(d.labels, "label", "entity", 6000)
    return out.select("entity", "label")


_FOLDS = ", ".join(f"({k}, '{r}', {a}, {b})" for k, tr, va in FOLDS for r, (a, b) in (("train", tr), ("val", va)))


@query("ml3_forward_chaining_folds", sql("v", f"""SELECT fold, role, count(*) AS n, min(w) AS lo, max(w) AS hi, count(DISTINCT entity) AS entities FROM (SELECT entity, CAST(floor(entry / 7.0) AS INTEGER) AS w FROM v)
  JOIN (VALUES {_FOLDS}) f(fold, role, a, b) ON w BETWEEN a AND b GROUP BY fold, role"""))
def ml3(d):
    w = d.visits.select("entity", DAY_SCALE.bucket(F.col("entry")).alias("w"))
    return SP.forward_chaining(w, "w", FOLDS).groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("w").alias("lo"), F.max("w").alias("hi"), F.count_distinct("entity").alias("entities")
    )


@query("ml4_leave_window_out", sql("v scen", """SELECT name AS fold, CASE WHEN entry BETWEEN t_start AND t_end THEN 'test' ELSE 'train' END AS role, entity, stage, entry FROM v JOIN scen
  ON entry BETWEEN t_start AND t_end OR entry < t_start - 5 OR entry > t_end + 5"""))
def ml4(d):
    return SP.leave_window_out(d.visits.select("entity", "stage", "entry"), "entry", SCENARIO_TIMES, 5)


@query("ml5_chronological_split", sql("v", """SELECT entity, entry, CASE WHEN row_number() OVER (ORDER BY entry, entity) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'val' END AS role FROM v WHERE stage = 1"""))
def ml5(d):
    return SP.chronological(d.visits.where("stage = 1").select("entity", "entry"), "entry", "entity")


_ST = ("qty", "price", "disc", "tax")


@query("ml6_impute_and_scale", sql("v", ", tr AS (SELECT * FROM v WHERE entry < 1600), md AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in _ST) + " FROM tr), ms AS (SELECT "
  + ", ".join(f"avg(coalesce(tr.{c}, md.{c})) AS m_{c}, stddev_pop(coalesce(tr.{c}, md.{c})) AS s_{c}" for c in _ST) + " FROM tr, md) SELECT entity, stage, "
  + ", ".join(f"round((coalesce(v.{c}, md.{c}) - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1.0 END, 6) AS {c}_std" for c in _ST) + " FROM v, md, ms"))
def ml6(d):
    out = FE.impute_and_scale(d.visits, _ST, F.col("entry") < 1600)
    cols = [f"{c}_std" for c in _ST]
    return rounded(out.select("entity", "stage", *cols), *cols)


@query("ml7_prevalence_baseline", sql("lv", "SELECT entity, stage, round((SELECT avg(label) FROM lv WHERE entry < 1600), 6) AS score FROM lv WHERE entry >= 1600"))
def ml7(d):
    lv = d.labelled_visits
    out = MO.prevalence_score(lv.where("entry < 1600"), lv.where("entry >= 1600"))
    return rounded(out.select("entity", "stage", "score"), "score")


@query("ml8_recent_rate_baseline", sql("etab", "SELECT entity, round(recent_rate, 6) AS score FROM etab"))
def ml8(d):
    return rounded(MO.column_score(entity_table(d), "recent_rate").select("entity", "score"), "score")


# ---- window table and sequences ---------------------------------------------------------------------------

def window_metrics(d):
    d.stored("visits")
    base = dictionary(PR.baselines(d.sensor_values, ("stage", "feature")), "baselines")
    z = d.sensor_values.join(base, ["stage", "feature"]).select(
        "stage", F.col("entry").alias("t"), S.abs_z(F.col("value"), F.col("mean"), F.col("std")).alias("abs_z")
    )
    entries = d.visits.select("stage", F.col("entry").alias("t"))
    transits = d.messages.select("stage", "t", F.col("transit_minutes").alias("transit"))
    return FE.window_metrics(entries, z, transits, WINDOW, DAY_SCALE, 1, STAGES, MIN_PARTS)


cte("wm", f"""WITH c AS (SELECT stage, entry // {WINDOW} AS window_id, count(*) AS n FROM v GROUP BY 1, 2),
  z AS (SELECT stage, entry // {WINDOW} AS window_id, max(az) AS mx, avg(az) AS mn FROM (SELECT sens.stage, entry, abs((value - mean) / greatest(std, 0.001)) AS az FROM sens JOIN baseline USING (stage, feature)) GROUP BY 1, 2),
  p AS (SELECT stage, t // {WINDOW} AS window_id, quantile_cont(transit_minutes, 0.9) AS p90, avg(CAST(transit_minutes <= 0.001 AS INT)) AS zs FROM m GROUP BY 1, 2),
  g AS (SELECT window_id, coalesce(n, 0) AS part_count, coalesce(n, 0) < {MIN_PARTS} AS is_gap FROM (SELECT unnest(generate_series(lo, hi)) AS window_id FROM (SELECT min(window_id) AS lo, max(window_id) AS hi FROM c)) LEFT JOIN (SELECT * FROM c WHERE stage = 1) USING (window_id))
  SELECT g.window_id, g.window_id * {WINDOW} AS t_start, g.window_id * {WINDOW} + {WINDOW} AS t_end, part_count, is_gap, s.stage,
  CASE WHEN is_gap THEN 0.0 ELSE coalesce(mx, 0.0) END AS max_abs_z, CASE WHEN is_gap THEN 0.0 ELSE coalesce(mn, 0.0) END AS mean_abs_z, CASE WHEN is_gap THEN 0.0 ELSE coalesce(p90, 0.0) END AS p90_transit,
  CASE WHEN is_gap THEN 1.0 ELSE coalesce(zs, 1.0) END AS zero_delta_share, CASE WHEN is_gap THEN 0.0 ELSE coalesce(CAST(c.n AS DOUBLE), 0.0) END AS throughput
  FROM g, (SELECT unnest(generate_series(1, 7)) AS stage) s LEFT JOIN c ON c.stage = s.stage AND c.window_id = g.window_id
  LEFT JOIN z ON z.stage = s.stage AND z.window_id = g.window_id LEFT JOIN p ON p.stage = s.stage AND p.window_id = g.window_id""", ["v", "sens", "baseline", "m"])


@query("agg39_window_metrics", sql("wm", """SELECT window_id, t_start, t_end, CAST(floor(t_start / 7.0) AS INTEGER) AS week, part_count, is_gap, CAST(stage AS INTEGER) AS stage, round(max_abs_z, 4) AS max_abs_z,
  round(mean_abs_z, 4) AS mean_abs_z, round(p90_transit, 4) AS p90_transit, round(zero_delta_share, 4) AS zero_delta_share, throughput FROM wm"""))
def agg39(d):
    return window_metrics(d)


@query("agg40_entry_histogram", sql("v", "SELECT CAST(least(floor((entry - 100) / 50.0), 39) AS INTEGER) AS bin, count(*) AS n FROM v WHERE stage = 1 AND entry BETWEEN 100 AND 2100 GROUP BY 1"))
def agg40(d):
    return FE.entry_histogram(d.visits.where("stage = 1"), "entry", 100, 50, 40)


def wide_windows(d):
    return FE.window_vector(FE.window_table(window_metrics(d), STAGES), STAGES)


@query("shp5_window_vector", sql("wm", """SELECT window_id, part_count, is_gap, CAST(35 AS INTEGER) AS dims, max(throughput) FILTER (stage = 1) AS first_throughput, max(throughput) FILTER (stage = 7) AS last_throughput FROM wm GROUP BY ALL"""))
def shp5(d):
    v = F.col("vec")
    return wide_windows(d).select(
        "window_id", "part_count", "is_gap", F.size(v).alias("dims"), v[4].alias("first_throughput"), v[34].alias("last_throughput")
    )


def sequence_table(d):
    return materialize(FE.sequences(materialize(wide_windows(d), "windows"), LENGTH), "sequences")


@query("win11_sequences", sql("wm", f""", w AS (SELECT DISTINCT window_id, max(throughput) FILTER (stage = 1) OVER (PARTITION BY window_id) AS thr FROM wm WHERE NOT is_gap),
  i AS (SELECT *, window_id - row_number() OVER (ORDER BY window_id) AS island FROM w), k AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY window_id) AS pos FROM i)
  SELECT k.window_id, k.window_id - {LENGTH - 1} AS first_window, CAST({LENGTH} AS INTEGER) AS steps, f.thr AS first_throughput, k.thr AS last_throughput FROM k JOIN k f ON f.window_id = k.window_id - {LENGTH - 1} WHERE k.pos >= {LENGTH}"""))
def win11(d):
    s = FE.sequences(materialize(wide_windows(d), "windows"), LENGTH)
    q = F.col("sequence")
    return s.select(
        "window_id", (F.col("window_id") - (LENGTH - 1)).alias("first_window"), F.size(q).alias("steps"), q[0][4].alias("first_throughput"), q[LENGTH - 1][4].alias("last_throughput")
    )


@query("ml15_normal_regime", sql("wm scen", """SELECT DISTINCT window_id, t_start, part_count FROM wm WHERE NOT is_gap AND NOT EXISTS (SELECT 1 FROM scen s WHERE wm.t_start BETWEEN s.t_start - 3 AND s.t_end + 3)"""))
def ml15(d):
    return J.outside_intervals(wide_windows(d).where("NOT is_gap"), "t_start", SCENARIO_TIMES, margin=3).select("window_id", "t_start", "part_count")


# ---- metrics ----------------------------------------------------------------------------------------------

cte("sc", """SELECT entity * 8 + stage AS row_id, line AS fold, model, score, label FROM (
  SELECT entity, stage, line, label, 'disc' AS model, coalesce(disc, 0.0) / 0.1 AS score FROM lv UNION ALL SELECT entity, stage, line, label, 'qty', qty / 50.0 FROM lv UNION ALL
  SELECT entity, stage, line, label, 'tax', tax / 0.08 FROM lv)""", ["lv"])
cte("cv", """SELECT fold, model, score, n, pos, sum(n) OVER d AS cum_n, sum(pos) OVER d AS cum_pos, sum(n) OVER k AS total, sum(pos) OVER k AS positives FROM (
  SELECT fold, model, score, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos FROM sc GROUP BY 1, 2, 3) WINDOW d AS (PARTITION BY fold, model ORDER BY score DESC), k AS (PARTITION BY fold, model)""", ["sc"])
cte("auc", "SELECT fold, model, (sum(pos * (total - cum_n + (n + 1) / 2.0)) - max(positives) * (max(positives) + 1) / 2.0) / (max(positives) * (max(total) - max(positives))) AS roc_auc FROM cv GROUP BY 1, 2", ["cv"])
cte("ap", "SELECT fold, model, sum(pos * cum_pos / cum_n) / sum(pos) AS pr_auc FROM cv GROUP BY 1, 2", ["cv"])
_PTS = "[" + ", ".join(repr(p) for p in M.THRESHOLD_POINTS) + "]"
_MCC = "CASE WHEN (tp + fp) * (tp + fn) > 0 AND (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)) ELSE 0.0 END"
cte("bt", f"""WITH th AS (SELECT fold, model, unnest(list_distinct(quantile_cont(score, {_PTS}))) AS threshold FROM sc GROUP BY 1, 2),
  q AS (SELECT fold, model, threshold, CAST(count(*) FILTER (score >= threshold AND label = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (score >= threshold AND label = 0) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (score < threshold AND label = 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (score < threshold AND label = 0) AS DOUBLE) AS tn FROM sc JOIN th USING (fold, model) GROUP BY 1, 2, 3),
  s AS (SELECT *, round({_MCC}, 12) AS mcc FROM q) SELECT fold, model, threshold, mcc FROM (SELECT *, row_number() OVER (PARTITION BY fold, model ORDER BY mcc DESC, threshold) AS k FROM s) WHERE k = 1""", ["sc"])
cte("rec", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY fold, model ORDER BY score DESC, row_id) AS k, count(*) OVER (PARTITION BY fold, model) AS n, sum(label) OVER (PARTITION BY fold, model) AS p FROM sc)
  SELECT fold, model, sum(label) FILTER (k <= ceil(n * 0.01)) / max(p) AS recall_at_1pct, sum(label) FILTER (k <= ceil(n * 0.05)) / max(p) AS recall_at_5pct FROM o GROUP BY 1, 2""", ["sc"])
cte("bri", "SELECT fold, model, avg((label - score) * (label - score)) AS brier FROM sc GROUP BY 1, 2", ["sc"])


def scored(d):
    scores = F.array(
        F.struct(F.lit("disc").alias("model"), (F.coalesce("disc", F.lit(0.0)) / 0.1).alias("score")),
        F.struct(F.lit("qty").alias("model"), (F.col("qty") / 50.0).alias("score")),
        F.struct(F.lit("tax").alias("model"), (F.col("tax") / 0.08).alias("score")),
    )
    df = d.labelled_visits.select((F.col("entity") * 8 + F.col("stage")).alias("row_id"), F.col("line").alias("fold"), "label", F.inline(scores))
    return M.Scored(df, ("fold", "model"), "row_id")


KEYS = ("fold", "model")


@query("met1_roc_auc", sql("auc", "SELECT fold, model, round(roc_auc, 8) AS roc_auc FROM auc"))
def met1(d):
    return rounded(M.roc_auc(M.curve(scored(d)), KEYS), "roc_auc", digits=8)


@query("met2_average_precision", sql("ap", "SELECT fold, model, round(pr_auc, 8) AS pr_auc FROM ap"))
def met2(d):
    return rounded(M.average_precision(M.curve(scored(d)), KEYS), "pr_auc", digits=8)


@query("met3_mcc", sql("sc", f""", q AS (SELECT fold, model, count(*) FILTER (score >= 0.8 AND label = 1) AS tp, count(*) FILTER (score >= 0.8 AND label = 0) AS fp,
  count(*) FILTER (score < 0.8 AND label = 1) AS fn, count(*) FILTER (score < 0.8 AND label = 0) AS tn FROM sc GROUP BY 1, 2) SELECT fold, model, tp, fp, fn, tn, round({_MCC}, 8) AS mcc FROM q"""))
def met3(d):
    return rounded(M.mcc_at(scored(d), F.lit(0.8)), "mcc", digits=8)


@query("met4_threshold_search", sql("bt", "SELECT fold, model, round(threshold, 8) AS threshold, round(mcc, 8) AS mcc FROM bt"))
def met4(d):
    s = scored(d)
    return rounded(M.best_threshold(s, M.curve(s)), "threshold", "mcc", digits=8)


@query("met5_recall_at_top", sql("rec", "SELECT fold, model, round(recall_at_1pct, 8) AS recall_at_1pct, round(recall_at_5pct, 8) AS recall_at_5pct, round(recall_at_1pct / 0.01, 6) AS lift_at_1pct FROM rec"))
def met5(d):
    s = scored(d)
    c = M.curve(s)
    out = M.recall_at(s, c, 0.01, "recall_at_1pct").join(M.recall_at(s, c, 0.05, "recall_at_5pct"), list(KEYS))
    out = out.withColumn("lift_at_1pct", F.round(F.col("recall_at_1pct") / 0.01, 6))
    return rounded(out, "recall_at_1pct", "recall_at_5pct", digits=8)


@query("met6_brier", sql("bri", "SELECT fold, model, round(brier, 8) AS brier FROM bri"))
def met6(d):
    return rounded(M.brier(scored(d)), "brier", digits=8)


@query("met7_metric_table", sql("auc ap bt rec bri", """SELECT fold, model, round(pr_auc, 5) AS pr_auc, round(roc_auc, 5) AS roc_auc, round(mcc, 5) AS mcc, round(threshold, 5) AS optimal_threshold,
  round(recall_at_1pct, 5) AS recall_at_1pct, round(recall_at_5pct, 5) AS recall_at_5pct, round(recall_at_1pct / 0.01, 2) AS lift_at_1pct, round(brier, 6) AS brier_score
  FROM auc JOIN ap USING (fold, model) JOIN bt USING (fold, model) JOIN rec USING (fold, model) JOIN bri USING (fold, model)"""))
def met7(d):
    return M.metric_table(scored(d))


@query("met8_alarm_lead_time", sql("v scen", """, f AS (SELECT entry // 7 * 7 AS t, count(*) >= 24 AS a FROM v WHERE stage = 1 GROUP BY 1)
  SELECT name AS scenario, CAST(t_start AS BIGINT) AS surge_start, min(t) FILTER (a) AS first_alarm, count(*) FILTER (a) AS alarms, count(*) AS windows, t_start - min(t) FILTER (a) AS lead
  FROM f JOIN scen ON t >= t_start - 60 AND t <= t_end GROUP BY name, t_start"""))
def met8(d):
    t = F.floor(F.col("entry") / 7).cast("long") * 7
    f = d.visits.where("stage = 1").groupBy(t.alias("t")).agg((F.count(F.lit(1)) >= 24).alias("is_anomaly"))
    return M.alarm_lead(f, SCENARIO_TIMES, "t", 60)


# ---- models -----------------------------------------------------------------------------------------------

VALUES = [*SPEC.transits, "arrivals", "recent_rate", *SPEC.sensor_columns]
FLAGS = ["branch", *[f"{c}_isna" for c in SPEC.sensor_columns]]
COLS = [*[f"{c}_std" for c in VALUES], *FLAGS]


def three_ranges(d):
    """Fit, calibrate and test on disjoint time ranges; missing readings get the median of the rows fitted on, all values their scale."""
    parts = materialize(SP.time_ranges(entity_table(d), "decision_time", "entity", [("train", 0.6), ("cal", 0.8)], "test"), "parts")
    scaled = FE.scaled_array(parts.withColumn("_all", F.lit(0)), VALUES, "_all", F.col("role") == "train")
    parts = materialize(scaled.select(*parts.columns, *[F.col("x")[i].alias(f"{c}_std") for i, c in enumerate(VALUES)]), "ranges")
    return tuple(parts.where(F.col("role") == r).drop("role") for r in ("train", "cal", "test"))


def named(df, column):
    """Feature names without the mark of the scaled column."""
    return df.withColumn(column, F.regexp_replace(column, "_std$", ""))


def _report(df, model):
    return M.metric_table(M.Scored(materialize(df.select(F.lit(model).alias("model"), "entity", "label", "score"), "scores"), ("model",), "entity"))


@query("ml9_logistic_regression")
def ml9(d):
    train, _, test = three_ranges(d)
    return _report(MO.score_table(MO.fit_logistic(train, COLS), test), "logistic")


@query("ml10_boosted_trees")
def ml10(d):
    train, _, test = three_ranges(d)
    return _report(MO.score_table(MO.fit_boosted(train, COLS), test), "boosted")


def calibrated_model(d):
    train, cal, test = three_ranges(d)
    model = MO.fit_logistic(train, COLS)
    return model, MO.fit_platt(MO.probability(model, cal)), train, test


@query("ml11_platt_calibration")
def ml11(d):
    model, platt, _, test = calibrated_model(d)
    out = MO.probability(model, test)
    return out.select("entity", "label", F.round("raw_prob", 6).alias("raw_prob"), F.round(MO.calibrated(F.col("raw_prob"), *platt), 6).alias("calibrated_prob"))


@query("ml12_batch_scoring")
def ml12(d):
    model, platt, _, test = calibrated_model(d)
    out = MO.score_table(model, test, platt)
    return out.select("entity", "decision_time", "branch", "score", (F.col("score") >= S.ScoreConfig().high_prob).alias("is_high_risk"))


@query("ml12_default_without_model", sql("lab", "SELECT entity, 0.005069 AS score FROM lab"))
def ml12_default(d):
    return MO.score_table(None, d.labels).select("entity", "score")


@query("ml13_feature_ablation")
def ml13(d):
    train, _, test = three_ranges(d)
    return named(MO.ablation(train, test, COLS, ["recent_rate_std", "arrivals_std"], "entity"), "dropped")


@query("ml14_permutation_importance")
def ml14(d):
    model, platt, _, test = calibrated_model(d)
    return named(MO.permutation_importance(model, materialize(test, "test"), COLS, "entity", platt), "feature")


FEATURES = [*VALUES, *FLAGS]
#: Columns left out of the models of a fold, by name.
LEFT_OUT = {"logistic": (), "logistic without recent_rate": ("recent_rate",), "logistic without arrivals": ("arrivals",), "logistic without sensors": (*SPEC.sensor_columns, *FLAGS[1:])}


def fold_models(d):
    """(rows of all forward-chaining folds with their features, models of all folds and left-out columns)."""
    folds = materialize(SP.forward_chaining(entity_table(d), "week", FOLDS), "folds")
    rows = materialize(FE.scaled_array(folds, FEATURES, "fold", F.col("role") == "train"), "fold-features")
    left_out = {name: [FEATURES.index(c) for c in out] for name, out in LEFT_OUT.items()}
    return rows, materialize(MM.fit_many(rows.where("role = 'train'"), "fold", left_out), "fold-models")


_FOLD_ROWS = f"SELECT fold, role, label FROM etab JOIN (VALUES {_FOLDS}) f(fold, role, a, b) ON week BETWEEN a AND b"


@query("ml3_fold_optimum", sql("etab", f"""SELECT fold, variant, count(*) AS n, count(*) FILTER (label = 1) AS positives, true AS at_optimum, CAST({len(FEATURES)} AS INTEGER) AS columns
  FROM ({_FOLD_ROWS}), (VALUES {", ".join(f"('{v}')" for v in LEFT_OUT)}) x(variant) WHERE role = 'train' GROUP BY fold, variant"""))
def ml3_optimum(d):
    """Every model of every fold, fitted together: rows used, and whether the gradient of its loss vanishes, summed anew over the rows."""
    rows, models = fold_models(d)
    train = rows.where("role = 'train'")
    w = train.groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("positives"))
    w = w.withColumn("_pos", F.when(F.col("positives") > 0, (F.col("n") - F.col("positives")) / F.col("positives")).otherwise(1.0))
    w = dictionary(w, "fold-weights")
    scored = MM.score_many(train, models, "fold").join(w, "fold").withColumn("_w", F.when(F.col("label") == 1, F.col("_pos")).otherwise(1.0))
    error = F.col("_w") * (F.col("score") - F.col("label"))
    sums = scored.groupBy("fold", "variant").agg(
        F.array(F.sum(error), *[F.sum(error * F.col("x")[i]) for i in range(len(FEATURES))]).alias("g"), F.sum("_w").alias("t"), F.first("n").alias("n"), F.first("positives").alias("positives")
    ).join(models.select("fold", "variant", "beta"), ["fold", "variant"])
    slope = F.zip_with(F.transform("g", lambda v: v / F.col("t")), F.transform("beta", lambda b, i: F.when((i == 0) | (b == 0), 0.0).otherwise(1e-3 * b)), lambda a, b: a + b)
    left = F.zip_with(slope, "beta", lambda s, b: F.when(b == 0, 0.0).otherwise(F.abs(s)))  # a left-out column has coefficient 0
    return sums.select("fold", "variant", "n", "positives", (F.array_max(left) < 1e-6).alias("at_optimum"), (F.size("beta") - 1).alias("columns"))


@query("ml3_fold_metrics")
def ml3_metrics(d):
    """Fold x model: training prevalence, recent rate, and all logistic models, each tested on the weeks after those it was fitted on."""
    rows, models = fold_models(d)
    val = rows.where("role = 'val'")
    keep = ["fold", "model", "entity", "label", "score"]
    fitted = MM.score_many(val, models, "fold").withColumnRenamed("variant", "model").select(keep)
    rate = dictionary(models.where("variant = 'logistic'").select("fold", (F.col("positives") / F.col("n")).alias("score")), "prevalence")
    base = val.join(rate, "fold").withColumn("model", F.lit("prevalence")).select(keep)
    recent = MO.column_score(val, "recent_rate").withColumn("model", F.lit("recent_rate")).select(keep)
    return M.metric_table(M.Scored(fitted.unionByName(base).unionByName(recent), ("fold", "model"), "entity"))


def variant_roles(d):
    """Rows of each variant: a held-out window is its test set, the earlier four fifths of the others are fitted on and the rest calibrate; ``general`` is cut by time."""
    table = materialize(entity_table(d), "entities")
    cuts = [("train", 0.6), ("cal", 0.8)]
    by_time = materialize(SP.time_ranges(table, "decision_time", "entity", cuts, "test"), "by-time")
    held = SP.leave_window_out(by_time.withColumnRenamed("role", "_range"), "decision_time", SCENARIO_TIMES, 5).withColumnRenamed("fold", "variant_name")
    role = F.when((F.col("role") == "train") & (F.col("_range") == "test"), "cal").otherwise(F.col("role"))
    general = by_time.withColumn("variant_name", F.lit("general"))
    return held.withColumn("role", role).drop("_range").unionByName(general)


@query("ml19_scenario_variants")
def ml19(d):
    rows = FE.scaled_array(materialize(variant_roles(d), "variant-roles"), FEATURES, "variant_name", F.col("role") == "train")
    out = MM.registry(rows.select("variant_name", "role", "entity", "x", "label"), "variant_name", "entity")
    return out.withColumnRenamed("variant_name", "variant").drop("gradient", "beta").withColumn("slope", F.round("slope", 6)).withColumn("intercept", F.round("intercept", 6))


@query("ml19_variant_roles", sql("etab scen", """, var_rank AS (SELECT *, row_number() OVER (ORDER BY decision_time, entity) AS k, count(*) OVER () AS n FROM etab),
  var_time AS (SELECT *, CASE WHEN k <= floor(n * 0.6) THEN 'train' WHEN k <= floor(n * 0.8) THEN 'cal' ELSE 'test' END AS role FROM var_rank),
  var_role AS (SELECT 'general' AS variant, role, label, decision_time FROM var_time UNION ALL SELECT name, CASE WHEN decision_time BETWEEN t_start AND t_end THEN 'test' WHEN role = 'test' THEN 'cal' ELSE 'train' END, label, decision_time
    FROM var_time JOIN scen ON decision_time BETWEEN t_start AND t_end OR decision_time < t_start - 5 OR decision_time > t_end + 5)
  SELECT variant, role, count(*) AS n, count(*) FILTER (label = 1) AS positives, min(decision_time) AS first_time, max(decision_time) AS last_time FROM var_role GROUP BY variant, role"""))
def ml19_roles(d):
    return variant_roles(d).groupBy(F.col("variant_name").alias("variant"), "role").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("positives"), F.min("decision_time").alias("first_time"), F.max("decision_time").alias("last_time")
    )


@query("ml19_variant_lookup", sql("v scen", """SELECT entity, stage, coalesce((SELECT min(name) FROM scen WHERE entry BETWEEN t_start AND t_end), 'general') AS variant FROM v"""))
def ml19_lookup(d):
    names = d.spark.createDataFrame([("general",), *[(n,) for n, _, _ in SCENARIO_TIMES]], "variant STRING")
    cases = F.lit(None).cast("string")
    for n, a, b in sorted(SCENARIO_TIMES, reverse=True):
        cases = F.when(S.in_interval(F.col("entry"), F.lit(a), F.lit(b)), n).otherwise(cases)
    return MO.lookup_variant(names, cases, d.visits).select("entity", "stage", "variant")


def anomaly_run(d):
    seqs = sequence_table(d)
    normal = SP.chronological(J.outside_intervals(seqs, "t_start", SCENARIO_TIMES, margin=3), "window_id", "window_id", 0.7)
    model = MO.fit_sequence_model(normal.where("role = 'train'"))
    known = seqs.join(normal.select("window_id", "role"), "window_id", "left").fillna("scenario", "role")
    scored_ = MO.anomaly_score(MO.reconstruct(model, known, 35), STAGES, 5)
    scored_ = materialize(scored_.drop("sequence", "vec", "actual", "rebuilt"), "anomaly")
    threshold = MO.error_threshold(scored_.where("role = 'val'")).scalar()
    return MO.flag(scored_, threshold)


@query("ml16_sequence_model")
def ml16(d):
    return anomaly_run(d).select("window_id", "t_start", "role", F.round("anomaly_score", 6).alias("anomaly_score"))


@query("ml17_error_threshold", sql("v", "SELECT stage, round(quantile_cont(price / qty, 0.99), 6) AS threshold FROM v GROUP BY stage"))
def ml17(d):
    from stageflow.operators import primitives as P

    e = d.visits.select("stage", (F.col("price") / F.col("qty")).alias("e"))
    return P.quantiles(e, "e", (0.99,), ["stage"]).select("stage", F.round("quantile", 6).alias("threshold"))


@query("ml18_error_attribution", sql("v", """, e AS (SELECT entity, stage, [pow(qty / 50.0 - 0.5, 2), pow(coalesce(disc, 0.0) / 0.1 - 0.5, 2), pow(tax / 0.08 - 0.5, 2), pow(price / 100000.0 - 0.5, 2)] AS q FROM v)
  SELECT entity, stage, round(list_sum(q) / 4.0, 8) AS anomaly_score, round(CASE WHEN list_sum(q) > 0 THEN (q[1] + q[2]) / list_sum(q) ELSE 0.0 END, 8) AS share_a,
  round(CASE WHEN list_sum(q) > 0 THEN (q[3] + q[4]) / list_sum(q) ELSE 0.0 END, 8) AS share_b, list_sum(q) / 4.0 >= 0.12 AS is_anomaly FROM e"""))
def ml18(d):
    actual = F.array(F.col("qty") / 50.0, F.coalesce("disc", F.lit(0.0)) / 0.1, F.col("tax") / 0.08, F.col("price") / 100000.0)
    x = d.visits.select("entity", "stage", actual.alias("actual"), F.array(*[F.lit(0.5)] * 4).alias("rebuilt"))
    out = MO.flag(MO.anomaly_score(x, ("a", "b"), 2), F.lit(0.12))
    return out.select(
        "entity", "stage", F.round("anomaly_score", 8).alias("anomaly_score"), F.round(F.col("contributions")["Sa"], 8).alias("share_a"),
        F.round(F.col("contributions")["Sb"], 8).alias("share_b"), "is_anomaly",
    )


@query("sco5_decision_risk")
def sco5(d):
    """Model risk at the decision stage with causal features only, blended with the entity's own rule risk and the stage's health there."""
    from stageflow.operators import scoring as SCO
    from stageflow.plans.scoring import health

    model, platt, _, test = calibrated_model(d)
    own = SCO.part_risk(health(d)).select("entity", "stage", "cumulative_risk", "health_score")
    out = MO.score_table(model, test, platt).withColumn("stage", F.when(F.col("branch") == 1, 6).otherwise(5)).join(own, ["entity", "stage"], "left")
    cfg = S.ScoreConfig()
    rule, at_stage = F.coalesce("cumulative_risk", F.lit(cfg.base_rate)), F.coalesce("health_score", F.lit(100.0))
    return out.select(
        "entity", "stage", F.round("cumulative_risk", 4).alias("rule_risk"), F.round("health_score", 2).alias("health_score"), "branch", "decision_time", F.col("score").alias("predicted_defect_prob"),
        (F.col("score") >= 0.05).alias("is_high_risk"), S.blended_risk(rule, at_stage, F.col("score"), cfg).alias("composite_risk"),
        F.lit("general").alias("scenario_model"), F.col("label").alias("ground_truth"),
    )


@query("sco6_window_anomaly")
def sco6(d):
    """Window metrics, sequences and anomaly score with per-stage attribution."""
    out = anomaly_run(d)
    return out.select(
        "window_id", "t_start", F.round("anomaly_score", 6).alias("anomaly_score"), F.round("threshold_p99", 6).alias("threshold_p99"), "is_anomaly",
        *[F.round(F.col("contributions")[f"S{s}"], 6).alias(f"attr_S{s}") for s in STAGES],
    )
