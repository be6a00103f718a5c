"""Statistics, scan and ranking queries."""

from pyspark.sql import functions as F

from stageflow.functions import stats as ST
from stageflow.operators import joins as J
from stageflow.operators import quality as Q
from stageflow.operators import scan as SC
from stageflow.operators import visits as V
from stageflow.plans.flow import rounded
from stageflow.plans.profile_quality import SCENARIO_TIMES
from stageflow.plans.registry import cte, query, sql
from stageflow.plans.scalars import erfc_sql
from stageflow.sources import io
from stageflow.sources.tables import DAY_MINUTES, SENSORS, stage_rank

# Window lengths of the scans in days, with the thresholds that suit day-based tables.
WINDOWS = (("1w", 7), ("2w", 14), ("3w", 21))
SURGE = {"step": 7, "min_n": 15, "min_defects": 5, "min_ratio": 1.4}
DRIFT = {"step": 14, "min_n": 15, "min_z": 0.45}
EVENTS = (("E1", 400, 460, [1, 2]), ("E2", 900, 990, [3]), ("E3", 1500, 1530, [5, 6]), ("E4", 2000, 2200, [1, 2, 3]))


def event_windows(d):
    return io.parameter_table(d.spark, EVENTS, "event_id STRING, t_start LONG, t_end LONG, stages ARRAY<INT>")


cte("win", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {w})" for n, w in WINDOWS) + ") w(win, width)")
cte("evw", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}, {b}, {s})" for n, a, b, s in EVENTS) + ") e(event_id, t_start, t_end, stages)")


def bh_sql(source: str) -> str:
    return f"""SELECT *, min(least(1.0, raw_p * n_all / k)) OVER (ORDER BY raw_p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS adj_p
  FROM (SELECT *, count(*) OVER () AS n_all, count(*) OVER (ORDER BY raw_p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM {source})"""


def _grid(keys, src, step, cols):
    k = ", ".join(keys)
    on = " AND ".join(f"g.{c} = e.{c}" for c in keys)
    gk = ", ".join(f"g.{c}" for c in keys)
    return f"""gb AS (SELECT {k}, min(entry) AS t0, max(entry) AS t1 FROM {src} GROUP BY {k}),
  gg AS (SELECT {k}, win, width, t0, unnest(generate_series(0, CAST(ceil((t1 - width - t0) / {step}) AS BIGINT) - 1)) AS i FROM gb, win),
  grid AS (SELECT {gk}, g.win, g.t0 + g.i * {step} AS t_start, g.t0 + g.i * {step} + g.width AS t_end, {cols} FROM gg g
    JOIN ticks e ON {on} AND e.entry >= g.t0 + g.i * {step} AND e.entry < g.t0 + g.i * {step} + g.width GROUP BY ALL)"""


_BZ = "((defects - 0.5 - n * base) / sqrt(n * base * (1.0 - base)))"
cte("surge", f"""WITH ticks AS (SELECT stage, entry, count(*) AS c, sum(label) AS d FROM lv GROUP BY 1, 2),
  {_grid(["stage"], "lv", SURGE["step"], "CAST(sum(e.c) AS BIGINT) AS n, CAST(sum(e.d) AS BIGINT) AS defects")},
  bs AS (SELECT stage, sum(label) / count(*) AS base FROM lv GROUP BY stage),
  h AS (SELECT grid.*, base, defects / n AS observed_rate, defects / n / base AS ratio FROM grid JOIN bs USING (stage) WHERE n >= {SURGE["min_n"]} AND defects >= {SURGE["min_defects"]}),
  c AS (SELECT *, CASE WHEN defects <= n * base THEN 1.0 ELSE greatest(0.0, least(1.0, 0.5 * {erfc_sql(f"({_BZ} / {ST.SQRT2!r})")})) END AS raw_p FROM h WHERE ratio >= {SURGE["min_ratio"]})
  {bh_sql("c")}""", ["lv", "win"])
_DZ = f"((abs(observed_mean - mu) / (sigma / sqrt(n))) / {ST.SQRT2!r})"
cte("drift", f"""WITH ticks AS (SELECT stage, feature, entry, count(*) AS c, sum(value) AS s FROM sens GROUP BY 1, 2, 3),
  {_grid(["stage", "feature"], "sens", DRIFT["step"], "CAST(sum(e.c) AS BIGINT) AS n, sum(e.s) / sum(e.c) AS observed_mean")},
  bs AS (SELECT stage, feature, avg(value) AS mu, stddev_pop(value) AS sigma FROM sens GROUP BY stage, feature HAVING count(*) >= 200 AND stddev_pop(value) > 0),
  h AS (SELECT grid.*, mu, sigma, (observed_mean - mu) / sigma AS z FROM grid JOIN bs USING (stage, feature) WHERE n >= {DRIFT["min_n"]}),
  c AS (SELECT *, least(1.0, {erfc_sql(_DZ)}) AS raw_p FROM h WHERE abs(z) >= {DRIFT["min_z"]})
  {bh_sql("c")}""", ["sens", "win"])


def surges(d):
    d.stored("visits")
    return SC.surge_scan(d.labelled_visits, WINDOWS, **SURGE)


def drifts(d):
    d.stored("visits")
    return SC.drift_scan(d.sensor_values, WINDOWS, **DRIFT)


@query("stat4_surge_scan", sql("surge", """SELECT stage, win AS "window", t_start, t_end, n, defects, round(observed_rate, 6) AS observed_rate, round(base, 6) AS baseline_rate, round(ratio, 6) AS ratio,
  round(raw_p, 9) AS raw_p, round(adj_p, 9) AS adj_p FROM surge"""))
def stat4(d):
    out = rounded(rounded(surges(d), "observed_rate", "baseline_rate", "ratio"), "raw_p", "adj_p", digits=9)
    return out.select("stage", "window", "t_start", "t_end", "n", "defects", "observed_rate", "baseline_rate", "ratio", "raw_p", "adj_p")


@query("stat5_drift_scan", sql("drift", """SELECT stage, feature, win AS "window", t_start, t_end, n, round(mu, 5) AS mu, round(sigma, 5) AS sigma, round(z, 6) AS z,
  round(raw_p, 8) AS raw_p, round(adj_p, 8) AS adj_p FROM drift"""))
def stat5(d):
    out = rounded(rounded(rounded(drifts(d), "z"), "mu", "sigma", digits=5), "raw_p", "adj_p", digits=8)
    return out.select("stage", "feature", "window", "t_start", "t_end", "n", "mu", "sigma", "z", "raw_p", "adj_p")


@query("stat2_bh_adjustment", sql("lv", f""", w AS (SELECT stage, CAST(floor(entry / 7.0) AS INTEGER) AS period, count(*) AS n, CAST(sum(label) AS BIGINT) AS k FROM lv GROUP BY 1, 2),
  c AS (SELECT stage, period, round(0.5 * {erfc_sql(f"(((k - n * 0.3) / sqrt(n * 0.3 * 0.7)) / {ST.SQRT2!r})")}, 9) AS raw_p FROM w)
  SELECT stage, period, raw_p, round(adj_p, 8) AS adj_p FROM ({bh_sql("c").replace(" AS k FROM", " AS k FROM")})"""))
def stat2(d):
    from stageflow.plans.scalars import _weekly

    z = ST.binomial_z(F.col("k"), F.col("n"), F.lit(0.3))
    c = rounded(_weekly(d).select("stage", "period", ST.upper_tail(z).alias("raw_p")), "raw_p", digits=9)
    return rounded(SC.adjust_p(c), "adj_p", digits=8).select("stage", "period", "raw_p", "adj_p")




def surge_order():
    return [F.round("adj_p", 9), -F.round("ratio", 6), F.col("t_start"), F.col("stage"), F.col("t_end")]


def drift_order():
    return [F.round("adj_p", 8), -F.round(F.abs("z"), 6), F.col("t_start"), F.col("stage"), F.col("feature"), F.col("t_end")]


def greedy_sql(name: str, source: str, keys: list[str], order: str, gap: int, top: int) -> str:
    """Sub-queries that take the rows of ``source`` in order and keep the first ``top`` that have no kept neighbour of their key."""
    same = " AND ".join(f"x.{k} = r.{k}" for k in keys)
    return f"""{name}_r AS (SELECT *, row_number() OVER (ORDER BY {order}) AS pos FROM {source}),
  {name}_g AS (SELECT CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS kept UNION ALL
    SELECT r.pos, CASE WHEN len(g.kept) < {top} AND NOT EXISTS (SELECT 1 FROM {name}_r x WHERE list_contains(g.kept, x.pos) AND {same} AND abs(x.t_start - r.t_start) < {gap}) THEN list_append(g.kept, r.pos) ELSE g.kept END
    FROM {name}_g g JOIN {name}_r r ON r.pos = g.pos + 1 WHERE len(g.kept) < {top}),
  {name} AS (SELECT * FROM {name}_r WHERE list_contains((SELECT kept FROM {name}_g ORDER BY pos DESC LIMIT 1), pos))"""


SURGE_ORDER_SQL = "round(adj_p, 9), -round(ratio, 6), t_start, stage, t_end"
DRIFT_ORDER_SQL = "round(adj_p, 8), -round(abs(z), 6), t_start, stage, feature, t_end"


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query("srt4_separate_windows", recursive(sql("surge", f""", {greedy_sql("chosen", "surge", ["stage"], SURGE_ORDER_SQL, 10, 4)}
  SELECT stage, win AS "window", t_start, t_end, n, defects, round(ratio, 6) AS ratio, round(adj_p, 6) AS adj_p FROM chosen""")))
def srt4(d):
    chosen = SC.separate_windows(surges(d), ("stage",), surge_order(), 10, 4)
    return rounded(chosen, "ratio", "adj_p").select("stage", "window", "t_start", "t_end", "n", "defects", "ratio", "adj_p")


@query("srt5_master_ranking", recursive(sql("surge drift", f""", {greedy_sql("cs", "surge", ["stage"], SURGE_ORDER_SQL, 10, 4)}, {greedy_sql("cd", "drift", ["stage", "feature"], DRIFT_ORDER_SQL, 10, 4)},
  u AS (SELECT 0 AS kind, 'Defect Rate Surge' AS anomaly_type, stage, 'label' AS feature, t_start, t_end, n, CAST(defects AS BIGINT) AS failures, observed_rate AS observed, base AS baseline, ratio AS effect, adj_p FROM cs
    UNION ALL SELECT 1, 'Measurement Drift', stage, feature, t_start, t_end, n, NULL, observed_mean, mu, z, adj_p FROM cd)
  SELECT anomaly_type, stage, feature, t_start, t_end, n, failures, round(observed, 5) AS observed, round(baseline, 5) AS baseline, round(effect, 6) AS effect, round(adj_p, 6) AS adj_p,
    CAST(row_number() OVER (ORDER BY kind, round(adj_p, 8), round(abs(effect), 6) DESC, t_start, stage, feature) AS INTEGER) AS rank FROM u""")))
def srt5(d):
    s = SC.separate_windows(surges(d), ("stage",), surge_order(), 10, 4)
    r = SC.separate_windows(drifts(d), ("stage", "feature"), drift_order(), 10, 4)
    return rounded(rounded(SC.master_ranking(s, r), "effect", "adj_p"), "observed", "baseline", digits=5)


_EZ = f"(((failures - entities * b) / sqrt(entities * b * (1.0 - b))) / {ST.SQRT2!r})"


@query("agg35_window_evaluation", sql("lv lab evw", f""", p AS (SELECT event_id, t_start, t_end, entity, max(label) AS y FROM lv JOIN evw ON list_contains(stages, stage) AND entry BETWEEN t_start AND t_end GROUP BY ALL),
  o AS (SELECT event_id, t_start, t_end, count(*) AS entities, CAST(sum(y) AS BIGINT) AS failures, (SELECT avg(label) FROM lab) AS b FROM p GROUP BY ALL)
  SELECT event_id, t_start, t_end, entities, failures, round(entities * b, 4) AS expected, round(failures - entities * b, 4) AS excess, round(failures / greatest(0.000001, entities * b), 6) AS oe_ratio,
  round(failures * 100.0 / entities, 6) AS rate_pct, round(0.5 * {erfc_sql(_EZ)}, 9) AS p_value FROM o"""))
def agg35(d):
    ev = event_windows(d)
    out = SC.evaluate_windows(d.labelled_visits, ev, Q.base_rate(d.labels))
    out = rounded(rounded(rounded(out, "oe_ratio", "rate_pct"), "expected", "excess", digits=4), "p_value", digits=9)
    return out.withColumn("t_start", F.col("t_start").cast("int")).withColumn("t_end", F.col("t_end").cast("int"))


@query("agg36_failure_overlap", sql("lv evw", """, p AS (SELECT event_id, len(stages) AS need, entity, count(DISTINCT stage) AS s FROM lv JOIN evw ON list_contains(stages, stage) AND entry >= t_start AND entry < t_end WHERE label = 1 GROUP BY ALL)
  SELECT event_id, count(*) FILTER (s = need) AS at_all, count(*) AS at_any, round(count(*) FILTER (s = need) * 100.0 / count(*), 6) AS shared_pct FROM p GROUP BY event_id"""))
def agg36(d):
    return rounded(SC.failure_overlap(d.labelled_visits, event_windows(d)), "shared_pct")


SLOW = (("A", 2, 400, 600), ("B", 2, 1200, 1210), ("C", 4, 900, 1400))


@query("agg37_slowdown_analysis", sql("v", """, q AS (SELECT * FROM (VALUES ('A', 2, 400, 600), ('B', 2, 1200, 1210), ('C', 4, 900, 1400)) q(win, st, a, b)),
  b0 AS (SELECT stage, quantile_cont(duration, 0.5) * 1440.0 AS base_p50, quantile_cont(duration, 0.99) * 1440.0 AS base_p99 FROM v GROUP BY stage),
  h AS (SELECT win, v.stage, duration * 1440.0 AS dd, row_number() OVER (PARTITION BY win ORDER BY duration DESC) AS k, base_p50, base_p99 FROM v JOIN q ON v.stage = st AND entry >= a AND entry < b JOIN b0 ON b0.stage = v.stage)
  SELECT win AS "window", stage, count(*) AS n, round(avg(dd), 4) AS mean, quantile_cont(dd, 0.5) AS median, round(max(base_p50), 4) AS base_p50, round(max(base_p99), 4) AS base_p99,
  count(*) FILTER (dd > base_p99) AS n_above, round(count(*) FILTER (dd > base_p99) * 100.0 / count(*), 6) AS above_pct, max(dd) AS top1, coalesce(max(dd) FILTER (k = 2), 0.0) AS top2,
  round(CASE WHEN count(*) > 2 THEN (sum(dd) - max(dd) - max(dd) FILTER (k = 2)) / (count(*) - 2) ELSE 0.0 END, 4) AS mean_without_top2,
  count(*) FILTER (dd > base_p99) <= 4 AND max(dd) > max(base_p99) * 5.0 AS outlier_driven FROM h GROUP BY win, stage"""))
def agg37(d):
    w = io.parameter_table(d.spark, SLOW, "window STRING, stage INT, t_start LONG, t_end LONG")
    out = SC.slowdown(d.visits, w, DAY_MINUTES)
    return rounded(rounded(out, "above_pct"), "mean", "base_p50", "base_p99", "mean_without_top2", digits=4)


@query("agg38_binned_timeline", sql("lv sens", """, a AS (SELECT stage, entry // 30 AS bin, count(*) AS n, CAST(sum(label) AS BIGINT) AS defects FROM lv GROUP BY 1, 2),
  b AS (SELECT stage, entry // 30 AS bin, feature, avg(value) AS mean_value FROM sens GROUP BY 1, 2, 3),
  g AS (SELECT stage, unnest(generate_series(lo, hi)) AS bin FROM (SELECT stage, min(bin) AS lo, max(bin) AS hi FROM a GROUP BY stage)), f AS (SELECT DISTINCT stage, feature FROM b)
  SELECT g.stage, f.feature, g.bin, coalesce(n, 0) AS n, coalesce(defects, 0) AS defects, round(defects / n, 6) AS rate, round(mean_value, 6) AS mean_value
  FROM g JOIN f ON f.stage = g.stage LEFT JOIN a ON a.stage = g.stage AND a.bin = g.bin LEFT JOIN b ON b.stage = g.stage AND b.bin = g.bin AND b.feature = f.feature"""))
def agg38(d):
    return rounded(SC.binned_timeline(d.labelled_visits, d.sensor_values, 30), "rate", "mean_value")


@query("stat3_autocorrelation", sql("v", """, h AS (SELECT entry // 1 AS bin, count(*) AS n FROM v GROUP BY 1), g AS (SELECT unnest(generate_series(lo, hi)) AS bin FROM (SELECT min(bin) AS lo, max(bin) AS hi FROM h)),
  d AS (SELECT bin, coalesce(n, 0) - (SELECT avg(coalesce(n, 0)) FROM g LEFT JOIN h USING (bin)) AS x FROM g LEFT JOIN h USING (bin))
  SELECT CAST(lag AS INTEGER) AS lag, round(sum(a.x * b.x) / (SELECT sum(x * x) FROM d), 8) AS acf FROM (SELECT unnest(generate_series(5, 60)) AS lag) l JOIN d a ON true JOIN d b ON a.bin = b.bin + lag GROUP BY lag"""))
def stat3(d):
    return rounded(SC.autocorrelation(d.visits, "entry", 1, range(5, 61)), "acf", digits=8)


@query("stat6_production_gaps", sql("v", """SELECT stage, prev AS gap_start, entry AS gap_end, entry - prev AS gap FROM (SELECT stage, entry, lag(entry) OVER (PARTITION BY stage ORDER BY entry) AS prev
  FROM (SELECT DISTINCT stage, entry FROM v)) WHERE entry - prev > 2"""))
def stat6(d):
    return SC.production_gaps(d.visits, "entry", 2, ("stage",))


def scenario_slice(d):
    """STAT7: replay rows of every scenario window, transits recomputed inside the slice, in message order."""
    inside = J.in_intervals(d.visits, "entry", SCENARIO_TIMES).withColumnRenamed("name", "scenario")
    ranked = inside.withColumn("key", F.concat_ws("|", "scenario", F.col("entity").cast("string"))).withColumn("stage_rank", stage_rank(F.col("stage")).cast("int"))
    moved = V.transit_from_previous(ranked, "key", "stage_rank", "entry", DAY_MINUTES)
    return moved.join(d.labels, "entity", "left").select(
        "scenario", "entity", "stage", "stage_rank", F.col("entry").alias("t"), (F.col("entry") * 24.0).alias("t_hours"), "transit_minutes",
        F.to_json(V.sensor_map(SENSORS)).alias("features_json"), (F.col("stage") == 1).alias("is_entry"), (F.col("stage") == 7).alias("is_exit"),
        F.when(F.col("stage") == 7, F.coalesce("label", F.lit(0))).otherwise(-1).alias("response"), F.coalesce("label", F.lit(0)).alias("ground_truth"),
    )


@query("stat7_scenario_slice", sql("ranked_v lab scen", """SELECT name AS scenario, entity, stage, stage_rank, entry AS t, entry * 24.0 AS t_hours,
  coalesce(greatest(0.0, (entry - lag(entry) OVER (PARTITION BY name, entity ORDER BY stage_rank, entry, stage)) * 1440.0), 0.0) AS transit_minutes,
  qty AS f_qty, disc AS f_disc, stage = 1 AS is_entry, stage = 7 AS is_exit, CASE WHEN stage = 7 THEN coalesce(label, 0) ELSE -1 END AS response, coalesce(label, 0) AS ground_truth
  FROM ranked_v JOIN scen ON entry BETWEEN t_start AND t_end LEFT JOIN lab USING (entity)"""))
def stat7(d):
    out = scenario_slice(d)
    j = F.col("features_json")
    return out.withColumn("f_qty", F.get_json_object(j, "$.qty").cast("double")).withColumn(
        "f_disc", F.get_json_object(j, "$.disc").cast("double")
    ).drop("features_json").orderBy("scenario", "t", "stage_rank", "entity")
