"""Point table, dashboard and alert queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stageflow.functions.timescale import DAY_SCALE
from stageflow.operators import models as MO
from stageflow.operators import monitor as MN
from stageflow.operators import points as PT
from stageflow.operators import primitives as P
from stageflow.operators import scoring as SCO
from stageflow.plans.flow import rounded
from stageflow.plans.learning import entity_table, window_metrics
from stageflow.plans.registry import cte, query, sql
from stageflow.plans.scoring import health
from stageflow.session import materialize
from stageflow.sources.tables import STAGES

BASE_US = 788918400000000  # 1995-01-01
WEEK = "7 days"


def at(days):
    return DAY_SCALE.to_timestamp(days, BASE_US)


def station(c):
    return F.concat(F.lit("S"), c.cast("string"))


def _topic(kind, c):
    prefix, suffix = {"telemetry": ("factory/line3/", "/telemetry"), "health": ("factory/line3/", "/health"), "risk": ("factory/line3/parts/", "/risk")}[kind]
    return F.concat(F.lit(prefix), c, F.lit(suffix))


def number():
    return F.col("entity") * 8 + F.col("stage")


def telemetry_messages(d):
    m = d.messages
    return PT.message(
        m, _topic("telemetry", station(F.col("stage"))), at(F.col("t")), number(), part_id=F.col("entity"), station_id=station(F.col("stage")), sim_time=F.col("t"),
        sim_time_hours=F.col("t") * 24.0, transit_minutes=F.col("transit_minutes"), features=F.col("features"), is_entry=F.col("is_entry"), is_exit=F.col("is_exit"), response=F.col("response"),
    )


def health_messages(h):
    return PT.message(
        h, _topic("health", station(F.col("stage"))), at(F.col("t")), number(), station_id=station(F.col("stage")), sim_time=F.col("t"), health_score=F.col("health_score"),
        feature_drift_score=F.col("feature_drift_score"), transit_pacing_score=F.col("transit_pacing_score"), defect_rate_score=F.col("defect_rate_score"), status=F.col("status"),
        active_features_count=F.col("n_features"), parts_processed_window=F.col("window_parts"), observed_defect_rate=F.col("observed_defect_rate"),
    )


def risk_messages(r):
    return PT.message(
        r, _topic("risk", F.col("entity").cast("string")), at(F.col("t")), number(), part_id=F.col("entity"), current_station=station(F.col("stage")), sim_time=F.col("t"),
        cumulative_risk=F.col("cumulative_risk"), risk_level=F.col("risk_level"), cumulative_anomalies=F.col("cumulative_anomalies"), ground_truth_response=F.col("response"),
    )


def overview_messages(o):
    return PT.message(
        o, F.lit("factory/line3/overview"), at(F.col("t")), F.col("total_completed"), sim_time=F.col("t"), active_parts_in_line=F.col("active_parts"), total_parts_entered=F.col("total_entered"),
        total_parts_completed=F.col("total_completed"), total_defects_observed=F.col("total_defects"), cumulative_defect_rate=F.col("cumulative_defect_rate"),
        rolling_throughput_per_hr=F.col("rolling_throughput_per_hr"), line_average_health=F.col("line_average_health"),
    )


def decision_messages(d):
    """Predictions of the single-feature model: the recent failure rate, a third of which is the alarm level here."""
    e = entity_table(d)
    return PT.message(
        e, F.lit("twin/ai/part_risk"), at(F.col("decision_time")), F.col("entity"), part_id=F.col("entity"), station_id=F.when(F.col("branch") == 1, "S6").otherwise("S5"), branch=F.col("branch"),
        decision_time=F.col("decision_time"), predicted_defect_prob=F.col("recent_rate"), is_high_risk=F.col("recent_rate") >= 0.33, scenario_model=F.lit("general"), ground_truth_response=F.col("label"),
    )


def window_messages(d):
    w = window_metrics(d)
    return PT.message(
        w, F.lit("twin/ai/window"), at(F.col("t_end")), F.col("window_id") * 8 + F.col("stage"), station_id=station(F.col("stage")), throughput=F.col("throughput"),
        zero_delta_share=F.col("zero_delta_share"), max_abs_z=F.col("max_abs_z"), mean_abs_z=F.col("mean_abs_z"), p90_transit=F.col("p90_transit"),
    )


def anomaly_messages(d):
    """Anomaly messages of a fixed reconstruction: every stage is expected to see 20 entities per window."""
    counts = d.visits.groupBy((F.floor(F.col("entry") / 7)).cast("long").alias("window_id")).agg(*[F.count_if(F.col("stage") == s).alias(f"c{s}") for s in STAGES])
    x = counts.select("window_id", F.array(*[F.col(f"c{s}") / 20.0 for s in STAGES]).alias("actual"), F.array(*[F.lit(1.0)] * len(STAGES)).alias("rebuilt"))
    s = MO.flag(MO.anomaly_score(x, STAGES, 1), F.lit(0.05))
    return PT.message(
        s, F.lit("twin/ai/anomaly"), at((F.col("window_id") + 1) * 7), F.col("window_id"), scenario_model=F.lit("general"), anomaly_score=F.round("anomaly_score", 8), threshold_p99=F.col("threshold_p99"),
        is_anomaly=F.col("is_anomaly"), station_contributions=F.transform_values("contributions", lambda _, v: F.round(v, 8)),
    )


# Point tables written in this session: (application, data folder, its state, kind) -> table.
_TABLES: dict[tuple[str, str, str, str], DataFrame] = {}


def freshness(d) -> str:
    """Changes when a file of the tables behind the points is added, removed or rewritten."""
    out = []
    for name in ("lineitem", "orders"):
        meta = d.table(name).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        out.append(str(meta.agg(F.count(F.lit(1)), F.sum("file_size"), F.max("file_modification_time"), F.sum(F.xxhash64("file_path").cast("decimal(38,0)"))).first()))
    return " ".join(out)


# What the messages of stage health, risk and overview read of the scored visits.
SCORED = ("entity", "stage", "stage_rank", "t", "life", "visit_no", "is_first", "is_entry", "is_exit", "response", "n_features", "window_parts", "anomalous", "health_score",
          "feature_drift_score", "transit_pacing_score", "defect_rate_score", "status", "observed_defect_rate")


def scored_table(d, key):
    """The scored visits, written once per session and state of the data for all kinds that need them."""
    if key not in _TABLES:
        _TABLES[key] = materialize(health(d).select(*SCORED), "health")
    return _TABLES[key]


def message_tables(d, kinds, scored_visits):
    """(kind, messages) pairs; the three kinds that need stage health share one health table."""
    scored = [k for k in ("health", "risk", "overview") if k in kinds]
    if scored:
        h = scored_visits()
        build = {"health": lambda: health_messages(h), "risk": lambda: risk_messages(SCO.part_risk(h)), "overview": lambda: overview_messages(SCO.line_overview(h, 24.0))}
        yield from ((k, build[k]()) for k in scored)
    plain = {"telemetry": telemetry_messages, "decision": decision_messages, "window": window_messages, "anomaly": anomaly_messages}
    yield from ((k, plain[k](d)) for k in kinds if k in plain)


#: The measurement that the messages of a kind become.
MEASURED = {"telemetry": "station_telemetry", "health": "station_health", "risk": "part_risk", "overview": "line_overview", "decision": "ai_part_risk", "window": "ai_window", "anomaly": "ai_anomaly"}


def points(d, *kinds, write=True):
    """The point table a dashboard reads: one written table per message kind, made once per session and state of the data.

    A reader that takes all points once needs no copy of them: without ``write``, kinds that aren't written yet go from message to point to the reader."""
    state = freshness(d)
    key = lambda k: (d.spark.sparkContext.applicationId, d.sf_dir, state, k)
    tables = {k: _TABLES[key(k)] for k in kinds if key(k) in _TABLES}
    for k, messages in message_tables(d, [k for k in kinds if k not in tables], lambda: scored_table(d, key("scored"))):
        tables[k] = PT.to_points(messages, names=[MEASURED[k]])
        if write:
            tables[k] = _TABLES[key(k)] = materialize(tables[k], f"points-{k}")
    out = tables[kinds[0]]
    for k in kinds[1:]:
        out = out.unionByName(tables[k])
    return out


def us(df, c="ts"):
    return df.withColumn("us", F.unix_micros(c)).drop(c)


T_SQL = f"({BASE_US} + {{}} * 86400000000)"
cte("hm", f"SELECT entity * 8 + stage AS seq, {T_SQL.format('t')} AS us, 'S' || stage AS station_id, health_score, round(sd, 2) AS drift, round(sp, 2) AS pacing, round(observed_rate * 100.0, 4) AS obs, status, n_features, window_parts FROM health", ["health"])
WEEK_END = "(us // 604800000000 + 1) * 604800000000"


@query("snk5_points_telemetry", sql("m", f"""SELECT entity * 8 + stage AS seq, {T_SQL.format('t')} AS us, 'station_telemetry' AS measurement, 'S' || stage AS station_id,
  CASE WHEN is_exit THEN 'True' ELSE 'False' END AS is_exit, CAST(entity AS DOUBLE) AS part_id, round(transit_minutes, 4) AS transit_minutes, CAST(response AS DOUBLE) AS response, qty, disc,
  5 - CAST(response IS NULL AS INT) + CAST(qty IS NOT NULL AS INT) + CAST(price IS NOT NULL AS INT) + CAST(disc IS NOT NULL AS INT) + CAST(tax IS NOT NULL AS INT) AS n_fields FROM m"""))
def snk5(d):
    p = us(PT.to_points(telemetry_messages(d)))
    f, t = F.col("fields"), F.col("tags")
    return p.select(
        "seq", "us", "measurement", t["station_id"].alias("station_id"), t["is_exit"].alias("is_exit"), f["part_id"].alias("part_id"), F.round(f["transit_minutes"], 4).alias("transit_minutes"),
        f["response"].alias("response"), f["qty"].alias("qty"), f["disc"].alias("disc"), F.size(f).alias("n_fields"),
    )


cte("anom", """SELECT w AS window_id, list_transform(c, lambda x: pow(x / 20.0 - 1.0, 2)) AS e FROM (SELECT entry // 7 AS w, [""" + ", ".join(f"count(*) FILTER (stage = {s})" for s in STAGES) + "] AS c FROM v GROUP BY 1)", ["v"])


def counts_sql() -> str:
    """Points by measurement and field, counted in the tables behind the messages: all rows, or those that have the value."""
    every = {
        "health": ("station_health", "health_score feature_drift_score transit_pacing_score defect_rate_score active_features_count parts_processed_window observed_defect_rate"),
        "etab": ("ai_part_risk", "decision_time predicted_defect_prob ground_truth_response"),
        "wm": ("ai_window", "throughput zero_delta_share max_abs_z mean_abs_z p90_transit"),
        "anom": ("ai_anomaly", "anomaly_score threshold_p99 " + " ".join(f"attr_S{s}" for s in STAGES)),
        "(SELECT * FROM m WHERE is_exit)": ("line_overview", "active_parts_in_line total_parts_entered total_parts_completed total_defects_observed cumulative_defect_rate rolling_throughput_per_hr line_average_health"),
    }
    parts = [f"SELECT '{name}' AS measurement, unnest({fields.split()}) AS field, count(*) AS n FROM {t}" for t, (name, fields) in every.items()]
    values = {"station_telemetry": "part_id=* sim_time=* sim_time_hours=* transit_minutes=* response=response qty=qty price=price disc=disc tax=tax", "part_risk": "cumulative_risk=* cumulative_anomalies=* ground_truth_response=response"}
    for name, fields in values.items():
        parts += [f"SELECT '{name}', '{f}', count({c}) FROM m" for f, c in (x.split("=") for x in fields.split())]
    return " UNION ALL ".join(parts)


ALL_POINTS_SQL = sql("m health etab wm anom", counts_sql())
MEASUREMENTS = ("telemetry", "health", "risk", "overview", "decision", "window", "anomaly")


@query("snk5_points_all_measurements", ALL_POINTS_SQL)
def snk5_all(d):
    return MN.point_counts(points(d, *MEASUREMENTS, write=False))


cte("ovr", """WITH tot AS (SELECT entity, t, pos, is_exit, CAST(sum(CAST(is_exit AS INT)) OVER w AS BIGINT) AS completed, CAST(sum(CAST(is_exit AND coalesce(response, 0) = 1 AS INT)) OVER w AS BIGINT) AS defects FROM ml WINDOW w AS (ORDER BY pos)),
  th AS (SELECT entity, CASE WHEN n >= 2 AND (t - t0) * 24.0 > 0.01 THEN round(n / ((t - t0) * 24.0), 1) ELSE 0.0 END AS thr FROM (
    SELECT entity, t, count(*) OVER w AS n, min(t) OVER w AS t0 FROM m WHERE is_exit WINDOW w AS (ORDER BY t, entity ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)))
  SELECT tot.t, completed, round(defects / completed * 100.0, 3) AS rate, thr, round(avg_health, 1) AS h FROM tot JOIN th USING (entity) JOIN win9c w ON w.pos = tot.pos WHERE tot.is_exit""", ["ml", "m", "win9c"])


@query("mon1_line_kpis", sql("ovr", "SELECT arg_max(h, completed) AS line_average_health, arg_max(thr, completed) AS rolling_throughput_per_hr, arg_max(rate, completed) AS cumulative_defect_rate, CAST(max(completed) AS DOUBLE) AS total_parts_completed FROM ovr"))
def mon1(d):
    return MN.line_kpis(points(d, "overview"))


@query("mon2_health_series", sql("hm", f"SELECT {WEEK_END} AS us, station_id, round(avg(health_score), 9) AS value FROM hm GROUP BY 1, 2"))
def mon2(d):
    return us(rounded(MN.health_series(points(d, "health"), WEEK), "value", digits=9))


@query("mon3_latest_health", sql("hm", "SELECT station_id, arg_max(health_score, us * 1000000 + seq) AS value FROM (SELECT station_id, health_score, CAST(us AS HUGEINT) AS us, seq FROM hm) GROUP BY station_id"))
def mon3(d):
    return MN.latest_health(points(d, "health"))


@query("mon4_stage_detail", sql("hm", """SELECT health_score, drift AS feature_drift_score, pacing AS transit_pacing_score, obs AS observed_defect_rate FROM hm WHERE station_id = 'S3' ORDER BY us DESC, seq DESC LIMIT 1"""))
def mon4(d):
    return MN.stage_detail(points(d, "health"), "S3")


@query("mon5_sensor_series", sql("m", f""", u AS (SELECT {T_SQL.format('t')} AS us, unnest(['qty', 'price', 'disc', 'tax']) AS field, unnest([qty, price, disc, tax]) AS value FROM m WHERE stage = 3)
  SELECT {WEEK_END} AS us, field, round(avg(value), 9) AS value FROM u WHERE value IS NOT NULL AND regexp_matches(field, '^(qty|tax)') GROUP BY 1, 2"""))
def mon5(d):
    return us(rounded(MN.sensor_series(points(d, "telemetry"), "S3", "^(qty|tax)", WEEK), "value", digits=9))


@query("mon6_transit_series", sql("m", f"SELECT {T_SQL.format('t')} AS us, entity * 8 + stage AS seq, 'S3' AS station_id, round(transit_minutes, 4) AS value FROM m WHERE stage = 3"))
def mon6(d):
    return us(rounded(MN.transit_series(points(d, "telemetry"), "S3"), "value", digits=4))


_RISK2 = "CAST(round(CAST(greatest(0.005069, least(0.99, (least(1.0, ca * 0.22) * 0.5 + greatest(0.0, (100.0 - health_score) / 100.0) * 0.3) / 0.8)) AS DECIMAL(18, 10)), 4) AS DOUBLE)"
cte("rk", f"""SELECT entity, stage, t, response, {T_SQL.format('t')} AS us, entity * 8 + stage AS seq, risk, CASE WHEN risk < 0.3 THEN 'LOW' WHEN risk < 0.7 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM (
  SELECT *, {_RISK2} AS risk FROM (SELECT health.*, cumulative_anomalies AS ca FROM health JOIN hist USING (entity, stage)))""", ["health", "hist"])


@query("mon7_risk_counts", sql("rk", "SELECT count(*) FILTER (level = 'HIGH') AS high, count(*) FILTER (level = 'MEDIUM') AS medium, count(*) FILTER (response = 1) AS confirmed FROM rk"))
def mon7(d):
    return MN.risk_counts(points(d, "risk", "telemetry"))


@query("mon8_risk_trend", sql("rk", f"SELECT {WEEK_END} AS us, round(avg(risk), 12) AS mean_risk, max(risk) AS peak_risk FROM rk GROUP BY 1"))
def mon8(d):
    return us(rounded(MN.risk_trend(points(d, "risk"), WEEK), "mean_risk", digits=12))


@query("mon9_watchlist", sql("rk", "SELECT us, CAST(entity AS VARCHAR) AS part_id, 'S' || stage AS station, level AS risk_level, risk AS risk_score FROM rk WHERE risk > 0.2 ORDER BY us DESC, seq DESC LIMIT 20"))
def mon9(d):
    return us(MN.watchlist(points(d, "risk"), 0.2))


@query("mon10_model_status", sql("etab", "SELECT 'general' AS scenario_model, CAST(max(decision_time) AS DOUBLE) AS last_decision, count(*) AS predictions FROM etab"))
def mon10(d):
    return MN.model_status(points(d, "decision"))


@query("mon11_predicted_vs_observed", sql("etab ovr", f"""SELECT 'Predicted Risk (P)' AS field, {WEEK_END} AS us, round(avg(p), 5) AS value FROM (SELECT {T_SQL.format('decision_time')} AS us, recent_rate AS p FROM etab) GROUP BY 2
  UNION ALL SELECT 'Line Observed Defect Rate', {T_SQL.format('t')}, round(rate / 100.0, 5) FROM ovr"""))
def mon11(d):
    return us(rounded(MN.predicted_vs_observed(points(d, "decision", "overview"), WEEK), "value", digits=5))


@query("mon12_high_risk_by_stage", sql("etab", "SELECT CASE WHEN branch = 1 THEN 'S6' ELSE 'S5' END AS station_id, count(*) AS predictions, round(max(recent_rate), 6) AS peak FROM etab WHERE recent_rate >= 0.33 GROUP BY 1"))
def mon12(d):
    return rounded(MN.high_risk_by_stage(points(d, "decision")), "peak")





@query("mon13_anomaly_vs_threshold", sql("anom", f"""SELECT {T_SQL.format('(window_id + 1) * 7')} AS us, 'Reconstruction Error (MSE)' AS field, round(list_sum(e) / 7.0, 6) AS value FROM anom
  UNION ALL SELECT {T_SQL.format('(window_id + 1) * 7')}, 'Threshold (p99 Normal Windows)', 0.05 FROM anom"""))
def mon13(d):
    return us(rounded(MN.anomaly_vs_threshold(points(d, "anomaly")), "value"))


@query("mon14_latest_attribution", sql("anom", """SELECT 'attr_S' || i AS field, round(CASE WHEN list_sum(e) > 0 THEN e[i] / list_sum(e) ELSE 0.0 END, 6) AS value FROM (SELECT e FROM anom ORDER BY window_id DESC LIMIT 1), (SELECT unnest(generate_series(1, 7)) AS i)"""))
def mon14(d):
    return rounded(MN.latest_attribution(points(d, "anomaly")), "value")


@query("mon15_window_series", sql("wm", f"SELECT {T_SQL.format('t_end')} AS us, 'S' || stage AS station_id, throughput, round(zero_delta_share, 4) AS zero_delta_share FROM wm"))
def mon15(d):
    return us(MN.window_series(points(d, "window")))


@query("mon16_point_counts", ALL_POINTS_SQL)
def mon16(d):
    return MN.point_counts(points(d, *MEASUREMENTS, write=False))


# ---- alerts over the event stream table, seconds since 2024-01-01 -------------------------------------------

cte("es", "SELECT us // 1000000 AS sec, us // 60000000 AS slot, stage, value FROM ev", ["ev"])


def seconds(d):
    return d.events.select(F.floor(F.col("us") / 1000000).cast("long").alias("sec"), "stage", "value")


def alert_sql(back: int, held: int, expr: str, cond: str, empty: str = "NULL", where: str = "true", keys: str = "") -> str:
    """Evaluation grid, trailing window and hold in plain SQL; ``keys`` is empty or 'stage, '."""
    part = f"PARTITION BY {keys[:-2]} " if keys else ""
    match = "e.stage = g.stage AND " if keys else ""
    gk = "g.stage, " if keys else ""
    grp = f" GROUP BY {keys[:-2]}" if keys else ""
    return f""", src AS (SELECT * FROM es WHERE {where}), g AS (SELECT {keys}unnest(generate_series(a, b)) AS g FROM (SELECT {keys}min(slot) AS a, max(slot) AS b FROM src{grp})),
  e AS (SELECT {gk}g.g, {expr} AS x FROM g LEFT JOIN src e ON {match}e.slot >= g.g - {back // 60} AND e.slot < g.g GROUP BY {gk}g.g),
  c AS (SELECT {keys}g, CAST({cond} AS INT) AS ok FROM e), h AS (SELECT {keys}g, sum(ok) OVER ({part}ORDER BY g RANGE BETWEEN {held} PRECEDING AND CURRENT ROW) AS s FROM c)
  SELECT {keys}g FROM h WHERE s = {held + 1}"""


@query("alr1_high_risk_surge", sql("es", alert_sql(300, 1, "count(e.sec) FILTER (e.value >= 60)", "x > 1")))
def alr1(d):
    return MN.alert(seconds(d), "sec", 300, 1, {"n": F.count_if(F.col("value") >= 60)}, F.col("n") > 1)


@query("alr2_stage_idle", sql("es", alert_sql(300, 2, "count(e.sec)", "x < 1", keys="stage, ")))
def alr2(d):
    return MN.alert(seconds(d), "sec", 300, 2, {"n": F.count(F.lit(1))}, F.coalesce("n", F.lit(0)) < 1, ("stage",))


@query("alr3_anomaly_flagged", sql("es", alert_sql(300, 1, "coalesce(max(CAST(e.stage = 'error' AS INT)), 0)", "x > 0")))
def alr3(d):
    return MN.alert(seconds(d), "sec", 300, 1, {"max_flag": F.max((F.col("stage") == "error").cast("int"))}, F.col("max_flag") > 0)


@query("alr4_stream_stalled", sql("es", alert_sql(120, 2, "count(e.sec)", "x < 1")))
def alr4(d):
    return MN.alert(seconds(d), "sec", 120, 2, {"n": F.count(F.lit(1))}, F.coalesce("n", F.lit(0)) < 1)


@query("alr5_condition_hold", sql("v", """, c AS (SELECT entry AS g, count(*) >= 3 AS ok FROM v WHERE stage = 1 GROUP BY entry)
  SELECT g FROM (SELECT g, ok, count(*) FILTER (ok) OVER (ORDER BY g RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM c) WHERE s = 3"""))
def alr5(d):
    e = d.visits.where("stage = 1").groupBy(F.col("entry").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return MN.hold(e, F.col("n") >= 3, 2)


@query("str7_inactivity_batch", sql("es", """, g AS (SELECT unnest(generate_series(a, b)) AS g FROM (SELECT min(slot) AS a, max(slot) AS b FROM es)), c AS (SELECT slot, count(*) AS n FROM es GROUP BY slot)
  SELECT g AS minute, coalesce(n, 0) AS n FROM g LEFT JOIN c ON slot = g"""))
def str7_batch(d):
    per = seconds(d).groupBy(F.floor(F.col("sec") / 60).cast("long").alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    span = per.agg(F.min("minute").alias("a"), F.max("minute").alias("b"))
    return P.dense_grid(span, "a", "b", 1, "minute").select("minute").join(per, "minute", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("agg41_scenario_kpis", sql("ranked_v lab scen", """, s AS (SELECT name AS scenario, entity, stage, stage_rank, entry, coalesce(label, 0) AS y,
  coalesce(greatest(0.0, (entry - lag(entry) OVER (PARTITION BY name, entity ORDER BY stage_rank, entry, stage)) * 1440.0), 0.0) AS tr FROM ranked_v JOIN scen ON entry BETWEEN t_start AND t_end LEFT JOIN lab USING (entity))
  SELECT scenario, count(*) AS rows, count(DISTINCT entity) AS entities, count(DISTINCT CASE WHEN y = 1 THEN entity END) AS defects, round(avg(tr), 4) AS mean_transit FROM s GROUP BY scenario"""))
def agg41(d):
    from stageflow.plans.scans import scenario_slice

    s = scenario_slice(d)
    per = s.groupBy("scenario", "entity").agg(F.count(F.lit(1)).alias("r"), F.max("ground_truth").alias("y"), F.sum("transit_minutes").alias("tr"))
    out = per.groupBy("scenario").agg(
        F.sum("r").alias("rows"), F.count(F.lit(1)).alias("entities"), F.count_if(F.col("y") == 1).alias("defects"), (F.sum("tr") / F.sum("r")).alias("mean_transit")
    )
    return rounded(out, "mean_transit", digits=4)
