"""Health, risk and overview queries over the message table."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stageflow.operators import primitives as P
from stageflow.operators import profile as PR
from stageflow.operators import scoring as SCO
from stageflow.plans.flow import rounded
from stageflow.plans.joins import segment_benchmark, topology
from stageflow.plans.registry import cte, half_up, query, sql
from stageflow.plans.scalars import DEFECT_SQL
from stageflow.session import materialize
from stageflow.sources.tables import SENSORS

# Messages with state lives, deviations and positions, in plain windows.
cte("ml", """SELECT x.*, row_number() OVER (PARTITION BY entity, life ORDER BY t, stage_rank, stage) = 1 AS is_first,
    lag(stage) OVER (PARTITION BY entity, life ORDER BY t, stage_rank, stage) AS arrived_from FROM (
  SELECT *, coalesce(CAST(sum(CAST(is_exit AS INT)) OVER (PARTITION BY entity ORDER BY t, stage_rank, stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS life,
    row_number() OVER (ORDER BY t, stage_rank, entity) AS pos, row_number() OVER (PARTITION BY stage ORDER BY t, entity) AS visit_no FROM m) x""", ["m"])
cte("mz", """SELECT entity, stage, feature, ord, coalesce((value - mean) / std, 0.0) AS z FROM (
  SELECT entity, ml.stage, unnest(['qty', 'price', 'disc', 'tax']) AS feature, unnest([1, 2, 3, 4]) AS ord, unnest([qty, price, disc, tax]) AS value FROM ml) u
  LEFT JOIN baseline USING (stage, feature) WHERE value IS NOT NULL""", ["ml", "baseline"])
cte("msc", """SELECT ml.*, max_abs_z, n_features, n_anom, avg(max_abs_z) OVER w AS avg_z, count(*) OVER w AS window_parts FROM ml
  JOIN (SELECT entity, stage, max(abs(z)) AS max_abs_z, count(*) AS n_features, count(*) FILTER (abs(z) >= 3.0) AS n_anom FROM mz GROUP BY 1, 2) q USING (entity, stage)
  WINDOW w AS (PARTITION BY stage ORDER BY t, entity ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""", ["ml", "mz"])
cte("oc", """SELECT v.stage, v.entity, v.visit_no, x.pos, coalesce(x.response, 0) AS label FROM ml v JOIN ml x ON x.entity = v.entity AND x.life = v.life AND x.is_exit AND v.pos <= x.pos""", ["ml"])
cte("oc2", """SELECT stage, pos, label, row_number() OVER (PARTITION BY stage ORDER BY pos) AS k, CAST(sum(label) OVER (PARTITION BY stage ORDER BY pos) AS BIGINT) AS c FROM (
  SELECT *, sum(is_visit) OVER (PARTITION BY stage ORDER BY pos, 1 - is_visit) AS seen FROM (
    SELECT stage, entity, visit_no, pos, label, 0 AS is_visit FROM oc UNION ALL SELECT stage, entity, visit_no, pos, 0, 1 FROM ml)) WHERE is_visit = 0 AND seen - visit_no < 100""", ["oc", "ml"])
cte("obs", """SELECT a.stage, a.entity, CASE WHEN a.k > 0 THEN (a.c - coalesce(b.c, 0)) / least(a.k, 100) ELSE 0.005069 END AS observed_rate FROM (
  SELECT ml.stage, ml.entity, coalesce(o.k, 0) AS k, coalesce(o.c, 0) AS c FROM ml ASOF LEFT JOIN oc2 o ON o.stage = ml.stage AND o.pos < ml.pos) a
  LEFT JOIN oc2 b ON b.stage = a.stage AND b.k = a.k - 100""", ["ml", "oc2"])
_D = "CASE WHEN n_features > 0 THEN greatest(0.0, least(100.0, 100.0 - (avg_z - 1.0) * (100.0 / 3.0))) ELSE 100.0 END"
_P = """CASE WHEN incoming IS NULL OR transit_minutes <= p90 THEN 100.0 WHEN transit_minutes <= p99 THEN 100.0 - 40.0 * (transit_minutes - p90) / greatest(0.001, p99 - p90)
  ELSE greatest(0.0, 60.0 - 60.0 * (transit_minutes - p99) / greatest(1.0, p99)) END"""
cte("health", f"""SELECT *, CASE WHEN health_score >= 80 THEN 'HEALTHY' WHEN health_score >= 50 THEN 'WARNING' ELSE 'CRITICAL' END AS status FROM (
  SELECT *, {half_up("greatest(0.0, least(100.0, sd * 0.45 + sp * 0.30 + sq * 0.25))", 2)} AS health_score FROM (
    SELECT *, {_D} AS sd, {_P} AS sp, {DEFECT_SQL.format(r="(observed_rate / greatest(0.00001, 0.005069))")} AS sq FROM (
      SELECT msc.*, coalesce(arrived_from, static_prev) AS incoming, coalesce(seg.p90, 6.0238) AS p90, coalesce(seg.p99, 36.1060) AS p99, observed_rate
      FROM msc LEFT JOIN topo ON topo.stage = msc.stage LEFT JOIN seg ON seg.a = coalesce(arrived_from, static_prev) AND seg.b = msc.stage
      JOIN obs ON obs.stage = msc.stage AND obs.entity = msc.entity)))""", ["msc", "topo", "seg", "obs"])


def health(d):
    lived = d.lived_messages
    return SCO.stage_health(lived, PR.baselines(d.sensor_values, ("stage", "feature")), segment_benchmark(d), topology(d), sensors=SENSORS)


def scored(d):
    return SCO.deviations(SCO.lives(d.messages), PR.baselines(d.sensor_values, ("stage", "feature"))).withColumn("tie", SCO.message_tie())


@query("win4_rolling_drift", sql("msc", "SELECT entity, stage, visit_no, round(avg_z, 8) AS avg_z, window_parts FROM msc"))
def win4(d):
    narrow = scored(d).select("entity", "stage", "t", "max_abs_z")
    return rounded(SCO.rolling_drift(materialize(narrow, "scored")).select("entity", "stage", "visit_no", "avg_z", "window_parts"), "avg_z", digits=8)


@query("win5_rolling_outcomes", sql("obs", "SELECT entity, stage, round(observed_rate, 6) AS observed_rate FROM obs"))
def win5(d):
    m = materialize(SCO.lives(d.messages).withColumn("tie", SCO.message_tie()).drop("features", "prev_stage"), "lives")
    m = materialize(P.ranked(m, "t", "entity", ("stage",), "visit_no"), "numbered")
    return rounded(SCO.rolling_outcomes(m).select("entity", "stage", "observed_rate"), "observed_rate")


@query("win6_rolling_p90", sql("ml", """SELECT entity, stage, visit_no, round(quantile_cont(transit_minutes, 0.9) OVER (PARTITION BY stage ORDER BY t, entity ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 4) AS p90_transit FROM ml"""))
def win6(d):
    out = SCO.rolling_p90(d.messages).select("entity", "stage", "visit_no", "p90_transit")
    return rounded(out, "p90_transit", digits=4)


@query("win7_rolling_throughput", sql("m", """SELECT entity, t, CASE WHEN n >= 2 AND (t - t0) * 24.0 > 0.01 THEN round(n / ((t - t0) * 24.0), 1) ELSE 0.0 END AS rolling_throughput_per_hr FROM (
  SELECT entity, t, count(*) OVER w AS n, min(t) OVER w AS t0 FROM m WHERE is_exit WINDOW w AS (ORDER BY t, entity ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))"""))
def win7(d):
    return SCO.rolling_throughput(d.messages.where("is_exit").select("entity", "t"), 24.0).select("entity", "t", "rolling_throughput_per_hr")


@query("win8_line_totals", sql("ml", """SELECT entity, t, started - completed + 1 AS active_parts, entered, completed, defects, round(defects / completed * 100.0, 3) AS rate FROM (
  SELECT entity, t, is_exit, CAST(sum(CAST(is_first AS INT)) OVER w AS BIGINT) AS started, CAST(sum(CAST(is_first AND is_entry AS INT)) OVER w AS BIGINT) AS entered,
  CAST(sum(CAST(is_exit AS INT)) OVER w AS BIGINT) AS completed, CAST(sum(CAST(is_exit AND coalesce(response, 0) = 1 AS INT)) OVER w AS BIGINT) AS defects FROM ml WINDOW w AS (ORDER BY pos)) WHERE is_exit"""))
def win8(d):
    m = SCO.lives(d.messages).withColumn("tie", SCO.message_tie())
    sums = {
        "s": F.col("is_first").cast("int"), "e": (F.col("is_first") & F.col("is_entry")).cast("int"),
        "x": F.col("is_exit").cast("int"), "b": (F.col("is_exit") & (F.coalesce("response", F.lit(0)) == 1)).cast("int"),
    }
    flags = m.select("entity", "t", "tie", "is_exit", *[e.alias(n) for n, e in sums.items()])
    out = P.running_rows(materialize(flags, "flags"), "t", "tie", {n: F.col(n) for n in sums}).where("is_exit")
    return out.select(
        "entity", "t", (F.col("cum_s") - F.col("cum_x") + 1).alias("active_parts"), F.col("cum_e").alias("entered"), F.col("cum_x").alias("completed"),
        F.col("cum_b").alias("defects"), F.round(F.col("cum_b") / F.col("cum_x") * 100.0, 3).alias("rate"),
    )


cte("win9c", """SELECT pos, entity, stage, t, is_exit, 100.0 + CAST(sum(cents - prev) OVER (ORDER BY pos) AS BIGINT) / 700.0 AS avg_health FROM (
  SELECT *, lag(cents, 1, 10000) OVER (PARTITION BY stage ORDER BY pos) AS prev FROM (SELECT *, CAST(round(health_score * 100) AS BIGINT) AS cents FROM health))""", ["health"])


@query("win9_average_latest_health", sql("win9c", "SELECT entity, stage, t, round(avg_health, 5) AS avg_health FROM win9c"))
def win9(d):
    stepped = SCO.health_steps(health(d)).select("entity", "stage", "t", SCO.message_tie().alias("tie"), "_step")
    out = P.running_rows(materialize(stepped, "steps"), "t", "tie", {"c": F.col("_step")})
    return out.select("entity", "stage", "t", F.round(F.lit(100.0) + F.col("cum_c") / F.lit(700.0), 5).alias("avg_health"))


cte("hist", """SELECT msc.*, CAST(sum(n_anom) OVER w AS BIGINT) AS cumulative_anomalies, string_agg(stage, ',') OVER w AS visited FROM msc
  WINDOW w AS (PARTITION BY entity, life ORDER BY t, stage_rank, stage ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", ["msc"])


@query("win10_entity_history", sql("hist", "SELECT entity, stage, life, cumulative_anomalies, visited FROM hist"))
def win10(d):
    return SCO.entity_history(scored(d)).select(
        "entity", "stage", "life", "cumulative_anomalies", F.array_join(F.transform("stages_visited", lambda s: s.cast("string")), ",").alias("visited")
    )


@query("win10_last_deviations", sql("ml mz", """, a AS (SELECT ml.entity, ml.life, ml.t, ml.stage_rank, ml.stage, feature, ord, round(z, 2) AS z FROM ml JOIN mz USING (entity, stage) WHERE abs(z) >= 1.6),
  j AS (SELECT ml.entity, ml.stage, a.stage AS s, a.feature AS f, row_number() OVER (PARTITION BY ml.entity, ml.stage ORDER BY a.t DESC, a.stage_rank DESC, a.ord DESC) AS k, a.t, a.stage_rank, a.ord
  FROM ml JOIN a ON a.entity = ml.entity AND a.life = ml.life AND (a.t, a.stage_rank) <= (ml.t, ml.stage_rank))
  SELECT entity, stage, string_agg('S' || s || ':' || f, ',' ORDER BY k DESC) AS last_five FROM j WHERE k <= 5 GROUP BY 1, 2"""))
def win10_last(d):
    from dataclasses import replace

    cfg = replace(SCO.CFG, z_threshold=1.6)
    base = PR.baselines(d.sensor_values, ("stage", "feature"))
    out = SCO.entity_history(SCO.deviations(SCO.lives(d.messages), base, cfg)).where(F.size("top_deviations") > 0)
    text = F.transform("top_deviations", lambda x: F.concat(F.lit("S"), x["stage"].cast("string"), F.lit(":"), x["feature"]))
    return out.select("entity", "stage", F.array_join(text, ",").alias("last_five"))


@query("win12_rank_by_score", """SELECT l_discount, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY l_discount DESC) AS BIGINT) AS last_rank,
  CAST(sum(count(*)) OVER (ORDER BY l_discount DESC) AS BIGINT) - (count(*) - 1) / 2.0 AS mean_rank FROM lineitem GROUP BY l_discount""")
def win12(d):
    s = d.table("lineitem").select((-F.col("l_discount")).alias("neg"))
    r = P.running(s, "neg", {"n": ("sum", F.lit(1))}, code=P.double_code(F.col("neg")), levels=P.DOUBLE_LEVELS)
    return r.select((-F.col("neg")).alias("l_discount"), "n", F.col("cum_n").alias("last_rank"), (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias("mean_rank"))


HEALTH_OUT = ["entity", "stage", "t", "feature_drift_score", "transit_pacing_score", "defect_rate_score", "health_score", "status", "observed_defect_rate", "window_parts"]


@query("sco1_stage_health", sql("health", """SELECT entity, stage, t, round(sd, 2) AS feature_drift_score, round(sp, 2) AS transit_pacing_score, round(sq, 2) AS defect_rate_score, health_score, status,
  round(observed_rate * 100.0, 4) AS observed_defect_rate, window_parts FROM health"""))
def sco1(d):
    return health(d).select(*HEALTH_OUT)


_RISK = half_up("greatest(0.005069, least(0.99, (least(1.0, ca * 0.22) * 0.5 + greatest(0.0, (100.0 - health_score) / 100.0) * 0.3) / 0.8))", 4)


@query("sco2_part_risk", sql("health hist", f""", j AS (SELECT health.*, cumulative_anomalies AS ca FROM health JOIN hist USING (entity, stage)),
  rk AS (SELECT *, {_RISK} AS risk FROM j)
  SELECT entity, stage, ca AS cumulative_anomalies, risk AS cumulative_risk, CASE WHEN risk < 0.3 THEN 'LOW' WHEN risk < 0.7 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level FROM rk"""))
def sco2(d):
    return SCO.part_risk(health(d)).select("entity", "stage", "cumulative_anomalies", "cumulative_risk", "risk_level")


@query("sco3_line_overview", sql("win9c ml m", """, tot AS (SELECT entity, t, pos, is_exit, CAST(sum(CAST(is_first AS INT)) OVER w AS BIGINT) AS started, CAST(sum(CAST(is_first AND is_entry AS INT)) OVER w AS BIGINT) AS entered,
  CAST(sum(CAST(is_exit AS INT)) OVER w AS BIGINT) AS completed, CAST(sum(CAST(is_exit AND coalesce(response, 0) = 1 AS INT)) OVER w AS BIGINT) AS defects FROM ml WINDOW w AS (ORDER BY pos)),
  th AS (SELECT entity, CASE WHEN n >= 2 AND (t - t0) * 24.0 > 0.01 THEN round(n / ((t - t0) * 24.0), 1) ELSE 0.0 END AS thr FROM (
    SELECT entity, t, count(*) OVER w AS n, min(t) OVER w AS t0 FROM m WHERE is_exit WINDOW w AS (ORDER BY t, entity ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)))
  SELECT tot.entity, tot.t, started - completed + 1 AS active_parts, entered AS total_entered, completed AS total_completed, defects AS total_defects, round(defects / completed * 100.0, 3) AS cumulative_defect_rate,
  thr AS rolling_throughput_per_hr, round(avg_health, 1) AS line_average_health FROM tot JOIN th USING (entity) JOIN win9c w ON w.pos = tot.pos WHERE tot.is_exit"""))
def sco3(d):
    return SCO.line_overview(health(d), 24.0)


@query("sco4_critical_alerts", sql("health mz", """SELECT 'STATION_HEALTH_CRITICAL' AS alert_type, health.entity, health.stage, health_score, t,
  (SELECT count(*) FROM mz WHERE mz.entity = health.entity AND mz.stage = health.stage AND abs(z) >= 3.0) AS n_anomalous FROM health WHERE status = 'CRITICAL'"""))
def sco4(d):
    return SCO.critical_alerts(health(d)).withColumn("n_anomalous", F.size("anomalous_features").cast("long")).drop("anomalous_features")
