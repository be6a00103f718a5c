"""Sources, sinks, profiles, quality and drift queries."""

from pyspark.sql import functions as F

from stageflow.functions import scalar as S
from stageflow.functions.timescale import DAY_SCALE
from stageflow.operators import drift as D
from stageflow.operators import profile as PR
from stageflow.operators import quality as Q
from stageflow.operators import throughput as T
from stageflow.plans.flow import rounded, routes_labelled
from stageflow.operators import routes as R
from stageflow.plans.registry import cte, half_up, query, sql
from stageflow.session import work_dir
from stageflow.sources import io
from stageflow.sources.tables import SENSORS, STAGES, wide_names

F_COLS = [c for s in STAGES for c in wide_names()[s][2:]]
D_COLS = [c for s in STAGES for c in wide_names()[s][:2]]


def _wide_sql():
    parts = []
    for s in STAGES:
        d1, d2, *f = wide_names()[s]
        parts += [f"min(CASE WHEN stage = {s} THEN t END) AS {d1}", f"max(CASE WHEN stage = {s} THEN t END) AS {d2}"]
        parts += [f"max(CASE WHEN stage = {s} THEN {c} END) AS {n}" for c, n in zip(SENSORS, f)]
    return f"SELECT lab.entity AS \"Id\", max(label) AS \"Response\", {', '.join(parts)} FROM lab LEFT JOIN r ON lab.entity = r.entity GROUP BY lab.entity"


cte("wide", _wide_sql(), ["r", "lab"])
cte("first_entry", "SELECT entity, min(entry) AS t FROM v GROUP BY entity", ["v"])
cte("baseline", """SELECT stage, feature, avg(value) AS mean, CASE WHEN stddev_samp(value) > 0 THEN stddev_samp(value) ELSE 0.01 END AS std
  FROM sens GROUP BY stage, feature""", ["sens"])
cte("lsens", "SELECT sens.*, coalesce(lab.label, 0) AS label FROM sens LEFT JOIN lab USING (entity)", ["sens", "lab"])


# ---- sources ---------------------------------------------------------------------------------------------

@query("src1_wide_csv_scan", sql("wide", f"SELECT \"Id\", {', '.join(F_COLS)}, \"Response\" FROM wide"))
def src1(d):
    path = io.write_csv(d.wide.select("Id", *F_COLS, "Response"), work_dir(d.spark, "wide_csv"))
    return io.scan_csv(d.spark, path, io.wide_schema(F_COLS))


@query("src2_projected_csv_scan", sql("wide", f"SELECT \"Id\", {F_COLS[0]}, {F_COLS[5]} FROM wide"))
def src2(d):
    path = io.write_csv(d.wide.select("Id", *F_COLS, "Response"), work_dir(d.spark, "wide_csv"))
    return io.scan_csv(d.spark, path, io.wide_schema(F_COLS), ["Id", F_COLS[0], F_COLS[5]])


@query("src3_scan_of_target_ids", sql("r lab", "SELECT entity, stage, t, qty, price FROM r WHERE entity IN (SELECT entity FROM lab WHERE label = 1)"))
def src3(d):
    ids = d.labels.where("label = 1")
    return io.restrict_to(d.rows.select("entity", "stage", "t", "qty", "price"), ids, "entity")


@query("src4_first_rows", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def src4(d):
    return io.first_rows(d.table("orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], 1000)


@query("src5_parquet_pushdown", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1997-06-30' AND l_linenumber IN (1, 2, 5)""")
def src5(d):
    ship = F.col("l_shipdate")
    where = S.in_interval(ship, F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1997-06-30").cast("timestamp_ntz"))
    return io.scan_parquet(
        d.spark, f"{d.sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"],
        where & F.col("l_linenumber").isin(1, 2, 5),
    )


@query("src6_parquet_full_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate) AS order_us, o_orderpriority FROM orders")
def src6(d):
    o = io.scan_parquet(d.spark, f"{d.sf_dir}/orders.parquet")
    return o.withColumn("order_us", F.unix_micros(F.col("o_orderdate").cast("timestamp"))).drop("o_orderdate")


@query("src7_baseline_scan", sql("baseline", f"SELECT stage, feature, {half_up('mean', 6)} AS mean, {half_up('std', 6)} AS std FROM baseline"))
def src7(d):
    base = PR.baselines(d.sensor_values, ("stage", "feature"))
    stats = base.withColumns({c: S.round_half_up(F.col(c), 6) for c in ("mean", "std")})
    path = io.write_summary_csv(stats, work_dir(d.spark, "baseline_csv"))
    back = d.spark.read.schema("stage INT, feature STRING, mean DOUBLE, std DOUBLE").option("header", True).csv(path)
    return back.withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(0.01)))


# Scenario windows (name, first day, last day, focus stages) laid over the day-based tables.
SCENARIOS = (("A", 400, 460, ["S1", "S2"]), ("B", 900, 990, ["S3"]), ("C", 1500, 1530, ["S5", "S6"]), ("D", 2000, 2200, ["S7"]))
SCENARIO_TIMES = tuple((n, a, b) for n, a, b, _ in SCENARIOS)
cte("scen", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}, {b}, {f!r})" for n, a, b, f in SCENARIOS) + ") s(name, t_start, t_end, focus)")


def scenarios(d):
    return io.parameter_table(d.spark, SCENARIOS, "name STRING, t_start LONG, t_end LONG, focus ARRAY<STRING>")


@query("src8_parameter_tables", sql("v scen", """SELECT name, 'S' || stage AS focus_stage, count(*) AS visits, min(entry) AS first_t, max(entry) AS last_t
  FROM v JOIN scen ON entry BETWEEN t_start AND t_end AND list_contains(focus, 'S' || stage) GROUP BY 1, 2"""))
def src8(d):
    sc = F.broadcast(scenarios(d).select("name", "t_start", "t_end", F.explode("focus").alias("focus_stage")))
    named = d.visits.withColumn("focus_stage", F.concat(F.lit("S"), F.col("stage").cast("string")))
    hit = named.join(sc, "focus_stage").where(S.in_interval(F.col("entry"), F.col("t_start"), F.col("t_end")))
    return hit.groupBy("name", "focus_stage").agg(
        F.count(F.lit(1)).alias("visits"), F.min("entry").alias("first_t"), F.max("entry").alias("last_t")
    )


def garbled(d):
    """Event payloads in which every 'error' message is cut off, as a broken sender would do."""
    cut = F.expr("substring(props, 1, length(props) - 1)")
    return d.events.select("event_id", "stage", F.when(F.col("stage") == "error", cut).otherwise(F.col("props")).alias("payload"))


@query("src10_json_decode", sql("ev", """SELECT event_id, CASE WHEN stage <> 'error' THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS k, stage = 'error' AS quarantined,
  CASE WHEN stage = 'error' THEN length(props) - 1 END AS raw_length FROM ev"""))
def src10(d):
    good, bad = io.split_corrupt(io.decode_json(garbled(d), "payload", "k DOUBLE"))
    empty = F.lit(None).cast("int")
    return good.select("event_id", "k", F.lit(False).alias("quarantined"), empty.alias("raw_length")).unionByName(
        bad.select("event_id", F.lit(None).cast("double").alias("k"), F.lit(True).alias("quarantined"), F.length("_corrupt").alias("raw_length"))
    )


@query("src11_header_check", sql("wide", f"""SELECT 'numeric' AS table_name, true AS label_expected, true AS label_present, true AS ok, {len(F_COLS) + 2} AS columns,
  count(*) AS rows, count(*) FILTER ("Response" IS NULL) AS null_labels FROM wide
  UNION ALL SELECT 'date', false, false, true, {len(D_COLS) + 1}, count(*), NULL FROM wide"""))
def src11(d):
    return PR.header_check(
        {"numeric": (d.wide.select("Id", *F_COLS, "Response"), True), "date": (d.wide.select("Id", *D_COLS), False)}, "Response"
    )


# ---- sinks -----------------------------------------------------------------------------------------------

@query("snk1_parquet_write", sql("v", "SELECT line, count(*) AS visits, count(DISTINCT stage) AS stages, min(entry) AS first_t FROM v GROUP BY line"))
def snk1(d):
    path = io.write_parquet(d.visits, work_dir(d.spark, "visits"), ["line"])
    return d.spark.read.parquet(path).groupBy("line").agg(
        F.count(F.lit(1)).alias("visits"), F.count_distinct("stage").alias("stages"), F.min("entry").alias("first_t")
    )


@query("snk2_summary_csv", sql("v", "SELECT stage, count(*) AS visits, round(avg(duration), 6) AS mean_d FROM v GROUP BY stage"))
def snk2(d):
    out = rounded(d.visits.groupBy("stage").agg(F.count(F.lit(1)).alias("visits"), F.avg("duration").alias("mean_d")), "mean_d")
    path = io.write_summary_csv(out, work_dir(d.spark, "summary"))
    return d.spark.read.schema("stage INT, visits LONG, mean_d DOUBLE").option("header", True).csv(path)


@query("snk3_statistics_record", sql("lab v", """SELECT (SELECT count(*) FROM lab) AS rows, (SELECT CAST(sum(label) AS BIGINT) FROM lab) AS positives,
  (SELECT round(avg(label), 6) FROM lab) AS rate, count(DISTINCT w) AS active_periods, max(w) - min(w) + 1 - count(DISTINCT w) AS gaps
  FROM (SELECT CAST(floor(entry / 7.0) AS BIGINT) AS w FROM v)"""))
def snk3(d):
    weeks = d.visits.select(DAY_SCALE.bucket(F.col("entry")).cast("long").alias("w")).distinct()
    lab = Q.overall(d.labels).select("n", "defects", "rate").agg(F.struct(F.first("n").alias("n"), F.first("defects").alias("d"), F.first("rate").alias("r")).alias("x")).scalar()
    rec = weeks.agg(F.count(F.lit(1)).alias("active_periods"), F.max("w").alias("_hi"), F.min("w").alias("_lo")).select(
        lab.getField("n").alias("rows"), lab.getField("d").alias("positives"), F.round(lab.getField("r"), 6).alias("rate"),
        "active_periods", (F.col("_hi") - F.col("_lo") + 1 - F.col("active_periods")).alias("gaps"),
    )
    path = io.write_json(rec, work_dir(d.spark, "stats"))
    return d.spark.read.schema("rows LONG, positives LONG, rate DOUBLE, active_periods LONG, gaps LONG").json(path)


@query("snk4_routed_messages", sql("m", """SELECT entity, stage, 'factory/line3/S' || stage || '/telemetry' AS topic, t AS payload_t, round(transit_minutes, 4) AS payload_transit,
  CAST(is_exit AS VARCHAR) AS payload_exit FROM m"""))
def snk4(d):
    topic = F.concat(F.lit("factory/line3/S"), F.col("stage").cast("string"), F.lit("/telemetry"))
    out = io.routed(d.messages, topic, ["entity", "stage", "t", "transit_minutes", "features", "is_entry", "is_exit", "response"])
    p = F.col("payload")
    return out.select(
        "entity", "stage", "topic",
        F.get_json_object(p, "$.t").cast("long").alias("payload_t"),
        F.round(F.get_json_object(p, "$.transit_minutes").cast("double"), 4).alias("payload_transit"),
        F.get_json_object(p, "$.is_exit").alias("payload_exit"),
    )


# ---- profile ---------------------------------------------------------------------------------------------

def profile(d):
    numeric = PR.column_profile(d.wide, ["Id", *F_COLS, "Response"], "numeric")
    return numeric.unionByName(PR.column_profile(d.wide, ["Id", *D_COLS], "date"))


def _profile_sql():
    parts = []
    for src, cols in (("numeric", ["Id", *F_COLS, "Response"]), ("date", ["Id", *D_COLS])):
        for c in cols:
            parts.append(f"SELECT '{src}' AS source, '{c}' AS col_name, count(*) AS total_rows, count(\"{c}\") AS non_null FROM wide")
    return " UNION ALL ".join(parts)


PATTERN = S.COLUMN_PATTERN


def _parsed(i, name):
    return f"CASE WHEN regexp_matches({name}, '{PATTERN}') THEN CAST(regexp_extract({name}, '{PATTERN}', {i}) AS INTEGER) END"


def _kind(name):
    return f"CASE regexp_extract({name}, '{PATTERN}', 3) WHEN 'F' THEN 'Feature' WHEN 'D' THEN 'Date' ELSE 'Other' END"


cte("prof0", _profile_sql(), ["wide"])
cte("prof", f"""SELECT *, total_rows - non_null AS missing, (total_rows - non_null) / total_rows AS missing_rate, {_parsed(1, 'col_name')} AS line,
  {_parsed(2, 'col_name')} AS station, {_kind('col_name')} AS kind, {_parsed(4, 'col_name')} AS feature_id FROM prof0""", ["prof0"])


@query("agg1_column_profile", sql("prof", "SELECT source, col_name, total_rows, non_null, missing, round(missing_rate, 6) AS missing_rate, line, station, kind, feature_id FROM prof"))
def agg1(d):
    return rounded(profile(d), "missing_rate")


@query("agg2_profile_by_type", sql("prof", "SELECT source, kind, count(*) AS columns, round(avg(missing_rate), 6) AS mean_missing_rate FROM prof GROUP BY source, kind"))
def agg2(d):
    return rounded(PR.by_type(profile(d)), "mean_missing_rate")


@query("agg3_stage_missingness", sql("prof", """SELECT line, station, count(*) FILTER (kind = 'Feature') AS feature_cols, count(*) FILTER (kind = 'Date') AS date_cols,
  CAST(sum(non_null) AS BIGINT) AS filled, max(non_null) AS max_non_null, round(avg(non_null), 6) AS mean_non_null,
  round(1.0 - sum(non_null) / sum(total_rows), 6) AS cell_missing_rate, round(max(non_null) * 100.0 / max(total_rows), 6) AS coverage_pct
  FROM prof WHERE station IS NOT NULL GROUP BY line, station"""))
def agg3(d):
    return rounded(PR.stage_missingness(profile(d)), "mean_non_null", "cell_missing_rate", "coverage_pct")


@query("agg4_functional_dependency", sql("r", "SELECT stage, count(DISTINCT line) AS n_values, count(DISTINCT line) > 1 AS violated FROM r GROUP BY stage"))
def agg4(d):
    return PR.functional_dependency(d.rows, "stage", "line")


@query("prj1_column_name_parse", sql("r", f""", n AS (SELECT DISTINCT 'L' || line || '_S' || stage || '_' || k AS name FROM r, (VALUES ('F1'), ('D20'), ('X3')) q(k))
  SELECT name, {_parsed(1, 'name')} AS line, {_parsed(2, 'name')} AS station, {_kind('name')} AS kind, {_parsed(4, 'name')} AS feature_id FROM n"""))
def prj1(d):
    pairs = d.rows.select("line", "stage").distinct()
    suffix = F.explode(F.array(*[F.lit(s) for s in ("F1", "D20", "X3")]))
    named = pairs.withColumn("k", suffix).select(F.concat(F.lit("L"), F.col("line").cast("string"), F.lit("_S"), F.col("stage").cast("string"), F.lit("_"), F.col("k")).alias("name"))
    return named.select("name", *[e.alias(n) for n, e in S.parse_column(F.col("name")).items()])


def feature_stats(d):
    return PR.feature_profile(d.sensor_values, PR.total_rows(d.visits, "stage"), ("stage", "feature"))


cte("fp", """SELECT stage, feature, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, var_samp(value) AS variance, min(value) AS min, max(value) AS max,
  count(DISTINCT value) AS n_distinct, ((SELECT count(*) FROM v WHERE v.stage = sens.stage) - count(*)) * 100.0 / (SELECT count(*) FROM v WHERE v.stage = sens.stage) AS missing_pct
  FROM sens GROUP BY stage, feature""", ["sens", "v"])
FP = """stage, feature, n, round(mean * n, 6) / n AS mean, round(std, 6) AS std, round(variance, 1) AS variance, min, max, n_distinct, round(missing_pct, 6) AS missing_pct"""


def _fp_round(df):
    return rounded(rounded(df, "mean", "std", "missing_pct"), "variance", digits=1)


@query("agg28_best_feature", sql("fp", f"SELECT {FP} FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY n DESC, feature) AS k FROM fp WHERE variance > 0) WHERE k = 1"))
def agg28(d):
    return _fp_round(PR.best_feature(feature_stats(d), "stage", "feature"))


@query("agg29_feature_profile", sql("fp", f"SELECT {FP} FROM fp WHERE std >= 0.01 AND n_distinct >= 10"))
def agg29(d):
    return _fp_round(PR.informative(feature_stats(d)))


@query("srt3_top_features_per_stage", sql("fp", """SELECT stage, feature, n, k FROM (SELECT fp.*, row_number() OVER (PARTITION BY fp.stage ORDER BY n DESC, feature) AS k, keep
  FROM fp LEFT JOIN (VALUES (1, 2), (2, 3), (3, 1)) l(stage, keep) USING (stage)) WHERE keep IS NULL OR k <= keep"""))
def srt3(d):
    limits = F.broadcast(io.parameter_table(d.spark, [(1, 2), (2, 3), (3, 1)], "stage INT, keep INT"))
    return PR.top_features(feature_stats(d), limits, "stage", "feature").select("stage", "feature", "n", F.col("k").cast("long").alias("k"))


@query("agg42_median_per_feature", sql("sens", "SELECT stage, feature, round(quantile_cont(value, 0.5), 6) AS median FROM sens GROUP BY stage, feature"))
def agg42(d):
    return rounded(PR.medians(d.sensor_values, ("stage", "feature")), "median")


# ---- quality ---------------------------------------------------------------------------------------------

@query("agg19_quality_overall", sql("lab", "SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS defects, round(avg(label), 6) AS rate, CAST(round(count(*) / sum(label)) AS BIGINT) AS one_in FROM lab"))
def agg19(d):
    return rounded(Q.overall(d.labels), "rate")


QUALITY_SQL = """SELECT {g}, count(*) AS n, CAST(sum(y) AS BIGINT) AS defects, round(count(*) * 100.0 / (SELECT count(*) FROM lab), 6) AS share_pct, round(avg(y), 6) AS rate,
  round(avg(y) / (SELECT avg(label) FROM lab), 6) AS relative_risk FROM (SELECT p.{g}, coalesce(lab.label, 0) AS y FROM ({pairs}) p LEFT JOIN lab USING (entity)) GROUP BY {g}"""


@query("agg20_quality_by_line", sql("v lab", QUALITY_SQL.format(g="line", pairs="SELECT DISTINCT entity, line FROM v")))
def agg20(d):
    return rounded(Q.by_group(d.visits.select("entity", "line").distinct(), d.labels, "line"), "share_pct", "rate", "relative_risk")


@query("agg21_quality_by_stage", sql("v lab", QUALITY_SQL.format(g="stage", pairs="SELECT entity, stage FROM v") + " HAVING count(*) >= 1000"))
def agg21(d):
    out = Q.by_group(d.visits.select("entity", "stage"), d.labels, "stage", min_n=1000)
    return rounded(out, "share_pct", "rate", "relative_risk").orderBy(F.desc("rate"), "stage")


@query("agg22_quality_by_period", sql("first_entry lab", """, w AS (SELECT CAST(floor(t / 7.0) AS INTEGER) AS period, count(*) AS n, CAST(sum(coalesce(label, 0)) AS BIGINT) AS defects
  FROM first_entry LEFT JOIN lab USING (entity) GROUP BY 1)
  SELECT period, n, defects, round(defects / n, 6) AS rate, round(avg(defects / n) OVER (ORDER BY period ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS rolling_rate,
  round(defects / n / (SELECT avg(label) FROM lab), 6) AS relative_rate, n >= 20 AND defects / n / (SELECT avg(label) FROM lab) >= 1.25 AS is_spike FROM w"""))
def agg22(d):
    first = T.first_event(d.visits, ("entity",), "entry")
    return rounded(Q.by_period(first, d.labels, "entry", DAY_SCALE, 20, 1.25), "rate", "rolling_rate", "relative_rate")


@query("win3_centred_mean", sql("v", """SELECT stage, p AS period, n, round(avg(n) OVER (PARTITION BY stage ORDER BY p ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smooth
  FROM (SELECT stage, CAST(floor(entry / 7.0) AS INTEGER) AS p, count(*) AS n FROM v GROUP BY 1, 2)"""))
def win3(d):
    from pyspark.sql import Window

    near = Window.partitionBy("stage").orderBy("period").rowsBetween(-1, 1)
    return rounded(T.per_period(d.visits, "entry", DAY_SCALE, ("stage",)).withColumn("smooth", F.avg("n").over(near)), "smooth")


@query("agg23_high_risk_routes", sql("routes_l", """SELECT route, count(*) AS n, CAST(sum(label) AS BIGINT) AS defects, round(avg(label), 6) AS rate,
  round(avg(label) / (SELECT avg(label) FROM routes_l), 6) AS relative_risk FROM routes_l GROUP BY route HAVING count(*) >= 50"""))
def agg23(d):
    rl = routes_labelled(d).select("entity", "route", "label")
    out = Q.by_group(rl.select("entity", "route"), rl.select("entity", "label"), "route", min_n=50)
    return rounded(out, "rate", "relative_risk").select("route", "n", "defects", "rate", "relative_risk").orderBy(F.desc("relative_risk"), "route")


@query("agg30_line_comparison", sql("v lab", """, p AS (SELECT DISTINCT entity, line FROM v), q AS (SELECT line, count(*) AS entities, CAST(sum(coalesce(label, 0)) AS BIGINT) AS defects,
  round(avg(coalesce(label, 0)), 6) AS rate FROM p LEFT JOIN lab USING (entity) GROUP BY line),
  s AS (SELECT line, count(DISTINCT stage) AS stages, max(CAST(qty IS NOT NULL AS INT)) + max(CAST(price IS NOT NULL AS INT)) + max(CAST(disc IS NOT NULL AS INT)) + max(CAST(tax IS NOT NULL AS INT)) AS sensors FROM v GROUP BY line)
  SELECT line, stages, sensors, entities, defects, rate FROM s JOIN q USING (line)"""))
def agg30(d):
    return rounded(Q.line_comparison(d.visits, d.labels, SENSORS), "rate")


@query("agg31_stage_profile", sql("lv sens", """SELECT lv.stage, count(*) AS n, CAST(sum(label) AS BIGINT) AS defects, round(avg(label), 6) AS rate, round(avg(duration), 6) AS mean_d,
  round(quantile_cont(duration, 0.9), 6) AS p90_d, (SELECT count(DISTINCT feature) FROM sens WHERE sens.stage = lv.stage) AS features FROM lv GROUP BY lv.stage"""))
def agg31(d):
    quality = Q.by_group(d.visits.select("entity", "stage"), d.labels, "stage").select("stage", "n", "defects", "rate")
    timing = T.duration_summary(d.visits, "stage", DAY_SCALE).select("stage", "mean_d", "p90_d")
    feats = d.sensor_values.groupBy("stage").agg(F.count_distinct("feature").alias("features"))
    return rounded(Q.stage_profile(quality, timing, feats), "rate", "mean_d", "p90_d")


@query("agg32_cohort_comparison", sql("v first_entry lab", """, f AS (SELECT CAST(floor(t / 7.0) AS INTEGER) AS p, coalesce(label, 0) AS y, entity IN (SELECT entity FROM v WHERE stage = 6) AS m
  FROM first_entry LEFT JOIN lab USING (entity)), a AS (SELECT * FROM f WHERE p IN (SELECT p FROM f WHERE m))
  SELECT 'members' AS cohort, count(*) AS n, CAST(sum(y) AS BIGINT) AS defects, round(avg(y), 6) AS rate FROM a WHERE m
  UNION ALL SELECT 'all', count(*), CAST(sum(y) AS BIGINT), round(avg(y), 6) FROM a UNION ALL SELECT 'others', count(*), CAST(sum(y) AS BIGINT), round(avg(y), 6) FROM a WHERE NOT m"""))
def agg32(d):
    first = T.first_event(d.visits, ("entity",), "entry")
    members = d.visits.where("stage = 6").select("entity").distinct()
    return rounded(Q.cohort(first, members, d.labels, "entry", DAY_SCALE), "rate")


@query("agg33_active_span", sql("v", """, w AS (SELECT stage, CAST(floor(entry / 7.0) AS INTEGER) AS period, count(*) AS n, min(entry) AS lo, max(entry) AS hi FROM v GROUP BY 1, 2)
  SELECT stage, min(lo) AS first_t, max(hi) AS last_t, min(period) AS first_period, max(period) AS last_period, count(*) AS periods, max(n) AS max_n, CAST(sum(n) AS BIGINT) AS visits FROM w GROUP BY stage"""))
def agg33(d):
    return Q.active_span(d.visits, "stage", "entry", DAY_SCALE)


# ---- drift -----------------------------------------------------------------------------------------------

def labelled_values(d):
    return d.sensor_values.join(d.labels, "entity", "left").withColumn("label", F.coalesce("label", F.lit(0)))


@query("agg27_stage_drift", sql("lsens", """, g AS (SELECT stage, feature, count(*) AS total, avg(value) AS mu, CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1.0 END AS sigma
  FROM lsens GROUP BY stage, feature HAVING count(*) >= 50),
  w AS (SELECT stage, feature, floor(entry / 7.0) AS period, count(*) AS n, avg(value) AS mean, sum(label) AS defects FROM lsens GROUP BY 1, 2, 3)
  SELECT stage, feature, max(total) AS n, round(max(mu), 6) AS mu, round(max(sigma), 6) AS sigma, round(max(abs((mean - mu) / sigma)), 6) AS max_abs_z, round(max(defects / n), 6) AS peak_rate,
  round(sum(defects) / sum(n), 6) AS rate, round(max(defects / n) / (sum(defects) / sum(n)), 6) AS spike_ratio FROM w JOIN g USING (stage, feature) GROUP BY stage, feature"""))
def agg27(d):
    out = D.stage_drift(labelled_values(d), "entry", DAY_SCALE)
    return rounded(out, "mu", "sigma", "max_abs_z", "peak_rate", "rate", "spike_ratio")


@query("agg34_period_feature_z", sql("sens", f""", g AS (SELECT stage, feature, avg(value) AS mu, stddev_samp(value) AS sigma FROM sens GROUP BY 1, 2),
  w AS (SELECT stage, feature, CAST(floor(entry / 7.0) AS INTEGER) AS period, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std FROM sens GROUP BY 1, 2, 3)
  SELECT stage, feature, period, n, {half_up('mean', 6)} AS mean, round(std, 5) AS std, round((mean - mu) / sigma, 5) AS z FROM w JOIN g USING (stage, feature)"""))
def agg34(d):
    out = rounded(D.period_z(d.sensor_values, "entry", DAY_SCALE), "std", "z", digits=5)
    out = out.withColumn("mean", S.round_half_up(F.col("mean"), 6))
    return out.orderBy(F.desc(F.abs("z")), "stage", "feature", "period")


@query("srt2_top_bottom_periods", sql("v", """, w AS (SELECT CAST(floor(entry / 7.0) AS INTEGER) AS period, count(*) AS n FROM v GROUP BY 1)
  SELECT 'top' AS kind, * FROM (SELECT period, n FROM w ORDER BY n DESC, period LIMIT 5) UNION ALL SELECT 'bottom', * FROM (SELECT period, n FROM w ORDER BY n, period LIMIT 5)"""))
def srt2(d):
    w = T.per_period(d.visits, "entry", DAY_SCALE)
    top = w.orderBy(F.desc("n"), "period").limit(5)
    low = w.orderBy("n", "period").limit(5)
    return top.select(F.lit("top").alias("kind"), "*").unionByName(low.select(F.lit("bottom").alias("kind"), "*"))
