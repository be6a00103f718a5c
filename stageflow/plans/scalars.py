"""Projection queries: conversions, scores, p-values, filters."""

from pyspark.sql import functions as F

from stageflow.functions import scalar as S
from stageflow.functions import stats as ST
from stageflow.functions.timescale import DAY_SCALE
from stageflow.operators import joins as J
from stageflow.operators import profile as PR
from stageflow.operators import visits as V
from stageflow.plans.flow import rounded
from stageflow.plans.registry import half_up, query, sql
from stageflow.sources.tables import FORK, SENSORS, STAGES
from stageflow.session import dictionary

CFG = S.ScoreConfig()


def erfc_sql(x: str) -> str:
    """SQL text of the same rational fit as ``stats.erfc``."""
    t = f"(1.0 / (1.0 + abs({x}) * 0.5))"
    poly = repr(ST.ERFC_COEFFICIENTS[-1])
    for c in reversed(ST.ERFC_COEFFICIENTS[:-1]):
        poly = f"({c!r} + {t} * {poly})"
    tail = f"{t} * exp(-({x}) * ({x}) + {poly})"
    return f"(CASE WHEN {x} >= 0 THEN {tail} ELSE 2.0 - {tail} END)"


def clamp_sql(x: str, lo: float, hi: float) -> str:
    return f"greatest({lo}, least({hi}, {x}))"


@query("prj2_topic_parse", sql("v", """, t AS (SELECT entity, stage, unnest(['factory/line3/S' || stage || '/telemetry', 'factory/line3/parts/' || entity || '/risk', 'twin/ai/window']) AS topic FROM v)
  SELECT topic, count(*) AS n, CASE WHEN len(string_split(topic, '/')) >= 4 AND string_split(topic, '/')[1] = 'factory' AND string_split(topic, '/')[2] = 'line3'
  THEN string_split(topic, '/')[3] ELSE '' END AS stage_id FROM t GROUP BY topic"""))
def prj2(d):
    s, e = F.col("stage").cast("string"), F.col("entity").cast("string")
    topics = F.array(
        F.concat(F.lit("factory/line3/S"), s, F.lit("/telemetry")), F.concat(F.lit("factory/line3/parts/"), e, F.lit("/risk")),
        F.lit(S.TOPICS["ai_window"]),
    )
    t = d.visits.select(F.explode(topics).alias("topic"))
    return t.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).withColumn("stage_id", S.topic_stage(F.col("topic")))


@query("prj3_time_conversion", sql("v", "SELECT entity, stage, duration * 24.0 AS hours, duration * 1440.0 AS minutes, duration * 86400.0 AS seconds FROM v"))
def prj3(d):
    t = F.col("duration")
    return d.visits.select(
        "entity", "stage", DAY_SCALE.to_hours(t).alias("hours"), DAY_SCALE.to_minutes(t).alias("minutes"), DAY_SCALE.to_seconds(t).alias("seconds")
    )


@query("prj4_period_bucket", sql("v", "SELECT entity, stage, CAST(floor(entry / 7.0) AS INTEGER) AS period FROM v"))
def prj4(d):
    return d.visits.select("entity", "stage", DAY_SCALE.bucket(F.col("entry")).alias("period"))


@query("prj5_absolute_time", sql("v", "SELECT entity, stage, 788918400000000 + entry * 86400000000 AS us FROM v"))
def prj5(d):
    at = DAY_SCALE.to_timestamp(F.col("entry"), 788918400000000)
    return d.visits.select("entity", "stage", F.unix_micros(at).alias("us"))


@query("prj6_clipped_transit", sql("v", """, p AS (SELECT entity, max(CASE WHEN stage = 1 THEN entry END) AS a, max(CASE WHEN stage = 2 THEN entry END) AS b FROM v GROUP BY entity)
  SELECT entity, coalesce(greatest(0.0, (b - a) * 1440.0), 0.0) AS transit FROM p"""))
def prj6(d):
    piv = V.pivot_stages(d.visits, "entity", "stage", STAGES, {"entry": "e"})
    return piv.select("entity", S.clipped_transit(F.col("e_2"), F.col("e_1"), 1440.0).alias("transit"))


def scored_values(d):
    return d.visits.unpivot(["entity", "stage"], list(SENSORS), "feature", "value")


Z_FROM = """, u AS (SELECT entity, stage, unnest(['qty', 'price', 'disc', 'tax']) AS feature, unnest([qty, price, disc, tax]) AS value FROM v),
  b AS (SELECT * FROM baseline WHERE NOT (stage = 7 AND feature = 'tax'))"""


@query("prj7_z_score_with_default", sql("v baseline", Z_FROM + " SELECT entity, u.stage, u.feature, round(coalesce((value - mean) / std, 0.0), 6) AS z FROM u LEFT JOIN b ON u.stage = b.stage AND u.feature = b.feature"))
def prj7(d):
    base = PR.baselines(d.sensor_values, ("stage", "feature")).where("NOT (stage = 7 AND feature = 'tax')")
    joined = scored_values(d).join(dictionary(base, "baselines"), ["stage", "feature"], "left")
    z = S.z_score(F.col("value"), F.col("mean"), F.col("std"))
    return rounded(joined.select("entity", "stage", "feature", z.alias("z")), "z")


@query("prj8_abs_z_nullable", sql("v baseline", Z_FROM + " SELECT entity, u.stage, u.feature, round(abs((value - mean) / greatest(std, 0.001)), 6) AS abs_z FROM u LEFT JOIN b ON u.stage = b.stage AND u.feature = b.feature"))
def prj8(d):
    base = PR.baselines(d.sensor_values, ("stage", "feature")).where("NOT (stage = 7 AND feature = 'tax')")
    joined = scored_values(d).join(dictionary(base, "baselines"), ["stage", "feature"], "left")
    return rounded(joined.select("entity", "stage", "feature", S.abs_z(F.col("value"), F.col("mean"), F.col("std")).alias("abs_z")), "abs_z")


@query("prj9_drift_subscore", "SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_discount > 0 THEN round(greatest(0.0, least(100.0, 100.0 - (l_quantity / 10.0 - 1.0) * (100.0 / 3.0))), 6) ELSE 100.0 END AS score FROM lineitem")
def prj9(d):
    score = S.drift_score(F.col("l_quantity") / 10.0, (F.col("l_discount") > 0).cast("int"))
    return rounded(d.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", score.alias("score")), "score")


PACING_SQL = """CASE WHEN prev_stage IS NULL THEN 100.0 WHEN transit_minutes <= p90 THEN 100.0
  WHEN transit_minutes <= p99 THEN 100.0 - 40.0 * (transit_minutes - p90) / greatest(0.001, p99 - p90)
  ELSE greatest(0.0, 60.0 - 60.0 * (transit_minutes - p99) / greatest(1.0, p99)) END"""


@query("prj10_pacing_subscore", sql("m seg", f"""SELECT entity, stage, round({PACING_SQL}, 6) AS score FROM (SELECT m.*, coalesce(seg.p90, 6.0238) AS p90, coalesce(seg.p99, 36.1060) AS p99
  FROM m LEFT JOIN seg ON m.prev_stage = seg.a AND m.stage = seg.b)"""))
def prj10(d):
    from stageflow.plans.joins import segment_benchmark

    j = J.lookup_with_default(d.messages, segment_benchmark(d), ("prev_stage", "stage"), {"p90": 6.0238, "p99": 36.1060})
    score = S.pacing_score(F.col("transit_minutes"), F.col("p90"), F.col("p99"), F.col("prev_stage").isNotNull())
    return rounded(j.select("entity", "stage", score.alias("score")), "score")


DEFECT_SQL = "CASE WHEN {r} <= 1.0 THEN 100.0 WHEN {r} <= 3.0 THEN 100.0 - 50.0 * ({r} - 1.0) / 2.0 ELSE greatest(0.0, 50.0 - 50.0 * ({r} - 3.0) / 4.0) END"


@query("prj11_defect_subscore", sql("lv", """, w AS (SELECT stage, CAST(floor(entry / 7.0) AS INTEGER) AS period, avg(label) AS rate FROM lv GROUP BY 1, 2)
  SELECT stage, period, round(""" + DEFECT_SQL.format(r="(rate / greatest(0.00001, 0.1))") + ", 6) AS score FROM w"))
def prj11(d):
    w = d.labelled_visits.groupBy("stage", DAY_SCALE.bucket(F.col("entry")).alias("period")).agg(F.avg("label").alias("rate"))
    return rounded(w.select("stage", "period", S.defect_score(F.col("rate"), F.lit(0.1)).alias("score")), "score")


def _health_cols():
    """Three sub-score stand-ins in [0, 100] taken from the raw readings."""
    return F.col("l_quantity") * 1.7123, F.col("l_discount") * 913.7, F.col("l_tax") * 1187.3


H_SQL = half_up("greatest(0.0, least(100.0, l_quantity * 1.7123 * 0.45 + l_discount * 913.7 * 0.30 + l_tax * 1187.3 * 0.25))", 2)


@query("prj12_composite_health", f"SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, {H_SQL} AS health FROM lineitem")
def prj12(d):
    h = S.composite_health(*_health_cols(), CFG)
    return d.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", h.alias("health"))


@query("prj13_status_band", f"SELECT CASE WHEN h >= 80 THEN 'HEALTHY' WHEN h >= 50 THEN 'WARNING' ELSE 'CRITICAL' END AS status, count(*) AS n FROM (SELECT {H_SQL} AS h FROM lineitem) GROUP BY 1")
def prj13(d):
    h = S.composite_health(*_health_cols(), CFG)
    return d.table("lineitem").select(S.health_status(h, CFG).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


RISK_SQL = half_up("greatest(0.005069, least(0.99, (0.5 * least(1.0, a * 0.22) + 0.3 * greatest(0.0, (100.0 - h) / 100.0)) / 0.8))", 4)


@query("prj14_rule_risk", f"SELECT a, h, count(*) AS n, {RISK_SQL} AS risk FROM (SELECT CAST(l_discount * 100 AS INTEGER) AS a, l_quantity * 2.0 AS h FROM lineitem) GROUP BY a, h")
def prj14(d):
    base = d.table("lineitem").select(F.round(F.col("l_discount") * 100).cast("int").alias("a"), (F.col("l_quantity") * 2.0).alias("h"))
    grouped = base.groupBy("a", "h").agg(F.count(F.lit(1)).alias("n"))
    return grouped.withColumn("risk", S.rule_risk(F.col("a"), F.col("h"), CFG))


@query("prj15_risk_band", "SELECT CASE WHEN r < 0.3 THEN 'LOW' WHEN r < 0.7 THEN 'MEDIUM' ELSE 'HIGH' END AS level, count(*) AS n FROM (SELECT l_quantity / 50.0 AS r FROM lineitem) GROUP BY 1")
def prj15(d):
    level = S.risk_level(F.col("l_quantity") / 50.0, CFG)
    return d.table("lineitem").select(level.alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


BLEND_SQL = half_up("greatest(0.0, least(1.0, (l_quantity / 50.0) * 0.3 + (1.0 - l_tax * 1000.0 / 100.0) * 0.2 + greatest(0.0, least(1.0, ((l_discount / 4.0) / 0.00507 - 1.0) / 4.0)) * 0.2))", 3)


@query("prj16_blended_risk", f"SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, {BLEND_SQL} AS risk FROM lineitem")
def prj16(d):
    r = S.blended_risk(F.col("l_quantity") / 50.0, F.col("l_tax") * 1000.0, F.col("l_discount") / 4.0, CFG)
    return d.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", r.alias("risk"))


@query("prj17_high_risk_flag", "SELECT l_orderkey, l_linenumber, l_discount, l_discount >= 0.05 AS is_high_risk FROM lineitem")
def prj17(d):
    return d.table("lineitem").select("l_orderkey", "l_linenumber", "l_discount", (F.col("l_discount") >= CFG.high_prob).alias("is_high_risk"))


@query("prj18_logit_sigmoid", """SELECT l_discount, round(ln(p / (1.0 - p)), 6) AS logit, round(1.0 / (1.0 + exp(-ln(p / (1.0 - p)))), 6) AS back, count(*) AS n
  FROM (SELECT l_discount, greatest(0.000001, least(1.0 - 0.000001, l_discount)) AS p FROM lineitem) GROUP BY l_discount, p""")
def prj18(d):
    g = d.table("lineitem").groupBy("l_discount").agg(F.count(F.lit(1)).alias("n"))
    x = S.logit(F.col("l_discount"))
    return rounded(g.select("l_discount", x.alias("logit"), S.sigmoid(x).alias("back"), "n"), "logit", "back")


@query("prj19_missing_indicator", sql("v", "SELECT entity, stage, " + ", ".join(f"CAST({s} IS NULL AS INTEGER) AS {s}_isna" for s in SENSORS) + " FROM v"))
def prj19(d):
    return d.visits.select("entity", "stage", *[S.missing_flag(F.col(s)).alias(f"{s}_isna") for s in SENSORS])


@query("prj20_rate_columns", sql("lv", """, w AS (SELECT stage, CAST(floor(entry / 7.0) AS INTEGER) AS period, count(*) AS n, CAST(sum(label) AS BIGINT) AS defects FROM lv GROUP BY 1, 2)
  SELECT stage, period, round(defects * 100.0 / n, 6) AS rate_pct, round(n * 0.3, 6) AS expected, round(defects - n * 0.3, 6) AS excess, round(defects / greatest(0.000001, n * 0.3), 6) AS oe_ratio,
  round(CASE WHEN n > 10 THEN defects / (n - 10) END, 6) AS guarded FROM w"""))
def prj20(d):
    w = d.labelled_visits.groupBy("stage", DAY_SCALE.bucket(F.col("entry")).alias("period")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("defects"))
    exp = F.col("n") * 0.3
    out = w.select(
        "stage", "period", (F.col("defects") * 100.0 / F.col("n")).alias("rate_pct"), exp.alias("expected"), (F.col("defects") - exp).alias("excess"),
        (F.col("defects") / F.greatest(F.lit(1e-6), exp)).alias("oe_ratio"),
        S.ratio(F.col("defects"), F.greatest(F.col("n") - 10, F.lit(0))).alias("guarded"),
    )
    return rounded(out, "rate_pct", "expected", "excess", "oe_ratio", "guarded")


def _weekly(d):
    return d.labelled_visits.groupBy("stage", DAY_SCALE.bucket(F.col("entry")).alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("k")
    )


WEEKLY_SQL = ", w AS (SELECT stage, CAST(floor(entry / 7.0) AS INTEGER) AS period, count(*) AS n, CAST(sum(label) AS BIGINT) AS k FROM lv GROUP BY 1, 2)"
BZ = "((k - 0.5 - n * 0.25) / sqrt(n * 0.25 * 0.75))"
PZ = "((k - n * 0.25) / sqrt(n * 0.25 * 0.75))"


@query("prj21_binomial_tail", sql("lv", WEEKLY_SQL + f" SELECT stage, period, n, k, round(CASE WHEN k <= n * 0.25 THEN 1.0 ELSE greatest(0.0, least(1.0, 0.5 * {erfc_sql(f'({BZ} / {ST.SQRT2!r})')})) END, 9) AS p FROM w"))
def prj21(d):
    return rounded(_weekly(d).withColumn("p", ST.binomial_upper_p(F.col("k"), F.col("n"), F.lit(0.25))), "p", digits=9)


@query("prj22_mean_shift_p", sql("v", f""", w AS (SELECT stage, CAST(floor(entry / 7.0) AS INTEGER) AS period, count(*) AS n, avg(qty) AS m FROM v GROUP BY 1, 2)
  SELECT stage, period, n, round(least(1.0, {erfc_sql(f'((abs(m - 28.0) / (14.0 / sqrt(n))) / {ST.SQRT2!r})')}), 9) AS p FROM w"""))
def prj22(d):
    w = d.visits.groupBy("stage", DAY_SCALE.bucket(F.col("entry")).alias("period")).agg(F.count(F.lit(1)).alias("n"), F.avg("qty").alias("m"))
    return rounded(w.select("stage", "period", "n", ST.mean_shift_p(F.col("m"), F.lit(28.0), F.lit(14.0), F.col("n")).alias("p")), "p", digits=9)


@query("prj23_binomial_z", sql("lv", WEEKLY_SQL + f" SELECT stage, period, n, k, round({PZ}, 6) AS z, round(0.5 * {erfc_sql(f'({PZ} / {ST.SQRT2!r})')}, 9) AS p FROM w"))
def prj23(d):
    z = ST.binomial_z(F.col("k"), F.col("n"), F.lit(0.25))
    return rounded(rounded(_weekly(d).select("stage", "period", "n", "k", z.alias("z"), ST.upper_tail(z).alias("p")), "z"), "p", digits=9)


@query("stat1_normal_tail", f"""SELECT l_tax, l_discount, z, round(0.5 * {erfc_sql(f'(z / {ST.SQRT2!r})')}, 12) AS upper, round(0.5 * {erfc_sql(f'(-z / {ST.SQRT2!r})')}, 9) AS cdf, count(*) AS n
  FROM (SELECT l_tax, l_discount, round(l_discount * 60.0 - l_tax * 30.0, 2) AS z FROM lineitem) GROUP BY l_tax, l_discount, z""")
def stat1(d):
    g = d.table("lineitem").groupBy("l_tax", "l_discount").agg(F.count(F.lit(1)).alias("n"))
    z = F.round(F.col("l_discount") * 60.0 - F.col("l_tax") * 30.0, 2)
    out = g.select("l_tax", "l_discount", z.alias("z"), ST.upper_tail(z).alias("upper"), ST.normal_cdf(z).alias("cdf"), "n")
    return rounded(rounded(out, "upper", digits=12), "cdf", digits=9)


@query("prj25_explorer_filter", sql("lv", """SELECT entity, stage, entry, label FROM lv WHERE contains(CAST(entity AS VARCHAR), '12') AND label = 1 AND stage = 3
  ORDER BY entry, entity LIMIT 250"""))
def prj25(d):
    hit = d.labelled_visits.where(F.col("entity").cast("string").contains("12") & (F.col("label") == 1) & (F.col("stage") == 3))
    return hit.select("entity", "stage", "entry", "label").orderBy("entry", "entity").limit(250)


@query("prj26_half_unit_bin", "SELECT l_orderkey, l_linenumber, l_extendedprice, floor(l_extendedprice * 2) / 2.0 AS bin FROM lineitem")
def prj26(d):
    return d.table("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", S.half_bin(F.col("l_extendedprice")).alias("bin"))


@query("prj27_interval_filter", sql("v", """SELECT entity, stage, entry, entry <= 700 AS in_closed, entry < 700 AS in_half_open FROM v WHERE entry >= 400 AND entry <= 700"""))
def prj27(d):
    t, a, b = F.col("entry"), F.lit(400), F.lit(700)
    closed, half = S.in_interval(t, a, b), S.in_interval(t, a, b, "left")
    return d.visits.where(closed).select("entity", "stage", "entry", closed.alias("in_closed"), half.alias("in_half_open"))
