"""Visits, routes, throughput and pacing queries."""

from pyspark.sql import functions as F

from stageflow.functions import scalar as S
from stageflow.functions.timescale import DAY_SCALE
from stageflow.operators import primitives as P
from stageflow.operators import routes as R
from stageflow.operators import throughput as T
from stageflow.operators import visits as V
from stageflow.plans import base  # noqa: F401
from stageflow.plans.registry import query, sql
from stageflow.sources.tables import DAY_MINUTES, FORK, STAGES, wide_names

SEGMENTS = ((1, 2), (2, 3), (3, 4), (4, 5), (4, 6), (5, 7), (6, 7))
SEGMENT_NAMES = tuple(f"S{a}->S{b}" for a, b in SEGMENTS)
PATTERNS = {"p_12": ("S1->S2",), "p_34": ("S3->S4",), "p_fork": ("S5->S7", "S6->S7"), "p_any": ("S1->S2", "S3->S4", "S5->S7", "S6->S7")}


def rounded(df, *cols, digits=6):
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c), digits))
    return df


def routes_labelled(d):
    return V.attach_label(R.build_routes(d.visits), d.labels)


@query("agg5_visits", sql("v", "SELECT entity, stage, line, entry, exit, duration FROM v"))
def agg5(d):
    return d.visits.select("entity", "stage", "line", "entry", "exit", "duration")


@query("agg5_visits_from_wide", sql("v", "SELECT entity AS \"Id\", stage, entry, exit, duration FROM v WHERE entity IN (SELECT o_orderkey FROM orders)"))
def agg5_wide(d):
    return V.visits_from_wide(d.wide, "Id", {s: wide_names()[s][:2] for s in STAGES})


@query("agg6_entity_span", sql("v", """SELECT o_orderkey AS "Id", min(entry) AS first_t, max(exit) AS last_t, max(exit) - min(entry) AS cycle
  FROM orders LEFT JOIN v ON o_orderkey = entity GROUP BY o_orderkey"""))
def agg6(d):
    return V.entity_span(d.wide, "Id", [c for s in STAGES for c in wide_names()[s][:2]])


@query("agg7_stage_durations", sql("v", """SELECT stage, count(*) AS visits, round(avg(duration), 6) AS mean_d, quantile_cont(duration, 0.5) AS median_d,
  round(quantile_cont(duration, 0.9), 6) AS p90_d, round(quantile_cont(duration, 0.99), 6) AS p99_d, max(duration) AS max_d,
  round(count(*) FILTER (duration = 0) * 100.0 / count(*), 6) AS zero_pct, min(entry) AS entry_min, max(entry) AS entry_max,
  round(avg(entry), 6) AS entry_mean, round(avg(duration) * 1440.0, 6) AS mean_minutes FROM v GROUP BY stage"""))
def agg7(d):
    return rounded(T.duration_summary(d.visits, "stage", DAY_SCALE), "mean_d", "p90_d", "p99_d", "zero_pct", "entry_mean", "mean_minutes")


@query("agg8_routes", sql("routes", "SELECT entity, route FROM routes"))
def agg8(d):
    return R.build_routes(d.visits).select("entity", "route")


@query("agg9_route_length_lines", sql("routes_l", "SELECT entity, num_stages, line_sequence FROM routes_l"))
def agg9(d):
    return R.build_routes(d.visits).select("entity", "num_stages", "line_sequence")


RANK_SQL = """SELECT {by}, count(*) AS entities, min(num_stages) AS num_stages, CAST(sum(label) AS BIGINT) AS defects,
  round(avg(label), 6) AS defect_rate, round(count(*) * 100.0 / (SELECT count(*) FROM routes_l), 6) AS volume_pct FROM routes_l GROUP BY {by}"""


@query("agg10_route_ranking", sql("routes_l", RANK_SQL.format(by="route")))
def agg10(d):
    return rounded(R.rank_routes(routes_labelled(d)), "defect_rate", "volume_pct").orderBy(F.desc("entities"), "route")


@query("agg11_line_sequence_ranking", sql("routes_l", RANK_SQL.format(by="line_sequence")))
def agg11(d):
    return rounded(R.rank_routes(routes_labelled(d), by="line_sequence"), "defect_rate", "volume_pct")


@query("agg12_route_length_histogram", sql("routes", "SELECT num_stages, count(*) AS entities FROM routes GROUP BY num_stages"))
def agg12(d):
    lengths = d.visits.groupBy("entity").agg(F.count(F.lit(1)).cast("int").alias("num_stages"))
    return R.route_lengths(lengths)


def _hit(path):
    return f"contains('->' || route || '->', '->{path}->')"


@query("agg13_pattern_coverage", sql("routes_l", " UNION ALL ".join(
    f"""SELECT '{n}' AS pattern, count(*) FILTER ({c}) AS entities, CAST(sum(CASE WHEN {c} THEN label ELSE 0 END) AS BIGINT) AS defects,
  round(count(*) FILTER ({c}) * 100.0 / count(*), 6) AS share_pct, round(sum(CASE WHEN {c} THEN label ELSE 0 END) / nullif(count(*) FILTER ({c}), 0), 6) AS defect_rate FROM routes_l"""
    for n, c in ((n, "(" + " OR ".join(_hit(p) for p in ps) + ")") for n, ps in PATTERNS.items()))))
def agg13(d):
    return rounded(R.pattern_coverage(routes_labelled(d), PATTERNS), "share_pct", "defect_rate")


@query("prj24_path_contains", sql("routes", f"SELECT entity, {_hit('S1->S2')} AS has_12, {_hit('S7')} AS has_7, {_hit('S3->S4')} AS has_34, {_hit('S5->S7')} AS has_57 FROM routes"))
def prj24(d):
    c = F.col("route")
    return R.build_routes(d.visits).select(
        "entity",
        S.contains_path(c, "S1->S2").alias("has_12"), S.contains_path(c, "S7").alias("has_7"),
        S.contains_path(c, "S3->S4").alias("has_34"), S.contains_path(c, "S5->S7").alias("has_57"),
    )



@query("agg14_arrival_summary", sql("tk", """SELECT CAST(sum(n) AS BIGINT) AS n, max(entry) - min(entry) AS span,
  round(sum(n) / ((max(entry) - min(entry)) * 24.0), 6) AS per_hour, round(sum(n) / ((max(entry) - min(entry)) * 24.0) * 24.0, 6) AS per_day,
  round(sum(n) / (max(entry) - min(entry)) * 7.0, 6) AS per_period, round((max(entry) - min(entry)) / (sum(n) - 1), 9) AS mean_interarrival,
  round(avg(gap), 6) AS mean_positive_gap, quantile_cont(gap, 0.5) AS median_positive_gap,
  round((sum(n) - count(*)) / (sum(n) - 1), 6) AS zero_gap_share FROM tk"""))
def agg14(d):
    out = T.arrival_summary(d.visits.where("stage = 1"), "entry", DAY_SCALE)
    out = rounded(out, "per_hour", "per_day", "per_period", "mean_positive_gap", "zero_gap_share")
    return rounded(out, "mean_interarrival", digits=9)


@query("win2_interarrival", sql("tk", "SELECT entry, n, gap FROM tk"))
def win2(d):
    return T.arrival_gaps(d.visits.where("stage = 1"), "entry").select("entry", "n", "gap")


@query("win2_interarrival_events", sql("ev", "SELECT us, us - lag(us) OVER (ORDER BY us) AS gap FROM (SELECT DISTINCT us FROM ev)"))
def win2_events(d):
    return T.arrival_gaps(d.events, "us", levels=3).select("us", "gap")


@query("agg15_batch_sizes", sql("v", """, g AS (SELECT stage, entry, count(*) AS n, entry - lag(entry) OVER (PARTITION BY stage ORDER BY entry) AS gap FROM v GROUP BY stage, entry)
  SELECT stage, count(*) AS batches, round(avg(n), 6) AS mean_size, quantile_cont(n, 0.5) AS median_size, round(quantile_cont(n, 0.9), 6) AS p90_size,
  CAST(max(n) AS BIGINT) AS max_size, round(avg(gap), 6) AS mean_gap, quantile_cont(gap, 0.5) AS median_gap FROM g GROUP BY stage"""))
def agg15(d):
    return rounded(T.batch_sizes(d.visits, "entry", ("stage",)), "mean_size", "p90_size", "mean_gap")


@query("agg16_throughput_per_period", sql("v", """SELECT CAST(floor(t / 7.0) AS INTEGER) AS period, count(*) AS n
  FROM (SELECT entity, min(entry) AS t FROM v GROUP BY entity) GROUP BY 1"""))
def agg16(d):
    return T.per_period(T.first_event(d.visits, ("entity",), "entry"), "entry", DAY_SCALE)


@query("agg17_line_period_crosstab", sql("v", """SELECT CAST(floor(t / 7.0) AS INTEGER) AS period, count(*) FILTER (line = 0) AS line_0, count(*) FILTER (line = 1) AS line_1,
  count(*) FILTER (line = 2) AS line_2, count(*) FILTER (line = 3) AS line_3 FROM (SELECT entity, line, min(entry) AS t FROM v GROUP BY entity, line) GROUP BY 1"""))
def agg17(d):
    first = T.first_event(d.visits, ("entity", "line"), "entry")
    return T.period_crosstab(first, "entry", "line", (0, 1, 2, 3), DAY_SCALE, "line")


@query("agg18_stage_throughput", sql("v", """, w AS (SELECT stage, floor(entry / 7.0) AS p, count(*) AS n FROM v GROUP BY 1, 2)
  SELECT stage, CAST(sum(n) AS BIGINT) AS total, count(*) AS periods, round(avg(n), 6) AS mean_n, quantile_cont(n, 0.5) AS median_n, max(n) AS max_n, min(n) AS min_n,
  round(stddev_samp(n), 6) AS std_n, round(avg(n) / 168.0, 6) AS per_hour FROM w GROUP BY stage"""))
def agg18(d):
    return rounded(T.stage_throughput(d.visits, "stage", "entry", DAY_SCALE), "mean_n", "std_n", "per_hour")


@query("shp3_crosstab_fill", sql("v", """SELECT stage, count(*) FILTER (w = 0) AS n_0, count(*) FILTER (w = 1) AS n_1, count(*) FILTER (w = 2) AS n_2 FROM (
  SELECT stage, CAST(floor(entry / 7.0) AS INTEGER) % 3 AS w FROM v) GROUP BY stage"""))
def shp3(d):
    third = DAY_SCALE.bucket(F.col("entry")) % 3
    out = d.visits.withColumn("w", third).groupBy("stage").pivot("w", [0, 1, 2]).count().fillna(0)
    return out.select("stage", *[F.col(str(i)).alias(f"n_{i}") for i in range(3)])


PIV_SQL = ", ".join(f"max(CASE WHEN stage = {s} THEN {c} END) AS {p}_{s}" for c, p in (("entry", "entry"), ("exit", "exit")) for s in STAGES)


@query("shp1_pivot_stages", sql("v", f"SELECT entity, {PIV_SQL} FROM v GROUP BY entity"))
def shp1(d):
    return V.pivot_stages(d.visits, "entity", "stage", STAGES, {"entry": "entry", "exit": "exit"})


@query("jn6_stage_chain", sql("v", f"SELECT v1.entity, {', '.join(f'v{s}.entry AS t{s}' for s in STAGES)} FROM v v1 "
  + " ".join(f"LEFT JOIN v v{s} ON v1.entity = v{s}.entity AND v{s}.stage = {s}" for s in STAGES if s != 1) + " WHERE v1.stage = 1"))
def jn6(d):
    piv = V.pivot_stages(d.visits, "entity", "stage", STAGES, {"entry": "t"}).where(F.col("t_1").isNotNull())
    return piv.select("entity", *[F.col(f"t_{s}").alias(f"t{s}") for s in STAGES])


@query("shp2_core_flow", sql("v", """SELECT entity, CASE WHEN s6 THEN 1 ELSE 0 END AS branch FROM (SELECT entity, bool_or(stage = 1) AS s1, bool_or(stage = 2) AS s2,
  bool_or(stage = 5) AS s5, bool_or(stage = 6) AS s6 FROM v GROUP BY entity) WHERE s1 AND s2 AND (s5 <> s6)"""))
def shp2(d):
    piv = V.pivot_stages(d.visits, "entity", "stage", STAGES, {"entry": "entry"})
    return V.core_flow(piv, (1, 2), FORK).select("entity", "branch")


@query("shp4_sensor_map", sql("v", """SELECT entity, stage, CAST((qty IS NOT NULL)::INT + (price IS NOT NULL)::INT + (disc IS NOT NULL)::INT + (tax IS NOT NULL)::INT AS INTEGER) AS n_features,
  qty, disc FROM v"""))
def shp4(d):
    m = d.visits.withColumn("features", V.sensor_map(("qty", "price", "disc", "tax")))
    return m.select("entity", "stage", F.size("features").alias("n_features"), F.col("features")["qty"].alias("qty"), F.col("features")["disc"].alias("disc"))


@query("win1_previous_transit", sql("m", "SELECT entity, stage, stage_rank, t, prev_stage, transit_minutes FROM m"))
def win1(d):
    return d.messages.select("entity", "stage", "stage_rank", "t", "prev_stage", "transit_minutes")


def _gap_sql(start):
    """SQL text of the long gap table."""
    piv = f"piv AS (SELECT entity, {PIV_SQL} FROM v GROUP BY entity)"
    segs = " UNION ALL ".join(
        f"SELECT 'S{a}->S{b}' AS segment, entry_{b} - {start}_{a} AS gap, entry_{b} AS arrived FROM piv" for a, b in SEGMENTS
    )
    return f", {piv}, gaps AS (SELECT * FROM ({segs}) WHERE gap IS NOT NULL) "


@query("agg24_segment_transits", sql("v", _gap_sql("entry") + """SELECT segment, CAST(count(*) FILTER (gap >= 0) AS BIGINT) AS n,
  round(quantile_cont(gap, 0.5) FILTER (gap >= 0) * 1440.0, 4) AS median_min, round(quantile_cont(gap, 0.9) FILTER (gap >= 0) * 1440.0, 4) AS p90_min,
  round(quantile_cont(gap, 0.95) FILTER (gap >= 0) * 1440.0, 4) AS p95_min, round(quantile_cont(gap, 0.99) FILTER (gap >= 0) * 1440.0, 4) AS p99_min,
  round(avg(gap) FILTER (gap >= 0) * 1440.0, 4) AS mean_min, round(count(*) FILTER (gap = 0) * 100.0 / count(*), 6) AS zero_pct FROM gaps GROUP BY segment"""))
def agg24(d):
    piv = V.pivot_stages(d.visits, "entity", "stage", STAGES, {"entry": "entry"})
    out = T.segment_transits(T.segment_gaps(piv, SEGMENTS), DAY_MINUTES)
    return rounded(rounded(out, "median_min", "p90_min", "p95_min", "p99_min", "mean_min", digits=4), "zero_pct")


@query("agg25_duration_percentiles", sql("v", """SELECT stage, round(quantile_cont(duration, 0.5), 6) AS p50, round(quantile_cont(duration, 0.9), 6) AS p90,
  round(quantile_cont(duration, 0.95), 6) AS p95, round(quantile_cont(duration, 0.99), 6) AS p99, round(avg(duration), 6) AS mean_d, max(duration) AS max_d
  FROM v WHERE stage IN (2, 4) GROUP BY stage"""))
def agg25(d):
    return rounded(T.duration_percentiles(d.visits, "stage", (2, 4)), "p50", "p90", "p95", "p99", "mean_d")


@query("agg26_period_segment_transits", sql("v", _gap_sql("exit") + "SELECT CAST(floor(arrived / 7.0) AS INTEGER) AS period, " + ", ".join(
    f"""round(quantile_cont(gap, 0.9) FILTER (segment = '{s}'), 6) AS {k}_p90, round(quantile_cont(gap, 0.99) FILTER (segment = '{s}'), 6) AS {k}_p99,
  round(count(*) FILTER (gap = 0 AND segment = '{s}') * 100.0 / nullif(count(*) FILTER (segment = '{s}'), 0), 6) AS {k}_zero_pct""" for s, k in ((s, s.replace("->", "_")) for s in SEGMENT_NAMES)) + " FROM gaps GROUP BY 1"))
def agg26(d):
    piv = V.pivot_stages(d.visits, "entity", "stage", STAGES, {"entry": "entry", "exit": "exit"})
    out = T.period_segment_transits(T.segment_gaps(piv, SEGMENTS, start="exit"), DAY_SCALE, SEGMENT_NAMES)
    return rounded(out, *[c for c in out.columns if c != "period"])


@query("agg43_cycle_distribution", sql("v", """, c AS (SELECT (max(exit) - min(entry)) * 24.0 AS h FROM v WHERE entity IN (SELECT o_orderkey FROM orders) GROUP BY entity)
  SELECT CAST(least(floor(h / 4380.0), 11) AS INTEGER) AS bin, count(*) AS n,
  round((SELECT count(*) FILTER (h <= 168.0) * 100.0 / count(*) FROM c), 6) AS within_pct FROM c GROUP BY 1"""))
def agg43(d):
    spans = V.entity_span(d.wide, "Id", [c for s in STAGES for c in wide_names()[s][:2]])
    return rounded(T.cycle_distribution(spans, DAY_SCALE, 168.0, 4380.0, 12), "within_pct")


@query("prim1_running_totals", sql("v", """SELECT stage, entry, n, CAST(sum(n) OVER (PARTITION BY stage ORDER BY entry) AS BIGINT) AS cum_n FROM (
  SELECT stage, entry, count(*) AS n FROM v GROUP BY stage, entry)"""))
def prim1(d):
    return P.running(d.visits, "entry", {"n": ("sum", F.lit(1))}, ("stage",), width=64, levels=1).select("stage", "entry", "n", "cum_n")


@query("prim1_global_rank", sql("v", "SELECT entity, stage, entry, row_number() OVER (ORDER BY entry, entity * 8 + stage) AS rank FROM v"))
def prim1_rank(d):
    tie = d.visits.withColumn("tie", F.col("entity") * 8 + F.col("stage"))
    return P.ranked(tie, "entry", "tie", width=64, levels=1, tie_width=1024).select("entity", "stage", "entry", "rank")


@query("prim2_dense_grid", sql("v", """SELECT stage, unnest(generate_series(lo, hi, 30)) AS slot FROM (SELECT stage, min(entry) AS lo, max(entry) AS hi FROM v GROUP BY stage)"""))
def prim2(d):
    bounds = d.visits.groupBy("stage").agg(F.min("entry").alias("lo"), F.max("entry").alias("hi"))
    return P.dense_grid(bounds, "lo", "hi", 30).select("stage", "slot")


@query("prim3_islands", sql("v", """SELECT stage, entry, CAST(entry - row_number() OVER (PARTITION BY stage ORDER BY entry) AS BIGINT) AS island FROM (SELECT DISTINCT stage, entry FROM v)"""))
def prim3(d):
    return P.islands(d.visits.select("stage", "entry").distinct(), "entry", ("stage",)).select("stage", "entry", "island")


@query("srt1_chronological_order", sql("m", "SELECT entity, stage, stage_rank, t FROM m"))
def srt1(d):
    return d.messages.select("entity", "stage", "stage_rank", "t").orderBy("t", "stage_rank", "entity")
