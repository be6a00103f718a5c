"""Join and set queries."""

from pyspark.sql import functions as F

from stageflow.functions.timescale import DAY_SCALE
from stageflow.operators import joins as J
from stageflow.operators import primitives as P
from stageflow.operators import throughput as T
from stageflow.plans.flow import rounded
from stageflow.plans.profile_quality import SCENARIO_TIMES, scenarios
from stageflow.plans.registry import cte, query, sql
from stageflow.sources import io

# Static predecessor of each stage (the two fork stages follow stage 4, the exit has none).
TOPOLOGY = ((1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, 4), (7, None))
cte("topo", "SELECT * FROM (VALUES " + ", ".join(f"({a}, {'NULL' if b is None else b})" for a, b in TOPOLOGY) + ") t(stage, static_prev)")


def topology(d):
    return io.parameter_table(d.spark, TOPOLOGY, "stage INT, static_prev INT")


@query("jn1_inner_entity", sql("v lab", "SELECT v.entity, v.stage, v.qty, lab.label FROM v JOIN lab USING (entity)"))
def jn1(d):
    return d.visits.join(d.labels, "entity").select("entity", "stage", "qty", "label")


@query("jn2_left_label", sql("lv", "SELECT entity, stage, label FROM lv"))
def jn2(d):
    return d.labelled_visits.select("entity", "stage", "label")


@query("jn3_left_semi", sql("v lab", "SELECT entity, stage, entry FROM v WHERE entity IN (SELECT entity FROM lab WHERE label = 1)"))
def jn3(d):
    return d.visits.select("entity", "stage", "entry").join(d.labels.where("label = 1"), "entity", "left_semi")


@query("jn4_left_anti", sql("lab r", "SELECT entity, label FROM lab WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.entity = lab.entity)"))
def jn4(d):
    return d.labels.join(d.rows.select("entity"), "entity", "left_anti")


cte("seg", """SELECT prev_stage AS a, stage AS b, quantile_cont(transit_minutes, 0.9) AS p90, quantile_cont(transit_minutes, 0.99) AS p99, count(*) AS n
  FROM m WHERE prev_stage IS NOT NULL GROUP BY 1, 2""", ["m"])


def segment_benchmark(d):
    """Pacing benchmark of every segment that the messages show."""
    counted = d.messages.where(F.col("prev_stage").isNotNull()).groupBy("prev_stage", "stage", "transit_minutes").agg(F.count(F.lit(1)).alias("n"))
    p = T.weighted_percentiles("transit_minutes", (0.9, 0.99), "n")
    return (
        counted.groupBy("prev_stage", "stage")
        .agg(p.getItem(0).alias("p90"), p.getItem(1).alias("p99"))
    )


@query("jn5_lookup_with_default", sql("m seg", """SELECT m.entity, m.stage, round(coalesce(seg.p90, 6.0238), 4) AS p90, round(coalesce(seg.p99, 36.1060), 4) AS p99
  FROM m LEFT JOIN seg ON m.prev_stage = seg.a AND m.stage = seg.b"""))
def jn5(d):
    out = J.lookup_with_default(d.messages, segment_benchmark(d), ("prev_stage", "stage"), {"p90": 6.0238, "p99": 36.1060})
    return rounded(out.select("entity", "stage", "p90", "p99"), "p90", "p99", digits=4)


@query("jn7_full_outer_fill", sql("v", """, a AS (SELECT CAST(floor(entry / 7.0) AS INTEGER) AS period, count(*) AS n_in FROM v WHERE stage = 1 GROUP BY 1),
  b AS (SELECT CAST(floor(exit / 7.0) AS INTEGER) AS period, count(*) AS n_out FROM v WHERE stage = 7 GROUP BY 1)
  SELECT coalesce(a.period, b.period) AS period, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out FROM a FULL JOIN b ON a.period = b.period"""))
def jn7(d):
    a = T.per_period(d.visits.where("stage = 1"), "entry", DAY_SCALE).withColumnRenamed("n", "n_in")
    b = T.per_period(d.visits.where("stage = 7"), "exit", DAY_SCALE).withColumnRenamed("n", "n_out")
    return J.full_by_period(a, b, "period")


@query("jn8_range_count", sql("v", """, e AS (SELECT entry AS t, count(*) AS n FROM v WHERE stage = 1 GROUP BY entry), p AS (SELECT DISTINCT entry FROM v WHERE stage IN (5, 6)),
  c AS (SELECT p.entry, (SELECT coalesce(sum(n), 0) FROM e WHERE e.t BETWEEN p.entry - 9 AND p.entry) AS k FROM p)
  SELECT v.entity, v.stage, v.entry, CAST(c.k AS BIGINT) AS arrivals FROM v JOIN c USING (entry) WHERE v.stage IN (5, 6)"""))
def jn8(d):
    probes = d.visits.where("stage IN (5, 6)").select("entity", "stage", "entry")
    return J.range_count(probes, d.visits.where("stage = 1").select("entry"), "entry", 9, "arrivals", "entry")


@query("jn8_range_count_events", sql("ev", """, s AS (SELECT us // 1000000 AS sec, stage FROM ev), e AS (SELECT stage, sec, count(*) AS n FROM s GROUP BY 1, 2)
  SELECT stage, sec, CAST(sum(n) OVER (PARTITION BY stage ORDER BY sec RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS BIGINT) AS last_hour FROM e"""))
def jn8_events(d):
    secs = d.events.select("stage", F.floor(F.col("us") / 1000000).cast("long").alias("sec"))
    return J.range_count(secs.distinct(), secs, "sec", 3600, "last_hour", "sec", ("stage",), levels=1).select("stage", "sec", "last_hour")


@query("jn9_recent_rate", sql("v lab", """, x AS (SELECT v.entity, exit AS t, label FROM v JOIN lab USING (entity) WHERE stage = 7),
  o AS (SELECT row_number() OVER (ORDER BY t, entity) AS k, t, CAST(sum(label) OVER (ORDER BY t, entity ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c FROM x),
  p AS (SELECT DISTINCT entry FROM v WHERE stage IN (5, 6)),
  q AS (SELECT p.entry, coalesce(max(k), 0) AS k, coalesce(max(c), 0) AS c FROM p LEFT JOIN (SELECT t, max(k) AS k, max(c) AS c FROM o GROUP BY t) o ON o.t <= p.entry GROUP BY p.entry),
  z AS (SELECT q.entry, CASE WHEN q.k > 0 THEN (q.c - coalesce(o.c, 0)) / least(q.k, 500) ELSE 0.005069 END AS rate FROM q LEFT JOIN o ON o.k = q.k - 500)
  SELECT v.entity, v.stage, v.entry, round(rate, 6) AS recent_rate FROM v JOIN z USING (entry) WHERE stage IN (5, 6)"""))
def jn9(d):
    probes = d.visits.where("stage IN (5, 6)").select("entity", "stage", "entry")
    outcomes = d.visits.where("stage = 7").join(d.labels, "entity").select(F.col("exit").alias("t"), "entity", "label")
    return rounded(J.recent_rate(probes, outcomes, "entry", "t", "entity", "label", 500, 0.005069), "recent_rate")


@query("jn10_sliding_grid", sql("lv", """, b AS (SELECT stage, min(entry) AS t0, max(entry) AS t1 FROM lv GROUP BY stage),
  g AS (SELECT stage, w AS width, t0, unnest(generate_series(0, CAST(ceil((t1 - w - t0) / 7.0) AS BIGINT) - 1)) AS i FROM b, (VALUES (7), (14), (30)) q(w)),
  e AS (SELECT stage, entry, count(*) AS n, sum(label) AS d FROM lv GROUP BY 1, 2)
  SELECT g.stage, g.width, g.t0 + g.i * 7 AS t_start, CAST(sum(n) AS BIGINT) AS n, CAST(sum(d) AS BIGINT) AS defects
  FROM g JOIN e ON e.stage = g.stage AND e.entry >= g.t0 + g.i * 7 AND e.entry < g.t0 + g.i * 7 + g.width GROUP BY 1, 2, 3"""))
def jn10(d):
    ticks = d.labelled_visits.groupBy("stage", "entry").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("d"))
    bounds = ticks.groupBy("stage").agg(F.min("entry").alias("t_min"), F.max("entry").alias("t_max"))
    widths = (("1w", 7), ("2w", 14), ("30d", 30))
    out = J.sliding_grid(ticks, bounds, ("stage",), "entry", widths, 7, {"n": F.sum("n"), "defects": F.sum("d")})
    return out.select("stage", F.col("width").cast("int").alias("width"), "t_start", "n", "defects")


@query("jn11_interval_mask", sql("v scen", "SELECT entity, stage, entry FROM v WHERE NOT EXISTS (SELECT 1 FROM scen WHERE entry BETWEEN t_start - 3 AND t_end + 3)"))
def jn11(d):
    return J.outside_intervals(d.visits.select("entity", "stage", "entry"), "entry", SCENARIO_TIMES, margin=3)


@query("jn11_interval_table_mask", sql("v scen", "SELECT entity, stage, entry FROM v WHERE NOT EXISTS (SELECT 1 FROM scen WHERE entry BETWEEN t_start - 3 AND t_end + 3)"))
def jn11_table(d):
    return J.outside_interval_table(d.visits.select("entity", "stage", "entry"), scenarios(d), "entry", margin=3, slot=32)


@query("jn12_dense_grid_left_join", sql("v", """, g AS (SELECT stage, unnest(generate_series(lo, hi)) AS period FROM (SELECT stage, min(entry) // 7 AS lo, max(entry) // 7 AS hi FROM v GROUP BY stage)),
  w AS (SELECT stage, entry // 7 AS period, count(*) AS n, max(duration) AS max_d FROM v GROUP BY 1, 2)
  SELECT g.stage, g.period, coalesce(n, 0) AS n, max_d FROM g LEFT JOIN w USING (stage, period)"""))
def jn12(d):
    w = d.visits.groupBy("stage", DAY_SCALE.bucket(F.col("entry")).cast("long").alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.max("duration").alias("max_d")
    )
    bounds = w.groupBy("stage").agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    grid = P.dense_grid(bounds, "lo", "hi", 1, "period").select("stage", "period")
    return grid.join(w, ["stage", "period"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("jn13_predecessor", sql("m topo", "SELECT entity, m.stage, coalesce(prev_stage, static_prev) AS incoming FROM m LEFT JOIN topo ON topo.stage = m.stage"))
def jn13(d):
    return J.predecessor(d.messages, topology(d)).select("entity", "stage", "incoming")


@query("set1_union_by_name", sql("v lab", "SELECT entity, stage, entry, NULL::INTEGER AS label FROM v UNION ALL SELECT entity, NULL, NULL, label FROM lab"))
def set1(d):
    return d.visits.select("entity", "stage", "entry").unionByName(d.labels, allowMissingColumns=True)


@query("set2_entity_set_operations", sql("v", """, a AS (SELECT DISTINCT entity FROM v WHERE stage = 1), b AS (SELECT DISTINCT entity FROM v WHERE stage = 7)
  SELECT 'both' AS kind, entity FROM (SELECT entity FROM a INTERSECT SELECT entity FROM b) UNION ALL SELECT 'either', entity FROM (SELECT entity FROM a UNION SELECT entity FROM b)
  UNION ALL SELECT 'first_only', entity FROM (SELECT entity FROM a EXCEPT SELECT entity FROM b)"""))
def set2(d):
    a = d.visits.where("stage = 1").select("entity")
    b = d.visits.where("stage = 7").select("entity")
    tag = lambda df, k: df.select(F.lit(k).alias("kind"), "entity")
    return tag(a.intersect(b), "both").unionByName(tag(a.union(b).distinct(), "either")).unionByName(tag(a.subtract(b), "first_only"))


@query("set3_distinct", sql("r", "SELECT DISTINCT entity, line FROM r"))
def set3(d):
    return d.rows.select("entity", "line").distinct()
