"""Streaming queries: each runs on the data available now and returns the table it wrote."""

from pyspark.sql import functions as F

from stageflow.functions import scalar as S
from stageflow.operators import models as MO
from stageflow.operators import points as PT
from stageflow.operators import scoring as SCO
from stageflow.plans.flow import rounded
from stageflow.operators import profile as PR
from stageflow.plans.joins import segment_benchmark, topology
from stageflow.plans.monitoring import us
from stageflow.plans.registry import REGISTRY, cte, query, sql
from stageflow.session import materialize, work_dir
from stageflow.sources import io
from stageflow.sources.tables import SENSORS
from stageflow.streaming import alerts as AL
from stageflow.streaming import jobs as J
from stageflow.streaming import ordered as O
from stageflow.streaming import scorer as LIVE
from stageflow.streaming import sources as SRC

EPOCH_US = 1704067200000000
EXIT, WINDOW, DELAY_S = "purchase", 100, 600


def shaped(df):
    ts = F.col("ts").cast("timestamp")
    return df.select(
        "event_id", (F.unix_micros(ts) - F.lit(EPOCH_US)).alias("us"), ts.alias("ts"), F.col("user_id").alias("entity"), F.col("event_type").alias("stage"), "value", "props"
    )


def event_stream(d):
    # A pattern, because the table may be a single file and a stream source otherwise wants a folder.
    return shaped(SRC.file_stream(d.spark, f"{d.sf_dir}/events.parquet*"))


def event_topic():
    """Topics of the event stream: purchases come as alerts of another system, the others as telemetry or predictions."""
    return (
        F.when(F.col("stage") == "error", "twin/ai/part_risk").when(F.col("stage") == "purchase", "factory/line9/misc")
        .otherwise(F.concat(F.lit("factory/line3/"), F.col("stage"), F.lit("/telemetry")))
    )


TOPIC_SQL = "CASE WHEN stage = 'error' THEN 'twin/ai/part_risk' WHEN stage = 'purchase' THEN 'factory/line9/misc' ELSE 'factory/line3/' || stage || '/telemetry' END"


@query("src9_stream_subscription", sql("ev", f"SELECT event_id, {TOPIC_SQL} AS topic, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM ev WHERE stage <> 'purchase'"))
def src9(d):
    s = event_stream(d).withColumn("topic", event_topic()).where(SRC.subscribed(F.col("topic")))
    return J.run_append(io.decode_json(s, "props", "k DOUBLE").select("event_id", "topic", "k"), "subscribed")


@query("src10_stream_quarantine", sql("ev", "SELECT stage = 'error' AS quarantined, count(*) AS n FROM ev GROUP BY 1"))
def src10(d):
    cut = F.expr("substring(props, 1, length(props) - 1)")
    s = event_stream(d).withColumn("payload", F.when(F.col("stage") == "error", cut).otherwise(F.col("props")))
    decoded = io.decode_json(s, "payload", "k DOUBLE").select("event_id", "k", F.col("_corrupt").isNotNull().alias("quarantined"))
    return J.persist(decoded, "decoded").groupBy("quarantined").agg(F.count(F.lit(1)).alias("n"))


@query("snk4_stream_routing", sql("ev", f"SELECT event_id, {TOPIC_SQL} AS topic, value AS payload_value FROM ev"))
def snk4(d):
    out = J.run_append(io.routed(event_stream(d), event_topic(), ["event_id", "stage", "value"]).select("event_id", "topic", "payload"), "routed")
    return out.select("event_id", "topic", F.get_json_object("payload", "$.value").cast("double").alias("payload_value"))


@query("snk6_idempotent_batches", sql("ev", "SELECT stage, count(*) AS n, round(sum(value), 2) AS total FROM ev GROUP BY stage"))
def snk6(d):
    """Every batch is written twice, as after a restart; the table holds it once."""
    path = work_dir(d.spark, "idempotent")
    write = J.write_batch(path)

    def twice(batch, batch_id):
        write(batch, batch_id)
        write(batch, batch_id)

    s = event_stream(d)
    J.run_batches(s, "idempotent", twice)
    return rounded(J.read_batches(s.schema, d.spark, path).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total", digits=2)


@query("snk7_batch_callback", sql("ev", "SELECT stage, count(*) AS n FROM ev GROUP BY stage"))
def snk7(d):
    path = work_dir(d.spark, "callback")
    J.run_batches(event_stream(d), "callback", lambda b, i: b.groupBy("stage").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={i}"))
    return J.read_batches("stage STRING, n LONG", d.spark, path).groupBy("stage").agg(F.sum("n").alias("n"))


cte("trk", """SELECT *, coalesce(CAST(sum(CAST(stage = 'purchase' AS INT)) OVER (PARTITION BY entity ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INTEGER), 0) AS life FROM ev""", ["ev"])


SLICES, SLICE_ROWS, AHEAD_US = 4, 2_000_000, 10 * 86_400 * 1000000


def arriving(d, df, name):
    """The rows as a stream: slices of time that come one after the other in files of any order, and a marker that closes the last. Returns the stream
    and the delay that its order needs. There are as many slices as keep a micro-batch, and what waits in the state, at some millions of rows. The rows are read a few
    times, so they should be those of a table, or a few columns made from them."""
    path = work_dir(d.spark, name)
    width = O.land(df, path, max(SLICES, -(-df.count() // SLICE_ROWS)))
    O.marker(df, path, width + AHEAD_US)
    stream = O.files(d.spark, path, df.schema, per_trigger=O.FILES)
    return stream.withColumn(O.TIME, O.timed(F.col("us"))), f"{width} microseconds"


def tracked_events(d):
    rows = shaped(d.table("events")).select("entity", "event_id", "us", "stage", (F.col("value") >= 100).alias("is_anomaly"), (F.col("value") >= 50).cast("int").alias("outcome"))
    stream, delay = arriving(d, rows, "tracked")
    return O.dealt(stream, "entity", O.Entities(EXIT), delay)


@query("str1_entity_state", sql("trk", """SELECT entity, event_id, life, lag(stage) OVER w AS prev_stage, CAST(sum(CAST(value >= 100 AS INT)) OVER w AS BIGINT) AS anomalies, count(*) FILTER (first) OVER w AS visited FROM (
  SELECT *, row_number() OVER (PARTITION BY entity, life, stage ORDER BY us, event_id) = 1 AS first FROM trk) WINDOW w AS (PARTITION BY entity, life ORDER BY us, event_id)"""))
def str1(d):
    return O.run(tracked_events(d), "entities").select("entity", "event_id", "life", "prev_stage", "anomalies", "visited")


@query("str2_stage_windows", sql("trk", f""", p AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY us, event_id) AS vn FROM trk),
  lastv AS (SELECT entity, life, stage, max(vn) AS vn FROM p GROUP BY 1, 2, 3), x AS (SELECT entity, life, us, event_id, CAST(value >= 50 AS INT) AS y FROM trk WHERE stage = 'purchase'),
  o AS (SELECT l.stage, l.entity, l.life, x.us, x.event_id, 1 AS kind, y, l.vn FROM lastv l JOIN x USING (entity, life)), a AS (SELECT stage, us, event_id, kind, y, vn FROM o UNION ALL SELECT stage, us, event_id, 0, 0, vn FROM p),
  c AS (SELECT *, sum(1 - kind) OVER (PARTITION BY stage ORDER BY us, event_id, kind ROWS UNBOUNDED PRECEDING) AS seen FROM a),
  e AS (SELECT stage, us, event_id, row_number() OVER (PARTITION BY stage ORDER BY us, event_id) AS k, CAST(sum(y) OVER (PARTITION BY stage ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM c WHERE kind = 1 AND seen - vn < {WINDOW}),
  z AS (SELECT p.stage, p.event_id, p.vn, coalesce(e.k, 0) AS k, coalesce(e.s, 0) AS s FROM p ASOF LEFT JOIN e ON e.stage = p.stage AND e.us < p.us)
  SELECT z.stage, z.event_id, least(vn, {WINDOW}) AS visits, round(CASE WHEN z.k > 0 THEN (z.s - coalesce(f.s, 0)) / least(z.k, {WINDOW}) ELSE 0.005069 END, 6) AS observed_rate FROM z LEFT JOIN e f ON f.stage = z.stage AND f.k = z.k - {WINDOW}"""))
def str2(d):
    """Two operators in one query: an exit's outcome goes from the entity to the stages of its life."""
    out = O.apply(O.stage_messages(tracked_events(d)), ["stage"], O.StageWindows(WINDOW, 0.005069), O.StageWindows.output)
    return O.run(out, "stage-windows").select("stage", "event_id", "visits", F.round("observed_rate", 6).alias("observed_rate"))


@query("str3_tumbling_windows", sql("ev", """SELECT us // 3600000000 AS hour, stage, count(*) AS throughput, round(max(value), 6) AS max_value, round(quantile_cont(value, 0.9), 6) AS p90, round(avg(CAST(value <= 5.0 AS INT)), 6) AS low_share FROM ev
  WHERE (us // 3600000000 + 1) * 3600000000 <= (SELECT max(us) // 1000 * 1000 - 600000000 FROM ev) GROUP BY 1, 2"""))
def str3(d):
    aggs = [
        F.count(F.lit(1)).alias("throughput"), F.max("value").alias("max_value"), F.percentile("value", F.lit(0.9)).alias("p90"), F.avg((F.col("value") <= 5.0).cast("int")).alias("low_share"),
    ]
    out = J.run_append(J.tumbling(event_stream(d), "ts", "stage", "1 hour", f"{DELAY_S} seconds", aggs), "tumbling")
    hour = ((F.unix_micros("w_start") - EPOCH_US) / 3600000000).cast("long").alias("hour")
    return rounded(out.select(hour, "stage", "throughput", "max_value", "p90", "low_share"), "max_value", "p90", "low_share")


LEN, PARTS = 6, 10


@query("str4_sequence_buffer", sql("ev", f""", w AS (SELECT us // 3600000000 AS window_id, count(*) AS parts, avg(value) AS v FROM ev GROUP BY 1),
  i AS (SELECT *, window_id - row_number() OVER (ORDER BY window_id) AS island FROM w WHERE parts >= {PARTS}), k AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY window_id) AS pos,
    string_agg(CAST(CAST(round(v * 10000) AS BIGINT) AS VARCHAR), ',') OVER (PARTITION BY island ORDER BY window_id ROWS BETWEEN {LEN - 1} PRECEDING AND CURRENT ROW) AS buffered FROM i)
  SELECT window_id, window_id - {LEN - 1} AS first_window, buffered FROM k WHERE pos >= {LEN}"""))
def str4(d):
    """Spark's own windows feed the buffer."""
    stream, delay = arriving(d, shaped(d.table("events")).select("us", "value"), "sequences")
    line = F.when(F.col("value").isNotNull(), F.lit(3))
    windows = stream.withWatermark(O.TIME, delay).groupBy(F.window(O.TIME, "1 hour"), line.alias("line")).agg(F.count(F.lit(1)).alias("parts"), F.avg("value").alias("value"))
    start = (F.unix_micros("window.start") / 3600000000).cast("long")
    end = F.unix_micros("window.end")
    rows = windows.select("line", (end - 1).alias("us"), start.alias("window_id"), "parts", "value", F.timestamp_micros(end - 1).alias(O.TIME), "window").withColumn(O.TIME, F.window_time("window")).drop("window")
    out = O.run(O.apply(rows, ["line"], O.Sequences(LEN, PARTS), O.Sequences.output), "sequences")
    return out.select("window_id", "first_window", F.array_join(F.transform("values", lambda v: F.round(v * 10000).cast("long").cast("string")), ",").alias("buffered"))


@query("str5_trailing_arrivals", sql("ev", "SELECT event_id, stage, count(*) OVER (PARTITION BY stage ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS arrivals FROM ev"))
def str5_exact(d):
    stream, delay = arriving(d, shaped(d.table("events")).select("stage", "event_id", "us"), "arrivals")
    return O.run(O.arrivals(stream, 3600 * 1000000, delay), "arrivals").select("event_id", "stage", "arrivals")


@query("str5_sliding_arrivals", sql("ev", """, s AS (SELECT unnest(generate_series(us // 360000000 - 9, us // 360000000)) AS k, us FROM ev)
  SELECT k AS slot, count(*) AS arrivals FROM s WHERE k * 360000000 + 3600000000 <= (SELECT max(us) // 1000 * 1000 - 600000000 FROM ev) GROUP BY k"""))
def str5(d):
    out = J.run_append(J.sliding(event_stream(d), "ts", "1 hour", "6 minutes", f"{DELAY_S} seconds"), "sliding")
    return out.select(((F.unix_micros("w_start") - EPOCH_US) / 360000000).cast("long").alias("slot"), "arrivals")


@query("str6_late_rows", sql("ev", "SELECT entity_half, late, count(*) AS n FROM (SELECT CASE WHEN stage IN ('error', 'purchase') THEN 'second' ELSE 'first' END AS entity_half, stage IN ('error', 'purchase') AND us < (SELECT max(us) FROM ev WHERE stage NOT IN ('error', 'purchase')) - 600000000 AS late FROM ev) GROUP BY 1, 2"))
def str6(d):
    """Errors and purchases arrive after everything else; those older than the watermark go to the side table."""
    path = work_dir(d.spark, "ordered-files")
    half = F.when(F.col("stage").isin("error", "purchase"), "second").otherwise("first")
    src = shaped(d.table("events")).withColumn("entity_half", half)
    s1 = J.write_batch(path)
    s1(src.where("entity_half = 'first'").coalesce(1), 0)
    s1(src.where("entity_half = 'second'").coalesce(1), 1)
    stream = SRC.file_stream(d.spark, f"{path}/batch=*", src.schema, per_trigger=1)
    main, late = J.split_late(stream, "ts", DELAY_S, "late")
    both = main.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return both.groupBy("entity_half", "late").agg(F.count(F.lit(1)).alias("n"))


def silences(d):
    stream, delay = arriving(d, shaped(d.table("events")).select("stage", "us"), "idle")
    return O.run(O.silences(stream, 3600 * 1000000, delay), "idle")


@query("str7_inactivity", sql("ev", """SELECT stage, prev AS idle_from, us AS idle_to FROM (SELECT stage, us, lag(us) OVER (PARTITION BY stage ORDER BY us) AS prev FROM ev) WHERE us - prev > 3600000000"""))
def str7(d):
    return silences(d).where("kind = 'back'").select("stage", "idle_from", F.col("us").alias("idle_to"))


@query("str7_stalled_stages", sql("ev", "SELECT stage, us AS idle_from, us + 3600000000 AS as_of FROM (SELECT stage, us, lead(us) OVER (PARTITION BY stage ORDER BY us) AS later FROM ev) WHERE later IS NULL OR later - us > 3600000000"))
def str7_stalled(d):
    """Every stage that has been silent for an hour, as soon as the others' messages move the watermark past it; none needs to speak again."""
    return silences(d).where("kind = 'idle'").select("stage", "idle_from", F.col("us").alias("as_of"))


DAY_US = 86_400 * 1000000


def live(d):
    """The scorer over the arriving messages."""
    d.stored("visits", "messages")
    rows = d.messages.withColumns({"us": F.col("t") * DAY_US, **{s: F.col("features")[s] for s in SENSORS}}).drop("prev_stage", "features")
    stream, delay = arriving(d, rows, "messages")
    baselines = materialize(PR.baselines(d.sensor_values, ("stage", "feature")), "baselines")
    return LIVE.health(stream, baselines, materialize(segment_benchmark(d), "segments"), topology(d), delay, sensors=SENSORS)


def live_messages(d, topic, schema):
    """Payloads that the scorer's routed messages carry on a topic."""
    out = O.run(LIVE.messages_of(live(d)), "live")
    return out.where(SRC.subscribed(F.col("topic"), (topic,))).select(F.from_json("payload", schema).alias("p")).select("p.*")


@query("str_health", REGISTRY["sco1_stage_health"].sql)
def str_health(d):
    return live_messages(d, "factory/line3/+/health", "entity long, stage int, t long, feature_drift_score double, transit_pacing_score double, defect_rate_score double, "
                         "health_score double, status string, observed_defect_rate double, window_parts int")


@query("str_risk", REGISTRY["sco2_part_risk"].sql)
def str_risk(d):
    return live_messages(d, "factory/line3/parts/+/risk", "entity long, stage int, cumulative_anomalies long, cumulative_risk double, risk_level string")


@query("str_overview", REGISTRY["sco3_line_overview"].sql)
def str_overview(d):
    return O.run(LIVE.overview(live(d), 24.0), "overview")


@query("str_alerts", REGISTRY["sco4_critical_alerts"].sql)
def str_alerts(d):
    return live_messages(d, "factory/line3/alerts", "alert_type string, entity long, stage int, health_score double, t long, n_anomalous long")


#: The rules of the batch queries alr1 to alr4, on the same event stream table.
RULES = (
    AL.Rule("high_risk_surge", 5, 1, ">", 1), AL.Rule("stage_idle", 5, 2, "<", 1, by_stage=True), AL.Rule("anomaly_flagged", 5, 1, ">", 0, "max"), AL.Rule("stream_stalled", 2, 2, "<", 1),
)
RULE_SQL = {
    "high_risk_surge": ("coalesce(sum(n) FILTER (value >= 60), 0) > 1", ""), "stage_idle": ("count(n) < 1", "stage"),
    "anomaly_flagged": ("coalesce(max(CAST(stage = 'error' AS INT)), 0) > 0", ""), "stream_stalled": ("count(n) < 1", ""),
}


def rule_sql(rule: AL.Rule) -> str:
    """Evaluations on a dense grid, runs of true ones, and their changes. The grid ends where nothing can change any more."""
    cond, by = RULE_SQL[rule.name]
    key = by or "''"
    return f"""SELECT '{rule.name}' AS rule, key, since, n, top, {rule.held} AS held FROM (SELECT key, min(g) AS since, count(*) AS n, any_value(top) AS top FROM (
    SELECT key, g, top, g - row_number() OVER (PARTITION BY key ORDER BY g) AS run FROM (
      SELECT g.key, g.g, g.top, {cond} AS ok FROM (SELECT key, top, unnest(generate_series(a, top)) AS g FROM (SELECT {key} AS key, min(slot) AS a, max(slot) + {rule.back + rule.held + 1} AS top FROM ev1 GROUP BY 1)) g
      LEFT JOIN (SELECT {key} AS key, slot, stage, value, 1 AS n FROM ev1) e ON e.key = g.key AND e.slot >= g.g - {rule.back} AND e.slot < g.g GROUP BY ALL) WHERE ok) GROUP BY key, run)"""


@query("str_alert_rules", sql("es", ", ev1 AS (SELECT slot, stage, value FROM es), runs AS (" + " UNION ALL ".join(rule_sql(r) for r in RULES) + """)
  SELECT rule, key, 'pending' AS kind, since AS g, since FROM runs UNION ALL SELECT rule, key, 'firing', since + held, since FROM runs WHERE n > held
  UNION ALL SELECT rule, key, CASE WHEN n > held THEN 'resolved' ELSE 'normal' END, since + n, since FROM runs WHERE since + n <= top"""))
def str_alert_rules(d):
    """All changes of the four rules; the silent ones come by timers. Rules over the line and by stage share one pass over the stream."""
    stream, delay = arriving(d, shaped(d.table("events")).select("stage", "us", "value"), "rules")
    values = ((F.col("value") >= 60).cast("int"), F.lit(1), (F.col("stage") == "error").cast("int"), F.lit(1))
    return O.run(AL.transitions(stream, "stage", dict(zip(RULES, values, strict=True)), delay), "rules").select("rule", "key", "kind", "g", "since")


cte("kb", "SELECT stage, avg(CAST(json_extract(props, '$.k') AS DOUBLE)) AS mean, stddev_samp(CAST(json_extract(props, '$.k') AS DOUBLE)) AS std FROM ev GROUP BY stage", ["ev"])


@query("str8_stream_enrichment", sql("ev kb", "SELECT event_id, ev.stage, round(abs((CAST(json_extract(props, '$.k') AS DOUBLE) - mean) / std), 6) AS max_abs_z FROM ev JOIN kb ON kb.stage = ev.stage"))
def str8(d):
    k = F.from_json("props", "MAP<STRING, DOUBLE>")
    base = d.events.select("stage", F.explode(k).alias("feature", "value")).groupBy("stage", "feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    s = event_stream(d).withColumn("features", k)
    return rounded(J.run_append(SCO.deviations(s, materialize(base, "baseline")).select("event_id", "stage", "max_abs_z"), "enriched"), "max_abs_z")


@query("str9_stream_scoring")
def str9(d):
    shape = lambda df: df.select("event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"), (F.col("stage") == "error").cast("int").alias("label"))
    model = MO.fit_logistic(materialize(shape(d.events), "events"), ["value", "k"])
    out = MO.score_table(model, shape(event_stream(d))).select("event_id", "score", (F.col("score") >= S.ScoreConfig().high_prob).alias("is_high_risk"))
    return J.run_append(out, "scored")


@query("str10_stream_persist", sql("ev", """SELECT event_id AS seq, 'station_telemetry' AS measurement, stage AS station_id, us, value AS f_value FROM ev WHERE stage NOT IN ('error', 'purchase')
  UNION ALL SELECT event_id, 'ai_part_risk', 'S35', us, NULL FROM ev WHERE stage = 'error'"""))
def str10(d):
    s = event_stream(d)
    station_id = F.when(F.col("stage") != "error", F.col("stage"))
    msgs = PT.message(s, event_topic(), F.col("ts"), F.col("event_id"), station_id=station_id, part_id=F.col("entity"), features=F.create_map(F.lit("value"), F.col("value")))
    p = J.persist(PT.to_points(msgs.where(SRC.subscribed(F.col("topic")))), "points")
    return us(p.select("seq", "measurement", F.col("tags")["station_id"].alias("station_id"), "ts", F.col("fields")["value"].alias("f_value"))).withColumn("us", F.col("us") - EPOCH_US)
