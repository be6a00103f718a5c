import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from stageflow.operators import points as PT
from stageflow.streaming import alerts as AL
from stageflow.streaming import jobs as J
from stageflow.streaming import ordered as O
from stageflow.streaming import sources as SRC


def test_topic_patterns():
    rx = SRC.topic_regex("factory/line3/+/telemetry")
    assert re.match(rx, "factory/line3/S29/telemetry") and not re.match(rx, "factory/line3/a/b/telemetry")
    assert re.match(SRC.topic_regex("twin/ai/#"), "twin/ai/part_risk/x") and re.match(SRC.topic_regex("twin/ai/#"), "twin/ai")
    assert not re.match(SRC.topic_regex("twin/ai/#"), "twin/aix")


def test_points_defaults_and_optional_fields(spark):
    rows = [
        ("factory/line3/S29/telemetry", 1, '{"part_id": 5, "station_id": "S29", "features": {"L3_S29_F1": 0.5, "x": null}, "is_entry": true, "response": null}'),
        ("factory/line3/parts/5/risk", 2, '{"part_id": 5, "current_station": "S29", "cumulative_risk": 0.4, "ground_truth_response": 1}'),
        ("twin/ai/part_risk", 3, '{"part_id": 5, "is_high_risk": false}'),
        ("twin/ai/anomaly", 4, '{"anomaly_score": 2.0, "station_contributions": {"S29": 0.75}}'),
        ("factory/line3/alerts", 5, '{"x": 1}'),
        ("factory/line3/overview", 6, "{}"),
    ]
    df = spark.createDataFrame(rows, "topic string, seq long, payload string").withColumn("ts", F.current_timestamp())
    got = {r["seq"]: r for r in PT.to_points(df).collect()}
    assert set(got) == {1, 2, 3, 4, 6}
    assert got[1]["measurement"] == "station_telemetry" and got[1]["tags"]["is_entry"] == "True" and got[1]["tags"]["line_id"] == "3"
    assert got[1]["fields"]["L3_S29_F1"] == 0.5 and "x" not in got[1]["fields"] and "response" not in got[1]["fields"]
    assert got[2]["measurement"] == "part_risk" and got[2]["fields"]["ground_truth_response"] == 1.0 and got[2]["tags"]["risk_level"] == "LOW"
    assert got[3]["measurement"] == "ai_part_risk" and got[3]["tags"]["is_high_risk"] == "False" and got[3]["fields"]["predicted_defect_prob"] == 0.0
    assert got[4]["fields"]["attr_S29"] == 0.75
    assert got[6]["fields"]["line_average_health"] == 100.0


def _two_files(spark, tmp_path):
    base = 1704067200000000
    rows = [(i, base + i * 60_000_000, i % 4, ["a", "b", "x"][(i * 7) % 3], float(i % 10)) for i in range(120)]
    src = spark.createDataFrame(rows, "event_id long, abs_us long, entity long, stage string, value double").select(
        "event_id", (F.col("abs_us") - base).alias("us"), F.timestamp_micros("abs_us").alias("ts"), "entity", "stage", "value"
    )
    for k, cond in enumerate(("event_id < 70", "event_id >= 70")):
        src.where(cond).coalesce(1).write.parquet(f"{tmp_path}/in/batch={k}")
    return src, f"{tmp_path}/in/batch=*"


def plain_states(rows, exit_stage):
    """event_id -> (prev_stage, visited, anomalies, life), message by message in event order."""
    state: dict = {}
    want = {}
    for r in sorted(rows, key=lambda r: (r.us, r.event_id)):
        s = state.setdefault(r.entity, {"life": 0, "seen": set(), "n": 0, "last": None})
        s["seen"].add(r.stage)
        s["n"] += r.is_anomaly
        want[r.event_id] = (s["last"], len(s["seen"]), s["n"], s["life"])
        s["last"] = r.stage
        if r.stage == exit_stage:
            state[r.entity] = {"life": s["life"] + 1, "seen": set(), "n": 0, "last": None}
    return want


def plain_windows(rows, exit_stage, window):
    """(stage, event_id) -> (visits, rate), message by message in event order."""
    life, stages, recent, known, want = {}, {}, {}, {}, {}
    for r in sorted(rows, key=lambda r: (r.us, r.event_id)):
        who = (r.entity, life.get(r.entity, 0))
        visits, outcomes = recent.setdefault(r.stage, []), known.setdefault(r.stage, [])
        visits.append(who)
        del visits[:-window]
        want[r.stage, r.event_id] = (len(visits), round(sum(outcomes) / len(outcomes), 6) if outcomes else -1.0)
        stages.setdefault(who, set()).add(r.stage)
        if r.stage == exit_stage:
            for x in stages[who]:
                if who in recent[x]:
                    known.setdefault(x, []).append(r.outcome)
                    del known[x][:-window]
            life[r.entity] = who[1] + 1
    return want


def _messages(spark, n=400):
    rng = random.Random(4)
    rows = [(rng.randrange(12), i, 1000 * i + rng.randrange(3000), rng.choice("aabcdx"), rng.random() < 0.2, int(rng.random() < 0.4)) for i in range(n)]
    return spark.createDataFrame(rows, O.Entities.row)


def _both(spark, folder, schema, delay, per_trigger):
    stream = O.files(spark, folder, schema, per_trigger).withColumn(O.TIME, O.timed(F.col("us")))
    entities = O.apply(stream, ["entity"], O.Entities("x"), O.Entities.output, delay)
    return O.apply(O.stage_messages(entities), ["stage"], O.StageWindows(7, -1.0), O.StageWindows.output)


@pytest.mark.parametrize(("files", "per_trigger"), [(1, 1), (300, 100)])
def test_order_and_number_of_files_do_not_matter(spark, tmp_path, files, per_trigger):
    """Shuffled files that each hold all times need a delay of the whole time, and come out the same."""
    src = _messages(spark)
    src.repartition(files, F.xxhash64("event_id")).write.parquet(f"{tmp_path}/in")
    O.marker(src, f"{tmp_path}/in", 10**9)
    out = O.run(_both(spark, f"{tmp_path}/in", src.schema, "1 second", per_trigger), "files")
    assert {(r.stage, r.event_id): (r.visits, round(r.observed_rate, 6)) for r in out.collect()} == plain_windows(src.collect(), "x", 7)


def test_state_goes_on_after_a_restart_and_late_rows_are_dropped(spark, tmp_path):
    src = _messages(spark)
    rows = src.collect()
    folder, checkpoint, out = (f"{tmp_path}/{x}" for x in ("in", "checkpoint", "out"))
    src.where("event_id < 230").coalesce(1).write.parquet(folder)
    first = O.run(_both(spark, folder, src.schema, "4 milliseconds", 1), "restart", checkpoint, out).count()
    assert 200 < first < 230  # what the watermark has not passed waits in the state
    src.where("event_id >= 230").unionByName(spark.createDataFrame([(1, 9999, 5, "a", False, 0)], src.schema)).coalesce(1).write.mode("append").parquet(folder)
    O.marker(src, folder, 10**9)
    got = O.run(_both(spark, folder, src.schema, "4 milliseconds", 1), "restart", checkpoint, out)
    assert {(r.stage, r.event_id): (r.visits, round(r.observed_rate, 6)) for r in got.collect()} == plain_windows(rows, "x", 7)


class _Value:
    """State of one key in memory."""

    def __init__(self):
        self.x = None

    def get(self):
        return self.x

    def update(self, x):
        self.x = x


class _List(_Value):
    def get(self):
        return iter(self.x or [])

    def put(self, x):
        self.x = list(x)

    def clear(self):
        self.x = None


class _Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, name, schema):
        return _Value()

    def getListState(self, name, schema):
        return _List()

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.discard(t)


class _Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


class _Key:
    """An operator for one key, driven by hand."""

    def __init__(self, operator, key):
        self.op, self.key, self.handle = operator, (key,), _Handle()
        self.names = [c.split()[0] for c in operator.row.split(", ")]
        operator.row_type = operator.value_type = type("T", (), {"names": self.names, "__iter__": lambda s: iter(())})()
        operator.init(self.handle)

    def rows(self, watermark, *rows):
        return [r.asDict() for r in self.op.handleInputRows(self.key, iter([Row(**dict(zip(self.names, r, strict=True))) for r in rows]), _Clock(watermark))]

    def tick(self, watermark):
        out = []
        for t in sorted(x for x in self.handle.timers if x < watermark):
            out += [r.asDict() for r in self.op.handleExpiredTimer(self.key, _Clock(watermark), t)]
            self.handle.timers.discard(t)
        return out


def test_a_long_silence_starts_a_new_life():
    k = _Key(O.Entities("x", idle_us=100), 1)
    got = k.rows(10, (1, 3, 500, "a", True, 0), (1, 1, 0, "a", True, 0), (1, 2, 10, "b", True, 0))
    assert [(r["life"], r["prev_stage"], r["visited"], r["anomalies"]) for r in got] == [(0, None, 1, 1), (0, "a", 2, 2), (1, None, 1, 1)]
    assert k.rows(20, (1, 4, 11000, "b", False, 0))[0]["life"] == 2 and not k.handle.timers


def test_rows_wait_for_the_watermark_and_a_timer_takes_them():
    k = _Key(O.Arrivals(1000), "s")
    assert k.rows(0, ("s", 1, 5000), ("s", 2, 4200)) == [] and k.handle.timers == {4}
    assert k.tick(4) == []
    assert [(r["event_id"], r["arrivals"]) for r in k.tick(5)] == [(2, 1), (1, 2)] and not k.handle.timers
    assert [(r["us"], r["arrivals"]) for r in k.rows(9, ("s", 3, 5999), ("s", 4, 6000), ("s", 5, 6000), ("s", 6, 6001))] == [(5999, 2), (6000, 4), (6000, 4), (6001, 4)]
    assert k.op.carried.get()[0] == [5999, 6000, 6001]  # only the last width is kept


def test_a_silence_is_reported_once_by_timer_and_armed_anew():
    k = _Key(O.Silences(10_000), "s")
    assert k.rows(5, ("s", 5000), ("s", 0)) == [] and k.handle.timers == {14}
    assert [(r["kind"], r["idle_from"], r["us"]) for r in k.tick(15)] == [("idle", 5000, 15000)] and not k.handle.timers and k.tick(99) == []
    assert [(r["kind"], r["idle_from"], r["us"]) for r in k.rows(60, ("s", 52000), ("s", 50000))] == [("back", 5000, 50000)] and k.handle.timers == {61}
    assert [(r["kind"], r["us"]) for r in k.rows(85, ("s", 80000))] == [("idle", 62000), ("back", 80000)]


def test_sequences():
    k = _Key(O.Sequences(3, 1), 3)
    row = lambda i: (3, 1000 * i, i, 1, float(i))
    assert k.rows(2, row(1), row(2)) == []
    assert [(r["window_id"], r["first_window"], r["values"]) for r in k.rows(6, row(6), row(3), row(4))] == [(3, 1, [1.0, 2.0, 3.0]), (4, 2, [2.0, 3.0, 4.0])]
    assert [r["window_id"] for r in k.rows(9, row(7), row(8))] == [8]


def test_replayed_batch_is_written_once(spark, tmp_path):
    src, path = _two_files(spark, tmp_path)
    out = f"{tmp_path}/out"
    write = J.write_batch(out)
    J.run_batches(SRC.file_stream(spark, path, src.schema, per_trigger=1), "once", lambda b, i: (write(b, i), write(b, i))[0])
    assert J.read_batches(src.schema, spark, out).count() == 120


M = AL.MINUTE
QUIET = AL.Rule("quiet", 2, 1, "<", 1, by_stage=True)
PEAK = AL.Rule("peak", 3, 0, ">", 5, "max")


def plain_changes(rule, minutes):
    """(kind, g, since) of one key, minute by minute; ``minutes``: minute -> values."""
    out, run = [], None
    for g in range(min(minutes), max(minutes) + rule.back + rule.held + 2):
        seen = [x for m in range(g - rule.back, g) for x in minutes.get(m, ())]
        true = rule.holds(seen)
        if true and run is None:
            run = g
            out.append(("pending", g, g))
        if true and g - run == rule.held:
            out.append(("firing", g, run))
        if not true and run is not None:
            out.append(("resolved" if g - run > rule.held else "normal", g, run))
            run = None
    return out


def _kinds(rows):
    return [(r["kind"], r["g"], r["since"]) for r in rows]


def test_silence_fires_by_timer_once_and_is_resolved_by_a_row():
    k = _Key(AL.Alerts([QUIET]), "s")
    k.key = ("quiet", "s")
    row = lambda m: ("quiet", "s", (m + 1) * M - 1, 1.0)
    assert _kinds(k.rows(6 * M // 1000, row(5))) == [("pending", 5, 5), ("normal", 6, 5)]
    assert k.tick(8 * M // 1000 - 1) == []
    assert _kinds(k.tick(8 * M // 1000)) == [("pending", 8, 8)]
    assert _kinds(k.tick(30 * M // 1000)) == [("firing", 9, 8)] and not k.handle.timers and k.tick(99 * M // 1000) == []
    assert _kinds(k.rows(41 * M // 1000, row(40))) == [("resolved", 41, 8)]
    assert len(k.op.carried.get()[1]) == 1  # only the last minutes are kept


def test_rules_of_maximum_and_no_hold():
    k = _Key(AL.Alerts([PEAK]), "")
    k.key = ("peak", "")
    got = k.rows(200 * M // 1000, *[("peak", "", (m + 1) * M - 1, x) for m, x in ((1, 2.0), (2, 6.0), (2, 1.0), (9, 7.0), (11, 9.0))])
    assert _kinds(got) == plain_changes(PEAK, {1: [2.0], 2: [6.0, 1.0], 9: [7.0], 11: [9.0]}) and not k.handle.timers


def _changes(spark, folder, schema, delay):
    stream = O.files(spark, folder, schema, 1).withColumn(O.TIME, O.timed(F.col("us")))
    return AL.transitions(stream, "stage", {QUIET: F.lit(1), PEAK: F.col("x")}, delay)


def test_alert_changes_go_on_after_a_restart(spark, tmp_path):
    rng = random.Random(8)
    rows, minute = [], 3
    for _ in range(120):
        minute += rng.choice((0, 0, 1, 1, 2, 6))
        rows.append((rng.choice("ab"), minute * M + rng.randrange(M), rng.choice((1.0, 2.0, 6.0, None))))
    src = spark.createDataFrame(rows, "stage string, us long, x double")
    folder, checkpoint, out = (f"{tmp_path}/{x}" for x in ("in", "checkpoint", "out"))
    half = sorted(r[1] for r in rows)[60]
    src.where(F.col("us") < half).coalesce(1).write.parquet(folder)
    first = O.run(_changes(spark, folder, src.schema, "1 minute"), "rules", checkpoint, out).count()
    src.where(F.col("us") >= half).coalesce(1).write.mode("append").parquet(folder)
    O.marker(src, folder, 100 * M)
    got = O.run(_changes(spark, folder, src.schema, "1 minute"), "rules", checkpoint, out).collect()
    want = []
    for rule, keys in ((QUIET, "ab"), (PEAK, ("",))):
        for key in keys:
            minutes = {}
            for stage, us, x in rows:
                if key in ("", stage) and (rule is QUIET or x is not None):
                    minutes.setdefault(us // M, []).append(1 if rule is QUIET else x)
            want += [(rule.name, key, *c) for c in plain_changes(rule, minutes)]
    assert 0 < first < len(want)
    assert sorted((r["rule"], r["key"], r["kind"], r["g"], r["since"]) for r in got) == sorted(want)
