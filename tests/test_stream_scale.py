"""Stream operators whose calls, rows and memory must not grow with hot or many keys."""

import random

import pytest
from pyspark.sql import functions as F

from stageflow.streaming import ordered as O

from tests.test_streams import _Key, _messages, plain_states


def _stream(src, folder, ahead=10**9):
    src.repartition(5).write.parquet(folder)
    O.marker(src, folder, ahead)
    return O.files(src.sparkSession, folder, src.schema, 2).withColumn(O.TIME, O.timed(F.col("us")))


def test_keys_of_a_bucket_share_one_state(spark, tmp_path):
    src = _messages(spark)
    out = O.run(O.dealt(_stream(src, f"{tmp_path}/in"), "entity", O.Entities("x"), "1 second"), "dealt")
    assert {r.event_id: (r.prev_stage, r.visited, r.anomalies, r.life) for r in out.collect()} == plain_states(src.collect(), "x")


def test_a_null_of_one_key_leaves_the_others_of_its_bucket_in_order():
    k = _Key(O.Dealt(O.Entities("x"), "entity"), 3)
    got = k.rows(10, (1, None, 500, "a", True, 0), (2, 7, 500, "b", True, 0), (2, 6, 400, "a", False, 0))
    assert sorted((r["entity"], r["event_id"] or 0, r["visited"]) for r in got) == [(1, 0, 1), (2, 6, 1), (2, 7, 2)]


def test_waiting_rows_are_one_state_value_a_block():
    k = _Key(O.Arrivals(1000), "s")
    k.rows(0, *[("s", i, 10_000 + i) for i in range(500)])
    assert len(list(k.op.waiting.get())) == 1


@pytest.fixture
def events(spark):
    rng = random.Random(6)
    rows = [(rng.choice("aab"), i, 50_000 + rng.randrange(40) * 7_000 + rng.randrange(900) * (rng.random() < 0.7)) for i in range(600)]
    return spark.createDataFrame(rows, "stage string, event_id long, us long")


def test_arrivals_by_slot(events, tmp_path):
    rows = events.collect()
    out = O.run(O.arrivals(_stream(events, f"{tmp_path}/in"), 10_000, "1 second"), "slots").collect()
    want = {r.event_id: sum(x.stage == r.stage and r.us - 10_000 <= x.us <= r.us for x in rows) for r in rows}
    assert len(out) == len(rows) and {r.event_id: r.arrivals for r in out} == want


def test_a_slot_is_forgotten_after_its_end():
    k = _Key(O.Arrivals(1000), "s")
    k.key = ("s", 5)
    k.op.carried.clear = lambda: k.op.carried.update(None)
    assert [(r["event_id"], r["arrivals"]) for r in k.rows(5, ("s", 1, 4500), ("s", 2, 5000))] == [(2, 2)] and k.handle.timers == {5}
    assert k.tick(6) == [] and k.op.carried.get() is None and not k.handle.timers


@pytest.mark.parametrize("limit", [5_000, 10_000])
def test_silences_from_the_ends_of_windows(spark, tmp_path, limit):
    rng = random.Random(9)
    us, rows = 50_000, []
    for _ in range(300):
        us += rng.choice((1, 300, 900, limit - 1, limit, limit + 1, 3 * limit))
        rows.append((rng.choice("abbb"), us))
    src = spark.createDataFrame(rows, "stage string, us long")
    out = O.run(O.silences(_stream(src, f"{tmp_path}/in"), limit, "10 seconds"), "ends").collect()
    want = []
    for stage in "ab":
        times = sorted(u for s, u in rows if s == stage)
        for a, b in zip(times, [*times[1:], None]):
            if b is None or b - a > limit:
                want.append((stage, "idle", a, a + limit))
                want += [] if b is None else [(stage, "back", a, b)]
    assert sorted((r.stage, r.kind, r.idle_from, r.us) for r in out) == sorted(want)


def test_a_limit_inside_an_open_window_waits_for_its_end():
    k = _Key(O.Silences(10_000, 4_000), "s")
    assert k.rows(8, ("s", 5000), ("s", 4100)) == [] and k.handle.timers == {15}  # 15000 lies in the window that ends at 16000
    assert k.tick(15) == [] and [r["us"] for r in k.tick(16)] == [15000]


def test_more_rows_come_in_more_slices(data, monkeypatch):
    from stageflow.plans import streams as ST

    monkeypatch.setattr(ST, "SLICE_ROWS", 150)
    seen = []
    monkeypatch.setattr(O, "land", lambda df, path, slices, land=O.land: seen.append((df.count(), slices)) or land(df, path, slices))
    n = ST.str1(data).count()
    assert seen == [(n, max(4, -(-n // 150)))] and seen[0][1] > 4


def test_a_dashboard_writes_only_the_points_it_reads(data):
    from stageflow.plans import monitoring as M

    before = set(M._TABLES)
    M.mon2(data).count()
    assert {k[3] for k in set(M._TABLES) - before} <= {"health", "scored"}


def test_a_stream_has_at_most_one_state_partition_a_core(spark, events, tmp_path):
    asked = spark.conf.get(O.PARTITIONS)
    spark.conf.set(O.PARTITIONS, "64")
    try:
        O.run(O.arrivals(_stream(events, f"{tmp_path}/in"), 10_000, "1 second"), "slots", f"{tmp_path}/checkpoint")
        assert spark.conf.get(O.PARTITIONS) == "64"
    finally:
        spark.conf.set(O.PARTITIONS, asked)
    with open(f"{tmp_path}/checkpoint/offsets/0") as f:
        assert f'"{O.PARTITIONS}":"{spark.sparkContext.defaultParallelism}"' in f.read()


def test_the_stage_takes_a_message_as_one_text():
    from stageflow.operators.scoring import CFG
    from stageflow.streaming.scorer import StageFacts

    k = _Key(StageFacts(CFG), 1)
    got = k.rows(10, (1, 0, 1000, 1, 7, 0, None, 2.0, "a"), (1, 1, 2000, 1, 7, 0, 1, 0.0, None), (1, 0, 3000, 1, 8, 0, None, 4.0, "b"))
    assert [(r["facts"], r["avg_z"], r["window_parts"], r["observed_rate"]) for r in got] == [("a", 2.0, 1, CFG.base_rate), ("b", 3.0, 2, 1.0)]


def test_points_of_one_measurement_parse_only_its_keys(spark):
    from stageflow.operators import points as PT
    from stageflow.plans.monitoring import MEASURED

    rows = [("factory/line3/S2/telemetry", 1, '{"part_id": 5, "station_id": "S2", "features": {"qty": 0.5}, "cumulative_risk": 0.5}'), ("factory/line3/parts/5/risk", 2, '{"cumulative_risk": 0.4}')]
    df = spark.createDataFrame(rows, "topic string, seq long, payload string").withColumn("ts", F.timestamp_micros(F.col("seq")))
    one = PT.to_points(df, names=[MEASURED["telemetry"]])
    assert one.collect() == PT.to_points(df).where("measurement = 'station_telemetry'").collect()
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "cumulative_risk" not in plan and "features" in plan and set(MEASURED.values()) == {m.name for m in PT.MEASUREMENTS}


def test_written_tables_are_compressed_with_zstd(spark):
    from stageflow.session import materialize

    assert all(f.endswith(".zstd.parquet") for f in materialize(spark.range(10), "small").inputFiles())


def test_points_that_are_counted_once_are_not_written(spark, tmp_path):
    import shutil

    from stageflow.plans import REGISTRY
    from stageflow.session import written

    for t in ("lineitem", "orders"):
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", f"{tmp_path}/{t}.parquet")
    before = len(written(spark))
    once = REGISTRY["mon16_point_counts"].run(spark, str(tmp_path))
    assert not [p for p in written(spark)[before:] if "/points-" in p]
    first = sorted(map(tuple, once.collect()))
    REGISTRY["mon3_latest_health"].run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, REGISTRY["snk5_points_all_measurements"].run(spark, str(tmp_path)).collect())) == first and len(first) == 43


def test_maps_of_points_compile_and_drop_nulls(spark):
    """Only the parse is a generator; the maps were one too, and so interpreted for every row."""
    from stageflow.operators import points as PT

    rows = [("x/telemetry", '{"station_id": "S1", "features": {"a": 1.0, "b": null}, "response": null}', 1), ("x/telemetry", '{"response": 1}', 2),
            ("twin/ai/anomaly", '{"anomaly_score": 2.0, "station_contributions": {"S1": 0.5, "S2": null}}', 3), ("twin/ai/part_risk", '{"raw_defect_prob": 0.5}', 4)]
    df = spark.createDataFrame(rows, "topic string, payload string, seq long").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    p = PT.to_points(df)
    assert p._jdf.queryExecution().executedPlan().toString().count("Generate inline") == 1
    zeros = {"part_id": 0.0, "sim_time": 0.0, "sim_time_hours": 0.0, "transit_minutes": 0.0}
    assert {r.seq: r.fields for r in p.collect()} == {
        1: zeros | {"a": 1.0}, 2: zeros | {"response": 1.0}, 3: {"anomaly_score": 2.0, "threshold_p99": 0.0, "attr_S1": 0.5},
        4: {"predicted_defect_prob": 0.0, "decision_time": 0.0, "raw_defect_prob": 0.5},
    }
