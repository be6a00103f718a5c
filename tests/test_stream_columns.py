"""Stream operators on columns give what a loop over the messages gives, and Python gets blocks of rows, not rows."""

import math
import random
from collections import deque

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stageflow.streaming import columns as C
from stageflow.streaming import ordered as O
from stageflow.streaming import scorer as LIVE

from tests.test_stream_scale import _stream
from tests.test_streams import _Clock, _Key, _messages


def _parts(rng, n, k):
    cuts = sorted(rng.sample(range(1, n), k - 1))
    return list(zip([0, *cuts], [*cuts, n]))


@pytest.mark.parametrize(("distinct", "idle"), [(True, 40), (False, None)])
def test_lives_of_many_entities(distinct, idle):
    rng = random.Random(3)
    rows, us = [], 0
    for _ in range(900):
        us += rng.randrange(6)
        rows.append((rng.randrange(25) * 7, us, rng.choice((-1, 0, 1, 1, 2, 3)), rng.randrange(3)))
    state, plain, got, want = C.Lives.start(), {}, {}, {}
    for a, b in _parts(rng, len(rows), 9):
        part = sorted(enumerate(rows[a:b], a), key=lambda x: (x[1][0], x[0]))
        e, t, s, x = (np.array([r[i] for _, r in part]) for i in range(4))
        state, out = C.Lives.step(state, e, t, s, s == 3, x, idle, distinct)
        lists = iter(out["seen"])
        for i, (n, r) in enumerate(part):
            got[n] = (out["life"][i], out["last"][i], out["anomalies"][i], out["n_seen"][i], next(lists).tolist() if r[2] == 3 else None)
    for n, (who, t, stage, x) in enumerate(rows):
        life, last, last_us, total, seen = plain.get(who, (0, -1, 0, 0, []))
        if idle is not None and last >= 0 and t - last_us > idle:
            life, last, total, seen = life + 1, -1, 0, []
        seen = seen if distinct and stage in seen else [*seen, stage]
        total += x
        want[n] = (life, last, total, len(seen), seen if stage == 3 else None)
        plain[who] = (life + 1, -1, t, 0, []) if stage == 3 else (life, stage, t, total, seen)
    assert got == want and {v[4] is None for v in want.values()} == {True, False} and max(v[0] for v in want.values()) > 3


def test_outcomes_and_deviations_of_a_stage():
    rng = random.Random(5)
    rows = [(rng.random() < 0.4, rng.randrange(30), rng.randrange(2), rng.randrange(2), rng.random() * 9) for _ in range(800)]
    state, zs, got = C.Learnt.start(), np.zeros(0), []
    for a, b in _parts(rng, len(rows), 40):
        kind, e, life, y, z = (np.array([r[i] for r in rows[a:b]]) for i in range(5))
        state, n, rate = C.Learnt.step(state, kind, e, life, y, 12, -1.0)
        got += zip(n.tolist(), rate.tolist(), C.trailing_mean(zs, z[~kind], 12).tolist(), strict=True)
        zs = np.concatenate([zs, z[~kind]])[-12:]
    recent, ys, window, want = deque(maxlen=12), deque(maxlen=12), deque(maxlen=12), []
    for kind, e, life, y, z in rows:
        if kind:
            if (e, life) in recent:
                ys.append(y)
            continue
        recent.append((e, life))
        window.append(z)
        want.append((len(recent), sum(ys) / len(ys) if ys else -1.0, math.fsum(window) / len(window)))
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want], rel=1e-13)
    assert all(len(x) == 12 for x in state)


def test_the_line_adds_up():
    rng = random.Random(6)
    rows = []
    for i in range(400):
        leaves = rng.random() < 0.3
        rows.append((3, 1000 * i, rng.randrange(6), rng.randrange(90), rng.randrange(1, 8), i // 5, rng.random() < 0.4, rng.random() < 0.5, leaves, rng.choice((0, 1, None)) if leaves else None, round(rng.random() * 100, 2)))
    k, got = _Key(LIVE.LineFacts(24.0, 7, 10), 3), []
    for a, b in _parts(rng, len(rows), 7):
        got += k.rows(10**6, *rows[a:b])
    started = entered = completed = defects = 0
    health, exits, want = {}, [], []
    for _, _, _, entity, stage, t, first, entry, leaves, y, h in rows:
        started, entered = started + first, entered + (first and entry)
        health[stage] = round(h * 100)
        if leaves:
            completed, defects, exits = completed + 1, defects + (y == 1), [*exits, t][-10:]
            dt = (t - exits[0]) * 24.0
            want.append((entity, t, started - completed + 1, entered, completed, defects, defects / completed * 100.0, len(exits) / dt if len(exits) >= 2 and dt > 0.01 else 0.0,
                         100.0 + sum(c - 10000 for c in health.values()) / 700.0))
    names = C.names(LIVE.LineFacts.output)[1:]
    assert [tuple(r[c] for c in names) for r in got] == want


def test_a_message_keeps_its_nulls_and_large_numbers():
    k = _Key(O.Dealt(LIVE.EntityFacts(), "entity"), 1)
    big = 2**60 + 1
    row = lambda us, stage, leaves, y: (big, stage, 1, us, 5, 0.5, False, leaves, y, 1.5, 2, 1)
    got = k.rows(10, row(2000, 7, True, 1), row(1000, None, None, None))
    assert [(r["entity"], r["cumulative_anomalies"], r["is_first"], r["stages_visited"]) for r in got] == [(big, 1, True, None), (big, 2, False, [None, 7])]
    assert got[1]["response"] == 1


def _blocks(rows, op):
    import pandas as pd

    return iter([pd.DataFrame({"block": [C.packed(pa.Table.from_pylist([dict(zip(C.names(op.row), r, strict=True)) for r in rows], C.schema(op.row)))]})])


def test_rows_of_a_block_that_come_too_late_are_dropped():
    op = O.Dealt(O.Entities("x"), "entity")
    k = _Key(op, 1)
    op.first = True
    give = lambda ms, *rows: [e for f in op.handleInputRows((1,), _blocks(rows, op), _Clock(ms)) for e in f["event_id"]]
    assert give(0, (1, 1, 5000, "a", False, 0)) == [] and k.handle.timers == {1}
    assert [len(f) for f in op.handleExpiredTimer((1,), _Clock(4), None)] == [] and 5 in k.handle.timers  # called whenever the watermark moves
    assert give(6, (1, 2, 4000, "a", False, 0), (1, 3, 4001, "b", False, 0)) == [3, 1]  # the batch before ended at 4 ms
    assert give(6) == []


def test_python_gets_one_block_a_key_and_partition(spark):
    df = spark.range(6000, numPartitions=2).select((F.col("id") % 3).alias("k"), F.timestamp_micros("id").alias(O.TIME), F.when(F.col("id") % 2 == 0, F.col("id")).alias("v"))
    got = O.packed(df, F.when(F.col("k") > 0, F.col("k")), "v long", 5).collect()
    assert sorted(r.key for r in got) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]  # 0, 3 and 4 have no rows
    tables = [(r.key, C.unpacked(r.block)) for r in got]
    assert sorted(v for k, t in tables if k == 2 for v in t["v"].to_pylist() if v is not None) == [i for i in range(6000) if i % 3 == 2 and i % 2 == 0]
    assert sum(t.num_rows for _, t in tables) == 4000 and all(t.num_rows == 0 for k, t in tables if k not in (1, 2))


def test_a_stream_hands_blocks_to_the_operators(spark, tmp_path):
    src = _messages(spark)
    entities = O.dealt(_stream(src, f"{tmp_path}/in"), "entity", O.Entities("x"), "1 second")
    plan = O.apply(O.stage_messages(entities), ["stage"], O.StageWindows(7, -1.0), O.StageWindows.output)._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("TransformWithStateInPySpark") == 2


def test_a_file_of_a_slice_has_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(O, "FILE_ROWS", 100)
    O.land(spark.range(1000, numPartitions=1).select(F.col("id").alias("us")), f"{tmp_path}/in", 2)
    sizes = [r[0] for r in spark.read.parquet(f"{tmp_path}/in").groupBy(F.input_file_name()).count().select("count").collect()]
    assert sorted(sizes) == [100] * 10
