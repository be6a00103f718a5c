"""Live scorer: health of the stage, risk of the entity and the overview of the line for every message, as chained stateful operators.

A message goes through the state of its entity (life, previous stage, anomalies), then of its stage (last deviations, last outcomes), then of the line
(totals, latest health of each stage). An exit's outcome goes from the entity to all stages of its life. The scores themselves are the
expressions of ``operators.scoring``; the result is that of its batch operators.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stageflow.functions import scalar as S
from stageflow.functions.scalar import ScoreConfig
from stageflow.operators import scoring as SCO
from stageflow.session import dictionary
from stageflow.streaming import columns as C
from stageflow.streaming.ordered import TIME, InColumns, _times, apply
from stageflow.streaming.ordered import dealt as dealt_by

MESSAGE = (
    "entity long, stage int, stage_rank int, us long, t long, transit_minutes double, is_entry boolean, is_exit boolean, response int, "
    "max_abs_z double, n_features int, n_anomalous int"
)
_FACTS = "arrived_from int, is_first boolean, life int, cumulative_anomalies long, stages_visited array<int>"
#: Columns of a message that its stage passes on unread, beside its own.
_PASSED = "t long, transit_minutes double, is_entry boolean, is_exit boolean, n_features int, n_anomalous int, arrived_from int, is_first boolean, cumulative_anomalies long"


class EntityFacts(InColumns):
    """What the entity's earlier messages say about a message. Output: the message, and for an exit the stages that learn its outcome."""

    row = MESSAGE
    output = f"{MESSAGE}, {_FACTS}"
    order = ("entity", "us", "stage_rank", "stage")

    def start(self) -> Any:
        return C.Lives.start()

    def step(self, key: Any, value: Any, rows: pa.Table) -> tuple[Any, Any]:
        import pandas as pd

        us, leaves = C.values(rows, "us"), C.values(rows, "is_exit")
        stage = np.where(C.known(rows, "stage"), C.values(rows, "stage"), -1)
        value, got = C.Lives.step(value, C.values(rows, "entity"), us, stage, leaves, C.values(rows, "n_anomalous"), None, distinct=False)
        seen = np.full(len(us), None, object)
        for i, x in zip(np.flatnonzero(leaves), got["seen"], strict=True):
            seen[i] = [None if v < 0 else v for v in x.tolist()]
        out = {c: C.series(rows[c]) for c in rows.column_names}
        last = got["last"]
        return value, pd.DataFrame(out | {
            "arrived_from": C.nullable(last, last >= 0), "is_first": got["n_seen"] == 1, "life": got["life"], "cumulative_anomalies": got["anomalies"], "stages_visited": seen, TIME: _times(us),
        })


class StageFacts(InColumns):
    """Mean of the stage's last deviations and of the outcomes it has learnt, at each visit. Rows with kind 1 are outcomes. ``passed``: further columns of
    the message, which a visit passes on."""

    BASE = "at int, kind int, us long, stage_rank int, entity long, life int, response int, max_abs_z double"
    order = ("us", "stage_rank", "entity", "kind")

    def __init__(self, cfg: ScoreConfig, passed: str = "facts string") -> None:
        self.window, self.default = cfg.window, cfg.base_rate
        self.row = f"{self.BASE}, {passed}"
        self.output = f"{self.row}, avg_z double, window_parts int, observed_rate double"

    def start(self) -> Any:
        return C.Learnt.start(), np.zeros(0)

    def step(self, key: Any, value: Any, rows: pa.Table) -> tuple[Any, Any]:
        import pandas as pd

        learnt, zs = value
        outcome = C.values(rows, "kind") != 0
        learnt, parts, rate = C.Learnt.step(
            learnt, outcome, C.values(rows, "entity"), C.values(rows, "life"), C.values(rows, "response"), self.window, self.default)
        mine = rows.filter(pa.array(~outcome))
        z = C.values(mine, "max_abs_z")
        out = {c: C.series(mine[c]) for c in mine.column_names}
        out |= {"avg_z": C.trailing_mean(zs, z, self.window), "window_parts": parts, "observed_rate": rate, TIME: _times(C.values(mine, "us"))}
        return (learnt, np.concatenate([zs, z])[-self.window :]), pd.DataFrame(out)


class LineFacts(InColumns):
    """Totals, throughput over the last exits and mean of the latest health of all stages, at each exit. State: the totals, the health of each stage in
    hundredths and the times of the last exits. The line is one key."""

    row = "line int, us long, stage_rank int, entity long, stage int, t long, is_first boolean, is_entry boolean, is_exit boolean, response int, health_score double"
    output = (
        "line int, entity long, t long, active_parts long, total_entered long, total_completed long, total_defects long, cumulative_defect_rate double, "
        "rolling_throughput_per_hr double, line_average_health double"
    )
    order = ("us", "stage_rank", "entity")

    def __init__(self, hours: float, n_stages: int, last: int) -> None:
        self.hours, self.n_stages, self.last = hours, n_stages, last

    def start(self) -> Any:
        return (0, 0, 0, 0), {}, np.zeros(0, np.int64)

    def step(self, key: Any, value: Any, rows: pa.Table) -> tuple[Any, Any]:
        import pandas as pd

        totals, health, exits = value
        is_first, leaves, stage = C.values(rows, "is_first"), C.values(rows, "is_exit"), C.values(rows, "stage")
        flags = is_first, is_first & C.values(rows, "is_entry"), leaves, leaves & (C.values(rows, "response") == 1)
        started, entered, completed, defects = (a + np.cumsum(f) for a, f in zip(totals, flags, strict=True))
        cents = np.rint(C.values(rows, "health_score") * 100).astype(np.int64)
        order = np.argsort(stage, kind="stable")
        first = np.flatnonzero(np.append(True, stage[order][1:] != stage[order][:-1]))
        before = np.append(0, cents[order][:-1])
        before[first] = [health.get(int(s), 10000) for s in stage[order][first]]
        steps = np.empty(len(cents), np.int64)
        steps[order] = cents[order] - before
        change = sum(c - 10000 for c in health.values()) + np.cumsum(steps)
        latest = np.append(first[1:], len(order)) - 1
        health = health | {int(stage[i]): int(cents[i]) for i in order[latest]}
        totals = tuple(int(x[-1]) for x in (started, entered, completed, defects))

        t, us = C.values(rows, "t")[leaves], C.values(rows, "us")[leaves]
        times = np.concatenate([exits, t])
        nth = len(exits) + np.arange(len(t))
        n, dt = np.minimum(nth + 1, self.last), (t - times[np.maximum(nth - self.last + 1, 0)]) * self.hours
        rate = np.where((n >= 2) & (dt > 0.01), n / np.where(dt > 0.01, dt, 1.0), 0.0)
        out = pd.DataFrame({
            "line": np.full(len(t), key[0], np.int32), "entity": C.values(rows, "entity")[leaves], "t": t, "active_parts": (started - completed + 1)[leaves], "total_entered": entered[leaves],
            "total_completed": completed[leaves], "total_defects": defects[leaves], "cumulative_defect_rate": (defects[leaves] / completed[leaves]) * 100.0, "rolling_throughput_per_hr": rate,
            "line_average_health": 100.0 + change[leaves] / (100.0 * self.n_stages), TIME: _times(us),
        })
        return (totals, health, times[-self.last :]), out


def health(
    messages: DataFrame, baselines: DataFrame, benchmark: DataFrame, topology: DataFrame, delay: str, cfg: ScoreConfig = SCO.CFG, sensors: Sequence[str] = ()
) -> DataFrame:
    """SCO1 and SCO2 on a stream of messages with ``us`` and the event time: the columns of the stage's health and of the entity's risk. ``sensors``: as in ``deviations``."""
    deviating = SCO.deviations(messages, baselines, cfg, sensors=sensors).withColumn("n_anomalous", F.greatest(F.coalesce(F.size("anomalous"), F.lit(0)), F.lit(0)))
    facts = dealt_by(deviating.select(*C.names(MESSAGE), TIME), "entity", EntityFacts(), delay)
    targets = F.transform("stages_visited", lambda s: F.struct(s.alias("at"), F.lit(1).alias("kind")))
    own = F.array(F.struct(F.col("stage").alias("at"), F.lit(0).alias("kind")))
    dealt = facts.withColumn("m", F.explode(F.when(F.col("is_exit"), F.concat(own, targets)).otherwise(own)))
    operator = StageFacts(cfg, _PASSED)
    stages = apply(dealt.select("m.at", "m.kind", *C.names(operator.row)[2:], TIME), ["at"], operator, operator.output)
    seen = stages.drop("kind").withColumnRenamed("at", "stage").repartition("entity")  # the stages are few keys, so few tasks; scores and payloads are made by all
    paced = (
        seen.join(dictionary(topology, "topology"), "stage", "left").withColumn("incoming", F.coalesce("arrived_from", "static_prev"))
        .join(dictionary(benchmark.select(F.col("prev_stage").alias("incoming"), "stage", "p90", "p99"), "benchmark"), ["incoming", "stage"], "left")
    )
    drift = S.drift_score(F.col("avg_z"), F.col("n_features"))
    pacing = S.pacing_score(F.col("transit_minutes"), F.coalesce("p90", F.lit(cfg.default_p90)), F.coalesce("p99", F.lit(cfg.default_p99)), F.col("incoming").isNotNull())
    defect = S.defect_score(F.col("observed_rate"), F.lit(cfg.base_rate))
    scored = paced.withColumn("health_score", S.composite_health(drift, pacing, defect, cfg)).select(
        *seen.columns, "health_score", F.round(drift, 2).alias("feature_drift_score"), F.round(pacing, 2).alias("transit_pacing_score"), F.round(defect, 2).alias("defect_rate_score"),
        S.health_status(F.col("health_score"), cfg).alias("status"), F.round(F.col("observed_rate") * 100.0, 4).alias("observed_defect_rate"))
    risk = S.rule_risk(F.col("cumulative_anomalies"), F.col("health_score"), cfg)
    return scored.withColumn("cumulative_risk", risk).withColumn("risk_level", S.risk_level(F.col("cumulative_risk"), cfg))


def overview(scored: DataFrame, hours: float, n_stages: int = 7, last: int = 200) -> DataFrame:
    """SCO3 on the stream of ``health``: one row an exit."""
    rows = scored.select(F.lit(3).alias("line"), *C.names(LineFacts.row)[1:], TIME)
    out = apply(rows, ["line"], LineFacts(hours, n_stages, last), LineFacts.output)
    rounded = {"cumulative_defect_rate": 3, "rolling_throughput_per_hr": 1, "line_average_health": 1}
    return out.select(*[F.round(c, rounded[c]).alias(c) if c in rounded else c for c in out.columns if c != "line"])


def messages_of(scored: DataFrame, stage_name: str = "S") -> DataFrame:
    """SNK4: (topic, payload, TIME) of each scored message: health of the stage, risk of the entity and, where critical, an alert."""
    name = F.concat(F.lit(stage_name), F.col("stage").cast("string"))
    health_ = F.struct(F.format_string(S.TOPICS["health"].replace("{}", "%s"), name).alias("topic"), F.to_json(F.struct(
        "entity", "stage", "t", "feature_drift_score", "transit_pacing_score", "defect_rate_score", "health_score", "status", "observed_defect_rate", "window_parts")).alias("payload"))
    risk = F.struct(F.format_string(S.TOPICS["part_risk"].replace("{}", "%s"), F.col("entity").cast("string")).alias("topic"), F.to_json(F.struct(
        "entity", "stage", "cumulative_anomalies", "cumulative_risk", "risk_level")).alias("payload"))
    alert = F.struct(F.lit(S.TOPICS["alerts"]).alias("topic"), F.to_json(F.struct(
        F.lit("STATION_HEALTH_CRITICAL").alias("alert_type"), "entity", "stage", "health_score", "t", F.col("n_anomalous").cast("long").alias("n_anomalous"))).alias("payload"))
    both = F.array(health_, risk)
    return scored.select(F.explode(F.when(F.col("status") == "CRITICAL", F.concat(both, F.array(alert))).otherwise(both)).alias("m"), TIME).select("m.topic", "m.payload", TIME)
