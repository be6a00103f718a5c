"""Alert rules on a stream: a condition over the last minutes, held for a while, with its changes as messages.

Spark's windows count the events of each minute first, so that a rule over the whole line takes one row a stage and minute, not one an event. A rule's
machine then evaluates every minute in event time. While nothing comes, timers make the evaluations, up to the one after which no more can
change; so a rule on silence fires without a further message of its key.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from stageflow.streaming import ordered as O

MINUTE = 60_000_000
COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


@dataclass(frozen=True)
class Rule:
    """``combine`` (sum or max) of a minute's values over the ``back`` minutes before an evaluation, 0 where there are none, compared with ``limit``;
    it fires when that has held at ``held`` evaluations after the first. ``by_stage``: one machine a stage, otherwise one in all."""

    name: str
    back: int
    held: int
    compare: str
    limit: float
    combine: str = "sum"
    by_stage: bool = False

    def holds(self, values: Sequence[float]) -> bool:
        return COMPARE[self.compare]((max if self.combine == "max" else sum)(values) if values else 0.0, self.limit)


class Alerts(O.InOrder):
    """ALR1-5: the changes of each rule and key. ``pending``: the condition is true; ``firing``: it has held; ``resolved``: it has ended after that;
    ``normal``: before. ``g`` is the minute of the evaluation, ``since`` that of the first of the run. A key is evaluated from its first minute. State: the values
    of the last minutes, the phase and the next evaluation."""

    row = "rule string, key string, us long, x double"
    value = "next long, minutes array<long>, xs array<double>, phase string, since long"
    output = "rule string, key string, kind string, g long, since long"
    order = ("us", "x")

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.rules = {r.name: r for r in rules}

    def start(self) -> tuple:
        return None, [], [], "normal", None

    def _settled(self, rule: Rule, value: tuple) -> bool:
        """No evaluation can change anything before the next row."""
        return not value[1] and value[3] == ("firing" if rule.holds(()) else "normal")

    def _evaluate(self, key: Any, rule: Rule, value: tuple) -> tuple[tuple, list[Row]]:
        g, minutes, xs, phase, since = value
        kept = [(m, x) for m, x in zip(minutes, xs, strict=True) if m >= g - rule.back]
        was, first = phase, since
        if rule.holds([x for _, x in kept]):
            first = g if phase == "normal" else since
            phase = "firing" if g - first >= rule.held else "pending"
        else:
            phase, since = "normal", None
        out = []
        if was == "normal" and phase != "normal":
            out.append(("pending", first))
        if was != "firing" and phase == "firing":
            out.append(("firing", first))
        if was != "normal" and phase == "normal":
            out.append(("resolved" if was == "firing" else "normal", first))
        time = O._time((g + 1) * MINUTE - 1)  # the first row of a key comes at the end of its minute, after the evaluation
        state = (g + 1, [m for m, _ in kept], [x for _, x in kept], phase, None if phase == "normal" else first)
        return state, [Row(rule=key[0], key=key[1], kind=kind, g=g, since=s, time=time) for kind, s in out]

    def _add(self, rule: Rule, minutes: list[int], xs: list[float], minute: int, x: float) -> tuple[list[int], list[float]]:
        if minutes and minutes[-1] == minute:  # another stage's row of this minute
            return minutes, [*xs[:-1], max(xs[-1], x) if rule.combine == "max" else xs[-1] + x]
        return [*minutes, minute], [*xs, x]

    def step(self, key: Any, value: tuple, rows: list[Row]) -> tuple[tuple, Iterable[Row]]:
        rule, out = self.rules[key[0]], []
        for r in rows:
            minute = r["us"] // MINUTE
            if value[0] is None:
                value = (minute, *value[1:])
            while value[0] <= minute:
                if self._settled(rule, value):
                    value = (minute + 1, *value[1:])
                else:
                    value, made = self._evaluate(key, rule, value)
                    out += made
            value = (value[0], *self._add(rule, value[1], value[2], minute, r["x"]), *value[3:])
        return value, out

    def silence(self, key: Any, value: tuple) -> int | None:
        return None if value[0] is None or self._settled(self.rules[key[0]], value) else value[0] * MINUTE

    def quiet(self, key: Any, value: tuple) -> tuple[tuple, Iterable[Row]]:
        return self._evaluate(key, self.rules[key[0]], value)


def transitions(stream: DataFrame, stage: str, values: dict[Rule, Column], delay: str) -> DataFrame:
    """Changes of the rules on a stream with the event time ``ordered.TIME``. ``values``: what a rule adds up, or takes the maximum of, by event. Rows without
    a stage (markers) only move the watermark. A rule with a null value for all events of a minute gets no row of it."""
    aggs = [(F.max(v) if rule.combine == "max" else F.sum(v)).cast("double").alias(rule.name) for rule, v in values.items()]
    minutes = stream.withWatermark(O.TIME, delay).groupBy(F.window(O.TIME, "1 minute"), stage).agg(*aggs)
    key = lambda rule: F.col(stage) if rule.by_stage else F.when(F.col(stage).isNotNull(), F.lit(""))
    each = F.explode(F.array(*[F.struct(F.lit(rule.name).alias("rule"), key(rule).alias("key"), F.col(rule.name).alias("x")) for rule in values])).alias("r")
    rows = minutes.select("window", F.unix_micros("window.end").alias("end"), each).where(F.col("r.x").isNotNull())
    rows = rows.select("r.rule", "r.key", (F.col("end") - 1).alias("us"), "r.x", F.window_time("window").alias(O.TIME))
    return O.apply(rows, ["rule", "key"], Alerts(list(values)), Alerts.output)
