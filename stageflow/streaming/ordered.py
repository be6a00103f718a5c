"""Order-sensitive stream operators on Spark's own state.

Every operator is a ``transformWithState`` processor: a message waits in the state of its key until the watermark has passed it, then it is
taken in event order, so neither the number nor the order of files matters as long as no row comes later than the watermark's delay (Spark
drops those). What an operator carries from message to message is one value a key. Timers are set to the first waiting message, or to the
end of a silence; the watermark, moved by any key, fires them.

Operators can be chained in one query: ``time`` is the event time that the next one waits for.

Every access to the state is a call from Python to Spark. Waiting rows are therefore kept in blocks, and many small keys share one state
(``dealt``), so that the calls grow with the buckets of a batch, not with its keys.

Operators that take every message (``InColumns``) work on columns of all rows that are due. Their rows come packed, some thousands in a block, since
Spark hands rows to Python one by one.
"""

from __future__ import annotations

import bisect
import pickle
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from stageflow.session import work_dir
from stageflow.streaming import columns as C

#: Event time of the rows, for the watermark; event order is by the other columns.
TIME = "time"

#: Waiting rows in one block of the state.
BLOCK = 10_000
HELD = StructType([StructField("rows", BinaryType())])


def _ms(us: int) -> int:
    """Watermark from which a row of this microsecond is due; Spark drops rows that come later."""
    return -(-us // 1000)


class InOrder(StatefulProcessor):
    """Base of the operators. A row has ``us`` (event time in microseconds) and sorts by ``order``; rows without a key (markers) only move the
    watermark. ``step`` takes the carried value and
    the rows that are due, in order, and returns the new value and the output. ``silence(key, value)``: microsecond at which ``quiet`` is due if nothing
    comes before, or None; ``quiet`` is called until that lies ahead of the watermark."""

    row: str  # schema of the input rows
    value: str  # schema of the carried value
    order: tuple[str, ...] = ("us", "event_id")
    forgets = False  # drop the state of a key that is back at its start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carried = handle.getValueState("carried", StructType([*self.value_type, StructField("armed", LongType())]))
        self.waiting = handle.getListState("waiting", HELD)
        self.names = self.row_type.names
        self.make = Row(*self.names)

    def start(self) -> tuple:
        raise NotImplementedError

    def step(self, key: Any, value: tuple, rows: list[Row]) -> tuple[tuple, Iterable[Row]]:
        raise NotImplementedError

    def silence(self, key: Any, value: tuple) -> int | None:
        return None

    def quiet(self, key: Any, value: tuple) -> tuple[tuple, Iterable[Row]]:
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        fresh, at = [], None
        for r in rows:
            at = at or [r.__fields__.index(n) for n in self.names]
            plain = tuple(r)  # a row's own access by name is slow
            fresh.append(self.make(*[plain[i] for i in at]))
        return self._advance(key, fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        return self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def _advance(self, key: Any, fresh: list[Row], watermark: int) -> Iterator[Row]:
        if key[0] is None:
            return iter(())
        held = [self.make(*r) for block in self.waiting.get() for r in pickle.loads(block[0])]
        at = [self.names.index(c) for c in self.order]
        rows = sorted(held + fresh, key=lambda r: tuple((tuple.__getitem__(r, i) is not None, tuple.__getitem__(r, i)) for i in at))  # nulls first
        us = self.names.index("us")
        n_due = bisect.bisect_right(rows, watermark, key=lambda r: _ms(tuple.__getitem__(r, us)))
        due, left = rows[:n_due], rows[n_due:]
        kept = self.carried.get()
        value, armed = (self.start(), None) if kept is None else (tuple(kept[:-1]), kept[-1])
        out: list[Row] = []
        if due:
            value, made = self.step(key, value, due)
            out.extend(made)
        while (end := self.silence(key, value)) is not None and _ms(end) <= watermark:
            value, made = self.quiet(key, value)
            out.extend(made)
        if left and (fresh or due):
            self.waiting.put([(pickle.dumps([tuple(r) for r in left[i : i + BLOCK]], 5),) for i in range(0, len(left), BLOCK)])
        elif held and not left:
            self.waiting.clear()
        times = [_ms(x) for x in (left[0]["us"] if left else None, end) if x is not None]
        wanted = min(times) - 1 if times else None  # a timer fires once the watermark is past it
        if armed != wanted:
            if armed is not None and armed >= watermark:  # older ones have fired or are about to, and change nothing
                self.handle.deleteTimer(armed)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        if wanted is None and self.forgets and tuple(value) == self.start():
            self.carried.clear()  # as if the key had never come
        else:
            self.carried.update((*value, wanted))
        return iter(out)

    def close(self) -> None:
        pass


class InColumns(InOrder):
    """Base of the operators that take the rows that are due as columns. ``step`` gets them in order as one table, and returns the new value and a frame of
    the output; the value may hold arrays. Such an operator doesn't wait for silences. Driven by hand, it takes and gives rows.

    ``first``: the operator reads the source. Spark sees the time of a block, not those of its rows, so the operator drops the rows itself that come later than the
    watermark of the batch before. A timer calls every key whenever the watermark moves; so that watermark is the one at which the key was last called."""

    first = False
    CHUNK = 100_000  # most rows in a block of the state or a frame of the output

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carried = handle.getValueState("carried", HELD)
        self.armed = handle.getValueState("armed", StructType([StructField("ms", LongType())]))
        self.waiting = handle.getListState("waiting", HELD)

    def step(self, key: Any, value: Any, rows: pa.Table) -> tuple[Any, Any]:
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[Any], timerValues: Any) -> Iterator[Any]:
        got, schema = list(rows), C.schema(self.row)
        watermark = timerValues.getCurrentWatermarkInMs()
        if isinstance(got[0], Row):
            made = self._advance(key, [pa.Table.from_pylist([r.asDict() for r in got], schema)], watermark)
            return (Row(**r) for f in made for r in f.to_dict("records"))
        return self._advance(key, [C.unpacked(b) for f in got for b in f["block"]], watermark)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Any]:
        return self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def _advance(self, key: Any, fresh: list[pa.Table], watermark: int) -> Iterator[Any]:
        armed = self.armed.get()
        armed = None if armed is None else armed[0]
        if key[0] is None or not fresh and (armed is None or armed > watermark):  # the rows of this batch have been taken
            return
        if self.first:
            in_time = [C.values(t, "us") > ((armed or 1) - 1) * 1000 for t in fresh]
            fresh = [t if x.all() else t.filter(pa.array(x)) for t, x in zip(fresh, in_time, strict=True)]
        held = [C.unpacked(block[0]) for block in self.waiting.get()]
        out, first_left = None, None
        if any(t.num_rows for t in (*held, *fresh)):
            rows = pa.concat_tables([*held, *fresh])
            is_due = C.values(rows, "us") <= watermark * 1000  # as _ms(us) <= watermark
            due, left = (rows, rows.slice(0, 0)) if is_due.all() else (rows.filter(pa.array(is_due)), rows.filter(pa.array(~is_due)))
            if left.num_rows:
                self.waiting.put([(C.packed(left.slice(i, self.CHUNK)),) for i in range(0, left.num_rows, self.CHUNK)])
                first_left = pc.min(left["us"]).as_py()
            elif held:
                self.waiting.clear()
            del rows, left, held, fresh, is_due  # a stage may have a third of a batch's rows: one copy of them is enough
            if due.num_rows:
                due = C.in_order(due, self.order)
                kept = self.carried.get()
                value, out = self.step(key, self.start() if kept is None else pickle.loads(kept[0]), due)
                self.carried.update((pickle.dumps(value, 5),))
            del due
        wanted = watermark + 1 if self.first else None if first_left is None else _ms(first_left)  # a timer fires once the watermark has come to it
        if armed != wanted:
            if armed is not None and armed > watermark:
                self.handle.deleteTimer(armed)
            if wanted is not None:
                self.handle.registerTimer(wanted)
            self.armed.update((wanted,))
        if out is not None:
            for i in range(0, len(out), self.CHUNK):
                yield out.iloc[i : i + self.CHUNK]


def _schema(text: str) -> StructType:
    return StructType.fromDDL(text)


def packed(df: DataFrame, key: Column, row: str, keys: int = 0) -> DataFrame:
    """Rows of a stream as blocks: key, latest time and the columns of ``row``. Each of the keys below ``keys`` gets a block of every partition, if only an empty one."""
    cut = df.select(key.alias("key"), TIME, *[F.col(f.name).cast(f.dataType).alias(f.name) for f in _schema(row)])
    return cut.mapInArrow(lambda batches: C.pack_by_key(batches, keys), StructType([*[StructField(f.name, f.dataType, True, f.metadata) for f in cut.schema.fields[:2]], StructField("block", BinaryType())]))


def apply(df: DataFrame, key: list[str], processor: InOrder, output: str, delay: str | None = None) -> DataFrame:
    """The operator on a stream with the event time ``TIME``. delay: how late rows may come; None behind another operator."""
    if isinstance(processor, InColumns):
        return dealt(df, *key, processor, delay) if delay else _on_blocks(packed(df, F.col(*key), processor.row), processor, output)
    rows = df if delay is None else df.withWatermark(TIME, delay)
    processor.row_type, processor.value_type = _schema(processor.row), _schema(processor.value)  # workers can't parse schemas
    return rows.groupBy(*key).transformWithState(
        statefulProcessor=processor, outputStructType=_schema(f"{output}, {TIME} timestamp"), outputMode="append", timeMode="EventTime", eventTimeColumnName=TIME)


def _on_blocks(blocks: DataFrame, processor: InColumns, output: str) -> DataFrame:
    return blocks.groupBy("key").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=_schema(f"{output}, {TIME} timestamp"), outputMode="append", timeMode="EventTime", eventTimeColumnName=TIME)


class Dealt(InColumns):
    """Another operator, which takes the rows of many keys at once, for all keys of a bucket."""

    def __init__(self, operator: InColumns, key: str) -> None:
        self.operator, self.by = operator, key
        self.row, self.output, self.order = operator.row, operator.output, operator.order

    def start(self) -> Any:
        return self.operator.start()

    def step(self, key: Any, value: Any, rows: pa.Table) -> tuple[Any, Any]:
        return self.operator.step(key, value, rows)


#: Buckets of ``dealt``; part of a checkpoint's state, as the number of shuffle partitions is.
BUCKETS = 128


def dealt(df: DataFrame, key: str, operator: InColumns, delay: str) -> DataFrame:
    """The first operator of a stream, by buckets of its keys."""
    operator = operator if isinstance(operator, Dealt) else Dealt(operator, key)
    operator.first = True
    bucket = F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    return _on_blocks(packed(df.withWatermark(TIME, delay), bucket, operator.row, BUCKETS), operator, operator.output)


PARTITIONS = "spark.sql.shuffle.partitions"


def run(df: DataFrame, name: str, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Run a stream over everything available into a table and read the table; given folders go on where an earlier run ended.

    Every partition of an operator's state costs a Python worker and a commit in every batch, whether or not it has rows, and a batch is bounded by its
    files. So a new stream has one partition a core, if the session doesn't ask for fewer; one that goes on keeps the number in its checkpoint."""
    spark = df.sparkSession
    out = out or work_dir(spark, name)
    asked = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, min(int(asked), max(1, spark.sparkContext.defaultParallelism)))
    try:  # start() takes a copy of the settings
        query = (
            df.drop(TIME).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint or work_dir(spark, f"{name}-checkpoint"))
            .outputMode("append").trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(PARTITIONS, asked)
    query.awaitTermination()
    return spark.read.schema(df.drop(TIME).schema).parquet(out)


class Entities(InColumns):
    """STR1: per message of an entity the previous stage, stages and anomalies so far, and the number of its life. An exit ends a life, and so
    does a silence longer than ``idle_us``. State: the lives of the entities, and their messages ahead of the watermark."""

    row = "entity long, event_id long, us long, stage string, is_anomaly boolean, outcome int"
    output = "entity long, event_id long, us long, stage string, prev_stage string, visited long, anomalies long, is_exit boolean, life int, outcome int, stages array<string>"
    order = ("entity", "us", "event_id")

    def __init__(self, exit_stage: str, idle_us: int = 30 * 86_400_000_000) -> None:
        self.exit_stage, self.idle_us = exit_stage, idle_us

    def start(self) -> Any:
        return [], C.Lives.start()

    def step(self, key: Any, value: Any, rows: pa.Table) -> tuple[Any, Any]:
        import pandas as pd

        names, lives = value
        found = rows["stage"].combine_chunks().dictionary_encode()
        number = {x: i for i, x in enumerate(names)}
        names = [*names, *[x for x in found.dictionary.to_pylist() if x not in number]]
        number = {x: i for i, x in enumerate(names)}
        stage = np.array([*[number[x] for x in found.dictionary.to_pylist()], -1], np.int32)[found.indices.fill_null(-1).to_numpy()]
        entity, us, leaves = C.values(rows, "entity"), C.values(rows, "us"), stage == number.get(self.exit_stage, -2)
        lives, got = C.Lives.step(lives, entity, us, stage, leaves, C.values(rows, "is_anomaly"), self.idle_us, distinct=True)
        text = np.array([*names, None], object)
        seen = np.full(len(us), None, object)
        for i, x in zip(np.flatnonzero(leaves), got["seen"], strict=True):
            seen[i] = text[x].tolist()
        out = pd.DataFrame({
            "entity": entity, "event_id": C.series(rows["event_id"]), "us": us, "stage": text[stage], "prev_stage": text[got["last"]], "visited": got["n_seen"],
            "anomalies": got["anomalies"], "is_exit": leaves, "life": got["life"], "outcome": C.series(rows["outcome"]), "stages": seen, TIME: _times(us),
        })
        return (names, lives), out


class StageWindows(InColumns):
    """STR2: for each visit, the visits in the stage's window and the mean of the last ``window`` outcomes that the stage had learnt. An outcome
    counts if the entity's life is among the stage's last visits when it comes. State: the last visits and outcomes of a stage."""

    row = "stage string, us long, pos long, event_id long, entity long, life int, outcome int"
    output = "stage string, event_id long, us long, visits long, observed_rate double"
    order = ("us", "pos", "entity")

    def __init__(self, window: int, default: float) -> None:
        self.window, self.default = window, default

    def start(self) -> Any:
        return C.Learnt.start()

    def step(self, key: Any, value: Any, rows: pa.Table) -> tuple[Any, Any]:
        import pandas as pd

        outcome = C.values(rows, "pos") % 2 == 1
        value, visits, rate = C.Learnt.step(
            value, outcome, C.values(rows, "entity"), C.values(rows, "life"), C.values(rows, "outcome"), self.window, self.default)
        mine = rows.filter(pa.array(~outcome))
        us = C.values(mine, "us")
        return value, pd.DataFrame({"stage": mine["stage"].to_numpy(), "event_id": C.series(mine["event_id"]), "us": us, "visits": visits, "observed_rate": rate, TIME: _times(us)})


def stage_messages(entities: DataFrame) -> DataFrame:
    """Visits and, for every stage of a life that has ended, its outcome. ``pos`` puts a visit before the outcome of the same message."""
    visit = F.struct("stage", (F.col("event_id") * 2).alias("pos"))
    learnt = F.transform("stages", lambda s: F.struct(s.alias("stage"), (F.col("event_id") * 2 + 1).alias("pos")))
    both = F.when(F.col("is_exit"), F.concat(F.array(visit), learnt)).otherwise(F.array(visit))
    return entities.withColumn("m", F.explode(both)).select("m.stage", "us", "m.pos", "event_id", "entity", "life", "outcome", TIME)


class Sequences(InOrder):
    """STR4: for each window that ends ``length`` consecutive windows with at least ``least`` messages: the first of them and their values. State: the
    last windows of a line."""

    row = "line int, us long, window_id long, parts long, value double"
    value = "last long, held array<double>"
    output = "line int, window_id long, first_window long, values array<double>"
    order = ("us", "window_id")

    def __init__(self, length: int, least: int) -> None:
        self.length, self.least = length, least

    def start(self) -> tuple:
        return -1, []

    def step(self, key: Any, value: tuple, rows: list[Row]) -> tuple[tuple, Iterable[Row]]:
        last, held = value
        held, out = list(held or []), []
        for r in rows:
            if r["window_id"] != last + 1:
                held = []
            last = r["window_id"]
            held = [*held, r["value"]][-self.length :] if r["parts"] >= self.least else []
            if len(held) == self.length:
                out.append(Row(line=r["line"], window_id=last, first_window=last - self.length + 1, values=held, time=_time(r["us"])))
        return (last, held[1 - self.length :]), out


class Arrivals(InOrder):
    """STR5: at each message, how many the stage has had in the time ``width_us`` up to and including it. State: the times in that width,
    with the number of messages of each. By (stage, slot), as ``arrivals`` deals them, a key reports the messages of its own slot, reads those of the
    slot before, and is forgotten at its end."""

    row = "stage string, event_id long, us long"
    value = "times array<long>, counts array<long>"
    output = "stage string, event_id long, us long, arrivals long"

    forgets = True

    def __init__(self, width_us: int) -> None:
        self.width = width_us

    def start(self) -> tuple:
        return [], []

    def silence(self, key: Any, value: tuple) -> int | None:
        return (key[1] + 1) * self.width if len(key) > 1 and value[0] else None

    def quiet(self, key: Any, value: tuple) -> tuple[tuple, Iterable[Row]]:
        return self.start(), []

    def step(self, key: Any, value: tuple, rows: list[Row]) -> tuple[tuple, Iterable[Row]]:
        us = np.array([r["us"] for r in rows], np.int64)
        times = np.concatenate([np.repeat(np.array(value[0] or [], np.int64), np.array(value[1] or [], np.int64)), us])
        n = np.searchsorted(times, us, "right") - np.searchsorted(times, us - self.width, "left")
        out = [Row(stage=r["stage"], event_id=r["event_id"], us=r["us"], arrivals=int(k), time=_time(r["us"])) for r, k in zip(rows, n, strict=True) if len(key) < 2 or r["us"] // self.width == key[1]]
        kept, counts = np.unique(times[times >= us[-1] - self.width], return_counts=True)
        return (kept.tolist(), counts.tolist()), out


def slot(us: Column, width_us: int) -> Column:
    """Number of the slot of time."""
    return ((us - F.pmod(us, F.lit(width_us))) / F.lit(width_us)).cast("long")


def arrivals(stream: DataFrame, width_us: int, delay: str) -> DataFrame:
    """STR5 on a stream of ``Arrivals.row`` and the event time, by stage and slot of time: a message goes to its own slot and to the next, which looks back
    into it, so a stage spreads over as many keys as there are slots."""
    own = slot(F.col("us"), width_us)
    return apply(stream.withColumn("slot", F.explode(F.array(own, own + 1))), ["stage", "slot"], Arrivals(width_us), Arrivals.output, delay)


class Silences(InOrder):
    """STR7: every silence of a key that lasts longer than the limit. ``idle`` comes by a timer as soon as the watermark has passed the limit, whether or
    not the key speaks again, and once a silence; ``back`` comes with the message that ends it. State: the last message of a key and whether its
    silence has been reported. ``every``: width of the windows that the rows were taken from, if they come at the end of their window; ``idle`` then
    waits for the end of the window in which the limit lies."""

    row = "stage string, us long"
    value = "last long, reported boolean"
    output = "stage string, kind string, idle_from long, us long"
    order = ("us",)

    def __init__(self, limit_us: int, every: int | None = None) -> None:
        self.limit, self.every = limit_us, every

    def start(self) -> tuple:
        return None, True

    def _end(self, us: int) -> int:
        return (us // self.every + 1) * self.every if self.every else us

    def _row(self, key: Any, kind: str, last: int, us: int) -> Row:
        return Row(stage=key[0], kind=kind, idle_from=last, us=us, time=_time(self._end(us) - 1 if self.every else us))

    def step(self, key: Any, value: tuple, rows: list[Row]) -> tuple[tuple, Iterable[Row]]:
        last, reported = value
        out = []
        for r in rows:
            if last is not None and r["us"] - last > self.limit:
                out += [] if reported else [self._row(key, "idle", last, last + self.limit)]
                out.append(self._row(key, "back", last, r["us"]))
            last, reported = r["us"], False
        return (last, reported), out

    def silence(self, key: Any, value: tuple) -> int | None:
        last, reported = value
        return None if last is None or reported else self._end(last + self.limit)

    def quiet(self, key: Any, value: tuple) -> tuple[tuple, Iterable[Row]]:
        return (value[0], True), [self._row(key, "idle", value[0], value[0] + self.limit)]


def silences(stream: DataFrame, limit_us: int, delay: str) -> DataFrame:
    """STR7 on a stream of ``Silences.row`` and the event time. Spark's windows keep the first and last message of a stage in a tenth of the limit: no
    silence lies between two messages of one window, so a stage takes two rows a window, not one a message."""
    every = max(1, limit_us // 10)
    ends = stream.withWatermark(TIME, delay).groupBy(F.window(TIME, f"{every} microseconds"), "stage").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    rows = ends.select("stage", F.explode(F.array_distinct(F.array("first", "last"))).alias("us"), F.window_time("window").alias(TIME))
    return apply(rows, ["stage"], Silences(limit_us, every), Silences.output)


def _time(us: int) -> Any:
    import datetime

    return datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(microseconds=us)


def _times(us: np.ndarray) -> Any:
    """``_time`` of a column."""
    import pandas as pd

    return pd.Series(us.astype("datetime64[us]")).dt.tz_localize("UTC")


def timed(us: Column) -> Column:
    """Event time of microseconds, as the operators write it."""
    return F.timestamp_micros(us).alias(TIME)


#: Files of a slice of ``land``, and most rows of one: a table that is read in a few large parts makes few files a slice, and a batch may take several slices.
FILES, FILE_ROWS = 8, 300_000


def land(df: DataFrame, path: str, slices: int, us: str = "us") -> int:
    """A table as files that arrive one after the other, each slice with a later part of the time; returns the width of a slice. What is in a
    slice comes in any order, so a slice's width is the least delay that loses nothing."""
    first, last = df.agg(F.min(us), F.max(us)).first()
    if first is None:
        return 1
    width = (last - first) // slices + 1
    parts = f"{path}-slices"
    cut = df.where(F.col(us).isNotNull()).withColumn("slice", ((F.col(us) - first - F.pmod(F.col(us) - first, F.lit(width))) / F.lit(width)).cast("int"))
    cut.write.partitionBy("slice").parquet(parts)
    for (k,) in sorted(cut.select("slice").distinct().collect()):
        df.sparkSession.read.schema(df.schema).parquet(f"{parts}/slice={k}").coalesce(FILES).write.option("maxRecordsPerFile", FILE_ROWS).mode("append").parquet(path)
    return width


def marker(df: DataFrame, path: str, ahead_us: int, us: str = "us") -> None:
    """A last file with one row whose keys are null, so far ahead in time that the watermark passes all others."""
    top = df.agg(F.max(us)).first()[0]
    if top is None:
        return
    row = [top + ahead_us if c == us else None for c in df.columns]
    df.sparkSession.createDataFrame([tuple(row)], StructType([type(f)(f.name, f.dataType, True) for f in df.schema])).coalesce(1).write.mode("append").parquet(path)


def files(spark: SparkSession, path: str, schema: StructType, per_trigger: int) -> DataFrame:
    """Stream with an event time over the files of a folder, by arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
