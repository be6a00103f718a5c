"""Adapters: driver tables read as visits, labels, sensors, messages and wide raw tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stageflow.operators import scoring as SCO
from stageflow.operators import visits as V
from stageflow.session import materialize

STAGES = (1, 2, 3, 4, 5, 6, 7)
SENSORS = ("qty", "price", "disc", "tax")
FORK = (5, 6)
ENTRY_STAGE, EXIT_STAGE = 1, 7
DAY_MINUTES = 1440.0


def stage_rank(stage: Column) -> Column:
    """Position in the flow; the two fork stages share a rank."""
    return F.when(stage == FORK[1], FORK[0]).when(stage > FORK[1], stage - 1).otherwise(stage)


#: Columns of a message, from a visit with its rank, previous stage and transit, and the label of its entity.
MESSAGE_NAMES = ("entity", "stage", "stage_rank", "t", "transit_minutes", "features", "is_entry", "is_exit", "response", "prev_stage")


def message_columns() -> list[Column]:
    derived = {
        "t": F.col("entry"),
        "features": V.sensor_map(SENSORS),
        "is_entry": F.col("stage") == ENTRY_STAGE,
        "is_exit": F.col("stage") == EXIT_STAGE,
        "response": F.when(F.col("stage") == EXIT_STAGE, F.col("label")),
    }
    return [derived[n].alias(n) if n in derived else F.col(n) for n in MESSAGE_NAMES]


@dataclass
class Data:
    spark: SparkSession
    sf_dir: str
    _written: set[str] = field(default_factory=set)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stored(self, *tables: str) -> Data:
        """Write the named derived tables once, so that a job reading them several times does not derive them again."""
        for name in tables:
            if name not in self._written:
                self.__dict__[name] = materialize(getattr(self, name), name)
                self._written.add(name)
        return self

    @cached_property
    def rows(self) -> DataFrame:
        """Stage records: one row per raw line, time in days since 1995-01-01, a missing discount is null."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("entity"),
            F.col("l_linenumber").cast("int").alias("stage"),
            F.floor((F.col("l_linenumber") - 1) / 2).cast("int").alias("line"),
            F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long").alias("t"),
            F.col("l_quantity").alias("qty"),
            F.col("l_extendedprice").alias("price"),
            F.nullif(F.col("l_discount"), F.lit(0.0)).alias("disc"),
            F.col("l_tax").alias("tax"),
            (F.col("l_returnflag") == "R").cast("int").alias("row_label"),
        )

    @cached_property
    def labels(self) -> DataFrame:
        """Pass/fail outcome per entity."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("entity"), (F.col("o_orderstatus") == "F").cast("int").alias("label")
        )

    @cached_property
    def visits(self) -> DataFrame:
        """One row per (entity, stage) with entry, exit, duration and the largest sensor readings.

        Rows meet by entity, so that the windows, joins and aggregates per entity after it need no other shuffle.
        """
        return V.derive_visits(
            self.rows.repartition("entity"), "entity", "stage", "t", carry=("line",), maxima=SENSORS
        )

    @cached_property
    def labelled_visits(self) -> DataFrame:
        return V.attach_label(self.visits, self.labels)

    @cached_property
    def sensor_values(self) -> DataFrame:
        """Long sensor table: (entity, stage, line, entry, feature, value), missing readings dropped."""
        return V.sensors_long(self.visits, SENSORS, ("entity", "stage", "line", "entry"))

    @cached_property
    def messages(self) -> DataFrame:
        """Telemetry messages: one per visit, with transit, sensor map and the outcome revealed at the exit."""
        return self.moved.join(self.labels, "entity", "left").select(*message_columns())

    @property
    def moved(self) -> DataFrame:
        """Visits with their rank, the previous stage and the transit from it."""
        ranked = self.visits.withColumn("stage_rank", stage_rank(F.col("stage")).cast("int"))
        return V.transit_from_previous(ranked, "entity", "stage_rank", "entry", DAY_MINUTES)

    @cached_property
    def lived_messages(self) -> DataFrame:
        """Messages with their lives. They are written once, with the columns of their visits, from which ``visits`` and ``messages`` are then read too.

        The outcomes of an entity are numbered before the join, so that ``copy`` tells the first message of a visit from those that another outcome adds.
        The messages carry their readings as columns too.
        """
        outcomes = self.labels.withColumn("copy", F.row_number().over(Window.partitionBy("entity").orderBy("label")) - 1)
        carried = ("line", "entry", "exit", *SENSORS, "copy")
        flow = self.moved.join(outcomes, "entity", "left").select(*message_columns(), *carried)
        written = materialize(SCO.lives(flow).drop("features", "t"), "flow").withColumn("t", F.col("entry"))
        self.visits = written.where(F.coalesce("copy", F.lit(0)) == 0).select(
            "entity", "stage", "line", "entry", "exit", (F.col("exit") - F.col("entry")).alias("duration"), *SENSORS
        )
        lived = written.withColumn("features", V.sensor_map(SENSORS)).drop(*[c for c in carried if c not in SENSORS])
        self.messages = lived.select(*MESSAGE_NAMES)
        self._written |= {"visits", "messages"}
        return lived

    @cached_property
    def events(self) -> DataFrame:
        """Event stream table: time in microseconds since 2024-01-01, JSON properties as a map."""
        ts = F.col("ts").cast("timestamp")
        return self.table("events").select(
            "event_id",
            (F.unix_micros(ts) - F.lit(1704067200000000)).alias("us"),
            ts.alias("ts"),
            F.col("user_id").alias("entity"),
            F.col("event_type").alias("stage"),
            "value",
            "props",
        )

    @cached_property
    def wide(self) -> DataFrame:
        """Wide raw table: Id, L<line>_S<stage>_D1/D2 and L<line>_S<stage>_F1..F4, Response."""
        names = wide_names()
        aggs = []
        for stage in STAGES:
            here = F.col("stage") == stage
            d1, d2, *feats = names[stage]
            aggs += [F.min(F.when(here, F.col("t"))).alias(d1), F.max(F.when(here, F.col("t"))).alias(d2)]
            aggs += [F.max(F.when(here, F.col(s))).alias(n) for s, n in zip(SENSORS, feats)]
        return (
            self.labels.join(self.rows, "entity", "left")
            .groupBy("entity")
            .agg(F.max("label").alias("Response"), *aggs)
            .withColumnRenamed("entity", "Id")
        )


def wide_names() -> dict[int, list[str]]:
    """Column names of the wide table per stage: two dates, then the four sensors."""
    return {
        s: [f"L{(s - 1) // 2}_S{s}_D{k}" for k in (1, 2)] + [f"L{(s - 1) // 2}_S{s}_F{k}" for k in (1, 2, 3, 4)]
        for s in STAGES
    }
