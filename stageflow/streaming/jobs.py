"""Streaming operators and the helpers that run them to completion on the data available now."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stageflow.session import work_dir


def run_append(df: DataFrame, name: str) -> DataFrame:
    """Run an append-mode stream over everything available into a table, and read the table."""
    spark = df.sparkSession
    out = work_dir(spark, name)
    query = (
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", work_dir(spark, f"{name}-cp"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def run_batches(df: DataFrame, name: str, fn: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """SNK7: hand every micro-batch to ``fn(batch, batch_id)``."""
    query = (
        df.writeStream.foreachBatch(fn).option("checkpointLocation", work_dir(df.sparkSession, f"{name}-cp"))
        .outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """SNK6: idempotent sink; a batch that is replayed overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_batches(df_schema, spark, path: str) -> DataFrame:
    return spark.read.schema(df_schema).option("basePath", path).parquet(f"{path}/batch=*").drop("batch")


def persist(df: DataFrame, name: str) -> DataFrame:
    """STR10: micro-batch append of a stream into a table."""
    path = work_dir(df.sparkSession, name)
    run_batches(df, name, write_batch(path))
    return read_batches(df.schema, df.sparkSession, path)


def tumbling(df: DataFrame, ts: str, stage: str, width: str, delay: str, aggs: Sequence[Column]) -> DataFrame:
    """STR3: windows per stage, emitted once the watermark has passed their end."""
    return (
        df.withWatermark(ts, delay).groupBy(F.window(ts, width), stage).agg(*aggs)
        .select(F.col("window.start").alias("w_start"), F.col("window.end").alias("w_end"), stage, *[c for c in _names(df, ts, stage, width, aggs)])
    )


def _names(df: DataFrame, ts: str, stage: str, width: str, aggs: Sequence[Column]) -> list[str]:
    probe = df.groupBy(F.window(ts, width), stage).agg(*aggs)
    return probe.columns[2:]


def sliding(df: DataFrame, ts: str, width: str, step: str, delay: str) -> DataFrame:
    """STR5: arrivals per sliding window."""
    return (
        df.withWatermark(ts, delay).groupBy(F.window(ts, width, step)).agg(F.count(F.lit(1)).alias("arrivals"))
        .select(F.col("window.start").alias("w_start"), F.col("window.end").alias("w_end"), "arrivals")
    )


def split_late(df: DataFrame, ts: str, delay_seconds: int, name: str) -> tuple[DataFrame, DataFrame]:
    """STR6: rows older than the newest earlier event minus the delay go to a side table.

    The newest event time of every batch is kept in a table of one row per batch, so a restarted query continues
    with the same limit and a replayed batch gives the same split.
    """
    spark = df.sparkSession
    main, late, marks = (work_dir(spark, f"{name}-{part}") for part in ("main", "late", "marks"))

    def write(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        limit = None
        if batch_id > 0:
            seen = s.read.schema("top TIMESTAMP, batch LONG").option("basePath", marks).parquet(f"{marks}/batch=*")
            limit = seen.where(F.col("batch") < batch_id).agg(F.max("top")).first()[0]
        batch.agg(F.max(ts).alias("top")).write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")
        is_late = F.col(ts) < F.lit(limit) - F.make_dt_interval(secs=F.lit(delay_seconds)) if limit is not None else F.lit(False)
        batch.where(~is_late).write.mode("overwrite").parquet(f"{main}/batch={batch_id}")
        batch.where(is_late).write.mode("overwrite").parquet(f"{late}/batch={batch_id}")

    run_batches(df, name, write)
    return read_batches(df.schema, spark, main), read_batches(df.schema, spark, late)
