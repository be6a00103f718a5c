"""Session helper and the folder used for written intermediates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",  # ordered rows shrink tenfold in a shuffle: with 64 MB their sorts spill
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(app: str = "stageflow", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the settings the operators expect (UTC, AQE, RocksDB state)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session created by someone else."""
    for key, value in SESSION_CONF.items():
        if spark.conf.get(key, None) != value and spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder named by ``spark.checkpoint.dir``, or, where that is unset, of the warehouse folder.

    A warehouse on a machine's own disk is only accepted for a local master; on a cluster every executor would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        if root.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; {root} is local to a machine")
    return f"{root.rstrip('/')}/stageflow/{name}-{uuid.uuid4().hex[:12]}"


def _drop_all(jvm, conf, paths: list[str]) -> None:
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    paths.clear()


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: lineage is cut, and lost executors cost nothing.

    The folder stays until ``release`` or the end of the session, since the result reads it lazily.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    written(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most rows that a dictionary (stages, segments, sensor columns, variants, configured windows) may have.
DICTIONARY_ROWS = 100_000


def dictionary(df: DataFrame, name: str = "dictionary", rows: int = DICTIONARY_ROWS) -> DataFrame:
    """A table that doesn't grow with the data, as the broadcast side of a join, so that the other side isn't shuffled on a few hot keys.

    It is written and counted first; a table of more than ``rows`` rows is refused, and needs a join of its own kind."""
    kept = materialize(df, name)
    if kept.limit(rows + 1).count() > rows:
        raise ValueError(f"{name} has more than {rows} rows and can't be broadcast")
    return F.broadcast(kept)


def written(spark: SparkSession) -> list[str]:
    """Folders written by ``materialize`` and not yet released."""
    sc = spark.sparkContext
    if not hasattr(sc, "_stageflow_written"):
        sc._stageflow_written = []
        stop = sc.stop

        def stop_after_cleaning() -> None:
            if sc._jsc is not None:
                release(spark)
            stop()

        sc.stop = stop_after_cleaning
    return sc._stageflow_written


def release(spark: SparkSession, keep: int = 0) -> None:
    """Delete the folders of ``materialize`` beyond the first ``keep``; only call it when no result that reads them is needed any more."""
    paths = written(spark)
    gone, paths[keep:] = paths[keep:], []
    _drop_all(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), gone)
