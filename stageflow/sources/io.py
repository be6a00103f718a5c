"""Scans and sinks: CSV, Parquet, JSON messages, parameter tables, written results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def wide_schema(columns: Sequence[str], key: str = "Id", label: str | None = "Response") -> T.StructType:
    """Explicit schema of a wide numeric file: integer key, all readings double, optional label."""
    fields = [T.StructField(key, T.LongType())] + [T.StructField(c, T.DoubleType()) for c in columns]
    if label:
        fields.append(T.StructField(label, T.IntegerType()))
    return T.StructType(fields)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """SRC1-2: CSV scan with a given schema; ``columns`` prunes inside the parser."""
    df = spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)
    return df.select(*columns) if columns else df


def scan_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    """SRC5-6: Parquet scan; filter and projection are pushed to the reader."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """SRC4: the first n rows in a stated order."""
    return df.orderBy(*order).limit(n)


def restrict_to(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """SRC3 / JN3: keep the rows whose key occurs in ``ids``."""
    return df.join(ids.select(key), key, "left_semi")


def parameter_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """SRC8: configuration as a table; its size is fixed by the configuration file."""
    return spark.createDataFrame(list(rows), schema)


def decode_json(df: DataFrame, payload: str, schema: str) -> DataFrame:
    """SRC10: parse JSON messages; ``_corrupt`` keeps the text of a message that does not parse."""
    full = f"{schema}, _corrupt STRING"
    parsed = F.from_json(F.col(payload), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return df.withColumn("_msg", parsed).select("*", "_msg.*").drop("_msg")


def split_corrupt(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good messages and the quarantine branch."""
    bad = F.col("_corrupt").isNotNull()
    return decoded.where(~bad).drop("_corrupt"), decoded.where(bad)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """SNK1: overwrite a table, optionally partitioned by low-cardinality columns."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def write_summary_csv(df: DataFrame, path: str) -> str:
    """SNK2: a small summary as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """A wide table as CSV, one file per partition."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    """SNK3: a one-row statistics record as JSON."""
    df.write.mode("overwrite").json(path)
    return path


def routed(df: DataFrame, topic: Column, fields: Sequence[str]) -> DataFrame:
    """SNK4: (topic, payload) rows, ready for a message sink."""
    return df.select("*", topic.alias("topic"), F.to_json(F.struct(*fields)).alias("payload"))
