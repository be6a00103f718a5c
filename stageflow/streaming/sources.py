"""Streaming sources: files, topic patterns, Kafka options."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Topic patterns of the ingestion side.
TOPIC_PATTERNS = (
    "factory/line3/+/telemetry",
    "factory/line3/+/health",
    "factory/line3/parts/+/risk",
    "factory/line3/overview",
    "factory/line3/alerts",
    "twin/ai/#",
)


def topic_regex(pattern: str) -> str:
    """Regular expression of a topic pattern: ``+`` is one level, a trailing ``#`` any number of levels."""
    parts = []
    for level in pattern.split("/"):
        parts.append("[^/]+" if level == "+" else ".*" if level == "#" else re.escape(level))
    text = "/".join(parts)
    return "^" + (text[: -len("/.*")] + "(/.*)?" if text.endswith("/.*") else text) + "$"


def subscribed(topic: Column, patterns=TOPIC_PATTERNS) -> Column:
    """SRC9: true where a topic matches any of the patterns."""
    out = F.lit(False)
    for p in patterns:
        out = out | topic.rlike(topic_regex(p))
    return out


def file_stream(spark: SparkSession, path: str, schema=None, fmt: str = "parquet", per_trigger: int = 256) -> DataFrame:
    """Stream over files that appear under ``path``; the schema is read from the files unless given.

    ``per_trigger`` bounds a micro-batch; results of order-sensitive operators do not depend on it (``streaming.ordered``).
    """
    schema = schema or spark.read.format(fmt).load(path).schema
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def kafka_stream(spark: SparkSession, servers: str, pattern: str) -> DataFrame:
    """Stream of (topic, payload, ts) from Kafka; needs the Kafka connector on the class path."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribePattern", pattern)
        .option("startingOffsets", "earliest")
        .load()
    )
    return raw.select("topic", F.col("value").cast("string").alias("payload"), F.col("timestamp").alias("ts"))
