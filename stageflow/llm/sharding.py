"""Contiguous shards of nearly equal byte size, cut on global prefix sums.

Rows are ordered by (digest of the text, id, whole row), so equal texts are neighbours. The order is dealt to partitions by range over all
three, which splits a text that a third of the rows share. Only totals by partition reach the driver; they are the starts of the prefix sums
inside the partitions. The cuts are the multiples of total / n. A cut inside a group of equal texts moves to the nearer end of the group
if the group is smaller than ``whole`` of a shard; larger groups are cut where the target is.

Null texts count as empty (size 1, crc32 0); repeated rows keep their number; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stageflow.llm.common import materialize, table
from stageflow.llm.prefix import prefix_sums

#: Largest part of a shard's target that a group of equal texts may have to stay in one shard.
WHOLE = 0.05


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, group) of each row; the text itself goes no further."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return df.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("group")
    )


def cuts(rows: DataFrame, total: int, n: int, whole: float = WHOLE) -> list[int]:
    """The n - 1 cuts in bytes; those inside small groups of equal texts are moved to the nearer end of the group."""
    targets = [total * k // n for k in range(1, n)]
    if not targets or not total:
        return targets
    crossing = F.lit(False)
    for t in targets:
        crossing = crossing | ((F.col("at") <= t) & (F.col("at") + F.col("size") > t))
    keys = rows.where(crossing).select("group").distinct()  # n - 1 groups at most
    extents = rows.join(F.broadcast(keys), "group").groupBy("group").agg(F.min("at"), F.max(F.col("at") + F.col("size"))).collect()
    out = []
    for t in targets:
        begin, end = next(((b, e) for _, b, e in extents if b <= t < e), (t, t))
        out.append(t if end - begin > whole * total / n else begin if t - begin <= end - t else end)
    return sorted(out)


def shard(df: DataFrame, n: int = 16, id_col: str = "doc_id", text_col: str = "text", whole: float = WHOLE) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row. shard: 0 to n - 1; slot: gapless from 0 in each shard."""
    if n < 1:
        raise ValueError("n must be positive")
    rows, total = prefix_sums(measured(df, id_col, text_col), ["group", "doc_id", "size"], "size", "shard")
    rows = materialize(rows, "shard-place")
    at = cuts(rows, total, n, whole)
    number = F.lit(0)  # the cuts up to the middle of the row
    for c in at:
        number = number + (2 * F.col("at") + F.col("size") >= 2 * c).cast("int")
    rows = rows.withColumn("shard", number)
    first = dict(rows.groupBy("shard").agg(F.min("row")).collect())  # n rows
    start = F.lit(0).cast("long")
    for k, row in first.items():
        start = F.when(F.col("shard") == k, F.lit(row)).otherwise(start)
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("row") - start).cast("long").alias("slot"))


def write_shards(df: DataFrame, placed_rows: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the documents in folders ``shard=k``, in slot order. Ids must be unique."""
    where = placed_rows.select(F.col("doc_id").alias("_id"), F.col("shard"), F.col("slot"))
    out = df.join(where, F.col(id_col).eqNullSafe(F.col("_id"))).drop("_id")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
