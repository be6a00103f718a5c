import os

import pytest
from pyspark.sql import functions as F

from stageflow import session as S


def test_dictionary_is_broadcast_and_refused_when_large(spark):
    rows = spark.range(50).withColumn("k", F.col("id") % 3)
    small = S.dictionary(spark.range(3).select(F.col("id").alias("k"), F.lit("x").alias("v")))
    plan = rows.join(small, "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    with pytest.raises(ValueError, match="more than 10 rows"):
        S.dictionary(spark.range(11), rows=10)


def test_release_deletes_written_tables(spark):
    keep = len(S.written(spark))
    S.materialize(spark.range(5), "gone")
    path = S.written(spark)[-1].removeprefix("file:")
    assert os.path.isdir(path)
    S.release(spark, keep)
    assert not os.path.exists(path) and len(S.written(spark)) == keep
