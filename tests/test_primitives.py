import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stageflow.operators import primitives as P


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows share one key and one tick."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5).cast("int").alias("key"),
        F.when(F.col("id") % 3 == 0, 500).otherwise((F.col("id") * 37) % 900 - 50).cast("long").alias("t"),
        F.col("id").alias("tie"), (F.col("id") % 11).alias("v"),
    )
    return df.repartition(5, "tie")


@pytest.mark.parametrize("levels,width", [(0, 64), (1, 64), (3, 4)])
@pytest.mark.parametrize("keys", [(), ("key",)])
def test_running_equals_window(rows, levels, width, keys):
    got = P.running(rows, "t", {"n": ("sum", F.lit(1)), "hi": ("max", F.col("v"))}, keys, width=width, levels=levels)
    at = rows.groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("hi"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("t")
    b = w.rowsBetween(Window.unboundedPreceding, -1)
    want = at.select(
        *keys, "t", F.sum("n").over(w).alias("cn"), F.coalesce(F.sum("n").over(b), F.lit(0)).alias("bn"), F.max("hi").over(w).alias("ch"), F.max("hi").over(b).alias("bh")
    )
    cols = [*keys, "t", "cum_n", "before_n", "cum_hi", "before_hi"]
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("levels", [0, 2])
def test_rank_equals_row_number(rows, levels):
    got = P.ranked(rows, "t", "tie", ("key",), levels=levels, width=16, tie_width=128)
    bad = got.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("t", "tie"))).where("rn <> rank")
    assert bad.count() == 0 and got.count() == 3000


def test_trailing_equals_window(rows):
    ranked = P.ranked(rows, "t", "tie", ("key",))
    got = P.trailing(ranked, "rank", 7, {"s": lambda w: F.sum("v").over(w), "c": lambda w: F.count("v").over(w)}, ("key",), block=16)
    w = Window.partitionBy("key").orderBy("rank").rowsBetween(-6, 0)
    bad = got.withColumn("s2", F.sum("v").over(w)).withColumn("c2", F.count("v").over(w)).where("s <> s2 OR c <> c2")
    assert bad.count() == 0 and got.count() == 3000


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=300), [0.0] * 100, rng.exponential(size=101) * 1e-6, [-5.0, 7e9]])
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(3)
    points = (0.0, 0.1, 0.5, 0.9, 0.998, 1.0)
    got = {r["point"]: r["quantile"] for r in P.quantiles(df, "x", points).collect()}
    for p in points:
        assert got[p] == pytest.approx(np.percentile(values, p * 100), rel=1e-12, abs=1e-15)


def test_double_code_is_monotone(spark):
    xs = sorted([0.0, -0.0, 1e-300, 5e-9, 0.1, 0.1000000001, 1.0, 1e12, -1e-300, -0.5, -0.50001, -1e9])
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(P.double_code(F.col("x"))).collect()]
    assert got == sorted(got)


def test_previous_position_and_islands(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (5,), (6,), (9,)], "t long")
    prev = {r["t"]: (r["n"], r["prev"]) for r in P.previous_position(df, "t", width=2, levels=1).collect()}
    assert prev == {1: (1, None), 2: (2, 1), 5: (1, 2), 6: (1, 5), 9: (1, 6)}
    isl = P.islands(df.distinct(), "t").groupBy("island").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    assert sorted((r["a"], r["b"]) for r in isl.collect()) == [(1, 2), (5, 6), (9, 9)]


def test_cumulative_at_is_closed_on_the_right(spark):
    ev = spark.createDataFrame([(1,), (3,), (3,), (8,)], "t long")
    pr = spark.createDataFrame([(0,), (3,), (7,), (8,)], "t long")
    got = {r["t"]: r["cum_n"] for r in P.cumulative_at(ev, "t", {"n": F.lit(1)}, pr).collect()}
    assert got == {0: 0, 3: 3, 7: 3, 8: 4}
