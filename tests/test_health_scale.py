"""The shared step of stage health: few shuffles by entity, narrow ordered scans, and the same rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from stageflow.operators import scoring as SCO
from stageflow.plans import REGISTRY
from stageflow.session import configure, written
from stageflow.sources.tables import Data


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Repeated rows, two outcomes of an entity, one that is null, an entity without an outcome and one without a time."""
    out = str(tmp_path_factory.mktemp("odd"))
    day = lambda n: None if n is None else datetime.date(1995, 1, 1) + datetime.timedelta(n)
    lines = [(1, 1, 3), (1, 2, 4), (1, 2, 5), (1, 7, 9), (2, 1, 3), (2, 7, 8), (3, 2, 6), (4, 1, None), (5, 1, 2), (5, 7, 3), (5, 2, 4), (2, 1, 3)]
    rows = [(e, s, day(t), float(e + s), 10.0 * e, 0.0 if s == 2 else 0.05, 0.01, "R") for e, s, t in lines]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_shipdate date, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string").write.parquet(f"{out}/lineitem.parquet")
    spark.createDataFrame([(1, "F"), (2, "F"), (2, "O"), (3, None), (5, "F"), (5, "F")], "o_orderkey long, o_orderstatus string").write.parquet(f"{out}/orders.parquet")
    return out


def _rows(df):
    return sorted(map(repr, df.withColumns({c: F.to_json(c) for c, t in df.dtypes if t.startswith("map")}).collect()))


def _shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_messages_need_one_shuffle_of_the_rows(spark, odd):
    """Outcomes are so few here that they are broadcast."""
    assert _shuffles(Data(spark, odd).messages) == 1


def test_visits_and_messages_read_from_the_written_ones_are_the_same(spark, odd):
    plain, stored = Data(spark, odd), Data(spark, odd)
    lived = stored.lived_messages
    for name in ("visits", "messages"):
        a, b = getattr(plain, name), getattr(stored, name)
        assert a.dtypes == b.dtypes and _rows(a) == _rows(b), name
    assert lived.count() == plain.messages.count() == 14


def test_a_life_tells_its_exit(spark):
    rows = [(1, 1, 1, 5, False, None), (1, 7, 6, 9, True, 1), (1, 2, 2, 12, False, None), (2, 7, 6, 4, True, None), (2, 1, 1, 4, False, None)]
    m = spark.createDataFrame(rows, "entity long, stage int, stage_rank int, t long, is_exit boolean, response int")
    got = {(r.entity, r.stage): (r.life, r.exit_t, r.exit_label) for r in SCO.lives(m).collect()}
    assert got == {(1, 1): (0, 9, 1), (1, 7): (0, 9, 1), (1, 2): (1, None, None), (2, 1): (0, 4, 0), (2, 7): (0, 4, 0)}


def test_health_writes_one_wide_table_and_line_scans_read_steps_once(spark, data):
    before = len(written(spark))
    d = Data(spark, data.sf_dir)
    from stageflow.plans.scoring import health

    SCO.line_overview(health(d), 24.0)
    names = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in written(spark)[before:]]
    assert sorted(names) == ["baselines", "benchmark", "changes", "flow", "numbered", "outcomes", "overview", "steps", "topology"]
    numbered = spark.read.parquet(next(p for p in written(spark)[before:] if "/numbered-" in p))
    assert {"features", "anomalous", "transit_minutes", "max_abs_z"}.isdisjoint(numbered.columns)


def test_outcomes_that_many_visits_share_are_not_a_join_key(spark):
    """1000 visits after the same outcome once met in one group of a join on the outcome's number."""
    times = [(0, 1, 1), (0, 1, 0), (0, 1, 1)] + [(2, None, None)] * 1000 + [(3, 3, 1), (4, None, None)]
    rows = [(e, 0, 1, t, e, x, None if x is None else e, y, e + 1) for e, (t, x, y) in enumerate(times)]
    schema = "entity long, life long, stage int, t long, tie long, exit_t long, exit_tie long, exit_label int, visit_no long"
    before = len(written(spark))
    out = SCO.rolling_outcomes(spark.createDataFrame(rows, schema), 2, 0.25)
    assert [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in written(spark)[before:]] == ["outcomes", "changes"]
    assert {r.entity: r.observed_rate for r in out.collect()} == {e: 0.25 if e < 3 else 0.5 if e < 1004 else 1.0 for e in range(1005)}


def test_a_repeated_message_keeps_its_own_drift(spark):
    """Two outcomes of an entity double its messages: each is scored with its own visit number, once for the rate of each."""
    rows = [(1, 1, 1, 0, 0.0, {"f": z}, True, False, None, None) for z in (0.1, 0.3)] + [(2, 1, 1, 1, 0.0, {"f": 0.2}, True, False, None, None)]
    m = spark.createDataFrame(
        rows, "entity long, stage int, stage_rank int, t long, transit_minutes double, features map<string,double>, is_entry boolean, is_exit boolean, response int, prev_stage int"
    )
    base = spark.createDataFrame([(1, "f", 0.0, 0.1)], "stage int, feature string, mean double, std double")
    bench = spark.createDataFrame([(1, 2, 6.0, 36.0)], "prev_stage int, stage int, p90 double, p99 double")
    got = SCO.stage_health(m, base, bench, spark.createDataFrame([(1, None)], "stage int, static_prev int")).collect()
    first = [(r.visit_no, round(r.max_abs_z, 6)) for r in got if r.entity == 1]
    assert len(first) == 4 and len(set(first)) == 2 and {v for v, _ in first} == {1, 2}


def test_folds_count_entities_where_their_visits_are(spark, odd):
    assert _shuffles(REGISTRY["ml3_forward_chaining_folds"].run(spark, odd)) == 2


def test_shuffled_partitions_stay_small(spark):
    configure(spark)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"


def _nulls_as_missing(df, columns):
    return df.withColumn("features", F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*columns)), lambda _, v: v.isNotNull()))


def test_readings_in_columns_score_as_those_in_the_map(spark):
    rows = [(1, 1, 0.5, 9.0), (2, 1, None, -9.0), (3, 1, None, None), (4, 2, 5.0, float("nan")), (5, 3, 1.0, 1.0), (6, None, 1.0, 2.0)]
    m = _nulls_as_missing(spark.createDataFrame(rows, "entity long, stage int, a double, b double"), ("a", "b"))
    base = spark.createDataFrame([(1, "a", 0.0, 0.1), (1, "b", 0.0, 2.0), (2, "b", 1.0, 1.0), (3, "a", None, 1.0), (3, "b", 1.0, None)], "stage int, feature string, mean double, std double")
    names = ("entity", "n_features", "max_abs_z", "anomalous", "zs")
    got, want = (sorted(map(repr, SCO.deviations(m, base, sensors=s).select(*names).collect())) for s in (("a", "b"), ()))
    assert got == want and "a" in SCO.deviations(m, base, sensors=("a", "b")).columns


@pytest.mark.parametrize("last", [1, 2, 3, 50])
def test_throughput_reads_the_first_exit_of_its_frame(spark, last):
    times = [(e, t) for e, t in enumerate([0, 0, 1, 5, 5, 5, 9, 20, 21, 21])]
    got = {r.entity: r.rolling_throughput_per_hr for r in SCO.rolling_throughput(spark.createDataFrame(times, "entity long, t long"), 0.7, last).collect()}
    want = {}
    for e, t in times:
        frame = [x for _, x in times[max(0, e + 1 - last):e + 1]]
        want[e] = round(len(frame) / ((t - frame[0]) * 0.7), 1) if len(frame) >= 2 and t > frame[0] else 0.0
    assert got == want
    frames = SCO.rolling_throughput(spark.createDataFrame(times, "entity long, t long"), 0.7, last)._jdf.queryExecution().optimizedPlan().toString()
    assert "min(t" not in frames


def test_outcomes_are_numbered_by_a_window(spark, odd):
    """A list of an entity's outcomes fell back to a second sort; the messages keep the readings as columns."""
    lived = Data(spark, odd).lived_messages
    assert {"qty", "price", "disc", "tax", "features"} <= set(lived.columns) and lived.where("entity = 2").count() == 4
