"""A cross-section of the registered queries against DuckDB; tests/check_oracle.py runs all of them."""

import pytest

from stageflow.plans import REGISTRY
from tests.check_oracle import compare, connect
from tests.conftest import SMALL

QUICK = """agg5_visits agg5_visits_from_wide agg6_entity_span agg7_stage_durations agg10_route_ranking agg13_pattern_coverage agg14_arrival_summary
agg17_line_period_crosstab agg24_segment_transits src5_parquet_pushdown src10_json_decode snk1_parquet_write agg1_column_profile agg22_quality_by_period
agg27_stage_drift agg32_cohort_comparison jn8_range_count jn9_recent_rate jn10_sliding_grid jn11_interval_table_mask jn13_predecessor prj2_topic_parse
prj10_pacing_subscore prj21_binomial_tail stat2_bh_adjustment stat3_autocorrelation stat7_scenario_slice win4_rolling_drift win5_rolling_outcomes
win8_line_totals win10_last_deviations ml1_entity_training_table ml4_leave_window_out met1_roc_auc met4_threshold_search met5_recall_at_top
mon5_sensor_series alr2_stage_idle str1_entity_state str3_tumbling_windows""".split()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", QUICK)
def test_matches_sql(spark, duck, name):
    q = REGISTRY[name]
    got = q.run(spark, SMALL).toPandas()
    assert compare(got, duck.execute(q.sql).df()) is None


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 150


def test_no_cross_product_in_plans(spark):
    for name in ("agg10_route_ranking", "jn10_sliding_grid", "ml4_leave_window_out", "stat7_scenario_slice", "jn11_interval_mask"):
        plan = REGISTRY[name].run(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_scan_is_pushed_down(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = REGISTRY["src5_parquet_pushdown"].run(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "In(l_linenumber" in plan
    assert "l_comment" not in plan and "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_shipdate" in plan
