"""Physical plans: filters and columns reach the scan, and nothing multiplies rows or leaves the JVM needlessly."""

import pytest
from conftest import SF

from callstrata.plans import catalog

CHECKED = ["audit_summary", "temporal_profile", "completeness", "seasonal_profile", "calendar_complete", "segment_summary", "field_autodetect",
           "day_type_counts", "role_attendance", "calls_by_user", "role_attach", "feature_matrix", "sliding_rate", "escalating_block", "activity_sessions",
           "content_scan", "baseline_forecast", "demand_alerts", "system_alerts", "audit_metrics", "data_validation_alerts", "row_access_filter",
           "paginate_sessions", "clean_users", "order_check", "iqr_outliers", "numeric_quality"]


def plan(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_cross_join_and_no_python(name, spark):
    text = plan(spark, name)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"):
        assert node not in text


def test_date_range_reaches_the_scan(spark):
    text = plan(spark, "scan_date_range")
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text
    assert "o_orderpriority" not in text


def test_future_cut_reaches_the_scan(spark):
    assert "PushedFilters: [IsNotNull(ts), LessThan(ts" in plan(spark, "drop_future")


def test_only_needed_columns_are_read(spark):
    text = plan(spark, "heat_day_hour")
    assert "ReadSchema: struct<ts:timestamp_ntz>" in text


def test_gaps_are_filled_from_one_scan(spark):
    text = plan(spark, "calendar_complete")
    assert text.count("FileScan parquet") == 1 and "Join" not in text


def test_audit_profiles_scan_once(spark):
    for name in ("temporal_profile", "seasonal_profile", "completeness", "value_counts", "peak_valley", "kpi_cards"):
        assert plan(spark, name).count("FileScan parquet") == 1, name
