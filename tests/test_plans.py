"""Physical-plan properties the operators rely on at scale (read from explain())."""

from __future__ import annotations

import re
import tempfile

import pytest

from stockline.operators import forecast
from stockline.plans.catalog import SPARK_QUERIES
from stockline.sources import files, mart


@pytest.fixture(scope="module")
def snapshot(spark, sf_dir):
    lazy = mart.build_tables(spark, sf_dir)
    return files.read_published(spark, files.write_tables(lazy, tempfile.mkdtemp(prefix="stockline-plan-")), lazy.as_of)


def plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.mark.parametrize("key", ["urgent_positions", "last_n_mean_demand"])
def test_top_k_per_group_is_limited_before_the_shuffle(snapshot, capsys, key):
    text = plan(SPARK_QUERIES[key](snapshot), capsys)
    assert "WindowGroupLimit" in text and "Partial" in text


def test_top_k_report_uses_take_ordered(snapshot, capsys):
    assert "TakeOrderedAndProject" in plan(SPARK_QUERIES["top_at_risk"](snapshot), capsys)


def test_trailing_window_prunes_month_partitions(snapshot, capsys):
    text = plan(SPARK_QUERIES["recent_demand"](snapshot), capsys)
    assert re.search(r"PartitionFilters: \[[^\]]*sales_month", text)


def test_scans_read_only_needed_columns(snapshot, capsys):
    text = plan(SPARK_QUERIES["stock_position"](snapshot), capsys)
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", text).group(1)
    assert "batch_number" not in schema and "manufacture_date" not in schema


def test_supplier_ranking_windows_run_over_counts_only(snapshot, capsys):
    text = plan(SPARK_QUERIES["supplier_ranking"](snapshot), capsys)
    # unpartitioned windows: over the partitions' row counts and over the distinct scores
    specs = re.findall(r"windowspecdefinition\(([^)]*)\)", text)
    assert specs and all("_part" in x or "_value" in x for x in specs)
    assert "/numbered-" in text or "numbered" in text


def test_position_aggregates_are_partial_before_exchange(snapshot, capsys):
    text = plan(SPARK_QUERIES["inventory_health"](snapshot), capsys)
    assert text.count("partial_sum") >= 2


@pytest.mark.parametrize("key", ["expiry_risk_near", "fefo_queue", "expiry_kpis", "top_at_risk"])
def test_expiry_cut_reaches_the_scan(snapshot, capsys, key):
    text = plan(SPARK_QUERIES[key](snapshot), capsys)
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(expiry_date", text)


@pytest.mark.parametrize("key", ["reorder_point", "weeks_of_supply", "order_quantity_gross"])
def test_policy_queries_aggregate_trailing_demand_once(snapshot, capsys, key):
    text = plan(SPARK_QUERIES[key](snapshot), capsys)
    assert len(re.findall(r"ReadSchema: struct<[^>]*demand_units", text)) == 1


def test_trend_joins_products_after_aggregating(snapshot, capsys):
    text = plan(SPARK_QUERIES["therapy_trend"](snapshot), capsys)
    assert text.index("partial_sum") < text.index("therapeutic_area")


def test_forecast_outputs_read_the_written_fit_not_the_input(snapshot, capsys):
    # KPIs combine future, metrics and the index: after the fit is written,
    # the final plan neither scans weekly_sales nor runs the solve again.
    text = plan(SPARK_QUERIES["forecast_kpis"](snapshot), capsys)
    assert "weekly_sales" not in text
    assert "MapInPandas" not in text and "MapInArrow" not in text
    assert "Window" not in text


def test_forecasts_run_no_job_until_materialized(snapshot, capsys):
    result = forecast.forecast_tables(snapshot, ("dosage_form", "warehouse_id"))
    text = plan(forecast.recent_history(result, result.keys), capsys)
    assert "weekly_sales" in text and "MapInPandas" not in text
    assert "weekly_sales" in plan(result.metrics, capsys)  # planned, not run
    result.materialize()
    assert "weekly_sales" not in plan(result.metrics, capsys)
    assert "MapInPandas" not in plan(result.future, capsys)


def test_queries_share_one_fit(snapshot):
    one, two = (SPARK_QUERIES[k](snapshot) for k in ("forecast_future", "residual_band"))
    assert set(two.inputFiles()) <= set(one.inputFiles())


def test_quality_summary_scans_each_fact_three_times_at_most(snapshot, capsys):
    text = plan(SPARK_QUERIES["dq_summary"](snapshot), capsys)
    for table, most in (("weekly_sales", 3), ("inventory_batches", 3), ("purchase_orders", 2)):
        assert 0 < len(re.findall(rf"Location: [^\n]*/{table}\]", text)) <= most, table
