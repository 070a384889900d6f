"""SQL access over temp views, named parameters and input contracts."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

from fixtures import tiny_tables
from stockline.functions.contracts import check_contract, require_columns, require_views
from stockline.plans import views
from stockline.sources.schemas import SCHEMAS


def test_parameterised_query_over_views(spark):
    t = tiny_tables(spark)
    names = views.register_views(t, prefix="fx_")
    require_views(names, ["fx_v_inventory_health", "fx_weekly_sales"])
    rows = views.query(
        spark,
        "SELECT product_id, stockout_risk FROM fx_v_inventory_health WHERE warehouse_id = :wh ORDER BY product_id",
        {"wh": "W1"},
    ).collect()
    assert [(r.product_id, r.stockout_risk) for r in rows] == [("P1", "Watch")]
    assert views.query(spark, "SELECT count(*) AS n FROM fx_weekly_sales").first().n == 26
    kpi = views.query(spark, "SELECT * FROM fx_v_executive_kpis").collect()
    assert len(kpi) == 1 and kpi[0].total_revenue > 0


def test_missing_columns_message(spark):
    df = spark.createDataFrame([(1,)], "status long")
    with pytest.raises(ValueError, match="Missing columns: accepted_quantity, ordered_quantity"):
        require_columns(df, ["status", "ordered_quantity", "accepted_quantity"])
    with pytest.raises(ValueError, match="Missing required objects: v_expiry_risk"):
        require_views(["v_inventory_health"], ["v_inventory_health", "v_expiry_risk"])


def test_contract_reports_type_drift(spark):
    t = tiny_tables(spark)
    assert check_contract(t.products, SCHEMAS["products"]) == []
    drifted = t.products.withColumn("unit_cost", t.products.unit_cost.cast("string")).drop("strength")
    problems = check_contract(drifted, SCHEMAS["products"])
    assert "missing column strength" in problems
    assert any(p.startswith("column unit_cost: expected double") for p in problems)


def test_integral_ids_stand_in_for_strings_only_where_asked():
    class Frame:
        schema = T.StructType([T.StructField("product_id", T.LongType()), T.StructField("unit_cost", T.LongType())])

    declared = T.StructType([T.StructField("product_id", T.StringType()), T.StructField("unit_cost", T.DoubleType())])
    assert len(check_contract(Frame, declared)) == 2
    assert check_contract(Frame, declared, integral_ids=True) == ["column unit_cost: expected double, got bigint"]


def test_views_without_a_column_that_pages_read_are_refused(spark):
    t = tiny_tables(spark)
    built = {name: build(t) for name, build in views.VIEWS.items()}
    views.check_view_columns(built)
    with pytest.raises(ValueError, match="Missing columns: on_order_quantity"):
        views.check_view_columns(built | {"v_inventory_health": built["v_inventory_health"].drop("on_order_quantity")})
    with pytest.raises(ValueError, match="Missing required objects: v_expiry_risk"):
        views.check_view_columns({k: v for k, v in built.items() if k != "v_expiry_risk"})
