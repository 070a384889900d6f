"""Demand history, service level, revenue trends and portfolio views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.numeric import extended_value, money_sum, pct, round_half_up
from ..tables import Tables
from .inventory import trailing_sales

GRAIN_LABELS = {0: "position", 1: "product", 2: "warehouse", 3: "network"}


def demand_history(t: Tables, product_id=None, warehouse_id=None) -> DataFrame:
    """weekly demand, optionally for one product and/or one warehouse."""
    sales = t.weekly_sales
    if product_id is not None and product_id != "":
        sales = sales.where(F.col("product_id") == F.lit(product_id))
    if warehouse_id is not None and warehouse_id != "":
        sales = sales.where(F.col("warehouse_id") == F.lit(warehouse_id))
    return (
        sales.groupBy("week_start")
        .agg(F.sum("demand_units").cast("bigint").alias("demand_units"))
        .orderBy("week_start")
    )


def demand_history_all_grains(t: Tables) -> DataFrame:
    """F1 for every grain at once: network, product, warehouse and position.

    GROUPING SETS expands each row four ways before the partial aggregation, so
    one shuffle serves the four grains.
    """
    sales = t.weekly_sales.select("week_start", "product_id", "warehouse_id", "demand_units")
    grouped = sales.groupingSets(
        [
            ["week_start"],
            ["week_start", "product_id"],
            ["week_start", "warehouse_id"],
            ["week_start", "product_id", "warehouse_id"],
        ],
        "week_start",
        "product_id",
        "warehouse_id",
    ).agg(
        F.sum("demand_units").cast("bigint").alias("demand_units"),
        F.grouping_id().alias("_gid"),
    )
    # grouping_id bits follow (week_start, product_id, warehouse_id); week is always grouped.
    label = F.when(F.col("_gid") == 0, "position").when(F.col("_gid") == 1, "product").when(
        F.col("_gid") == 2, "warehouse"
    ).otherwise("network")
    return grouped.select(label.alias("grain"), "product_id", "warehouse_id", "week_start", "demand_units")


def therapy_trend(t: Tables) -> DataFrame:
    """weekly demand per therapeutic area, 4-row moving average and
    year-over-year change against the row 52 rows earlier (row-based lag)."""
    # per product and week first, so that the join meets one row per pair
    per_product = t.weekly_sales.groupBy("product_id", "week_start").agg(F.sum("demand_units").alias("demand_units"))
    weekly = (
        per_product.join(t.products.select("product_id", "therapeutic_area"), "product_id")
        .groupBy("week_start", "therapeutic_area")
        .agg(F.sum("demand_units").cast("bigint").alias("weekly_demand"))
    )
    w = Window.partitionBy("therapeutic_area").orderBy("week_start")
    prior = F.lag("weekly_demand", 52).over(w)
    moving = F.avg("weekly_demand").over(w.rowsBetween(-3, Window.currentRow))
    return (
        weekly.withColumn("_prior", prior)
        .select(
            "week_start",
            "therapeutic_area",
            "weekly_demand",
            round_half_up(moving, 1).alias("moving_average_4_week"),
            round_half_up(pct(F.col("weekly_demand") - F.col("_prior"), "_prior"), 1).alias("year_over_year_pct"),
        )
        .orderBy("week_start", "therapeutic_area")
    )


def product_service(t: Tables) -> DataFrame:
    """demand, sales, lost sales, service level and lost revenue by product.

    Sales are reduced to one row per product before the product join.
    """
    per_product = t.weekly_sales.groupBy("product_id").agg(
        F.sum("demand_units").cast("bigint").alias("demand_units"),
        F.sum("units_sold").cast("bigint").alias("units_sold"),
        F.sum("lost_sales_units").cast("bigint").alias("lost_sales_units"),
    )
    products = t.products.select("product_id", "product_name", "therapeutic_area", "unit_price")
    return (
        per_product.join(products, "product_id")
        .select(
            "product_id",
            "product_name",
            "therapeutic_area",
            "demand_units",
            "units_sold",
            "lost_sales_units",
            round_half_up(pct("units_sold", "demand_units"), 2).alias("service_level_pct"),
            extended_value("lost_sales_units", "unit_price").cast("double").alias("simulated_lost_revenue_opportunity"),
        )
        .orderBy(F.col("simulated_lost_revenue_opportunity").desc(), "product_id")
    )


def current_service(t: Tables) -> DataFrame:
    """network service level over the trailing 84 days, with its label."""
    recent = trailing_sales(t).agg(
        F.sum("demand_units").cast("bigint").alias("demand_units"),
        F.sum("units_sold").cast("bigint").alias("units_sold"),
    )
    level = round_half_up(pct("units_sold", "demand_units"), 2)
    return recent.select(
        "demand_units",
        "units_sold",
        level.alias("service_level_pct"),
        F.when(level >= rules.SERVICE_GOOD_PCT, F.lit("good")).otherwise(F.lit("watch")).alias("service_status"),
    )


def weekly_revenue(t: Tables) -> DataFrame:
    """revenue and units per week."""
    return (
        t.weekly_sales.groupBy("week_start")
        .agg(
            F.round(money_sum("revenue"), 2).cast("double").alias("revenue"),
            F.sum("units_sold").cast("bigint").alias("units_sold"),
        )
        .orderBy("week_start")
    )


def therapy_portfolio(t: Tables) -> DataFrame:
    """revenue, units and service level by therapeutic area."""
    per_product = t.weekly_sales.groupBy("product_id").agg(
        money_sum("revenue").alias("_rev"),
        F.sum("units_sold").alias("_sold"),
        F.sum("demand_units").alias("_demand"),
    )
    return (
        per_product.join(t.products.select("product_id", "therapeutic_area"), "product_id")
        .groupBy("therapeutic_area")
        .agg(
            F.round(F.sum("_rev"), 2).cast("double").alias("revenue"),
            F.sum("_sold").cast("bigint").alias("units_sold"),
            F.sum("_demand").alias("_demand_total"),
        )
        .select(
            "therapeutic_area",
            "revenue",
            "units_sold",
            round_half_up(pct("units_sold", "_demand_total"), 2).alias("service_level_pct"),
        )
        .orderBy(F.col("revenue").desc(), "therapeutic_area")
    )
