"""Executive and page-level KPI strips, urgency ranking and order allocation.

Every KPI strip is a one-row aggregate; the executive view is four one-row
aggregates (sales, positions, batches, suppliers) cross-joined, so each input
is scanned once instead of once per scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.numeric import round_half_up, safe_divide
from ..tables import Tables
from .expiry import expiry_risk
from .inventory import coverage_ratio, inventory_health, replenishment_recommendations
from .suppliers import supplier_performance


def _decimal_mean(c: str, scale: int):
    """avg of a rounded metric, exact: Σ as decimal / count (NULLs skipped)."""
    return safe_divide(F.sum(F.col(c).cast(f"decimal(18,{scale})")), F.count(c))


def executive_kpis(t: Tables) -> DataFrame:
    """F8: the 11-column executive row."""
    sales = t.weekly_sales.agg(
        F.round(F.sum(F.col("revenue").cast("decimal(18,2)")), 2).cast("double").alias("total_revenue"),
        F.sum("units_sold").cast("bigint").alias("units_sold"),
    )
    health = inventory_health(t).agg(
        F.round(F.sum(F.col("inventory_value").cast("decimal(18,2)")), 2).cast("double").alias("inventory_value"),
        F.count(F.when(F.col("stockout_risk") == rules.CRITICAL, 1)).alias("critical_stockout_skus"),
        round_half_up(coverage_ratio(F.col("inventory_quantity"), F.col("avg_weekly_demand")), 2).alias(
            "network_weeks_of_supply"
        ),
        F.count(F.when(F.col("replenishment_flag") == 1, 1)).alias("replenishment_flags"),
    )
    b = F.col("expiry_bucket")
    within90 = b.isin(rules.EXPIRED, rules.D90)
    within180 = b.isin(rules.EXPIRED, rules.D90, rules.D180)
    expiry = expiry_risk(t).agg(
        F.sum(F.when(within90, F.col("inventory_quantity"))).cast("bigint").alias("units_expiring_90_days"),
        F.sum(F.when(within180, F.col("inventory_quantity"))).cast("bigint").alias("units_expiring_180_days"),
        F.round(F.sum(F.when(within180, F.col("inventory_value_at_risk").cast("decimal(18,2)"))), 2)
        .cast("double")
        .alias("expiry_value_at_risk_180_days"),
    )
    suppliers = supplier_performance(t).agg(
        round_half_up(_decimal_mean("on_time_delivery_pct", 1), 1).alias("supplier_on_time_delivery_pct"),
        round_half_up(_decimal_mean("acceptance_quality_pct", 1), 1).alias("supplier_acceptance_quality_pct"),
    )
    # Four one-row relations: the cross joins are bounded by construction.
    return (
        sales.crossJoin(F.broadcast(health))
        .crossJoin(F.broadcast(expiry))
        .crossJoin(F.broadcast(suppliers))
        .select(
            "total_revenue",
            "units_sold",
            "inventory_value",
            "critical_stockout_skus",
            "network_weeks_of_supply",
            "replenishment_flags",
            "units_expiring_90_days",
            "units_expiring_180_days",
            "expiry_value_at_risk_180_days",
            "supplier_on_time_delivery_pct",
            "supplier_acceptance_quality_pct",
        )
    )


def urgent_positions(t: Tables, per_warehouse: int = 10) -> DataFrame:
    """the ``per_warehouse`` most urgent positions of each warehouse.

    Tier rank, then coverage ascending with NULL first, then product id.
    ``row_number() <= k`` plans as WindowGroupLimit: each map task keeps k rows
    per warehouse before the shuffle, so the few warehouses never concentrate
    all positions in one task.
    """
    health = inventory_health(t)
    w = Window.partitionBy("warehouse_id").orderBy(
        rules.tier_rank("stockout_risk"), F.col("weeks_of_supply").asc_nulls_first(), F.col("product_id")
    )
    return (
        health.select(
            "product_id",
            "product_name",
            "therapeutic_area",
            "warehouse_id",
            "warehouse_name",
            "inventory_quantity",
            "weeks_of_supply",
            "stockout_risk",
            "recommended_order_quantity",
            F.row_number().over(w).alias("warehouse_risk_rank"),
        )
        .where(F.col("warehouse_risk_rank") <= per_warehouse)
        .orderBy("warehouse_name", "warehouse_id", "warehouse_risk_rank")
    )


def risk_mix(t: Tables, warehouse_id=None, therapeutic_area=None) -> DataFrame:
    """positions per stockout tier in scope."""
    from .inventory import filtered_health

    health = filtered_health(inventory_health(t), warehouse_id, therapeutic_area)
    return health.groupBy("stockout_risk").agg(F.count(F.lit(1)).alias("positions"))


def inventory_scope_kpis(t: Tables, warehouse_id=None, therapeutic_area=None) -> DataFrame:
    """positions, critical count, flags and weighted coverage in scope."""
    from .inventory import filtered_health

    health = filtered_health(inventory_health(t), warehouse_id, therapeutic_area)
    return health.agg(
        F.count(F.lit(1)).alias("positions"),
        F.count(F.when(F.col("stockout_risk") == rules.CRITICAL, 1)).alias("critical_positions"),
        F.coalesce(F.sum("replenishment_flag"), F.lit(0)).cast("bigint").alias("replenishment_flags"),
        coverage_ratio(F.col("inventory_quantity"), F.col("avg_weekly_demand")).alias("weighted_coverage_weeks"),
    )


def order_allocation(t: Tables, warehouse_id=None) -> DataFrame:
    """recommended units and value by warehouse."""
    rec = replenishment_recommendations(t, warehouse_id)
    return (
        rec.groupBy("warehouse_id", "warehouse_name")
        .agg(
            F.sum("recommended_order_quantity").cast("bigint").alias("recommended_units"),
            F.round(F.sum(F.col("estimated_order_value").cast("decimal(18,2)")), 2)
            .cast("double")
            .alias("estimated_order_value"),
        )
        .orderBy("estimated_order_value", "warehouse_id")
    )


def replenishment_kpis(t: Tables, warehouse_id=None) -> DataFrame:
    """order count, units, purchase value and critical orders."""
    rec = replenishment_recommendations(t, warehouse_id)
    return rec.agg(
        F.count(F.lit(1)).alias("recommended_orders"),
        F.coalesce(F.sum("recommended_order_quantity"), F.lit(0)).cast("bigint").alias("recommended_units"),
        F.coalesce(F.round(F.sum(F.col("estimated_order_value").cast("decimal(18,2)")), 2), F.lit(0).cast("decimal(18,2)"))
        .cast("double")
        .alias("purchase_value"),
        F.count(F.when(F.col("stockout_risk") == rules.CRITICAL, 1)).alias("critical_orders"),
    )
