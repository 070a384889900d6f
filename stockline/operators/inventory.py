"""Inventory health, replenishment and warehouse roll-ups.

Plan shape at scale: the three facts are each aggregated to the
(product_id, warehouse_id) grain with map-side partial aggregation, so a hot
position never reaches one reducer as raw rows.  The three aggregates share
their hash partitioning, so the joins between them need no further exchange;
products and warehouses are joined once per position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.contracts import require_columns
from ..functions.numeric import extended_value, round_half_up, safe_divide, to_double
from ..tables import Tables

POSITION = ["product_id", "warehouse_id"]


def latest_week(t: Tables) -> Column:
    """MAX(week_start) of the sales table as a scalar subquery (one row).

    On a published snapshot the latest month comes first, from the partition
    column alone (no data column is read), so weeks are scanned in that month only.
    """
    sales = t.weekly_sales
    if "sales_month" in sales.columns:
        sales = sales.where(F.col("sales_month") == sales.select(F.max("sales_month")).scalar())
    return sales.select(F.max("week_start")).scalar()


def trailing_sales(t: Tables, window_days: int = rules.DEMAND_WINDOW_DAYS) -> DataFrame:
    """Sales rows with week_start > latest week - window (12 Mondays for 84 days).

    On a published snapshot (partitioned by ``sales_month``) the same cutoff is
    also stated on the partition column; Spark evaluates the scalar subquery
    first and then lists only the last few month partitions.
    """
    cutoff = F.date_sub(latest_week(t), window_days)
    recent = F.col("week_start") > cutoff
    if "sales_month" in t.weekly_sales.columns:
        recent = recent & (F.col("sales_month") >= F.trunc(cutoff, "month"))
    return t.weekly_sales.where(recent)


def recent_demand(t: Tables, window_days: int = rules.DEMAND_WINDOW_DAYS) -> DataFrame:
    """Average and total demand per position over the trailing window.

    The average is over the weeks present, not over 12.
    """
    return trailing_sales(t, window_days).groupBy(*POSITION).agg(
        F.avg("demand_units").alias("avg_weekly_demand"),
        F.sum("demand_units").cast("bigint").alias("demand_last_12_weeks"),
    )


def stock_position(t: Tables) -> DataFrame:
    """Usable and expired units per position and the position policy values."""
    usable = F.col("expiry_date") >= F.lit(t.as_of)
    expired = F.col("expiry_date") < F.lit(t.as_of)
    qty = F.col("inventory_quantity")
    return t.inventory_batches.groupBy(*POSITION).agg(
        F.sum(F.when(usable, qty).otherwise(0)).cast("bigint").alias("inventory_quantity"),
        F.sum(F.when(expired, qty).otherwise(0)).cast("bigint").alias("expired_inventory_quantity"),
        F.max("reorder_point").cast("bigint").alias("reorder_point"),
        F.max("safety_stock").cast("bigint").alias("safety_stock"),
    )


def open_on_order(t: Tables) -> DataFrame:
    """C4: units still to arrive on Open purchase orders, per position."""
    return (
        t.purchase_orders.where(F.col("status") == "Open")
        .groupBy(*POSITION)
        .agg(F.sum(F.col("ordered_quantity") - F.col("received_quantity")).cast("bigint").alias("on_order_quantity"))
    )


def _positions(t: Tables) -> DataFrame:
    """Every position with a batch: stock, unrounded demand, open orders and dimensions."""
    stock = stock_position(t)
    demand = recent_demand(t)
    on_order = open_on_order(t)
    products = t.products.select(
        "product_id", "product_name", "therapeutic_area", "unit_cost", "unit_price", "lead_time_days"
    )
    warehouses = t.warehouses.select("warehouse_id", "warehouse_name", "region")

    return (
        stock.join(demand, POSITION, "left")
        .join(on_order, POSITION, "left")
        .join(products, "product_id")
        .join(warehouses, "warehouse_id")
    )


def inventory_health(t: Tables) -> DataFrame:
    """One row per position that has at least one batch (21 columns)."""
    joined = _positions(t)
    inv = F.col("inventory_quantity")
    avg = F.coalesce(F.col("avg_weekly_demand"), F.lit(0.0))
    on_order_qty = F.coalesce(F.col("on_order_quantity"), F.lit(0).cast("bigint"))
    position = inv + on_order_qty
    coverage = F.when(avg > 0, inv / avg)
    lead_weeks = F.col("lead_time_days").cast("double") / F.lit(7.0)
    recommended = F.greatest(
        F.lit(0).cast("bigint"),
        F.round(avg * (lead_weeks + F.lit(float(rules.REVIEW_PERIOD_WEEKS))) + F.col("safety_stock") - inv - on_order_qty).cast("bigint"),
    )
    return joined.select(
        "product_id",
        "product_name",
        "therapeutic_area",
        "warehouse_id",
        "warehouse_name",
        "region",
        inv.alias("inventory_quantity"),
        "expired_inventory_quantity",
        on_order_qty.alias("on_order_quantity"),
        position.alias("inventory_position"),
        "reorder_point",
        "safety_stock",
        round_half_up(avg, 2).alias("avg_weekly_demand"),
        round_half_up(coverage, 2).alias("weeks_of_supply"),
        rules.stockout_tier(inv, "safety_stock", "reorder_point", coverage).alias("stockout_risk"),
        F.when(position <= F.col("reorder_point"), 1).otherwise(0).alias("replenishment_flag"),
        recommended.alias("recommended_order_quantity"),
        extended_value(inv, "unit_cost").cast("double").alias("inventory_value"),
        "unit_cost",
        "unit_price",
        "lead_time_days",
    )


def filtered_health(health: DataFrame, warehouse_id=None, therapeutic_area=None) -> DataFrame:
    """Equality filters applied only when the argument is given and not empty."""
    if warehouse_id is not None and warehouse_id != "":
        health = health.where(F.col("warehouse_id") == F.lit(warehouse_id))
    if therapeutic_area:
        health = health.where(F.col("therapeutic_area") == F.lit(therapeutic_area))
    return health


def inventory_health_report(t: Tables, warehouse_id=None, therapeutic_area=None) -> DataFrame:
    """C17: filtered positions, flagged first, lowest coverage first (NULL first)."""
    return filtered_health(inventory_health(t), warehouse_id, therapeutic_area).orderBy(
        F.col("replenishment_flag").desc(),
        F.col("weeks_of_supply").asc_nulls_first(),
        "product_id",
        "warehouse_id",
    )


def replenishment_recommendations(t: Tables, warehouse_id=None) -> DataFrame:
    """Positions with a positive recommended order and its value."""
    health = filtered_health(inventory_health(t), warehouse_id)
    return (
        health.where(F.col("recommended_order_quantity") > 0)
        .withColumn(
            "estimated_order_value",
            extended_value("recommended_order_quantity", "unit_cost").cast("double"),
        )
        .orderBy(
            rules.tier_rank("stockout_risk"),
            F.col("weeks_of_supply").asc_nulls_last(),
            "product_id",
            "warehouse_id",
        )
    )


def coverage_ratio(units: Column, rounded_avg: Column) -> Column:
    """Σ units / Σ rounded average demand, NULL when the demand sum is 0."""
    total_avg = F.sum(rounded_avg.cast("decimal(18,2)")).cast("double")
    return safe_divide(F.sum(units).cast("double"), total_avg)


def warehouse_summary(t: Tables) -> DataFrame:
    """Value, units, critical count, flags and coverage by warehouse."""
    health = inventory_health(t)
    return (
        health.groupBy("warehouse_id", "warehouse_name", "region")
        .agg(
            F.round(F.sum(F.col("inventory_value").cast("decimal(18,2)")), 2).cast("double").alias("inventory_value"),
            F.sum("inventory_quantity").cast("bigint").alias("inventory_units"),
            F.sum(F.when(F.col("stockout_risk") == rules.CRITICAL, 1).otherwise(0)).cast("bigint").alias("critical_skus"),
            F.sum("replenishment_flag").cast("bigint").alias("replenishment_flags"),
            round_half_up(coverage_ratio(F.col("inventory_quantity"), F.col("avg_weekly_demand")), 2).alias(
                "weeks_of_supply"
            ),
        )
        .orderBy(F.col("inventory_value").desc(), "warehouse_id")
    )


def last_n_mean_demand(t: Tables, n: int = 12) -> DataFrame:
    """C20: mean demand of the last ``n`` rows per position (rows, not dates).

    ``row_number() <= n`` becomes a WindowGroupLimit, so each map task keeps
    only ``n`` rows per position before the shuffle.
    """
    w = Window.partitionBy(*POSITION).orderBy(F.col("week_start").desc())
    return (
        t.weekly_sales.select(*POSITION, "week_start", "demand_units")
        .withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= n)
        .groupBy(*POSITION)
        .agg(F.avg("demand_units").alias("avg_weekly_demand"), F.count(F.lit(1)).alias("weeks_used"))
    )


def position_demand_stats(t: Tables) -> DataFrame:
    """Per position: weeks observed, sample stddev and mean of weekly demand."""
    require_columns(t.weekly_sales, [*POSITION, "demand_units"])
    return t.weekly_sales.groupBy(*POSITION).agg(
        F.count(to_double("demand_units")).alias("observations"),
        # non-numeric input becomes NULL and is skipped (coercion, ANSI-safe)
        F.stddev_samp(to_double("demand_units")).alias("demand_stddev"),
        F.avg(to_double("demand_units")).alias("avg_weekly_demand"),
    )


def safety_stock_by_position(t: Tables, z: float = rules.SERVICE_Z) -> DataFrame:
    """C12 for every position: NULL safety stock plus a reason for invalid groups."""
    stats = position_demand_stats(t).join(t.products.select("product_id", "lead_time_days"), "product_id")
    lead_weeks = F.col("lead_time_days") / F.lit(7.0)
    return stats.select(
        *POSITION,
        "observations",
        round_half_up(lead_weeks, 4).alias("lead_time_weeks"),
        rules.safety_stock("demand_stddev", "observations", lead_weeks, z).alias("safety_stock"),
        rules.safety_stock_reject_reason("observations", lead_weeks).alias("reject_reason"),
    )


def _policy_inputs(t: Tables) -> DataFrame:
    return _positions(t).select(
        *POSITION,
        "inventory_quantity",
        "safety_stock",
        "lead_time_days",
        F.coalesce("avg_weekly_demand", F.lit(0.0)).alias("avg_weekly_demand"),
    )


def reorder_points(t: Tables) -> DataFrame:
    """ceil(avg demand * lead weeks + safety stock) per position."""
    base = _policy_inputs(t)
    lead_weeks = F.col("lead_time_days") / F.lit(7.0)
    return base.select(*POSITION, rules.reorder_point("avg_weekly_demand", lead_weeks, "safety_stock").alias("reorder_point"))


def weeks_of_supply(t: Tables, zero_demand: str = "null") -> DataFrame:
    """C14: unrounded coverage per position; zero demand -> NULL or +inf."""
    base = _policy_inputs(t)
    return base.select(
        *POSITION,
        rules.coverage_weeks("inventory_quantity", "avg_weekly_demand", zero_demand).alias("weeks_of_supply"),
    )


def gross_order_quantity(t: Tables, review_weeks: float = rules.REVIEW_PERIOD_WEEKS) -> DataFrame:
    """Order-up-to quantity without open-PO netting (ceil)."""
    base = _policy_inputs(t)
    lead_weeks = F.col("lead_time_days") / F.lit(7.0)
    return base.select(
        *POSITION,
        rules.order_up_to_quantity("inventory_quantity", "avg_weekly_demand", lead_weeks, "safety_stock", review_weeks).alias(
            "order_quantity"
        ),
    )
