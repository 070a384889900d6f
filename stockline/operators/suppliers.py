"""Supplier scorecards, rankings and purchase-order exposure.

Purchase orders are aggregated per supplier first (partial aggregation absorbs
a supplier holding a large share of orders); the supplier table is then joined
to one row per supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.contracts import require_columns
from ..functions.numeric import extended_value, pct, round_half_up, safe_divide
from ..functions.ranking import dense_rank_of_values, global_row_number, ntile_from_row_number
from ..tables import Tables

ORDER_COLUMNS = (
    "supplier_id",
    "order_date",
    "promised_delivery_date",
    "actual_delivery_date",
    "ordered_quantity",
    "received_quantity",
    "accepted_quantity",
    "unit_cost",
    "status",
)


def _delivered():
    return F.col("status") == "Delivered"


def _delivered_sum(c: str):
    return F.sum(F.when(_delivered(), F.col(c)).otherwise(0))


def po_stats_by_supplier(t: Tables) -> DataFrame:
    """Exact per-supplier sums over purchase orders (one row per supplier)."""
    require_columns(t.purchase_orders, ORDER_COLUMNS)
    on_time = F.col("actual_delivery_date") <= F.col("promised_delivery_date")
    return t.purchase_orders.groupBy("supplier_id").agg(
        F.count(F.when(_delivered(), 1)).alias("delivered_orders"),
        F.count(F.when(_delivered() & on_time, 1)).alias("on_time_orders"),
        _delivered_sum("ordered_quantity").cast("bigint").alias("delivered_ordered"),
        _delivered_sum("received_quantity").cast("bigint").alias("delivered_received"),
        _delivered_sum("accepted_quantity").cast("bigint").alias("delivered_accepted"),
        # delivered orders without a delivery date have no lead time and do not enter its mean
        F.avg(F.when(_delivered(), F.datediff("actual_delivery_date", "order_date"))).alias("mean_lead_days"),
        F.sum(extended_value("ordered_quantity", "unit_cost", scale=None)).alias("po_value"),
    )


def supplier_performance(t: Tables) -> DataFrame:
    """Every supplier (LEFT JOIN) with delivery, quality, fill and lead time."""
    stats = po_stats_by_supplier(t)
    s = t.suppliers.select("supplier_id", "supplier_name", "country", "contracted_lead_time_days")
    joined = s.join(stats, "supplier_id", "left")
    delivered = F.coalesce(F.col("delivered_orders"), F.lit(0)).cast("bigint")
    return joined.select(
        "supplier_id",
        "supplier_name",
        "country",
        "contracted_lead_time_days",
        delivered.alias("delivered_orders"),
        round_half_up(F.lit(100.0) * safe_divide("on_time_orders", "delivered_orders"), 1).alias("on_time_delivery_pct"),
        round_half_up(pct("delivered_accepted", "delivered_received"), 1).alias("acceptance_quality_pct"),
        round_half_up(pct("delivered_received", "delivered_ordered"), 1).alias("fill_rate_pct"),
        round_half_up("mean_lead_days", 1).alias("actual_lead_time_days"),
        F.round(F.col("po_value"), 2).cast("double").alias("total_po_value"),
    )


def supplier_metrics(t: Tables) -> DataFrame:
    """Unrounded delivered-only metrics per supplier with orders.

    NULL where the reference returns NaN (no delivered order / zero quantity).
    """
    stats = po_stats_by_supplier(t)
    return stats.select(
        "supplier_id",
        F.col("delivered_orders").cast("bigint").alias("delivered_orders"),
        (F.lit(100.0) * safe_divide("on_time_orders", "delivered_orders")).alias("on_time_delivery_pct"),
        pct("delivered_received", "delivered_ordered").alias("fill_rate_pct"),
        pct("delivered_accepted", "delivered_received").alias("acceptance_quality_pct"),
    )


def supplier_scorecard(t: Tables) -> DataFrame:
    """Performance score (missing metrics count as 0) and tier."""
    perf = supplier_performance(t)
    score = rules.weighted_score("on_time_delivery_pct", "acceptance_quality_pct", "fill_rate_pct", nulls_as_zero=True)
    return (
        perf.withColumn("performance_score", score)
        .withColumn("performance_tier", rules.score_tier("performance_score"))
        .orderBy(F.col("performance_score").desc(), "supplier_id")
    )


def supplier_ranking(t: Tables) -> DataFrame:
    """Composite score (NULL if a metric is NULL), DENSE_RANK and NTILE(4)
    by score descending, NULL scores last, supplier_id breaking NTILE ties.

    The score has one decimal, so it takes a bounded number of values and the
    dense rank is a window over those.  Tiles come from the distributed global
    numbering (one job, see ``functions.ranking``), so neither a single-task
    window nor a score that many suppliers share gathers rows in one task.
    """
    perf = supplier_performance(t)
    scored = perf.select(
        "supplier_id",
        "supplier_name",
        "delivered_orders",
        "on_time_delivery_pct",
        "acceptance_quality_pct",
        "fill_rate_pct",
        rules.weighted_score("on_time_delivery_pct", "acceptance_quality_pct", "fill_rate_pct", nulls_as_zero=False).alias(
            "composite_score"
        ),
    )
    numbered = global_row_number(
        scored, [F.col("composite_score").desc_nulls_last(), F.col("supplier_id").asc()], "_rn", total="_n"
    )
    ranked = dense_rank_of_values(numbered, "composite_score", name="supplier_rank")
    return (
        ranked.withColumn("performance_quartile", ntile_from_row_number("_rn", "_n", 4))
        .drop("_rn", "_n")
        .orderBy("supplier_rank", "supplier_id")
    )


def supplier_order_detail(t: Tables, supplier_id) -> DataFrame:
    """One supplier's orders with names; signed days against the promise."""
    po = t.purchase_orders.where(F.col("supplier_id") == F.lit(supplier_id))
    products = t.products.select("product_id", "product_name")
    warehouses = t.warehouses.select("warehouse_id", "warehouse_name")
    return (
        po.join(products, "product_id")
        .join(warehouses, "warehouse_id")
        .select(
            "purchase_order_id",
            "product_name",
            "warehouse_name",
            "order_date",
            "promised_delivery_date",
            "actual_delivery_date",
            "ordered_quantity",
            "received_quantity",
            "accepted_quantity",
            "status",
            F.when(_delivered(), F.datediff("actual_delivery_date", "promised_delivery_date")).alias("days_vs_promise"),
        )
        .orderBy(F.col("order_date").desc(), "purchase_order_id")
    )


def open_po_exposure(t: Tables) -> DataFrame:
    """Open orders by warehouse x supplier (ids kept in the grouping)."""
    po = t.purchase_orders.where(F.col("status") == "Open")
    per_pair = po.groupBy("warehouse_id", "supplier_id").agg(
        F.count(F.lit(1)).alias("open_po_count"),
        F.sum("ordered_quantity").cast("bigint").alias("open_units"),
        F.round(F.sum(extended_value("ordered_quantity", "unit_cost", scale=None)), 2).cast("double").alias("open_po_value"),
        F.count(F.when(F.col("promised_delivery_date") < F.lit(t.as_of), 1)).alias("past_due_orders"),
    )
    warehouses = t.warehouses.select("warehouse_id", "warehouse_name")
    suppliers = t.suppliers.select("supplier_id", "supplier_name")
    return (
        per_pair.join(warehouses, "warehouse_id")
        .join(suppliers, "supplier_id")
        .select(
            "warehouse_id",
            "warehouse_name",
            "supplier_id",
            "supplier_name",
            "open_po_count",
            "open_units",
            "open_po_value",
            "past_due_orders",
        )
        .orderBy(F.col("open_po_value").desc(), "warehouse_id", "supplier_id")
    )


def supplier_kpis(t: Tables) -> DataFrame:
    """Scorecard strip — mean on-time and quality (NULLs skipped), tiers."""
    card = supplier_scorecard(t)
    mean_on_time = safe_divide(
        F.sum(F.col("on_time_delivery_pct").cast("decimal(10,1)")), F.count("on_time_delivery_pct")
    )
    mean_quality = safe_divide(
        F.sum(F.col("acceptance_quality_pct").cast("decimal(10,1)")), F.count("acceptance_quality_pct")
    )
    kpis = card.agg(
        F.count(F.lit(1)).alias("suppliers"),
        mean_on_time.alias("mean_on_time_delivery_pct"),
        mean_quality.alias("mean_acceptance_quality_pct"),
        F.count(F.when(F.col("performance_tier") == rules.PREFERRED, 1)).alias("preferred_suppliers"),
        F.count(F.when(F.col("performance_tier") == rules.NEEDS_ACTION, 1)).alias("needs_action_suppliers"),
    )
    return kpis.withColumn(
        "on_time_status",
        F.when(F.col("mean_on_time_delivery_pct") >= rules.ON_TIME_GOOD_PCT, F.lit("good")).otherwise(F.lit("watch")),
    )
