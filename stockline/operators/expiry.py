"""Batch shelf-life exposure and FEFO (first-expire-first-out) queues."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.contracts import require_columns
from ..functions.numeric import extended_value
from ..tables import Tables

NEAR_DAYS = 365


def expiry_risk(t: Tables, within_days: int | None = None) -> DataFrame:
    """Every batch (expired and empty ones included) with its band.

    ``within_days`` keeps batches that expire by then; the cut is a literal date
    on ``expiry_date``, which reaches the scan (a cut on the derived number of
    days would not).
    """
    as_of = F.lit(t.as_of)
    batches = t.inventory_batches
    if within_days is not None:
        batches = batches.where(F.col("expiry_date") <= F.lit(t.as_of + dt.timedelta(days=within_days)))
    products = t.products.select("product_id", "product_name", "therapeutic_area", "unit_cost")
    warehouses = t.warehouses.select("warehouse_id", "warehouse_name")
    days = F.datediff("expiry_date", as_of)
    return (
        batches.join(products, "product_id")
        .join(warehouses, "warehouse_id")
        .select(
            "batch_id",
            "batch_number",
            "product_id",
            "product_name",
            "therapeutic_area",
            "warehouse_id",
            "warehouse_name",
            "manufacture_date",
            "expiry_date",
            F.datediff(as_of, "manufacture_date").alias("age_days"),
            days.alias("days_to_expiry"),
            "inventory_quantity",
            "unit_cost",
            extended_value("inventory_quantity", "unit_cost").cast("double").alias("inventory_value_at_risk"),
            rules.expiry_bucket(days).alias("expiry_bucket"),
        )
    )


def expiry_report(t: Tables, warehouse_id=None, include_long_dated: bool = True) -> DataFrame:
    """Optional warehouse filter and 365-day cut, most urgent first."""
    df = expiry_risk(t, None if include_long_dated else NEAR_DAYS)
    if warehouse_id is not None and warehouse_id != "":
        df = df.where(F.col("warehouse_id") == F.lit(warehouse_id))
    return df.orderBy(F.col("days_to_expiry").asc(), F.col("inventory_value_at_risk").desc(), "batch_id")


def value_at_risk(t: Tables, horizons: Sequence[int] = (90, 180, 365)) -> DataFrame:
    """D3: Σ quantity * cost of batches expiring within each horizon (expired
    included), unrounded per row.  All horizons come from one pass of
    conditional sums, then are unpivoted to (horizon_days, value_at_risk).
    """
    if any(h < 0 for h in horizons):
        raise ValueError("Horizon must be non-negative")
    require_columns(t.inventory_batches, ["product_id", "expiry_date", "inventory_quantity"])
    require_columns(t.products, ["product_id", "unit_cost"])
    days = F.datediff("expiry_date", F.lit(t.as_of))
    batches = t.inventory_batches.join(t.products.select("product_id", "unit_cost"), "product_id")
    value = extended_value("inventory_quantity", "unit_cost", scale=None)
    sums = batches.agg(
        *[
            F.coalesce(F.sum(F.when(days <= h, value)), F.lit(0).cast("decimal(38,4)")).alias(f"h{h}")
            for h in horizons
        ]
    )
    stack = ", ".join(f"{h}, h{h}" for h in horizons)
    return sums.select(
        F.expr(f"stack({len(horizons)}, {stack}) as (horizon_days, value_at_risk)")
    ).select(F.col("horizon_days").cast("int"), F.col("value_at_risk").cast("double"))


def expiry_summary(t: Tables) -> DataFrame:
    """Batches, units and value by band, in band order."""
    return (
        expiry_risk(t)
        .groupBy("expiry_bucket")
        .agg(
            F.count(F.lit(1)).alias("batch_count"),
            F.sum("inventory_quantity").cast("bigint").alias("inventory_units"),
            F.round(F.sum(F.col("inventory_value_at_risk").cast("decimal(18,2)")), 2)
            .cast("double")
            .alias("inventory_value_at_risk"),
        )
        .orderBy(rules.bucket_rank("expiry_bucket"))
    )


def fefo_actions(t: Tables) -> DataFrame:
    """Running FEFO units per (warehouse, product) and the action label.

    SUM(...) OVER (PARTITION BY warehouse, product ORDER BY expiry) uses the
    RANGE frame: batches with the same expiry date share one running total.
    Computed in two steps so a position holding a large share of all batches
    never lands in one window task as raw rows:

    1. units per (warehouse, product, expiry date) — a partial aggregate;
    2. running sum over those date rows (at most one row per calendar day per
       position, a bounded group);
    3. join the totals back to the batch rows on the three keys, null-safely: a
       batch without an expiry date comes first in the order and keeps its row.
    """
    risk = expiry_risk(t)
    keys = ["warehouse_id", "product_id", "expiry_date"]
    # From the view itself: its dimension joins are then one shared exchange
    # (reused by the join back) instead of a second scan of the batches.
    per_date = risk.groupBy(*keys).agg(F.sum("inventory_quantity").alias("_units"))
    running = per_date.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.sum("_units")
        .over(
            Window.partitionBy("warehouse_id", "product_id")
            .orderBy("expiry_date")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        .cast("bigint")
        .alias("cumulative_units_by_fefo"),
    )
    return (
        risk.join(running, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]))
        .select(
            "batch_id",
            "warehouse_id",
            "warehouse_name",
            "product_id",
            "product_name",
            "batch_number",
            "expiry_date",
            "days_to_expiry",
            "inventory_quantity",
            "inventory_value_at_risk",
            "cumulative_units_by_fefo",
            rules.fefo_action("days_to_expiry").alias("recommended_action"),
        )
        .orderBy("days_to_expiry", F.col("inventory_value_at_risk").desc(), "batch_id")
    )


def fefo_queue(t: Tables) -> DataFrame:
    """Batches within 365 days with the expiry page's action labels."""
    return (
        expiry_report(t, include_long_dated=False)
        .withColumn("recommended_action", rules.fefo_action("days_to_expiry", rules.FEFO_ACTIONS_PAGE))
    )


def expiry_kpis(t: Tables) -> DataFrame:
    """Urgent batch count, units within 90 and 180 days, value within 180."""
    near = expiry_risk(t, 180)
    d = F.col("days_to_expiry")
    return near.agg(
        F.count(F.when(d <= 90, 1)).alias("urgent_batches"),
        F.coalesce(F.sum(F.when(d <= 90, F.col("inventory_quantity"))), F.lit(0)).cast("bigint").alias("units_90_days"),
        F.coalesce(F.sum(F.when(d <= 180, F.col("inventory_quantity"))), F.lit(0)).cast("bigint").alias("units_180_days"),
        F.coalesce(
            F.round(F.sum(F.when(d <= 180, F.col("inventory_value_at_risk").cast("decimal(18,2)"))), 2),
            F.lit(0).cast("decimal(18,2)"),
        )
        .cast("double")
        .alias("value_at_risk_180_days"),
    )


def top_at_risk(t: Tables, n: int = 20) -> DataFrame:
    """The ``n`` highest-value batches within 365 days (a top-k report).

    orderBy + limit plans as TakeOrderedAndProject: each task keeps its own
    top ``n`` and only those reach the final merge.
    """
    near = expiry_risk(t, NEAR_DAYS)
    return near.orderBy(F.col("inventory_value_at_risk").desc(), "batch_id").limit(n)
