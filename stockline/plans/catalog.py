"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Every query reads the projected tables of ``sf_dir`` (see ``sources/mart``),
over the whole tables.  Parameters below are the fixed example arguments of the
parameterised readers (a warehouse, an area, a supplier).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..operators import expiry, forecast, inventory, kpis, moments, quality, quality_state, rollup, sales, suppliers
from ..session import scratch_path
from ..sources import bucketed, mart
from ..tables import Tables

# Fixed example arguments of the parameterised readers.
EXAMPLE_WAREHOUSE = 1
EXAMPLE_AREA = "STANDARD"
EXAMPLE_SUPPLIER = 7
FORECAST_GRAIN = ("dosage_form", "warehouse_id")
# Queries on kept state load the history before this month first, then the rest.
EXAMPLE_MONTH = dt.date(2001, 8, 1)

Query = Callable[[SparkSession, str], DataFrame]


def _on_tables(fn: Callable[[Tables], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(mart.load(spark, sf_dir))

    run.__doc__ = fn.__doc__
    return run


def table_counts(t: Tables) -> DataFrame:
    """A4: row count of each of the six tables."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in t.frames().items()]
    return reduce(DataFrame.unionByName, parts)


def load_tables(t: Tables) -> DataFrame:
    """A1: the typed table set: rows, columns and declared-schema problems per table.

    Column contracts are checked on the schema (no job); counts are one
    aggregate per table.  Integral ids of the projected tables are accepted
    in place of the string ids of the CSV layout.
    """
    from ..functions.contracts import check_contract
    from ..sources.schemas import SCHEMAS

    parts = []
    for name, df in t.frames().items():
        problems = len(check_contract(df, SCHEMAS[name], integral_ids=True))
        parts.append(df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count",
            F.lit(len(SCHEMAS[name].fields)).alias("column_count"),
            F.lit(problems).alias("contract_problems"),
        ))
    return reduce(DataFrame.unionByName, parts)


def selector_lists(t: Tables) -> DataFrame:
    """Distinct (id, name) pairs for warehouses and products, sorted areas."""
    wh = t.warehouses.select(
        F.lit("warehouse").alias("list_name"), F.col("warehouse_id").cast("string").alias("item_id"),
        F.col("warehouse_name").alias("label"))
    pr = t.products.select(
        F.lit("product").alias("list_name"), F.col("product_id").cast("string").alias("item_id"),
        F.col("product_name").alias("label"))
    ar = t.products.select(
        F.lit("therapeutic_area").alias("list_name"), F.lit(None).cast("string").alias("item_id"),
        F.col("therapeutic_area").alias("label"))
    return wh.unionByName(pr).unionByName(ar).distinct().orderBy("list_name", "label", "item_id")


def _dq_family(*families: str) -> Callable[[Tables], DataFrame]:
    def run(t: Tables) -> DataFrame:
        return quality.dq_summary(t, families)

    return run


_RESULTS: dict[tuple[str, ...], tuple[Tables, forecast.ForecastResult]] = {}


def _forecast(t: Tables, grain: tuple[str, ...]) -> forecast.ForecastResult:
    """One forecast per grain and table set, shared by all queries on its outputs."""
    if grain not in _RESULTS or _RESULTS[grain][0] is not t:
        _RESULTS[grain] = t, forecast.forecast_tables(t, grain)
    return _RESULTS[grain][1]


def forget_fits() -> None:
    """Fit anew from now on (a timed run must not read another run's fit)."""
    _RESULTS.clear()


def fit(t: Tables, grain: tuple[str, ...] = FORECAST_GRAIN) -> None:
    """Write the index and the models that all queries on the fit read."""
    _forecast(t, grain).materialize()


def _fit(part: Callable[[forecast.ForecastResult], DataFrame], grain: tuple[str, ...] = FORECAST_GRAIN) -> Callable[[Tables], DataFrame]:
    """An output of the fit: index and fit are written once and read by all of them."""
    return lambda t: part(_forecast(t, grain).materialize())


def _index(part: Callable[[forecast.ForecastResult], DataFrame], grain: tuple[str, ...] = FORECAST_GRAIN) -> Callable[[Tables], DataFrame]:
    """An output of the index alone."""
    return lambda t: part(_forecast(t, grain))


SPARK_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    # A — sources, preparation
    "load_tables": load_tables,
    "table_counts": table_counts,
    "selector_lists": selector_lists,
    "inventory_health_filtered": lambda t: inventory.inventory_health_report(t, EXAMPLE_WAREHOUSE, EXAMPLE_AREA),
    # B — data quality
    "dq_summary": quality.dq_summary,
    "dq_primary_key": _dq_family("non_empty", "primary_key"),
    "dq_unique": _dq_family("unique"),
    "dq_foreign_key": _dq_family("foreign_key"),
    "dq_not_null": _dq_family("not_null"),
    "dq_range": _dq_family("range"),
    "dq_cross_column": _dq_family("cross_column"),
    "dq_date_order": _dq_family("date_order"),
    "dq_status": _dq_family("status"),
    "dq_reconcile": quality.reconciliation,
    # C — inventory
    "recent_demand": inventory.recent_demand,
    "stock_position": inventory.stock_position,
    "open_on_order": inventory.open_on_order,
    "inventory_health": inventory.inventory_health,
    "safety_stock": inventory.safety_stock_by_position,
    "reorder_point": inventory.reorder_points,
    "weeks_of_supply": inventory.weeks_of_supply,
    "order_quantity_gross": inventory.gross_order_quantity,
    "replenishment": inventory.replenishment_recommendations,
    "warehouse_summary": inventory.warehouse_summary,
    "last_n_mean_demand": inventory.last_n_mean_demand,
    # D — expiry / FEFO
    "expiry_risk": expiry.expiry_risk,
    "value_at_risk": expiry.value_at_risk,
    "expiry_risk_near": lambda t: expiry.expiry_report(t, include_long_dated=False),
    "expiry_summary": expiry.expiry_summary,
    "fefo_actions": expiry.fefo_actions,
    "fefo_queue": expiry.fefo_queue,
    "expiry_kpis": expiry.expiry_kpis,
    "top_at_risk": expiry.top_at_risk,
    # E — suppliers
    "supplier_performance": suppliers.supplier_performance,
    "supplier_metrics": suppliers.supplier_metrics,
    "supplier_scorecard": suppliers.supplier_scorecard,
    "supplier_ranking": suppliers.supplier_ranking,
    "supplier_po_detail": lambda t: suppliers.supplier_order_detail(t, EXAMPLE_SUPPLIER),
    "open_po_exposure": suppliers.open_po_exposure,
    "supplier_kpis": suppliers.supplier_kpis,
    # F — demand, sales, portfolio, KPIs
    "demand_history": sales.demand_history_all_grains,
    "therapy_trend": sales.therapy_trend,
    "product_service": sales.product_service,
    "current_service": sales.current_service,
    "weekly_revenue": sales.weekly_revenue,
    "therapy_portfolio": sales.therapy_portfolio,
    "urgent_positions": kpis.urgent_positions,
    "executive_kpis": kpis.executive_kpis,
    "risk_mix": kpis.risk_mix,
    "inventory_scope_kpis": kpis.inventory_scope_kpis,
    "order_allocation": kpis.order_allocation,
    "replenishment_kpis": kpis.replenishment_kpis,
    # G — forecasting (dosage form x warehouse series; network series)
    "series_index": _index(lambda r: r.history),
    "rejected_series": _index(lambda r: r.rejected, ("product_id", "warehouse_id")),
    "ridge_moments": _fit(lambda r: r.coefficients),
    "forecast_validation": _fit(lambda r: r.validation),
    "seasonal_naive": _index(lambda r: r.seasonal_naive),
    "forecast_accuracy": _fit(lambda r: r.metrics.select(*FORECAST_GRAIN, "mae", "mape", "baseline_mae", "baseline_mape")),
    "residual_band": _fit(lambda r: r.metrics.select(*FORECAST_GRAIN, "residual_lower", "residual_upper")),
    "forecast_future": _fit(lambda r: r.future),
    "forecast_network_future": _fit(lambda r: r.future, ()),
    "forecast_kpis": _fit(lambda r: forecast.forecast_kpis(r, FORECAST_GRAIN)),
    "forecast_recent_history": _index(lambda r: forecast.recent_history(r, FORECAST_GRAIN)),
}


def dq_two_loads(t: Tables) -> DataFrame:
    """B1-B9 over all rows, from the saved states of two loads (``quality_state``)."""
    spark = t.products.sparkSession
    root = scratch_path(spark, "dq-state")
    for name, load in zip(("history", EXAMPLE_MONTH.isoformat()), quality_state.split_by_month(t, EXAMPLE_MONTH)):
        quality_state.save(quality_state.measure(load), root, name)
    return quality_state.evaluate(quality_state.read(spark, root))


def _on_rollup(part: Callable[[Tables, DataFrame], DataFrame]) -> Callable[[Tables], DataFrame]:
    """An output of the demand rollup, saved for the history first and then for the months after it."""

    def run(t: Tables) -> DataFrame:
        spark = t.products.sparkSession
        root = scratch_path(spark, "rollup")
        for load in quality_state.split_by_month(t, EXAMPLE_MONTH):
            rollup.save(rollup.monthly(load.weekly_sales), root)
        return part(t, rollup.read(spark, root))

    return run


def _stored_forecast(t: Tables) -> moments.StoredForecast:
    """The forecast of a kept state: the history's moments, the later weeks' shifted behind them."""
    spark, keys = t.products.sparkSession, list(FORECAST_GRAIN)
    weekly = forecast.series_demand(t, keys)
    root = scratch_path(spark, "moments")
    moments.save(moments.measure(weekly.where(F.col("week_start") < F.lit(EXAMPLE_MONTH)), keys), root)
    later = moments.measure(weekly.where(F.col("week_start") >= F.lit(EXAMPLE_MONTH)), keys)
    return moments.StoredForecast(moments.merge(moments.read(spark, root), later, keys), keys)


def ridge_two_loads(t: Tables) -> DataFrame:
    """G4/G9 coefficients from a kept state, to four decimals (sums taken in another order)."""
    found = _stored_forecast(t).coefficients
    return found.select(*[c if c in (*FORECAST_GRAIN, "n_obs") else round_half_up(c, 4).alias(c) for c in found.columns])


def _bucketed(fn: Callable[[Tables], DataFrame]) -> Query:
    """A query over the bucketed layout, written for it under names of its own."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = scratch_path(spark, "bucketed")
        prefix = root.rsplit("/", 1)[-1].replace("-", "_")
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        t = mart.build_dealt(spark, sf_dir, buckets)
        bucketed.write(t, root, prefix, buckets)
        return fn(bucketed.read(spark, root, prefix, buckets, t.as_of))

    run.__doc__ = fn.__doc__
    return run


#: Queries on state that is kept and added to, load by load.
LOAD_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    "dq_two_loads": dq_two_loads,
    "safety_stock_two_loads": _on_rollup(rollup.safety_stock_by_position),
    "recent_demand_two_loads": _on_rollup(rollup.recent_demand),
    "last_n_mean_two_loads": _on_rollup(rollup.last_n_mean_demand),
    "ridge_two_loads": ridge_two_loads,
    "forecast_future_two_loads": lambda t: _stored_forecast(t).future,
}

#: Queries on the bucketed layout, which is built from the source tables without the snapshot.
BUCKETED_QUERIES: dict[str, Query] = {
    "inventory_health_bucketed": _bucketed(inventory.inventory_health),
    "dq_unique_bucketed": _bucketed(_dq_family("unique")),
}


def queries() -> dict[str, Query]:
    return {key: _on_tables(fn) for key, fn in (SPARK_QUERIES | LOAD_QUERIES).items()} | BUCKETED_QUERIES
