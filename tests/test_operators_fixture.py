"""Operators on a hand-built fixture, checked against brute force."""

from __future__ import annotations

import datetime as dt

import pytest

from fixtures import D, empty, frame, tiny_tables
from stockline.operators import expiry, inventory, kpis, quality, suppliers
from stockline.tables import Tables


def test_value_at_risk_includes_expired_and_near_expiry(spark):
    products = frame(spark, "products", [
        (f"P{i}", f"Product {i}", "A", "Tablet", "1 mg", "S1", cost, cost * 2, 28)
        for i, cost in enumerate((5.0, 7.5, 20.0))
    ])
    batches = frame(spark, "inventory_batches", [
        (f"B{i}", f"N{i}", f"P{i}", "W1", D("2020-01-01"), D(e), q, 0, 0, D("2026-09-27"))
        for i, (e, q) in enumerate((("2026-09-20", 10), ("2026-11-01", 20), ("2027-10-01", 100)))
    ])
    t = Tables(
        suppliers=frame(spark, "suppliers", [("S1", "S", "US", 1)]), products=products,
        warehouses=frame(spark, "warehouses", [("W1", "W", "C", "R")]),
        weekly_sales=empty(spark, "weekly_sales"), inventory_batches=batches,
        purchase_orders=empty(spark, "purchase_orders"), as_of=D("2026-09-27"),
    )
    rows = {r.horizon_days: r.value_at_risk for r in expiry.value_at_risk(t, (90, 180, 365, 800)).collect()}
    assert rows[90] == 200.0
    assert rows[800] == 2200.0
    with pytest.raises(ValueError):
        expiry.value_at_risk(t, (-1,))


def test_supplier_metrics_are_quantity_weighted(spark):
    t = tiny_tables(spark)
    rows = {r.supplier_id: r for r in suppliers.supplier_metrics(t).collect()}
    s1 = rows["S1"]
    assert s1.delivered_orders == 2
    assert s1.on_time_delivery_pct == 50.0
    assert s1.fill_rate_pct == 92.5
    assert round(s1.acceptance_quality_pct, 2) == 94.05
    s2 = rows["S2"]
    assert s2.delivered_orders == 0
    assert s2.on_time_delivery_pct is None and s2.fill_rate_pct is None


def test_inventory_health_position_math(spark):
    t = tiny_tables(spark)
    health = {(r.product_id, r.warehouse_id): r for r in inventory.inventory_health(t).collect()}
    assert len(health) == 3  # positions with batches only
    p = health[("P1", "W1")]
    # B1 expired; B2 + B3 usable
    assert (p.inventory_quantity, p.expired_inventory_quantity) == (340, 10)
    assert p.on_order_quantity == 500 and p.inventory_position == 840
    # trailing 84 days = the last 12 of 13 weeks: demand 101..112
    assert p.avg_weekly_demand == pytest.approx(106.5)
    assert p.weeks_of_supply == round(340 / 106.5, 2)
    assert p.stockout_risk == "Watch"  # above reorder point, coverage < 6
    assert p.replenishment_flag == 0
    lead = 28 / 7.0
    assert p.recommended_order_quantity == max(0, round(106.5 * (lead + 4) + 50 - 340 - 500))
    assert p.inventory_value == 850.0
    q = health[("P2", "W2")]
    assert q.avg_weekly_demand == 0.0 and q.weeks_of_supply is None
    assert q.stockout_risk == "High" and q.on_order_quantity == 60


def test_replenishment_and_reconciliation(spark):
    t = tiny_tables(spark)
    rec = inventory.replenishment_recommendations(t).collect()
    assert all(r.recommended_order_quantity > 0 for r in rec)
    assert all(r.estimated_order_value == round(r.recommended_order_quantity * r.unit_cost, 2) for r in rec)
    row = quality.reconciliation(t).collect()[0]
    assert row.batch_units == 1280 and row.stock_reconciles and row.on_order_reconciles
    assert row.open_po_units == 560


def test_fefo_running_total_shares_equal_expiry_dates(spark):
    t = tiny_tables(spark)
    rows = {r.batch_id: r.cumulative_units_by_fefo for r in expiry.fefo_actions(t).collect()}
    assert rows["B1"] == 10
    assert rows["B2"] == rows["B3"] == 350  # same expiry date: RANGE frame
    assert rows["B5"] == 900


def test_urgent_positions_rank_within_warehouse(spark):
    t = tiny_tables(spark)
    rows = kpis.urgent_positions(t, per_warehouse=1).collect()
    assert {r.warehouse_id for r in rows} == {"W1", "W2"}
    assert all(r.warehouse_risk_rank == 1 for r in rows)


def test_quality_gate_messages_in_loader_order(spark):
    t = tiny_tables(spark)
    quality.validate_tables(t)  # clean fixture passes
    bad_sales = [(1, D("2026-06-29"), "P1", "W1", 10, 12, -2, 1.0)]
    bad = tiny_tables(spark, weekly_sales=bad_sales)
    with pytest.raises(ValueError, match="Units sold cannot exceed demand"):
        quality.validate_tables(bad)
    dup = tiny_tables(spark, suppliers=[("S1", "A", "US", 1), ("S1", "B", "US", 1), ("S2", "C", "DE", 2)])
    with pytest.raises(ValueError, match=r"Invalid primary key in suppliers.supplier_id"):
        quality.validate_tables(dup)
    orphan = tiny_tables(spark, products=[
        ("P1", "Product One", "Cardiology", "Tablet", "10 mg", "S9", 2.5, 10.0, 28),
        ("P2", "Product Two", "Oncology", "Injection", "5 mg", "S2", 7.5, 20.0, 14),
    ])
    with pytest.raises(ValueError, match="Products contain unknown suppliers"):
        quality.validate_tables(orphan)
    empty_wh = tiny_tables(spark, warehouses=[])
    with pytest.raises(ValueError, match="warehouses is empty"):
        quality.validate_tables(empty_wh)


def test_quality_summary_and_quarantine(spark):
    pos = [
        ("PO1", "S1", "P1", "W1", D("2026-01-01"), D("2026-01-10"), None, 100, 100, 98, 2.5, "Delivered"),
        ("PO2", "S1", "P1", "W1", D("2026-01-05"), D("2026-01-01"), D("2026-01-03"), 100, 120, 130, 2.5, "Lost"),
    ]
    t = tiny_tables(spark, purchase_orders=pos)
    summary = {r.rule_id: r.violations for r in quality.dq_summary(t).collect()}
    assert summary["status.purchase_orders.domain"] == 1
    assert summary["status.purchase_orders.actual_date_iff_delivered"] == 2
    assert summary["date.purchase_orders.promised_on_or_after_order"] == 1
    assert summary["cross.purchase_orders.received_le_ordered"] == 1
    assert summary["cross.purchase_orders.accepted_le_received"] == 1
    assert summary["pk.purchase_orders.purchase_order_id"] == 0
    bad = quality.quarantine(t, "status.purchase_orders.domain").collect()
    assert [r.purchase_order_id for r in bad] == ["PO2"]
    with pytest.raises(KeyError):
        quality.quarantine(t, "no.such.rule")
    # promised before order date: not a loader rule, but a schema constraint
    late = [("PO2", "S1", "P1", "W1", D("2026-01-05"), D("2026-01-01"), None, 100, 0, 0, 2.5, "Open")]
    quality.validate_tables(tiny_tables(spark, purchase_orders=late))
    with pytest.raises(ValueError, match="Constraint violated: date.purchase_orders.promised_on_or_after_order"):
        quality.validate_tables(tiny_tables(spark, purchase_orders=late), scope="all")


def test_business_date_override_moves_expiry(spark):
    t = tiny_tables(spark).with_as_of(dt.date(2027, 1, 15))
    rows = {r.batch_id: r.expiry_bucket for r in expiry.expiry_risk(t).collect()}
    assert rows["B2"] == "Expired" and rows["B5"] == "0-90 days"


def test_foreign_key_orphans_count_rows_not_keys(spark):
    # three batches point at a missing product (two share the key), one at a
    # missing warehouse; the distinct-key pre-aggregation must still count rows
    batches = [
        ("B1", "N1", "P1", "W1", D("2025-01-01"), D("2026-09-20"), 10, 120, 50),
        ("B2", "N2", "P9", "W1", D("2025-06-01"), D("2026-11-01"), 300, 120, 50),
        ("B3", "N3", "P9", "W2", D("2025-07-01"), D("2026-11-01"), 40, 120, 50),
        ("B4", "N4", "P8", "W2", D("2025-08-01"), D("2027-10-01"), 30, 40, 20),
        ("B5", "N5", "P1", "W7", D("2025-09-01"), D("2027-03-26"), 900, 200, 100),
    ]
    t = tiny_tables(spark, inventory_batches=batches)
    counts = {r.rule_id: r.violations for r in quality.dq_summary(t, ("foreign_key",)).collect()}
    assert counts["fk.inventory_batches.product_id"] == 3
    assert counts["fk.inventory_batches.warehouse_id"] == 1
    assert counts["fk.purchase_orders.product_id"] == 0
    orphans = {r.batch_id for r in quality.quarantine(t, "fk.inventory_batches.product_id").collect()}
    assert orphans == {"B2", "B3", "B4"}
