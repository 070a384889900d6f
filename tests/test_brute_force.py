"""Stock, expiry and FEFO results on tables made by arithmetic, against plain Python."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict

import pytest

from fixtures import D, empty, frame, tiny_tables
from stockline.operators import expiry, inventory, kpis
from stockline.tables import Tables

AS_OF = D("2025-03-01")
PRODUCTS = [(f"P{i}", f"Name {i}", f"Area {i % 2}", "Tablet", f"{i} mg", "S1", 1.25 + 0.5 * i, 9.0 + i, 7 * (1 + i % 4)) for i in range(1, 7)]
WAREHOUSES = [(f"W{i}", f"Depot {i}", "Town", "North") for i in range(1, 4)]


def batches():
    rows = []
    for p in range(1, 7):
        for w in range(1, 4):
            for b in range(4):
                n = 100 * p + 10 * w + b
                # expired, due soon and late ones; some share a date
                expires = AS_OF + dt.timedelta(days=(n * 37) % 500 - 60 if b != 3 else (n - 1) * 37 % 500 - 60)
                rows.append((f"B{n}", f"N{n}", f"P{p}", f"W{w}", AS_OF - dt.timedelta(days=100 + b), expires, n % 23, 20 + p, 6 + w, AS_OF))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(
        suppliers=frame(spark, "suppliers", [("S1", "One", "US", 20)]),
        products=frame(spark, "products", PRODUCTS),
        warehouses=frame(spark, "warehouses", WAREHOUSES),
        weekly_sales=empty(spark, "weekly_sales"),
        inventory_batches=frame(spark, "inventory_batches", batches()),
        purchase_orders=empty(spark, "purchase_orders"),
        as_of=AS_OF,
    )


COST = {p[0]: p[6] for p in PRODUCTS}


def band(days):
    if days < 0:
        return "Expired"
    for limit, name in ((90, "0-90 days"), (180, "91-180 days"), (365, "181-365 days")):
        if days <= limit:
            return name
    return "Over 365 days"


def test_bands(tables):
    expected = defaultdict(lambda: [0, 0, 0.0])
    for b in batches():
        e = expected[band((b[5] - AS_OF).days)]
        e[0] += 1
        e[1] += b[6]
        e[2] += round(b[6] * COST[b[2]], 2)
    got = {r.expiry_bucket: [r.batch_count, r.inventory_units, r.inventory_value_at_risk] for r in expiry.expiry_summary(tables).collect()}
    assert got == {k: [v[0], v[1], pytest.approx(v[2])] for k, v in expected.items()}


def test_value_within_horizons(tables):
    within = lambda days: [b for b in batches() if (b[5] - AS_OF).days <= days]
    value = lambda rows: sum(b[6] * COST[b[2]] for b in rows)
    got = {r.horizon_days: r.value_at_risk for r in expiry.value_at_risk(tables, (30, 180)).collect()}
    assert got == {h: pytest.approx(value(within(h))) for h in (30, 180)}
    k = expiry.expiry_kpis(tables).collect()[0]
    assert k.urgent_batches == len(within(90))
    assert (k.units_90_days, k.units_180_days) == tuple(sum(b[6] for b in within(h)) for h in (90, 180))
    assert k.value_at_risk_180_days == pytest.approx(value(within(180)))
    assert kpis.executive_kpis(tables).collect()[0].units_expiring_180_days == k.units_180_days


def test_positions(tables):
    usable, spoiled = defaultdict(int), defaultdict(int)
    for b in batches():
        (usable if b[5] >= AS_OF else spoiled)[b[2], b[3]] += b[6]
    got = {(r.product_id, r.warehouse_id): r for r in inventory.inventory_health(tables).collect()}
    assert len(got) == 18
    for (p, w), r in got.items():
        assert (r.inventory_quantity, r.expired_inventory_quantity) == (usable[p, w], spoiled[p, w])
        safety, reorder = 6 + int(w[1]), 20 + int(p[1])
        tier = "Critical" if usable[p, w] <= safety else "High" if usable[p, w] <= reorder else "Healthy"
        assert r.stockout_risk == tier and r.replenishment_flag == int(usable[p, w] <= reorder)
        assert r.inventory_value == pytest.approx(round(usable[p, w] * COST[p], 2))
        assert r.recommended_order_quantity == max(0, safety - usable[p, w]) and r.weeks_of_supply is None
    per_warehouse = {r.warehouse_id: r.inventory_units for r in inventory.warehouse_summary(tables).collect()}
    assert per_warehouse == {w: sum(n for (_, x), n in usable.items() if x == w) for w in ("W1", "W2", "W3")}


def test_top_batches(tables):
    near = [b for b in batches() if (b[5] - AS_OF).days <= 365]
    order = sorted(near, key=lambda b: (-round(b[6] * COST[b[2]], 2), b[0]))
    assert [r.batch_id for r in expiry.top_at_risk(tables, 5).collect()] == [b[0] for b in order[:5]]


def test_running_units(tables):
    rows = batches()
    got = {r.batch_id: r.cumulative_units_by_fefo for r in expiry.fefo_actions(tables).collect()}
    assert got == {b[0]: sum(x[6] for x in rows if x[2:4] == b[2:4] and x[5] <= b[5]) for b in rows}
    assert len({(b[2], b[3], b[5]) for b in rows}) < len(rows)  # some share a date


def test_batches_without_an_expiry_date_keep_their_rows(spark):
    from dataclasses import replace

    from pyspark.sql import functions as F

    t = tiny_tables(spark)
    no_date = F.when(F.col("batch_id").isin("B2", "B4"), None).otherwise(F.col("expiry_date"))
    t = replace(t, inventory_batches=t.inventory_batches.withColumn("expiry_date", no_date))
    rows = {r.batch_id: r for r in expiry.fefo_actions(t).collect()}
    assert set(rows) == {"B1", "B2", "B3", "B4", "B5"}
    # without a date: first in the order, and in the last band
    assert (rows["B2"].cumulative_units_by_fefo, rows["B1"].cumulative_units_by_fefo, rows["B3"].cumulative_units_by_fefo) == (300, 310, 350)
    assert rows["B4"].cumulative_units_by_fefo == 30
    bands = {r.batch_id: r.expiry_bucket for r in expiry.expiry_risk(t).collect()}
    assert bands["B2"] == bands["B4"] == "Over 365 days"
