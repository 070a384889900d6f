"""Small hand-built tables for unit tests (brute-force checkable)."""

from __future__ import annotations

import datetime as dt

from stockline.sources.schemas import SCHEMAS
from stockline.tables import Tables

D = dt.date.fromisoformat


def frame(spark, name, rows):
    return spark.createDataFrame(rows, SCHEMAS[name])


def empty(spark, name):
    return spark.createDataFrame([], SCHEMAS[name])


def tiny_tables(spark, as_of="2026-09-27", **overrides) -> Tables:
    """Two products, two warehouses, two suppliers and a few facts."""
    rows = {
        "suppliers": [("S1", "Supplier One", "US", 28), ("S2", "Supplier Two", "DE", 35)],
        "products": [
            ("P1", "Product One", "Cardiology", "Tablet", "10 mg", "S1", 2.5, 10.0, 28),
            ("P2", "Product Two", "Oncology", "Injection", "5 mg", "S2", 7.5, 20.0, 14),
        ],
        "warehouses": [("W1", "West", "Reno", "West"), ("W2", "East", "Allentown", "East")],
        "weekly_sales": [
            (i * 10 + w, D("2026-06-29") + dt.timedelta(weeks=i), "P1", f"W{w}", 100 + i, 95 + i, 5, 950.0 + 10 * i)
            for i in range(13) for w in (1, 2)
        ],
        "inventory_batches": [
            ("B1", "N1", "P1", "W1", D("2025-01-01"), D("2026-09-20"), 10, 120, 50),
            ("B2", "N2", "P1", "W1", D("2025-06-01"), D("2026-11-01"), 300, 120, 50),
            ("B3", "N3", "P1", "W1", D("2025-07-01"), D("2026-11-01"), 40, 120, 50),
            ("B4", "N4", "P2", "W2", D("2025-08-01"), D("2027-10-01"), 30, 40, 20),
            ("B5", "N5", "P1", "W2", D("2025-09-01"), D("2027-03-26"), 900, 200, 100),
        ],
        "purchase_orders": [
            ("PO1", "S1", "P1", "W1", D("2026-01-01"), D("2026-01-10"), D("2026-01-09"), 100, 100, 98, 2.5, "Delivered"),
            ("PO2", "S1", "P1", "W1", D("2026-01-01"), D("2026-01-10"), D("2026-01-12"), 300, 270, 250, 2.5, "Delivered"),
            ("PO3", "S1", "P1", "W1", D("2026-09-01"), D("2026-10-01"), None, 500, 0, 0, 2.5, "Open"),
            ("PO4", "S2", "P2", "W2", D("2026-09-10"), D("2026-09-20"), None, 60, 0, 0, 7.5, "Open"),
        ],
    }
    rows.update(overrides)
    batch_defaults = [r + (D(as_of),) if len(r) == 9 else r for r in rows["inventory_batches"]]
    rows["inventory_batches"] = batch_defaults
    frames = {name: frame(spark, name, data) for name, data in rows.items()}
    return Tables(as_of=D(as_of), **frames)
