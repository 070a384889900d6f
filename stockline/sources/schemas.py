"""Declared schemas of the six tables (no schema inference anywhere).

Ids are strings in the CSV layout.  Tables derived from other sources may use
integral ids; every operator is indifferent to the id type.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, DT = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.DateType()


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


SCHEMAS: dict[str, T.StructType] = {
    "suppliers": _struct(
        ("supplier_id", S, False),
        ("supplier_name", S, False),
        ("country", S, False),
        ("contracted_lead_time_days", I, False),
    ),
    "products": _struct(
        ("product_id", S, False),
        ("product_name", S, False),
        ("therapeutic_area", S, False),
        ("dosage_form", S, False),
        ("strength", S, False),
        ("primary_supplier_id", S, False),
        ("unit_cost", D, False),
        ("unit_price", D, False),
        ("lead_time_days", I, False),
    ),
    "warehouses": _struct(
        ("warehouse_id", S, False),
        ("warehouse_name", S, False),
        ("city", S, False),
        ("region", S, False),
    ),
    "weekly_sales": _struct(
        ("sales_id", L, False),
        ("week_start", DT, False),
        ("product_id", S, False),
        ("warehouse_id", S, False),
        ("demand_units", L, False),
        ("units_sold", L, False),
        ("lost_sales_units", L, False),
        ("revenue", D, False),
    ),
    "inventory_batches": _struct(
        ("batch_id", S, False),
        ("batch_number", S, False),
        ("product_id", S, False),
        ("warehouse_id", S, False),
        ("manufacture_date", DT, False),
        ("expiry_date", DT, False),
        ("inventory_quantity", L, False),
        ("reorder_point", L, False),
        ("safety_stock", L, False),
        ("last_count_date", DT, False),
    ),
    "purchase_orders": _struct(
        ("purchase_order_id", S, False),
        ("supplier_id", S, False),
        ("product_id", S, False),
        ("warehouse_id", S, False),
        ("order_date", DT, False),
        ("promised_delivery_date", DT, False),
        ("actual_delivery_date", DT, True),
        ("ordered_quantity", L, False),
        ("received_quantity", L, False),
        ("accepted_quantity", L, False),
        ("unit_cost", D, False),
        ("status", S, False),
    ),
}

# Primary keys, as declared by the relational schema.
PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "suppliers": ("supplier_id",),
    "products": ("product_id",),
    "warehouses": ("warehouse_id",),
    "weekly_sales": ("sales_id",),
    "inventory_batches": ("batch_id",),
    "purchase_orders": ("purchase_order_id",),
}

# Purchase-order status domain.
PO_STATUSES = ("Delivered", "Open", "Cancelled")
