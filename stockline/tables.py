"""The typed table bundle every operator takes as its first argument."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

TABLE_NAMES = (
    "suppliers",
    "products",
    "warehouses",
    "weekly_sales",
    "inventory_batches",
    "purchase_orders",
)


@dataclass(frozen=True)
class Tables:
    """Six normalized tables plus the business date (``as_of``).

    The reference keeps the business date in a one-row config table; here it is
    a job parameter that operators turn into a literal, so Catalyst folds it
    into filters instead of joining a one-row relation.
    """

    suppliers: DataFrame
    products: DataFrame
    warehouses: DataFrame
    weekly_sales: DataFrame
    inventory_batches: DataFrame
    purchase_orders: DataFrame
    as_of: dt.date

    def frames(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLE_NAMES}

    def with_as_of(self, as_of: dt.date | str) -> "Tables":
        return replace(self, as_of=to_date(as_of))


def to_date(value: dt.date | dt.datetime | str) -> dt.date:
    """Normalize a business date argument to a ``date`` (midnight, no zone)."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value)[:10])
