"""stockline: supply-chain inventory, expiry, supplier, demand and forecast
analytics as Spark DataFrame operators.

Every operator is ``f(tables: Tables, **params) -> DataFrame``; see
``stockline.plans.catalog`` for the registered queries.
"""

from .tables import TABLE_NAMES, Tables

__all__ = ["TABLE_NAMES", "Tables"]
