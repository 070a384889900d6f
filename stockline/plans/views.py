"""SQL access: the tables and derived views as temp views, parameterised queries.

``register_views`` exposes the six tables plus the four derived views under
the names users of the relational schema know (``v_inventory_health``,
``v_expiry_risk``, ``v_supplier_performance``, ``v_executive_kpis``).  The
views stay lazy DataFrames; Catalyst pushes filters written in SQL down into
them like any other plan.

``query`` runs SQL with named parameters (``:name`` markers) through
``spark.sql(..., args=...)`` — values are bound as literals, never pasted into
the text.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..functions.contracts import require_columns, require_views
from ..operators.expiry import expiry_risk
from ..operators.inventory import inventory_health
from ..operators.kpis import executive_kpis
from ..operators.suppliers import supplier_performance
from ..tables import Tables

VIEWS = {
    "v_inventory_health": inventory_health,
    "v_expiry_risk": expiry_risk,
    "v_supplier_performance": supplier_performance,
    "v_executive_kpis": executive_kpis,
}


#: Columns that pages select from the views by name.
VIEW_COLUMNS = {
    "v_inventory_health": ("expired_inventory_quantity", "on_order_quantity", "inventory_position"),
    "v_expiry_risk": ("days_to_expiry", "expiry_bucket", "inventory_value_at_risk"),
    "v_supplier_performance": ("on_time_delivery_pct", "acceptance_quality_pct", "fill_rate_pct"),
    "v_executive_kpis": (),
}


def check_view_columns(views: Mapping[str, DataFrame]) -> None:
    """Raise when a derived view or one of the columns read by name is missing."""
    require_views(views, VIEW_COLUMNS)
    for name, columns in VIEW_COLUMNS.items():
        require_columns(views[name], columns)


def register_views(t: Tables, prefix: str = "") -> list[str]:
    """Create or replace temp views for the tables and derived views."""
    names = []
    check_view_columns({name: build(t) for name, build in VIEWS.items()})
    for name, df in t.frames().items():
        df.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    for name, build in VIEWS.items():
        build(t).createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names


def query(spark: SparkSession, sql: str, params: Mapping[str, object] | None = None) -> DataFrame:
    """Run SQL over the registered views with named parameters."""
    return spark.sql(sql, args=dict(params or {}))
