"""Data-quality job: the relational constraints of the schema as Spark checks.

Output of ``dq_summary``: one row per rule ``(rule_id, family, table_name,
violations)``.  Row-level rules of a table (not null, ranges, cross-column,
date order, status) and its foreign keys come from **one scan** (``table_pass``);
primary keys and unique keys are one grouped count each.  ``quarantine`` returns
the offending rows of one rule.

A CHECK whose condition is NULL passes in SQL; ``count(when(~cond, 1))``
skips NULL conditions the same way.

``validate_tables`` is the fail-fast gate: it collects the (bounded, one row per
rule) summary and raises ``ValueError`` for the first failing rule, in the
order of the reference's loader.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import PO_STATUSES, PRIMARY_KEYS
from ..tables import TABLE_NAMES, Tables
from .inventory import inventory_health


@dataclass(frozen=True)
class RowRule:
    rule_id: str
    family: str
    table: str
    condition: str  # SQL predicate that must hold for a valid row

    def column(self) -> Column:
        return F.expr(self.condition)


NOT_NULL_COLUMNS: dict[str, tuple[str, ...]] = {
    "suppliers": ("supplier_name", "country", "contracted_lead_time_days"),
    "products": (
        "product_name", "therapeutic_area", "dosage_form", "strength", "primary_supplier_id",
        "unit_cost", "unit_price", "lead_time_days",
    ),
    "warehouses": ("warehouse_name", "city", "region"),
    "weekly_sales": (
        "week_start", "product_id", "warehouse_id", "demand_units", "units_sold", "lost_sales_units", "revenue",
    ),
    "inventory_batches": (
        "batch_number", "product_id", "warehouse_id", "manufacture_date", "expiry_date",
        "inventory_quantity", "reorder_point", "safety_stock", "last_count_date",
    ),
    "purchase_orders": (
        "supplier_id", "product_id", "warehouse_id", "order_date", "promised_delivery_date",
        "ordered_quantity", "received_quantity", "accepted_quantity", "unit_cost", "status",
    ),
}


def row_rules() -> list[RowRule]:
    """All row-level rules as SQL predicates (Columns are built only when used)."""
    rules: list[RowRule] = []
    for table, cols in NOT_NULL_COLUMNS.items():
        for c in cols:
            rules.append(RowRule(f"not_null.{table}.{c}", "not_null", table, f"{c} IS NOT NULL"))
    positive = {
        "suppliers": ("contracted_lead_time_days",),
        "products": ("unit_cost", "lead_time_days"),
        "purchase_orders": ("ordered_quantity", "unit_cost"),
    }
    non_negative = {
        "weekly_sales": ("demand_units", "units_sold", "lost_sales_units", "revenue"),
        "inventory_batches": ("inventory_quantity", "reorder_point", "safety_stock"),
        "purchase_orders": ("received_quantity", "accepted_quantity"),
    }
    for table, cols in positive.items():
        for c in cols:
            rules.append(RowRule(f"range.{table}.{c}_positive", "range", table, f"{c} > 0"))
    for table, cols in non_negative.items():
        for c in cols:
            rules.append(RowRule(f"range.{table}.{c}_non_negative", "range", table, f"{c} >= 0"))
    statuses = ", ".join(f"'{v}'" for v in PO_STATUSES)
    rules += [
        RowRule("cross.products.price_ge_cost", "cross_column", "products", "unit_price >= unit_cost"),
        RowRule("cross.weekly_sales.sold_le_demand", "cross_column", "weekly_sales", "units_sold <= demand_units"),
        RowRule("cross.weekly_sales.lost_eq_demand_minus_sold", "cross_column", "weekly_sales",
                "lost_sales_units = demand_units - units_sold"),
        RowRule("cross.purchase_orders.received_le_ordered", "cross_column", "purchase_orders",
                "received_quantity <= ordered_quantity"),
        RowRule("cross.purchase_orders.accepted_le_received", "cross_column", "purchase_orders",
                "accepted_quantity <= received_quantity"),
        RowRule("date.inventory_batches.expiry_after_manufacture", "date_order", "inventory_batches",
                "expiry_date > manufacture_date"),
        RowRule("date.purchase_orders.promised_on_or_after_order", "date_order", "purchase_orders",
                "promised_delivery_date >= order_date"),
        RowRule("date.purchase_orders.actual_on_or_after_order", "date_order", "purchase_orders",
                "actual_delivery_date IS NULL OR actual_delivery_date >= order_date"),
        RowRule("status.purchase_orders.domain", "status", "purchase_orders", f"status IN ({statuses})"),
        RowRule("status.purchase_orders.actual_date_iff_delivered", "status", "purchase_orders",
                "(status = 'Delivered' AND actual_delivery_date IS NOT NULL) "
                "OR (status IN ('Open', 'Cancelled') AND actual_delivery_date IS NULL)"),
    ]
    return rules


UNIQUE_RULES: list[tuple[str, str, tuple[str, ...]]] = [
    ("unique.suppliers.supplier_name", "suppliers", ("supplier_name",)),
    ("unique.products.product_name", "products", ("product_name",)),
    ("unique.warehouses.warehouse_name", "warehouses", ("warehouse_name",)),
    ("unique.weekly_sales.week_product_warehouse", "weekly_sales", ("week_start", "product_id", "warehouse_id")),
    ("unique.inventory_batches.batch_number_warehouse", "inventory_batches", ("batch_number", "warehouse_id")),
]

# (rule_id, child table, child column, parent table, parent column)
FOREIGN_KEYS: list[tuple[str, str, str, str, str]] = [
    ("fk.products.primary_supplier_id", "products", "primary_supplier_id", "suppliers", "supplier_id"),
    ("fk.weekly_sales.product_id", "weekly_sales", "product_id", "products", "product_id"),
    ("fk.weekly_sales.warehouse_id", "weekly_sales", "warehouse_id", "warehouses", "warehouse_id"),
    ("fk.inventory_batches.product_id", "inventory_batches", "product_id", "products", "product_id"),
    ("fk.inventory_batches.warehouse_id", "inventory_batches", "warehouse_id", "warehouses", "warehouse_id"),
    ("fk.purchase_orders.supplier_id", "purchase_orders", "supplier_id", "suppliers", "supplier_id"),
    ("fk.purchase_orders.product_id", "purchase_orders", "product_id", "products", "product_id"),
    ("fk.purchase_orders.warehouse_id", "purchase_orders", "warehouse_id", "warehouses", "warehouse_id"),
]


def _summary_row(rule_id: str, family: str, table: str, violations: str) -> list[str]:
    """SQL select items of one summary row (``violations`` is an expression)."""
    return [
        f"'{rule_id}' AS rule_id",
        f"'{family}' AS family",
        f"'{table}' AS table_name",
        f"CAST({violations} AS BIGINT) AS violations",
    ]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _duplicate_rows(df: DataFrame, cols: tuple[str, ...], rule_id: str, table: str) -> DataFrame:
    """Rows beyond the first per key value (what ``duplicated()`` flags), as a summary row."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).selectExpr(
        *_summary_row(rule_id, "unique", table, "coalesce(sum(_n - 1), 0)")
    )


def primary_key_counts(t: Tables) -> DataFrame:
    """B1/B2: empty tables, NULL keys and duplicated keys.

    One grouped count per table gives all three: NULL keys group together, the
    row total comes from the group sizes and duplicates are size - 1 per key.
    """
    frames = t.frames()
    parts = []
    for table in TABLE_NAMES:
        key = PRIMARY_KEYS[table]
        null_key = " OR ".join(f"{k} IS NULL" for k in key)
        sizes = frames[table].groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
        rows = "coalesce(sum(_n), 0)"
        nulls = f"coalesce(sum(CASE WHEN {null_key} THEN _n END), 0)"
        dups = f"coalesce(sum(CASE WHEN NOT ({null_key}) THEN _n - 1 END), 0)"
        pk_rule = f"pk.{table}.{'_'.join(key)}"
        # a global aggregate yields one row even for an empty table
        parts.append(sizes.selectExpr(
            f"stack(2, 'non_empty.{table}', 'non_empty', '{table}', CAST(CASE WHEN {rows} = 0 THEN 1 ELSE 0 END AS BIGINT), "
            f"'{pk_rule}', 'primary_key', '{table}', CAST({nulls} + {dups} AS BIGINT)) "
            "AS (rule_id, family, table_name, violations)"
        ))
    return _union(parts)


def unique_counts(t: Tables) -> DataFrame:
    """Duplicated rows per UNIQUE constraint (rows with a NULL part skipped)."""
    frames = t.frames()
    parts = []
    for rule_id, table, cols in UNIQUE_RULES:
        df = frames[table].select(*cols).where(" AND ".join(f"{c} IS NOT NULL" for c in cols))
        parts.append(_duplicate_rows(df, cols, rule_id, table))
    return _union(parts)


def _orphans(t: Tables, child: str, ccol: str, parent: str, pcol: str) -> DataFrame:
    frames = t.frames()
    kids = frames[child].where(F.col(ccol).isNotNull())
    keys = frames[parent].select(F.col(pcol).alias("_parent_key")).where(F.col("_parent_key").isNotNull())
    return kids.join(keys, F.col(ccol) == F.col("_parent_key"), "left_anti")


def _refused(rule: RowRule) -> str:
    """Predicate of rows that the load refuses under a row rule.

    A CHECK lets a NULL condition pass; the load does not: a missing operand
    means that the comparison does not hold.  A purchase order whose status is
    outside the domain fails the domain rule, not the one on its dates.
    """
    failed = f"NOT coalesce({rule.condition}, FALSE)"
    if rule.family == "status":
        failed += f" AND (status IS NULL OR status IN ({', '.join(repr(v) for v in PO_STATUSES)}))"
    return failed


def table_pass(
    t: Tables, table: str, families: tuple[str, ...] = (), only: set[str] | None = None, refused: bool = False
) -> DataFrame | None:
    """B4-B9 for one table: its foreign keys and row rules from one scan.

    ``refused`` adds, in the same scan, a row of family ``load`` for each rule of
    the load's gate: the rows that the load refuses (``_refused``).

    Rows are counted per combination of the foreign-key columns, with the
    violations of every row rule beside them (partial aggregation before the
    shuffle, so a hot key reaches the joins as one row per map task).  The
    combinations are joined to the parents' distinct keys, and one global
    aggregate gives all summary rows.
    """
    frames = t.frames()
    wanted = lambda family, rule: family in families and (only is None or rule in only)
    keys = [k for k in FOREIGN_KEYS if k[1] == table and wanted("foreign_key", k[0])]
    rules = [r for r in row_rules() if r.table == table and wanted(r.family, r.rule_id)]
    if not keys and not rules:
        return None
    checks = [(r.rule_id, r.family, f"NOT ({r.condition})") for r in rules]
    if refused:
        gate_ids = {rule_id for rule_id, _ in GATE}
        checks += [(r.rule_id, "load", _refused(r)) for r in row_rules() if r.table == table and r.rule_id in gate_ids]
    broken = [f"count(CASE WHEN {failed} THEN 1 END)" for *_, failed in checks]
    entries = [f"'{rule_id}', '{family}', '{table}', CAST({n} AS BIGINT)" for (rule_id, family, _), n in zip(checks, broken)]
    source = frames[table]
    if keys:
        columns = list(dict.fromkeys(k[2] for k in keys))
        source = source.groupBy(*columns).agg(F.expr("count(1)").alias("_rows"), *[F.expr(n).alias(f"_v{i}") for i, n in enumerate(broken)])
        entries = [f"'{rule_id}', '{family}', '{table}', CAST(coalesce(sum(_v{i}), 0) AS BIGINT)" for i, (rule_id, family, _) in enumerate(checks)]
        for i, (rule_id, _, column, parent, parent_column) in enumerate(keys):
            known = frames[parent].select(F.col(parent_column).alias(f"_p{i}")).where(F.col(f"_p{i}").isNotNull()).distinct()
            source = source.join(known, F.col(column) == F.col(f"_p{i}"), "left")
            orphans = f"coalesce(sum(CASE WHEN {column} IS NOT NULL AND _p{i} IS NULL THEN _rows END), 0)"
            entries.append(f"'{rule_id}', 'foreign_key', '{table}', CAST({orphans} AS BIGINT)")
    return source.selectExpr(f"stack({len(entries)}, {', '.join(entries)}) AS (rule_id, family, table_name, violations)")


def row_and_key_counts(t: Tables, families: tuple[str, ...], only: set[str] | None = None, refused: bool = False) -> DataFrame:
    """``table_pass`` of every table."""
    return _union([p for p in (table_pass(t, table, families, only, refused) for table in TABLE_NAMES) if p is not None])


ROW_FAMILIES = ("not_null", "range", "cross_column", "date_order", "status")
FAMILIES = ("non_empty", "primary_key", "unique", "foreign_key", *ROW_FAMILIES)


def dq_summary(t: Tables, families: tuple[str, ...] | None = None) -> DataFrame:
    """Rules of the given families (all by default): (rule_id, family, table_name,
    violations).  Only the requested checks are planned, so a single family
    costs one pass over the tables it touches."""
    wanted = set(families or FAMILIES)
    unknown = wanted - set(FAMILIES)
    if unknown:
        raise ValueError(f"Unknown rule families: {sorted(unknown)}")
    parts = []
    if wanted & {"non_empty", "primary_key"}:
        parts.append(primary_key_counts(t).where(F.col("family").isin(*wanted)))
    if "unique" in wanted:
        parts.append(unique_counts(t))
    scanned = tuple(f for f in ("foreign_key", *ROW_FAMILIES) if f in wanted)
    if scanned:
        parts.append(row_and_key_counts(t, scanned))
    return reduce(DataFrame.unionByName, parts)


def quarantine(t: Tables, rule_id: str) -> DataFrame:
    """Rows violating one rule (for PK/unique: all rows of a duplicated key)."""
    frames = t.frames()
    for r in row_rules():
        if r.rule_id == rule_id:
            return frames[r.table].where(~r.column())
    for rid, child, ccol, parent, pcol in FOREIGN_KEYS:
        if rid == rule_id:
            return _orphans(t, child, ccol, parent, pcol)
    keyed = [(rid, tbl, cols) for rid, tbl, cols in UNIQUE_RULES] + [
        (f"pk.{tbl}.{'_'.join(k)}", tbl, k) for tbl, k in PRIMARY_KEYS.items()
    ]
    for rid, table, cols in keyed:
        if rid == rule_id:
            df = frames[table]
            dup_keys = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
            null_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
            bad = df.join(dup_keys, list(cols), "left_semi")
            return bad.unionByName(df.where(null_key)) if rid.startswith("pk.") else bad
    raise KeyError(f"Unknown rule: {rule_id}")


def reconciliation(t: Tables) -> DataFrame:
    """Batch units vs usable + expired in the health view; open PO units
    vs on-order units in the health view.  One row, two flags."""
    batches = t.inventory_batches.agg(F.sum("inventory_quantity").cast("bigint").alias("batch_units"))
    health = inventory_health(t).agg(
        F.sum(F.col("inventory_quantity") + F.col("expired_inventory_quantity")).cast("bigint").alias("reconciled_units"),
        F.sum("on_order_quantity").cast("bigint").alias("view_on_order_units"),
    )
    open_po = t.purchase_orders.where(F.col("status") == "Open").agg(
        F.sum(F.col("ordered_quantity") - F.col("received_quantity")).cast("bigint").alias("open_po_units")
    )
    return (
        batches.crossJoin(F.broadcast(health))
        .crossJoin(F.broadcast(open_po))
        .select(
            "batch_units",
            "reconciled_units",
            "open_po_units",
            "view_on_order_units",
            (F.col("batch_units") == F.col("reconciled_units")).alias("stock_reconciles"),
            (F.coalesce(F.col("open_po_units"), F.lit(0)) == F.coalesce(F.col("view_on_order_units"), F.lit(0))).alias(
                "on_order_reconciles"
            ),
        )
    )


# Fail-fast order and messages of the reference's loader (fixed values).
GATE: list[tuple[str, str]] = (
    [(f"non_empty.{tbl}", f"{tbl} is empty") for tbl in PRIMARY_KEYS]
    + [(f"pk.{tbl}.{'_'.join(k)}", f"Invalid primary key in {tbl}.{'_'.join(k)}") for tbl, k in PRIMARY_KEYS.items()]
    + [
        ("fk.products.primary_supplier_id", "Products contain unknown suppliers"),
        ("cross.weekly_sales.sold_le_demand", "Units sold cannot exceed demand"),
        ("cross.weekly_sales.lost_eq_demand_minus_sold", "Lost sales must equal demand minus fulfilled units"),
        ("cross.purchase_orders.accepted_le_received", "Accepted quantity cannot exceed received quantity"),
        ("status.purchase_orders.actual_date_iff_delivered",
         "Only delivered purchase orders may have an actual delivery date"),
        ("date.inventory_batches.expiry_after_manufacture", "Expiry date must follow manufacture date"),
    ]
)


def validate_tables(t: Tables, scope: str = "loader") -> None:
    """Raise ``ValueError`` for the first failing rule.

    ``scope="loader"`` checks the rules the reference's loader checks, in its
    order (the interleaving of empty and key checks per table is kept).
    ``scope="all"`` then also enforces every schema constraint of
    ``dq_summary`` (message ``Constraint violated: <rule_id> (<n> rows)``).
    """
    everything = scope == "all"
    keyed = [primary_key_counts(t), *([unique_counts(t)] if everything else [])]
    only = None if everything else {rule_id for rule_id, _ in GATE}
    rows = _union([*keyed, row_and_key_counts(t, ("foreign_key", *ROW_FAMILIES), only, refused=True)]).collect()
    # under a rule of the gate, what the load refuses is what counts
    counts = {r["rule_id"]: r["violations"] for r in sorted(rows, key=lambda r: r["family"] == "load")}
    ordered = []
    for tbl, k in PRIMARY_KEYS.items():
        ordered.append((f"non_empty.{tbl}", f"{tbl} is empty"))
        ordered.append((f"pk.{tbl}.{'_'.join(k)}", f"Invalid primary key in {tbl}.{'_'.join(k)}"))
    ordered += GATE[2 * len(PRIMARY_KEYS):]
    for rule_id, message in ordered:
        if counts.get(rule_id, 0):
            raise ValueError(message)
    if scope == "all":
        for rule_id in sorted(counts):
            if counts[rule_id]:
                raise ValueError(f"Constraint violated: {rule_id} ({counts[rule_id]} rows)")
