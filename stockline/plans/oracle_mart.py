"""The mart projection written as DuckDB SQL CTEs (the oracle's own build).

Independent SQL text for the rules in ``sources/mart.py``; every oracle query
starts with ``MART`` and adds its own CTEs after it.
"""

from __future__ import annotations

AS_OF_SQL = "DATE '2001-11-04'"

MART = f"""
WITH
sup_count AS (SELECT count(*) AS n FROM supplier),
products AS (
    SELECT p_partkey AS product_id, p_name AS product_name, p_type AS therapeutic_area,
           p_brand AS dosage_form, CAST(p_size AS VARCHAR) || ' units' AS strength,
           p_partkey % (SELECT n FROM sup_count) AS primary_supplier_id,
           CAST(round(CAST(p_retailprice AS DECIMAL(18,4)) * 0.4, 2) AS DOUBLE) AS unit_cost,
           p_retailprice AS unit_price,
           14 + p_size AS lead_time_days
    FROM part
),
warehouses AS (
    SELECT r_regionkey AS warehouse_id, r_name AS warehouse_name, r_name AS city, r_name AS region
    FROM region
),
suppliers AS (
    SELECT s_suppkey AS supplier_id, s_name AS supplier_name, n_name AS country,
           28 + s_suppkey % 22 AS contracted_lead_time_days
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
),
base_lines AS (
    SELECT l.*, CAST(l_shipdate AS DATE) AS d, n.n_regionkey AS warehouse_id
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey
),
sales_grouped AS (
    SELECT CAST(date_trunc('week', d) AS DATE) AS week_start, l_partkey AS product_id, warehouse_id,
           CAST(sum(l_quantity) AS BIGINT) AS demand_units,
           CAST(sum(CASE WHEN l_returnflag = 'R' THEN floor(l_quantity * l_discount) ELSE 0 END) AS BIGINT)
               AS lost_sales_units
    FROM base_lines
    GROUP BY 1, 2, 3
),
weekly_sales AS (
    SELECT CAST((g.product_id * 65536 + g.warehouse_id) * 65536
                + floor(datediff('day', DATE '1970-01-05', g.week_start) / 7) AS BIGINT) AS sales_id,
           g.week_start, g.product_id, g.warehouse_id, g.demand_units,
           g.demand_units - g.lost_sales_units AS units_sold,
           g.lost_sales_units,
           CAST(round(CAST(p.unit_price AS DECIMAL(18,4)) * (g.demand_units - g.lost_sales_units), 2) AS DOUBLE)
               AS revenue
    FROM sales_grouped g JOIN products p ON p.product_id = g.product_id
),
line_parts AS (
    SELECT b.*, p.unit_cost, p.lead_time_days AS lead,
           concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
                     CAST(l_suppkey AS VARCHAR), CAST(d AS VARCHAR)) AS line_key
    FROM base_lines b JOIN products p ON p.product_id = b.l_partkey
),
inventory_batches AS (
    SELECT line_key AS batch_id,
           'B' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS batch_number,
           l_partkey AS product_id, warehouse_id,
           d AS manufacture_date,
           CAST(d + INTERVAL (365 + 40 * (lead - 14)) DAY AS DATE) AS expiry_date,
           CAST(l_quantity AS BIGINT) AS inventory_quantity,
           CAST(5 + l_partkey % 20 + (lead - 14) AS BIGINT) AS reorder_point,
           CAST(5 + l_partkey % 20 AS BIGINT) AS safety_stock,
           {AS_OF_SQL} AS last_count_date
    FROM line_parts WHERE l_returnflag = 'N'
),
po_status AS (
    SELECT *,
           CASE WHEN d > CAST({AS_OF_SQL} - INTERVAL (CAST(floor(lead * 50 / 100) AS INTEGER)) DAY AS DATE)
                THEN 'Open'
                WHEN l_orderkey % 25 = 0 THEN 'Cancelled'
                ELSE 'Delivered' END AS status,
           CAST(d + INTERVAL (lead) DAY AS DATE) AS promised,
           CAST(l_quantity AS BIGINT) AS qty
    FROM line_parts WHERE l_returnflag IN ('A', 'R')
),
purchase_orders AS (
    SELECT 'PO-' || line_key AS purchase_order_id,
           l_suppkey AS supplier_id, l_partkey AS product_id, warehouse_id,
           d AS order_date,
           promised AS promised_delivery_date,
           CASE WHEN status = 'Delivered' THEN
               CAST(promised + INTERVAL (CASE WHEN l_tax <= 0.05 THEN -(l_orderkey % 4)
                                              ELSE 1 + l_orderkey % 10 END) DAY AS DATE)
           END AS actual_delivery_date,
           20 * qty AS ordered_quantity,
           CASE WHEN status = 'Delivered' THEN 20 * qty - qty * (l_orderkey % 2) ELSE 0 END AS received_quantity,
           CASE WHEN status = 'Delivered' THEN 20 * qty - qty * (l_orderkey % 2) - qty * (l_partkey % 2) ELSE 0 END
               AS accepted_quantity,
           unit_cost,
           status
    FROM po_status
)"""


def with_mart(body: str) -> str:
    """``body`` is ``name AS (...), ... SELECT ...`` or a bare ``SELECT``."""
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return f"{MART}\n{body}"
    return f"{MART},\n{body}"
