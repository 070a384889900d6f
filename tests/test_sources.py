"""Readers, sinks, publish gate and the star-schema projection."""

from __future__ import annotations

import tempfile
from pathlib import Path

import pytest

from fixtures import D, tiny_tables
from stockline.sources import files, mart
from stockline.tables import TABLE_NAMES


def _tmp() -> str:
    return tempfile.mkdtemp(prefix="stockline-test-")


def test_csv_roundtrip_keeps_schema(spark):
    t = tiny_tables(spark)
    root = files.write_tables(t, _tmp(), fmt="csv")
    back = files.read_tables(spark, root, t.as_of, fmt="csv")
    for name in TABLE_NAMES:
        assert back.frames()[name].schema.simpleString() == t.frames()[name].schema.simpleString()
        assert sorted(back.frames()[name].collect()) == sorted(t.frames()[name].collect())


def test_parquet_publish_roundtrip_and_partitioning(spark):
    t = tiny_tables(spark)
    snapshot = files.publish_tables(t, _tmp())
    assert any(p.name.startswith("sales_month=") for p in Path(snapshot, "weekly_sales").iterdir())
    back = files.read_published(spark, snapshot, t.as_of)
    assert back.weekly_sales.columns == t.weekly_sales.columns + ["sales_month"]
    assert back.weekly_sales.count() == t.weekly_sales.count()


def test_publish_refuses_invalid_tables(spark):
    bad = tiny_tables(spark, weekly_sales=[(1, D("2026-06-29"), "P1", "W1", 10, 12, -2, 1.0)])
    root = _tmp()
    with pytest.raises(ValueError, match="Units sold cannot exceed demand"):
        files.publish_tables(bad, root)
    assert not any(Path(root).iterdir())


SALE = (1, D("2026-06-29"), "P1", "W1", 10, 8, 2, 1.0)


@pytest.mark.parametrize(
    "rows",
    [
        {"weekly_sales": [SALE, (2, D("2026-07-06"), "P9", "W1", 10, 8, 2, 1.0)]},  # unknown product
        {"weekly_sales": [SALE, (2, D("2026-07-06"), "P1", "W9", 10, 8, 2, 1.0)]},  # unknown warehouse
        {"weekly_sales": [SALE, (2, *SALE[1:])]},  # week, product and warehouse twice
        {"weekly_sales": [(1, D("2026-06-29"), "P1", "W1", 10, 8, 2, -1.0)]},  # negative revenue
        {"warehouses": [("W1", "West", "Reno", "West"), ("W2", "West", "Allentown", "East")]},  # name twice
    ],
)
def test_publish_refuses_what_the_schema_forbids(spark, rows):
    root = _tmp()
    with pytest.raises(ValueError, match="Constraint violated"):
        files.publish_tables(tiny_tables(spark, **rows), root)
    assert not any(Path(root).iterdir())


def test_a_missing_operand_fails_the_gate(spark):
    from dataclasses import replace

    from pyspark.sql import functions as F

    t = tiny_tables(spark)
    no_units = replace(t, weekly_sales=t.weekly_sales.withColumn("units_sold", F.lit(None).cast("bigint")))
    with pytest.raises(ValueError, match="Units sold cannot exceed demand|Lost sales must equal"):
        files.publish_tables(no_units, _tmp())
    no_status = replace(t, purchase_orders=t.purchase_orders.withColumn("status", F.when(F.col("purchase_order_id") != "PO1", F.col("status"))))
    with pytest.raises(ValueError, match="Only delivered purchase orders"):
        files.publish_tables(no_status, _tmp())
    lost = replace(t, purchase_orders=t.purchase_orders.withColumn("status", F.when(F.col("purchase_order_id") == "PO3", F.lit("Lost")).otherwise(F.col("status"))))
    with pytest.raises(ValueError, match="status.purchase_orders.domain"):
        files.publish_tables(lost, _tmp())


def test_only_recorded_snapshots_are_found(spark):
    t, root = tiny_tables(spark), _tmp()
    first = files.publish_tables(t, root)
    files.write_tables(t, f"{root}/snapshot-halfway")  # a publish that died before its record
    assert files.latest_snapshot(spark, root) == first
    second = files.publish_tables(t, root)
    assert files.latest_snapshot(spark, root) == second != first


def test_malformed_csv_value_is_an_error(spark):
    root = Path(_tmp())
    (root / "suppliers.csv").write_text("supplier_id,supplier_name,country,contracted_lead_time_days\nS1,One,US,abc\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_table(spark, str(root / "suppliers.csv"), "suppliers", fmt="csv").collect()


def test_missing_frame_is_reported():
    with pytest.raises(ValueError, match="Missing required data frames: purchase_orders"):
        files.require_frames({n: None for n in TABLE_NAMES if n != "purchase_orders"})


def test_csv_header_mismatch_is_an_error(spark):
    root = Path(_tmp())
    (root / "warehouses.csv").write_text("id,name,city,region\nW1,West,Reno,West\n")
    with pytest.raises(Exception):
        files.read_table(spark, str(root / "warehouses.csv"), "warehouses", fmt="csv").collect()


def test_projection_sizes(spark, sf_dir):
    t = mart.build_tables(spark, sf_dir)
    counts = {n: df.count() for n, df in t.frames().items()}
    assert counts["warehouses"] == 5
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n_lines = lines.count()
    assert counts["inventory_batches"] + counts["purchase_orders"] == n_lines
    staged = mart.build_tables(spark, sf_dir, stage_dir=_tmp() + "/lines")
    assert staged.purchase_orders.count() == counts["purchase_orders"]


def test_published_snapshot_gives_same_results(spark, sf_dir):
    """Trailing-window queries add a partition predicate on snapshots only."""
    from oracle_check import normalize

    from stockline.plans.catalog import SPARK_QUERIES

    lazy = mart.build_tables(spark, sf_dir)
    snap = files.read_published(spark, files.write_tables(lazy, _tmp()), lazy.as_of)
    for key in ("recent_demand", "current_service", "inventory_health", "executive_kpis"):
        a, b = SPARK_QUERIES[key](lazy), SPARK_QUERIES[key](snap)
        assert normalize(a.collect(), a.columns) == normalize(b.collect(), b.columns), key


def test_registered_queries_read_the_published_snapshot(spark, sf_dir):
    t = mart.load(spark, sf_dir)
    assert mart.load(spark, sf_dir) is t  # one publish per session and folder
    for df in t.frames().values():
        files_read = df.inputFiles()
        assert files_read and all("/snapshot-" in f for f in files_read)
    assert "sales_month" in t.weekly_sales.columns  # month folders for pruning
