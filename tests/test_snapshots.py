"""Publish protocol, CSV quarantine and the fingerprint of source files."""

from __future__ import annotations

import shutil
import tempfile
import threading
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fixtures import D, frame, tiny_tables
from stockline.operators import quality, suppliers
from stockline.sources import files, mart, snapshots, stores
from stockline.sources.schemas import SCHEMAS
from stockline.tables import TABLE_NAMES


def _tmp() -> str:
    return tempfile.mkdtemp(prefix="stockline-test-")


def test_versions_are_numbered_and_read_with_their_schemas(spark):
    t, root = tiny_tables(spark), _tmp()
    first = snapshots.publish(t, root)
    second = snapshots.publish(t.with_as_of("2026-10-04"), root)
    assert (first.number, second.number) == (1, 2)
    assert [v.number for v in snapshots.versions(spark, root)] == [1, 2]
    assert files.latest_snapshot(spark, root) == second.path
    assert snapshots.read(spark, root).as_of == D("2026-10-04")
    old = snapshots.read(spark, root, 1)
    assert old.as_of == t.as_of
    for name in TABLE_NAMES:
        own = old.frames()[name].drop("sales_month")
        assert [(f.name, f.dataType) for f in own.schema] == [(f.name, f.dataType) for f in SCHEMAS[name]]
        assert sorted(own.collect()) == sorted(t.frames()[name].collect())


def test_latest_version_does_not_depend_on_clocks(spark):
    import os

    root = _tmp()
    snapshots.publish(tiny_tables(spark), root)
    last = snapshots.publish(tiny_tables(spark), root)
    for p in Path(root, "versions").glob("*2.json"):
        os.utime(p, (1, 1))  # as if the second were far older
    assert snapshots.latest(spark, root) == last


def test_two_publishers_cannot_both_win(spark):
    t, root = tiny_tables(spark), _tmp()
    winner = snapshots.publish(t, root, base=0)
    with pytest.raises(snapshots.PublishConflict, match="Version 1 "):
        snapshots.publish(t, root, base=0)
    assert [v.path for v in snapshots.versions(spark, root)] == [winner.path]
    (orphan,) = snapshots.orphans(spark, root)
    assert orphan != winner.path and Path(orphan, "products").exists()
    assert snapshots.publish(t, root).number == 2


def test_only_one_of_many_claims_is_granted(spark):
    path, won = f"{_tmp()}/versions/1.json", []
    claims = [threading.Thread(target=lambda i=i: won.append(i) if stores.create_new(spark, path, str(i)) else None) for i in range(8)]
    for c in claims:
        c.start()
    for c in claims:
        c.join()
    assert len(won) == 1 and Path(path).read_text() == str(won[0])


def test_a_claim_without_content_is_skipped_and_not_used_again(spark):
    root = _tmp()
    first = snapshots.publish(tiny_tables(spark), root)
    Path(root, "versions", f"{2:020d}.json").write_text("")
    assert snapshots.latest(spark, root) == first
    assert snapshots.publish(tiny_tables(spark), root).number == 3


def test_nothing_published_is_an_error(spark):
    root = _tmp()
    assert snapshots.versions(spark, root) == [] and snapshots.orphans(spark, root) == []
    with pytest.raises(FileNotFoundError):
        snapshots.latest(spark, root)


def test_what_is_published_is_what_was_gated(spark, monkeypatch):
    """The source changes between gate and publish; the published rows are the gated ones."""
    source, root = _tmp(), _tmp()
    good = tiny_tables(spark)
    good.weekly_sales.write.mode("overwrite").parquet(f"{source}/sales")
    t = replace(good, weekly_sales=spark.read.schema(SCHEMAS["weekly_sales"]).parquet(f"{source}/sales"))
    gate = quality.validate_tables
    seen = []

    def gate_then_change(tables, scope):
        gate(tables, scope)
        seen.append(tables.weekly_sales.count())
        frame(spark, "weekly_sales", [(99, D("2026-06-29"), "P9", "W9", 1, 5, -4, -1.0)]).write.mode("append").parquet(f"{source}/sales")

    monkeypatch.setattr(quality, "validate_tables", gate_then_change)
    version = snapshots.publish(t, root)
    assert spark.read.parquet(f"{source}/sales").count() == seen[0] + 1
    published = snapshots.read(spark, root, version.number).weekly_sales
    assert published.count() == seen[0] and published.where("product_id = 'P9'").isEmpty()


def test_the_gate_scans_each_table_once_for_its_row_rules(spark):
    t = tiny_tables(spark)
    for name in TABLE_NAMES:
        plan = quality.table_pass(t, name, ("foreign_key", *quality.ROW_FAMILIES), refused=True)
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        own = [c for c in SCHEMAS[name].fieldNames() if c.endswith("quantity") or c in ("revenue", "unit_price")]
        assert sum("LogicalRDD" in line and any(c in line for c in own) for line in text.splitlines()) <= 1
    rows = quality.row_and_key_counts(t, quality.ROW_FAMILIES, refused=True).collect()
    assert {r["rule_id"] for r in rows if r["family"] == "load"} == {r for r, _ in quality.GATE if r.split(".")[0] in ("cross", "status", "date")}


def _csv(tables):
    root = files.write_tables(tables, _tmp(), fmt="csv")
    return root


def test_one_bad_row_of_a_thousand(spark):
    root = _csv(tiny_tables(spark))
    lines = ["supplier_id,supplier_name,country,contracted_lead_time_days", *(f"S{i},Name {i},US,{10 + i % 9}" for i in range(1000))]
    lines[500] = "S499,Name 499,US,soon"
    shutil.rmtree(f"{root}/suppliers.csv")
    Path(root, "suppliers.csv").write_text("\n".join(lines) + "\n")
    with pytest.raises(ValueError, match="suppliers: 1 malformed rows, 0 allowed"):
        files.load_csv(spark, root, "2026-09-27")
    found = files.load_csv(spark, root, "2026-09-27", max_rejected={"suppliers": 1})
    assert (found.accepted_rows["suppliers"], found.rejected_rows["suppliers"]) == (999, 1)
    assert found.tables.suppliers.count() == 999
    assert found.tables.suppliers.select("supplier_id").count() == 999  # fewer columns, same rows
    assert [tuple(r) for r in found.quarantine().collect()] == [("suppliers", "S499,Name 499,US,soon")]
    assert found.tables.suppliers.schema.simpleString() == SCHEMAS["suppliers"].simpleString()


@pytest.mark.parametrize("line", ["S1,One,US", "S1,One,US,1,extra", "S1,One,US,1.5"])
def test_kinds_of_malformed_rows(spark, line):
    path = Path(_tmp(), "suppliers.csv")
    path.write_text(f"supplier_id,supplier_name,country,contracted_lead_time_days\nS0,Zero,US,1\n{line}\n")
    rows = files.split_csv(spark, str(path), "suppliers", _tmp() + "/out")
    assert [r["_corrupt_record"] for r in rows.where("_rejected").collect()] == [line]
    assert [r["supplier_id"] for r in rows.where("NOT _rejected").collect()] == ["S0"]


def test_malformed_dates_and_empty_tables(spark):
    path = Path(_tmp(), "weekly_sales.csv")
    head = "sales_id,week_start,product_id,warehouse_id,demand_units,units_sold,lost_sales_units,revenue\n"
    path.write_text(head + "1,2026-13-01,P1,W1,1,1,0,1.0\n2,2026-01-05,P1,W1,1,1,0,1.0\n3,,P1,W1,1,1,0,1.0\n")
    rows = files.split_csv(spark, str(path), "weekly_sales", _tmp() + "/out")
    assert {r["sales_id"]: r["_rejected"] for r in rows.collect()} == {1: True, 2: False, 3: False}
    path.write_text(head)
    rows = files.split_csv(spark, str(path), "weekly_sales", _tmp() + "/out")
    assert rows.count() == 0


def test_fingerprint_sees_added_removed_and_rewritten_files(spark):
    root = Path(_tmp())
    (root / "t").mkdir()
    (root / "t" / "a.parquet").write_text("one")
    paths = [str(root / "t"), str(root / "missing")]
    states = [stores.fingerprint(spark, paths)]
    assert stores.fingerprint(spark, paths) == states[0]
    (root / "t" / "_SUCCESS").write_text("")
    assert stores.fingerprint(spark, paths) == states[0]
    (root / "t" / "b.parquet").write_text("two")
    states.append(stores.fingerprint(spark, paths))
    (root / "t" / "b.parquet").write_text("other")
    states.append(stores.fingerprint(spark, paths))
    (root / "t" / "b.parquet").rename(root / "t" / "c.parquet")
    states.append(stores.fingerprint(spark, paths))
    assert len(set(states)) == 4


def test_queries_see_rewritten_source_files(spark, sf_dir):
    from stockline.plans.catalog import queries

    source = Path(_tmp(), "data")
    shutil.copytree(sf_dir, source)
    counts = lambda: {r["table_name"]: r["row_count"] for r in queries()["table_counts"](spark, str(source)).collect()}
    naive = lambda: queries()["forecast_recent_history"](spark, str(source)).count()
    fit = lambda: queries()["ridge_moments"](spark, str(source)).count()
    before, history, fits = counts(), naive(), fit()
    assert counts() == before
    lines = spark.read.parquet(str(source / "lineitem.parquet")).limit(100).toPandas()
    lines.to_parquet(source / "lineitem.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    after = counts()
    assert after["inventory_batches"] + after["purchase_orders"] == 100 and after["weekly_sales"] <= 100 < before["weekly_sales"]
    assert naive() < history and fit() < fits


def test_lead_time_is_the_mean_of_dated_deliveries(spark):
    """A delivered order without a date (rule B9 reports it) does not pull the mean down."""
    orders = [
        ("PO1", "S1", "P1", "W1", D("2026-01-01"), D("2026-01-10"), D("2026-01-11"), 10, 10, 10, 2.5, "Delivered"),
        ("PO2", "S1", "P1", "W1", D("2026-01-01"), D("2026-01-10"), D("2026-01-21"), 10, 10, 10, 2.5, "Delivered"),
        ("PO3", "S1", "P1", "W1", D("2026-01-01"), D("2026-01-10"), None, 10, 10, 10, 2.5, "Delivered"),
        ("PO4", "S2", "P2", "W2", D("2026-01-01"), D("2026-01-10"), None, 10, 10, 10, 2.5, "Delivered"),
    ]
    rows = {r["supplier_id"]: r for r in suppliers.supplier_performance(tiny_tables(spark, purchase_orders=orders)).collect()}
    assert rows["S1"]["actual_lead_time_days"] == 15.0 and rows["S1"]["delivered_orders"] == 3
    assert rows["S2"]["actual_lead_time_days"] is None and rows["S2"]["delivered_orders"] == 1
