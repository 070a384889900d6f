"""State that adds up load by load, and the bucketed layout, against whole-table results."""

from __future__ import annotations

import datetime as dt
import tempfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fixtures import D, tiny_tables
from stockline.functions import ridge
from stockline.operators import forecast, inventory, moments, quality, quality_state, rollup
from stockline.sources import bucketed, files
from stockline.sources.stores import file_sizes


def _tmp() -> str:
    return tempfile.mkdtemp(prefix="stockline-test-")


def _rows(df):
    """Sorted rows; floating sums depend on the order of rows in their last digits."""
    plain = lambda v: float(f"{v:.12g}") if isinstance(v, float) else v
    return sorted((tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def faulty(spark):
    """Rules broken inside a month, across months, and through missing parents."""
    sale = lambda i, week, product="P1", units=(10, 8, 2), revenue=1.0: (i, D(week), product, "W1", *units, revenue)
    sales = [
        sale(1, "2026-06-01"), sale(2, "2026-06-08"), sale(2, "2026-07-06"),  # key 2 in two months
        sale(4, "2026-07-13"), sale(5, "2026-07-13"),  # a week twice
        sale(6, "2026-08-03", "P9"), sale(7, "2026-08-10", units=(10, 12, -2), revenue=-1.0), sale(8, "2026-06-01"),
    ]
    t = tiny_tables(spark, weekly_sales=sales)
    extra = t.purchase_orders.where("purchase_order_id = 'PO1'").withColumn("order_date", F.lit(D("2026-09-01")))
    null = t.purchase_orders.limit(1).withColumn("supplier_id", F.lit(None).cast("string")).withColumn("purchase_order_id", F.lit(None).cast("string"))
    return replace(t, purchase_orders=t.purchase_orders.unionByName(extra).unionByName(null))


def test_states_add_up(faulty):
    before, after = quality_state.split_by_month(faulty, "2026-07-01")
    whole = quality_state.measure(faulty)
    parts = quality_state.merge(quality_state.measure(before), quality_state.measure(after))
    assert _rows(parts.keys) == _rows(whole.keys)
    # a load without rows of a table has no row for it, as the whole has none
    assert _rows(parts.counts) == _rows(whole.counts)


@pytest.mark.parametrize("month", ["2026-01-01", "2026-07-01", "2026-08-01", "2030-01-01"])
def test_merged_state_is_the_summary(faulty, month):
    states = [quality_state.measure(x) for x in quality_state.split_by_month(faulty, month)]
    got = quality_state.evaluate(quality_state.merge(*states))
    want = quality.dq_summary(faulty)
    assert _rows(got) == _rows(want)
    assert sum(r["violations"] > 0 for r in want.collect()) >= 8


def test_a_load_saved_twice_counts_once_and_only_loads_are_read(spark, faulty):
    root = _tmp()
    before, after = (quality_state.measure(x) for x in quality_state.split_by_month(faulty, "2026-07-01"))
    quality_state.save(before, root, "history")
    for _ in range(2):
        quality_state.save(after, root, "2026-07")
    result = quality_state.evaluate(quality_state.read(spark, root))
    assert _rows(result) == _rows(quality.dq_summary(faulty))
    assert all("/load=" in f for f in quality_state.read(spark, root).keys.inputFiles())


def test_only_keys_of_tables_referred_to_are_joined(spark, faulty, capsys):
    root = _tmp()
    quality_state.save(quality_state.measure(faulty), root, "all")
    capsys.readouterr()
    quality_state.evaluate(quality_state.read(spark, root)).explain("formatted")
    scans = [x for x in capsys.readouterr().out.split("\n") if "PushedFilters" in x and "rule_id" in x]
    referred = [x for x in scans if "pk.products.product_id" in x]
    assert referred and all("pk.weekly_sales" not in x for x in referred)
    assert not any("StringStartsWith(rule_id,pk.)" in x and "Not(" not in x for x in scans)


def test_state_of_empty_tables(spark, faulty):
    empty = replace(faulty, **{n: df.limit(0) for n, df in faulty.frames().items()})
    assert _rows(quality_state.evaluate(quality_state.measure(empty))) == _rows(quality.dq_summary(empty))


# rollup


@pytest.fixture(scope="module")
def demand(spark):
    sales, i = [], 0
    for product, gap in (("P1", 1), ("P2", 3)):
        for k in range(0, 60, gap):
            for w in ("W1", "W2"):
                i += 1
                week = D("2025-08-04") + dt.timedelta(weeks=k)
                units = (i * 37) % 101
                sales.append((i, week, product, w, units, units, 0, 1.0))
    sales.append((i + 1, D("2025-08-04"), "P2", "W3", 5, 5, 0, 1.0))
    t = tiny_tables(spark, weekly_sales=sales)
    some = F.when(F.col("sales_id") % 17 != 0, F.col("demand_units"))
    return replace(t, weekly_sales=t.weekly_sales.withColumn("demand_units", some))


@pytest.mark.parametrize("published", [False, True])
def test_rollup_after_an_appended_month_equals_the_full_scan(spark, demand, published):
    root, t = _tmp(), demand
    if published:
        t = files.read_published(spark, files.write_tables(demand, _tmp()), demand.as_of)
    month = "2026-09-01"
    before, after = quality_state.split_by_month(t, month)
    for load in (before, after, after):  # a month that is loaded again replaces itself
        rollup.save(rollup.monthly(load.weekly_sales), root)
    saved = rollup.read(spark, root)
    assert _rows(rollup.safety_stock_by_position(t, saved)) == _rows(inventory.safety_stock_by_position(t))
    for n in (1, 3, 4, 12, 13, 1000):
        assert _rows(rollup.last_n_mean_demand(t, saved, n)) == _rows(inventory.last_n_mean_demand(t, n)), n
    for days in (7, 30, 84, 120, 10_000):
        assert _rows(rollup.recent_demand(t, saved, days)) == _rows(inventory.recent_demand(t, days)), days
    deviation = {tuple(r)[:2]: r["demand_stddev"] for r in inventory.position_demand_stats(t).collect()}
    for r in rollup.demand_stats(saved).collect():
        want = deviation[r["product_id"], r["warehouse_id"]]
        assert r["demand_stddev"] == (pytest.approx(want, rel=1e-9) if want is not None else None)


def test_policy_reads_no_sales_rows(spark, demand):
    t = files.read_published(spark, files.write_tables(demand, _tmp()), demand.as_of)
    root = _tmp()
    rollup.save(rollup.monthly(t.weekly_sales), root)
    plan = rollup.safety_stock_by_position(t, rollup.read(spark, root))._jdf.queryExecution().executedPlan().toString()
    assert "demand_units" not in plan and "demand_sq" in plan


# moments


def _weekly(spark, names=("a", None, "c"), weeks=90):
    rows = []
    for s, name in enumerate(names):
        for k in range(weeks - 13 * s):
            if (k + s) % 7 or name == "a":  # gaps are compressed
                rows.append((name, D("2024-01-01") + dt.timedelta(weeks=k), float((k * (31 + s)) % 53 + s + k / 7)))
    rows += [(name, week, 1.5) for name, week, _ in rows[::9]]  # several rows a week
    return spark.createDataFrame(rows, "series string, week_start date, demand_units double")


def _close(a, b, tolerance):
    a, b = ({r["series"]: r.asDict() for r in x.collect()} for x in (a, b))
    assert a.keys() == b.keys()
    for s in a:
        for c, want in b[s].items():
            assert a[s][c] == (pytest.approx(want, rel=tolerance, abs=tolerance) if isinstance(want, float) else want), (s, c)


@pytest.mark.parametrize("cuts", [["2025-08-01"], ["2024-02-01", "2024-03-01", "2025-06-01", "2025-09-08", "2025-09-15"]])
def test_merged_moments_equal_those_of_all_rows(spark, cuts):
    weekly = _weekly(spark)
    edges = ["2000-01-01", *cuts, "2100-01-01"]
    state = None
    for lo, hi in zip(edges, edges[1:]):
        part = moments.measure(weekly.where(f"week_start >= '{lo}' AND week_start < '{hi}'"), ["series"])
        state = part if state is None else moments.merge(state, part, ["series"])
    path = _tmp() + "/state"
    moments.save(state, path)
    state = moments.read(spark, path)
    _close(state.drop("tail"), moments.measure(weekly, ["series"]).drop("tail"), 1e-9)
    kept, fresh = moments.StoredForecast(state, ["series"]), forecast.forecast(weekly, ["series"])
    assert fresh.fitted.count() == 2 and fresh.rejected.count() == 1
    _close(kept.fitted, fresh.fitted, 1e-8)
    for name in ("future", "validation", "rejected"):
        assert _rows(getattr(kept, name)) == _rows(getattr(fresh, name)), name
    assert _rows(forecast.forecast_kpis(kept, ["series"])) == _rows(forecast.forecast_kpis(fresh, ["series"]))
    assert _rows(forecast.recent_history(kept, ["series"])) == _rows(forecast.recent_history(fresh, ["series"]))


def test_one_more_week_reads_no_history(spark):
    weekly, path = _weekly(spark), _tmp() + "/state"
    moments.save(moments.measure(weekly.where("week_start < '2025-09-01'"), ["series"]), path)
    week = weekly.where("week_start = '2025-09-01'")
    state = moments.merge(moments.read(spark, path), moments.measure(week, ["series"]), ["series"])
    _close(state.drop("tail"), moments.measure(weekly.where("week_start <= '2025-09-01'"), ["series"]).drop("tail"), 1e-9)
    assert all(path in f for f in state.inputFiles())  # and the week's own rows, held in memory here


def test_a_new_series_and_a_short_one(spark):
    a = moments.measure(_weekly(spark, ["x"], 70), ["series"])
    b = moments.measure(_weekly(spark, ["y"], 20), ["series"])
    both = moments.merge(a, b, ["series"])
    assert {r["series"]: r["n"] for r in both.collect()} == {"x": 70 - 0 - len([k for k in range(70) if k % 7 == 0]), "y": 20 - 3}
    kept = moments.StoredForecast(both, ["series"], test_weeks=5)
    assert [r["series"] for r in kept.rejected.collect()] == ["y"]


def test_weeks_that_overlap_are_refused(spark):
    state = moments.measure(_weekly(spark), ["series"])
    with pytest.raises(Exception, match="a later state begins before the earlier one ends"):
        moments.merge(state, state, ["series"]).collect()


def test_shift_of_a_feature_row(spark):
    """R(n) x(t) = x(t + n), term by term."""
    names = [f"x_{n}" for n, _ in ridge.FEATURES]
    rows = moments._with_features(spark.range(6).select(F.col("id").cast("int").alias("t")))
    terms = moments._shift_rows("17")
    moved = rows.select("t", *[F.expr(" + ".join(f"{c} * {names[i] if i >= 0 else '1'}" for c, i in r)).alias(names[j]) for j, r in enumerate(terms)])
    later = moments._with_features(spark.range(17, 23).select(F.col("id").cast("int").alias("t")))
    for a, b in zip(moved.orderBy("t").collect(), later.orderBy("t").collect()):
        assert list(a)[1:] == pytest.approx(list(b)[1:], abs=1e-9)


# bucketed layout


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def laid_out(spark, sf_dir):
    from stockline.sources import mart

    t = mart.load(spark, sf_dir)
    root = _tmp()
    bucketed.write(t, root, "layout", 6)
    return t, root


def test_positions_and_keys_need_no_exchange(spark, laid_out):
    t, root = laid_out
    b = bucketed.read(spark, root, "layout", 6, t.as_of)
    for make in (inventory.stock_position, inventory.open_on_order, inventory.position_demand_stats):
        assert "Exchange hashpartitioning" not in _plan(make(b)), make
        assert _rows(make(b)) == _rows(make(t))
    joined = inventory.stock_position(b).join(inventory.position_demand_stats(b), inventory.POSITION)
    assert "Exchange hashpartitioning" not in _plan(joined)
    unique = b.weekly_sales.groupBy("week_start", *inventory.POSITION).count()
    assert "Exchange" not in _plan(unique)
    assert _rows(inventory.inventory_health(b)) == _rows(inventory.inventory_health(t))
    assert _rows(quality.unique_counts(b)) == _rows(quality.unique_counts(t))


def test_another_session_registers_the_layout(spark, laid_out):
    t, root = laid_out
    schemas = {n: spark.table(f"layout_{n}").schema for n in t.frames()}
    other = spark.newSession()
    bucketed.register(other, root, "again", 6, schemas)
    b = bucketed.read(other, root, "again", 6, t.as_of)
    assert _rows(inventory.recent_demand(b)) == _rows(inventory.recent_demand(t))
    assert "Exchange hashpartitioning" not in _plan(inventory.stock_position(b))


def test_a_hot_position_is_read_by_size_instead(spark, laid_out, monkeypatch):
    t, root = laid_out
    hot = t.inventory_batches.where("batch_id IS NOT NULL").limit(3).crossJoin(spark.range(20_000)).drop("id")
    one = hot.withColumn("product_id", F.lit(1)).withColumn("warehouse_id", F.lit(1))
    one = one.withColumn("batch_id", F.concat("batch_id", F.rand(3).cast("string")))
    skewed = replace(t, inventory_batches=t.inventory_batches.select(*one.columns).unionByName(one))
    where = _tmp()
    bucketed.write(skewed, where, "skewed", 6)
    assert bucketed.skew(spark, f"{where}/inventory_batches", 6) > bucketed.SKEW
    assert bucketed.skew(spark, f"{where}/purchase_orders", 6) < bucketed.SKEW
    b = bucketed.read(spark, where, "skewed", 6, t.as_of)
    assert "Exchange hashpartitioning" in _plan(inventory.stock_position(b))
    assert "Exchange hashpartitioning" not in _plan(inventory.open_on_order(b))
    assert b.inventory_batches.count() == skewed.inventory_batches.count()


def _star(spark, regions=(0, 1)):
    """Source tables of a few orders, under a fresh folder: a part twice, a line without part, nations of these regions."""
    root, day = _tmp(), dt.datetime(2001, 10, 1)
    tables = {
        "region": (("r_regionkey int", "r_name string"), [(0, "EAST"), (1, "WEST")]),
        "nation": (("n_nationkey int", "n_name string", "n_regionkey int"), [(i, f"N{i}", r) for i, r in enumerate(regions)]),
        "supplier": (("s_suppkey bigint", "s_name string", "s_nationkey int"), [(1, "S1", 0), (2, "S2", 1)]),
        "customer": (("c_custkey bigint", "c_nationkey int"), [(i, i % len(regions)) for i in range(4)]),
        "part": (("p_partkey bigint", "p_name string", "p_brand string", "p_type string", "p_size int", "p_retailprice double"),
                 [(p, f"P{p}", "B", "T", p, 10.5 * n) for p, n in ((1, 1), (2, 1), (2, 2), (3, 1), (3, 1))]),
        "orders": (("o_orderkey bigint", "o_custkey bigint"), [(o, o % 4) for o in range(30)]),
        "lineitem": (("l_orderkey bigint", "l_partkey bigint", "l_suppkey bigint", "l_linenumber int", "l_quantity double",
                      "l_discount double", "l_tax double", "l_returnflag string", "l_shipdate timestamp_ntz"),
                     [(i % 30, i % 5 or None, 1 + i % 2, i % 7, 1.0 + i % 9, 0.1, 0.01 * (i % 8), "NAR"[i % 3], day + dt.timedelta(days=i % 40, hours=i % 24))
                      for i in range(240)]),
    }
    for name, (columns, rows) in tables.items():
        spark.createDataFrame(rows, ", ".join(columns)).write.parquet(f"{root}/{name}.parquet")
    return root


@pytest.mark.parametrize("regions", [(0, 1), (0, 1, 1, 0), (0, None)])
def test_dealt_facts_are_the_projected_ones(spark, regions):
    from stockline.sources import mart

    root = _star(spark, regions)
    plain, dealt = mart.build_tables(spark, root), mart.build_dealt(spark, root, 6)
    for name, df in plain.frames().items():
        got = dealt.frames()[name]
        assert got.schema.simpleString() == df.schema.simpleString(), name
        assert _rows(got) == _rows(df) and df.count(), name


def test_the_layout_moves_no_dealt_fact(spark):
    from stockline.sources import mart

    t = mart.build_dealt(spark, _star(spark), 6)
    for name in bucketed.FACTS:
        plan = _plan(t.frames()[name].repartition(6, *bucketed.COLUMNS))
        # the products' rows only, the few distinct warehouses aside
        assert plan.count("Exchange hashpartitioning(product_id") == 1 and "hashpartitioning(l_partkey" not in plan, plan
        assert "SelectedBucketsCount: 6 out of 6" in plan, plan


@pytest.mark.parametrize("key", ["dq_unique_bucketed", "inventory_health_bucketed"])
def test_bucketed_queries_on_dealt_facts(spark, key):
    from stockline.plans import catalog

    root, found = _star(spark), catalog.queries()
    assert _rows(found[key](spark, root)) == _rows(found[key.removesuffix("_bucketed")](spark, root))


def test_the_deal_moves_only_what_the_facts_need(spark):
    from stockline.sources import mart

    t = mart.build_dealt(spark, _star(spark), 6)
    staged = {c for name in bucketed.FACTS for c in _plan(t.frames()[name]).replace(",", " ").split()}
    # discount and tax stay with their reader: lost units and punctuality go on
    assert not any(c.startswith(("l_discount", "l_tax", "l_shipdate")) for c in staged)
    assert any(c.startswith("lost#") for c in staged) and any(c.startswith("early#") for c in staged)


def test_the_layout_is_written_compact(spark, laid_out):
    t, root = laid_out
    found = [name for table in t.frames() for name, _ in file_sizes(spark, f"{root}/{table}")]
    assert found and all(name.endswith(".zstd.parquet") for name in found), found
    assert all(bucketed.skew(spark, f"{root}/{name}", 6) > 0 for name in bucketed.FACTS)  # buckets are told by these names


def test_lost_units_and_punctuality_of_odd_lines(spark):
    """Lines without flag, quantity, discount or tax keep their reading: nothing lost, delivered late."""
    from stockline.sources import mart

    root, day = _star(spark), dt.datetime(2001, 1, 1)
    lines = [(0, 2, 1, 0, 9.0, 0.3, 0.01, "R"), (1, 2, 1, 1, 9.0, 0.3, None, "A"), (2, 2, 1, 2, 9.0, None, 0.06, "R"),
             (3, 2, 1, 3, None, 0.3, 0.05, "A"), (6, 2, 1, 4, 9.0, 0.3, 0.0, None)]
    names = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp_ntz"
    spark.createDataFrame([(*x, day) for x in lines], names).write.mode("overwrite").parquet(f"{root}/lineitem.parquet")
    for t in (mart.build_tables(spark, root), mart.build_dealt(spark, root, 6)):
        weeks = t.weekly_sales.groupBy("warehouse_id").agg(F.max("demand_units"), F.max("lost_sales_units"))
        assert _rows(weeks) == [(27, 2, 0), (9, 0, 1)]  # demand, lost, warehouse
        late = F.datediff("actual_delivery_date", "promised_delivery_date")
        orders = t.purchase_orders.select(F.element_at(F.split("purchase_order_id", "-"), 2).alias("line"), late.alias("late")).distinct()
        assert {r.line: r.late for r in orders.collect()} == {"0": None, "1": 2, "2": 3, "3": -3}
