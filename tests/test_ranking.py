"""Distributed global numbering against pandas brute force."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from stockline.functions.ranking import dense_rank_of_values, global_row_number, ntile_from_row_number


def _scores(spark, n=257, seed=7):
    rnd = random.Random(seed)
    rows = [(i, None if rnd.random() < 0.1 else float(rnd.randint(0, 20))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, score double").repartition(5), rows


def test_global_row_number_matches_sort(spark):
    df, rows = _scores(spark)
    out = global_row_number(df, [F.col("score").desc_nulls_last(), F.col("id").asc()], "rn")
    got = {r.id: r.rn for r in out.collect()}
    pdf = pd.DataFrame(rows, columns=["id", "score"]).sort_values(["score", "id"], ascending=[False, True],
                                                                 na_position="last")
    expected = {i: k + 1 for k, i in enumerate(pdf["id"])}
    assert got == expected


def test_dense_rank_and_ntile_match_sql_windows(spark):
    df, _ = _scores(spark)
    df.createOrReplaceTempView("scores")
    expected = {
        r.id: (r.dr, r.nt)
        for r in spark.sql(
            "SELECT id, dense_rank() OVER (ORDER BY score DESC NULLS LAST) AS dr, "
            "ntile(4) OVER (ORDER BY score DESC NULLS LAST, id) AS nt FROM scores"
        ).collect()
    }
    numbered = global_row_number(df, [F.col("score").desc_nulls_last(), F.col("id").asc()], "rn")
    ranked = dense_rank_of_values(numbered, "score", name="dr")
    out = ranked.crossJoin(df.agg(F.count(F.lit(1)).alias("n"))).select(
        "id", "dr", ntile_from_row_number("rn", "n", 4).alias("nt")
    )
    got = {r.id: (r.dr, r.nt) for r in out.collect()}
    assert got == expected


def test_ntile_with_fewer_rows_than_tiles(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "rn long")
    got = [r.t for r in df.select(ntile_from_row_number("rn", F.lit(3), 4).alias("t")).orderBy("rn").collect()]
    assert got == [1, 2, 3]


def test_row_number_total_comes_from_the_partition_counts(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("v"))
    out = global_row_number(df, [F.col("v").desc()], "rn", total="n").collect()
    assert {r.n for r in out} == {1000}
    assert sorted(r.rn for r in out) == list(range(1, 1001))
    assert all(r.rn == 1000 - r.v for r in out)


def _wide_suppliers(spark, n):
    from fixtures import tiny_tables
    from pyspark.sql import functions as F

    ids = spark.range(0, n, 1, 32)
    suppliers = ids.select(
        F.format_string("S%08d", "id").alias("supplier_id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 3).alias("supplier_name"),
        F.lit("US").alias("country"), F.lit(20).alias("contracted_lead_time_days"))
    received = (F.col("id") * 7919 % 60 + 41).cast("bigint")
    day = F.to_date(F.lit("2026-01-10"))
    orders = ids.where("id % 11 <> 0").select(
        F.format_string("PO%d", "id").alias("purchase_order_id"), F.format_string("S%08d", "id").alias("supplier_id"),
        F.lit("P1").alias("product_id"), F.lit("W1").alias("warehouse_id"), F.date_sub(day, 9).alias("order_date"),
        day.alias("promised_delivery_date"), F.date_add(day, (F.col("id") % 3 - 1).cast("int")).alias("actual_delivery_date"),
        F.lit(100).cast("bigint").alias("ordered_quantity"), received.alias("received_quantity"),
        (received - F.col("id") % 5).alias("accepted_quantity"), F.lit(2.0).alias("unit_cost"), F.lit("Delivered").alias("status"))
    from dataclasses import replace

    return replace(tiny_tables(spark), suppliers=suppliers, purchase_orders=orders)


def test_supplier_ranking_keeps_every_supplier_at_any_partition_size(spark):
    from stockline.operators import suppliers

    n = 200_000
    tables = _wide_suppliers(spark, n)
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        for advisory in ("256k", "64m"):
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
            ranked = suppliers.supplier_ranking(tables).toPandas()
            assert len(ranked) == n and ranked.supplier_id.nunique() == n
            order = ranked.sort_values(["composite_score", "supplier_id"], ascending=[False, True], na_position="last")
            score = order.composite_score.fillna(-1.0)
            assert (order.supplier_rank.to_numpy() == (score != score.shift()).cumsum().to_numpy()).all()
            assert (order.performance_quartile.to_numpy() == [i * 4 // n + 1 for i in range(n)]).all()
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
