"""Global ranking without an unpartitioned window.

``Window.orderBy(...)`` with no ``partitionBy`` moves every row into one task.
``global_row_number`` numbers rows of a globally ordered frame in parallel:

1. range-partition on the ordering, sort inside each partition, and tag rows
   with (partition index, position) from ``monotonically_increasing_id`` (its
   documented layout: partition index << 33, plus the position);
2. write the tagged rows under ``spark.checkpoint.dir``.  Row numbers and
   partition sizes must come from the same partitioning; a second evaluation
   could sample other range bounds or coalesce other partitions, so both read
   the written rows;
3. per-partition row counts (one row per partition, a bounded table) give each
   partition's offset, broadcast back.

The order must be total (add a unique tie-break column) for the numbers to be
reproducible.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

_LOW_BITS = (1 << 33) - 1


def global_row_number(
    df: DataFrame, order: Sequence[Column], name: str = "row_number", total: str | None = None
) -> DataFrame:
    """Append a 1-based row number following ``order`` (must be a total order).

    Runs one job, which writes the ordered rows (see the module's text).

    ``total`` names an optional column holding the row count of ``df``, taken
    from the same per-partition counts (no second pass over ``df``).
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = ordered.withColumn("_mid", F.monotonically_increasing_id()).select(
        "*",
        F.shiftright("_mid", 33).alias("_part"),
        F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)).alias("_pos"),
    )
    path = scratch_path(df.sparkSession, "numbered")
    tagged.write.parquet(path)
    tagged = df.sparkSession.read.schema(tagged.schema).parquet(path)
    # One row per partition: a table bounded by the partition count.
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_cnt"))
    in_order = Window.orderBy("_part")
    offsets = counts.select(
        "_part",
        (F.sum("_cnt").over(in_order.rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
        *(
            [F.sum("_cnt").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
             .cast("bigint").alias(total)]
            if total else []
        ),
    )
    return (
        tagged.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_pos") + 1).cast("bigint"))
        .drop("_mid", "_part", "_pos", "_off")
    )


def dense_rank_of_values(df: DataFrame, value: str, name: str = "dense_rank") -> DataFrame:
    """dense_rank by one column descending (NULL last), for a column of few values.

    Meant for values of a bounded domain (a score of one decimal): the window
    runs over the distinct values, one row each, not over the rows.
    """
    distinct = df.select(F.col(value).alias("_value")).distinct()
    ranked = distinct.withColumn(name, F.row_number().over(Window.orderBy(F.col("_value").desc_nulls_last())))
    return df.join(ranked, df[value].eqNullSafe(ranked["_value"]), "left").drop("_value")


def ntile_from_row_number(row_number: str | Column, total: str | Column, buckets: int) -> Column:
    """SQL NTILE(buckets) from a 1-based row number and the row count.

    The first ``total % buckets`` tiles hold one extra row.
    """
    r = F.col(row_number) if isinstance(row_number, str) else row_number
    n = F.col(total) if isinstance(total, str) else total
    size = F.floor(n / buckets)
    extra = n % buckets
    big_rows = extra * (size + 1)
    return (
        F.when(r <= big_rows, F.ceil(r / (size + 1)))
        .otherwise(extra + F.ceil((r - big_rows) / F.greatest(size, F.lit(1))))
        .cast("int")
    )
