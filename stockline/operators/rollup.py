"""Monthly rollup of weekly demand per position, kept up month by month.

One row per (position, month): rows, rows with a demand, their sum and sum of
squares.  Everything adds up over months, so the statistics over all history
(C12's deviation, C20's last rows, C2's trailing window) need the rollup, a
fraction of the sales rows, and at most one month of sales per position:

* ``demand_stats`` -- observations, mean and sample deviation, from sums alone;
* ``recent_demand`` -- the months that lie wholly inside the trailing window come
  from the rollup, the month in which it begins from the sales rows of that month;
* ``last_n_mean_demand`` -- months are taken from the latest backwards while they
  fit into ``n`` rows; only the month that does not fit whole is read.

``save`` replaces the months it is given and leaves the others, so one new month
reads one month of sales, and a corrected month can be loaded again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.contracts import require_columns
from ..functions.numeric import round_half_up, to_double
from ..tables import Tables
from .inventory import POSITION

MONTH = "sales_month"


def monthly(sales: DataFrame) -> DataFrame:
    """The rollup of these sales rows: position, month, n_rows, n, demand_sum, demand_sq."""
    require_columns(sales, [*POSITION, "week_start", "demand_units"])
    y = to_double("demand_units")  # non-numeric input becomes NULL and is skipped
    return sales.groupBy(*POSITION, F.trunc("week_start", "month").alias(MONTH)).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(y).alias("n"),
        F.coalesce(F.sum(y), F.lit(0.0)).alias("demand_sum"),
        F.coalesce(F.sum(y * y), F.lit(0.0)).alias("demand_sq"),
        F.max("week_start").alias("last_week"),
    )


def save(rollup: DataFrame, root: str) -> None:
    """Write the months of ``rollup``, in place of these months if they are there."""
    dealt = rollup.repartitionByRange(MONTH, *POSITION)  # few files a month
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(root)


def read(spark: SparkSession, root: str) -> DataFrame:
    """The saved rollup (its schema is that of ``monthly``)."""
    return spark.read.parquet(root)


def demand_stats(rollup: DataFrame) -> DataFrame:
    """Per position: weeks observed, sample deviation and mean of weekly demand."""
    sums = rollup.groupBy(*POSITION).agg(F.sum("n").alias("observations"), F.sum("demand_sum").alias("s"), F.sum("demand_sq").alias("q"))
    n = F.col("observations")
    # never below zero, which rounding could give for equal demands
    spread = F.greatest(F.col("q") - F.col("s") * F.col("s") / n, F.lit(0.0))
    return sums.select(
        *POSITION,
        "observations",
        F.when(n > 1, F.sqrt(spread / (n - 1))).alias("demand_stddev"),
        F.when(n > 0, F.col("s") / n).alias("avg_weekly_demand"),
    )


def safety_stock_by_position(t: Tables, rollup: DataFrame, z: float = rules.SERVICE_Z) -> DataFrame:
    """C12 from the rollup: as ``inventory.safety_stock_by_position``, without a scan of sales."""
    stats = demand_stats(rollup).join(t.products.select("product_id", "lead_time_days"), "product_id")
    lead_weeks = F.col("lead_time_days") / F.lit(7.0)
    return stats.select(
        *POSITION,
        "observations",
        round_half_up(lead_weeks, 4).alias("lead_time_weeks"),
        rules.safety_stock("demand_stddev", "observations", lead_weeks, z).alias("safety_stock"),
        rules.safety_stock_reject_reason("observations", lead_weeks).alias("reject_reason"),
    )


def _sales_of(t: Tables, month) -> DataFrame:
    """Sales rows with their month; a published snapshot has it as partition column."""
    sales = t.weekly_sales
    if MONTH not in sales.columns:
        sales = sales.withColumn(MONTH, F.trunc("week_start", "month"))
    return sales if month is None else sales.where(F.col(MONTH) == month)


def recent_demand(t: Tables, rollup: DataFrame, window_days: int = rules.DEMAND_WINDOW_DAYS) -> DataFrame:
    """C2 from the rollup and the sales of one month: as ``inventory.recent_demand``."""
    cutoff = F.date_sub(rollup.select(F.max("last_week")).scalar(), window_days)  # weeks after it count
    begins = F.trunc(F.date_add(cutoff, 1), "month")  # the month of the first day that counts
    whole = rollup.where(F.col(MONTH) > cutoff).select(*POSITION, "n", "demand_sum")
    rows = _sales_of(t, begins).where((F.col("week_start") > cutoff) & (F.col(MONTH) <= cutoff))
    y = to_double("demand_units")
    part = rows.groupBy(*POSITION).agg(F.count(y).alias("n"), F.coalesce(F.sum(y), F.lit(0.0)).alias("demand_sum"))
    both = whole.unionByName(part).groupBy(*POSITION).agg(F.sum("n").alias("n"), F.sum("demand_sum").alias("s"))
    known = F.col("n") > 0
    return both.select(
        *POSITION,
        F.when(known, F.col("s") / F.col("n")).alias("avg_weekly_demand"),
        F.when(known, F.col("s").cast("bigint")).alias("demand_last_12_weeks"),
    )


def last_n_mean_demand(t: Tables, rollup: DataFrame, n: int = 12) -> DataFrame:
    """C20 from the rollup and one month of sales a position: as ``inventory.last_n_mean_demand``."""
    latest_first = Window.partitionBy(*POSITION).orderBy(F.col(MONTH).desc())  # a row per month
    later = F.coalesce(F.sum("n_rows").over(latest_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    months = rollup.select(*POSITION, MONTH, "n_rows", "n", "demand_sum").withColumn("room", F.lit(n) - later).where("room > 0")
    fits = F.col("n_rows") <= F.col("room")
    whole = months.where(fits).select(*POSITION, "n_rows", "n", "demand_sum")
    # at most one month a position; the months' partition column prunes the scan
    cut = months.where(~fits).select(*POSITION, MONTH, "room")
    sales = _sales_of(t, None).select(*POSITION, MONTH, "week_start", "demand_units").join(cut, [*POSITION, MONTH])
    place = F.row_number().over(Window.partitionBy(*POSITION).orderBy(F.col("week_start").desc()))
    last = sales.withColumn("place", place).where(F.col("place") <= F.col("room"))
    y = to_double("demand_units")
    part = last.groupBy(*POSITION).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(y).alias("n"), F.coalesce(F.sum(y), F.lit(0.0)).alias("demand_sum")
    )
    both = whole.unionByName(part).groupBy(*POSITION).agg(*(F.sum(c).alias(c) for c in ("n_rows", "n", "demand_sum")))
    return both.select(
        *POSITION, F.when(F.col("n") > 0, F.col("demand_sum") / F.col("n")).alias("avg_weekly_demand"), F.col("n_rows").alias("weeks_used")
    )
