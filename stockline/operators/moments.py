"""Forecast moments that are kept and updated: a week more costs a week, not the history.

A ridge fit needs n, Σx, Σxxᵀ, Σxy and Σy per series (``functions.ridge``).  The
features depend on a row's index t in its series only, so the moments of a later
stretch of rows, measured with its own t = 0, 1, ..., can be moved behind n
earlier rows without the rows: x(t + n) = R(n)·x(t), where R adds n to the trend
and turns each (sin, cos) pair by its angle.  Hence

    Σ x(t+n) x(t+n)ᵀ = R(n) · Σ x̃ x̃ᵀ · R(n)ᵀ        (x̃ = (1, x))

and two states merge by shifting the later one and adding.

A state is one row per series: the moments, first and last week, and the last
``ANNUAL + test_weeks`` weekly values, which give the holdout rows and their
seasonal naive values.  The holdout fit's moments are the full ones without the
last ``test_weeks`` rows.  ``StoredForecast`` is the usual forecast result made
from a state alone.

Edge cases: a null key is a series of its own; a series found in one of the two
states only goes over as it is; weeks of the later state that are not after the
earlier one's last week are an error (they would be counted twice).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ridge
from ..functions.contracts import require_columns
from .forecast import ANNUAL, ForecastResult

K = ridge.K
TAIL = "array<struct<week_start: date, y: double>>"
MOMENTS = [name for name, _ in ridge.moment_aggregates("", "true")]
STATE_COLUMNS = [*MOMENTS, "first_week", "last_week", "tail"]


def _with_features(rows: DataFrame) -> DataFrame:
    return rows.select("*", *[F.expr(e).alias(n) for n, e in ridge.feature_exprs("t")])


def measure(weekly: DataFrame, keys: Sequence[str], test_weeks: int = 12) -> DataFrame:
    """The state of these rows (keys, week_start, demand_units), each series from t = 0."""
    require_columns(weekly, [*keys, "week_start", "demand_units"])
    in_time = Window.partitionBy(*keys).orderBy("week_start")
    rows = (
        weekly.groupBy(*keys, "week_start")
        .agg(F.sum("demand_units").cast("double").alias("y"))
        .withColumn("t", (F.row_number().over(in_time) - 1).cast("int"))
    )
    values = F.array_sort(F.collect_list(F.struct("week_start", "y")))  # one value a week: bounded by the calendar
    return _with_features(rows).groupBy(*keys).agg(
        *[F.expr(e).alias(n) for n, e in ridge.moment_aggregates("", "true")],
        F.min("week_start").alias("first_week"),
        F.max("week_start").alias("last_week"),
        _last(values, ANNUAL + test_weeks).cast(TAIL).alias("tail"),
    )


def _last(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), F.lit(n))


def _shift_rows(by: str) -> list[list[tuple[str, int]]]:
    """R(by) as (coefficient, feature) terms of each feature; feature -1 is the constant 1."""
    out: list[list[tuple[str, int]]] = [[("1", 0), (by, -1)]]
    for j in range(1, K, 2):
        # the pair of features j, j + 1 is (sin, cos) of t times this angle
        name = ridge.FEATURES[j][0]
        angle = f"(2 * pi() * {by} / {name[1:]})"
        out += [[(f"cos{angle}", j), (f"sin{angle}", j + 1)], [(f"cos{angle}", j + 1), (f"-sin{angle}", j)]]
    return out


def shifted(prefix: str, by: str) -> dict[str, str]:
    """Expressions of the moments in columns ``{prefix}...`` for rows that begin at t = ``by`` instead of 0."""
    p, rows = prefix, _shift_rows(by)

    def xx(i: int, j: int) -> str:
        i, j = sorted((i, j))
        if j < 0:
            return f"{p}n"
        return f"{p}sx{j}" if i < 0 else f"{p}sxx{i}_{j}"

    out = {"n": f"{p}n", "sy": f"{p}sy"}
    for j in range(K):
        out[f"sx{j}"] = " + ".join(f"{c} * {xx(-1, i)}" for c, i in rows[j])
        out[f"sxy{j}"] = " + ".join(f"{c} * {f'{p}sxy{i}' if i >= 0 else f'{p}sy'}" for c, i in rows[j])
        for k in range(j, K):
            out[f"sxx{j}_{k}"] = " + ".join(f"{a} * {b} * {xx(i, m)}" for a, i in rows[j] for b, m in rows[k])
    return out


def merge(earlier: DataFrame, later: DataFrame, keys: Sequence[str], test_weeks: int = 12) -> DataFrame:
    """The state of both stretches: later rows moved behind the earlier ones and added."""
    keys = list(keys)
    a = earlier.select(*[F.col(k).alias(f"_a{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"a_{c}") for c in STATE_COLUMNS])
    b = later.select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"b_{c}") for c in STATE_COLUMNS])
    both = a.join(b, reduce(and_, [F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}")) for i in range(len(keys))]), "full_outer")
    moved = shifted("b_", "a_n")
    only_a, only_b = F.col("b_n").isNull(), F.col("a_n").isNull()
    in_order = F.assert_true(
        F.coalesce(F.col("a_last_week") < F.col("b_first_week"), F.lit(True)), F.lit("a later state begins before the earlier one ends")
    ).isNull()
    tails = F.concat(*(F.coalesce(F.col(c), F.array().cast(TAIL)) for c in ("a_tail", "b_tail")))
    return both.where(in_order).select(
        *[F.when(only_b, F.col(f"_b{i}")).otherwise(F.col(f"_a{i}")).alias(k) for i, k in enumerate(keys)],
        *[F.when(only_a, F.col(f"a_{m}")).when(only_b, F.col(f"b_{m}")).otherwise(F.col(f"a_{m}") + F.expr(moved[m])).alias(m) for m in MOMENTS],
        F.coalesce("a_first_week", "b_first_week").alias("first_week"),
        F.coalesce("b_last_week", "a_last_week").alias("last_week"),
        _last(tails, ANNUAL + test_weeks).alias("tail"),
    )


def save(state: DataFrame, root: str) -> None:
    """Write a state to a new folder (an update reads the old one, so it cannot overwrite it)."""
    state.write.mode("errorifexists").parquet(root)


def read(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


class StoredForecast(ForecastResult):
    """A forecast from a state: the index holds the tail's rows, the fit is that of all rows."""

    def __init__(self, state: DataFrame, keys: Sequence[str], periods: int = 12, test_weeks: int = 12, alpha: float = 1.0, solver: str = "numpy"):
        super().__init__(state, keys, periods, test_weeks, alpha, solver)
        self._state = state

    @property
    def indexed(self) -> DataFrame:
        """The last rows of each series, with their index in the whole series; the naive value where the tail has it."""
        if self._indexed is None:
            n, size = F.col("n").cast("int"), F.size("tail")
            row = self._state.select(*self.keys, n.alias("n_obs"), (n - size).alias("start"), "tail", F.posexplode("tail").alias("pos", "row"))
            self._indexed = row.select(
                *self.keys,
                F.col("row.week_start").alias("week_start"),
                F.col("row.y").alias("actual_demand"),
                (F.col("start") + F.col("pos")).alias("t"),
                "n_obs",
                F.when(F.col("pos") >= ANNUAL, F.try_element_at("tail", F.col("pos") - ANNUAL + 1)["y"]).alias("seasonal_naive_demand"),
            )
        return self._indexed

    def _moments(self) -> DataFrame:
        """Full moments as kept; those of the holdout fit without the last ``test_weeks`` rows."""
        held = self._features(self.indexed).where("t >= split")
        gone = held.groupBy(*self.keys).agg(*[F.expr(e).alias(n) for n, e in ridge.moment_aggregates("g_", "true", "actual_demand")])
        full = self._state.where(F.col("n") >= self.minimum)
        other = gone.select(*[F.col(k).alias(f"_{k}") for k in self.keys], *[F.col(f"g_{m}") for m in MOMENTS])
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys])
        return full.join(other, same).select(
            *self.keys,
            *[F.col(m).alias(f"f_{m}") for m in MOMENTS],
            *[(F.col(m) - F.col(f"g_{m}")).alias(f"h_{m}") for m in MOMENTS],
            F.col("n").cast("int").alias("n_obs"),
            "last_week",
        )

    @property
    def rejected(self) -> DataFrame:
        return self._rejected(self._state.select(*self.keys, F.col("n").cast("int").alias("n_obs")))

    @property
    def history(self) -> DataFrame:
        raise NotImplementedError("a state keeps the last weeks only; the history is in the sales table")
