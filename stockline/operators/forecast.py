"""Seasonal-trend weekly demand forecasts with holdout validation, for every
series of a grain in one job.

Per series: weekly sums, time index t = row position (gaps in weeks are
compressed, as in the reference), ridge fit on all but the last ``test_weeks``
rows, clipped holdout predictions, MAE / zero-safe MAPE against the seasonal
naive forecast (value 52 rows earlier), an 80 % residual band from the 10th and
90th percentiles, then a refit on all rows and ``periods`` future weeks.

Scale: a series holds one row per week, so every per-series window and the
exact ``percentile`` are bounded by the calendar, not by data volume; the
number of series is what grows, and each stage is a plain groupBy / join on
the series key.  Series with too little history go to ``rejected`` with a
reason instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ridge
from ..functions.contracts import require_columns
from ..functions.numeric import round_half_up
from ..session import scratch_path
from ..tables import Tables

ANNUAL = 52
# Unrounded statistics of the forecast (coefficients, predictions, errors) come
# from floating sums whose order depends on partitioning; they are reported
# rounded to this many decimals so reruns give identical values.
REPORT_DECIMALS = 6


def series_demand(t: Tables, grain: Sequence[str]) -> DataFrame:
    """Weekly demand rows tagged with the series key columns of ``grain``.

    ``grain`` may name sales columns (product_id, warehouse_id) and product
    attributes (therapeutic_area, dosage_form, ...); an empty grain is the
    network series.
    """
    sales = t.weekly_sales
    attrs = [c for c in grain if c not in sales.columns]
    if attrs:
        # units per product (and the grain's own sales columns) and week first: the
        # join to products then meets one row per group instead of every sales row
        own = [c for c in grain if c in sales.columns and c != "product_id"]
        sales = sales.groupBy("product_id", *own, "week_start").agg(F.sum("demand_units").alias("demand_units"))
        sales = sales.join(t.products.select("product_id", *attrs), "product_id")
    keys = list(grain) if grain else ["series"]
    if not grain:
        sales = sales.withColumn("series", F.lit("network"))
    return sales.select(*keys, "week_start", "demand_units")


def accuracy_metrics(actual: str, predicted: str) -> list:
    """G7 aggregates: MAE and zero-safe MAPE (percent; NULL with no nonzero actual)."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    return [
        F.avg(F.abs(a - p)),
        F.avg(F.when(a != 0, F.abs((a - p) / a))) * F.lit(100.0),
    ]


def _apply_stages(df: DataFrame, stages: list[list[tuple[str, str]]], carry: list[str], keep: set[str]) -> DataFrame:
    """Run the solve stages, keeping only columns a later stage or the output needs."""
    live = ridge.live_columns(stages, keep)
    for stage, after in zip(stages, live):
        produced = {name for name, _ in stage}
        kept = [c for c in df.columns if c in after and c not in produced and c not in carry]
        df = df.select(*carry, *kept, *[F.expr(expr).alias(name) for name, expr in stage if name in after])
    return df


def _join_series(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join two frames by series; a NULL key is a series of its own."""
    other = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return left.join(other, same).drop(*[f"_{k}" for k in keys])


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class ForecastResult:
    """Outputs of one forecast over every series of a grain.

    Two reduced tables carry every output:

    * ``indexed``: one row per (series, week) -- weekly sums, row index ``t``,
      series length and the seasonal naive value, from the single pass over
      the input;
    * ``fitted``: one row per accepted series -- both coefficient sets and the
      unrounded holdout statistics, from the single ridge solve.

    Everything is lazy until ``materialize()`` is called.  It writes the index
    and the fit as Parquet in the shared checkpoint folder (lineage cut; a lost
    executor re-reads them; readers take only the columns they need), so the
    input is scanned and aggregated once and the solve runs once however many
    outputs a caller combines.  Without it each output plans what it needs from
    the input.
    """

    def __init__(self, weekly: DataFrame, keys: Sequence[str], periods: int, test_weeks: int, alpha: float, solver: str):
        if periods <= 0 or test_weeks <= 0:
            raise ValueError("Forecast and test horizons must be positive")
        if solver not in ("numpy", "sql"):
            raise ValueError(f"Unknown solver: {solver}")
        self.keys = list(keys)
        self.periods, self.test_weeks, self.alpha, self.solver = periods, test_weeks, alpha, solver
        self.minimum = test_weeks + ANNUAL
        self._weekly = weekly
        self._indexed: DataFrame | None = None
        self._fitted: DataFrame | None = None
        self._written = False

    def materialize(self) -> ForecastResult:
        """Write the index and the fit (two jobs); later outputs read them."""
        if not self._written:
            self._indexed = _written(self.indexed, "forecast-index")
            self._fitted = None  # planned anew, from the written index
            self._fitted = _written(self.fitted, "forecast-fit")
            self._written = True
        return self

    @property
    def indexed(self) -> DataFrame:
        """Keys, week_start, actual_demand, t, n_obs, seasonal_naive_demand."""
        if self._indexed is None:
            keys = self.keys
            in_time = Window.partitionBy(*keys).orderBy("week_start")
            self._indexed = (
                self._weekly.groupBy(*keys, "week_start")
                .agg(F.sum("demand_units").cast("double").alias("actual_demand"))
                .select(
                    "*",
                    (F.row_number().over(in_time) - 1).cast("int").alias("t"),
                    F.count(F.lit(1)).over(Window.partitionBy(*keys)).cast("int").alias("n_obs"),
                    F.lag("actual_demand", ANNUAL).over(in_time).alias("seasonal_naive_demand"),
                )
            )
        return self._indexed

    def _features(self, rows: DataFrame) -> DataFrame:
        return rows.select(
            "*", (F.col("n_obs") - self.test_weeks).alias("split"),
            *[F.expr(e).alias(n) for n, e in ridge.feature_exprs("t")],
        )

    def _moments(self) -> DataFrame:
        """keys, n_obs, last_week and both moment sets (holdout fit, full refit) in one aggregation pass."""
        feats = self._features(self.indexed.where(F.col("n_obs") >= self.minimum))
        aggs = ridge.moment_aggregates("h_", "t < split", "actual_demand") + ridge.moment_aggregates(
            "f_", "true", "actual_demand"
        )
        return feats.groupBy(*self.keys).agg(
            *[F.expr(e).alias(n) for n, e in aggs],
            F.max("n_obs").alias("n_obs"),
            F.max("week_start").alias("last_week"),
        )

    @property
    def fitted(self) -> DataFrame:
        """G4/G7/G8/G9 per series: n_obs, last_week, h_* and f_* coefficients,
        unrounded MAE/MAPE (model and seasonal naive) and the residual band."""
        if self._fitted is None:
            keys = self.keys
            moments = self._moments()
            feats = self._features(self.indexed.where(F.col("n_obs") >= self.minimum))
            outputs = {f"{p}{c}" for p in ("h_", "f_") for c in COEF_COLS}
            carry = [*keys, "n_obs", "last_week"]
            if self.solver == "sql":
                models = _apply_stages(moments, ridge.merged_stages(("h_", "f_"), self.alpha), carry, outputs)
            else:
                schema = T.StructType(
                    [moments.schema[c] for c in carry] + [T.StructField(c, T.DoubleType()) for c in sorted(outputs)]
                )
                models = moments.mapInPandas(ridge.solve_batches(("h_", "f_"), carry, self.alpha), schema)
            coefs = [f"{p}{c}" for p in ("h_", "f_") for c in COEF_COLS]
            # Holdout rows meet their model once; the coefficients ride through
            # the per-series aggregate (constant within a series), so the solve
            # is planned once.
            holdout = _predict(_join_series(feats.where(F.col("t") >= F.col("split")), models.drop("n_obs"), keys))
            mae, mape = accuracy_metrics("actual_demand", "predicted_demand")
            base_mae, base_mape = accuracy_metrics("actual_demand", "seasonal_naive_demand")
            residual = F.col("actual_demand") - F.col("predicted_demand")
            self._fitted = holdout.groupBy(*keys).agg(
                F.max("n_obs").alias("n_obs"),
                F.max("last_week").alias("last_week"),
                *[F.max(c).alias(c) for c in coefs],
                mae.alias("mae"),
                mape.alias("mape"),
                base_mae.alias("baseline_mae"),
                base_mape.alias("baseline_mape"),
                F.least(F.percentile(residual, F.lit(0.1)), F.lit(0.0)).alias("residual_lower"),
                F.greatest(F.percentile(residual, F.lit(0.9)), F.lit(0.0)).alias("residual_upper"),
            )
        return self._fitted

    @property
    def history(self) -> DataFrame:
        """G1: keys, week_start, actual_demand, t (every series, accepted or not)."""
        return self.indexed.select(*self.keys, "week_start", "actual_demand", "t")

    @property
    def seasonal_naive(self) -> DataFrame:
        """History with the value 52 rows earlier."""
        return self.indexed.select(*self.keys, "week_start", "t", "actual_demand",
                                   F.col("seasonal_naive_demand").cast("double").alias("seasonal_naive_demand"))

    @property
    def rejected(self) -> DataFrame:
        """Series shorter than test_weeks + 52, with the reference's message."""
        return self._rejected(self.indexed.where(F.col("t") == 0))

    def _rejected(self, series: DataFrame) -> DataFrame:
        reason = f"At least {self.minimum} weekly observations are required for annual validation"
        return series.where(F.col("n_obs") < self.minimum).select(*self.keys, "n_obs", F.lit(reason).alias("reason"))

    @property
    def validation(self) -> DataFrame:
        """Holdout rows with clipped predictions and the seasonal naive value."""
        coefs = [f"h_{c}" for c in COEF_COLS]
        models = self.fitted.select(*self.keys, *coefs)
        holdout = self._features(self.indexed.where(F.col("n_obs") >= self.minimum))
        rows = _predict(_join_series(holdout.where(F.col("t") >= F.col("split")), models, self.keys))
        return rows.select(
            *self.keys, "week_start", "t", "actual_demand",
            round_half_up("predicted_demand", REPORT_DECIMALS).alias("predicted_demand"),
            F.col("seasonal_naive_demand").cast("double").alias("seasonal_naive_demand"),
        )

    @property
    def metrics(self) -> DataFrame:
        """MAE, MAPE, seasonal-naive MAE/MAPE and the residual band."""
        return self.fitted.select(*self.keys, *[round_half_up(c, REPORT_DECIMALS).alias(c) for c in METRIC_COLS])

    @property
    def coefficients(self) -> DataFrame:
        """Holdout (h_) and full (f_) ridge coefficients per series."""
        r = REPORT_DECIMALS
        return self.fitted.select(
            *self.keys,
            "n_obs",
            *[round_half_up(f"h_{c}", r).alias(f"h_{c}") for c in COEF_COLS],
            *[round_half_up(f"f_{c}", r).alias(f"f_{c}") for c in COEF_COLS],
        )

    @property
    def future(self) -> DataFrame:
        """``periods`` weeks from the first Monday after the last
        observed week + 6 days; point forecast and band clipped at zero."""
        steps = F.explode(F.sequence(F.lit(0), F.lit(self.periods - 1))).alias("step")
        base = self.fitted.select("*", steps)
        feats = base.select("*", (F.col("n_obs") + F.col("step")).alias("t")).select(
            "*", *[F.expr(e).alias(n) for n, e in ridge.feature_exprs("t")]
        )
        point = F.greatest(F.lit(0.0), F.expr(ridge.prediction_expr("f_")))
        first_week = F.next_day(F.date_add("last_week", 6), "Mon")
        return feats.select(
            *self.keys,
            F.date_add(first_week, F.col("step") * 7).alias("week_start"),
            round_half_up(point, 1).alias("forecast_demand"),
            round_half_up(F.greatest(point + F.col("residual_lower"), F.lit(0.0)), 1).alias("lower_80"),
            round_half_up(F.greatest(point + F.col("residual_upper"), F.lit(0.0)), 1).alias("upper_80"),
        )


COEF_COLS = ["intercept"] + ridge.COEFFICIENTS
METRIC_COLS = ["mae", "mape", "baseline_mae", "baseline_mape", "residual_lower", "residual_upper"]


def _predict(rows: DataFrame) -> DataFrame:
    """Holdout prediction from the h_ coefficients, clipped at zero."""
    return rows.withColumn("predicted_demand", F.greatest(F.lit(0.0), F.expr(ridge.prediction_expr("h_"))))


def forecast(
    weekly: DataFrame,
    keys: Sequence[str],
    periods: int = 12,
    test_weeks: int = 12,
    alpha: float = 1.0,
    solver: str = "numpy",
) -> ForecastResult:
    """G1-G11 for every series of ``weekly`` (columns: keys, week_start, demand_units).

    ``solver="numpy"`` solves the per-series 7x7 systems with a batched LAPACK
    call in ``mapInPandas`` (one row per series crosses to Python);
    ``solver="sql"`` uses the generated elimination expressions (JVM only).
    """
    require_columns(weekly, [*keys, "week_start", "demand_units"])
    return ForecastResult(weekly, keys, periods, test_weeks, alpha, solver)


def forecast_tables(t: Tables, grain: Sequence[str], periods: int = 12, test_weeks: int = 12,
                    alpha: float = 1.0) -> ForecastResult:
    weekly = series_demand(t, grain)
    keys = list(grain) if grain else ["series"]
    return forecast(weekly, keys, periods, test_weeks, alpha)


def forecast_kpis(result: ForecastResult, keys: Sequence[str]) -> DataFrame:
    """Forecast total and weekly average, improvement over the seasonal
    naive MAE (NULL when that MAE is 0) and the last actual, per series."""
    keys = list(keys)
    totals = result.future.groupBy(*keys).agg(
        F.sum(F.col("forecast_demand").cast("decimal(18,1)")).cast("double").alias("forecast_total")
    )
    # The last row of a series is t = n_obs - 1: a filter on the index, no window.
    last = result.indexed.where(F.col("t") == F.col("n_obs") - 1).select(
        *keys, F.col("actual_demand").alias("last_actual")
    )
    improvement = F.when(
        F.col("baseline_mae") > 0,
        F.lit(100.0) * (F.col("baseline_mae") - F.col("mae")) / F.col("baseline_mae"),
    )
    return (
        _join_series(_join_series(totals, result.metrics, keys), last, keys)
        .select(
            *keys,
            "forecast_total",
            round_half_up(F.col("forecast_total") / F.lit(float(result.periods)), REPORT_DECIMALS).alias(
                "forecast_weekly_average"
            ),
            round_half_up(improvement, REPORT_DECIMALS).alias("improvement_vs_naive_pct"),
            "last_actual",
        )
    )


def recent_history(result: ForecastResult, keys: Sequence[str], rows: int = 52) -> DataFrame:
    """The last ``rows`` history rows per series (chart input): a filter on
    the row index against the series length, no sort or window."""
    return result.indexed.where(F.col("t") >= F.col("n_obs") - rows).select(
        *keys, "week_start", "actual_demand", "t"
    )
