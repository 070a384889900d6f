"""Forecasts on series with known shape, against a second derivation of the fit."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import tiny_tables
from stockline.functions import ridge
from stockline.operators import forecast

FIRST = dt.date(2023, 1, 2)


def series(spark, shape, weeks, key="north"):
    rows = [(key, FIRST + dt.timedelta(weeks=i), round(shape(i))) for i in range(weeks)]
    return spark.createDataFrame(rows, "series string, week_start date, demand_units long")


def falling(i):
    return 900 - 2 * i + 70 * math.cos(4 * math.pi * i / 52)


def test_errors_of_three_weeks(spark):
    # off by 6, 0 and 10; the week without demand has no percentage: (6/24 + 10/40) / 2 = 25 %
    df = spark.createDataFrame([(24.0, 18.0), (0.0, 0.0), (40.0, 50.0)], "a double, p double")
    mae, mape = forecast.accuracy_metrics("a", "p")
    row = df.agg(mae.alias("mae"), mape.alias("mape")).first()
    assert (row.mae, row.mape) == (pytest.approx(16 / 3), pytest.approx(25.0))


def test_a_falling_series_with_a_half_year_wave(spark):
    result = forecast.forecast(series(spark, falling, 130), ["series"], periods=9, test_weeks=10)
    held = result.validation.orderBy("week_start").collect()
    assert [r.t for r in held] == list(range(120, 130))
    assert all(abs(r.predicted_demand - r.actual_demand) < 4 for r in held)
    assert [r.seasonal_naive_demand for r in held] == [round(falling(i - 52)) for i in range(120, 130)]
    ahead = result.future.orderBy("week_start").collect()
    assert [r.week_start for r in ahead] == [FIRST + dt.timedelta(weeks=130 + i) for i in range(9)]
    for i, r in enumerate(ahead):
        assert abs(r.forecast_demand - falling(130 + i)) < 6
        assert 0 <= r.lower_80 <= r.forecast_demand <= r.upper_80
    score = result.metrics.first()
    assert score.baseline_mae == pytest.approx(104, abs=1) and score.mae < 3
    assert score.residual_lower <= 0 <= score.residual_upper


def test_series_too_short_for_a_year(spark):
    short = series(spark, falling, 61, key="south")  # 10 held out + 52 are needed
    result = forecast.forecast(short.unionByName(series(spark, falling, 62)), ["series"], test_weeks=10)
    assert [(r.series, r.n_obs, r.reason[:11]) for r in result.rejected.collect()] == [("south", 61, "At least 62")]
    assert [r.series for r in result.future.select("series").distinct().collect()] == ["north"]


@pytest.mark.parametrize("wrong", [{"periods": 0}, {"test_weeks": -1}, {"solver": "guess"}])
def test_arguments(spark, wrong):
    with pytest.raises(ValueError):
        forecast.forecast(series(spark, falling, 5), ["series"], **wrong)


@pytest.mark.parametrize("solver", ["numpy", "sql"])
def test_fit_is_the_ridge_solution(spark, solver):
    weekly = series(spark, lambda i: falling(i) + 13 * (i % 5), 95)
    fit = forecast.forecast(weekly, ["series"], solver=solver).coefficients.first()
    y = np.array([round(falling(i) + 13 * (i % 5)) for i in range(95)], float)
    t = np.arange(95.0)
    x = np.column_stack([t, *(wave(2 * np.pi * turns * t / 52) for turns in (1, 2, 4) for wave in (np.sin, np.cos))])
    # ridge as least squares on rows appended for the penalty
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.lstsq(np.vstack([xc, np.eye(7)]), np.append(yc, np.zeros(7)), rcond=None)[0]
    assert [fit[f"f_{c}"] for c in ridge.COEFFICIENTS] == pytest.approx(list(w), abs=1e-5)
    assert fit.f_intercept == pytest.approx(y.mean() - x.mean(0) @ w, abs=1e-5)


def test_weekly_average_is_over_the_forecast_s_own_horizon(spark):
    result = forecast.forecast(series(spark, falling, 130), ["series"], periods=26)
    total = sum(r.forecast_demand for r in result.future.collect())
    kpi = forecast.forecast_kpis(result, ["series"]).first()
    assert kpi.forecast_total == pytest.approx(total)
    assert kpi.forecast_weekly_average == pytest.approx(total / 26, abs=1e-5)
    assert kpi.last_actual == round(falling(129))


def test_thousands_of_series_in_one_fit(spark):
    n, weeks = 3000, 70
    rows = spark.range(n * weeks).select(
        (F.col("id") % n).alias("series"),
        F.date_add(F.lit(FIRST), (F.floor(F.col("id") / n) * 7).cast("int")).alias("week_start"),
        (100 + (F.col("id") % n) + 3 * F.floor(F.col("id") / n)).cast("long").alias("demand_units"),
    )
    result = forecast.forecast(rows, ["series"])
    assert result.rejected.isEmpty()
    off = result.validation.agg(F.count("*").alias("n"), F.max(F.abs(F.col("predicted_demand") - F.col("actual_demand"))).alias("off")).first()
    assert (off.n, result.future.count()) == (12 * n, 12 * n) and off.off < 10


def test_network_series_of_a_young_table(spark):
    result = forecast.forecast_tables(tiny_tables(spark), ())
    assert [r.n_obs for r in result.rejected.collect()] == [13]


def test_a_series_without_a_key_is_a_series(spark):
    weekly = series(spark, falling, 80).unionByName(series(spark, falling, 80).withColumn("series", F.lit(None).cast("string")))
    result = forecast.forecast(weekly, ["series"]).materialize()
    counts = {r["series"]: r["count"] for r in result.validation.groupBy("series").count().collect()}
    assert counts == {"north": 12, None: 12}
    assert forecast.forecast_kpis(result, ["series"]).count() == 2
