import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cordon.operators import models as m
from cordon.operators import series as sr
from cordon.operators import weather as wt


def hours(n, start="2026-03-02"):
    return pd.date_range(start, periods=n, freq="h")


def signal(n, seed=0, noise=0.0):
    ds = hours(n)
    y = 20 + 8 * np.sin(2 * np.pi * ds.hour / 24) + 5 * (ds.dayofweek < 5) + np.random.default_rng(seed).normal(0, noise, n)
    df = pd.DataFrame({"ds": ds, "y": np.maximum(y, 0)})
    for k in (1, 2):
        df[f"lag_{k}w"] = df["y"].shift(168 * k).fillna(0.0)
    return df


def test_series_is_dense_with_lags_and_filled_weather(spark):
    counts = spark.createDataFrame([(1, hours(1)[0].to_pydatetime(), 5), (2, hours(3)[2].to_pydatetime(), 7)], "h3_zone long, hour_bucket timestamp_ntz, quote_count long")
    w = spark.createDataFrame([(t.to_pydatetime(), v) for t, v in zip(hours(4), (None, 3.0, None, 4.0))], "hour_bucket timestamp_ntz, temperature_2m double")
    got = sorted(sr.prepare_series(counts, w, "2026-03-02 00:00:00", "2026-03-09 01:00:00", ["temperature_2m", "visibility"]).collect(), key=lambda r: (r.h3_zone, r.ds))
    assert len(got) == 2 * 170 and [r.temperature_2m for r in got[:5]] == [0.0, 3.0, 3.0, 4.0, 4.0]
    assert (got[168].lag_1w, got[169].lag_1w, got[0].lag_1w, got[0].y, got[1].y) == (5.0, 0.0, 0.0, 5.0, 0.0)


def test_conversion_is_strictly_before_the_cutoff(spark):
    rows = [(1, pd.Timestamp(t).to_pydatetime(), r) for t, r in (("2026-03-02 08:00", 0.2), ("2026-03-09 08:00", 0.4), ("2026-03-16 08:00", 1.0))]
    got = sr.historical_conversion(spark.createDataFrame(rows, "h3_zone long, hour_bucket timestamp_ntz, conversion_rate double"), "2026-03-16 08:00:00").collect()
    assert [(r.hour_of_day, r.dow, round(r.conv_rate, 9)) for r in got] == [(8, 0, 0.3)]


def test_trips_clip_the_lower_bound_only_and_keep_missing_slots(spark):
    f = spark.createDataFrame([(1, pd.Timestamp("2026-03-02 08:00").to_pydatetime(), -3.0, 4.0, 9.0), (1, pd.Timestamp("2026-03-02 09:00").to_pydatetime(), 1.0, 4.0, 9.0)], "h3_zone long, ds timestamp_ntz, yhat_lower double, yhat double, yhat_upper double")
    c = spark.createDataFrame([(1, 8, 0, 0.125)], "h3_zone long, hour_of_day int, dow int, conv_rate double")
    a, b = sorted(sr.apply_conversion(f, c).collect(), key=lambda r: r.ds)
    assert (a.trips_lower, a.trips_pred, a.trips_upper, a.yhat_lower) == (0.0, 0.5, 1.13, -3.0)
    assert (b.conv_rate, b.trips_lower, b.trips_pred) == (None, None, None)


def test_metrics(spark):
    df = spark.createDataFrame([(0.0, 5.0, None, None), (10.0, 8.0, 9.0, 11.0), (10.0, None, 10.0, 10.0), (4.0, 5.0, 5.0, 6.0)], "y double, yhat double, yhat_lower double, yhat_upper double")
    r = df.agg(sr.mape().alias("m"), sr.coverage().alias("c")).first()
    assert r.m == pytest.approx(22.5) and r.c == 50.0
    assert df.where("y = 0").agg(sr.mape().alias("m")).first().m is None


def test_pivot_refuses_two_values_for_a_cell(spark):
    rows = [(1, 1, 5.0), (1, 2, 7.0), (2, 1, 1.0)]
    df = spark.createDataFrame(rows, "h3_zone int, day_i int, mape double")
    got = sr.day_pivot(df, "mape", 3).collect()
    assert [(r.h3_zone, r.d1, r.d2, r.d3, r.avg) for r in got] == [(2, 1.0, None, None, 1.0), (1, 5.0, 7.0, None, 6.0)]
    with pytest.raises(Exception, match="two values"):
        sr.day_pivot(df.union(df), "mape", 3).collect()


def test_ties_of_parameters_take_the_smaller(spark):
    df = spark.createDataFrame([(1, 0.1, 1.0, 5.0), (1, 0.01, 10.0, 5.0), (1, 0.05, 10.0, 8.0)], "h3_zone int, cps double, sps double, mape double")
    r = sr.best_params(df, (0.05, 10.0)).first()
    assert (r.cps, r.sps, r.best_mape, r.default_mape, r.gain) == (0.01, 10.0, 5.0, 8.0, 3.0)


def test_wind_and_quartile_bins(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.1, 10.0, 10.1, 30.0, 100.0, 100.1, None)], "wind_speed_10m double")
    assert [r.wind_bin for r in wt.wind_bins(df).collect()] == [None, "Calm", "Calm", "Breezy", "Windy", "Strong", None, None]
    q = spark.createDataFrame([(float(v),) for v in range(1, 9)], "v double")
    assert [r.bin for r in wt.quartiles(q, "v").collect()] == ["Q1", "Q1", "Q2", "Q2", "Q3", "Q3", "Q4", "Q4"]


def test_p_values():
    assert wt.p_value(0.0, 10) == pytest.approx(1.0)
    assert wt.p_value(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert wt.p_value(-12.7062, 1) == pytest.approx(0.05, abs=1e-6)
    assert wt.p_value(1.96, 1e7) == pytest.approx(0.05, abs=1e-4)


def test_regression_skips_what_is_not_finite(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (3.0, 7.1), (None, 1.0), (float("nan"), 2.0), (float("inf"), 2.0)], "x double, y double")
    r = wt.regression(df, "x", "y").first()
    assert r.n == 3 and r.slope == pytest.approx(2.05)


def test_least_squares_takes_a_constant_lag():
    df = signal(336)
    df["lag_2w"] = 0.0
    yhat = m.ols(df[:312], df[312:])
    assert np.abs(yhat - df["y"][312:]).max() < 0.5


@pytest.mark.parametrize("variant", m.VARIANTS)
def test_additive_model_recovers_a_signal(variant):
    df = signal(24 * 42, noise=0.5)[24 * 14 :].reset_index(drop=True)  # all lags are known
    for r in ("temperature_2m", "visibility", "precipitation_probability", "wind_speed_10m"):
        df[r] = 1.0  # a constant regressor must do no harm
    model = m.Additive(variant, samples=200).fit(df[: 24 * 21])
    out = model.predict(df[24 * 21 :].reset_index(drop=True), components=True)
    y = df["y"][24 * 21 :].to_numpy()
    assert np.mean(np.abs(out.yhat - y) / y) < 0.12 and (out.yhat >= 0).all()
    assert ((out.yhat_lower <= y) & (y <= out.yhat_upper)).mean() > 0.75 and {"trend", "daily", "weekly", "holidays", "regressors"} <= set(out)


def test_missing_regressor_and_variant_are_errors():
    with pytest.raises(ValueError, match="temperature_2m"):
        m.Additive("full_temp").fit(signal(200))
    with pytest.raises(ValueError, match="no variant"):
        m.Additive("nothing").fit(signal(200))


def test_forecasts_of_all_zones(spark):
    pdf = pd.concat([signal(24 * 28, k, 0.3).assign(h3_zone=k) for k in (1, 2)])
    tasks = spark.createDataFrame([(21, "ols", 0.05, 10.0), (14, "lags", 0.05, 10.0)], "h_days int, model string, cps double, sps double")
    f = m.forecasts(spark.createDataFrame(pdf).withColumn("ds", F.col("ds").cast("timestamp_ntz")), tasks, "2026-03-22 23:00:00", "2026-03-23 00:00:00", "2026-03-29 23:00:00")
    got = f.groupBy("h3_zone", "model").agg(F.count("*").alias("n"), sr.mape().alias("mape"), F.count("yhat_lower").alias("bounds")).collect()
    assert len(got) == 4 and all(r.n == 168 and r.mape < 15 for r in got)
    assert {r.model: r.bounds for r in got} == {"ols": 0, "lags": 168}
    assert not math.isnan(got[0].mape)
