"""Forecast models per zone: least squares, and an additive model with trend, seasons and regressors.

The additive model is a re-implementation of the published decomposable design (piecewise
linear trend times one plus seasonality and regressors, fitted to the posterior mode); it is
not the reference library and makes no claim to equal its numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordon.operators.series import mape

#: Regressors of each variant.
LAGS = ["lag_1w", "lag_2w"]
VARIANTS = {"base": [], "lags": LAGS, "full_temp": [*LAGS, "temperature_2m"], "full_temp_vis": [*LAGS, "temperature_2m", "visibility"], "full": [*LAGS, "temperature_2m", "visibility", "precipitation_probability", "wind_speed_10m"]}
CPS_GRID, SPS_GRID = (0.001, 0.01, 0.05, 0.1, 0.5), (1.0, 5.0, 10.0, 20.0)


def regressors(variant: str) -> list[str]:
    if variant not in VARIANTS:
        raise ValueError(f"no variant {variant!r}; there are {', '.join(VARIANTS)}")
    return VARIANTS[variant]


def ols(train: pd.DataFrame, future: pd.DataFrame) -> np.ndarray:
    """y on two lags, hours and weekdays, by least squares of least norm (a constant lag gets no weight); not below 0."""
    hours, days = sorted(train["ds"].dt.hour.unique()), sorted(train["ds"].dt.dayofweek.unique())

    def design(df):
        cols = [np.ones(len(df)), df["lag_1w"].to_numpy(float), df["lag_2w"].to_numpy(float)]
        cols += [(df["ds"].dt.hour == h).to_numpy(float) for h in hours[1:]] + [(df["ds"].dt.dayofweek == d).to_numpy(float) for d in days[1:]]
        return np.column_stack(cols)

    beta, *_ = np.linalg.lstsq(design(train), train["y"].to_numpy(float), rcond=None)
    return np.maximum(design(future) @ beta, 0)


@dataclass
class Additive:
    """trend(t) * (1 + seasons + regressors); rate changes have Laplace(cps) priors, seasons Normal(sps) ones."""

    variant: str = "full_temp_vis"
    cps: float = 0.05
    sps: float = 10.0
    changepoints: int = 25
    interval: float = 0.95
    samples: int = 1000
    holidays: dict[str, str] = field(default_factory=dict)
    seed: int = 42

    def _t(self, ds: pd.Series) -> np.ndarray:
        return ((ds - self.start) / self.span).to_numpy(float)

    def _trend_design(self, t: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(t)), t, np.maximum(t[:, None] - self.knots[None, :], 0)])

    def _season_design(self, df: pd.DataFrame) -> tuple[np.ndarray, list[str]]:
        hours = ((df["ds"] - pd.Timestamp("2000-01-03")) / pd.Timedelta(hours=1)).to_numpy(float)
        cols, names = [], []
        for name, period, order in (("daily", 24.0, 8), ("weekly", 168.0, 3)):
            for k in range(1, order + 1):
                cols += [np.sin(2 * np.pi * k * hours / period), np.cos(2 * np.pi * k * hours / period)]
                names += [name] * 2
        day = df["ds"].dt.strftime("%Y-%m-%d")
        for h in sorted(set(self.holidays.values())):
            cols.append(day.map(self.holidays).eq(h).to_numpy(float))
            names.append("holidays")
        for r in regressors(self.variant):
            if r not in df:
                raise ValueError(f"variant {self.variant!r} needs the column {r!r}")
            mean, scale = self.scales[r]
            cols.append((df[r].to_numpy(float) - mean) / scale)
            names.append("regressors")
        return np.column_stack(cols), names

    def fit(self, df: pd.DataFrame) -> Additive:
        self.start, self.span = df["ds"].min(), max(df["ds"].max() - df["ds"].min(), pd.Timedelta(hours=1))
        self.scale = max(float(df["y"].abs().max()), 1e-9)
        y, t = df["y"].to_numpy(float) / self.scale, self._t(df["ds"])
        self.knots = np.quantile(t[t <= 0.8], np.linspace(0, 1, min(self.changepoints, max(1, len(t) // 5)) + 1)[1:])
        self.scales = {r: (float(df[r].mean()), float(df[r].std(ddof=0)) or 1.0) for r in regressors(self.variant) if r in df}
        a, (s, self.names) = self._trend_design(t), self._season_design(df)
        self.beta, noise = np.zeros(s.shape[1]), max(float(y.std()), 1e-3)
        laplace = np.full(len(self.knots), self.cps)
        for _ in range(30):
            m = 1 + s @ self.beta
            prior = np.concatenate([[1 / 25, 1 / 25], 1 / (self.cps * np.maximum(laplace, 1e-6))])
            am = a * m[:, None]
            self.trend = np.linalg.solve(am.T @ am / noise**2 + np.diag(prior), am.T @ y / noise**2)
            laplace = np.abs(self.trend[2:])
            g = a @ self.trend
            sg = s * g[:, None]
            old, self.beta = self.beta, np.linalg.solve(sg.T @ sg / noise**2 + np.eye(s.shape[1]) / self.sps**2, sg.T @ (y - g) / noise**2)
            noise = max(float(np.sqrt(np.mean((y - g * (1 + s @ self.beta)) ** 2))), 1e-4)
            if np.abs(self.beta - old).max() < 1e-6:
                break
        self.noise = noise
        return self

    def predict(self, df: pd.DataFrame, components: bool = False) -> pd.DataFrame:
        """yhat (not below 0) with bounds (which may be) from simulated trend changes and noise; components of the fit if asked for."""
        t = self._t(df["ds"])
        s, names = self._season_design(df)
        g, season = self._trend_design(t) @ self.trend, s @ self.beta
        out = pd.DataFrame({"ds": df["ds"].to_numpy(), "yhat": np.maximum(g * (1 + season), 0) * self.scale})
        rng, ahead = np.random.default_rng(self.seed), np.maximum(t - 1, 0)
        size, rate = max(float(np.abs(self.trend[2:]).mean()), 1e-8), len(self.knots)
        drift = np.zeros((self.samples, len(t)))
        if ahead.max() > 0:
            for k, n in enumerate(rng.poisson(rate * ahead.max(), self.samples)):
                at, change = rng.uniform(0, ahead.max(), n), rng.laplace(0, size, n)
                drift[k] = (np.maximum(ahead[:, None] - at[None, :], 0) * change[None, :]).sum(1)
        draws = ((g[None, :] + drift) * (1 + season)[None, :] + rng.normal(0, self.noise, (self.samples, len(t)))) * self.scale
        tail = (1 - self.interval) / 2
        out["yhat_lower"], out["yhat_upper"] = np.quantile(draws, tail, axis=0), np.quantile(draws, 1 - tail, axis=0)
        if components:
            out["trend"] = g * self.scale
            for kind in ("daily", "weekly", "holidays", "regressors"):
                pick = [i for i, n in enumerate(names) if n == kind]
                out[kind] = s[:, pick] @ self.beta[pick]
        return out


FORECAST = "h3_zone long, h_days int, model string, cps double, sps double, ds timestamp_ntz, y double, yhat double, yhat_lower double, yhat_upper double"
MODELS = ["ols", *VARIANTS]


def forecasts(series: DataFrame, tasks: DataFrame, train_until: str, predict_from: str, predict_until: str, holidays: dict[str, str] | None = None, components: bool = False) -> DataFrame:
    """Forecasts of every zone for every row of `tasks` (h_days, model, cps, sps): a task a fit. With a column h3_zone, a row holds for its zone only.

    h_days of history before the end of training are used (0: all). A zone's series is of
    calendar size; it is copied once a task row.
    """
    schema = FORECAST + (", trend double, daily double, weekly double, holidays double, regressors double" if components else "")
    columns = [c.split()[0] for c in schema.split(", ")]
    last, first, end = pd.Timestamp(train_until), pd.Timestamp(predict_from), pd.Timestamp(predict_until)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds").reset_index(drop=True)
        head = pdf.iloc[0]
        train = pdf[(pdf["ds"] <= last) & ((pdf["ds"] > last - pd.Timedelta(days=int(head.h_days))) | (head.h_days == 0))]
        future = pdf[(pdf["ds"] >= first) & (pdf["ds"] <= end)]
        if head["model"] == "ols":
            out = pd.DataFrame({"ds": future["ds"].to_numpy(), "yhat": ols(train, future), "yhat_lower": np.nan, "yhat_upper": np.nan})
        else:
            out = Additive(head["model"], float(head.cps), float(head.sps), holidays=holidays or {}).fit(train).predict(future, components)
        out["y"] = future["y"].to_numpy()
        for k in ("h3_zone", "h_days", "model", "cps", "sps"):
            out[k] = head[k]
        return out.reindex(columns=columns)

    # tasks are a parameter table, or come from other fits and may be long in coming
    many = series.join(tasks.hint("merge"), "h3_zone") if "h3_zone" in tasks.columns else series.join(F.broadcast(tasks))
    return many.groupBy("h3_zone", "h_days", "model", "cps", "sps").applyInPandas(one, schema).withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("yhat_lower", "yhat_upper")})


def backtest_tasks(spark, horizons=(14, 21), models=tuple(MODELS)) -> DataFrame:
    return spark.createDataFrame([(h, m, 0.05, 10.0) for h in horizons for m in models], "h_days int, model string, cps double, sps double")


def grid_tasks(spark, variant: str = "full_temp_vis", h_days: int = 21, cps=CPS_GRID, sps=SPS_GRID) -> DataFrame:
    return spark.createDataFrame([(h_days, variant, float(c), float(s)) for c in cps for s in sps], "h_days int, model string, cps double, sps double")


def grid_scores(forecast: DataFrame) -> DataFrame:
    """MAPE per zone and parameters, best first."""
    return forecast.groupBy("h3_zone", "cps", "sps").agg(mape().alias("mape")).orderBy("h3_zone", "mape")
