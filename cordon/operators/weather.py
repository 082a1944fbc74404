"""Relations between weather and demand."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordon.functions import binned, finite, rounded

VARIABLES = ("temperature_2m", "apparent_temperature", "rain", "precipitation", "precipitation_probability", "wind_speed_10m", "cloud_cover", "visibility")


def hourly_totals(merged: DataFrame) -> DataFrame:
    """Quotes of all zones by hour, with the hour's weather (the same in all zones)."""
    return merged.groupBy("hour_bucket").agg(F.sum("quote_count").alias("total_quotes"), *[F.any_value(v, True).alias(v) for v in VARIABLES if v in merged.columns])


def pearson(x: Column, y: Column) -> Column:
    """Pearson r over rows where both are known; null where either is constant (an aggregate)."""
    a, b = F.when(y.isNotNull(), x.cast("double")), F.when(x.isNotNull(), y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlations(df: DataFrame, target: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pearson r of each weather variable with the target, as rows (keys, variable, r). Pairs with a null are passed over."""
    found = [v for v in VARIABLES if v in df.columns]
    wide = df.groupBy(*keys).agg(*[pearson(F.col(v), F.col(target)).alias(v) for v in found])
    return wide.unpivot(list(keys), found, "variable", "r").withColumn("r", rounded(F.col("r"), 6))


def strongest(corr: DataFrame, n: int = 4) -> DataFrame:
    return corr.orderBy(F.desc(F.abs("r")), "variable").limit(n)


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, slope, intercept, r, t of the least-squares line over rows where both are finite."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    d = df.where(finite(a) & finite(b))
    one = d.agg(F.count("*").alias("n"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), pearson(a, b).alias("r"))
    return one.withColumn("t", F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r"))))


def two_sample_t(df: DataFrame, first: Column, value: str) -> DataFrame:
    """One row: sizes, means and pooled t of the rows where `first` holds against the others; a null condition counts with the others."""
    one, v = F.coalesce(first, F.lit(False)), F.col(value).cast("double")
    parts = {"1": F.when(one, v), "2": F.when(~one, v)}
    agg = df.agg(*[f(c).alias(f"{name}{k}") for k, c in parts.items() for name, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    pooled = ((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2")) / (F.col("n1") + F.col("n2") - 2)
    return agg.withColumn("t", F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))))


def p_value(t: float, df: float) -> float:
    """Two-sided p of Student's t: the regularised incomplete beta function at df / (df + t^2), by its continued fraction."""
    from math import exp, lgamma, log

    a, b, x = df / 2, 0.5, df / (df + t * t)
    if x >= 1:
        return 1.0

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
        h = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    front = exp(a * log(x) + b * log(1 - x) + lgamma(a + b) - lgamma(a) - lgamma(b))
    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b


def with_p(one_row: DataFrame, t: str, df: Column) -> DataFrame:
    """Adds p to a row with a t statistic. The row is read: it is one."""
    row = one_row.withColumn("_df", df).first()
    value = p_value(row[t], row["_df"]) if row[t] is not None else None
    return one_row.withColumn("p", F.lit(value).cast("double"))


def quartiles(df: DataFrame, column: str, labels=("Q1", "Q2", "Q3", "Q4")) -> DataFrame:
    """Adds bin: quartile bins by exact quantiles, (low, high], the lowest value included."""
    edges = df.agg(*[rounded(F.percentile(F.col(column), float(q)), 9).alias(f"e{i}") for i, q in enumerate(np.linspace(0, 1, len(labels) + 1))])
    v, out = rounded(F.col(column), 9), F.lit(None).cast("string")
    for i, label in reversed(list(enumerate(labels))):
        low = (v >= F.col("e0")) if i == 0 else (v > F.col(f"e{i}"))
        out = F.when(low & (v <= F.col(f"e{i + 1}")), label).otherwise(out)
    return df.join(F.broadcast(edges)).withColumn("bin", out).drop(*[f"e{i}" for i in range(len(labels) + 1)])


def wind_bins(df: DataFrame) -> DataFrame:
    """Adds wind_bin; no wind and over 100 have none."""
    return df.withColumn("wind_bin", binned(F.col("wind_speed_10m"), [0, 10, 20, 30, 100], ["Calm", "Breezy", "Windy", "Strong"]))


def rain_label(df: DataFrame) -> DataFrame:
    return df.withColumn("rain_label", F.when(F.col("rain") > 0, "Rainy").otherwise("Dry"))


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    q = lambda p: F.percentile(value, p)
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"))


def hour_counts(counts: DataFrame) -> DataFrame:
    """Quotes by hour of the day."""
    return counts.groupBy(F.hour("hour_bucket").alias("hour")).agg(F.sum("quote_count").alias("n"))


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
