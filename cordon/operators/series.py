"""Hourly zone series: dense grids, lags, conversion, forecast metrics, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cordon.functions import clip_low, rounded

WEEK_HOURS = 168


def zone_counts(events: DataFrame, zone: Column, ts: str = "ts", converted: Column | None = None) -> DataFrame:
    """Quotes, trips and conversion by zone and hour."""
    hits = F.count_if(converted) if converted is not None else F.lit(None).cast("long")
    return events.groupBy(zone.alias("h3_zone"), F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour_bucket")).agg(F.count("*").alias("quote_count"), hits.alias("trip_count")).withColumn("conversion_rate", F.col("trip_count") / F.col("quote_count"))


def zone_stability(counts: DataFrame, hours: int, min_fill: float = 0.85, max_cv: float = 0.30) -> DataFrame:
    """Per zone: share of hours with quotes, variation of conversion, label cv_NN if at most max_cv (else unstable), and whether it is filled enough."""
    per = counts.groupBy("h3_zone").agg((F.count_if(F.col("quote_count") > 0) / F.lit(hours)).alias("fill"), F.try_divide(F.stddev_samp("conversion_rate"), F.avg("conversion_rate")).alias("cv"))
    return per.withColumns({"cv_risk": F.when(F.col("cv") <= max_cv, f"cv_{round(max_cv * 100)}").otherwise("unstable"), "kept": F.col("fill") >= min_fill})


def zones_labelled(stability: DataFrame, label: str) -> DataFrame:
    """Zones that carry a risk label, each once, in order: those that are forecast."""
    return stability.where(F.col("cv_risk") == label).select("h3_zone").distinct().orderBy("h3_zone")


def with_actuals(forecast: DataFrame, actual: DataFrame) -> DataFrame:
    """The forecast with the counts of its hours (h3_zone, ds, y), null where there are none."""
    return forecast.join(actual.select("h3_zone", "ds", "y"), ["h3_zone", "ds"], "left")


def with_weather(counts: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather of the hour for all zones. Weather is broadcast if its size is under the session's threshold, as a row an hour is."""
    return counts.join(weather, "hour_bucket", "left")


def spine(zones: DataFrame, start: str, end: str) -> DataFrame:
    """Every zone with every hour from start to end."""
    hours = F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.expr("interval 1 hour"))
    return zones.select("h3_zone").distinct().withColumn("hour_bucket", F.explode(hours))


def prepare_series(counts: DataFrame, weather: DataFrame, start: str, end: str, weather_columns: list[str], weeks: tuple[int, ...] = (1, 2)) -> DataFrame:
    """The dense series of all zones: y (0 where nothing was counted), weather filled forward then 0, lags in weeks (0 before the start)."""
    columns = [c for c in weather_columns if c in weather.columns]
    dense = spine(counts, start, end).join(counts.select("h3_zone", "hour_bucket", "quote_count"), ["h3_zone", "hour_bucket"], "left").join(weather.select("hour_bucket", *columns), "hour_bucket", "left")
    order = W.partitionBy("h3_zone").orderBy("hour_bucket")
    past = order.rowsBetween(W.unboundedPreceding, 0)
    out = dense.withColumn("y", F.coalesce("quote_count", F.lit(0)).cast("double")).withColumns({c: F.coalesce(F.last(c, True).over(past), F.lit(0.0)) for c in columns})
    out = out.withColumns({f"lag_{k}w": F.coalesce(F.lag("y", WEEK_HOURS * k).over(order), F.lit(0.0)) for k in weeks})
    return out.select("h3_zone", F.col("hour_bucket").alias("ds"), "y", *[f"lag_{k}w" for k in weeks], *columns)


def lag_by_time(grid: DataFrame, history: DataFrame, weeks: int) -> DataFrame:
    """Adds lag_{k}w found by timestamp in the history (h3_zone, ds, y), 0 where there is none."""
    past = history.select("h3_zone", (F.col("ds") + F.expr(f"interval {7 * weeks} days")).alias("ds"), F.col("y").alias(f"lag_{weeks}w"))
    return grid.join(past, ["h3_zone", "ds"], "left").na.fill(0.0, [f"lag_{weeks}w"])


def future_grid(history: DataFrame, weather: DataFrame, start: str, end: str, weather_columns: list[str], fill_forward: bool = False) -> DataFrame:
    """Hours to forecast, with lags by timestamp and weather (0 where missing, or filled forward)."""
    grid = spine(history, start, end).withColumnRenamed("hour_bucket", "ds")
    for k in (1, 2):
        grid = lag_by_time(grid, history, k)
    out = grid.join(weather.select(F.col("hour_bucket").alias("ds"), *weather_columns), "ds", "left")
    past = W.partitionBy("h3_zone").orderBy("ds").rowsBetween(W.unboundedPreceding, 0)
    return out.withColumns({c: F.coalesce(F.last(c, True).over(past) if fill_forward else F.col(c), F.lit(0.0)) for c in weather_columns})


def historical_conversion(counts: DataFrame, cutoff: str) -> DataFrame:
    """Mean of hourly conversion rates by zone, UTC hour and weekday (Monday 0), strictly before the cutoff."""
    before = counts.where(F.col("hour_bucket") < F.lit(cutoff).cast("timestamp_ntz"))
    return before.groupBy("h3_zone", F.hour("hour_bucket").alias("hour_of_day"), F.weekday("hour_bucket").alias("dow")).agg(F.avg("conversion_rate").alias("conv_rate"))


FORECAST = ["ds", "h3_zone", "yhat_lower", "yhat", "yhat_upper", "conv_rate", "trips_lower", "trips_pred", "trips_upper"]


def apply_conversion(forecast: DataFrame, conversion: DataFrame) -> DataFrame:
    """Trips from forecast quotes. The lower bound counts as 0 if it is less, but is kept as it is; slots without a rate have no trips.

    Conversion has 168 rows a zone at most; the join is left to the optimiser, which broadcasts it while it is small.
    """
    slot = forecast.withColumns({"hour_of_day": F.hour("ds"), "dow": F.weekday("ds")})
    met = slot.join(conversion, ["h3_zone", "hour_of_day", "dow"], "left")
    return met.withColumns({
        "trips_lower": rounded(clip_low(F.col("yhat_lower")) * F.col("conv_rate"), 2),
        "trips_pred": rounded(F.col("yhat") * F.col("conv_rate"), 2),
        "trips_upper": rounded(F.col("yhat_upper") * F.col("conv_rate"), 2),
    }).drop("hour_of_day", "dow")


def save_forecast(df: DataFrame, path: str) -> DataFrame:
    """The standard columns that exist, sorted by zone and hour, written as Parquet and returned."""
    out = df.select(*[c for c in FORECAST if c in df.columns]).orderBy("h3_zone", "ds")
    out.write.mode("overwrite").parquet(path)
    return out


def seasonal_naive(series: DataFrame, start: str, end: str, margin: float = 2.0) -> DataFrame:
    """A forecast that repeats the week before: yhat = lag_1w, bounds at a margin."""
    window = series.where(F.col("ds").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    return window.select("h3_zone", "ds", "y", F.col("lag_1w").alias("yhat"), (F.col("lag_1w") - margin).alias("yhat_lower"), (F.col("lag_1w") + margin).alias("yhat_upper"))


def mape(y: Column | None = None, yhat: Column | None = None) -> Column:
    """Mean absolute percentage error over rows with y > 0 and a prediction; null if there are none (an aggregate)."""
    y, yhat = F.col("y") if y is None else y, F.col("yhat") if yhat is None else yhat
    return F.avg(F.when(y > 0, F.abs(y - yhat) / y * 100))


def coverage() -> Column:
    """Percentage of rows within their bounds; a missing bound is a miss (an aggregate)."""
    return F.avg(F.when(F.col("y").between(F.col("yhat_lower"), F.col("yhat_upper")), 1.0).otherwise(0.0)) * 100


def with_day(df: DataFrame, start: str) -> DataFrame:
    """Adds day_i, the day of the window from 1, and its label."""
    return df.withColumns({"day_i": F.datediff(F.col("ds"), F.lit(start).cast("date")) + 1, "day_label": F.date_format("ds", "EEE dd MMM")})


def day_metrics(forecast: DataFrame, start: str, keys: tuple[str, ...] = ("h3_zone",)) -> DataFrame:
    return with_day(forecast, start).groupBy(*keys, "day_i", "day_label").agg(mape().alias("mape"), coverage().alias("coverage"))


def day_pivot(metrics: DataFrame, value: str, days: int = 7) -> DataFrame:
    """Zones by days, with the mean over days that have a value, best first. Cells must be unique; a second value of a cell is an error."""
    once = F.when(F.count("*") <= 1, F.first(value)).otherwise(F.raise_error(F.lit("two values for a cell")).cast("double"))
    wide = metrics.groupBy("h3_zone", "day_i").agg(once.alias(value)).groupBy("h3_zone").pivot("day_i", list(range(1, days + 1))).agg(F.first(value))
    for k in range(1, days + 1):
        wide = wide.withColumnRenamed(str(k), f"d{k}")
    cells = F.array_compact(F.array(*[F.col(f"d{k}") for k in range(1, days + 1)]))
    return wide.withColumn("avg", F.when(F.size(cells) > 0, F.aggregate(cells, F.lit(0.0), lambda a, x: a + x) / F.size(cells))).orderBy("avg", "h3_zone")


def metric_pivots(metrics: DataFrame, days: int = 7) -> DataFrame:
    """MAPE pivot, with coverage columns (c1 ... and c_avg) in its order: ord from 1."""
    m = day_pivot(metrics, "mape", days)
    c = day_pivot(metrics, "coverage", days)
    for k in range(1, days + 1):
        c = c.withColumnRenamed(f"d{k}", f"c{k}")
    return m.withColumn("ord", F.row_number().over(W.orderBy("avg", "h3_zone"))).join(c.withColumnRenamed("avg", "c_avg"), "h3_zone")


def best_params(grid: DataFrame, default: tuple[float, float]) -> DataFrame:
    """Per zone: parameters (cps, sps) of the least MAPE (of ties the smaller ones), MAPE of the default ones, and the gain."""
    best = grid.groupBy("h3_zone").agg(
        F.min_by(F.struct("cps", "sps", "mape"), F.struct("mape", "cps", "sps")).alias("b"),
        F.max(F.when((F.col("cps") == default[0]) & (F.col("sps") == default[1]), F.col("mape"))).alias("default_mape"),
    )
    return best.select("h3_zone", F.col("b.cps").alias("cps"), F.col("b.sps").alias("sps"), F.col("b.mape").alias("best_mape"), "default_mape", (F.col("default_mape") - F.col("b.mape")).alias("gain"))


def coverage_summary(metrics: DataFrame) -> DataFrame:
    """One row: median over zones of their mean MAPE and mean coverage."""
    per = metrics.groupBy("h3_zone").agg(F.avg("mape").alias("m"), F.avg("coverage").alias("c"))
    return per.agg(rounded(F.percentile("m", 0.5), 6).alias("median_mape"), rounded(F.percentile("c", 0.5), 6).alias("median_coverage"), F.count("*").alias("n_zones"))


def tuned_summary(default: DataFrame, tuned: DataFrame) -> DataFrame:
    """Per zone mean coverage and mean MAPE with default and tuned parameters, in rising order of coverage, and the medians of both MAPEs over zones."""
    per = lambda m, name: m.groupBy("h3_zone").agg(F.avg("mape").alias(f"{name}_mape"), F.avg("coverage").alias(f"{name}_coverage"))
    both = per(default, "default").join(per(tuned, "tuned"), "h3_zone")
    medians = both.agg(F.percentile("default_mape", 0.5).alias("median_default_mape"), F.percentile("tuned_mape", 0.5).alias("median_tuned_mape"))
    return both.join(F.broadcast(medians)).orderBy("tuned_coverage", "h3_zone")


def model_table(metrics: DataFrame, models: list[str], keys: tuple[str, ...] = ("h3_zone",)) -> DataFrame:
    """Median MAPE with one column a model."""
    return metrics.groupBy(*keys).pivot("model", models).agg(F.percentile("mape", 0.5))


def demand_slot(forecast: DataFrame, at: str) -> DataFrame:
    return forecast.where(F.col("ds") == F.lit(at).cast("timestamp_ntz"))
