"""Queries over hourly series, weather and forecasts, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cordon.functions import percent_error, rounded
from cordon.lens import duck, view
from cordon.operators import series as sr
from cordon.operators import weather as wt

START, END, TRAIN_END = "2024-01-01 00:00:00", "2024-01-30 23:00:00", "2024-01-21 23:00:00"
EVAL_START, EVAL_END = "2024-01-22 00:00:00", "2024-01-28 23:00:00"
FUTURE_START, FUTURE_END = "2024-01-31 00:00:00", "2024-02-06 23:00:00"
USED = ["temperature_2m", "visibility"]


def r(c: str, digits: int) -> str:
    return f"floor(({c})*1e{digits}+5e-1)/1e{digits}"


def counts(s, d):
    return view(s, d, "quotes_hourly_h3")


def weather(s, d):
    return view(s, d, "weather_hourly")


def merged(s, d):
    return sr.with_weather(counts(s, d), weather(s, d))


def totals(s, d):
    return wt.hourly_totals(merged(s, d))


def series(s, d):
    return sr.prepare_series(counts(s, d), weather(s, d), START, END, USED)


def naive(s, d):
    return sr.seasonal_naive(series(s, d), EVAL_START, EVAL_END)


def conversion(s, d):
    return sr.historical_conversion(counts(s, d), EVAL_START)


def with_trips(s, d):
    return sr.apply_conversion(naive(s, d), conversion(s, d))


def days(s, d):
    return sr.day_metrics(naive(s, d), EVAL_START[:10])


def scored_grid(s, d):
    """MAPE of naive forecasts shifted by a share, as a stand-in for a parameter grid."""
    grid = s.createDataFrame([(c, p) for c in (0.01, 0.05, 0.1) for p in (1.0, 10.0)], "cps double, sps double")
    return naive(s, d).join(F.broadcast(grid)).groupBy("h3_zone", "cps", "sps").agg(sr.mape(yhat=F.col("yhat") * (1 + F.col("cps")) + F.col("sps") / 10).alias("mape"))


def by_model(s, d):
    n = naive(s, d)
    models = [n.withColumn("model", F.lit(m)).withColumn("yhat", F.col("yhat") * k) for m, k in (("naive", 1.0), ("low", 0.9), ("high", 1.1))]
    u = models[0].unionByName(models[1]).unionByName(models[2])
    return sr.with_day(u, EVAL_START[:10]).groupBy("h3_zone", "model", "day_i").agg(sr.mape().alias("mape"))


def rounded_columns(df, *columns, digits=6):
    return df.withColumns({c: rounded(F.col(c), digits) for c in columns})


NAMES = "quotes_hourly_h3 weather_hourly"
MERGED = "merged as (select c.*, w.* exclude (hour_bucket) from quotes_hourly_h3 c left join weather_hourly w on c.hour_bucket = w.hour_bucket)"
TOTALS = MERGED + ", totals as (select hour_bucket, sum(quote_count) as total_quotes, " + ", ".join(f"any_value({v}) as {v}" for v in wt.VARIABLES) + " from merged group by 1)"
SERIES = f"""grid as (select h3_zone, unnest(generate_series(timestamp '{START}', timestamp '{END}', interval 1 hour)) as ds from (select distinct h3_zone from quotes_hourly_h3) z),
dense as (select g.h3_zone, g.ds, coalesce(quote_count, 0)*1e0 as y, {', '.join(USED)} from grid g left join quotes_hourly_h3 q on q.h3_zone = g.h3_zone and q.hour_bucket = g.ds left join weather_hourly w on w.hour_bucket = g.ds),
series as (select h3_zone, ds, y, coalesce(lag(y, 168) over o, 0e0) as lag_1w, coalesce(lag(y, 336) over o, 0e0) as lag_2w,
 {', '.join(f"coalesce(last_value({c} ignore nulls) over (partition by h3_zone order by ds rows between unbounded preceding and current row), 0e0) as {c}" for c in USED)} from dense window o as (partition by h3_zone order by ds))"""
NAIVE = SERIES + f", naive as (select h3_zone, ds, y, lag_1w as yhat, lag_1w - 2e0 as yhat_lower, lag_1w + 2e0 as yhat_upper from series where ds between timestamp '{EVAL_START}' and timestamp '{EVAL_END}')"
CONV = f"conv as (select h3_zone, cast(hour(hour_bucket) as integer) as hour_of_day, cast(isodow(hour_bucket) - 1 as integer) as dow, avg(conversion_rate) as conv_rate from quotes_hourly_h3 where hour_bucket < timestamp '{EVAL_START}' group by 1, 2, 3)"
TRIPS = NAIVE + ", " + CONV + f""", trips as (select n.*, conv_rate, {r('greatest(yhat_lower, 0e0)*conv_rate', 2)} as trips_lower, {r('yhat*conv_rate', 2)} as trips_pred, {r('yhat_upper*conv_rate', 2)} as trips_upper
 from naive n left join conv c on c.h3_zone = n.h3_zone and c.hour_of_day = hour(ds) and c.dow = isodow(ds) - 1)"""
MAPE = "avg(case when y > 0 then abs(y-yhat)/y*100 end)"
COV = "avg(case when y between yhat_lower and yhat_upper then 1e0 else 0e0 end)*100"
DAYS = NAIVE + f", days as (select h3_zone, cast(date_diff('day', date '{EVAL_START[:10]}', cast(ds as date)) + 1 as integer) as day_i, strftime(ds, '%a %d %b') as day_label, {MAPE} as mape, {COV} as coverage from naive group by 1, 2, 3)"


def pivot(value: str, letter: str) -> str:
    cells = ", ".join(f"max(case when day_i = {k} then {value} end) as {letter}{k}" for k in range(1, 8))
    return f"select h3_zone, {cells}, avg({value}) as avg from days group by 1"


FUTURE = SERIES + f""", future as (select g.h3_zone, g.ds, coalesce(a.y, 0e0) as lag_1w, coalesce(b.y, 0e0) as lag_2w, {', '.join(f'coalesce(w.{c}, 0e0) as {c}' for c in USED)}
 from (select h3_zone, unnest(generate_series(timestamp '{FUTURE_START}', timestamp '{FUTURE_END}', interval 1 hour)) as ds from (select distinct h3_zone from quotes_hourly_h3) z) g
 left join series a on a.h3_zone = g.h3_zone and a.ds = g.ds - interval 7 days left join series b on b.h3_zone = g.h3_zone and b.ds = g.ds - interval 14 days left join weather_hourly w on w.hour_bucket = g.ds)"""
PCELLS = [f"d{k}" for k in range(1, 8)]
CCELLS = [f"c{k}" for k in range(1, 8)]


def rounding(columns) -> str:
    return ", ".join(f"{r(c, 6)} as {c}" for c in columns)


QUERIES = {
    "hourly_zone_counts": (lambda s, d: sr.zone_counts(s.read.parquet(f"{d}/events.parquet"), F.col("user_id") % 14, converted=F.col("event_type") == "purchase"), "quotes_hourly_h3", "select * from quotes_hourly_h3"),
    "zone_stability": (lambda s, d: rounded_columns(sr.zone_stability(counts(s, d), 720), "fill", "cv"), "quotes_hourly_h3", f"with per as (select h3_zone, count(*)/720e0 as fill, stddev_samp(conversion_rate)/avg(conversion_rate) as cv from quotes_hourly_h3 group by 1) select h3_zone, {r('fill', 6)} as fill, {r('cv', 6)} as cv, case when cv <= 3e-1 then 'cv_30' else 'unstable' end as cv_risk, fill >= 85e-2 as kept from per"),
    "weather_join": (merged, NAMES, "with " + MERGED + " select * from merged"),
    "hourly_totals": (totals, NAMES, "with " + TOTALS + " select * from totals"),
    "zone_series_lags": (series, NAMES, "with " + SERIES + " select * from series"),
    "future_grid": (lambda s, d: sr.future_grid(series(s, d), weather(s, d), FUTURE_START, FUTURE_END, USED), NAMES, "with " + FUTURE + " select * from future"),
    "historical_conversion": (lambda s, d: rounded_columns(conversion(s, d), "conv_rate", digits=9), "quotes_hourly_h3", "with " + CONV + f" select h3_zone, hour_of_day, dow, {r('conv_rate', 9)} as conv_rate from conv"),
    "apply_conversion": (lambda s, d: rounded_columns(with_trips(s, d), "conv_rate", digits=9), NAMES, "with " + TRIPS + f" select * replace ({r('conv_rate', 9)} as conv_rate) from trips"),
    "demand_slot": (lambda s, d: rounded_columns(sr.demand_slot(with_trips(s, d), "2024-01-24 19:00:00"), "conv_rate", digits=9), NAMES, "with " + TRIPS + f" select * replace ({r('conv_rate', 9)} as conv_rate) from trips where ds = timestamp '2024-01-24 19:00:00'"),
    "forecast_columns": (lambda s, d: with_trips(s, d).select(*[c for c in sr.FORECAST if c != "conv_rate"]).orderBy("h3_zone", "ds"), NAMES, "with " + TRIPS + " select ds, h3_zone, yhat_lower, yhat, yhat_upper, trips_lower, trips_pred, trips_upper from trips"),
    "zone_mape": (lambda s, d: rounded_columns(naive(s, d).groupBy("h3_zone").agg(sr.mape().alias("mape")), "mape"), NAMES, "with " + NAIVE + f" select h3_zone, {r(MAPE, 6)} as mape from naive group by 1"),
    "ci_coverage": (lambda s, d: rounded_columns(naive(s, d).groupBy("h3_zone").agg(sr.coverage().alias("coverage")), "coverage"), NAMES, "with " + NAIVE + f" select h3_zone, {r(COV, 6)} as coverage from naive group by 1"),
    "mape_by_day": (lambda s, d: rounded_columns(days(s, d), "mape", "coverage"), NAMES, "with " + DAYS + f" select h3_zone, day_i, day_label, {rounding(['mape', 'coverage'])} from days"),
    "mape_pivot": (lambda s, d: rounded_columns(sr.day_pivot(days(s, d), "mape"), *PCELLS, "avg"), NAMES, "with " + DAYS + f", p as ({pivot('mape', 'd')}) select h3_zone, {rounding([*PCELLS, 'avg'])} from p"),
    "metric_pivots": (lambda s, d: rounded_columns(sr.metric_pivots(days(s, d)), *PCELLS, "avg", *CCELLS, "c_avg"), NAMES, "with " + DAYS + f", p as ({pivot('mape', 'd')}), c as ({pivot('coverage', 'c')}) select p.h3_zone, {rounding(PCELLS)}, {r('p.avg', 6)} as avg, cast(row_number() over (order by p.avg, p.h3_zone) as integer) as ord, {rounding(CCELLS)}, {r('c.avg', 6)} as c_avg from p join c on p.h3_zone = c.h3_zone"),
    "coverage_summary": (lambda s, d: sr.coverage_summary(days(s, d)), NAMES, "with " + DAYS + f", per as (select h3_zone, avg(mape) as m, avg(coverage) as c from days group by 1) select {r('quantile_cont(m, 0.5)', 6)} as median_mape, {r('quantile_cont(c, 0.5)', 6)} as median_coverage, count(*) as n_zones from per"),
    "best_params": (
        lambda s, d: rounded_columns(sr.best_params(scored_grid(s, d), (0.05, 10.0)), "best_mape", "default_mape", "gain"), NAMES,
        "with " + NAIVE + f""", g as (select h3_zone, cps, sps, avg(case when y > 0 then abs(y-(yhat*(1+cps)+sps/10))/y*100 end) as mape from naive cross join (select unnest([0.01e0, 0.05e0, 0.1e0]) as cps) a cross join (select unnest([1e0, 10e0]) as sps) b group by 1, 2, 3),
best as (select * from g qualify row_number() over (partition by h3_zone order by mape, cps, sps) = 1)
select best.h3_zone, best.cps, best.sps, {r('best.mape', 6)} as best_mape, {r('g.mape', 6)} as default_mape, {r('g.mape-best.mape', 6)} as gain from best join g on g.h3_zone = best.h3_zone and g.cps = 5e-2 and g.sps = 1e1""",
    ),
    "best_zone": (lambda s, d: rounded_columns(naive(s, d).groupBy("h3_zone").agg(sr.mape().alias("mape")).orderBy("mape", "h3_zone").limit(1), "mape"), NAMES, "with " + NAIVE + f", z as (select h3_zone, {MAPE} as mape from naive group by 1) select h3_zone, {r('mape', 6)} as mape from z order by z.mape, h3_zone limit 1"),
    "model_table": (
        lambda s, d: rounded_columns(sr.model_table(by_model(s, d), ["naive", "low", "high"]), "naive", "low", "high"), NAMES,
        "with " + NAIVE + f""", m as (select h3_zone, model, date_diff('day', date '{EVAL_START[:10]}', cast(ds as date)) as k, avg(case when y > 0 then abs(y-yhat*f)/y*100 end) as mape from naive cross join (values ('naive', 1e0), ('low', 9e-1), ('high', 11e-1)) v(model, f) group by 1, 2, 3)
select h3_zone, {', '.join(f"{r(f"quantile_cont(mape, 0.5) filter (where model = '{m}')", 6)} as {m}" for m in ('naive', 'low', 'high'))} from m group by 1""",
    ),
    "percent_errors": (lambda s, d: naive(s, d).select("h3_zone", "ds", rounded(percent_error(F.col("y"), F.col("yhat")), 6).alias("pct_error")), NAMES, "with " + NAIVE + f" select h3_zone, ds, {r('abs(yhat-y)/nullif(y, 0e0)*100', 6)} as pct_error from naive"),
    "weather_corr": (lambda s, d: wt.correlations(totals(s, d), "total_quotes"), NAMES, "with " + TOTALS + ", ".join([""]) + " select * from (" + " union all ".join(f"select '{v}' as variable, {r(f'corr({v}, total_quotes)', 6)} as r from totals" for v in wt.VARIABLES) + ") x"),
    "weather_corr_top": (lambda s, d: wt.strongest(wt.correlations(totals(s, d), "total_quotes")), NAMES, "with " + TOTALS + " select * from (" + " union all ".join(f"select '{v}' as variable, {r(f'corr({v}, total_quotes)', 6)} as r from totals" for v in wt.VARIABLES) + ") x order by abs(r) desc, variable limit 4"),
    "zone_weather_corr": (lambda s, d: wt.correlations(merged(s, d), "quote_count", ("h3_zone",)), NAMES, "with " + MERGED + " select * from (" + " union all ".join(f"select h3_zone, '{v}' as variable, {r(f'corr({v}, quote_count)', 6)} as r from merged group by 1" for v in wt.VARIABLES) + ") x"),
    "weather_regression": (lambda s, d: rounded_columns(wt.regression(totals(s, d), "temperature_2m", "total_quotes"), "slope", "intercept", "r", "t"), NAMES, "with " + TOTALS + f", o as (select count(*) as n, regr_slope(total_quotes, temperature_2m) as slope, regr_intercept(total_quotes, temperature_2m) as intercept, corr(temperature_2m, total_quotes) as r from totals where temperature_2m is not null) select n, {r('slope', 6)} as slope, {r('intercept', 6)} as intercept, {r('r', 6)} as r, {r('r*sqrt((n-2)/(1-r*r))', 6)} as t from o"),
    "weather_regression_p": (lambda s, d: wt.with_p(wt.regression(totals(s, d), "temperature_2m", "total_quotes"), "t", F.col("n") - 2), None, None),
    "rain_ttest": (
        lambda s, d: rounded_columns(wt.two_sample_t(totals(s, d), F.coalesce(F.col("rain") <= 0, F.lit(True)), "total_quotes"), "mean1", "mean2", "var1", "var2", "t"), NAMES,
        "with " + TOTALS + f""", o as (select count(*) filter (where not coalesce(rain > 0, false)) as n1, avg(total_quotes) filter (where not coalesce(rain > 0, false)) as mean1, var_samp(total_quotes) filter (where not coalesce(rain > 0, false)) as var1,
 count(*) filter (where rain > 0) as n2, avg(total_quotes) filter (where rain > 0) as mean2, var_samp(total_quotes) filter (where rain > 0) as var2 from totals)
select n1, n2, {rounding(['mean1', 'mean2', 'var1', 'var2'])}, {r('(mean1-mean2)/sqrt(((n1-1)*var1+(n2-1)*var2)/(n1+n2-2)*(1e0/n1+1e0/n2))', 6)} as t from o""",
    ),
    "rain_groups": (lambda s, d: wt.box_stats(wt.rain_label(totals(s, d)), "rain_label", "total_quotes"), NAMES, "with " + TOTALS + " select case when rain > 0 then 'Rainy' else 'Dry' end as rain_label, count(*) as n, quantile_cont(total_quotes, 0.25) as q1, quantile_cont(total_quotes, 0.5) as median, quantile_cont(total_quotes, 0.75) as q3 from totals group by 1"),
    "temp_quartiles": (
        lambda s, d: wt.box_stats(wt.quartiles(totals(s, d), "temperature_2m"), "bin", "total_quotes"), NAMES,
        "with " + TOTALS + f""", e as (select {', '.join(f"{r(f'quantile_cont(temperature_2m, {q})', 9)} as e{i}" for i, q in enumerate((0.0, 0.25, 0.5, 0.75, 1.0)))} from totals),
b as (select *, {r('temperature_2m', 9)} as v from totals, e), l as (select *, case when v >= e0 and v <= e1 then 'Q1' when v > e1 and v <= e2 then 'Q2' when v > e2 and v <= e3 then 'Q3' when v > e3 and v <= e4 then 'Q4' end as bin from b)
select bin, count(*) as n, quantile_cont(total_quotes, 0.25) as q1, quantile_cont(total_quotes, 0.5) as median, quantile_cont(total_quotes, 0.75) as q3 from l where bin is not null group by 1""",
    ),
    "wind_bins": (lambda s, d: wt.wind_bins(totals(s, d)).groupBy("wind_bin").agg(F.count("*").alias("n")), NAMES, "with " + TOTALS + " select case when wind_speed_10m > 0 and wind_speed_10m <= 10 then 'Calm' when wind_speed_10m > 10 and wind_speed_10m <= 20 then 'Breezy' when wind_speed_10m > 20 and wind_speed_10m <= 30 then 'Windy' when wind_speed_10m > 30 and wind_speed_10m <= 100 then 'Strong' end as wind_bin, count(*) as n from totals group by 1"),
    "missing_counts": (lambda s, d: wt.missing_counts(weather(s, d), list(wt.VARIABLES)), "weather_hourly", "select " + ", ".join(f"count(*) filter (where {v} is null) as {v}" for v in wt.VARIABLES) + " from weather_hourly"),
    "count_range": (lambda s, d: counts(s, d).agg(F.min("quote_count").alias("min_count"), rounded(F.avg("quote_count"), 6).alias("mean_count"), F.max("quote_count").alias("max_count"), F.min("hour_bucket").alias("first_hour"), F.max("hour_bucket").alias("last_hour"), F.count_distinct("h3_zone").alias("n_zones")), "quotes_hourly_h3", f"select min(quote_count) as min_count, {r('avg(quote_count)', 6)} as mean_count, max(quote_count) as max_count, min(hour_bucket) as first_hour, max(hour_bucket) as last_hour, count(distinct h3_zone) as n_zones from quotes_hourly_h3"),
}


def queries() -> dict:
    return {k: f for k, (f, _, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: duck(names, sql) for k, (_, names, sql) in QUERIES.items() if sql}
