"""Queries over quote sessions, each with its DuckDB SQL."""

from __future__ import annotations

from cordon.lens import duck, view
from cordon.operators import quotes as q

HAVERSINE = "2*6371000e0*atan2(sqrt({a}), sqrt(greatest(1-({a}),0e0)))".format(a="pow(sin((radians(b.lat)-radians(a.lat))/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2),2)")
ORDER = "l_linenumber, l_partkey, l_suppkey, quoted_price"
TS = "quote_creation_timestamp"
BAD = f"""with f1 as (select quote_id from quotes_raw group by 1 having count(distinct quote_converted) > 1),
f2 as (select distinct quote_id from quotes_raw where not coalesce(pickup_latitude between 51.260 and 51.764 and pickup_longitude between -0.681 and 0.423
  and dropoff_latitude between 51.260 and 51.764 and dropoff_longitude between -0.681 and 0.423, false)),
pts as (select distinct quote_id, pickup_latitude as lat, pickup_longitude as lon from quotes_raw),
spread as (select a.quote_id, max({HAVERSINE}) as m from pts a join pts b on a.quote_id=b.quote_id group by 1),
f3 as (select quote_id from spread where m > 1000),
ett as (select quote_id, {TS}, arg_min(estimated_travel_time, (l_linenumber, l_partkey, l_suppkey, quoted_price)) as e from quotes_raw where estimated_travel_time is not null group by 1, 2),
f4 as (select quote_id from ett group by 1 having max(e)-min(e) > 1000),
"""
CLEAN = BAD + "cleaned as (select * from quotes_raw where quote_id not in (select quote_id from f1 union all select quote_id from f2 union all select quote_id from f3 union all select quote_id from f4))\n"
ARM = "md5(concat_ws('|', cast(quote_id as varchar), cast(cast(round(quoted_price*100) as bigint) as varchar), '42'))"
CANON = "quote_id, quote_creation_timestamp, pickup_latitude, pickup_longitude, dropoff_latitude, dropoff_longitude, quoted_price, estimated_travel_time, quote_converted"
LAST_ARM = f"""row_number() over (partition by quote_id order by {ARM}, quoted_price, {ORDER}) as n"""
TRIP = "quote_id, pickup_latitude as pickup_lat, pickup_longitude as pickup_lon, dropoff_latitude as dropoff_lat, dropoff_longitude as dropoff_lon, quoted_price as sampled_revenue, estimated_travel_time"
CALLS = f"""calls as (select quote_id, {TS} as call_ts, {', '.join(f"arg_min({c}, ({ORDER})) as {a}" for c, a in (('pickup_latitude', 'pickup_lat'), ('pickup_longitude', 'pickup_lon'), ('dropoff_latitude', 'dropoff_lat'), ('dropoff_longitude', 'dropoff_lon'), ('estimated_travel_time', 'time_travel_estimated'), ('quote_converted', 'quote_converted')))},
  list_sort(list(distinct quoted_price)) as prices from quotes_raw group by 1, 2),
table_of_calls as (select *, row_number() over w - 1 as call_id, floor((epoch_us(call_ts)-epoch_us(lag(call_ts) over w))/1e6*1000*1e2+5e-1)/1e2 as delta_ms_prev,
  [floor((prices[i+1]-prices[i])*1e2+5e-1)/1e2 for i in range(1, len(prices))] as price_gaps, len(prices) as n_prices, coalesce(prices = lag(prices) over w, false) as is_repeat_call
  from calls window w as (partition by quote_id order by call_ts))
"""


def r(c: str, digits: int) -> str:
    return f"floor(({c})*1e{digits}+5e-1)/1e{digits}"


def per_quote(f):
    return lambda s, d: f(view(s, d, "quotes_raw"))


def canonical(df):
    return q.canonical_quotes(q.canonical_location(q.clean(df)))


QUERIES = {
    "clean_f1_inconsistent": (per_quote(q.filter_inconsistent_conversion), BAD + "x as (select 1) select * from quotes_raw where quote_id not in (select quote_id from f1)"),
    "clean_f2_bbox": (per_quote(q.filter_outside), BAD + "x as (select 1) select * from quotes_raw where quote_id not in (select quote_id from f2)"),
    "clean_f3_spread": (per_quote(q.filter_location_spread), BAD + "x as (select 1) select * from quotes_raw where quote_id not in (select quote_id from f3)"),
    "clean_f4_ett": (per_quote(q.filter_ett_variation), BAD + "x as (select 1) select * from quotes_raw where quote_id not in (select quote_id from f4)"),
    "clean_pipeline": (per_quote(q.clean), CLEAN + "select * from cleaned"),
    "clean_drop_counts": (
        per_quote(q.drop_counts),
        BAD + """per as (select distinct quote_id, quote_id in (select quote_id from f1) as f1, quote_id in (select quote_id from f2) as f2, quote_id in (select quote_id from f3) as f3, quote_id in (select quote_id from f4) as f4 from quotes_raw)
select count(*) filter (where f1) as dropped_f1, count(*) filter (where not f1 and f2) as dropped_f2, count(*) filter (where not f1 and not f2 and f3) as dropped_f3,
 count(*) filter (where not f1 and not f2 and not f3 and f4) as dropped_f4, count(*) filter (where not (f1 or f2 or f3 or f4)) as kept from per""",
    ),
    "canonical_location": (
        per_quote(q.canonical_location),
        f"""select * replace ({', '.join(f'first_value({c}) over w as {c}' for c in q.PLACES)}) from quotes_raw
window w as (partition by quote_id order by {TS} desc, {ORDER} rows between unbounded preceding and unbounded following)""",
    ),
    "canonical_quotes": (
        per_quote(canonical),
        CLEAN + f""", placed as (select * replace ({', '.join(f'first_value({c}) over w as {c}' for c in q.PLACES)}) from cleaned window w as (partition by quote_id order by {TS} desc, {ORDER} rows between unbounded preceding and unbounded following)),
lasts as (select * from placed qualify {TS} = max({TS}) over (partition by quote_id)),
arms as (select *, {LAST_ARM} from lasts) select {CANON} from arms where n = 1""",
    ),
    "consistency_report": (
        per_quote(lambda df: q.consistency_report(q.canonical_location(q.clean(df)))),
        CLEAN + f""", placed as (select * replace ({', '.join(f'first_value({c}) over w as {c}' for c in q.PLACES)}) from cleaned window w as (partition by quote_id order by {TS} desc, {ORDER} rows between unbounded preceding and unbounded following)),
per as (select quote_id, count(distinct quote_converted) as c, greatest(count(distinct pickup_latitude), count(distinct pickup_longitude)) as p, greatest(count(distinct dropoff_latitude), count(distinct dropoff_longitude)) as f from placed group by 1),
one as (select count(*) as n_quotes, count(*) filter (where c > 1) as n_mixed_conversion, count(*) filter (where p > 1) as n_mixed_pickup, count(*) filter (where f > 1) as n_mixed_dropoff from per)
select *, n_mixed_conversion = 0 as conversion_ok, n_mixed_pickup = 0 as pickup_location_ok, n_mixed_dropoff = 0 as dropoff_location_ok, n_mixed_conversion + n_mixed_pickup + n_mixed_dropoff = 0 as all_ok from one""",
    ),
    "affected_quotes": (
        per_quote(q.affected_quotes),
        "with per as (select quote_id, greatest(count(distinct pickup_latitude), count(distinct pickup_longitude), count(distinct dropoff_latitude), count(distinct dropoff_longitude)) as m from quotes_raw group by 1) select count(*) filter (where m > 1) as n_affected, count(*) as n_quotes from per",
    ),
    "pricing_calls": (per_quote(q.call_table), "with " + CALLS + "select * from table_of_calls"),
    "call_gaps": (
        per_quote(lambda df: q.call_numbers(df).groupBy("call_num").count().withColumnRenamed("count", "n")),
        f"select call_num, count(*) as n from (select dense_rank() over (partition by quote_id order by {TS}) - 1 as call_num from quotes_raw) x group by 1",
    ),
    "price_gap_counts": (per_quote(lambda df: q.price_gap_counts(q.call_table(df))), "with " + CALLS + "select gap, count(*) as n from (select unnest(price_gaps) as gap from table_of_calls) x group by 1"),
    "rows_per_quote": (
        per_quote(q.rows_per_quote),
        f"with per as (select count(*) as c from quotes_raw group by quote_id), one as (select count(*) as n_quotes, count(*) filter (where c = 1) as n_single from per) select *, {r('100*n_single/n_quotes', 6)} as pct_single, {r('100-100*n_single/n_quotes', 6)} as pct_repeated from one",
    ),
    "ett_summary": (
        per_quote(lambda df: q.describe(df, "estimated_travel_time")),
        "select count(estimated_travel_time) as n, " + r("avg(estimated_travel_time)", 6) + " as mean, " + r("stddev_samp(estimated_travel_time)", 6) + " as std, min(estimated_travel_time) as min, "
        + ", ".join(f"{r(f'quantile_cont(estimated_travel_time, {p})', 6)} as {n}" for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.95, "p95"), (0.99, "p99"))) + ", max(estimated_travel_time) as max from quotes_raw",
    ),
    "spread_summary": (
        per_quote(q.spread_summary),
        BAD + f"""x as (select 1) select count(*) as n_quotes, count(*) filter (where m = 0) as n_static, {r('avg(m) filter (where m > 0 and m < 40000)', 4)} as mean_m, {r('quantile_cont(m, 0.5) filter (where m > 0 and m < 40000)', 4)} as median_m from spread""",
    ),
    "trip_dataset": (
        per_quote(q.trip_dataset),
        f"with conv as (select * from quotes_raw where quote_converted), lasts as (select * from conv qualify {TS} = max({TS}) over (partition by quote_id)), arms as (select *, {LAST_ARM} from lasts) select {TRIP} from arms where n = 1",
    ),
    "canonical_trips": (
        per_quote(lambda df: q.canonical_trips(q.canonical_quotes(df))),
        f"with lasts as (select * from quotes_raw qualify {TS} = max({TS}) over (partition by quote_id)), arms as (select *, {LAST_ARM} from lasts) select {TRIP} from arms where n = 1 and quote_converted",
    ),
    "rows_ecdf": (
        per_quote(lambda df: q.ecdf(df.groupBy("quote_id").count().withColumnRenamed("count", "n_rows"), "n_rows", "quote_id")),
        "with per as (select quote_id, count(*) as n_rows from quotes_raw group by 1) select quote_id, n_rows, row_number() over (order by n_rows, quote_id) / count(*) over () as cdf from per",
    ),
    "rows_histogram": (
        per_quote(lambda df: q.histogram(df.groupBy("quote_id").count().withColumnRenamed("count", "n_rows"), "n_rows", 0.0, 20.0, 20)),
        "with per as (select least(count(*)*1e0, 20e0) as v from quotes_raw group by quote_id) select cast(least(floor(v/1e0), 19) as integer) as bin, count(*) as n from per where v >= 0 group by 1",
    ),
    "hour_value_counts": (
        per_quote(lambda df: df.selectExpr("year(quote_creation_timestamp) as y").groupBy("y").count().withColumnRenamed("count", "n").orderBy("n")),
        "select cast(year(quote_creation_timestamp) as integer) as y, count(*) as n from quotes_raw group by 1",
    ),
}

LENS = {name: "quotes_raw" for name in QUERIES}


def queries() -> dict:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: duck(LENS[k], sql) for k, (_, sql) in QUERIES.items()}
