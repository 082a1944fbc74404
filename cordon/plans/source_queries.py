"""Queries that write a table in a format and read it again, each with DuckDB SQL for what must come back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cordon import flows
from cordon.lens import duck, view
from cordon.operators import quotes as q
from cordon.operators import series as sr
from cordon.operators import weather as wt
from cordon.plans import series_queries as sq
from cordon.plans.quote_queries import ARM
from cordon.shared import shared_dir
from cordon.sources import files

RAW = [c.split()[0] for c in files.QUOTES_RAW.split(", ")]
#: What orders rows of a call that a CSV file holds, after the draw and the price.
REST = [*q.PLACES, "estimated_travel_time", "quote_converted"]


def fresh(s, name):
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def raw_csv(s, d):
    """Raw quotes as a CSV file."""
    path = fresh(s, "quotes-csv")
    files.write_csv(view(s, d, "quotes_raw").select(*RAW), path)
    return path


def csv_scan(s, d):
    df = files.read_quotes_csv(s, raw_csv(s, d))
    return df.withColumn("quote_creation_timestamp", F.col("quote_creation_timestamp").cast("timestamp_ntz"))


def parquet_scan(s, d):
    path = fresh(s, "quotes-parquet")
    files.write_parquet(view(s, d, "quotes_raw"), path)
    return files.read_parquet(s, path, ["quote_id", "quoted_price", "quote_converted"])


def checkpoint_scan(s, d):
    """The second call reads what the first has written."""
    path = fresh(s, "hourly")
    make = lambda: view(s, d, "quotes_hourly_h3")
    files.checkpointed(make, s, path)
    return files.checkpointed(lambda: make().where("false"), s, path)


def canonical_from_csv(s, d):
    df = flows.build_and_save_canonical(s, raw_csv(s, d), fresh(s, "canonical"))
    return df.withColumn("quote_creation_timestamp", F.col("quote_creation_timestamp").cast("timestamp_ntz"))


def geojson_scan(s, d):
    """Parks as polygons of one feature collection, read as vertices."""
    path = fresh(s, "parks-geojson")
    corners = F.array(*[F.array(F.col(x), F.col(y)) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))])
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("park_id").cast("string").alias("name")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(corners).alias("coordinates")).alias("geometry"))
    one = view(s, d, "parks").select(feature.alias("f")).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list("f").alias("features"))).alias("value"))  # one file, as the format is
    one.coalesce(1).write.text(path)
    return files.read_geojson(s, path).select(F.col("properties")["name"].cast("long").alias("park_id"), F.col("part").cast("int").alias("part"), F.col("ring").cast("int").alias("ring"), F.col("seq").cast("int").alias("seq"), "x", "y")


def weather_scan(s, d):
    path = fresh(s, "weather-json")
    view(s, d, "weather_hourly").write.json(path)
    return files.read_weather(s, path, sq.START, sq.EVAL_START).select("hour_bucket", "temperature_2m", "rain", "visibility")


def zones_at_risk(s, d):
    """Labels at a limit that parts the zones of the test tables; the limit of real data is 0.30."""
    return sr.zones_labelled(sr.zone_stability(sq.counts(s, d), 38 * 24, 0.0, 1.8), "cv_180")


def before_after(s, d):
    return q.filter_counts(view(s, d, "quotes_raw"))


def with_actuals(s, d):
    return sr.with_actuals(sq.naive(s, d).drop("y"), sq.series(s, d))


HOLIDAY_ROWS = ", ".join("('{}', date '{}')".format(name.replace("'", "''"), day) for day, name in files.bank_holidays(range(2025, 2028)))

QUERIES = {
    "csv_scan": (csv_scan, "quotes_raw", "select " + ", ".join("cast(quote_id as varchar) as quote_id" if c == "quote_id" else f"cast({c} as {'timestamp' if c == 'quote_creation_timestamp' else 'boolean' if c == 'quote_converted' else 'double'}) as {c}" for c in RAW) + " from quotes_raw"),
    "parquet_scan": (parquet_scan, "quotes_raw", "select quote_id, quoted_price, quote_converted from quotes_raw"),
    "checkpoint_scan": (checkpoint_scan, "quotes_hourly_h3", "select * from quotes_hourly_h3"),
    "canonical_from_csv": (
        canonical_from_csv, "quotes_raw",
        f"""with lasts as (select * from quotes_raw qualify quote_creation_timestamp = max(quote_creation_timestamp) over (partition by quote_id)),
arms as (select *, row_number() over (partition by quote_id order by {ARM}, quoted_price, {", ".join(REST)}) as n from lasts)
select * replace (cast(quote_id as varchar) as quote_id, cast(quote_creation_timestamp as timestamp) as quote_creation_timestamp, cast(quoted_price as double) as quoted_price, cast(estimated_travel_time as double) as estimated_travel_time) from (select {", ".join(RAW)} from arms where n = 1) x""",
    ),
    "geojson_scan": (geojson_scan, "parks", "select park_id, cast(0 as integer) as part, cast(0 as integer) as ring, cast(k as integer) as seq, case when k in (1, 2) then x1 else x0 end as x, case when k in (2, 3) then y1 else y0 end as y from parks cross join (select unnest(range(5)) as k) c"),
    "weather_scan": (weather_scan, "weather_hourly", f"select hour_bucket, temperature_2m, rain, visibility from weather_hourly where hour_bucket >= timestamp '{sq.START}' and hour_bucket < timestamp '{sq.EVAL_START}'"),
    "holidays": (lambda s, d: files.holidays(s), "blocks", f"select * from (values {HOLIDAY_ROWS}) as t(holiday, ds)"),
    "zones_at_risk": (zones_at_risk, "quotes_hourly_h3", "select h3_zone from quotes_hourly_h3 group by 1 having stddev_samp(conversion_rate)/avg(conversion_rate) <= 18e-1"),
    "filter_counts": (
        before_after, "quotes_raw",
        """with per as (select quote_id, count(*) as n, coalesce(min(cast(quote_converted as integer)) <> max(cast(quote_converted as integer)), false) as f1,
 not bool_and(coalesce(pickup_latitude between 51.260 and 51.764 and pickup_longitude between -0.681 and 0.423 and dropoff_latitude between 51.260 and 51.764 and dropoff_longitude between -0.681 and 0.423, false)) as f2 from quotes_raw group by 1)
select 'conversion' as step, cast(sum(n) as bigint) as rows_before, cast(sum(case when not f1 then n else 0 end) as bigint) as rows_after, cast(count(*) as bigint) as quotes_before, cast(count(*) filter (where not f1) as bigint) as quotes_after from per
union all select 'place', cast(sum(case when not f1 then n else 0 end) as bigint), cast(sum(case when not f1 and not f2 then n else 0 end) as bigint), count(*) filter (where not f1), count(*) filter (where not f1 and not f2) from per""",
    ),
    "with_actuals": (with_actuals, sq.NAMES, "with " + sq.NAIVE + " select h3_zone, ds, yhat, yhat_lower, yhat_upper, y from naive"),
    "head_rows": (lambda s, d: view(s, d, "quotes_raw").orderBy("quoted_price", "quote_id", "l_linenumber").select("quote_id", "l_linenumber", "quoted_price").limit(5), "quotes_raw", "select quote_id, l_linenumber, quoted_price from quotes_raw order by quoted_price, quote_id, l_linenumber limit 5"),
    "hour_of_day_counts": (lambda s, d: wt.hour_counts(sq.counts(s, d)), "quotes_hourly_h3", "select cast(hour(hour_bucket) as integer) as hour, cast(sum(quote_count) as bigint) as n from quotes_hourly_h3 group by 1"),
}


def queries() -> dict:
    return {k: f for k, (f, _, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: duck(names, sql) for k, (_, names, sql) in QUERIES.items() if sql}
