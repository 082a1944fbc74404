"""Domain tables seen through the star-schema test tables.

Each view is one SELECT that Spark and DuckDB both run; base tables stand in braces. The
only text that differs is the hourly spine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SPINE_SPARK = "select explode(sequence(timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-02-07 23:00:00', interval 1 hour)) as hour_bucket"
SPINE_DUCK = "select unnest(generate_series(timestamp '2024-01-01 00:00:00', timestamp '2024-02-07 23:00:00', interval 1 hour)) as hour_bucket"

VIEWS = {
    "quotes_raw": """select l_orderkey as quote_id, date_trunc('year', l_shipdate) as quote_creation_timestamp,
 51.3e0+(o_custkey%97)*4e-3+(l_linenumber%3)*3e-3 as pickup_latitude,
 -6e-1+(o_custkey%89)*1e-2+(l_partkey%7)*2e-3 as pickup_longitude,
 51.28e0+(l_suppkey%100)*4.5e-3 as dropoff_latitude, -6.5e-1+(l_partkey%110)*9.85e-3 as dropoff_longitude,
 l_extendedprice as quoted_price, (o_custkey%1200)*1e0+l_quantity*25e0 as estimated_travel_time,
 (o_orderstatus='F' or (l_quantity=50 and l_linenumber=1)) as quote_converted,
 l_linenumber, l_partkey, l_suppkey
from {lineitem} join {orders} on l_orderkey=o_orderkey""",
    "trips_assigned": """select l_orderkey as quote_id, l_extendedprice*(1e0-l_discount) as sampled_revenue,
 s_nationkey as pickup_block, c_nationkey as dropoff_block,
 l_shipdate + (l_partkey%24)*interval '1' hour as quote_creation_timestamp
from {lineitem} join {supplier} on l_suppkey=s_suppkey join {orders} on l_orderkey=o_orderkey
 join {customer} on o_custkey=c_custkey""",
    "blocks": """select n_nationkey as block_id, (n_nationkey%5)*1000e0 as x0, floor(n_nationkey/5e0)*1000e0 as y0,
 (n_nationkey%5)*1000e0+1000e0 as x1, floor(n_nationkey/5e0)*1000e0+1000e0 as y1, 1e6 as area_m2
from {nation}""",
    "adjacency": """select a.block_id as src, b.block_id as dst from blocks a join blocks b on a.block_id<>b.block_id
where greatest(least(a.x1,b.x1)-greatest(a.x0,b.x0),0e0)+greatest(least(a.y1,b.y1)-greatest(a.y0,b.y0),0e0)>0
 and least(a.x1,b.x1)>=greatest(a.x0,b.x0) and least(a.y1,b.y1)>=greatest(a.y0,b.y0)""",
    "roads": """select row_number() over (order by vertical, k, i) as road_id,
 case when vertical=1 then k*1000e0 else i*1000e0 end as ax, case when vertical=1 then i*1000e0 else k*1000e0 end as ay,
 case when vertical=1 then k*1000e0 else i*1000e0+1000e0 end as bx, case when vertical=1 then i*1000e0+1000e0 else k*1000e0 end as by_
from (select v.n_nationkey as vertical, a.n_nationkey as k, b.n_nationkey as i from {nation} v cross join {nation} a cross join {nation} b
 where v.n_nationkey<2 and a.n_nationkey<6 and b.n_nationkey<5) z""",
    "points": """select o_orderkey as point_id, ((o_orderkey*7919)%5603)*1e0-300e0 as x,
 ((o_custkey*104729+o_orderkey)%5607)*1e0-300e0 as y from {orders}""",
    "parks": """select park_id, x0, y0, x0+side*boost+(park_id%3) as x1, y0+side*boost+(park_id%4) as y1 from (
 select p_partkey as park_id, ((p_partkey*977)%4800)*1e0 as x0, ((p_partkey*1409)%4800)*1e0 as y0,
  case when cast(floor(((p_partkey*977)%4800)/1e3)+floor(((p_partkey*1409)%4800)/1e3) as bigint)%3=0 then 3e0 else 1e0 end as boost,
  floor(sqrt(1e6/(select count(*) from {part}))) as side from {part}) z""",
    "waters": """select water_id, x0, y0, x0+side*boost+(water_id%3) as x1, y0+side*boost+(water_id%4) as y1 from (
 select s_suppkey as water_id, ((s_suppkey*1013)%4700)*1e0 as x0, ((s_suppkey*1423)%4700)*1e0 as y0,
  case when cast(floor(((s_suppkey*1013)%4700)/1e3)+floor(((s_suppkey*1423)%4700)/1e3) as bigint)%4=1 then 4e0 else 1e0 end as boost,
  floor(sqrt(4e5/(select count(*) from {supplier}))) as side from {supplier}) z""",
    "quarters": """select case when right_top and n_nationkey%2=0 and n_nationkey%5<4 then n_nationkey+1 else n_nationkey end as old_id, x0, y0, x0+500e0 as x1, y0+500e0 as y1
from (select n_nationkey, i=1 and j=1 as right_top, (n_nationkey%5)*1000e0+i*500e0 as x0, floor(n_nationkey/5e0)*1000e0+j*500e0 as y0
 from {nation} cross join (select 0 as i union all select 1) a cross join (select 0 as j union all select 1) b) z""",
    "streets": """select row_number() over (order by ax, ay, bx, by_) as road_id, ax, ay, bx, by_ from (
 select ax, ay, bx, by_ from (
  select old_id, x0 as ax, y0 as ay, x1 as bx, y0 as by_ from quarters union all select old_id, x1, y0, x1, y1 from quarters
  union all select old_id, x0, y1, x1, y1 from quarters union all select old_id, x0, y0, x0, y1 from quarters) s
 group by ax, ay, bx, by_ having count(*)=1 or count(distinct old_id)=2) t""",
    "shapes": """select cast(dense_rank() over (order by corner)-1 as integer) as block_id, x0, y0, x1, y1
from (select *, min(x0*1e6+y0) over (partition by old_id) as corner from quarters) z""",
    "quotes_hourly_h3": """select user_id%14 as h3_zone, cast(date_trunc('hour',ts) as :NTZ:) as hour_bucket, count(*) as quote_count,
 sum(case when event_type='purchase' then 1 else 0 end) as trip_count,
 sum(case when event_type='purchase' then 1 else 0 end)*1e0/count(*) as conversion_rate
from {events} group by user_id%14, date_trunc('hour',ts)""",
    "weather_hourly": """select hour_bucket, case when h%97=0 then null else ((h*37)%150)/1e1-2e0 end as temperature_2m,
 ((h*37)%150)/1e1-4e0+(h%5)*3e-1 as apparent_temperature,
 case when (h*29)%11<3 then ((h*29)%11)/1e1 else 0e0 end as rain,
 case when (h*29)%11<4 then ((h*29)%11)/1e1 else 0e0 end as precipitation,
 ((h*41)%101)*1e0 as precipitation_probability, ((h*31)%43)*1e0 as wind_speed_10m,
 ((h*17)%101)*1e0 as cloud_cover, 1000e0+((h*53)%20000) as visibility
from (select hour_bucket, cast(row_number() over (order by hour_bucket)-1 as bigint) as h from (:SPINE:) s) t""",
}
NEEDS = {"adjacency": ("blocks",), "streets": ("quarters",), "shapes": ("quarters",)}

def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = _with([name], f"select * from {name}", SPINE_SPARK, "timestamp_ntz")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **tables)


def duck(names: str, sql: str) -> str:
    """`sql` with the named views before it. A `with` of its own goes on behind them."""
    return re.sub(r"\{(\w+)\}", r"\1", _with(names.split(), sql, SPINE_DUCK, "timestamp"))


def _with(names: list[str], sql: str, spine: str, ntz: str) -> str:
    wanted = [n for n in VIEWS if n in {*names, *(m for n in names for m in NEEDS.get(n, ()))}]
    views = ",\n".join(f"{n} as ({VIEWS[n].replace(':SPINE:', spine).replace(':NTZ:', ntz)})" for n in wanted)
    sql = sql.strip()
    if sql.lower().startswith("with recursive "):
        return f"with recursive {views},\n{sql[15:]}"
    return f"with {views},\n{sql[5:]}" if sql.lower().startswith("with ") else f"with {views}\n{sql}"
