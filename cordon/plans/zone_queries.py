"""Queries over trips, blocks and zones, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordon import config
from cordon.functions import geo, rounded
from cordon.lens import duck, view
from cordon.operators import blocks as b
from cordon.operators import graph, rings
from cordon.operators import polygonize as pg
from cordon.operators import revenue as rv

ZONE, SPLIT_ZONE, NEXT_ZONE = (7, 8), (0, 1, 2, 7, 12, 24), (7, 12, 13)
SIDE = 5000.0
HULL = [(0.0, 0.0, SIDE, 0.0), (SIDE, 0.0, SIDE, SIDE), (SIDE, SIDE, 0.0, SIDE), (0.0, SIDE, 0.0, 0.0)]
MONEY = "cast(sum(cast({} as decimal(18,4))) as double)"


def ids(spark: SparkSession, zone) -> DataFrame:
    return spark.createDataFrame([(x,) for x in zone], "block_id int")


def hull(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HULL, "ax double, ay double, bx double, by_ double")


def lookup(s, d):
    return rv.revenue_lookup(view(s, d, "trips_assigned"))


def both(s, d):
    return rv.block_lookup(lookup(s, d))


def unilateral(s, d):
    return rv.unilateral_revenue(view(s, d, "blocks"), both(s, d))


def dated(s, d):
    return rv.local_time_columns(view(s, d, "trips_assigned"))


def roads(s, d):
    return view(s, d, "roads").withColumn("road_id", F.col("road_id").cast("long"))


LOOKUP = f"lookup as (select pickup_block, dropoff_block, {MONEY.format('sampled_revenue')} as revenue from trips_assigned group by 1, 2)"
BOTH = LOOKUP + f""", both_ways as (select block, other, {MONEY.format('revenue')} as revenue from (
 select pickup_block as block, dropoff_block as other, revenue from lookup union all select dropoff_block, pickup_block, revenue from lookup where pickup_block <> dropoff_block) x group by 1, 2)"""
UNI = BOTH + f", uni as (select block_id, coalesce(r, 0e0) as revenue from blocks left join (select block, {MONEY.format('revenue')} as r from both_ways group by 1) x on block_id = block)"
EXT = "ext as (select distinct dst as block_id from adjacency where src in (7, 8) and dst not in (7, 8))"
MARGINAL = BOTH + ", " + EXT + f", marginal as (select block_id, coalesce({MONEY.format('case when other in (7, 8) or other = block then revenue else 0e0 end')}, 0e0) as delta from ext left join both_ways on block_id = block group by 1)"
LOCAL = "timezone('Europe/London', timezone('UTC', quote_creation_timestamp))"
DATED = f"dated as (select *, cast({LOCAL} as date) as local_date, cast(hour({LOCAL}) as integer) as hour from trips_assigned)"
DAY = "1995-06-15"
HOURS = (8, 9, 10, 11, 12, 13)
SEGMENT = """met as (select point_id, road_id, x, y, ax + t*(bx-ax) as nx, ay + t*(by_-ay) as ny from (
 select *, coalesce(greatest(0e0, least(1e0, ((x-ax)*(bx-ax)+(y-ay)*(by_-ay))/nullif((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay), 0e0))), 0e0) as t from points cross join roads) z),
near as (select *, sqrt((x-nx)*(x-nx)+(y-ny)*(y-ny)) as dist from met where sqrt((x-nx)*(x-nx)+(y-ny)*(y-ny)) <= 100)"""
INSIDE = "inside as (select * from points where x >= 0 and x < 5000 and y >= 0 and y < 5000)"
TOUCH = "touch as (select road_id, block_id from roads join blocks on least(ax,bx) <= x1 and greatest(ax,bx) >= x0 and least(ay,by_) <= y1 and greatest(ay,by_) >= y0)"
CENTRES = "centres as (select block_id, (x0+x1)/2 as cx, (y0+y1)/2 as cy from blocks)"
DIST = "sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy))"
def cover(name: str, table: str) -> str:
    return f"""{name}_cover as (select b.block_id, sum(greatest(least(b.x1,p.x1)-greatest(b.x0,p.x0),0e0)*greatest(least(b.y1,p.y1)-greatest(b.y0,p.y0),0e0)) as c
 from blocks b join {table} p on p.x0 < b.x1 and p.x1 > b.x0 and p.y0 < b.y1 and p.y1 > b.y0 group by 1),
{name} as (select blocks.*, least(coalesce(c, 0e0), area_m2) as {name}_area_m2, least(coalesce(c, 0e0), area_m2)/area_m2 as {name}_fraction from blocks left join {name}_cover using (block_id))"""


COVER = cover("park", "parks")
KEPT = COVER + ", " + cover("water", "waters") + ", kept as (select park.*, water_area_m2, water_fraction from park join water using (block_id) where park_fraction < 1e-1 and water_fraction < 1e-1)"
MAXIMA = "maxima as (select * from uni u where not exists (select 1 from adjacency join uni v on dst = v.block_id where src = u.block_id and v.revenue > u.revenue))"
CENTRE_BOX, WHOLE_BOX = (1000.0, 1000.0, 4000.0, 4000.0), (0.0, 0.0, SIDE, SIDE)
PICKS = [f"s{k} as (select block_id, revenue from cand c where not exists (select 1 from ({' union all '.join(f'select block_id from s{j}' for j in range(1, k)) or 'select -1 as block_id'}) p where p.block_id = c.block_id or (p.block_id, c.block_id) in (select (src, dst) from two)) order by revenue desc, block_id limit 1)" for k in range(1, config.N_SEEDS + 1)]
SEEDS = UNI + ", " + MAXIMA + ", two as (select src, dst from adjacency union select a.src, b.dst from adjacency a join adjacency b on a.dst = b.src), cand as (select maxima.* from maxima join blocks using (block_id) where (x0+x1)/2 between 1e3 and 4e3 and (y0+y1)/2 between 1e3 and 4e3), " + ", ".join(PICKS)
AREAS = "areas as (select block_id, sum((x1-x0)*(y1-y0)) as area_m2, round(avg((x0+x1)/2), 6) as cx, round(avg((y0+y1)/2), 6) as cy from shapes group by 1)"
SHAPE_TOUCH = "touch as (select distinct road_id, block_id from roads join shapes on least(ax,bx) <= x1 and greatest(ax,bx) >= x0 and least(ay,by_) <= y1 and greatest(ay,by_) >= y0)"
SHAPE_COVER = """over as (select s.block_id, sum(greatest(least(s.x1,p.x1)-greatest(s.x0,p.x0),0e0)*greatest(least(s.y1,p.y1)-greatest(s.y0,p.y0),0e0)) as c
 from shapes s join parks p on p.x0 < s.x1 and p.x1 > s.x0 and p.y0 < s.y1 and p.y1 > s.y0 group by 1)"""


def greedy(s, d):
    return rv.greedy_step(ids(s, ZONE), view(s, d, "adjacency"), both(s, d), view(s, d, "blocks"), 15e6)


def maxima(s, d):
    return rv.local_maxima(unilateral(s, d), view(s, d, "adjacency"))


def assigned(s, d):
    blocks = view(s, d, "blocks")
    return b.assign_to_blocks(view(s, d, "points"), roads(s, d), b.road_blocks(roads(s, d), blocks), b.box_centers(blocks), hull(s))


def seeds(s, d, box):
    return rv.seeds(maxima(s, d), view(s, d, "adjacency"), config.N_SEEDS, b.box_centers(view(s, d, "blocks")), box)


def usable(s, d):
    """Blocks with their shares of parks and water, those under both limits."""
    parks = b.coverage_fraction(view(s, d, "blocks"), view(s, d, "parks"), "park")
    return b.filter_blocks(b.coverage_fraction(parks, view(s, d, "waters"), "water"))


def component(s, d):
    """The largest connected part of the blocks that are left."""
    kept, adjacent = usable(s, d), view(s, d, "adjacency")
    for end in ("src", "dst"):
        adjacent = adjacent.join(kept.select(F.col("block_id").alias(end)), end, "left_semi")
    return b.main_component(kept, adjacent).select("block_id", "area_m2", "new_id")


def faces(s, d):
    """Polygons that a network of streets encloses; many are not convex."""
    return pg.road_blocks(view(s, d, "streets").withColumn("road_id", F.col("road_id").cast("long")))


def box_rings(s, d, name, key):
    corners = [(0, "x0", "y0"), (1, "x1", "y0"), (2, "x1", "y1"), (3, "x0", "y1")]
    return view(s, d, name).select(F.col(key).alias("area_id"), F.explode(F.array(*[F.struct(F.lit(k).alias("seq"), F.col(x).alias("x"), F.col(y).alias("y")) for k, x, y in corners])).alias("p")).select("area_id", "p.*")


def ring_centers(s, d):
    return rings.measures(faces(s, d)).select("block_id", F.col("x").alias("cx"), F.col("y").alias("cy"))


def ring_assigned(s, d):
    return b.assign_to_blocks(view(s, d, "points"), roads(s, d), rings.touching(roads(s, d), faces(s, d)), ring_centers(s, d), hull(s))


def block_rings(s, d):
    v = view(s, d, "blocks")
    corners = [(0, "x0", "y0"), (1, "x1", "y0"), (2, "x1", "y1"), (3, "x0", "y1")]
    return geo.ring_measures(v.select("block_id", F.explode(F.array(*[F.struct(F.lit(k).alias("seq"), F.col(x).alias("x"), F.col(y).alias("y")) for k, x, y in corners])).alias("p")).select("block_id", "p.*"), ["block_id"])


def breathing(s, d):
    zones = s.createDataFrame([(h, z) for h in HOURS for z in (ZONE if h % 2 else NEXT_ZONE)], "hour int, block_id int")
    return rv.breathing_compare(ids(s, ZONE), zones, rv.hourly_lookups(dated(s, d), hours=list(HOURS)))


def grid_round_trip(s, d):
    """Pickups to the grid and back, to five decimals."""
    there = geo.with_grid(view(s, d, "quotes_raw"), "pickup_latitude", "pickup_longitude")
    back = geo.with_degrees(there, "east", "north")
    return back.select("quote_id", "l_linenumber", *[rounded(F.col(c), 5).alias(c) for c in ("lat", "lon")])


QUERIES = {
    "revenue_lookup": (lookup, "trips_assigned", "with " + LOOKUP + " select * from lookup"),
    "block_lookup": (both, "trips_assigned", "with " + BOTH + " select * from both_ways"),
    "unilateral_revenue": (unilateral, "trips_assigned blocks", "with " + UNI + " select * from uni"),
    "zone_revenue_both": (lambda s, d: rv.zone_revenue(ids(s, SPLIT_ZONE), lookup(s, d)), "trips_assigned", "with " + LOOKUP + f" select coalesce({MONEY.format('revenue')}, 0e0) as revenue from lookup where pickup_block in {SPLIT_ZONE} and dropoff_block in {SPLIT_ZONE}"),
    "zone_revenue_pickup": (lambda s, d: rv.zone_revenue(ids(s, SPLIT_ZONE), lookup(s, d), "pickup"), "trips_assigned", "with " + LOOKUP + f" select coalesce({MONEY.format('revenue')}, 0e0) as revenue from lookup where pickup_block in {SPLIT_ZONE}"),
    "capture_share": (lambda s, d: rv.capture_share(ids(s, SPLIT_ZONE), lookup(s, d)), "trips_assigned", "with " + LOOKUP + f", z as (select coalesce({MONEY.format('revenue')}, 0e0) as revenue from lookup where pickup_block in {SPLIT_ZONE} and dropoff_block in {SPLIT_ZONE}), t as (select {MONEY.format('revenue')} as total from lookup) select revenue, total, 100*revenue/total as capture_pct from z, t"),
    "external_blocks": (lambda s, d: rv.external_blocks(ids(s, ZONE), view(s, d, "adjacency")), "adjacency", "with " + EXT + " select * from ext"),
    "marginal_revenue": (lambda s, d: rv.marginal_revenue(rv.external_blocks(ids(s, ZONE), view(s, d, "adjacency")), ids(s, ZONE), both(s, d)), "trips_assigned adjacency", "with " + MARGINAL + " select * from marginal"),
    "greedy_step": (greedy, "trips_assigned adjacency", "with " + MARGINAL + " select * from marginal where delta > 0 order by delta desc, block_id limit 1"),
    "hourly_lookups": (lambda s, d: rv.hourly_lookups(dated(s, d)), "trips_assigned", "with " + DATED + f" select hour, pickup_block, dropoff_block, {MONEY.format('sampled_revenue')} as revenue from dated group by 1, 2, 3"),
    "cumulative_lookup": (lambda s, d: rv.cumulative_lookup(dated(s, d), DAY, list(HOURS)), "trips_assigned", "with " + DATED + f" select pickup_block, dropoff_block, {MONEY.format('sampled_revenue')} as revenue from dated where local_date = date '{DAY}' and hour in {HOURS} group by 1, 2"),
    "trips_per_hour": (lambda s, d: rv.trips_per_hour(dated(s, d)), "trips_assigned", "with " + DATED + " select hour, count(*) as trips, printf('%02d:00–%02d:00', hour, hour + 1) as label from dated group by 1"),
    "dated_trips": (
        lambda s, d: rv.dated_trips(view(s, d, "trips_assigned").drop("quote_creation_timestamp"), view(s, d, "quotes_raw").groupBy("quote_id").agg(F.max("quote_creation_timestamp").alias("quote_creation_timestamp"))),
        "trips_assigned quotes_raw",
        f"with stamps as (select quote_id, max(quote_creation_timestamp) as quote_creation_timestamp from quotes_raw group by 1) select t.quote_id, sampled_revenue, pickup_block, dropoff_block, cast({LOCAL.replace('quote_creation_timestamp', 's.quote_creation_timestamp')} as date) as local_date, cast(hour({LOCAL.replace('quote_creation_timestamp', 's.quote_creation_timestamp')}) as integer) as hour from trips_assigned t left join stamps s on t.quote_id = s.quote_id",
    ),
    "breathing_compare": (
        breathing, "trips_assigned",
        "with " + DATED + f""", hourly as (select hour, pickup_block, {MONEY.format('sampled_revenue')} as revenue from dated where hour in {HOURS} group by 1, 2),
x as (select hour, coalesce({MONEY.format('case when pickup_block in (7, 8) then revenue end')}, 0e0) as static_revenue,
 coalesce({MONEY.format('case when (hour % 2 = 1 and pickup_block in (7, 8)) or (hour % 2 = 0 and pickup_block in (7, 12, 13)) then revenue end')}, 0e0) as dynamic_revenue from hourly group by 1)
select *, dynamic_revenue - static_revenue as delta, 100*(dynamic_revenue - static_revenue)/nullif(static_revenue, 0e0) as delta_pct,
 cast(sum(cast(static_revenue as decimal(18,4))) over w as double) as static_total, cast(sum(cast(dynamic_revenue as decimal(18,4))) over w as double) as dynamic_total from x window w as (order by hour)""",
    ),
    "local_maxima": (maxima, "trips_assigned blocks adjacency", "with " + UNI + ", " + MAXIMA + " select * from maxima"),
    "seed_blocks": (lambda s, d: seeds(s, d, CENTRE_BOX), "trips_assigned blocks adjacency", "with " + SEEDS + " " + " union all ".join(f"select cast({k} as integer) as seed_rank, * from s{k}" for k in range(1, config.N_SEEDS + 1))),
    "top_blocks": (lambda s, d: rv.top_blocks(unilateral(s, d)), "trips_assigned blocks", "with " + UNI + " select * from uni order by revenue desc, block_id limit 5"),
    "zone_diff": (lambda s, d: rv.zone_diff(ids(s, ZONE), ids(s, NEXT_ZONE), view(s, d, "blocks")), "blocks", f"select block_id, case when block_id in {ZONE} and block_id in {NEXT_ZONE} then 'unchanged' when block_id in {NEXT_ZONE} then 'added' when block_id in {ZONE} then 'removed' else 'outside' end as status from blocks"),
    "zone_intersection": (lambda s, d: ids(s, ZONE).intersect(ids(s, NEXT_ZONE)), "blocks", f"select block_id from blocks where block_id in {ZONE} and block_id in {NEXT_ZONE}"),
    "adjacency": (lambda s, d: b.adjacency(b.box_edges(view(s, d, "blocks"))), "adjacency", "select src, dst from adjacency"),
    "zone_boundary": (lambda s, d: b.boundary_edges(b.box_edges(view(s, d, "blocks").where(F.col("block_id").isin(*SPLIT_ZONE)))).groupBy("block_id").agg(F.count("*").alias("n_edges")), "adjacency",
        f"with z as (select unnest({list(SPLIT_ZONE)}) as block_id), inner_edges as (select src, count(*) as n from adjacency where src in {SPLIT_ZONE} and dst in {SPLIT_ZONE} group by 1) select cast(block_id as integer) as block_id, 4 - coalesce(n, 0) as n_edges from z left join inner_edges on src = block_id where 4 - coalesce(n, 0) > 0"),
    "zone_connected": (
        lambda s, d: graph.reachable(ids(s, SPLIT_ZONE), view(s, d, "adjacency")), "adjacency",
        f"""with recursive reach(block_id) as (select {min(SPLIT_ZONE)} union select dst from reach join adjacency on src = block_id where dst in {SPLIT_ZONE})
select count(*) as reached, {len(SPLIT_ZONE)} as size, count(*) = {len(SPLIT_ZONE)} as connected from reach""",
    ),
    "main_component": (component, "blocks parks waters adjacency", "with recursive " + KEPT + """, reach(a, b) as (select block_id, block_id from kept union select r.a, k.block_id from reach r join adjacency on src = r.b join kept k on k.block_id = dst),
label as (select a as block_id, min(b) as comp from reach group by 1), best as (select comp from label join kept using (block_id) group by comp order by sum(area_m2) desc, comp limit 1)
select block_id, area_m2, cast(row_number() over (order by block_id) - 1 as integer) as new_id from label join kept using (block_id) where comp in (select comp from best)"""),
    "polygon_blocks": (lambda s, d: rings.measures(faces(s, d)), "shapes", "with " + AREAS + " select block_id, area_m2, cx as x, cy as y from areas"),
    "ring_adjacency": (lambda s, d: rings.ring_adjacency(faces(s, d)), "shapes", "select distinct a.block_id as src, b.block_id as dst from shapes a join shapes b on a.block_id <> b.block_id and ((a.x1 = b.x0 or b.x1 = a.x0) and a.y0 = b.y0 or (a.y1 = b.y0 or b.y1 = a.y0) and a.x0 = b.x0)"),
    "ring_road_touch": (lambda s, d: rings.touching(roads(s, d), faces(s, d)), "roads shapes", "with " + SHAPE_TOUCH + " select * from touch"),
    "ring_coverage": (lambda s, d: rings.coverage(faces(s, d), box_rings(s, d, "parks", "park_id"), "park"), "shapes parks", "with " + AREAS + ", " + SHAPE_COVER + " select block_id, area_m2, least(coalesce(c, 0e0), area_m2) as park_area_m2, least(coalesce(c, 0e0), area_m2)/area_m2 as park_fraction from areas left join over using (block_id)"),
    "water_coverage": (lambda s, d: rings.coverage(faces(s, d), box_rings(s, d, "waters", "water_id"), "water", roads=roads(s, d)), None, None),
    "ring_assign": (
        ring_assigned, "points roads shapes",
        "with " + INSIDE + ", " + SEGMENT + ", " + SHAPE_TOUCH + ", " + AREAS + f""", best as (select point_id, road_id from near where point_id in (select point_id from inside) qualify rank() over (partition by point_id order by dist) = 1),
cand as (select distinct best.point_id, block_id from best join touch using (road_id)),
first as (select c.point_id, c.block_id from cand c join areas using (block_id) join inside i on i.point_id = c.point_id qualify row_number() over (partition by c.point_id order by {DIST}, c.block_id) = 1),
rest as (select point_id, block_id from inside cross join areas where point_id not in (select point_id from first) qualify row_number() over (partition by point_id order by {DIST}, block_id desc) = 1)
select point_id, block_id, 'road' as way from first union all select point_id, block_id, 'centre' from rest""",
    ),
    "block_measures": (block_rings, "blocks", "select block_id, area_m2, (x0+x1)/2 as x, (y0+y1)/2 as y from blocks"),
    "nearest_segment": (lambda s, d: b.nearest_segment(view(s, d, "points"), roads(s, d)), "points roads", "with " + SEGMENT + " select point_id, road_id, dist, nx, ny from near qualify row_number() over (partition by point_id order by dist, road_id) = 1"),
    "nearest_segment_ties": (lambda s, d: b.nearest_segment(view(s, d, "points"), roads(s, d), ties=True), "points roads", "with " + SEGMENT + " select point_id, road_id, dist, nx, ny from near qualify rank() over (partition by point_id order by dist) = 1"),
    "snap_points": (lambda s, d: b.snap(view(s, d, "points"), roads(s, d)), "points roads", "with " + SEGMENT + ", first as (select * from near qualify row_number() over (partition by point_id order by dist, road_id) = 1) select p.point_id, coalesce(nx, p.x) as x, coalesce(ny, p.y) as y, nx is not null as moved from points p left join first f on p.point_id = f.point_id"),
    "nearest_centre": (lambda s, d: b.nearest_center(view(s, d, "points"), b.box_centers(view(s, d, "blocks"))), "points blocks", "with " + CENTRES + f" select point_id, block_id, {DIST} as dist from points cross join centres qualify row_number() over (partition by point_id order by {DIST}, block_id desc) = 1"),
    "road_blocks": (lambda s, d: b.road_blocks(roads(s, d), view(s, d, "blocks")), "roads blocks", "with " + TOUCH + " select * from touch"),
    "point_in_hull": (lambda s, d: b.in_ring(view(s, d, "points"), hull(s)), "points", "with " + INSIDE + " select point_id from inside"),
    "assign_blocks": (
        assigned, "points roads blocks",
        "with " + INSIDE + ", " + SEGMENT + ", " + TOUCH + ", " + CENTRES + f""", best as (select point_id, road_id from near where point_id in (select point_id from inside) qualify rank() over (partition by point_id order by dist) = 1),
cand as (select distinct best.point_id, block_id from best join touch using (road_id)),
first as (select c.point_id, c.block_id from cand c join centres using (block_id) join inside i on i.point_id = c.point_id qualify row_number() over (partition by c.point_id order by {DIST}, c.block_id) = 1),
rest as (select point_id, block_id from inside cross join centres where point_id not in (select point_id from first) qualify row_number() over (partition by point_id order by {DIST}, block_id desc) = 1)
select point_id, block_id, 'road' as way from first union all select point_id, block_id, 'centre' from rest""",
    ),
    "coverage_fraction": (lambda s, d: b.coverage_fraction(view(s, d, "blocks"), view(s, d, "parks"), "park"), "blocks parks", "with " + COVER + " select * from park"),
    "filter_blocks": (usable, "blocks parks waters", "with " + KEPT + " select * from kept"),
    "hex_cells": (
        lambda s, d: view(s, d, "points").select(geo.hex_cell(F.col("x"), F.col("y"), 500.0).alias("cell")).groupBy("cell").count().withColumnRenamed("count", "n"), "points",
        """with ax as (select (x*0.5773502691896257e0 - y/3e0)/500e0 as q, (y*0.6666666666666666e0)/500e0 as r from points), cube as (select q, r, -q-r as s from ax),
near as (select *, floor(q+5e-1) as rq, floor(r+5e-1) as rr, floor(s+5e-1) as rs from cube), off as (select *, abs(rq-q) as dq, abs(rr-r) as dr, abs(rs-s) as ds from near)
select cast(cast(case when dq > dr and dq > ds then -rr-rs else rq end as bigint) as varchar) || ':' || cast(cast(case when not (dq > dr and dq > ds) and dr > ds then -rq-rs else rr end as bigint) as varchar) as cell, count(*) as n from off group by 1""",
    ),
    "grid_round_trip": (grid_round_trip, "quotes_raw", "select quote_id, l_linenumber, floor(pickup_latitude*1e5+5e-1)/1e5 as lat, floor(pickup_longitude*1e5+5e-1)/1e5 as lon from quotes_raw"),
    "grid_bbox": (lambda s, d: geo.project_bbox(s.createDataFrame([("all", *config.BBOX), ("centre", *config.CENTER_BBOX)], "box string, min_lon double, min_lat double, max_lon double, max_lat double")), None, None),
}


def queries() -> dict:
    return {k: f for k, (f, _, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: duck(names, sql) for k, (_, names, sql) in QUERIES.items() if sql}
