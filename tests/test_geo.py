import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cordon.config import BBOX
from cordon.functions import geo
from cordon.operators import blocks as b
from cordon.operators import polygonize as pg
from cordon.operators import rings


def value(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_grid_of_the_published_worked_example(spark):
    lat, lon = 52 + 39 / 60 + 27.2531 / 3600, 1 + 43 / 60 + 4.5177 / 3600
    e, n = value(spark, *geo.airy_to_grid(F.radians(F.lit(lat)), F.radians(F.lit(lon))))
    assert (e, n) == pytest.approx((651409.903, 313177.270), abs=0.002)


def test_grid_of_a_known_place_and_back(spark):
    df = spark.createDataFrame([(51.4778, -0.0014)], "lat0 double, lon0 double")
    r = geo.with_degrees(geo.with_grid(df, "lat0", "lon0"), "east", "north").first()
    assert (r.east, r.north) == pytest.approx((538_890, 177_320), abs=60)
    assert (r.lat, r.lon) == pytest.approx((51.4778, -0.0014), abs=1e-6)


def test_box_bounds(spark):
    r = geo.project_bbox(spark.createDataFrame([("b", *BBOX)], "box string, min_lon double, min_lat double, max_lon double, max_lat double")).first()
    assert r.x0 < r.x1 and r.y0 < r.y1 and r.x1 - r.x0 == pytest.approx(77_000, rel=0.03)


def test_haversine(spark):
    assert value(spark, geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)))[0] == pytest.approx(math.pi * geo.EARTH_RADIUS_M)
    assert value(spark, geo.haversine_m(*map(F.lit, (51.5, -0.1, 51.5, -0.1))))[0] == 0


def test_segments_without_length(spark):
    assert value(spark, geo.along_segment(*map(F.lit, (3.0, 4.0, 1.0, 1.0, 1.0, 1.0))))[0] == 0


def test_hexagons_hold_their_points(spark):
    df = spark.range(500).select((F.rand(1) * 5000).alias("x"), (F.rand(2) * 5000).alias("y")).withColumn("cell", geo.hex_cell(F.col("x"), F.col("y"), 300.0)).withColumn("p", geo.hex_polygon(F.col("cell"), 300.0))
    for r in df.collect():
        ring = [(c["x"], c["y"]) for c in r.p]
        side = [(bx - ax) * (r.y - ay) - (by - ay) * (r.x - ax) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1])]
        assert min(side) >= -1e-6


def roads(spark, *rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "road_id long, ax double, ay double, bx double, by_ double")


def test_nearest_road_at_the_limit_and_ties(spark):
    r = roads(spark, (0, 0, 2000, 0), (0, 200, 2000, 200))
    p = spark.createDataFrame([(1, 1500.0, 100.0), (2, 700.0, -100.0), (3, 700.0, -100.01), (4, -50.0, 0.0)], "point_id long, x double, y double")
    near = {x.point_id: (x.road_id, x.dist) for x in b.nearest_segment(p, r).collect()}
    assert near == {1: (0, 100.0), 2: (0, 100.0), 4: (0, 50.0)}
    assert sorted(x.road_id for x in b.nearest_segment(p, r, ties=True).where("point_id = 1").collect()) == [0, 1]
    moved = {x.point_id: (x.x, x.y, x.moved) for x in b.snap(p, r).collect()}
    assert moved[1] == (1500.0, 0.0, True) and moved[3] == (700.0, -100.01, False)


def test_rings_find_what_one_join_finds(spark, monkeypatch):
    rng = random.Random(3)
    centres = spark.createDataFrame([(i, rng.uniform(0, 9000), rng.uniform(0, 9000)) for i in range(40)], "block_id long, cx double, cy double")
    points = spark.createDataFrame([(i, rng.uniform(-9000, 21000), rng.uniform(0, 9000)) for i in range(60)], "point_id long, x double, y double")
    whole = sorted(map(tuple, b.nearest_center(points, centres).collect()))
    monkeypatch.setattr(b, "CENTERS", 1)
    assert sorted(map(tuple, b.nearest_center(points, centres).collect())) == whole


def test_polygons_of_crossing_roads(spark):
    r = roads(spark, (-5, 0, 15, 0), (-5, 10, 15, 10), (0, -5, 0, 15), (10, -5, 10, 15), (0, 0, 10, 10), (20, 20, 30, 20))
    t = sorted((x.area_m2, x.x, x.y) for x in pg.block_table(pg.road_blocks(r)).collect())
    assert [x[0] for x in t] == pytest.approx([50, 50])
    assert sorted(x[1] for x in t) == pytest.approx([10 / 3, 20 / 3])


def test_overlapping_roads_give_each_edge_once(spark):
    r = roads(spark, (0, 0, 10, 0), (5, 0, 15, 0), (0, 0, 0, 10), (0, 10, 10, 10), (10, 0, 10, 10))
    assert [x.area_m2 for x in pg.block_table(pg.road_blocks(r)).collect()] == pytest.approx([100])


def test_clipping():
    edges = lambda r: np.array([(*p, *q) for p, q in zip(r, r[1:] + r[:1])])
    square = edges([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)])
    assert rings.overlap(edges([(5.0, 5.0), (15.0, 5.0), (15.0, 15.0), (5.0, 15.0)]), square) == 25
    assert rings.overlap(edges([(20.0, 20.0), (30.0, 20.0), (30.0, 30.0)]), square) == 0


def test_coverage_adds_overlaps_up_to_the_area(spark):
    blocks = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0, 100.0), (2, 10.0, 0.0, 20.0, 10.0, 100.0)], "block_id int, x0 double, y0 double, x1 double, y1 double, area_m2 double")
    parks = spark.createDataFrame([(1, 0.0, 0.0, 8.0, 10.0), (2, 0.0, 0.0, 9.0, 10.0)], "park_id int, x0 double, y0 double, x1 double, y1 double")
    got = {r.block_id: r.park_fraction for r in b.coverage_fraction(blocks, parks, "park").collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_corner_contact_is_no_adjacency_and_parts_stay_apart(spark):
    blocks = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, 1.0), (2, 1.0, 1.0, 2.0, 2.0, 1.0), (3, 1.0, 0.0, 2.0, 1.0, 1.0), (9, 5.0, 5.0, 6.0, 6.0, 1.5)], "block_id int, x0 double, y0 double, x1 double, y1 double, area_m2 double")
    adj = b.adjacency(b.box_edges(blocks))
    assert sorted(map(tuple, adj.collect())) == [(1, 3), (2, 3), (3, 1), (3, 2)]
    assert sorted((r.block_id, r.new_id) for r in b.main_component(blocks, adj).collect()) == [(1, 0), (2, 1), (3, 2)]
