import math
import random

import numpy as np
import pytest

from cordon.operators import blocks as b
from cordon.operators import polygonize as pg
from cordon.operators import rings

L = [(0, 0), (2000, 0), (2000, 1000), (1000, 1000), (1000, 2000), (0, 2000)]
NOTCH = [(1000, 1000), (2000, 1000), (2000, 2000), (1000, 2000)]
RIGHT = [(2000, 0), (3000, 0), (3000, 2000), (2000, 2000)]


def table(spark, shapes, key="block_id"):
    rows = [(i, ring, k, float(x), float(y)) for i, parts in shapes.items() for ring, points in enumerate(parts) for k, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, f"{key} int, ring int, seq int, x double, y double")


def edges(points):
    return np.array([(*p, *q) for p, q in zip(points, points[1:] + points[:1])], float)


def even_odd(shape, x, y):
    return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for ax, ay, bx, by in shape) % 2 == 1


def test_adjacency_across_t_junctions_but_not_corners(spark):
    corner = [(3000, 2000), (4000, 2000), (4000, 3000), (3000, 3000)]
    got = {tuple(r) for r in rings.ring_adjacency(table(spark, {0: [L], 1: [NOTCH], 2: [RIGHT], 3: [corner]})).collect()}
    assert got == {(0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1)}


def test_measures_with_a_hole(spark):
    got = rings.measures(table(spark, {0: [[(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (2, 0), (2, 2), (0, 2)]]})).first()
    assert got.area_m2 == 12 and (got.x, got.y) == (round(28 / 12, 6), round(28 / 12, 6))


def test_overlap_against_a_fine_raster():
    """Random polygons that may cross themselves, with and without masks."""
    rng = random.Random(4)
    for n in range(25):
        a, c = ([(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(rng.randint(3, 8))] for _ in range(2))
        masks = [np.array(rings.capsule(*(rng.uniform(0, 10) for _ in range(4)), 0.7)) for _ in range(n % 3)]
        step = 0.05
        grid = [(i * step + step / 2, j * step + step / 2) for i in range(200) for j in range(200)]
        ea, ec = edges(a).tolist(), edges(c).tolist()
        em = [m.tolist() for m in masks]
        want = sum(even_odd(ea, x, y) and even_odd(ec, x, y) and not any(even_odd(m, x, y) for m in em) for x, y in grid) * step * step
        assert rings.overlap(edges(a), edges(c), masks) == pytest.approx(want, abs=0.35)


def test_overlap_of_shapes_that_are_not_convex_is_exact():
    assert rings.overlap(edges(L), edges(NOTCH)) == 0
    assert rings.overlap(edges(L), edges([(500, 500), (1500, 500), (1500, 1500), (500, 1500)])) == 750_000
    comb = [(0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (6, 2), (6, 10), (4, 10), (4, 2), (2, 2), (2, 10), (0, 10)]
    assert rings.overlap(edges(comb), edges([(0, 5), (10, 5), (10, 6), (0, 6)])) == pytest.approx(6)


def test_boxes_without_area_overlap_by_zero_what_they_enter(spark):
    """As the SQL of overlay_area has it: boxes of no width, no height or neither, in, on and off the borders of two blocks."""
    blocks = {0: (0, 0, 1000, 1000), 1: (1000, 0, 2000, 1000)}
    spots = [0, 300, 1000, 1500, 2000, 2100]
    boxes = [(x, y, x + w, y + h) for x in spots for y in (0, 400, 1000) for w in (0, 2, 700) for h in (0, 3)]
    ring = lambda x0, y0, x1, y1: [[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]
    got = {tuple(r) for r in rings.overlaps(table(spark, {i: ring(*b) for i, b in blocks.items()}), table(spark, {i: ring(*p) for i, p in enumerate(boxes)}, "area_id")).collect()}
    want = {
        (i, k, (min(b[2], p[2]) - max(b[0], p[0])) * (min(b[3], p[3]) - max(b[1], p[1])))
        for i, b in blocks.items() for k, p in enumerate(boxes) if p[0] < b[2] and p[2] > b[0] and p[1] < b[3] and p[3] > b[1]
    }
    assert got == want and sum(a == 0 for *_, a in want) > 10


def test_lines_and_places_enter_shapes_that_are_not_convex():
    shape, hole = edges(L), edges([(200, 200), (400, 200), (400, 400), (200, 400)])
    there = lambda *p: edges([*p, *p[-2::-1]])
    assert rings.flat(there((0, 0), (700, 300), (900, 1100))) and rings.flat(edges([(3, 3)])) and not rings.flat(shape)
    assert rings.enters(there((1500, 1500), (500, 1500)), shape) and rings.enters(there((900, 1900), (1900, 900)), shape)
    assert not rings.enters(there((1000, 1000), (1000, 2000)), shape) and not rings.enters(there((1100, 1900), (1900, 1100)), shape)
    assert rings.enters(edges([(300, 300)]), shape) and not rings.enters(edges([(300, 300)]), shape, [hole]) and not rings.enters(edges([(1000, 1500)]), shape)
    assert not rings.enters(edges([(300, 300)]), np.vstack([shape, hole])) and rings.enters(there((300, 300), (300, 500)), np.vstack([shape, hole]))


def test_water_under_a_bridge_does_not_count(spark):
    block = table(spark, {0: [[(0, 0), (1000, 0), (1000, 1000), (0, 1000)]]})
    water = table(spark, {5: [[(100, 100), (900, 100), (900, 300), (100, 300)], [(600, 150), (700, 150), (700, 250), (600, 250)]]}, "area_id")
    roads = spark.createDataFrame([(1, 500.0, -500.0, 500.0, 1500.0), (2, 0.0, 320.0, 1000.0, 320.0)], "road_id long, ax double, ay double, bx double, by_ double")
    plain, dry = (rings.coverage(block, water, "water", **k).first() for k in ({}, {"roads": roads}))
    assert plain.water_area_m2 == 150_000
    assert dry.water_area_m2 == pytest.approx(150_000 - 40 * 200)  # the second road touches no water, so its buffer stays out


def test_roads_touch_polygons(spark):
    shapes = table(spark, {0: [L], 1: [NOTCH], 2: [[(5000, 5000), (6000, 5000), (6000, 6000), (5000, 6000)], [(5400, 5400), (5600, 5400), (5600, 5600), (5400, 5600)]]})
    lines = [(1, 1200, 1200, 1800, 1800), (2, 1500, 500, 1500, 1500), (3, 2000, 1500, 2500, 1500), (4, 5450, 5450, 5550, 5550), (5, 5100, 5100, 5200, 5200), (6, 8000, 8000, 9000, 9000)]
    roads = spark.createDataFrame([(i, *map(float, x)) for i, *x in lines], "road_id long, ax double, ay double, bx double, by_ double")
    got = {tuple(r) for r in rings.touching(roads, shapes).collect()}
    assert got == {(1, 1), (2, 0), (2, 1), (3, 1), (5, 2)}


def test_from_roads_to_assigned_points(spark):
    """Every point inside the hull gets the polygon that brute force gives, and all are assigned."""
    lines = [(0, 0, 3000, 0), (0, 2000, 3000, 2000), (0, 0, 0, 2000), (3000, 0, 3000, 2000), (2000, 0, 2000, 2000), (1000, 1000, 2000, 1000), (1000, 1000, 1000, 2000)]
    roads = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(lines)], "road_id long, ax double, ay double, bx double, by_ double")
    faces = pg.road_blocks(roads).cache()
    centers = rings.measures(faces).selectExpr("block_id", "x as cx", "y as cy")
    rng = random.Random(1)
    points = spark.createDataFrame([(i, rng.uniform(-200, 3200), rng.uniform(-200, 2200)) for i in range(200)], "point_id long, x double, y double")
    hull = spark.createDataFrame([(0.0, 0.0, 3000.0, 0.0), (3000.0, 0.0, 3000.0, 2000.0), (3000.0, 2000.0, 0.0, 2000.0), (0.0, 2000.0, 0.0, 0.0)], "ax double, ay double, bx double, by_ double")
    touch = rings.touching(roads, faces)
    got = {r.point_id: (r.block_id, r.way) for r in b.assign_to_blocks(points, roads, touch, centers, hull).collect()}
    at = {r.block_id: (r.cx, r.cy) for r in centers.collect()}
    by_road = {}
    for r in touch.collect():
        by_road.setdefault(r.road_id, set()).add(r.block_id)

    def far(p, line):
        (ax, ay, bx, by), (x, y) = line, p
        t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        return math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))

    want = {}
    for i, x, y in points.collect():
        if 0 < x < 3000 and 0 < y < 2000:
            d = [far((x, y), line) for line in lines]
            near = {k for k, v in enumerate(d) if v == min(d) and v <= 100}
            some = set().union(*(by_road[k] for k in near)) if near else set()
            best = min(some or at, key=lambda k: (math.dist((x, y), at[k]), k if some else -k))
            want[i] = (best, "road" if some else "centre")
    assert got == want and len(at) == 3


@pytest.mark.parametrize("most", [0, 1000])
def test_nearest_centre_leaves_out_points_without_a_place(spark, monkeypatch, most):
    monkeypatch.setattr(b, "CENTERS", most)
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 5.0), (3, float("nan"), 1.0), (4, float("inf"), 0.0), (5, 90_000.0, 0.0)], "point_id long, x double, y double")
    centers = spark.createDataFrame([(7, 1.0, 0.0), (8, 10.0, 0.0), (9, None, 0.0)], "block_id long, cx double, cy double")
    got = {r.point_id: r.block_id for r in b.nearest_center(points, centers).collect()}
    assert got == {1: 7, 5: 8}
    assert b.nearest_center(points, centers.where("false")).count() == 0


def test_hull_and_repeated_points(spark):
    ring = spark.createDataFrame([(0.0, 0.0, 4.0, 0.0), (4.0, 0.0, 0.0, 4.0), (0.0, 4.0, 0.0, 0.0)], "ax double, ay double, bx double, by_ double")
    points = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 1.0), (2, 3.0, 3.0), (3, None, 1.0)], "point_id long, x double, y double")
    plan = b.in_ring(points, ring)
    assert [r.point_id for r in plan.collect()] == [1, 1]
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_components_of_a_long_chain(spark):
    n = 60
    blocks = spark.range(n).selectExpr("cast(id as int) as block_id", "1.0 as area_m2")
    links = [(i, i + 1) for i in range(n - 1) if i != 40]
    adjacent = spark.createDataFrame(links + [(y, x) for x, y in links], "src int, dst int")
    got = {r.block_id: r.comp for r in b.components(blocks, adjacent).collect()}
    assert got == {i: 0 if i <= 40 else 41 for i in range(n)}
