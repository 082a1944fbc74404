"""Blocks and areas as polygons: adjacency, touching roads, centres, coverage.

Polygons are vertex tables (an id, seq, x, y, and `ring` where there are holes), as the
polygonizer gives them; any shape, convex or not. What is inside follows the even-odd rule
over all rings, so that holes count as outside and rings that cross themselves need no
repair. Spatial joins are equi-joins on grid cells, refined exactly.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordon.config import ROAD_BUFFER_M
from cordon.functions.geo import crosses, ring_measures
from cordon.operators.blocks import adjacency, cells_of_box, segment_cells

EDGE = ("ax", "ay", "bx", "by_")


def ring_edges(rings: DataFrame, key: str = "block_id", places: bool = False) -> DataFrame:
    """Edges (key, ring, i, ax, ay, bx, by_) of vertices (key, seq, x, y, and ring where there are several). With `places`,
    a ring whose vertices are all at one place is one edge without length; else it has none."""
    given = rings if "ring" in rings.columns else rings.withColumn("ring", F.lit(0))
    line = given.groupBy(key, "ring").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("r"))
    line = line.select(key, "ring", F.posexplode("r").alias("i", "p"), "r").withColumn("q", F.get("r", (F.col("i") + 1) % F.size("r")))
    same = (F.col("p.x") == F.col("q.x")) & (F.col("p.y") == F.col("q.y"))  # rings may be closed
    if places:
        alone = F.forall("r", lambda v: (v["x"] == F.get("r", 0)["x"]) & (v["y"] == F.get("r", 0)["y"]))
        same = same & ~((F.col("i") == 0) & alone & ~F.isnan(F.col("p.x") + F.col("p.y")))
    return line.where(~same).select(key, "ring", "i", F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), F.col("q.x").alias("bx"), F.col("q.y").alias("by_"))


def polygons(rings: DataFrame, key: str = "block_id") -> DataFrame:
    """One row a polygon: key, its edges as an array, its box x0, y0, x1, y1."""
    edges = ring_edges(rings, key, places=True)
    low, high = (lambda a, b: F.least(F.min(a), F.min(b))), (lambda a, b: F.greatest(F.max(a), F.max(b)))
    return edges.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*EDGE))).alias("edges"), low("ax", "bx").alias("x0"), low("ay", "by_").alias("y0"), high("ax", "bx").alias("x1"), high("ay", "by_").alias("y1"))


def measures(rings: DataFrame, key: str = "block_id", digits: int = 6) -> DataFrame:
    """key, area_m2 and centre x, y; holes (rings from 1 on) are taken away."""
    if "ring" not in rings.columns:
        one = ring_measures(rings, [key])
        return one.select(key, "area_m2", *[F.round(c, digits).alias(c) for c in ("x", "y")])
    sign = F.when(F.col("ring") == 0, 1.0).otherwise(-1.0)
    per = ring_measures(rings, [key, "ring"]).withColumn("a", sign * F.col("area_m2"))
    total = per.groupBy(key).agg(F.sum("a").alias("area_m2"), *[F.sum(F.col("a") * F.col(c)).alias(c) for c in ("x", "y")])
    return total.select(key, "area_m2", *[F.round(F.try_divide(F.col(c), F.col("area_m2")), digits).alias(c) for c in ("x", "y")])


def noded_edges(rings: DataFrame, key: str = "block_id", cell: float = 500.0, digits: int = 3) -> DataFrame:
    """(key, e): undirected edges, split where a corner of any polygon lies on them, so that both owners of a stretch have the same e."""
    edges = ring_edges(rings, key).withColumn("road_id", F.struct(key, "ring", "i"))
    corners = edges.select(F.round("ax", digits).alias("x"), F.round("ay", digits).alias("y")).distinct()
    corners = corners.withColumns({"cx": F.floor(F.col("x") / cell).cast("long"), "cy": F.floor(F.col("y") / cell).cast("long")})
    near = segment_cells(edges.select("road_id", *EDGE), cell).join(corners, ["cx", "cy"])
    dx, dy = F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay")
    px, py = F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
    length2 = dx * dx + dy * dy
    off = F.abs(px * dy - py * dx) / F.sqrt(length2)
    t = (px * dx + py * dy) / length2
    cuts = near.where((off < 10.0**-digits) & (t > 0) & (t < 1)).groupBy("road_id").agg(F.collect_set(F.struct(t.alias("t"), "x", "y")).alias("cuts"))
    end = lambda k, a, b: F.struct(F.lit(float(k)).alias("t"), F.round(a, digits).alias("x"), F.round(b, digits).alias("y"))
    stops = F.array_sort(F.concat(F.array(end(0, "ax", "ay"), end(1, "bx", "by_")), F.coalesce("cuts", F.array().cast("array<struct<t: double, x: double, y: double>>"))))
    name = lambda p: F.concat_ws(",", p["x"] + 0.0, p["y"] + 0.0)
    pairs = F.zip_with(F.slice("stops", 1, F.size("stops") - 1), F.slice("stops", 2, F.size("stops") - 1), lambda p, q: F.when(name(p) != name(q), F.concat_ws("|", F.array_sort(F.array(name(p), name(q))))))
    return edges.join(cuts, "road_id", "left").withColumn("stops", stops).select(key, F.explode(F.array_compact(pairs)).alias("e")).distinct()


def ring_adjacency(rings: DataFrame, cell: float = 500.0) -> DataFrame:
    """Blocks that share a stretch of border, both ways; touching corners don't count."""
    return adjacency(noded_edges(rings, cell=cell))


def met_by_cell(a: DataFrame, b: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Rows of two tables with boxes (x0, y0, x1, y1) whose boxes share a cell, each pair once."""
    deal = lambda df, mark: df.select(*[F.col(c).alias(f"{mark}{c}" if c in BOX else c) for c in df.columns], F.explode(cells_of_box(*(F.col(c) for c in BOX), cell)).alias("c"))
    met = deal(a, "a_").join(deal(b, "b_"), "c")
    overlap = (F.col("a_x0") <= F.col("b_x1")) & (F.col("b_x0") <= F.col("a_x1")) & (F.col("a_y0") <= F.col("b_y1")) & (F.col("b_y0") <= F.col("a_y1"))
    return met.where(overlap).dropDuplicates(keys)


BOX = ("x0", "y0", "x1", "y1")


def inside(x: Column, y: Column, edges: Column) -> Column:
    """Whether a place is in a polygon given as an array of edges."""
    hits = F.aggregate(edges, F.lit(0), lambda n, e: n + crosses(x, y, e["ax"], e["ay"], e["bx"], e["by_"]).cast("int"))
    return hits % 2 == 1


def meets(ax: Column, ay: Column, bx: Column, by: Column, e: Column) -> Column:
    """Whether a segment and an edge have a place in common, ends included."""
    turn = lambda px, py, qx, qy, rx, ry: F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))
    d1, d2 = turn(ax, ay, bx, by, e["ax"], e["ay"]), turn(ax, ay, bx, by, e["bx"], e["by_"])
    d3, d4 = turn(e["ax"], e["ay"], e["bx"], e["by_"], ax, ay), turn(e["ax"], e["ay"], e["bx"], e["by_"], bx, by)
    boxes = (F.least(ax, bx) <= F.greatest(e["ax"], e["bx"])) & (F.greatest(ax, bx) >= F.least(e["ax"], e["bx"])) & (F.least(ay, by) <= F.greatest(e["ay"], e["by_"])) & (F.greatest(ay, by) >= F.least(e["ay"], e["by_"]))
    return boxes & (d1 * d2 <= 0) & (d3 * d4 <= 0)


def touching(roads: DataFrame, rings: DataFrame, key: str = "block_id", cell: float = 1000.0) -> DataFrame:
    """Distinct (road_id, key) where a road segment touches, crosses or lies in a polygon."""
    lines = roads.select("road_id", *EDGE, F.least("ax", "bx").alias("x0"), F.least("ay", "by_").alias("y0"), F.greatest("ax", "bx").alias("x1"), F.greatest("ay", "by_").alias("y1"))
    met = met_by_cell(lines, polygons(rings, key), ["road_id", *EDGE, key], cell)
    at = [F.col(c) for c in EDGE]
    return met.where(F.exists("edges", lambda e: meets(*at, e)) | inside(at[0], at[1], F.col("edges"))).select("road_id", key).distinct()


# Areas of overlap


def capsule(ax: float, ay: float, bx: float, by: float, r: float, steps: int = 16) -> list[tuple[float, float, float, float]]:
    """Edges of the outline of all places within r of a segment; quarter circles in so many steps."""
    along = math.atan2(by - ay, bx - ax)
    turn = [along + math.pi / 2 + math.pi * k / (2 * steps) for k in range(2 * steps + 1)]
    ring = [(ax + r * math.cos(a), ay + r * math.sin(a)) for a in turn] + [(bx + r * math.cos(a + math.pi), by + r * math.sin(a + math.pi)) for a in turn]
    return [(*p, *q) for p, q in zip(ring, ring[1:] + ring[:1])]


def heights(shapes: list[np.ndarray]) -> np.ndarray:
    """Heights at which edges end or cross: between two of them, no edge of the shapes crosses another."""
    e = np.vstack(shapes)
    found = [e[:, 1], e[:, 3]]
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    for k in range(len(e) - 1):
        o = slice(k + 1, None)
        cross = dx[k] * dy[o] - dy[k] * dx[o]
        fx, fy = e[o, 0] - e[k, 0], e[o, 1] - e[k, 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (fx * dy[o] - fy * dx[o]) / cross, (fx * dy[k] - fy * dx[k]) / cross
        ok = (cross != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1)
        found.append(e[k, 1] + t[ok] * dy[k])
    return np.unique(np.concatenate(found))


def spans(shape: np.ndarray, y: float) -> np.ndarray:
    """Where a horizontal line enters and leaves a shape, in order; the same to the last bit whichever way an edge runs."""
    up = (shape[:, 1] > y) != (shape[:, 3] > y)
    e = shape[up]
    e = np.where((e[:, 1] > e[:, 3])[:, None], e[:, [2, 3, 0, 1]], e)
    return np.sort(e[:, 0] + (y - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1]))


def overlap(a: np.ndarray, b: np.ndarray, without: list[np.ndarray] | None = None) -> float:
    """Area that is in a and in b and in none of `without`, each an array of edges (n x 4) under the even-odd rule. Exact:
    between two of heights() the width of what is common changes linearly, so its middle counts."""
    without = without or []
    low, high = max(min(s[:, 1].min(), s[:, 3].min()) for s in (a, b)), min(max(s[:, 1].max(), s[:, 3].max()) for s in (a, b))
    ys = heights([a, b, *without])
    ys = np.unique(np.clip(ys, low, high)) if low < high else ys[:0]
    total = 0.0
    for y0, y1 in zip(ys[:-1], ys[1:]):
        y = (y0 + y1) / 2
        marks = sorted([(x, 0) for x in spans(a, y)] + [(x, 1) for x in spans(b, y)] + [(x, 2 + k) for k, s in enumerate(without) for x in spans(s, y)])
        inside_of, width, before = set(), 0.0, 0.0
        for x, k in marks:
            if inside_of == {0, 1}:
                width += x - before
            inside_of ^= {k}
            before = x
        total += width * (y1 - y0)
    return total


def flat(shape: np.ndarray) -> bool:
    """Whether a shape has no area: a place, a line there and back."""
    if any(np.ptp(shape[:, [c, c + 2]]) == 0 for c in (0, 1)):
        return True
    ys = heights([shape])
    widths = (spans(shape, (y0 + y1) / 2) for y0, y1 in zip(ys[:-1], ys[1:]))
    return all((w[::2] == w[1::2]).all() for w in widths)


def within(x: float, y: float, shape: np.ndarray) -> bool:
    """Whether a place is inside a shape, off its border."""
    ax, ay, bx, by = shape.T
    on = ((bx - ax) * (y - ay) == (by - ay) * (x - ax)) & (np.minimum(ax, bx) <= x) & (x <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= y) & (y <= np.maximum(ay, by))
    return not on.any() and bool((spans(shape, y) > x).sum() % 2)


def enters(line: np.ndarray, shape: np.ndarray, without: list[np.ndarray] | None = None) -> bool:
    """Whether any place on the edges of `line` is inside a shape, off its border, and in none of `without`. Between two
    places where an edge meets others nothing changes, so the middle counts."""
    o = np.vstack([shape, *(without or [])])
    ox, oy = o[:, 2] - o[:, 0], o[:, 3] - o[:, 1]
    for (ax, ay), (bx, by) in {tuple(sorted(((e[0], e[1]), (e[2], e[3])))) for e in line.tolist()}:
        dx, dy = bx - ax, by - ay
        length2 = dx * dx + dy * dy
        stops = np.array([0.0, 0.0])
        if length2 > 0:
            cross = dx * oy - dy * ox
            with np.errstate(divide="ignore", invalid="ignore"):
                met = ((o[:, 0] - ax) * oy - (o[:, 1] - ay) * ox) / cross
            along = ((o[:, 0] - ax) * dx + (o[:, 1] - ay) * dy) / length2
            t = np.concatenate([met[cross != 0], along])
            stops = np.unique(np.concatenate([[0.0, 1.0], t[(t > 0) & (t < 1)]]))
        for t in (stops[:-1] + stops[1:]) / 2:
            x, y = ax + t * dx, ay + t * dy
            if within(x, y, shape) and not any((spans(s, y) > x).sum() % 2 for s in without or []):
                return True
    return False


def overlaps(blocks: DataFrame, areas: DataFrame, key: str = "area_id", roads: DataFrame | None = None, buffer_m: float = ROAD_BUFFER_M, cell: float = 1000.0) -> DataFrame:
    """(block_id, key, overlap_m2) of polygons that overlap, both as vertices. With `roads`, places within the buffer of a
    road that touches any of the areas don't count, as under bridges. Polygons without area, lines and places, overlap by 0
    what they enter; on its border alone they don't."""
    a, b = polygons(blocks, "block_id"), polygons(areas, key)
    if roads is None:
        b = b.withColumn("roads", F.array().cast("array<struct<ax: double, ay: double, bx: double, by_: double>>"))
    else:
        wet = roads.join(touching(roads, areas, key, cell).select("road_id").distinct(), "road_id", "left_semi")
        around = wet.select("road_id", *EDGE, *[(f(c, d) + s * buffer_m).alias(n) for n, f, c, d, s in (("x0", F.least, "ax", "bx", -1), ("y0", F.least, "ay", "by_", -1), ("x1", F.greatest, "ax", "bx", 1), ("y1", F.greatest, "ay", "by_", 1))])
        near = met_by_cell(around, b.select(key, *BOX), ["road_id", *EDGE, key], cell).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*EDGE))).alias("roads"))
        b = b.join(near, key, "left").withColumn("roads", F.coalesce("roads", F.array().cast("array<struct<ax: double, ay: double, bx: double, by_: double>>")))
    met = met_by_cell(a.withColumnRenamed("edges", "block_edges"), b, ["block_id", key], cell).select("block_id", key, "block_edges", "edges", "roads")

    def run(batches):
        shape = lambda es: np.array([[e[c] for c in EDGE] for e in es], float).reshape(-1, 4)
        for pdf in batches:
            value, meet = [], []
            for x, y, lines in zip(pdf["block_edges"], pdf["edges"], pdf["roads"]):
                block, area = shape(x), shape(y)
                box = (min(block[:, 0].min(), block[:, 2].min()), min(block[:, 1].min(), block[:, 3].min()), max(block[:, 0].max(), block[:, 2].max()), max(block[:, 1].max(), block[:, 3].max()))
                reach = lambda e: min(e["ax"], e["bx"]) - buffer_m <= box[2] and max(e["ax"], e["bx"]) + buffer_m >= box[0] and min(e["ay"], e["by_"]) - buffer_m <= box[3] and max(e["ay"], e["by_"]) + buffer_m >= box[1]  # noqa: B023, E731
                under = [np.array(capsule(*(e[c] for c in EDGE), buffer_m)) for e in lines if reach(e)]
                value.append(overlap(block, area, under))
                meet.append(value[-1] > 0 or (enters(area, block, under) if flat(area) else flat(block) and enters(block, area, under)))
            yield pdf[["block_id", key]].assign(overlap_m2=value)[np.array(meet, bool)]

    kinds = {f.name: f.dataType.simpleString() for f in met.schema}
    return met.mapInPandas(run, f"block_id {kinds['block_id']}, {key} {kinds[key]}, overlap_m2 double")


def coverage(blocks: DataFrame, areas: DataFrame, name: str, key: str = "area_id", **how) -> DataFrame:
    """block_id, area_m2, {name}_area_m2 (overlaps summed, at most the block's area) and {name}_fraction of block polygons."""
    covered = overlaps(blocks, areas, key, **how).groupBy("block_id").agg(F.sum("overlap_m2").alias("covered"))
    area = F.least(F.coalesce("covered", F.lit(0.0)), F.col("area_m2"))
    return measures(blocks).select("block_id", "area_m2").join(covered, "block_id", "left").select("block_id", "area_m2", area.alias(f"{name}_area_m2"), F.try_divide(area, F.col("area_m2")).alias(f"{name}_fraction"))
