"""Blocks and places: nearest road, blocks of roads, hull, coverage, adjacency, components.

Spatial joins are equi-joins on grid cells, refined exactly. A segment or box is exploded
over the cells that it covers; a point looks at its own cell and the eight around.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cordon.config import PARK_MAX, SNAP_M, WATER_MAX
from cordon.functions.geo import along_segment, crosses, distance
from cordon.shared import cut_lineage


def cell_of(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def cells_of_box(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """Array of struct(cx, cy) of all cells that a box touches."""
    xs, ys = F.sequence(cell_of(x0, size), cell_of(x1, size)), F.sequence(cell_of(y0, size), cell_of(y1, size))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def segment_cells(roads: DataFrame, size: float) -> DataFrame:
    """Roads (road_id, ax, ay, bx, by_) exploded over cells of their bounding boxes, in stretches of a cell's length so that long ones don't cover whole areas."""
    n = F.greatest(F.lit(1), F.ceil(distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by_")) / size)).cast("int")
    part = roads.withColumn("k", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("n", n)
    at = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / F.col("n")
    xa, ya, xb, yb = at("ax", "bx", F.col("k")), at("ay", "by_", F.col("k")), at("ax", "bx", F.col("k") + 1), at("ay", "by_", F.col("k") + 1)
    cells = cells_of_box(F.least(xa, xb), F.least(ya, yb), F.greatest(xa, xb), F.greatest(ya, yb), size)
    return part.select(*roads.columns, F.explode(cells).alias("c")).select(*roads.columns, "c.cx", "c.cy").dropDuplicates(["road_id", "cx", "cy"])


def nearest_segment(points: DataFrame, roads: DataFrame, within: float = SNAP_M, ties: bool = False) -> DataFrame:
    """Nearest road of each point (point_id, x, y) within a distance, with the place on it: dist, nx, ny.

    Points without one are not in the result. `ties` keeps all equally near roads, else the
    smallest road_id stands for them.
    """
    around = F.array(*[F.struct((cell_of(F.col("x"), within) + i).alias("cx"), (cell_of(F.col("y"), within) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    p = points.select("point_id", "x", "y", F.explode(around).alias("c")).select("point_id", "x", "y", "c.cx", "c.cy")
    met = p.join(segment_cells(roads, within), ["cx", "cy"]).dropDuplicates(["point_id", "road_id"])
    t = along_segment(*(F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by_")))
    met = met.withColumn("nx", F.col("ax") + t * (F.col("bx") - F.col("ax"))).withColumn("ny", F.col("ay") + t * (F.col("by_") - F.col("ay")))
    met = met.withColumn("dist", distance(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))).where(F.col("dist") <= within)
    order = W.partitionBy("point_id").orderBy("dist")
    ranked = met.withColumn("n", F.rank().over(order) if ties else F.row_number().over(order.orderBy("dist", "road_id")))
    return ranked.where("n = 1").select("point_id", "road_id", "dist", "nx", "ny")


def snap(points: DataFrame, roads: DataFrame, within: float = SNAP_M) -> DataFrame:
    """Points moved to the nearest road if there is one within the distance; moved says which."""
    near = nearest_segment(points, roads, within)
    return points.join(near, "point_id", "left").select("point_id", F.coalesce("nx", "x").alias("x"), F.coalesce("ny", "y").alias("y"), F.col("nx").isNotNull().alias("moved"))


#: So many centres are compared with each point in one expression; more are looked up by grid cell.
CENTERS = 1_000
#: Edges of a hull that are held in an expression.
HULL_EDGES = 10_000


def nearest_center(points: DataFrame, centers: DataFrame) -> DataFrame:
    """Nearest center (block_id, cx, cy) of each point, without limit; of ties the largest id.

    Points and centers with a missing or infinite coordinate are left out. Up to CENTERS
    centers are constants of one expression: neither join nor shuffle. Of more, points search
    rings of grid cells of growing width.
    """
    points, centers = finite(points, "x", "y"), finite(centers, "cx", "cy")
    few = centers.select("block_id", "cx", "cy").limit(CENTERS + 1).collect()
    if len(few) > CENTERS:
        return _nearest_by_rings(points, centers)
    if not few:
        return points.select("point_id", F.lit(None).cast(centers.schema["block_id"].dataType).alias("block_id"), F.lit(None).cast("double").alias("dist")).where("false")
    few.sort(key=lambda r: r["block_id"])
    ids, xs, ys = (F.lit([r[c] for r in few]) for c in ("block_id", "cx", "cy"))
    away = F.transform(F.sequence(F.lit(0), F.lit(len(few) - 1)), lambda i: F.struct(distance(F.col("x"), F.col("y"), F.get(xs, i), F.get(ys, i)).alias("dist"), (-i).alias("i")))
    best = points.withColumn("b", F.array_min(away))
    return best.select("point_id", F.get(ids, -F.col("b.i")).cast(centers.schema["block_id"].dataType).alias("block_id"), "b.dist")


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose coordinates are numbers."""
    for c in columns:
        df = df.where(F.abs(c) < float("inf"))
    return df


def _nearest_by_rings(points: DataFrame, centers: DataFrame) -> DataFrame:
    """Points look around in cells of growing width until all have a center; few are left after the first rounds, and each round cuts its lineage."""
    span = centers.agg(F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1"), F.count("*").alias("n")).first()
    size = max(1e-9, max(span["x1"] - span["x0"], span["y1"] - span["y0"]) / max(1.0, span["n"] ** 0.5))
    found, left = None, points.select("point_id", "x", "y")
    while True:
        around = F.array(*[F.struct((cell_of(F.col("x"), size) + i).alias("gx"), (cell_of(F.col("y"), size) + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        p = left.select("point_id", "x", "y", F.explode(around).alias("g")).select("point_id", "x", "y", "g.gx", "g.gy")
        met = p.join(centers.withColumns({"gx": cell_of(F.col("cx"), size), "gy": cell_of(F.col("cy"), size)}), ["gx", "gy"])
        d = distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"))
        # within a cell's length nothing nearer can lie outside the nine cells
        best = cut_lineage(met.where(d <= size).groupBy("point_id").agg(F.min_by(F.struct("block_id", d.alias("dist")), F.struct(d, -F.col("block_id"))).alias("b")).select("point_id", "b.block_id", "b.dist"))
        found = best if found is None else found.unionByName(best)
        left = cut_lineage(left.join(best, "point_id", "left_anti"))
        if left.isEmpty():
            return found
        size *= 4


def road_blocks(roads: DataFrame, blocks: DataFrame, cell: float = 1000.0) -> DataFrame:
    """Distinct (road_id, block_id) where a road touches or crosses a block's box, border included (Liang-Barsky clipping)."""
    b = blocks.select("block_id", "x0", "y0", "x1", "y1", F.explode(cells_of_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), cell)).alias("c")).select("block_id", "x0", "y0", "x1", "y1", "c.cx", "c.cy")
    r = segment_cells(roads, cell)
    met = r.join(b, ["cx", "cy"])
    dx, dy = F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay")

    def window(d: Column, a: str, low: str, high: str):
        """Share of the road (from, to) between two parallel borders; none if it runs outside along them."""
        t0, t1 = F.try_divide(F.col(low) - F.col(a), d), F.try_divide(F.col(high) - F.col(a), d)
        flat = F.when(F.col(a).between(F.col(low), F.col(high)), 0.0).otherwise(2.0)
        return F.when(d == 0, flat).otherwise(F.least(t0, t1)), F.when(d == 0, 1.0).otherwise(F.greatest(t0, t1))

    (xa, xb), (ya, yb) = window(dx, "ax", "x0", "x1"), window(dy, "ay", "y0", "y1")
    return met.where(F.greatest(xa, ya, F.lit(0.0)) <= F.least(xb, yb, F.lit(1.0))).select("road_id", "block_id").distinct()


def in_ring(points: DataFrame, ring: DataFrame) -> DataFrame:
    """Rows of `points` (point_id) strictly inside a ring given as edges (ax, ay, bx, by_); odd crossings are inside.

    A hull's edges are constants of one expression: no join, no shuffle, and each row of
    `points` is looked at by itself. More than HULL_EDGES edges are an error.
    """
    edges = ring.select("ax", "ay", "bx", "by_").limit(HULL_EDGES + 1).collect()
    if len(edges) > HULL_EDGES:
        raise ValueError(f"a hull of more than {HULL_EDGES} edges: use rings.touching or simplify it")
    if not edges:
        return points.select("point_id").where("false")
    ax, ay, bx, by = (F.lit([float(e[c]) for e in edges]) for c in ("ax", "ay", "bx", "by_"))
    hit = lambda i: crosses(F.col("x"), F.col("y"), F.get(ax, i), F.get(ay, i), F.get(bx, i), F.get(by, i))
    odd = F.size(F.filter(F.sequence(F.lit(0), F.lit(len(edges) - 1)), hit)) % 2 == 1
    return points.where(odd).select("point_id")


def assign_to_blocks(points: DataFrame, roads: DataFrame, touch: DataFrame, centers: DataFrame, hull: DataFrame, within: float = SNAP_M) -> DataFrame:
    """Block of each point inside the hull: of the blocks that its nearest roads (ties included) touch (road_id, block_id) the
    one with the nearest centre (block_id, cx, cy), else the block with the nearest centre of all. way says which.

    Blocks may be boxes (road_blocks, box_centers) or polygons (rings.touching, rings.measures).
    """
    inside = points.join(in_ring(points, hull), "point_id", "left_semi")
    by_road = nearest_segment(inside, roads, within, ties=True).join(touch, "road_id").select("point_id", "block_id").distinct()
    d = distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"))
    first = by_road.join(centers, "block_id").join(inside, "point_id").groupBy("point_id").agg(F.min_by("block_id", F.struct(d, F.col("block_id"))).alias("block_id")).withColumn("way", F.lit("road"))
    rest = nearest_center(inside.join(first, "point_id", "left_anti"), centers).select("point_id", "block_id", F.lit("centre").alias("way"))
    return first.unionByName(rest)


def box_centers(blocks: DataFrame) -> DataFrame:
    return blocks.select("block_id", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))


def coverage_fraction(blocks: DataFrame, areas: DataFrame, name: str, cell: float = 1000.0) -> DataFrame:
    """Adds {name}_area_m2 (overlap with boxes of `areas`, summed, at most the block's area) and {name}_fraction."""
    explode = lambda df, k: df.select(k, "x0", "y0", "x1", "y1", F.explode(cells_of_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), cell)).alias("c"))
    key = areas.columns[0]
    b = explode(blocks, "block_id").select("block_id", "x0", "y0", "x1", "y1", "c.cx", "c.cy")
    a = explode(areas, key).select(key, *[F.col(c).alias(f"a{c}") for c in ("x0", "y0", "x1", "y1")], "c.cx", "c.cy")
    met = b.join(a, ["cx", "cy"]).dropDuplicates(["block_id", key])
    overlap = F.greatest(F.least("x1", "ax1") - F.greatest("x0", "ax0"), F.lit(0.0)) * F.greatest(F.least("y1", "ay1") - F.greatest("y0", "ay0"), F.lit(0.0))
    covered = met.groupBy("block_id").agg(F.sum(overlap).alias("covered"))
    area = F.least(F.coalesce("covered", F.lit(0.0)), F.col("area_m2"))
    return blocks.join(covered, "block_id", "left").withColumn(f"{name}_area_m2", area).withColumn(f"{name}_fraction", area / F.col("area_m2")).drop("covered")


def filter_blocks(blocks: DataFrame, park_max: float = PARK_MAX, water_max: float = WATER_MAX) -> DataFrame:
    return blocks.where((F.col("park_fraction") < park_max) & (F.col("water_fraction") < water_max))


def box_edges(blocks: DataFrame) -> DataFrame:
    """Each box's four sides as undirected edges: block_id, e (a key that both owners of a side share)."""
    corners = [("x0", "y0", "x1", "y0"), ("x1", "y0", "x1", "y1"), ("x0", "y1", "x1", "y1"), ("x0", "y0", "x0", "y1")]
    return blocks.select("block_id", F.explode(F.array(*[F.concat_ws(",", *c) for c in corners])).alias("e"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Blocks that share an edge (block_id, e), both ways. Boundaries must be noded: split where others begin."""
    a, b = edges.select(F.col("block_id").alias("src"), "e"), edges.select(F.col("block_id").alias("dst"), "e")
    return a.join(b, "e").where("src <> dst").select("src", "dst").distinct()


def boundary_edges(edges: DataFrame) -> DataFrame:
    """Edges of the union of blocks: those of one block only."""
    return edges.groupBy("e").agg(F.count("*").alias("n"), F.min("block_id").alias("block_id")).where("n = 1").select("e", "block_id")


def components(blocks: DataFrame, adjacent: DataFrame) -> DataFrame:
    """(block_id, comp): the smallest block that each reaches. Each round labels hear of neighbours' and then take their label's own, so that few rounds do for long chains."""
    labels = cut_lineage(blocks.select("block_id", F.col("block_id").alias("comp")))
    while True:
        heard = adjacent.join(labels.withColumnRenamed("block_id", "dst"), "dst").groupBy(F.col("src").alias("block_id")).agg(F.min("comp").alias("m"))
        mid = labels.join(heard, "block_id", "left").select("block_id", "comp", F.least("comp", "m").alias("mid"))
        up = labels.select(F.col("block_id").alias("mid"), F.col("comp").alias("top"))
        new = cut_lineage(mid.join(up, "mid", "left").select("block_id", F.least("mid", "top").alias("comp"), (F.least("mid", "top") < F.col("comp")).alias("moved")))
        labels = new.select("block_id", "comp")
        if new.where("moved").isEmpty():
            return labels


def main_component(blocks: DataFrame, adjacent: DataFrame) -> DataFrame:
    """Blocks of the edge-connected component of the largest area, numbered anew (new_id) in order of the old ids."""
    labels = components(blocks, adjacent)
    best = blocks.join(labels, "block_id").groupBy("comp").agg(F.sum("area_m2").alias("a")).orderBy(F.desc("a"), "comp").limit(1)
    inside = blocks.join(labels, "block_id").join(F.broadcast(best.select("comp")), "comp", "left_semi").drop("comp")
    return inside.withColumn("new_id", F.row_number().over(W.orderBy("block_id")) - 1)
