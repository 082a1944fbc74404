"""Blocks from road lines: faces of a planar network of segments.

Input is noded by exact crossing first (segments are split where others cross or touch
them, candidates by grid cell). Faces are then traced along half-edges: at each node the next
edge is the next one clockwise. The network of a city is one group.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordon.functions.geo import ring_measures
from cordon.operators.blocks import segment_cells


def noded(roads: DataFrame, cell: float = 500.0, digits: int = 3) -> DataFrame:
    """Segments (ax, ay, bx, by_) split at all crossings and touching ends, rounded to a grid, each once whatever its direction."""
    r = segment_cells(roads.select("road_id", "ax", "ay", "bx", "by_"), cell)
    o = r.select(F.col("road_id").alias("oid"), *[F.col(c).alias(f"o{c}") for c in ("ax", "ay", "bx", "by_")], "cx", "cy")
    met = r.join(o, ["cx", "cy"]).where("road_id <> oid").drop("cx", "cy").dropDuplicates(["road_id", "oid"])
    dx, dy, ex, ey = F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay"), F.col("obx") - F.col("oax"), F.col("oby_") - F.col("oay")
    cross = dx * ey - dy * ex
    fx, fy = F.col("oax") - F.col("ax"), F.col("oay") - F.col("ay")
    t, u = F.try_divide(fx * ey - fy * ex, cross), F.try_divide(fx * dy - fy * dx, cross)
    inside = lambda v: (v >= -1e-9) & (v <= 1 + 1e-9)
    crossing = F.when((F.abs(cross) > 1e-12) & inside(t) & inside(u), F.array(t))
    length2 = dx * dx + dy * dy
    along = lambda px, py: F.try_divide((px - F.col("ax")) * dx + (py - F.col("ay")) * dy, length2)
    # parallel and on one line: the other's ends cut this one
    same = (F.abs(cross) <= 1e-12) & (F.abs(fx * dy - fy * dx) <= 1e-9 * F.greatest(length2, F.lit(1.0)))
    ends = F.when(same, F.filter(F.array(along(F.col("oax"), F.col("oay")), along(F.col("obx"), F.col("oby_"))), lambda v: (v > 0) & (v < 1)))
    cuts = met.select("road_id", F.coalesce(crossing, ends, F.array().cast("array<double>")).alias("c")).groupBy("road_id").agg(F.flatten(F.collect_list("c")).alias("c"))
    at = F.array_sort(F.array_distinct(F.transform(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.coalesce("c", F.array().cast("array<double>"))), lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))))
    parts = roads.join(cuts, "road_id", "left").withColumn("t", at).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("t") - 1)))
    place = lambda a, b, k: F.round(F.col(a) + (F.col(b) - F.col(a)) * F.element_at("t", k), digits)
    parts = parts.select(place("ax", "bx", F.col("i")).alias("px"), place("ay", "by_", F.col("i")).alias("py"), place("ax", "bx", F.col("i") + 1).alias("qx"), place("ay", "by_", F.col("i") + 1).alias("qy"))
    first = F.struct("px", "py") <= F.struct("qx", "qy")
    return parts.where("px <> qx or py <> qy").select(*[F.when(first, F.col(a)).otherwise(F.col(b)).alias(n) for a, b, n in (("px", "qx", "ax"), ("py", "qy", "ay"), ("qx", "px", "bx"), ("qy", "py", "by_"))]).distinct()


def trace(pdf: pd.DataFrame) -> pd.DataFrame:
    """Bounded faces of noded segments, as rings (face, seq, x, y), anticlockwise."""
    out: dict[tuple, list[tuple]] = {}
    for ax, ay, bx, by in pdf[["ax", "ay", "bx", "by_"]].itertuples(index=False):
        out.setdefault((ax, ay), []).append((bx, by))
        out.setdefault((bx, by), []).append((ax, ay))
    turn = {p: sorted(set(q), key=lambda q, p=p: math.atan2(q[1] - p[1], q[0] - p[0])) for p, q in out.items()}
    place = {(p, q): i for p, qs in turn.items() for i, q in enumerate(qs)}
    seen, rings = set(), []
    for start in sorted(place):
        if start in seen:
            continue
        ring, edge = [], start
        while edge not in seen:
            seen.add(edge)
            ring.append(edge[0])
            p, q = edge
            edge = (q, turn[q][place[q, p] - 1])
        if sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])) > 1e-9:
            rings.append(min(ring[i:] + ring[:i] for i in range(len(ring))))
    rows = [(f, i, x, y) for f, ring in enumerate(sorted(rings)) for i, (x, y) in enumerate(ring)]
    return pd.DataFrame(rows, columns=["face", "seq", "x", "y"])


def road_blocks(roads: DataFrame) -> DataFrame:
    """Rings of blocks that roads enclose: block_id (numbered by the ring's first corner), seq, x, y. One city is one group."""
    return noded(roads).groupBy(F.lit(0).alias("city")).applyInPandas(trace, "face int, seq int, x double, y double").withColumnRenamed("face", "block_id")


def block_table(rings: DataFrame) -> DataFrame:
    """block_id, area and centre of rings."""
    return ring_measures(rings, ["block_id"])
