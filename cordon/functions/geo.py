"""Plane and sphere geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def max_spread_m(points: Column) -> Column:
    """Largest distance within an array of struct(lat, lon); 0 for fewer than two points."""
    def distance(p, q):
        return haversine_m(p["lat"], p["lon"], q["lat"], q["lon"])

    return F.coalesce(F.array_max(F.transform(points, lambda p: F.array_max(F.transform(points, lambda q: distance(p, q))))), F.lit(0.0))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def along_segment(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where on a segment (0 to 1) the nearest place to a point is; 0 for a segment without length."""
    length2 = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.try_divide((x - ax) * (bx - ax) + (y - ay) * (by - ay), length2)
    return F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))).otherwise(0.0)


def crosses(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Whether a ray from the point to the right crosses an edge; odd counts are inside."""
    return F.when((ay > y) != (by > y), x < (bx - ax) * (y - ay) / (by - ay) + ax).otherwise(False)


def ring_measures(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Area and centroid of rings given as vertices (keys, seq, x, y), not closed. Coordinates are taken from the ring's first corner for precision."""
    ring = F.array_sort(F.collect_list(F.struct("seq", "x", "y")))
    rings = vertices.groupBy(*keys).agg(ring.alias("r"))
    edges = rings.select(*keys, F.element_at("r", 1)["x"].alias("ox"), F.element_at("r", 1)["y"].alias("oy"), F.posexplode("r").alias("i", "p"), "r").withColumn("q", F.get("r", (F.col("i") + 1) % F.size("r")))
    ax, ay, bx, by = (F.col(p)[c] - F.col(o) for p, c, o in (("p", "x", "ox"), ("p", "y", "oy"), ("q", "x", "ox"), ("q", "y", "oy")))
    cross = ax * by - bx * ay
    return edges.groupBy(*keys, "ox", "oy").agg(F.sum(cross).alias("a2"), F.sum((ax + bx) * cross).alias("cx"), F.sum((ay + by) * cross).alias("cy")).select(
        *keys, F.abs(F.col("a2") / 2).alias("area_m2"),
        (F.col("ox") + F.try_divide(F.col("cx"), 3 * F.col("a2"))).alias("x"), (F.col("oy") + F.try_divide(F.col("cy"), 3 * F.col("a2"))).alias("y"),
    )


#: British National Grid (transverse Mercator on Airy 1830) and the datum shift from WGS84, of the
#: Ordnance Survey's published guide; good to a few metres.
AIRY_A, AIRY_B, WGS_A, WGS_B = 6377563.396, 6356256.909, 6378137.0, 6356752.314245
SCALE, LAT0, LON0, E0, N0 = 0.9996012717, math.radians(49), math.radians(-2), 400000.0, -100000.0
SHIFT = (-446.448, 125.157, -542.060)
ROTATION = tuple(math.radians(s / 3600) for s in (-0.1502, -0.2470, -0.8421))
PPM = 20.4894e-6


def _to_cartesian(lat: Column, lon: Column, a: float, b: float):
    e2 = 1 - b * b / (a * a)
    nu = a / F.sqrt(1 - e2 * F.pow(F.sin(lat), 2))
    return nu * F.cos(lat) * F.cos(lon), nu * F.cos(lat) * F.sin(lon), nu * (1 - e2) * F.sin(lat)


def _to_angles(x: Column, y: Column, z: Column, a: float, b: float):
    """Bowring's closed form."""
    e2, d2 = 1 - b * b / (a * a), a * a / (b * b) - 1
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * a, p * b)
    return F.atan2(z + d2 * b * F.pow(F.sin(theta), 3), p - e2 * a * F.pow(F.cos(theta), 3)), F.atan2(y, x)


def _shift(x, y, z, sign: int):
    (tx, ty, tz), (rx, ry, rz), s = (tuple(sign * v for v in SHIFT)), tuple(sign * v for v in ROTATION), 1 + sign * PPM
    return tx + s * x - rz * y + ry * z, ty + rz * x + s * y - rx * z, tz - ry * x + rx * y + s * z


def _meridian(lat: Column) -> Column:
    n = (AIRY_A - AIRY_B) / (AIRY_A + AIRY_B)
    d, s = lat - LAT0, lat + LAT0
    return AIRY_B * SCALE * (
        (1 + n + 5 / 4 * n**2 + 5 / 4 * n**3) * d
        - (3 * n + 3 * n**2 + 21 / 8 * n**3) * F.sin(d) * F.cos(s)
        + (15 / 8 * n**2 + 15 / 8 * n**3) * F.sin(2 * d) * F.cos(2 * s)
        - 35 / 24 * n**3 * F.sin(3 * d) * F.cos(3 * s)
    )


def airy_to_grid(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing of angles (radians) on the Airy ellipsoid."""
    e2 = 1 - AIRY_B**2 / AIRY_A**2
    s, c, t = F.sin(lat), F.cos(lat), F.tan(lat)
    nu = AIRY_A * SCALE / F.sqrt(1 - e2 * s * s)
    rho = AIRY_A * SCALE * (1 - e2) / F.pow(1 - e2 * s * s, 1.5)
    eta2, t2, d = nu / rho - 1, t * t, lon - LON0
    north = _meridian(lat) + N0 + nu / 2 * s * c * d * d + nu / 24 * s * F.pow(c, 3) * (5 - t2 + 9 * eta2) * F.pow(d, 4) + nu / 720 * s * F.pow(c, 5) * (61 - 58 * t2 + t2 * t2) * F.pow(d, 6)
    east = E0 + nu * c * d + nu / 6 * F.pow(c, 3) * (nu / rho - t2) * F.pow(d, 3) + nu / 120 * F.pow(c, 5) * (5 - 18 * t2 + t2 * t2 + 14 * eta2 - 58 * t2 * eta2) * F.pow(d, 5)
    return east, north


def with_grid(df: DataFrame, lat: str, lon: str, east: str = "east", north: str = "north") -> DataFrame:
    """Adds easting and northing (EPSG:27700) of WGS84 degrees. Steps are columns, since nested expressions would grow too large."""
    c = F.col
    x, y, z = _to_cartesian(F.radians(c(lat)), F.radians(c(lon)), WGS_A, WGS_B)
    df = df.withColumns({"_x": x, "_y": y, "_z": z})
    x, y, z = _shift(c("_x"), c("_y"), c("_z"), 1)
    df = df.withColumns({"_x": x, "_y": y, "_z": z})
    phi, lam = _to_angles(c("_x"), c("_y"), c("_z"), AIRY_A, AIRY_B)
    df = df.withColumns({"_phi": phi, "_lam": lam})
    e, n = airy_to_grid(c("_phi"), c("_lam"))
    return df.withColumns({east: e, north: n}).drop("_x", "_y", "_z", "_phi", "_lam")


def with_degrees(df: DataFrame, east: str, north: str, lat: str = "lat", lon: str = "lon", steps: int = 4) -> DataFrame:
    """Adds WGS84 degrees of an easting and northing."""
    c = F.col
    df = df.withColumn("_phi", LAT0 + (c(north) - N0) / (AIRY_A * SCALE))
    for _ in range(steps):
        df = df.withColumn("_phi", c("_phi") + (c(north) - N0 - _meridian(c("_phi"))) / (AIRY_A * SCALE))
    e2, p, d = 1 - AIRY_B**2 / AIRY_A**2, c("_phi"), c(east) - E0
    df = df.withColumns({"_nu": AIRY_A * SCALE / F.sqrt(1 - e2 * F.sin(p) * F.sin(p)), "_rho": AIRY_A * SCALE * (1 - e2) / F.pow(1 - e2 * F.sin(p) * F.sin(p), 1.5), "_t": F.tan(p)})
    nu, rho, t = c("_nu"), c("_rho"), c("_t")
    t2, eta2, sec = t * t, nu / rho - 1, 1 / F.cos(p)
    phi = p - t / (2 * rho * nu) * d * d + t / (24 * rho * F.pow(nu, 3)) * (5 + 3 * t2 + eta2 - 9 * t2 * eta2) * F.pow(d, 4) - t / (720 * rho * F.pow(nu, 5)) * (61 + 90 * t2 + 45 * t2 * t2) * F.pow(d, 6)
    lam = LON0 + sec / nu * d - sec / (6 * F.pow(nu, 3)) * (nu / rho + 2 * t2) * F.pow(d, 3) + sec / (120 * F.pow(nu, 5)) * (5 + 28 * t2 + 24 * t2 * t2) * F.pow(d, 5)
    df = df.withColumns({"_a": phi, "_b": lam})
    x, y, z = _to_cartesian(c("_a"), c("_b"), AIRY_A, AIRY_B)
    df = df.withColumns({"_x": x, "_y": y, "_z": z})
    x, y, z = _shift(c("_x"), c("_y"), c("_z"), -1)
    df = df.withColumns({"_x": x, "_y": y, "_z": z})
    la, lo = _to_angles(c("_x"), c("_y"), c("_z"), WGS_A, WGS_B)
    return df.withColumns({lat: F.degrees(la), lon: F.degrees(lo)}).drop("_phi", "_nu", "_rho", "_t", "_a", "_b", "_x", "_y", "_z")


def project_bbox(df: DataFrame, key: str = "box") -> DataFrame:
    """Bounds on the grid (x0, y0, x1, y1) of boxes (key, min_lon, min_lat, max_lon, max_lat): those of the projected corners."""
    corners = df.select(key, F.explode(F.array(*[F.struct(F.col(a).alias("la"), F.col(o).alias("lo")) for a in ("min_lat", "max_lat") for o in ("min_lon", "max_lon")])).alias("p")).select(key, "p.*")
    grid = with_grid(corners, "la", "lo")
    return df.join(grid.groupBy(key).agg(F.min("east").alias("x0"), F.min("north").alias("y0"), F.max("east").alias("x1"), F.max("north").alias("y1")), key)


def hex_cell(x: Column, y: Column, size: float) -> Column:
    """Cell "q:r" of an own grid of pointy-top hexagons with the given edge length (not H3)."""
    q, r = (x * (3**0.5 / 3) - y / 3) / size, y * (2 / 3) / size
    s = -q - r
    rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(s + 0.5)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    q2 = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    r2 = F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -rq - rs).otherwise(rr)
    return F.concat_ws(":", q2.cast("long"), r2.cast("long"))


def hex_polygon(cell: Column, size: float) -> Column:
    """Corners of a hexagon cell, array of struct(x, y), not closed."""
    q, r = F.split(cell, ":")[0].cast("double"), F.split(cell, ":")[1].cast("double")
    cx, cy = size * (3**0.5 * q + 3**0.5 / 2 * r), size * 1.5 * r
    return F.array(*[F.struct((cx + size * math.cos(math.radians(60 * k - 30))).alias("x"), (cy + size * math.sin(math.radians(60 * k - 30))).alias("y")) for k in range(6)])
