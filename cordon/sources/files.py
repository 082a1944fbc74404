"""Sources and sinks: quotes, trips, blocks, roads and areas, weather, holidays, checkpoints."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordon.config import BBOX, PARK_TAGS, ROAD_TYPES
from cordon.functions import nan_to_null
from cordon.functions.geo import with_grid
from cordon.operators.weather import VARIABLES

QUOTES_RAW = "quote_id string, quote_creation_timestamp string, pickup_latitude double, pickup_longitude double, dropoff_latitude double, dropoff_longitude double, quoted_price double, estimated_travel_time double, quote_converted boolean"
FEATURES = "type string, features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"


def read_quotes_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw quotes with ISO-8601 timestamps (any number of fractional digits; without an offset UTC). A row that doesn't parse is an error; NaN becomes null."""
    raw = spark.read.schema(QUOTES_RAW).option("mode", "FAILFAST").csv(path, header=True)
    doubles = [f.name for f in raw.schema if f.dataType.simpleString() == "double"]
    return raw.withColumn("quote_creation_timestamp", F.to_timestamp("quote_creation_timestamp")).withColumns({c: nan_to_null(F.col(c)) for c in doubles})


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of all features: feature (number in the file), properties, part, ring, seq, x, y. Polygons and multi-polygons."""
    one = spark.read.schema(FEATURES).json(path, multiLine=True)
    f = one.select(F.posexplode("features").alias("feature", "f")).select("feature", "f.properties", "f.geometry.type", "f.geometry.coordinates")
    multi = F.from_json("coordinates", "array<array<array<array<double>>>>")
    single = F.from_json("coordinates", "array<array<array<double>>>")
    parts = f.withColumn("parts", F.when(F.col("type") == "MultiPolygon", multi).when(F.col("type") == "Polygon", F.array(single)))
    rings = parts.select("feature", "properties", F.posexplode("parts").alias("part", "rings")).select("feature", "properties", "part", F.posexplode("rings").alias("ring", "points"))
    points = rings.select("feature", "properties", "part", "ring", F.posexplode("points").alias("seq", "p"))
    return points.select("feature", "properties", "part", "ring", "seq", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def load_roads(ways: DataFrame, bbox=BBOX, road_types: list[str] = ROAD_TYPES) -> DataFrame:
    """Road segments on the grid from way vertices (way_id, highway, seq, lon, lat): types of the list, ways with a vertex in the box.

    A reader of the map's binary format isn't part of this library; extracts come as tables.
    """
    inside = F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3])
    wanted = ways.where(F.col("highway").isin(road_types))
    kept = wanted.join(wanted.where(inside).select("way_id").distinct(), "way_id", "left_semi")
    line = with_grid(kept, "lat", "lon").groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("seq", "east", "north"))).alias("v"))
    pairs = line.where("size(v) > 1").select("way_id", F.posexplode(F.zip_with(F.slice("v", 1, F.size("v") - 1), F.slice("v", 2, F.size("v") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("i", "s"))
    return pairs.select(F.concat_ws(":", "way_id", "i").alias("road_id"), F.col("s.a.east").alias("ax"), F.col("s.a.north").alias("ay"), F.col("s.b.east").alias("bx"), F.col("s.b.north").alias("by_"))


def load_areas(polygons: DataFrame, tags: dict[str, list[str]] = PARK_TAGS, degrees: bool = False) -> DataFrame:
    """Polygons (properties map, vertices) of which any tag is in its list, with area_id for each part; holes stay, as rings from 1 on.

    `degrees` says that x and y are longitude and latitude; they are projected to the grid.
    Rings of fewer than three corners go. Rings that cross themselves need no repair, since
    areas and insides follow the even-odd rule (operators.rings). Places under bridges are
    taken off where coverage is measured (rings.coverage with roads).
    """
    match = reduce(lambda a, b: a | b, [F.coalesce(F.col("properties")[k].isin(v), F.lit(False)) for k, v in tags.items()])
    chosen = polygons.where(match)
    if degrees:
        chosen = with_grid(chosen, "y", "x").drop("x", "y").withColumnsRenamed({"east": "x", "north": "y"})
    sized = chosen.groupBy("feature", "part", "ring").agg(F.count("*").alias("n")).where("n > 3").select("feature", "part", "ring")
    return chosen.join(sized, ["feature", "part", "ring"], "left_semi").withColumn("area_id", F.concat_ws(":", "feature", "part"))


def read_weather(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Hourly weather from an ingested JSON-lines file (hour_bucket and the variables that it has), from start up to but without end."""
    raw = spark.read.schema("hour_bucket timestamp_ntz, " + ", ".join(f"{v} double" for v in VARIABLES)).json(path)
    if start is not None:
        raw = raw.where(F.col("hour_bucket") >= F.lit(start).cast("timestamp_ntz"))
    return raw if end is None else raw.where(F.col("hour_bucket") < F.lit(end).cast("timestamp_ntz"))


def easter(year: int) -> date:
    """Easter Sunday (the anonymous Gregorian rule)."""
    a, (b, c) = year % 19, divmod(year, 100)
    d, e = divmod(b, 4)
    g = (8 * b + 13) // 25
    h = (19 * a + b - d - g + 15) % 30
    i, k = divmod(c, 4)
    m = (a + 11 * h) // 319
    r = (2 * e + 2 * i - k - h + m + 32) % 7
    month = (h - m + r + 90) // 25
    return date(year, month, (h - m + r + month + 19) % 32)


def bank_holidays(years) -> list[tuple[str, str]]:
    """Public holidays of the United Kingdom as a whole (day, name): the days themselves, and substitutes for those on a weekend."""
    out = []
    for y in years:
        sunday = easter(y)
        first_monday = lambda m: date(y, m, 1) + timedelta((7 - date(y, m, 1).weekday()) % 7)  # noqa: B023, E731
        last_monday = lambda m: date(y, m, 31) - timedelta(date(y, m, 31).weekday())  # noqa: B023, E731
        days = [(date(y, 1, 1), "New Year's Day"), (sunday - timedelta(2), "Good Friday"), (sunday + timedelta(1), "Easter Monday"), (first_monday(5), "May Day"), (last_monday(5), "Spring Bank Holiday"), (last_monday(8), "Late Summer Bank Holiday"), (date(y, 12, 25), "Christmas Day"), (date(y, 12, 26), "Boxing Day")]
        taken = {d for d, _ in days}
        for d, name in list(days):
            if d.weekday() >= 5:
                free = d
                while free.weekday() >= 5 or free in taken:
                    free += timedelta(1)
                taken.add(free)
                days.append((free, f"{name} (substitute)"))
        out += days
    return [(d.isoformat(), name) for d, name in sorted(out)]


UK_HOLIDAYS = dict(bank_holidays(range(2025, 2028)))


def holidays(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(h, d) for d, h in sorted(UK_HOLIDAYS.items())], "holiday string, ds string").withColumn("ds", F.to_date("ds"))


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def checkpointed(df_of, spark: SparkSession, path: str) -> DataFrame:
    """The table at a path; if it isn't there, what df_of() gives is written first."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        write_parquet(df_of(), path)
    return spark.read.parquet(path)
