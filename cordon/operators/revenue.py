"""Revenue between blocks: lookups, zone revenue, marginal revenue, seeds.

Amounts are summed as decimals with four places, so that results don't depend on the order
of rows. Trips without a block at either end don't count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cordon.config import LOCAL_ZONE
from cordon.functions import hour_label, local_time, money_sum


def revenue_lookup(trips: DataFrame) -> DataFrame:
    """Revenue by (pickup_block, dropoff_block)."""
    return trips.na.drop(subset=["pickup_block", "dropoff_block"]).groupBy("pickup_block", "dropoff_block").agg(money_sum("sampled_revenue").alias("revenue"))


def block_lookup(lookup: DataFrame) -> DataFrame:
    """Revenue by (block, other) of both directions together; the diagonal counts once."""
    there = lookup.select(F.col("pickup_block").alias("block"), F.col("dropoff_block").alias("other"), "revenue")
    back = lookup.where("pickup_block <> dropoff_block").select(F.col("dropoff_block").alias("block"), F.col("pickup_block").alias("other"), "revenue")
    return there.unionByName(back).groupBy("block", "other").agg(money_sum("revenue").alias("revenue"))


def unilateral_revenue(blocks: DataFrame, both: DataFrame) -> DataFrame:
    """Revenue with any other end, for every block of the table."""
    own = both.groupBy(F.col("block").alias("block_id")).agg(money_sum("revenue").alias("revenue"))
    return blocks.select("block_id").join(own, "block_id", "left").na.fill(0.0, ["revenue"])


def zone_revenue(zone: DataFrame, lookup: DataFrame, ends: str = "both") -> DataFrame:
    """One row: revenue of trips that begin (and, for "both", end) in the zone (block_id)."""
    ids = zone.select("block_id").distinct()
    inside = lookup.join(ids, lookup["pickup_block"] == ids["block_id"], "left_semi")
    if ends == "both":
        inside = inside.join(ids, inside["dropoff_block"] == ids["block_id"], "left_semi")
    return inside.agg(F.coalesce(money_sum("revenue"), F.lit(0.0)).alias("revenue"))


def external_blocks(zone: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Neighbours of the zone that aren't in it."""
    ids = zone.select("block_id").distinct()
    return adjacency.join(ids, adjacency["src"] == ids["block_id"], "left_semi").select(F.col("dst").alias("block_id")).distinct().join(ids, "block_id", "left_anti")


def marginal_revenue(candidates: DataFrame, zone: DataFrame, both: DataFrame) -> DataFrame:
    """What each candidate (not in the zone) would add: its own trips and those with the zone. All candidates at once."""
    ids = zone.select(F.col("block_id").alias("zone_block")).distinct()
    pairs = both.join(candidates.select(F.col("block_id").alias("block")).distinct(), "block", "left_semi").join(ids, F.col("other") == F.col("zone_block"), "left")
    counts = F.col("zone_block").isNotNull() | (F.col("other") == F.col("block"))
    gain = pairs.groupBy(F.col("block").alias("block_id")).agg(money_sum(F.when(counts, F.col("revenue")).otherwise(0.0)).alias("delta"))
    return candidates.select("block_id").distinct().join(gain, "block_id", "left").na.fill(0.0, ["delta"])


def greedy_step(zone: DataFrame, adjacency: DataFrame, both: DataFrame, blocks: DataFrame, max_area_m2: float) -> DataFrame:
    """The block that a greedy expansion adds: the largest positive gain within the area cap, of ties the smallest id; no row if there is none."""
    area = blocks.join(zone.select("block_id").distinct(), "block_id", "left_semi").agg(F.coalesce(F.sum("area_m2"), F.lit(0.0)).alias("zone_area"))
    fits = external_blocks(zone, adjacency).join(blocks.select("block_id", "area_m2"), "block_id").join(F.broadcast(area)).where(F.col("zone_area") + F.col("area_m2") <= max_area_m2)
    return marginal_revenue(fits, zone, both).where("delta > 0").orderBy(F.desc("delta"), "block_id").limit(1)


def local_time_columns(trips: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """Adds the local date and hour of the quote's timestamp."""
    at = local_time(F.col("quote_creation_timestamp"), zone)
    return trips.withColumns({"local_date": F.to_date(at), "hour": F.hour(at)})


def dated_trips(trips: DataFrame, quotes: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """Trips with local date and hour of their quote's last call, found by quote_id; the timestamp goes."""
    stamps = quotes.groupBy("quote_id").agg(F.max("quote_creation_timestamp").alias("quote_creation_timestamp"))
    return local_time_columns(trips.join(stamps, "quote_id", "left"), zone).drop("quote_creation_timestamp")


def hourly_lookups(dated: DataFrame, date: str | None = None, hours: list[int] | None = None) -> DataFrame:
    """Revenue by (hour, pickup_block, dropoff_block): all hours in one pass."""
    if date is not None:
        dated = dated.where(F.col("local_date") == F.lit(date).cast("date"))
    if hours is not None:
        dated = dated.where(F.col("hour").isin(hours))
    return dated.na.drop(subset=["pickup_block", "dropoff_block"]).groupBy("hour", "pickup_block", "dropoff_block").agg(money_sum("sampled_revenue").alias("revenue"))


def cumulative_lookup(dated: DataFrame, date: str, hours: list[int]) -> DataFrame:
    return revenue_lookup(dated.where((F.col("local_date") == F.lit(date).cast("date")) & F.col("hour").isin(hours)))


def trips_per_hour(dated: DataFrame) -> DataFrame:
    return dated.groupBy("hour").agg(F.count("*").alias("trips")).withColumn("label", hour_label(F.col("hour")))


def capture_share(zone: DataFrame, lookup: DataFrame, ends: str = "both") -> DataFrame:
    """Zone revenue and its share of all revenue in percent."""
    total = lookup.agg(money_sum("revenue").alias("total"))
    return zone_revenue(zone, lookup, ends).join(F.broadcast(total)).withColumn("capture_pct", F.try_divide(100 * F.col("revenue"), F.col("total")))


def local_maxima(unilateral: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Blocks that no neighbour exceeds; ties, isolated blocks and plateaus without revenue qualify."""
    mine, theirs = unilateral.select("block_id", "revenue"), unilateral.select(F.col("block_id").alias("dst"), F.col("revenue").alias("other"))
    beaten = adjacency.join(theirs, "dst").join(mine.withColumnRenamed("block_id", "src"), "src").where("other > revenue").select(F.col("src").alias("block_id")).distinct()
    return mine.join(beaten, "block_id", "left_anti")


def seeds(maxima: DataFrame, adjacency: DataFrame, k: int, centers: DataFrame | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The k best maxima of which none lies within two steps of a better one, chosen in order of revenue, then id.

    With `centers` (block_id, cx, cy) and a box (x0, y0, x1, y1), only blocks whose centre is
    in the box. Choosing is sequential; maxima and the two-step neighbours among them are of
    city size, and are collected in that order.
    """
    spark = maxima.sparkSession
    if box is not None:
        middle = centers.where(F.col("cx").between(box[0], box[2]) & F.col("cy").between(box[1], box[3])).select("block_id")
        maxima = maxima.join(middle, "block_id", "left_semi")
    step = adjacency.select("src", "dst")
    two = step.union(step.join(step.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far"))).distinct()
    ids = maxima.select(F.col("block_id").alias("src"))
    near: dict = {}
    for r in two.join(ids, "src", "left_semi").join(maxima.select(F.col("block_id").alias("dst")), "dst", "left_semi").collect():
        near.setdefault(r["src"], set()).add(r["dst"])
    chosen, excluded = [], set()
    for r in maxima.orderBy(F.desc("revenue"), "block_id").collect():
        if len(chosen) < k and r["block_id"] not in excluded:
            chosen.append((len(chosen) + 1, r["block_id"], r["revenue"]))
            excluded |= near.get(r["block_id"], set())
    return spark.createDataFrame(chosen, maxima.select(F.lit(1).alias("seed_rank"), "block_id", "revenue").schema)


def top_blocks(unilateral: DataFrame, n: int = 5) -> DataFrame:
    return unilateral.orderBy(F.desc("revenue"), "block_id").limit(n)


def zone_diff(before: DataFrame, after: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each block's status between two zones: added, removed, unchanged or outside."""
    b, a = before.select("block_id", F.lit(1).alias("b")).distinct(), after.select("block_id", F.lit(1).alias("a")).distinct()
    status = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "unchanged").when(F.col("a").isNotNull(), "added").when(F.col("b").isNotNull(), "removed").otherwise("outside")
    return blocks.select("block_id").join(b, "block_id", "left").join(a, "block_id", "left").select("block_id", status.alias("status"))


def breathing_compare(static_zone: DataFrame, hourly_zones: DataFrame, hourly: DataFrame) -> DataFrame:
    """By hour: pickup revenue of the static zone and of the hour's zone (hour, block_id), difference and percent, and running totals."""
    fixed = static_zone.select(F.col("block_id").alias("pickup_block")).distinct()
    moving = hourly_zones.select("hour", F.col("block_id").alias("pickup_block")).distinct()
    static = hourly.join(fixed, "pickup_block", "left_semi").groupBy("hour").agg(money_sum("revenue").alias("static_revenue"))
    dynamic = hourly.join(moving, ["hour", "pickup_block"], "left_semi").groupBy("hour").agg(money_sum("revenue").alias("dynamic_revenue"))
    hours = hourly.select("hour").distinct().join(static, "hour", "left").join(dynamic, "hour", "left").na.fill(0.0)
    run = W.orderBy("hour").rowsBetween(W.unboundedPreceding, 0)
    return hours.withColumns({
        "delta": F.col("dynamic_revenue") - F.col("static_revenue"),
        "delta_pct": F.try_divide(100 * (F.col("dynamic_revenue") - F.col("static_revenue")), F.col("static_revenue")),
        "static_total": F.sum(F.col("static_revenue").cast("decimal(18,4)")).over(run).cast("double"),
        "dynamic_total": F.sum(F.col("dynamic_revenue").cast("decimal(18,4)")).over(run).cast("double"),
    })
