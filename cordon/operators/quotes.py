"""Quote sessions: filters by session, canonical places, canonical rows, pricing calls.

A session is all rows of one quote_id: several calls (timestamps), each with one or more
price arms. Everything is per quote_id, so windows over quote_id share one exchange.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cordon.config import BBOX, MAX_ETT_DIFF_S, MAX_SPREAD_M, SEED
from cordon.functions import gaps, rounded, seconds_between, sorted_prices
from cordon.functions.geo import EARTH_RADIUS_M, max_spread_m
from cordon.shared import cut_lineage

TS = "quote_creation_timestamp"
PLACES = ("pickup_latitude", "pickup_longitude", "dropoff_latitude", "dropoff_longitude")
#: A column of this name, if there is one, numbers the rows of the input.
ORDINAL = "row_ordinal"
CANONICAL = ("quote_id", TS, *PLACES, "quoted_price", "estimated_travel_time", "quote_converted")


def session():
    """All rows of a quote."""
    return W.partitionBy("quote_id")


def row_order(df: DataFrame) -> list[str]:
    """What orders rows of a call, in place of the order of the input file: an ordinal (ORDINAL) if there is one, other
    columns than a quote's in their order, the price, and all else, so that only equal rows are left in no order."""
    can = [f.name for f in df.schema if f.name not in ("quote_id", TS) and not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    first = [c for c in can if c == ORDINAL] + [c for c in can if c != ORDINAL and c not in CANONICAL]
    return [*first, *(["quoted_price"] if "quoted_price" in can else []), *(c for c in can if c in CANONICAL and c != "quoted_price")]


def inside(lat: Column, lon: Column, bbox=BBOX) -> Column:
    """Bounds included; a missing coordinate is outside."""
    return F.coalesce(lat.between(bbox[1], bbox[3]) & lon.between(bbox[0], bbox[2]), F.lit(False))


def bad_conversion() -> Column:
    """Session predicate: converted on some rows and not on others; nulls don't count."""
    c = F.col("quote_converted").cast("int")
    return F.coalesce(F.min(c).over(session()) != F.max(c).over(session()), F.lit(False))


def bad_place(bbox=BBOX) -> Column:
    ok = inside(F.col(PLACES[0]), F.col(PLACES[1]), bbox) & inside(F.col(PLACES[2]), F.col(PLACES[3]), bbox)
    return ~F.bool_and(ok).over(session())


def with_bad_spread(df: DataFrame, name: str, limit_m: float = MAX_SPREAD_M) -> DataFrame:
    """Adds whether the pickup moved by more than the limit between any two rows of the session.

    Bounds from the session's extent decide nearly all sessions; only for others are pairs of
    distinct places compared, once a session.
    """
    known = F.col(PLACES[0]).isNotNull() & F.col(PLACES[1]).isNotNull()
    lat, lon = (F.when(known, F.radians(c)) for c in PLACES[:2])
    of = lambda f, c: f(c).over(session())
    dlat, dlon = of(F.max, lat) - of(F.min, lat), of(F.max, lon) - of(F.min, lon)
    half = lambda a: F.pow(F.sin(F.least(a, F.lit(3.141592653589793)) / 2), 2)
    narrow, wide = F.cos(of(F.max, F.abs(lat))), F.cos(of(F.min, F.abs(lat)))
    metres = lambda a: 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))
    least = metres(F.greatest(half(dlat), narrow * narrow * half(dlon)))
    most = metres(half(dlat) + wide * wide * half(dlon))
    point = F.when(known, F.struct(F.col(PLACES[0]).alias("lat"), F.col(PLACES[1]).alias("lon")))
    by_bounds = F.when(most < limit_m * (1 - 1e-9), False).when(least > limit_m * (1 + 1e-9), True)
    df = df.withColumns({"_bounds": F.when(most.isNull(), False).otherwise(by_bounds), "_first": F.row_number().over(session().orderBy(TS)) == 1, "_points": F.collect_set(point).over(session())})
    pairs = F.when(F.col("_first") & F.col("_bounds").isNull(), max_spread_m(F.col("_points")) > limit_m)
    return df.withColumn(name, F.coalesce("_bounds", F.max(pairs).over(session()), F.lit(False))).drop("_bounds", "_first", "_points")


def with_call_ett(df: DataFrame) -> DataFrame:
    """Adds call_ett: the first known travel time of each call."""
    order = [F.col(c).asc() for c in row_order(df)]
    return df.withColumn("call_ett", F.first("estimated_travel_time", True).over(W.partitionBy("quote_id", TS).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))


def bad_ett(limit_s: float = MAX_ETT_DIFF_S) -> Column:
    return F.coalesce(F.max("call_ett").over(session()) - F.min("call_ett").over(session()) > limit_s, F.lit(False))


def flagged(df: DataFrame, bbox=BBOX, spread_m: float = MAX_SPREAD_M, ett_s: float = MAX_ETT_DIFF_S) -> DataFrame:
    """Rows with f1 to f4: whether each filter drops their session. Dealt by quote_id once."""
    dealt = with_bad_spread(with_call_ett(df.repartition("quote_id")), "f3", spread_m)
    return dealt.select(*df.columns, bad_conversion().alias("f1"), bad_place(bbox).alias("f2"), "f3", bad_ett(ett_s).alias("f4"))


def filter_inconsistent_conversion(df: DataFrame) -> DataFrame:
    return df.withColumn("_bad", bad_conversion()).where("not _bad").drop("_bad")


def filter_outside(df: DataFrame, bbox=BBOX) -> DataFrame:
    return df.withColumn("_bad", bad_place(bbox)).where("not _bad").drop("_bad")


def filter_location_spread(df: DataFrame, limit_m: float = MAX_SPREAD_M) -> DataFrame:
    return with_bad_spread(df, "_bad", limit_m).where("not _bad").drop("_bad")


def filter_ett_variation(df: DataFrame, limit_s: float = MAX_ETT_DIFF_S) -> DataFrame:
    return with_call_ett(df.repartition("quote_id")).withColumn("_bad", bad_ett(limit_s)).where("not _bad").drop("_bad", "call_ett")


def clean(df: DataFrame, **limits) -> DataFrame:
    """All four filters. A session's rows stay or go together, so the order of filters has no influence on what stays."""
    return flagged(df, **limits).where("not (f1 or f2 or f3 or f4)").drop("f1", "f2", "f3", "f4")


def drop_counts(df: DataFrame, **limits) -> DataFrame:
    """Sessions that each filter drops when they run one after the other."""
    per = flagged(df, **limits).groupBy("quote_id").agg(*[F.max(f).alias(f) for f in ("f1", "f2", "f3", "f4")])
    return per.agg(
        F.count_if(F.expr("f1")).alias("dropped_f1"),
        F.count_if(F.expr("not f1 and f2")).alias("dropped_f2"),
        F.count_if(F.expr("not f1 and not f2 and f3")).alias("dropped_f3"),
        F.count_if(F.expr("not f1 and not f2 and not f3 and f4")).alias("dropped_f4"),
        F.count_if(F.expr("not (f1 or f2 or f3 or f4)")).alias("kept"),
    )


def filter_counts(df: DataFrame, bbox=BBOX) -> DataFrame:
    """Rows and sessions before and after the filters of conversion and place, one after the other."""
    one = df.withColumns({"f1": bad_conversion(), "f2": bad_place(bbox)}).groupBy("quote_id").agg(F.count("*").alias("n"), F.max("f1").alias("f1"), F.max("f2").alias("f2"))
    step = lambda name, before, after: one.agg(
        F.lit(name).alias("step"), *[F.sum(F.when(F.expr(c), F.col("n")).otherwise(0)).alias(f"rows_{k}") for k, c in (("before", before), ("after", after))], *[F.count_if(F.expr(c)).alias(f"quotes_{k}") for k, c in (("before", before), ("after", after))]
    )
    return step("conversion", "true", "not f1").unionByName(step("place", "not f1", "not f1 and not f2"))


def canonical_location(df: DataFrame) -> DataFrame:
    """Every row gets the places of its session's last call (of ties, of the first row)."""
    last = session().orderBy(F.col(TS).desc(), *row_order(df)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return df.withColumns({c: F.first(c).over(last) for c in PLACES})


def arm_key(seed: int) -> Column:
    """A hash that draws one arm of a call; equal for equal seeds, whatever the partitions."""
    return F.md5(F.concat_ws("|", F.col("quote_id").cast("string"), F.round(F.col("quoted_price") * 100).cast("bigint").cast("string"), F.lit(str(seed))))


def last_call(df: DataFrame) -> DataFrame:
    """All rows of each session's last call."""
    return df.withColumn("_last", F.max(TS).over(session())).where(F.col(TS) == F.col("_last")).drop("_last")


def one_arm(df: DataFrame, seed: int = SEED) -> DataFrame:
    order = [arm_key(seed), F.col("quoted_price"), *row_order(df)]
    return df.withColumn("_n", F.row_number().over(session().orderBy(*order))).where("_n = 1").drop("_n")


def canonical_quotes(df: DataFrame, seed: int = SEED) -> DataFrame:
    """One row a session: an arm, drawn by hash, of its last call."""
    return one_arm(last_call(df), seed).select(*CANONICAL)


RENAMED = {"pickup_latitude": "pickup_lat", "pickup_longitude": "pickup_lon", "dropoff_latitude": "dropoff_lat", "dropoff_longitude": "dropoff_lon", "quoted_price": "sampled_revenue"}


def to_trip_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(RENAMED).select("quote_id", "pickup_lat", "pickup_lon", "dropoff_lat", "dropoff_lon", "sampled_revenue", "estimated_travel_time")


def trip_dataset(df: DataFrame, seed: int = SEED) -> DataFrame:
    """Converted rows, last call of them, one arm, in the trips' columns."""
    return to_trip_columns(one_arm(last_call(df.where("quote_converted")), seed))


def canonical_trips(canonical: DataFrame) -> DataFrame:
    return to_trip_columns(canonical.where("quote_converted"))


def consistency_report(df: DataFrame) -> DataFrame:
    """One row: sessions, those with more than one conversion, pickup or dropoff value, and whether there are none."""
    per = df.groupBy("quote_id").agg(
        *[F.count_distinct(c).alias(c) for c in PLACES], F.count_distinct("quote_converted").alias("conv")
    )
    moved = " or ".join(f"{c} > 1" for c in PLACES[:2])
    moved_off = " or ".join(f"{c} > 1" for c in PLACES[2:])
    one = per.agg(F.count("*").alias("n_quotes"), F.count_if(F.expr("conv > 1")).alias("n_mixed_conversion"), F.count_if(F.expr(moved)).alias("n_mixed_pickup"), F.count_if(F.expr(moved_off)).alias("n_mixed_dropoff"))
    one = one.withColumns({"conversion_ok": F.expr("n_mixed_conversion = 0"), "pickup_location_ok": F.expr("n_mixed_pickup = 0"), "dropoff_location_ok": F.expr("n_mixed_dropoff = 0")})
    return one.withColumn("all_ok", F.expr("conversion_ok and pickup_location_ok and dropoff_location_ok"))


def affected_quotes(df: DataFrame) -> DataFrame:
    """How many sessions have more than one value of any coordinate."""
    per = df.groupBy("quote_id").agg(*[F.count_distinct(c).alias(c) for c in PLACES])
    return per.agg(F.count_if(F.expr(" or ".join(f"{c} > 1" for c in PLACES))).alias("n_affected"), F.count("*").alias("n_quotes"))


def call_table(df: DataFrame) -> DataFrame:
    """One row per pricing call: number, gap to the call before, first places, sorted prices and their gaps, whether prices repeat."""
    order = F.struct(*row_order(df))
    first = lambda c: F.min_by(c, order)
    calls = df.groupBy("quote_id", F.col(TS).alias("call_ts")).agg(
        first(PLACES[0]).alias("pickup_lat"), first(PLACES[1]).alias("pickup_lon"), first(PLACES[2]).alias("dropoff_lat"), first(PLACES[3]).alias("dropoff_lon"),
        first("estimated_travel_time").alias("time_travel_estimated"), sorted_prices(F.col("quoted_price")).alias("prices"), first("quote_converted").alias("quote_converted"),
    )
    w = session().orderBy("call_ts")
    return calls.withColumns({
        "call_id": F.row_number().over(w) - 1,
        "delta_ms_prev": rounded(seconds_between(F.col("call_ts"), F.lag("call_ts").over(w)) * 1000, 2),
        "price_gaps": gaps(F.col("prices")),
        "n_prices": F.size("prices"),
        "is_repeat_call": F.coalesce(F.col("prices") == F.lag("prices").over(w), F.lit(False)),
    })


def call_numbers(df: DataFrame) -> DataFrame:
    """Rows with call_num, the 0-based number of their call."""
    return df.withColumn("call_num", F.dense_rank().over(session().orderBy(TS)) - 1)


def rows_per_quote(df: DataFrame) -> DataFrame:
    """Sessions, those of one row, and shares of single and repeated ones in percent."""
    per = df.groupBy("quote_id").count()
    one = per.agg(F.count("*").alias("n_quotes"), F.count_if(F.expr("`count` = 1")).alias("n_single"))
    return one.withColumns({"pct_single": rounded(100 * F.col("n_single") / F.col("n_quotes"), 6), "pct_repeated": rounded(100 - 100 * F.col("n_single") / F.col("n_quotes"), 6)})


def price_gap_counts(calls: DataFrame) -> DataFrame:
    return calls.select(F.explode("price_gaps").alias("gap")).groupBy("gap").count().withColumnRenamed("count", "n")


def spread_summary(df: DataFrame, prefix: str = "pickup", far_m: float = 40_000.0) -> DataFrame:
    """How many sessions' places never move, and mean and median spread of those that move by less than `far_m`."""
    point = F.struct(F.col(f"{prefix}_latitude").alias("lat"), F.col(f"{prefix}_longitude").alias("lon"))
    per = df.groupBy("quote_id").agg(F.collect_set(point).alias("p")).select(max_spread_m(F.col("p")).alias("m"))
    per = cut_lineage(per)
    moving = F.when((F.col("m") > 0) & (F.col("m") < far_m), F.col("m"))
    (median,) = quantiles(per.select(moving.alias("m")), "m", (0.5,))
    return per.agg(F.count("*").alias("n_quotes"), F.count_if(F.expr("m = 0")).alias("n_static"), rounded(F.avg(moving), 4).alias("mean_m"), rounded(F.lit(median).cast("double"), 4).alias("median_m"))


def quantiles(df: DataFrame, column: str, shares: tuple[float, ...]) -> list[float | None]:
    """Exact quantiles, interpolated between neighbours; None of no values. Nulls don't count.

    Values are counted first, so that one held by most rows is a single row, then
    range-partitioned. Only the partitions that a quantile lies in are numbered through.
    """
    spark = df.sparkSession
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    dealt = counted.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "v")
    placed = cut_lineage(dealt.withColumn("part", F.spark_partition_id()))
    first, total = {}, 0
    for r in placed.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row a partition
        first[r["part"]] = (total, total + r["n"])
        total += r["n"]
    if not total:
        return [None] * len(shares)
    places = [(total - 1) * q for q in shares]
    wanted = sorted({k for p in places for k in (math.floor(p), math.ceil(p))})
    parts = [k for k, (low, high) in first.items() if any(low <= w < high for w in wanted)]
    upto = F.sum("n").over(W.partitionBy("part").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    ranked = placed.where(F.col("part").isin(parts)).withColumn("upto", upto)
    ranges = spark.createDataFrame([(k, first[k][0]) for k in parts], "part int, before long")
    near = ranked.join(F.broadcast(ranges), "part").select("v", (F.col("before") + F.col("upto") - F.col("n")).alias("low"), (F.col("before") + F.col("upto")).alias("high"))
    hits = near.where(reduce(or_, [(F.col("low") <= w) & (F.col("high") > w) for w in wanted])).collect()  # at most two a share
    at = {w: r["v"] for w in wanted for r in hits if r["low"] <= w < r["high"]}
    return [at[math.floor(p)] if p == math.floor(p) else (math.ceil(p) - p) * at[math.floor(p)] + (p - math.floor(p)) * at[math.ceil(p)] for p in places]


def describe(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    """count, mean, standard deviation and exact quantiles."""
    c = F.col(column)
    shares = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    found = zip(shares, quantiles(df, column, tuple(shares.values())))
    return df.agg(
        F.count(c).alias("n"), rounded(F.avg(c), digits).alias("mean"), rounded(F.stddev_samp(c), digits).alias("std"), F.min(c).alias("min"),
        *[rounded(F.lit(v).cast("double"), digits).alias(name) for name, v in found], F.max(c).alias("max"),
    )


def ecdf(df: DataFrame, column: str, key: str) -> DataFrame:
    """Empirical distribution: row number over count, in rising order of the value and then of `key`.

    Rows are range-partitioned by both, so that a value of most rows is no single task; a
    row's number is its place in its partition and the rows of the partitions before.
    """
    spark = df.sparkSession
    dealt = df.where(F.col(column).isNotNull()).select(key, column).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), column, key)
    placed = cut_lineage(dealt.sortWithinPartitions(column, key).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    before, total = [], 0
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row a partition
        before.append((r["part"], total))
        total += r["count"]
    before = spark.createDataFrame(before, "part long, before long")
    number = F.col("before") + F.col("at") - F.shiftleft("part", 33) + 1
    return placed.withColumn("part", part).join(F.broadcast(before), "part").select(key, column, (number / F.lit(max(total, 1))).alias("cdf"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins over [low, high]; values above are clipped to it."""
    width = (high - low) / bins
    value = F.least(F.col(column).cast("double"), F.lit(high))
    return df.where(value >= low).select(F.least(F.floor((value - low) / width), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
