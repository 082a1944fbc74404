import json

import pytest
from pyspark.sql import functions as F

from cordon import config
from cordon.operators import series as sr
from cordon.sources import files
from cordon.streaming import zone_counts


def test_quotes_csv(spark, tmp_path):
    p = tmp_path / "q.csv"
    head = "quote_id,quote_creation_timestamp,pickup_latitude,pickup_longitude,dropoff_latitude,dropoff_longitude,quoted_price,estimated_travel_time,quote_converted\n"
    p.write_text(head + "a,2026-03-01T08:00:00Z,51.5,-0.1,51.6,-0.2,10.5,NaN,true\nb,2026-03-01T08:00:00.123456+01:00,51.5,,51.6,-0.2,10.5,300,false\n")
    a, b = files.read_quotes_csv(spark, str(p)).orderBy("quote_id").collect()
    assert a.estimated_travel_time is None and a.quote_converted and b.pickup_longitude is None
    assert (b.quote_creation_timestamp.hour, b.quote_creation_timestamp.microsecond) in ((7, 123456),)
    p.write_text(head + "a,not a time,51.5,-0.1,51.6,-0.2,10.5,1,true\n")
    with pytest.raises(Exception):
        files.read_quotes_csv(spark, str(p)).collect()


def test_geojson_areas_and_sinks(spark, tmp_path):
    square = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]
    features = [
        {"type": "Feature", "properties": {"leisure": "park", "n": 1}, "geometry": {"type": "Polygon", "coordinates": [square]}},
        {"type": "Feature", "properties": {"landuse": "retail"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square, square]]}},
        {"type": "Feature", "properties": {"natural": "water"}, "geometry": {"type": "Point", "coordinates": [0, 0]}},
    ]
    p = tmp_path / "f.geojson"
    p.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    v = files.read_geojson(spark, str(p))
    assert v.count() == 20 and v.groupBy("feature", "part", "ring").count().count() == 4
    assert {r.area_id for r in files.load_areas(v, config.PARK_TAGS).collect()} == {"0:0"}
    assert files.load_areas(v, {"landuse": ["retail"]}).select("area_id").distinct().count() == 2
    out = v.select("feature", "x", "y")
    files.write_parquet(out, str(tmp_path / "p"))
    files.write_csv(out, str(tmp_path / "c"))
    assert files.read_parquet(spark, str(tmp_path / "p"), ["x"]).columns == ["x"] and spark.read.csv(str(tmp_path / "c"), header=True).count() == 20


def test_roads(spark):
    ways = spark.createDataFrame([(1, "primary", 0, -0.1, 51.5), (1, "primary", 1, -0.1, 51.51), (1, "primary", 2, 9.0, 51.52), (2, "footway", 0, -0.1, 51.5), (2, "footway", 1, -0.1, 51.6), (3, "primary", 0, 5.0, 40.0), (3, "primary", 1, 5.1, 40.0)], "way_id long, highway string, seq int, lon double, lat double")
    r = files.load_roads(ways).collect()
    assert sorted(x.road_id for x in r) == ["1:0", "1:1"] and min(abs(x.by_ - x.ay) for x in r if x.road_id == "1:0") == pytest.approx(1112, abs=5)


def test_weather_file_and_holidays(spark, tmp_path):
    p = tmp_path / "w.json"
    p.write_text("\n".join(json.dumps({"hour_bucket": f"2026-03-01T{h:02d}:00:00", "rain": 0.1 * h}) for h in range(5)))
    w = files.read_weather(spark, str(p), "2026-03-01 01:00:00", "2026-03-01 04:00:00")
    assert w.count() == 3 and w.where("visibility is not null").count() == 0
    assert files.holidays(spark).where("ds = date'2026-04-03'").first().holiday == "Good Friday"


def test_checkpoint_is_made_once(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert files.checkpointed(make, spark, str(tmp_path / "z")).count() == 3
    assert len(calls) == 1


def test_saved_forecast(spark, tmp_path):
    df = spark.createDataFrame([(2, 1.0, "x"), (1, 2.0, "y")], "h3_zone int, yhat double, other string").withColumn("ds", F.lit("2026-03-01 00:00:00").cast("timestamp_ntz"))
    assert sr.save_forecast(df, str(tmp_path / "f")).columns == ["ds", "h3_zone", "yhat"]


def test_streamed_counts_equal_counted_ones(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    events.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = zone_counts.drained(zone_counts.hourly_counts(stream, F.col("user_id") % 14, F.col("event_type") == "purchase"), str(tmp_path / "zone_counts"), str(tmp_path / "cp"))
    whole = sr.zone_counts(events, F.col("user_id") % 14, converted=F.col("event_type") == "purchase").withColumn("hour_bucket", F.col("hour_bucket").cast("timestamp"))
    last = events.agg(F.max("ts")).first()[0].replace(minute=0, second=0, microsecond=0)
    final = whole.where(F.col("hour_bucket") < F.lit(last) - F.expr("interval 1 hour")).select(*got.columns)
    assert final.exceptAll(got).count() == 0 and got.exceptAll(whole.select(*got.columns)).count() == 0
    s = zone_counts.drained(zone_counts.sessions(stream, "user_id"), str(tmp_path / "sessions"), str(tmp_path / "cp2"))
    assert 0 < s.agg(F.sum("calls")).first()[0] <= events.count()


def test_bank_holidays_and_substitutes():
    """Published dates of three years; a holiday on a weekend is listed with its substitute."""
    days = dict(files.bank_holidays(range(2025, 2028)))
    easters = {2025: "2025-04-18", 2026: "2026-04-03", 2027: "2027-03-26"}
    assert all(days[d] == "Good Friday" for d in easters.values())
    assert {d for d in days if d.startswith("2026-12")} == {"2026-12-25", "2026-12-26", "2026-12-28"}
    assert {d for d in days if d.startswith("2027-12")} == {"2027-12-25", "2027-12-26", "2027-12-27", "2027-12-28"}
    assert days["2027-12-27"] == "Christmas Day (substitute)" and days["2025-08-25"] == "Late Summer Bank Holiday" and len(days) == 27


def test_areas_keep_holes_and_are_projected(spark):
    ring = lambda r, pts: [(0, {"natural": "water"}, 0, r, k, x, y) for k, (x, y) in enumerate(pts)]
    rows = ring(0, [(-0.10, 51.50), (-0.09, 51.50), (-0.09, 51.51), (-0.10, 51.51), (-0.10, 51.50)]) + ring(1, [(-0.097, 51.502), (-0.094, 51.502), (-0.094, 51.505), (-0.097, 51.502)])
    v = spark.createDataFrame(rows, "feature int, properties map<string, string>, part int, ring int, seq int, x double, y double")
    got = files.load_areas(v, config.WATER_TAGS, degrees=True)
    assert {r.ring for r in got.collect()} == {0, 1} and got.agg({"x": "min"}).first()[0] > 500_000
    from cordon.operators import rings

    whole, holed = (rings.measures(x.drop("properties"), "area_id").first().area_m2 for x in (got.where("ring = 0"), got))
    assert 700_000 < holed < whole < 800_000
