import datetime as dt

import pytest

from cordon.operators import quotes as q

COLUMNS = "quote_id string, quote_creation_timestamp timestamp, pickup_latitude double, pickup_longitude double, dropoff_latitude double, dropoff_longitude double, quoted_price double, estimated_travel_time double, quote_converted boolean, l_linenumber int"
T0, T1 = dt.datetime(2026, 3, 1, 8), dt.datetime(2026, 3, 1, 9)
#: Degrees of latitude of 1000 m on the sphere.
KM = 1000 / 6_371_000 * 180 / 3.141592653589793


def frame(spark, *rows):
    base = dict(t=T0, la=51.5, lo=-0.1, dla=51.51, dlo=-0.12, price=10.0, ett=300.0, conv=False)
    out = []
    for n, (quote, over) in enumerate(rows):
        r = base | over
        out.append((quote, r["t"], r["la"], r["lo"], r["dla"], r["dlo"], r["price"], r["ett"], r["conv"], n))
    return spark.createDataFrame(out, COLUMNS)


def ids(df):
    return sorted({r.quote_id for r in df.collect()})


def test_conversion_flip_drops_the_session_and_nulls_dont_count(spark):
    df = frame(spark, ("a", {}), ("a", {"conv": True}), ("b", {}), ("c", {"conv": None}), ("c", {"conv": True}))
    assert ids(q.filter_inconsistent_conversion(df)) == ["b", "c"]


def test_box_includes_its_border_and_a_missing_coordinate_is_outside(spark):
    df = frame(spark, ("a", {"la": 51.260, "lo": 0.423}), ("b", {"la": 51.2599}), ("c", {"dlo": None}), ("c", {}), ("d", {}))
    assert ids(q.filter_outside(df)) == ["a", "d"]


def test_spread_is_of_the_pickup_and_over_the_limit(spark):
    df = frame(spark, ("at", {}), ("at", {"la": 51.5 + 0.9999 * KM}), ("over", {}), ("over", {"la": 51.5 + 1.001 * KM}), ("off", {"dla": 51.4}), ("off", {"dla": 51.6}), ("one", {}))
    assert ids(q.filter_location_spread(df)) == ["at", "off", "one"]


def test_travel_time_uses_the_first_known_value_of_a_call(spark):
    df = frame(
        spark, ("at", {}), ("at", {"t": T1, "ett": 1300.0}), ("over", {}), ("over", {"t": T1, "ett": 1300.1}),
        ("arms", {"ett": 300.0}), ("arms", {"ett": 9000.0}), ("null", {"ett": None}), ("null", {"ett": 2000.0}), ("null", {"t": T1, "ett": 100.0}),
    )
    assert ids(q.filter_ett_variation(df)) == ["arms", "at"]


def test_last_call_places_go_to_all_rows_and_ties_take_the_first_row(spark):
    df = frame(spark, ("a", {"la": 51.1}), ("a", {"t": T1, "la": 51.2}), ("a", {"t": T1, "la": 51.3}))
    assert {r.pickup_latitude for r in q.canonical_location(df).collect()} == {51.2}


def test_one_arm_of_the_last_call_is_drawn_and_stays_the_same(spark):
    df = frame(spark, ("a", {}), ("a", {"t": T1, "price": 12.0}), ("a", {"t": T1, "price": 14.0}), ("b", {"price": 5.0}))
    first = {r.quote_id: r.quoted_price for r in q.canonical_quotes(df).collect()}
    assert first["a"] in (12.0, 14.0) and first["b"] == 5.0
    assert first == {r.quote_id: r.quoted_price for r in q.canonical_quotes(df.repartition(5)).collect()}
    drawn = {q.canonical_quotes(df, seed=s).where("quote_id = 'a'").first().quoted_price for s in range(12)}
    assert drawn == {12.0, 14.0}


def test_calls(spark):
    df = frame(spark, ("a", {"price": 10.0}), ("a", {"price": 12.5}), ("a", {"t": T1, "price": 12.5}), ("a", {"t": T1, "price": 10.0}), ("a", {"t": dt.datetime(2026, 3, 1, 9, 0, 0, 500_000), "price": 9.0}))
    calls = sorted(q.call_table(df).collect(), key=lambda r: r.call_id)
    assert [r.prices for r in calls] == [[10.0, 12.5], [10.0, 12.5], [9.0]]
    assert [r.price_gaps for r in calls] == [[2.5], [2.5], []]
    assert [r.is_repeat_call for r in calls] == [False, True, False]
    assert [r.delta_ms_prev for r in calls] == [None, 3_600_000.0, 500.0]


def test_report_of_a_clean_and_a_mixed_table(spark):
    clean = q.consistency_report(frame(spark, ("a", {}), ("b", {}))).first()
    mixed = q.consistency_report(frame(spark, ("a", {}), ("a", {"la": 51.6}), ("b", {}), ("b", {"conv": True}))).first()
    assert clean.all_ok and clean.n_quotes == 2
    assert (mixed.n_mixed_pickup, mixed.n_mixed_conversion, mixed.n_mixed_dropoff, mixed.all_ok) == (1, 1, 0, False)


def test_one_exchange_by_session(spark, sf):
    from cordon.lens import view

    plan = q.flagged(view(spark, sf, "quotes_raw"))._jdf.queryExecution().executedPlan().toString()
    after_join = plan[: plan.index("Join")]
    assert after_join.count("Exchange hashpartitioning(quote_id") == 1 and "quote_creation_timestamp" not in "".join(x for x in after_join.splitlines() if "Exchange" in x)


def test_drop_counts_add_up(spark, sf):
    from cordon.lens import view

    df = view(spark, sf, "quotes_raw")
    r = q.drop_counts(df).first()
    assert sum(r) == df.select("quote_id").distinct().count() and r.kept == len(ids(q.clean(df)))


@pytest.mark.parametrize("values, want", [([1.0, 2.0, 3.0, 4.0], (4, 2.5, 1.75, 2.5, 3.25))])
def test_describe(spark, values, want):
    r = q.describe(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert (r.n, r["mean"], r.p25, r.p50, r.p75) == want


def test_quantiles_with_a_value_of_most_rows(spark):
    """Against sorting, with ties over both neighbours of a quantile, nulls, few rows and none."""
    import numpy as np

    shares = (0.0, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)
    for values in ([7.0] * 700 + [k * 0.5 for k in range(300)], [3.0, -1.0], [2.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 5, "v double")
        assert q.quantiles(df, "v", shares) == pytest.approx([float(np.quantile(values, s)) for s in shares], abs=1e-9)
    assert q.quantiles(spark.createDataFrame([(None,)], "v double"), "v", (0.5,)) == [None]
    r = q.describe(spark.createDataFrame([], "v double"), "v").first()
    assert r.n == 0 and r.p50 is None


def test_spread_by_bounds_and_by_pairs_is_the_same(spark):
    """Random sessions around the limit, against all pairs."""
    import math
    import random

    rng, rows, where = random.Random(3), [], {}
    for n in range(120):
        places = [(51.5 + rng.uniform(0, 1.3) * KM * rng.choice([0.2, 0.8, 1]), -0.1 + rng.uniform(0, 1.3) * KM) for _ in range(rng.randint(1, 6))]
        where[f"s{n:03}"] = places
        rows += [(f"s{n:03}", {"la": a, "lo": o}) for a, o in places]
    rows.append(("s000", {"la": None}))

    def metres(p, r):
        (a, b), (c, d) = (map(math.radians, x) for x in (p, r))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6_371_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    want = sorted(k for k, v in where.items() if max(metres(x, y) for x in v for y in v) <= 1000)
    assert ids(q.filter_location_spread(frame(spark, *rows))) == want and 20 < len(want) < 110


def test_a_session_of_ten_thousand_calls(spark):
    df = spark.range(10_000).selectExpr("'bot' as quote_id", "timestamp'2026-03-01 08:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) as quote_creation_timestamp", "51.5 + id * 1e-8 as pickup_latitude", "-0.1D as pickup_longitude", "51.5D as dropoff_latitude", "-0.1D as dropoff_longitude", "10D as quoted_price", "300D as estimated_travel_time", "false as quote_converted", "cast(id as int) as l_linenumber")
    assert q.clean(df).count() == 10_000
    assert q.clean(df.withColumn("pickup_latitude", df.pickup_latitude + df.l_linenumber * 1e-6)).count() == 0


def test_ranks_of_a_value_that_most_rows_share(spark):
    df = spark.range(5000).selectExpr("id as k", "case when id % 10 = 0 then id else 1 end as v").union(spark.createDataFrame([(9999, None)], "k long, v long"))
    got = [(r.k, r.cdf) for r in q.ecdf(df, "v", "k").collect()]
    order = sorted(range(5000), key=lambda i: (i if i % 10 == 0 else 1, i))
    assert dict(got) == {k: (n + 1) / 5000 for n, k in enumerate(order)}


def test_ties_of_quotes_without_an_ordinal_dont_depend_on_partitions(spark):
    rows = [("a", {"la": 51.4 + k * 1e-3, "price": 10.0}) for k in range(9)]
    df = frame(spark, *rows).drop("l_linenumber")
    first = {r.pickup_latitude for r in q.canonical_location(df).collect()}
    assert len(first) == 1 and first == {r.pickup_latitude for r in q.canonical_location(df.repartition(7)).collect()}
    numbered = df.withColumn("row_ordinal", -df.pickup_latitude)
    assert {r.pickup_latitude for r in q.canonical_location(numbered).collect()} == {51.408}
