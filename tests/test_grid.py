from cordon.operators import models as m
from cordon.plans import model_queries as mq


def test_grid_and_tasks_of_the_registered_queries(spark, sf, monkeypatch):
    plain, seen = m.forecasts, []
    monkeypatch.setattr(m, "forecasts", lambda series, tasks, *a, **k: seen.append(tasks) or plain(series, tasks, *a, **k))
    pairs = {(c, s) for c in (0.001, 0.01, 0.05, 0.1, 0.5) for s in (1.0, 5.0, 10.0, 20.0)}
    for name in ("grid_search", "tuned_metrics", "production_forecast"):
        seen.clear()
        mq.QUERIES[name](spark, sf)
        assert {(r.cps, r.sps) for r in seen[0].collect()} == pairs
        assert name == "grid_search" or "h3_zone" in seen[-1].columns


def test_a_zone_is_fitted_with_its_own_parameters(spark, sf):
    zones = sorted(r.h3_zone for r in mq.full_series(spark, sf).select("h3_zone").distinct().collect())[:2]
    tasks = spark.createDataFrame([(zones[0], 21, "full_temp_vis", 0.5, 20.0), (zones[1], 21, "full_temp_vis", 0.01, 5.0)], "h3_zone long, h_days int, model string, cps double, sps double")
    got = {(r.h3_zone, r.cps, r.sps) for r in mq.forecast(spark, sf, tasks).select("h3_zone", "cps", "sps").distinct().collect()}
    assert got == {(zones[0], 0.5, 20.0), (zones[1], 0.01, 5.0)}
