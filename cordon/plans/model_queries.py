"""Queries of searches and models: results that SQL cannot express, tested by their properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from cordon.config import MAX_ITERATIONS, SA_ITERATIONS
from cordon.lens import duck, view
from cordon.operators import models as m
from cordon.operators import optimise as op
from cordon.operators import polygonize as pg
from cordon.operators import revenue as rv
from cordon.operators import rings
from cordon.operators import series as sr
from cordon.plans import series_queries as sq
from cordon.plans import zone_queries as zq
from cordon.sources import files

HOURS = list(zq.HOURS)


def city(s, d):
    return op.City.collect(view(s, d, "blocks"), view(s, d, "adjacency"), zq.both(s, d))


def seed_list(s, d):
    """Separated local maxima, best first."""
    return [r["block_id"] for r in zq.seeds(s, d, zq.WHOLE_BOX).orderBy("seed_rank").collect()]


def multi_start(s, d, mode):
    return op.run_all(s, op.multi_start(s, seed_list(s, d), mode), city(s, d), SA_ITERATIONS if mode == "sa" else MAX_ITERATIONS)


def history(s, d):
    return op.run_all(s, op.multi_start(s, seed_list(s, d)), city(s, d), MAX_ITERATIONS, history=True)


def sa_grid(s, d):
    """All schedules from the seed of the best greedy run."""
    seed = op.best_run(multi_start(s, d, "greedy")).first()["seed_block"]
    return op.grid_pivot(op.run_all(s, op.schedule_grid(s, seed), city(s, d), SA_ITERATIONS))


def hourly_both(s, d):
    hourly = rv.hourly_lookups(zq.dated(s, d), hours=HOURS)
    there = hourly.select("hour", F.col("pickup_block").alias("block"), F.col("dropoff_block").alias("other"), "revenue")
    back = hourly.where("pickup_block <> dropoff_block").select("hour", F.col("dropoff_block").alias("block"), F.col("pickup_block").alias("other"), "revenue")
    return hourly, there.unionByName(back).groupBy("hour", "block", "other").agg(rv.money_sum("revenue").alias("revenue"))


def breathing(s, d):
    hourly, both = hourly_both(s, d)
    return op.breathe(s, view(s, d, "blocks"), view(s, d, "adjacency"), both, hourly, seed_list(s, d)[0], HOURS)


def breathing_static(s, d):
    """The hourly zones against one zone for all hours, annealed on the hours' revenue together."""
    hourly, _ = hourly_both(s, d)
    together = rv.block_lookup(hourly.groupBy("pickup_block", "dropoff_block").agg(rv.money_sum("revenue").alias("revenue")))
    fixed = op.run_all(s, op.multi_start(s, seed_list(s, d)[:1], "sa"), op.City.collect(view(s, d, "blocks"), view(s, d, "adjacency"), together), SA_ITERATIONS)
    static = fixed.select(F.explode("blocks").alias("block_id"))
    return rv.breathing_compare(static, breathing(s, d).select("hour", F.explode("blocks").alias("block_id")), hourly)


def sensitivity(s, d):
    """The schedule of the largest revenue."""
    seed = op.best_run(multi_start(s, d, "greedy")).first()["seed_block"]
    return op.best_run(op.run_all(s, op.schedule_grid(s, seed), city(s, d), SA_ITERATIONS)).select("t_start", "cooling", "revenue")


def full_series(s, d):
    return sr.prepare_series(sq.counts(s, d), sq.weather(s, d), sq.START, sq.END, m.VARIANTS["full"][2:])


def forecast(s, d, tasks, components=False):
    return m.forecasts(full_series(s, d), tasks, sq.TRAIN_END, sq.EVAL_START, sq.EVAL_END, files.UK_HOLIDAYS, components)


def one(s, model):
    return m.backtest_tasks(s, (21,), (model,))


def backtest(s, d):
    """MAPE of six models over two horizons, all zones."""
    return forecast(s, d, m.backtest_tasks(s)).groupBy("h3_zone", "h_days", "model").agg(sr.mape().alias("mape"))


def grid(s, d):
    """MAPE of each zone for all pairs of the grid."""
    return m.grid_scores(forecast(s, d, m.grid_tasks(s)))


def best_tasks(s, d, h_days):
    """A task a zone: the production model with the zone's best parameters."""
    best = sr.best_params(grid(s, d), (0.05, 10.0))
    return best.select("h3_zone", F.lit(h_days).alias("h_days"), F.lit("full_temp_vis").alias("model"), "cps", "sps")


def tuned(s, d):
    """Day metrics of each zone's forecast with its best parameters."""
    return sr.day_metrics(forecast(s, d, best_tasks(s, d, 21)), sq.EVAL_START[:10])


def production(s, d):
    """Forecast of the days after the data, with each zone's best parameters and historical conversion: the pipeline's last table."""
    history_ = full_series(s, d)
    future = sr.future_grid(history_, sq.weather(s, d), sq.FUTURE_START, sq.FUTURE_END, m.VARIANTS["full"][2:]).withColumn("y", F.lit(None).cast("double"))
    both = history_.unionByName(future.select(*history_.columns))
    f = m.forecasts(both, best_tasks(s, d, 0), sq.END, sq.FUTURE_START, sq.FUTURE_END, files.UK_HOLIDAYS)
    out = sr.apply_conversion(f, sr.historical_conversion(sq.counts(s, d), sq.FUTURE_START))
    return out.select(*sr.FORECAST).orderBy("h3_zone", "ds")


def road_polygons(s, d):
    return pg.block_table(pg.road_blocks(zq.roads(s, d)))


def overlay(s, d):
    boxes = zq.box_rings(s, d, "blocks", "block_id").withColumnRenamed("area_id", "block_id")
    return rings.overlaps(boxes, zq.box_rings(s, d, "parks", "park_id"))


QUERIES = {
    "greedy_multistart": lambda s, d: multi_start(s, d, "greedy"),
    "sa_multistart": lambda s, d: multi_start(s, d, "sa"),
    "mode_comparison": lambda s, d: op.compare_modes(multi_start(s, d, "greedy"), multi_start(s, d, "sa")),
    "search_history": history,
    "sa_grid": sa_grid,
    "breathing_transitions": breathing,
    "breathing_static": breathing_static,
    "sensitivity_best": sensitivity,
    "ols_forecast": lambda s, d: forecast(s, d, one(s, "ols")),
    "additive_forecast": lambda s, d: forecast(s, d, one(s, "full_temp_vis")),
    "forecast_components": lambda s, d: forecast(s, d, one(s, "lags"), components=True),
    "backtest": backtest,
    "grid_search": grid,
    "tuned_metrics": tuned,
    "tuned_summary": lambda s, d: sr.tuned_summary(sr.day_metrics(forecast(s, d, one(s, "full_temp_vis")), sq.EVAL_START[:10]), tuned(s, d)),
    "production_forecast": production,
    "road_polygons": road_polygons,
    "overlay_area": overlay,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {
        "road_polygons": duck("blocks", "select cast(row_number() over (order by x0, y0) - 1 as integer) as block_id, area_m2, (x0+x1)/2 as x, (y0+y1)/2 as y from blocks"),
        "overlay_area": duck("blocks parks", "select block_id, park_id as area_id, (least(b.x1,p.x1)-greatest(b.x0,p.x0))*(least(b.y1,p.y1)-greatest(b.y0,p.y0)) as overlap_m2 from blocks b join parks p on p.x0 < b.x1 and p.x1 > b.x0 and p.y0 < b.y1 and p.y1 > b.y0"),
    }
