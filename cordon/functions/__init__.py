"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money_sum(c: Column | str) -> Column:
    """Sum of amounts, exact whatever the order of rows: to four decimals."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,4)")).cast("double")


def rounded(c: Column, digits: int) -> Column:
    """Half up on the scaled value; unlike round() the same in other engines. Null stays null."""
    scale = 10.0**digits
    return F.floor(c * scale + 0.5) / scale


def clip_low(c: Column, low: float = 0.0) -> Column:
    """greatest(), but null stays null."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def clip_high(c: Column, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(c, F.lit(high)))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def percent_error(actual: Column, predicted: Column) -> Column:
    """100 |p - a| / a; null where the actual value is 0."""
    return F.abs(predicted - actual) / F.nullif(actual, F.lit(0.0)) * 100


def binned(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the bin (edge, next edge] that holds the value; null outside."""
    out = F.lit(None).cast("string")
    for low, high, label in zip(edges, edges[1:], labels):
        out = F.when((c > low) & (c <= high), label).otherwise(out)
    return out


def sorted_prices(price: Column) -> Column:
    """Distinct prices of a group in rising order (an aggregate)."""
    return F.array_sort(F.collect_set(price))


def gaps(values: Column, digits: int = 2) -> Column:
    """Differences of neighbours in an array, each rounded; empty for fewer than two values."""
    pairs = F.zip_with(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), lambda b, a: b - a)
    return F.transform(pairs, lambda x: rounded(x, digits))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def hour_label(hour: Column) -> Column:
    return F.format_string("%02d:00–%02d:00", hour, hour + 1)


def local_time(ts: Column, zone: str) -> Column:
    """Wall-clock time of a UTC timestamp in a named zone."""
    return F.from_utc_timestamp(ts.cast("timestamp"), zone)
