"""Sums and averages of doubles that come out the same in whatever order their rows are added."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits of a score that are added as a decimal: 10 ahead of the point and 18 behind it; sums have ten more ahead.
EXACT = "decimal(28,18)"


def sum_parts(c: Column) -> dict[str, Column]:
    """Plain aggregates, so that each also works over a window, that ``total`` and ``average`` are made from.

    A double is added as the shortest decimal that it is written as (up to 18 places), so neither the partitioning nor the order shows in
    the sum. Values of 10^10 and more and non-finite ones have no such decimal and are added as doubles.
    """
    exact = c.cast("double").try_cast(EXACT)
    odd = F.when(exact.isNull(), c.cast("double"))
    return {"_exact": F.sum(exact), "_odd": F.sum(odd), "_count": F.count(c)}


def total(exact: Column, odd: Column) -> Column:
    """Sum as a double, rounded once; 0 without values."""
    return F.coalesce(exact.cast("double"), F.lit(0.0)) + F.coalesce(odd, F.lit(0.0))


def average(exact: Column, odd: Column, count: Column) -> Column:
    """The rounded sum divided once; null without values."""
    return F.when(count > 0, total(exact, odd) / count)


def exact_avg(c: Column) -> Column:
    """Average as an aggregate of a group."""
    parts = sum_parts(c)
    return average(parts["_exact"], parts["_odd"], parts["_count"])


def exact_sum(c: Column) -> Column:
    """Sum as an aggregate of a group, 0 without values."""
    parts = sum_parts(c)
    return total(parts["_exact"], parts["_odd"])
