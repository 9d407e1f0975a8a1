"""Price, ratio and growth expressions.

Ratios are computed in double and rounded, money is summed in decimal, so results
do not depend on the order in which partitions arrive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def effective_price(discount: str = "discount_price", price: str = "price") -> Column:
    return F.coalesce(F.col(discount), F.col(price))


def rounded(value: Column, digits: int) -> Column:
    """Half up on the scaled double, so 1/8 and 5/1000 round alike in every engine."""
    scale = float(10**digits)
    return F.round(value * scale) / scale


def ratio(part: Column, whole: Column, digits: int = 2) -> Column:
    """part / whole, null when whole is zero or null."""
    return rounded(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def percent(part: Column, whole: Column, digits: int = 4) -> Column:
    """100 · part / whole, null when whole is zero or null."""
    return rounded(F.try_divide(part.cast("double") * 100, whole.cast("double")), digits)


def mean(value: Column, digits: int = 2) -> Column:
    """Average of the non-null values, rounded once."""
    return ratio(F.sum(value), F.count(value), digits)


def sum_if(condition: Column, value: Column) -> Column:
    """Conditional sum that is zero, not null, when nothing matches."""
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))


def growth(current: Column, previous: Column, digits: int = 4) -> Column:
    """Percent change; with nothing before, 100 if there is something now and 0 otherwise."""
    change = percent(current - previous, previous, digits)
    return F.when(previous > 0, change).otherwise(
        F.when(current > 0, F.lit(100.0)).otherwise(F.lit(0.0))
    )


def saving(discount: str = "discount_price", price: str = "price") -> Column:
    return F.col(price) - F.col(discount)


def saving_percent(discount: str = "discount_price", price: str = "price") -> Column:
    off = 1 - F.try_divide(F.col(discount).cast("double"), F.col(price).cast("double"))
    return F.round(off * 100).cast("int")
