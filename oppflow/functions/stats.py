"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from oppflow.functions.text import as_col

Z95 = 1.96


def fixed_places(value, places: int) -> Column:
    """Round half up by flooring, the same way on every engine."""
    scale = float(10 ** places)
    return F.floor(as_col(value) * scale + 0.5).cast("double") / F.lit(scale)


def percent(part, whole) -> Column:
    """Whole-number percentage, 0 of nothing."""
    ratio = F.try_divide(as_col(part).cast("double"), as_col(whole).cast("double"))
    return F.coalesce(F.floor(ratio * 100 + 0.5), F.lit(0)).cast("bigint")


def rate(part, whole) -> Column:
    ratio = F.try_divide(as_col(part).cast("double"), as_col(whole).cast("double"))
    return F.coalesce(ratio, F.lit(0.0))


def wilson(k, n, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval of k out of n, clamped to [0, 1]; (0, 0) of nothing."""
    hits, size = as_col(k).cast("double"), as_col(n).cast("double")
    p = F.try_divide(hits, size)
    z2 = z * z
    width = 1 + F.try_divide(F.lit(z2), size)
    middle = p + F.try_divide(F.lit(z2 / 2), size)
    reach = z * F.sqrt(
        F.try_divide(p * (1 - p), size) + F.try_divide(F.lit(z2 / 4), size * size)
    )
    low, high = (middle - reach) / width, (middle + reach) / width
    some = size > 0
    return (
        F.when(some, F.greatest(F.lit(0.0), low)).otherwise(F.lit(0.0)),
        F.when(some, F.least(F.lit(1.0), high)).otherwise(F.lit(0.0)),
    )


def pearson(x, y) -> Column:
    """Correlation as an aggregate; 0 for fewer than two rows or a constant."""
    spread = F.stddev_pop(as_col(x)) * F.stddev_pop(as_col(y))
    return F.coalesce(F.try_divide(F.covar_pop(as_col(x), as_col(y)), spread), F.lit(0.0))
