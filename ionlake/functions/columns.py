"""Column helpers: NaN against NULL, guarded division, trapezoids over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
#: 1 / the normal quantile of 0.75: what a median absolute deviation is multiplied by.
MAD_SCALE = 1.482602218505602


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """Spark's aggregates skip NULL but not NaN."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def null_to_nan(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(NAN))


def divide(a: Column, b: Column) -> Column:
    """a / b with NULL where b is 0; plain division raises in ANSI mode."""
    return F.when(b != 0, a / b)


def ieee_divide(a: Column, b: Column) -> Column:
    """a / b as floating point has it: signed infinity over 0, NaN for 0 / 0."""
    inf = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(NAN))
    return F.when(b != 0, a / b).when(b == 0, inf)


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def array_trapezoid(x: Column, y: Column) -> Column:
    """Area under y over x by the trapezoid rule; 0 for fewer than two points."""
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - 1, F.lit(1))), lambda i: (F.get(x, i) - F.get(x, i - 1)) * (F.get(y, i) + F.get(y, i - 1)) / 2)
    return F.when(F.size(x) > 1, array_sum(steps)).otherwise(F.lit(0.0))


def array_dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def array_cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL where a norm is 0."""
    return divide(array_dot(a, b), F.sqrt(array_dot(a, a)) * F.sqrt(array_dot(b, b)))


def find_closest(values: Column, x: Column) -> Column:
    """Place (from 0) of the value of a sorted array nearest to x; of two equally near the right one."""
    dist = F.transform(values, lambda v: F.abs(v - x))
    best = F.array_min(dist)
    return F.size(values) - F.array_position(F.reverse(dist), best).cast("int")


def gauss(x: Column, mu: Column, sigma: Column, amp: Column) -> Column:
    z = (x - mu) / sigma
    return amp * F.exp(-0.5 * z * z)


def gaussian_mixture(x: Column, params: list[tuple[float, float, float]]) -> Column:
    """Sum of gaussians given as (mu, sigma, amp)."""
    total = F.lit(0.0)
    for mu, sigma, amp in params:
        total = total + gauss(x, F.lit(mu), F.lit(sigma), F.lit(amp))
    return total
