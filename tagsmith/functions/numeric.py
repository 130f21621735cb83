"""Numeric column helpers. Every one is a built-in expression that stays in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def real(c: Column) -> Column:
    """NaN to NULL. Spark sorts NaN above every number, so `nan > 5` would be true."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def finite_or_null(c: Column) -> Column:
    """NaN and both infinities to NULL."""
    x = real(c)
    return F.when(F.abs(x) != F.lit(float("inf")), x)


def finite_or_zero(c: Column) -> Column:
    """NaN and both infinities to 0.0; NULL stays NULL."""
    x = c.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(x)


def round_to(c: Column, places: int = 2) -> Column:
    """Round half to even on the scaled binary value (as array libraries do)."""
    scale = float(10**places)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def parse_number(c: Column) -> Column:
    """Text to a finite double; anything unreadable is NULL, never an ANSI error."""
    return finite_or_null(c.try_cast("double"))


def or_default(c: Column, default: Column) -> Column:
    """`default` where the value is missing or zero."""
    x = real(c)
    return F.when(x.isNull() | (x == 0.0), default).otherwise(x)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL, not an ANSI error, on a zero denominator."""
    return numerator / F.nullif(denominator, F.lit(0.0))


def pct_change(new: Column, old: Column) -> Column:
    return ratio(new - old, old) * F.lit(100.0)


def price_grid(price: Column, steps: int, low: float, high: float) -> Column:
    """Array of `steps` evenly spaced prices from low*price to high*price.

    The arithmetic order (index * step + start, exact end point) matters: a cut such as
    `candidate > competitor` must not flip on the last bit.
    """
    start, stop = price * F.lit(low), price * F.lit(high)
    step = (stop - start) / F.lit(float(steps - 1))
    last = steps - 1
    return F.transform(
        F.sequence(F.lit(0), F.lit(last)),
        lambda k: F.when(k == last, stop).otherwise(k.cast("double") * step + start))


def exact_total(c: Column) -> Column:
    """Sum of money amounts that does not depend on row or partition order.

    Amounts are added as DECIMAL with twelve decimals, so retried or re-partitioned runs give the
    same total to the last digit. NaN, infinite and larger amounts than 1e26 count as null.
    """
    return F.try_sum(c.try_cast("decimal(38,12)")).cast("double")


def price_text(c: Column) -> Column:
    """A price of two decimals as text without an exponent: 12.5, 15000000.0."""
    rounded = round_to(c, 2)
    whole = F.regexp_replace(rounded.cast("decimal(38,2)").cast("string"), r"(\.\d)0$", "$1")
    return F.when(F.abs(rounded) < 1e7, rounded.cast("string")).otherwise(
        F.coalesce(whole, rounded.cast("string")))
