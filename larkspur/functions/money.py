"""Exact money: unscaled integers with a scale, divided half to even.

Amounts are decimal(38,0); an overflow of 38 digits raises under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = "decimal(38,0)"


def units(value) -> Column:
    """An unscaled amount, given as string or number, for computing."""
    return (F.col(value) if isinstance(value, str) else value).cast(UNITS)


def power_of_ten(n: int) -> Column:
    return F.lit("1" + "0" * n).cast(UNITS)


def ten_to(exponent: Column) -> Column:
    """10 to a column's exponent of 0 to 37, exactly."""
    return F.element_at(F.array(*[power_of_ten(i) for i in range(38)]), exponent.cast("int") + 1)


def half_even_div(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator to an integer, ties to the even neighbour; null for a denominator below 1.

    The quotient is taken of a multiple of the denominator, so it is exact and no second rounding of
    a rounded decimal can happen.
    """
    d = F.when(denominator > 0, denominator).cast(UNITS)
    size = F.abs(numerator).cast(UNITS)
    rest = (size % d).cast(UNITS)
    whole = ((size - rest) / d).cast(UNITS)
    twice = (rest * 2).cast(UNITS)
    up = (twice > d) | ((twice == d) & (whole % 2 == 1))
    rounded = whole + F.when(up, F.lit(1)).otherwise(F.lit(0)).cast(UNITS)
    return F.when(numerator < 0, -rounded).otherwise(rounded).cast(UNITS)


def half_even_long(numerator: Column, denominator: Column) -> Column:
    """half_even_div for values that fit longs: integer arithmetic inside generated code."""
    n, d = numerator.cast("long"), F.when(denominator > 0, denominator).cast("long")
    size = F.abs(n)
    rest = size % d
    whole = F.call_function("div", size - rest, d)
    up = (rest * 2 > d) | ((rest * 2 == d) & (whole % 2 == 1))
    rounded = whole + up.cast("long")
    return F.when(n < 0, -rounded).otherwise(rounded)


def convert(amount: Column, scale: int, rate: Column, rate_scale: int, target_scale: int) -> Column:
    """amount in the target currency and scale; the common power of ten is cancelled first."""
    down, up = scale + rate_scale, target_scale
    shared = min(down, up)
    down, up = down - shared, up - shared
    return half_even_div((units(amount) * units(rate) * power_of_ten(up)).cast(UNITS), power_of_ten(down))


def convert_scaled(amount: Column, scale: Column, rate: Column, rate_scale: int, target_scale: int) -> Column:
    """convert() for amounts whose scale is a column."""
    down = scale + F.lit(rate_scale)
    up = F.greatest(F.lit(target_scale) - down, F.lit(0))
    return half_even_div((units(amount) * units(rate) * ten_to(up)).cast(UNITS), ten_to(F.greatest(down - F.lit(target_scale), F.lit(0))))


def rescale(amount: Column, scale: int, target_scale: int) -> Column:
    """Exact to a larger scale, half to even to a smaller one."""
    if scale <= target_scale:
        return (units(amount) * power_of_ten(target_scale - scale)).cast(UNITS)
    return half_even_div(units(amount), power_of_ten(scale - target_scale))


def decimal_to_unscaled(text: Column, scale: int = 6) -> Column:
    """Unscaled integer string of a plain decimal string; null if malformed or finer than the scale."""
    t = F.trim(text)
    whole, fraction = F.regexp_extract(t, r"^([0-9]+)(?:\.([0-9]+))?$", 1), F.regexp_extract(t, r"^([0-9]+)(?:\.([0-9]+))?$", 2)
    joined = F.concat(whole, F.rpad(fraction, scale, "0") if scale else F.lit(""))
    return F.when(t.rlike(r"^[0-9]+(\.[0-9]+)?$") & (F.length(fraction) <= scale), F.regexp_replace(joined, r"^0+(?=[0-9])", ""))
