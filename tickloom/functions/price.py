"""Column expressions on a single price or digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(price: Column) -> Column:
    return F.round(price * 100).cast("bigint")


def last_digit(price: Column) -> Column:
    """Last digit of the price written with two decimals."""
    return (F.abs(cents(price)) % 10).cast("int")


def parity(digit: Column) -> Column:
    """0 for even, 1 for odd."""
    return F.pmod(digit, F.lit(2)).cast("int")


def parity_name(digit: Column) -> Column:
    return F.when(parity(digit) == 0, "Even").when(parity(digit) == 1, "Odd")


def finite(c: Column) -> Column:
    """Null instead of an infinity."""
    return F.when(F.abs(c) != F.lit(float("inf")), c)


def known(c: Column) -> Column:
    """Null instead of NaN."""
    return F.nullif(c, F.lit(float("nan")))


def fraction(price: Column) -> Column:
    return price - F.floor(price)


def round_distance(price: Column) -> Column:
    """Distance to the nearest whole number."""
    return F.least(fraction(price), 1 - fraction(price))


def half_distance(price: Column) -> Column:
    """Distance of the fractional part to one half."""
    return F.abs(fraction(price) - 0.5)


def digit_distance(digit: Column, target: int) -> Column:
    return F.abs(digit - F.lit(target)).cast("int")


def flag(condition: Column) -> Column:
    """1 or 0; a comparison with null counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def zoned(epoch_seconds: Column, zone: str) -> Column:
    """Local wall-clock time of an epoch second, independent of the session zone."""
    utc = F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) \
        + F.make_dt_interval(secs=epoch_seconds.cast("decimal(18,6)"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def hour_of(epoch_seconds: Column, zone: str = "UTC") -> Column:
    return F.hour(zoned(epoch_seconds, zone)).cast("int")
