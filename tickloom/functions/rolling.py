"""Expressions over the trailing W rows of an ordered sequence.

All take a window from ``Sequence.derive`` and are null until W rows exist.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Ten digit counts share one 64-bit number, six bits each, so a window of up to
# 63 rows needs one rolling sum instead of ten.
BITS = 6
MAX_PACKED = 2 ** BITS - 1


def trailing(w: WindowSpec, rows: int) -> WindowSpec:
    return w.rowsBetween(-(rows - 1), 0)


def full(w: WindowSpec, rows: int) -> Column:
    """True once the window holds ``rows`` rows."""
    return F.row_number().over(w) >= rows


def rolling_std(value: Column, w: WindowSpec, rows: int) -> Column:
    """Sample deviation, null until all ``rows`` values are known."""
    frame = trailing(w, rows)
    return F.when(F.count(value).over(frame) == rows, F.stddev_samp(value).over(frame))


def running_count(condition: Column, w: WindowSpec) -> Column:
    return F.sum(F.coalesce(condition, F.lit(False)).cast("int")).over(
        w.rowsBetween(Window.unboundedPreceding, 0))


def count_in_last(running: Column, w: WindowSpec, rows: int) -> Column:
    """Rolling count as the difference of two running counts: constant work per row."""
    return F.when(full(w, rows), running - F.lag(running, rows, 0).over(w)).cast("int")


def packed_digits(digit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (digit * BITS).cast("int"))


def packed_counts(packed: Column, w: WindowSpec, rows: int, offset: int = 0) -> Column:
    """Counts of all digits over ``rows`` rows that end ``offset`` rows ago, packed."""
    if rows > MAX_PACKED:
        raise ValueError(f"at most {MAX_PACKED} rows")
    return F.when(full(w, rows + offset), F.sum(packed).over(w.rowsBetween(-(rows + offset - 1), -offset)))


def unpack(packed: Column, digit: int) -> Column:
    return F.shiftright(packed, BITS * digit).bitwiseAND(F.lit(MAX_PACKED)).cast("int")


def digit_counts(packed: Column) -> list[Column]:
    return [unpack(packed, d) for d in range(10)]


def _guard(packed: Column, value: Column) -> Column:
    return F.when(packed.isNotNull(), value)


def most_common(packed: Column) -> Column:
    """Digit with the largest count, the lowest of equals."""
    best = F.greatest(*[F.struct(c.alias("n"), F.lit(-d).alias("d")) for d, c in enumerate(digit_counts(packed))])
    return _guard(packed, -best["d"])


def least_common(packed: Column) -> Column:
    """Digit with the smallest count among those present, the lowest of equals."""
    worst = F.least(*[F.when(c > 0, F.struct(c.alias("n"), F.lit(d).alias("d")))
                      for d, c in enumerate(digit_counts(packed))])
    return _guard(packed, worst["d"])


def concentration(packed: Column, rows: int) -> Column:
    """Share of the most common digit."""
    return F.greatest(*digit_counts(packed)) / F.lit(float(rows))


def entropy(packed: Column, rows: int) -> Column:
    """Shannon entropy of the digits in bits."""
    total = F.lit(0.0)
    for c in digit_counts(packed):
        p = c / F.lit(float(rows))
        total = total - F.when(c > 0, p * F.log2(p)).otherwise(0.0)
    return _guard(packed, total)


def distribution_shift(newer: Column, older: Column, rows: int) -> Column:
    """L1 distance between the digit shares of two adjacent windows."""
    total = F.lit(0)
    for a, b in zip(digit_counts(newer), digit_counts(older)):
        total = total + F.abs(a - b)
    return _guard(older, total / F.lit(float(rows)))
