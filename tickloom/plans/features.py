"""The four generations of sequence features.

Each function takes a ``Sequence`` of ticks (columns price, digit) and returns
it with the columns of that generation added.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions import price as P
from tickloom.functions import rolling as R
from tickloom.operators.sequence import Sequence

LAGS = {"previous_digit": 1, "digit_2_ago": 2, "digit_3_ago": 3, "digit_5_ago": 5, "digit_10_ago": 10}
PARITY_WINDOWS = (10, 25, 50, 100)
DIGIT_WINDOWS = (10, 25)


def lags(w: WindowSpec) -> dict[str, Column]:
    return {name: F.lag("digit", k).over(w) for name, k in LAGS.items()}


def next_digit(w: WindowSpec) -> dict[str, Column]:
    return {"next_digit": F.lead("digit", 1).over(w)}


def next_parity(w: WindowSpec) -> dict[str, Column]:
    return {"next_parity": P.parity(F.lead("digit", 1).over(w))}


def price_delta(w: WindowSpec) -> dict[str, Column]:
    return {"delta": F.col("price") - F.lag("price").over(w)}


def forward_delta(w: WindowSpec) -> dict[str, Column]:
    """Step to the next tick.  A condition on it sees the tick it predicts."""
    return {"delta": F.lead("price").over(w) - F.col("price")}


def volatility(*windows: int):
    """Stage: sample deviation of the last W deltas, for each W."""
    return lambda w: {f"vol{n}": R.rolling_std(F.col("delta"), w, n) for n in windows}


def live_volatility(prices: int = 20):
    """Stage: deviation of the deltas inside the last ``prices`` prices (one delta fewer)."""
    return lambda w: {"live_volatility": R.rolling_std(F.col("delta"), w, prices - 1)}


def signal_inputs(seq: Sequence, windows: tuple[int, ...] = (10,), forward: bool = False,
                  pos: str | None = None) -> Sequence:
    """What the conditions need: delta, volatility, previous and next digit."""
    return seq.derive(
        forward_delta if forward else price_delta, volatility(*windows),
        lambda w: {"previous_digit": F.lag("digit").over(w), **next_digit(w)},
        back=max(windows), fwd=1, pos=pos)


def usable(seq: Sequence, *names: str) -> Sequence:
    """Drop the warm-up rows and the rows without a label."""
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(n).isNotNull()
    return seq.where(cond)


def even_counts_before(w: WindowSpec) -> dict[str, Column]:
    """Even and odd counts of the rows before this one.

    The first row has no row before it, which counts as neither even nor odd.
    """
    even = F.col("_even_run")
    odd = F.col("_odd_run")
    out = {}
    for n in PARITY_WINDOWS:
        out[f"even_count_{n}"] = R.count_in_last(even, w, n)
        out[f"odd_count_{n}"] = R.count_in_last(odd, w, n)
    return out


def v1(seq: Sequence) -> Sequence:
    d = F.col("digit")
    out = seq.derive(
        lambda w: {**lags(w), **next_digit(w)},
        lambda w: {"parity": P.parity(d), "previous_parity": P.parity(F.col("previous_digit")),
                   "digit_change": d - F.col("previous_digit"), "next_parity": P.parity(F.col("next_digit"))},
        lambda w: {"_even_run": R.running_count(F.col("previous_parity") == 0, w),
                   "_odd_run": R.running_count(F.col("previous_parity") == 1, w)},
        even_counts_before,
        back=max(*PARITY_WINDOWS, *LAGS.values()) + 1, fwd=1)
    out = out.with_columns({f"even_percentage_{n}": F.col(f"even_count_{n}") / n * 100 for n in PARITY_WINDOWS})
    return out.without("_even_run", "_odd_run")


def packed_windows(w: WindowSpec) -> dict[str, Column]:
    packed = R.packed_digits(F.col("digit"))
    return {f"_packed_{n}": R.packed_counts(packed, w, n) for n in DIGIT_WINDOWS}


def v2(seq: Sequence) -> Sequence:
    d = F.col("digit")
    out = seq.derive(
        lambda w: {**lags(w), **next_digit(w), **packed_windows(w)},
        back=max(*DIGIT_WINDOWS, *LAGS.values()), fwd=1, pos="pos")
    out = out.with_columns({
        "digit_change": d - F.col("previous_digit"), "parity": P.parity(d),
        "previous_parity": P.parity(F.col("previous_digit")), "next_parity": P.parity(F.col("next_digit")),
        "digit_repeated": P.flag(d == F.col("previous_digit")),
        "digit_repeated_2_ago": P.flag(d == F.col("digit_2_ago")),
        **{f"digit_{k}_count_{n}": R.unpack(F.col(f"_packed_{n}"), k) for n in DIGIT_WINDOWS for k in range(10)}})
    out = out.with_columns({f"{name}_count_{n}": sum((F.col(f"digit_{k}_count_{n}") for k in range(start + 2, 10, 2)),
                                                      F.col(f"digit_{start}_count_{n}"))
                            for n in DIGIT_WINDOWS for start, name in enumerate(("even", "odd"))})
    out = out.with_columns({f"even_percentage_{n}": F.col(f"even_count_{n}") / n * 100 for n in DIGIT_WINDOWS})
    out = out.without(*[f"_packed_{n}" for n in DIGIT_WINDOWS])
    out = out.runs("digit", "pos", "_digit_start", "digit_streak").runs("parity", "pos", "_parity_start", "parity_streak")
    return out.without("_digit_start", "_parity_start")


DIGIT_STATISTICS = ("digit_concentration_10", "digit_entropy_10", "digit_entropy_25", "distribution_shift_10")


def digit_statistics(seq: Sequence, *more, back: int = 0, fwd: int = 0, pos: str | None = None) -> Sequence:
    """Most and least common digit, concentration, entropy and shift over the last 10 (and 25) rows.

    ``more`` are further stages for the same pass over the rows.
    """
    packed = R.packed_digits(F.col("digit"))
    out = seq.derive(
        packed_windows,
        lambda w: {"_newer": R.packed_counts(packed, w, 5), "_older": R.packed_counts(packed, w, 5, offset=5)},
        *more, back=max(*DIGIT_WINDOWS, back), fwd=fwd, pos=pos)
    out = out.with_columns({
        "most_common_digit_10": R.most_common(F.col("_packed_10")),
        "least_common_digit_10": R.least_common(F.col("_packed_10")),
        "digit_concentration_10": R.concentration(F.col("_packed_10"), 10),
        "digit_entropy_10": R.entropy(F.col("_packed_10"), 10),
        "digit_entropy_25": R.entropy(F.col("_packed_25"), 25),
        "distribution_shift_10": R.distribution_shift(F.col("_newer"), F.col("_older"), 5)})
    return out.without("_newer", "_older", *[f"_packed_{n}" for n in DIGIT_WINDOWS])


def even_flag(w: WindowSpec) -> dict[str, Column]:
    return {"even": P.flag(P.parity(F.col("digit")) == 0)}


def even_share(w: WindowSpec) -> dict[str, Column]:
    """Share of even digits over the last 10 and 25 rows, this row included."""
    return {f"even_percentage_{n}": R.count_in_last(F.col("_even_run"), w, n) / n for n in DIGIT_WINDOWS}


def v3(seq: Sequence) -> Sequence:
    d = F.col("digit")
    out = digit_statistics(
        seq, even_flag,
        lambda w: {"previous_digit": F.lag("digit").over(w), **next_digit(w),
                   "_even_run": R.running_count(F.col("even") == 1, w)},
        even_share, back=max(DIGIT_WINDOWS) + 1, fwd=1, pos="pos")
    out = out.with_columns({"digit_change": F.abs(d - F.col("previous_digit")),
                            "digit_repeated": P.flag(d == F.col("previous_digit")),
                            **{c: P.finite(F.col(c)) for c in DIGIT_STATISTICS}})
    return out.without("_even_run").runs("digit", "pos", "_start", "repeat_streak").without("_start")


V4_FEATURES = ("previous_price", "delta", "absolute_delta", "vol5", "vol10", "round_distance", "half_distance",
               "previous_digit")


def v4(seq: Sequence, pos: str | None = None) -> Sequence:
    p = F.col("price")
    out = seq.derive(
        lambda w: {"previous_price": F.lag("price").over(w), **price_delta(w),
                   "previous_digit": F.lag("digit").over(w), **next_digit(w)},
        volatility(5, 10), back=10, fwd=1, pos=pos)
    return out.with_columns({"absolute_delta": F.abs("delta"), "round_distance": P.round_distance(p),
                             "half_distance": P.half_distance(p)})
