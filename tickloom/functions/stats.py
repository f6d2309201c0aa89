"""Exact tests as column expressions on aggregated rows.

Every function works on one row of counts, so the cost does not depend on how
many source rows were counted.  The binomial mass is written as Stirling's
formula plus its error terms (after C. Loader, "Fast and Accurate Computation of
Binomial Probabilities", 2000), which stays accurate for very large n.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Longest sum taken term by term; beyond it the terms are integrated.
MAX_TERMS = 50_000
PANELS = 2_000

# Coefficients of the Stirling error series.
STIRLING = (1 / 12, 1 / 360, 1 / 1260, 1 / 1680)


def let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """Name intermediate values so that an expression uses them without repeating them."""
    named = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.transform(F.array(named), body)[0]


def _d(c: Column | float) -> Column:
    return (c if isinstance(c, Column) else F.lit(float(c))).cast("double")


def _span(first: Column, last: Column) -> Column:
    """first..last as an array, empty where first > last."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _stirling_error(n: Column) -> Column:
    """log n! minus Stirling's formula: exact for small n, a short series beyond."""
    small = F.array(*[F.lit(math.lgamma(i + 1) - (i + 0.5) * math.log(max(i, 1)) + i - 0.5 * math.log(2 * math.pi))
                      for i in range(16)])
    a, b, c, d = STIRLING
    return let({"n": n, "r": 1 / (n * n)},
               lambda s: F.when(s["n"] <= 15, small[s["n"].cast("int")])
               .otherwise((a - (b - (c - d * s["r"]) * s["r"]) * s["r"]) / s["n"]))


def binom_pmf(k: Column, n: Column, p: Column | float) -> Column:
    """P(X = k) for X ~ Bin(n, p), 0 < p < 1."""
    def body(s: Column) -> Column:
        away = s["k"] - s["n"] * s["p"]
        fit = (s["k"] * F.log1p(away / (s["n"] * s["p"]))
               + s["m"] * F.log1p(-away / (s["n"] * (1 - s["p"]))))
        shape = _stirling_error(s["n"]) - _stirling_error(s["k"]) - _stirling_error(s["m"])
        return (F.when((s["k"] < 0) | (s["m"] < 0), 0.0)
                .when(s["k"] == 0, F.exp(s["n"] * F.log1p(-s["p"])))
                .when(s["m"] == 0, F.exp(s["n"] * F.log(s["p"])))
                .otherwise(F.exp(shape - fit) * F.sqrt(s["n"] / (2 * math.pi * s["k"] * s["m"]))))
    return let({"k": _d(k), "n": _d(n), "m": _d(n) - _d(k), "p": _d(p)}, body)


def _upper(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) where k lies above the mean, so that the terms fall from k on."""
    def summed(s: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            term = acc["t"] * ((s["n"] - i + 1) / _d(i)) * (s["p"] / (1 - s["p"]))
            return F.struct(term.alias("t"), (acc["s"] + term).alias("s"))
        return F.aggregate(_span(s["k"] + 1, s["end"]), F.struct(s["first"].alias("t"), s["first"].alias("s")),
                           add, lambda acc: acc["s"])

    def integrated(s: Column) -> Column:
        # Sum of a smooth function: its integral (Simpson) plus half the first term.
        h = _d(s["end"] - s["k"]) / PANELS

        def add(acc: Column, i: Column) -> Column:
            weight = F.when((i == 0) | (i == PANELS), 1.0).otherwise(2.0 + 2.0 * (i % 2))
            return acc + weight * binom_pmf(s["k"] + h * i, s["n"], s["p"])
        return F.aggregate(F.sequence(F.lit(0), F.lit(PANELS)), F.lit(0.0), add) * h / 3 + s["first"] / 2

    end = F.least(n, k + F.ceil(14 * F.sqrt(_d(n) * p * (1 - p))).cast("bigint") + 80)
    return let({"k": k, "n": n, "p": p, "end": end, "first": binom_pmf(k, n, p)},
               lambda s: F.when((s["k"] < 0) | (s["k"] > s["n"]), 0.0)
               .when(s["end"] - s["k"] <= MAX_TERMS, summed(s)).otherwise(integrated(s)))


def binom_at_least(k: Column, n: Column, p: Column | float) -> Column:
    """P(X >= k): p-value of the one-sided exact test that hits are more frequent than p."""
    k, n, p = k.cast("bigint"), n.cast("bigint"), _d(p)
    # Below the mean the misses are summed instead.
    return let({"low": k <= n * p, "n": n,
                "k": F.when(k <= n * p, n - k + 1).otherwise(k),
                "p": F.when(k <= n * p, 1 - p).otherwise(p), "none": k <= 0},
               lambda s: let({"tail": _upper(s["k"], s["n"], s["p"]), "low": s["low"], "none": s["none"]},
                             lambda t: F.when(t["none"], 1.0).when(t["low"], 1 - t["tail"]).otherwise(t["tail"])))


def binom_at_most(k: Column, n: Column, p: Column | float) -> Column:
    """P(X <= k)."""
    n = n.cast("bigint")
    return binom_at_least(n - k.cast("bigint"), n, 1 - _d(p))


def binom_two_sided(k: Column, n: Column, p: Column | float) -> Column:
    """Total mass of the outcomes that are no more likely than k."""
    k, n, p = k.cast("bigint"), n.cast("bigint"), _d(p)

    def body(s: Column) -> Column:
        # Here k lies at or above the mean.  Below the mean the mass rises
        # steadily, so the last outcome as rare as k is found by halving.
        def halve(acc: Column, _: Column) -> Column:
            def pick(t: Column) -> Column:
                rare = binom_pmf(t["mid"], s["n"], s["p"]) <= s["mass"]
                return F.struct(F.when(rare, t["mid"]).otherwise(t["lo"]).alias("lo"),
                                F.when(rare, t["hi"]).otherwise(t["mid"]).alias("hi"))
            mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("bigint")
            return let({"lo": acc["lo"], "hi": acc["hi"], "mid": mid}, pick)
        rare_end = F.aggregate(F.sequence(F.lit(1), F.lit(64)),
                               F.struct(F.lit(-1).cast("bigint").alias("lo"),
                                        (F.floor(s["n"] * s["p"]) + 1).cast("bigint").alias("hi")),
                               halve, lambda acc: acc["lo"])
        return F.when(s["at_mean"], 1.0).otherwise(
            F.least(F.lit(1.0), _upper(s["k"], s["n"], s["p"]) + binom_at_most(rare_end, s["n"], s["p"])))

    below = k < n * p
    return let({"k": F.when(below, n - k).otherwise(k), "n": n, "p": F.when(below, 1 - p).otherwise(p),
                "at_mean": k == n * p, "mass": binom_pmf(k, n, p) * (1 + 1e-7)}, body)


def binom_p_value(k: Column, n: Column, p: Column | float, side: str = "greater") -> Column:
    tests = {"greater": binom_at_least, "less": binom_at_most, "two-sided": binom_two_sided}
    return tests[side](k, n, p)


def _bisect(k: Column, n: Column, goal: float) -> Column:
    """The p in (0, 1) at which P(X >= k) equals ``goal``."""
    def halve(acc: Column, _: Column) -> Column:
        def pick(s: Column) -> Column:
            below = binom_at_least(k, n, s["mid"]) < goal
            return F.struct(F.when(below, s["mid"]).otherwise(s["lo"]).alias("lo"),
                            F.when(below, s["hi"]).otherwise(s["mid"]).alias("hi"))
        return let({"lo": acc["lo"], "hi": acc["hi"], "mid": (acc["lo"] + acc["hi"]) / 2}, pick)
    return F.aggregate(F.sequence(F.lit(1), F.lit(50)),
                       F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), halve,
                       lambda acc: (acc["lo"] + acc["hi"]) / 2)


def binom_interval(k: Column, n: Column, confidence: float = 0.95, side: str = "greater") -> Column:
    """Exact interval for the hit probability: struct(low, high).

    For ``greater`` only the lower end is bounded, the upper end is 1.
    """
    alpha = (1 - confidence) / (2 if side == "two-sided" else 1)
    k, n = k.cast("bigint"), n.cast("bigint")
    low = F.lit(0.0) if side == "less" else F.when(k <= 0, 0.0).otherwise(_bisect(k, n, alpha))
    high = F.lit(1.0) if side == "greater" else F.when(k >= n, 1.0).otherwise(_bisect(k + 1, n, 1 - alpha))
    return F.struct(low.alias("low"), high.alias("high"))


def log_gamma(x: Column) -> Column:
    def body(s: Column) -> Column:
        shift = s["x"]
        for i in range(1, 8):
            shift = shift * (s["x"] + i)
        y = s["y"]
        series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
        return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(shift)
    return let({"x": _d(x), "y": _d(x) + 8}, body)


def chi_square_p_value(statistic: Column, dof: Column) -> Column:
    """P(chi-square with ``dof`` degrees of freedom >= statistic).

    Both expansions need about the square root of ``dof`` terms near the mean, so their lengths grow with it.
    """
    def series(s: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            term = acc["t"] * s["x"] / (s["a"] + i)
            return F.struct(term.alias("t"), (acc["s"] + term).alias("s"))
        lower = F.aggregate(F.sequence(F.lit(1), F.lit(600) + 12 * s["root"]), F.struct((1 / s["a"]).alias("t"), (1 / s["a"]).alias("s")),
                            add, lambda acc: acc["s"])
        return 1 - s["scale"] * lower

    def fraction(s: Column) -> Column:
        # Continued fraction of the upper tail, evaluated from the far end.
        def step(acc: Column, i: Column) -> Column:
            j = s["steps"] + 1 - i
            return s["x"] + (2 * j - 1) - s["a"] + 0.0 - j * (j - s["a"]) / acc
        start = s["x"] + 2 * s["steps"] + 1 - s["a"]
        value = F.aggregate(F.sequence(F.lit(1), s["steps"].cast("int")), start, step)
        return s["scale"] / value

    root = F.ceil(F.sqrt(F.greatest(_d(dof), F.lit(0.0)) / 2)).cast("int")
    return let({"a": _d(dof) / 2, "x": _d(statistic) / 2, "root": root, "steps": _d(400 + 12 * root),
                "scale": F.exp(-_d(statistic) / 2 + _d(dof) / 2 * F.log(_d(statistic) / 2) - log_gamma(_d(dof) / 2))},
               lambda s: F.when(s["a"] <= 0, 1.0).when(s["x"] <= 0, 1.0)
               .when(s["x"] < s["a"] + 1, series(s)).otherwise(fraction(s)))
