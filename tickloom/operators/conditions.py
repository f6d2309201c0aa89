"""Signals: which rows a hypothesis is about."""

from __future__ import annotations

import math
from collections.abc import Sequence as Seq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.hits import HITS, OBSERVATIONS, counted, scored

# Thresholds and targets of the published hypotheses.
LARGE_DROP = -0.1
LOW_VOLATILITY = 0.145358
ROUND_DISTANCE = 0.1
FAR_DISTANCE = 0.4
GRID_DELTAS = (-0.05, -0.075, -0.1, -0.125, -0.15, -0.2)
GRID_VOLATILITIES = (0.1, 0.12, 0.145358, 0.17, 0.2)

BINS = 4_096


@dataclass(frozen=True)
class Drop:
    """A large drop in a calm stretch: delta <= ``delta`` and volatility <= ``volatility``."""
    delta: float = LARGE_DROP
    volatility: float = LOW_VOLATILITY
    volatility_column: str = "vol10"

    def holds(self) -> Column:
        return (F.col("delta") <= self.delta) & (F.col(self.volatility_column) <= self.volatility)

    def after(self, digit: int) -> Column:
        """Only where the digit before was ``digit``."""
        return self.holds() & (F.col("previous_digit") == digit)


def calm_low_digit(volatility: float, column: str = "vol20", digits: Seq[int] = (0, 1)) -> Column:
    """Low volatility and a current digit of 0 or 1."""
    return (F.col(column) <= volatility) & F.col("digit").isin(list(digits))


def over(label: str = "next_digit", floor: int = 2) -> Column:
    """Outcome: the next digit is larger than ``floor``."""
    return F.col(label).isin(list(range(floor + 1, 10)))


def near_whole(limit: float = ROUND_DISTANCE) -> Column:
    return F.col("round_distance") <= limit


def _rank_bounds(q: float, n: int) -> tuple[int, int, float]:
    at = q * (n - 1)
    low = math.floor(at)
    return low, min(low + 1, n - 1), at - low


def _order_statistics(df: DataFrame, wanted: dict[str, tuple[Column, int, float, float]]) -> dict[str, float]:
    """For each name the value of (column, rank, lowest, highest) with ``rank`` values below it.

    Ranges are narrowed by counting: each pass is one aggregate for all names, with at most BINS groups a name, and
    keeps the bin that holds the rank, until a bin has one value. No values are gathered anywhere.
    """
    state = {name: (rank, lo, hi) for name, (_, rank, lo, hi) in wanted.items()}
    while open_ := {name: s for name, s in state.items() if s[1] < s[2]}:
        parts = []
        for name, (_, lo, hi) in open_.items():
            v = wanted[name][0].cast("double")
            # The division may round a value just under an edge into the next bin, alike for equal values.
            width = max(hi / BINS - lo / BINS, 5e-324)
            place = F.floor(F.least((v - F.lit(lo)) / F.lit(width), F.lit(BINS - 1.0))).cast("int")
            parts.append(F.struct(F.lit(name).alias("name"), F.when(v.between(lo, hi), place).alias("bin"), v.alias("v")))
        rows = (df.select(F.explode(F.array(*parts)).alias("p")).where("p.bin IS NOT NULL").groupBy("p.name", "p.bin")
                .agg(F.count(F.lit(1)).alias("n"), F.min("p.v").alias("lo"), F.max("p.v").alias("hi")).collect())
        for name, (rank, *_) in open_.items():
            for r in sorted((r for r in rows if r["name"] == name), key=lambda r: r["bin"]):
                if rank < r["n"]:
                    state[name] = (rank, r["lo"], r["hi"])
                    break
                rank -= r["n"]
    return {name: lo for name, (_, lo, _) in state.items()}


def quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]]) -> dict[str, float | None]:
    """Exact quantiles with linear interpolation, as numbers for later conditions; the same way at every size."""
    size = df.agg(*[f(c).alias(f"{name}_{kind}") for name, (c, _) in wanted.items()
                    for kind, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    ranks: dict[str, tuple[Column, int, float, float]] = {}
    shares: dict[str, float] = {}
    for name, (c, q) in wanted.items():
        if n := size[f"{name}_n"]:
            low, high, shares[name] = _rank_bounds(q, n)
            for end, rank in (("low", low), ("high", high)):
                ranks[f"{name} {end}"] = (c, rank, float(size[f"{name}_lo"]), float(size[f"{name}_hi"]))
    found = _order_statistics(df, ranks)
    out: dict[str, float | None] = dict.fromkeys(wanted)
    for name, share in shares.items():
        a, b = found[f"{name} low"], found[f"{name} high"]
        out[name] = a + (b - a) * share
    return out


def usual_thresholds(df: DataFrame, delta: float = 0.75, volatility: float = 0.5) -> dict[str, float | None]:
    """Large rise, large drop and low volatility of this very data."""
    return quantiles(df, {"rise": (F.col("delta"), delta), "drop": (F.col("delta"), 1 - delta),
                          "calm": (F.col("vol10"), volatility)})


def forward_hypotheses(t: dict[str, float]) -> dict[str, tuple[Column, int]]:
    """The three hypotheses with thresholds from the data; comparisons include the threshold."""
    calm = F.col("vol10") <= t["calm"]
    return {"H1 near whole": (near_whole(), 4),
            "H2 rise and calm": ((F.col("delta") >= t["rise"]) & calm, 9),
            "H3 drop and calm": ((F.col("delta") <= t["drop"]) & calm, 3)}


def frozen_hypotheses(t: dict[str, float]) -> dict[str, tuple[Column, int]]:
    """The same with thresholds learned elsewhere; delta comparisons are strict."""
    calm = F.col("vol10") <= t["calm"]
    return {"H1 near whole": (near_whole(), 4),
            "H2 rise and calm": ((F.col("delta") > t["rise"]) & calm, 9),
            "H3 drop and calm": ((F.col("delta") < t["drop"]) & calm, 3)}


def explored_thresholds(df: DataFrame) -> dict[str, float | None]:
    d, v = F.col("delta"), F.col("vol10")
    return quantiles(df, {"rise": (d, 0.75), "drop": (d, 0.25), "small": (F.abs(d), 0.25),
                          "calm": (v, 0.25), "wild": (v, 0.75)})


def explored_conditions(t: dict[str, float]) -> dict[str, Column]:
    """Eleven named conditions over delta, round distance, volatility and their pairs."""
    rise, drop = F.col("delta") > t["rise"], F.col("delta") < t["drop"]
    calm, wild = F.col("vol10") <= t["calm"], F.col("vol10") >= t["wild"]
    near = near_whole()
    return {
        "large rise": rise, "large drop": drop, "small step": F.abs("delta") < t["small"],
        "near whole": near, "far from whole": F.col("round_distance") >= FAR_DISTANCE,
        "calm": calm, "wild": wild,
        "large rise and calm": rise & calm, "large drop and calm": drop & calm,
        "near whole and calm": near & calm, "near whole and wild": near & wild}


def test_hypotheses(df: DataFrame, hypotheses: dict[str, tuple[Column, int]], p0: float = 0.1,
                    label: str = "next_digit") -> DataFrame:
    """Hit test of several overlapping hypotheses in one pass over the rows."""
    parts = []
    for name, (cond, target) in hypotheses.items():
        parts += [F.count_if(cond).alias(f"n {name}"), F.count_if(cond & (F.col(label) == target)).alias(f"k {name}")]
    one = df.agg(*parts)
    rows = F.explode(F.array(*[
        F.struct(F.lit(name).alias("hypothesis"), F.lit(target).alias("target_digit"),
                 F.col(f"`n {name}`").alias(OBSERVATIONS), F.col(f"`k {name}`").alias(HITS))
        for name, (_, target) in hypotheses.items()]))
    return scored(one.select(rows.alias("r")).select("r.*"), p0, empty="null")


test_hypotheses.__test__ = False


def threshold_grid(df: DataFrame, hit: Column, p0: float, deltas: Seq[float] = GRID_DELTAS,
                   volatilities: Seq[float] = GRID_VOLATILITIES, volatility: str = "vol10") -> DataFrame:
    """Hit test of every pair of thresholds.

    The cells overlap.  Rows are counted once by how many thresholds of each
    kind they meet; the overlapping cells are then summed from that small table.
    """
    d_desc, v_asc = sorted(deltas, reverse=True), sorted(volatilities)
    met_d = sum((F.when(F.col("delta") <= t, 1).otherwise(0) for t in d_desc), F.lit(0))
    met_v = sum((F.when(F.col(volatility) <= t, 1).otherwise(0) for t in v_asc), F.lit(0))
    counts = counted(df.select(met_d.alias("_d"), met_v.alias("_v"), hit.alias("_hit"))
                     .where((F.col("_d") > 0) & (F.col("_v") > 0)), F.col("_hit"), ["_d", "_v"])
    # The i-th weakest drop threshold is met by rows that meet at least i of them.
    cells = counts.select(F.explode(F.sequence(F.lit(1), F.col("_d"))).alias("i"), "_v", OBSERVATIONS, HITS) \
        .select("i", F.explode(F.sequence(F.lit(1), F.col("_v"))).alias("j"), OBSERVATIONS, HITS)
    grid = df.sparkSession.createDataFrame(
        [(i, j, d, v, 0, 0) for i, d in enumerate(d_desc, 1)
         for j, v in enumerate(reversed(v_asc), 1)],
        f"i int, j int, delta_threshold double, volatility_threshold double, {OBSERVATIONS} bigint, {HITS} bigint")
    totals = cells.groupBy("i", "j").agg(F.sum(OBSERVATIONS).alias("_n"), F.sum(HITS).alias("_k"))
    filled = grid.join(totals, ["i", "j"], "left").select(
        "delta_threshold", "volatility_threshold",
        F.coalesce("_n", OBSERVATIONS).alias(OBSERVATIONS), F.coalesce("_k", HITS).alias(HITS))
    return scored(filled, p0)
