"""Blocks of rows or time, walk-forward evaluation and verdicts.

Blocks come from positions: a block is a grouping key, a training prefix is a
running total, and nothing is scanned once per block.
"""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.price import flag
from tickloom.operators.hits import HITS, OBSERVATIONS, scored
from tickloom.operators.sequence import Sequence


def signal_blocks(signals: Sequence, hit: Column, size: int, p0: float, time: str = "epoch") -> DataFrame:
    """Blocks of ``size`` signals in order; an incomplete last block is dropped."""
    rows = signals.with_columns({"_hit": hit}).number("_k").frame()
    block = (F.col("_k") / size).cast("bigint") + 1
    per = rows.groupBy(*signals.by, block.alias("block")).agg(
        F.min(time).alias("start_time"), F.max(time).alias("end_time"),
        F.count(F.lit(1)).alias(OBSERVATIONS), F.sum(flag(F.col("_hit")).cast("bigint")).alias(HITS))
    return scored(per.where(F.col(OBSERVATIONS) == size), p0)


def row_blocks(rows: Sequence, signal: Column, hit: Column, size: int, p0: float) -> DataFrame:
    """Blocks of ``size`` rows in order, the last one as long as it is; signals are tested inside each."""
    numbered = rows.with_columns({"_signal": signal, "_hit": hit}).number("_k").frame()
    block = (F.col("_k") / size).cast("bigint")
    on = flag(F.col("_signal"))
    per = numbered.groupBy(*rows.by, (block + 1).alias("block")).agg(
        F.min("_k").alias("start_row"), F.max("_k").alias("end_row"),
        F.sum(on.cast("bigint")).alias(OBSERVATIONS),
        F.sum((on * flag(F.col("_hit"))).cast("bigint")).alias(HITS))
    tested = scored(per, p0)
    return tested.withColumn("p_value", F.when(F.col(OBSERVATIONS) > 0, F.col("p_value")))


def time_windows(df: DataFrame, signal: Column, hit: Column, seconds: int, p0: float, time: str = "epoch") -> DataFrame:
    """Windows of fixed length counted from the first row; those without signals are left out."""
    first = df.agg(F.min(time)).first()[0]
    if first is None:
        first = 0
    number = F.floor((F.col(time) - F.lit(first)) / seconds).cast("bigint")
    on = flag(signal)
    per = df.groupBy(number.alias("window")).agg(
        F.min(time).alias("start_time"), F.max(time).alias("end_time"),
        F.sum(on.cast("bigint")).alias(OBSERVATIONS), F.sum((on * flag(hit)).cast("bigint")).alias(HITS))
    return scored(per, p0, empty="skip")


def walk_forward(signals: Sequence, hit: Column, train: int, test: int, p0: float, expanding: bool = True,
                 time: str = "epoch") -> DataFrame:
    """Test blocks after a training prefix that grows by each block, or stays frozen.

    The hits of the prefix are the running total before the first row of the block.
    """
    h = flag(hit).cast("bigint")
    rows = signals.with_columns({"_hit": h}).number("_k").store()
    rows = rows.running({"_so_far": (F.col("_hit"), "sum")})
    block = F.floor((F.col("_k") - train) / test).cast("bigint") + 1
    per = rows.frame().groupBy(*signals.by, F.greatest(block, F.lit(0)).alias("block")).agg(
        F.min(time).alias("start_time"), F.max(time).alias("end_time"),
        F.min("_k").alias("training_observations"), F.min(F.col("_so_far") - F.col("_hit")).alias("_before"),
        F.count(F.lit(1)).alias(OBSERVATIONS), F.sum("_hit").alias(HITS))
    if not expanding:
        # One row per key: the totals of block 0, the frozen training rows.
        frozen = per.where(F.col("block") == 0).select(
            *signals.by, F.col(OBSERVATIONS).alias("_n0"), F.col(HITS).alias("_k0"))
        per = per.join(frozen, list(signals.by)) if signals.by else per.join(F.broadcast(frozen), F.lit(True))
        per = per.withColumns({"training_observations": F.col("_n0"), "_before": F.col("_k0")}).drop("_n0", "_k0")
    tests = per.where((F.col("block") > 0) & (F.col(OBSERVATIONS) == test))
    return scored(tests.withColumn("training_probability", F.col("_before") / F.col("training_observations")), p0) \
        .drop("_before")


def checkpoints(signals: Sequence, hit: Column, p0: float,
                at: Seq[int] = (500, 1000, 1500, 2000, 2500, 3000)) -> DataFrame:
    """Hit rate over the first 500, 1000, ... signals; unreached checkpoints are flagged."""
    rows = signals.with_columns({"_hit": flag(hit).cast("bigint")}).number("_k").frame()
    one = rows.where(F.col("_k") < max(at)).agg(
        *[F.count_if(F.col("_k") < c).alias(f"n{c}") for c in at],
        *[F.coalesce(F.sum(F.when(F.col("_k") < c, F.col("_hit"))), F.lit(0).cast("bigint")).alias(f"k{c}") for c in at])
    table = F.explode(F.array(*[
        F.struct(F.lit(c).cast("bigint").alias("checkpoint"), (F.col(f"n{c}") == c).alias("reached"),
                 F.when(F.col(f"n{c}") == c, F.col(f"n{c}")).otherwise(0).alias(OBSERVATIONS),
                 F.when(F.col(f"n{c}") == c, F.col(f"k{c}")).otherwise(0).alias(HITS)) for c in at]))
    return scored(one.select(table.alias("r")).select("r.*"), p0, empty="null")


def progress(signals: DataFrame, target: int = 3000) -> DataFrame:
    """How far the collection of signals has come."""
    n = F.col("observed")
    return signals.agg(F.count(F.lit(1)).alias("observed")).select(
        "observed", F.lit(target).cast("bigint").alias("target"),
        F.greatest(F.lit(target) - n, F.lit(0)).cast("bigint").alias("remaining"),
        (n / target * 100).alias("percent"), (n >= target).alias("ready"))


def every_nth(signals: Sequence, hit: Column, step: int = 500) -> DataFrame:
    """Running count and hits, one row each ``step`` signals."""
    rows = signals.with_columns({"_hit": flag(hit).cast("bigint")}).number("_k").store()
    rows = rows.running({"correct_so_far": (F.col("_hit"), "sum")})
    n = F.col("_k") + 1
    return rows.frame().where(n % step == 0).select(
        *signals.by, n.alias("signals_so_far"), "correct_so_far", (F.col("correct_so_far") / n).alias("accuracy"))


def pooled(per_block: DataFrame, p0: float) -> DataFrame:
    """One test on the sum of all blocks."""
    total = per_block.agg(F.coalesce(F.sum(OBSERVATIONS), F.lit(0).cast("bigint")).alias(OBSERVATIONS),
                          F.coalesce(F.sum(HITS), F.lit(0).cast("bigint")).alias(HITS))
    return scored(total, p0, empty="null")


# Verdict rules as (name, least significant tests, least share above the baseline, mean must exceed it).
ROLLING_RULES = (("strong", 2, 0.6, True), ("partial", 0, 0.5, True))
ROW_BLOCK_RULES = (("strong", 2, 0.7, False), ("partial", 0, 0.5, False))
TIME_WINDOW_RULES = (("strong", 2, 0.5, False), ("partial", 0, 0.5, False))
GRID_RULES = (("robust", 3, 0.0, False), ("moderate", 0, 0.6, False))


def verdict(counts: DataFrame, rules: Seq[tuple[str, int, float, bool]], p0: float, otherwise: str = "none",
            significant_column: str = "significant") -> DataFrame:
    """Name the first rule that the counts of ``significance_counts`` meet."""
    out = F.lit(otherwise)
    for name, significant, above, mean in reversed(list(rules)):
        cond = ((F.col("tests") > 0) & (F.col(significant_column) >= significant)
                & (F.col("above") >= F.col("tests") * F.lit(above)))
        if mean:
            cond = cond & (F.col("mean_probability") > p0)
        out = F.when(cond, name).otherwise(out)
    return counts.withColumn("verdict", out)


def test_verdict(tested: DataFrame, p0: float, level: float = 0.05) -> DataFrame:
    """Per test: confirmed, only above the baseline, or not."""
    above = F.col("probability") > p0
    return tested.withColumn("verdict", F.when(above & (F.col("p_value") < level), "confirmed")
                             .when(above, "above baseline").otherwise("not confirmed"))


test_verdict.__test__ = False
