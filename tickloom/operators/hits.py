"""How often an outcome follows a condition: grouped hit-rate tests.

A slicing is a grouping key.  Source rows are only counted (partial sums before
the shuffle); tests, bands and zero rows work on the small counted table.
"""

from __future__ import annotations

from collections.abc import Sequence as Seq
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.stats import binom_p_value
from tickloom.functions.price import flag

OBSERVATIONS, HITS = "observations", "correct"


def counted(df: DataFrame, hit: Column, by: Seq[str] = ()) -> DataFrame:
    """Rows and hits per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias(OBSERVATIONS),
        F.coalesce(F.sum(flag(hit).cast("bigint")), F.lit(0).cast("bigint")).alias(HITS))


def summed(counts: DataFrame, by: Seq[str] = ()) -> DataFrame:
    """Pool counted groups."""
    return counts.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c)
                                     for c in (OBSERVATIONS, HITS)])


@lru_cache(maxsize=None)
def _p_value(p0: float, side: str) -> Column:
    """The test as a column; it is large, so it is built once per process."""
    return binom_p_value(F.col(HITS), F.col(OBSERVATIONS), p0, side)


def scored(counts: DataFrame, p0: float, side: str = "greater", empty: str = "zero") -> DataFrame:
    """Add probability, difference to the baseline and the exact p-value.

    A group without rows gets (0, 0, p = 1), nulls, or is left out, as ``empty``
    is ``zero``, ``null`` or ``skip``.
    """
    n, k = F.col(OBSERVATIONS), F.col(HITS)
    if empty == "skip":
        counts = counts.where(n > 0)
    fill = F.lit(None).cast("double") if empty == "null" else F.lit(0.0)
    fill_p = F.lit(None).cast("double") if empty == "null" else F.lit(1.0)
    return counts.withColumns({
        "probability": F.when(n > 0, k / n).otherwise(fill),
        "difference": F.when(n > 0, k / n - p0).otherwise(fill),
        "p_value": F.when(n > 0, _p_value(p0, side)).otherwise(fill_p)})


def hit_test(df: DataFrame, hit: Column, p0: float, by: Seq[str] = (), side: str = "greater",
             empty: str = "zero") -> DataFrame:
    return scored(counted(df, hit, by), p0, side, empty)


def with_expected(tested: DataFrame, p0: float) -> DataFrame:
    """Expected hits under the baseline and the excess over them."""
    return tested.withColumns({"expected": F.col(OBSERVATIONS) * F.lit(p0),
                               "excess": F.col(HITS) - F.col(OBSERVATIONS) * F.lit(p0)})


def fill_groups(counts: DataFrame, key: str, values: Seq[int]) -> DataFrame:
    """Keep a zero row for every listed group; ``values`` is a short fixed list."""
    kind = counts.schema[key].dataType
    every = counts.sparkSession.createDataFrame([(v,) for v in values], "v int").select(F.col("v").cast(kind).alias(key))
    rest = [c for c in counts.columns if c != key]
    return every.join(counts, key, "left").select(
        key, *[F.coalesce(F.col(c), F.lit(0)).cast(counts.schema[c].dataType).alias(c) for c in rest])


def in_bands(counts: DataFrame, bands: dict[str, Column], name: str = "band") -> DataFrame:
    """Pool counted groups into named, possibly overlapping bands.

    Applied after counting, so a source row is never copied per band.
    """
    labels = F.array_compact(F.array(*[F.when(cond, F.lit(label)) for label, cond in bands.items()]))
    return summed(counts.withColumn(name, F.explode(labels)), [name])


def labelled(counts: DataFrame, name: str, value: str | Column) -> DataFrame:
    value = F.lit(value) if isinstance(value, str) else value
    return counts.select(value.cast("string").alias(name), OBSERVATIONS, HITS)


def union_rows(parts: Seq[DataFrame]) -> DataFrame:
    """One result frame from several kinds of groups."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# The bands of the previous digit and of the digit distance.
DIGIT_BANDS = {"0-2": (0, 2), "3-6": (3, 6), "7-9": (7, 9), "8-9": (8, 9)}
DISTANCE_BANDS = {"0-1": (0, 1), "2-3": (2, 3), "4-6": (4, 6)}


def between_bands(column: str, bands: dict[str, tuple[int, int]]) -> dict[str, Column]:
    return {label: F.col(column).between(lo, hi) for label, (lo, hi) in bands.items()}


def value_counts(df: DataFrame, column: str, values: Seq[int] | None = None, scale: float = 1.0,
                 baseline: float | None = None) -> DataFrame:
    """Count and share per value; with ``values`` those without rows are kept as zeros."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if values is not None:
        counts = fill_groups(counts, column, values)
    total = F.sum("n").over(Window.partitionBy())
    out = counts.withColumn("share", F.when(total > 0, F.col("n") / total * scale).otherwise(0.0))
    if baseline is not None:
        out = out.withColumn("difference", F.col("share") - baseline * scale)
    return out


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts and row shares of each pair of values, in long form."""
    counts = (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
              .groupBy(a, b).agg(F.count(F.lit(1)).alias("n")))
    return counts.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy(a)))


def crosstab_wide(df: DataFrame, a: str, b: str, values: Seq[int] = tuple(range(10)), share: bool = False) -> DataFrame:
    """One row per value of ``a`` and one column per value of ``b``."""
    wide = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a).pivot(b, list(values)).count()
    cells = {v: F.coalesce(F.col(f"`{v}`"), F.lit(0)) for v in values}
    total = sum((cells[v] for v in values[1:]), cells[values[0]])
    return wide.select(a, *[(c / total if share else c).alias(f"{b}_{v}") for v, c in cells.items()])


def best_class(table: DataFrame, a: str, b: str) -> DataFrame:
    """Most frequent ``b`` for each ``a`` of a cross-tab, the lowest of equals."""
    return table.groupBy(a).agg(
        F.max_by(b, F.struct(F.col("n"), -F.col(b))).alias("best"), F.max("n").alias("best_n"),
        F.sum("n").alias("n")).withColumn("best_share", F.col("best_n") / F.col("n"))


def mean_best_share(df: DataFrame, features: Seq[str], label: str) -> DataFrame:
    """For each feature: the unweighted mean over its values of the best class share, in sample.

    All features are counted in one pass over the rows.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
    counts = (df.where(F.col(label).isNotNull()).select(label, each.alias("f")).select(label, "f.feature", "f.value")
              .where(F.col("value").isNotNull()).groupBy("feature", "value", label).agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy("feature", "value").agg((F.max("n") / F.sum("n")).alias("share"))
    return best.groupBy("feature").agg(F.avg("share").alias("mean_best_share"), F.count(F.lit(1)).alias("feature_values"))


def summary(df: DataFrame, column: str) -> DataFrame:
    """Mean, minimum, maximum and exact median of a result column.

    Counts each value first, so a long column of few distinct values stays small.
    """
    c = F.col(column)
    per_value = df.where(c.isNotNull()).groupBy(c.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return per_value.agg(
        F.sum("n").alias("n"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("v").alias("minimum"), F.max("v").alias("maximum"),
        F.percentile("v", F.lit(0.5), F.col("n")).alias("median"))


def best_row(result: DataFrame, score: str, key: str) -> DataFrame:
    """Row with the largest score, the first key of equals."""
    return result.orderBy(F.col(score).desc_nulls_last(), F.col(key)).limit(1)


def significance_counts(tested: DataFrame, p0: float, level: float = 0.05) -> DataFrame:
    """How many tests lie above the baseline, are significant, or both."""
    above = F.col("probability") > p0
    significant = F.col("p_value") < level
    return tested.agg(
        F.count(F.lit(1)).alias("tests"), F.count_if(above).alias("above"),
        F.count_if(significant).alias("significant"), F.count_if(above & significant).alias("above_and_significant"),
        F.avg("probability").alias("mean_probability"), F.min("probability").alias("min_probability"),
        F.max("probability").alias("max_probability"))


def profile_conditions(df: DataFrame, conditions: dict[str, Column], label: str, values: Seq[int] = tuple(range(10)),
                       minimum: int = 100, p0: float = 0.1) -> DataFrame:
    """Shares of every outcome under each condition, its extremes and a test of the highest.

    All conditions are counted in one pass over the rows.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(
        *[F.count_if(cond).alias(name) for name, cond in conditions.items()])
    counts = fill_groups(counts, label, values)
    long = counts.select(label, F.explode(F.array(*[
        F.struct(F.lit(n).alias("condition"), F.col(f"`{n}`").alias("n")) for n in conditions])).alias("c")) \
        .select(label, "c.condition", "c.n")
    d = F.col(label)
    per = long.groupBy("condition").agg(
        F.sum("n").alias(OBSERVATIONS),
        F.max_by(d, F.struct(F.col("n"), -d)).alias("highest_digit"), F.max("n").alias(HITS),
        F.min_by(d, F.struct(F.col("n"), d)).alias("lowest_digit"), F.min("n").alias("lowest_count"),
        F.transform(F.array_sort(F.collect_list(F.struct(d.alias("d"), F.col("n").alias("n")))),
                    lambda s: s["n"]).alias("_counts"))
    tested = scored(per.where(F.col(OBSERVATIONS) >= minimum), p0)
    return tested.select(
        "condition", OBSERVATIONS, "highest_digit", HITS, "probability", "lowest_digit", "lowest_count",
        (F.col("lowest_count") / F.col(OBSERVATIONS)).alias("lowest_probability"), "p_value",
        *[F.col("_counts")[i].alias(f"n_{v}") for i, v in enumerate(values)])


def confidence_bands(df: DataFrame, confidence: Column, hit: Column,
                     edges: Seq[float] = (0.10, 0.11, 0.12, 0.13, 0.15, 1.0)) -> DataFrame:
    """Rows and accuracy by band [low, high) of the predicted probability."""
    band = F.lit(None).cast("string")
    for lo, hi in zip(edges, edges[1:]):
        band = F.when((confidence >= lo) & (confidence < hi), F.lit(f"[{lo:.2f},{hi:.2f})")).otherwise(band)
    return (df.withColumn("band", band).where(F.col("band").isNotNull()).groupBy("band")
            .agg(F.count(F.lit(1)).alias("n"), F.avg(flag(hit)).alias("accuracy")))
