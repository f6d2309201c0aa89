"""Chronological splits and predictors that take the most frequent outcome."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.price import flag
from tickloom.operators.sequence import Sequence
from tickloom.storage import stored

# The features and combinations that are compared.
SINGLE_FEATURES = ("previous_digit", "digit_change", "even_percentage_10", "even_percentage_25",
                   "even_percentage_50", "even_percentage_100")
COMBINATIONS = (
    ("previous_digit", "digit_change"),
    ("previous_digit", "even_percentage_25"),
    ("digit_change", "even_percentage_25"),
    ("digit_change", "even_percentage_50"),
    ("digit_change", "even_percentage_100"),
    ("previous_digit", "digit_change", "even_percentage_25"),
    ("previous_digit", "digit_change", "even_percentage_50"),
    ("digit_change", "even_percentage_25", "even_percentage_50"),
)


def chronological(seq: Sequence, share: float = 0.8, pos: str = "pos", mark: str = "is_train") -> Sequence:
    """Mark the first ``int(share * n)`` rows of each key as training rows.

    The position is counted after incomplete rows were dropped.
    """
    out = seq.number(pos, total="_total")
    out = out.with_columns({mark: F.col(pos) < F.floor(F.col("_total") * F.lit(share))})
    return out.without("_total")


def known(*names: str) -> Column:
    return functools.reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])


def chronological_sets(seq: Sequence, sets: dict[str, Seq[str]], label: str, share: float = 0.8) -> Sequence:
    """For each named feature set a column ``mark_<i>``: true for the first ``int(share * n)`` of the n rows that are
    whole for that set, false for its later ones, null for the others.

    All sets are numbered in one running pass, on a sequence without a key.
    """
    whole = {f"_use_{i}": flag(known(label, *features)) for i, features in enumerate(sets.values())}
    numbered = seq.with_columns(whole).running({f"_nth_{i}": (F.col(f"_use_{i}"), "sum") for i in range(len(sets))}).store()
    totals = numbered.frame().agg(*[F.sum(c) for c in whole]).first()
    marks = {f"mark_{i}": F.when(F.col(f"_use_{i}") == 1, F.col(f"_nth_{i}") <= math.floor((n or 0) * share))
             for i, n in enumerate(totals)}
    return numbered.with_columns(marks).without(*whole, *[f"_nth_{i}" for i in range(len(sets))])


BROADCAST_ROWS = 100_000
SALTS = 16


def mode_model(train: DataFrame, features: Seq[str], label: str) -> DataFrame:
    """Most frequent label for each combination of feature values, the lowest of equals."""
    counts = train.na.drop(subset=[*features, label]).groupBy(*features, label).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*features).agg(
        F.max_by(label, F.struct(F.col("_n"), -F.col(label))).alias("prediction"))


def predicted(test: DataFrame, model: DataFrame, features: Seq[str]) -> DataFrame:
    """Look the prediction up; rows whose values were never seen keep a null.

    A model of up to BROADCAST_ROWS rows, which is counted, goes to every task, so rows that share a few values are not
    gathered by them. A larger one has many values and is joined on them, with the test rows of
    each value dealt to SALTS places and the model copied to each.
    """
    small = stored(model.select(*features, "prediction"))
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return test.join(F.broadcast(small), list(features), "left")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = test.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in test.columns]), F.lit(SALTS)).cast("int"))
    return salted.join(small.withColumn("_salt", salts), [*features, "_salt"], "left").drop("_salt")


def mode_scores(df: DataFrame, sets: Seq[Seq[str]], label: str, mark: str = "is_train") -> DataFrame:
    """Accuracy on the test rows of the mode learned on the training rows, for each set of features.

    All sets are counted in one pass, training and test rows together per
    feature values and label, so no row is joined and a frequent value is no
    bottleneck.
    """
    width = max(len(s) for s in sets)
    keys = [f"_k{i}" for i in range(width)]

    def entry(features: Seq[str]) -> Column:
        values = [F.col(f).cast("double") for f in features] + [F.lit(0.0)] * (width - len(features))
        return F.struct(F.lit(" + ".join(features)).alias("features"), *[v.alias(k) for v, k in zip(values, keys)])
    rows = (df.where(F.col(label).isNotNull()).select(label, mark, F.explode(F.array(*[entry(s) for s in sets])).alias("e"))
            .select(label, mark, "e.*").na.drop(subset=keys))
    counts = rows.groupBy("features", *keys, label).agg(
        F.count_if(mark).alias("_train"), F.count_if(~F.col(mark)).alias("_test"))
    per = counts.groupBy("features", *keys).agg(
        F.max_by("_test", F.struct(F.col("_train"), -F.col(label))).alias("_hits"), F.sum("_test").alias("n"),
        F.max("_train").alias("_seen"))
    total = per.where(F.col("_seen") > 0).groupBy("features").agg(F.sum("n").alias("n"), F.sum("_hits").alias("correct"))
    return total.withColumn("accuracy", F.when(F.col("n") > 0, F.col("correct") / F.col("n")))


def in_sample_accuracy(df: DataFrame, feature: str, label: str) -> DataFrame:
    """Accuracy of the best class per feature value, scored on the rows it was learned from."""
    counts = (df.where(F.col(feature).isNotNull() & F.col(label).isNotNull())
              .groupBy(feature, label).agg(F.count(F.lit(1)).alias("n")))
    per = counts.groupBy(feature).agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    return per.agg(F.sum("best").alias("correct"), F.sum("n").alias("n")).select(
        F.lit(feature).alias("feature"), F.lit(label).alias("label"), "correct", "n",
        (F.col("correct") / F.col("n")).alias("accuracy"))
