"""Next-outcome models with Spark ML: fit on the training rows, score on the later ones."""

from __future__ import annotations

import math
from collections.abc import Sequence as Seq

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.price import flag
from tickloom.functions.stats import binom_interval, binom_p_value
from tickloom.operators.hits import union_rows
from tickloom.operators.logistic import fit_sets, score_sets

SEED = 42

# The feature sets that are compared.
COMPARED_FEATURES = ("previous_digit", "digit_2_ago", "digit_3_ago", "digit_5_ago", "digit_10_ago", "digit_change",
                     "even_percentage_10", "even_percentage_25", "even_percentage_50", "even_percentage_100")
V3_SETS = {
    "repeat_streak": ("repeat_streak",),
    "digit_repeated": ("digit_repeated",),
    "repeat_streak + digit_repeated": ("repeat_streak", "digit_repeated"),
    "repeat_streak + digit_repeated + entropy": ("repeat_streak", "digit_repeated", "digit_entropy_10"),
    "repeat_streak + digit_repeated + even": ("repeat_streak", "digit_repeated", "even_percentage_10"),
}
V4_SETS = {
    "delta + round_distance": ("delta", "round_distance"),
    "delta + half_distance": ("delta", "half_distance"),
    "delta + vol5": ("delta", "vol5"),
    "delta + vol10": ("delta", "vol10"),
    "round_distance + delta + vol5": ("round_distance", "delta", "vol5"),
    "round_distance + delta + vol10": ("round_distance", "delta", "vol10"),
    "all": ("delta", "absolute_delta", "vol5", "vol10", "round_distance", "half_distance", "previous_digit"),
}


def split(df: DataFrame, mark: str = "is_train") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(mark)), df.where(~F.col(mark))


def assembled(features: Seq[str], scaled: bool = False, rows: int = 0) -> list:
    """Assembler, and a scaler that is fitted on the training rows with them.

    Spark's scaler divides by the sample deviation; the factor for ``rows`` makes it that of the population.
    """
    if not scaled:
        return [VectorAssembler(inputCols=list(features), outputCol="features")]
    factor = math.sqrt(rows / (rows - 1)) if rows > 1 else 1.0
    return [VectorAssembler(inputCols=list(features), outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="sampled", withMean=True, withStd=True),
            ElementwiseProduct(inputCol="sampled", outputCol="features", scalingVec=Vectors.dense([factor] * len(features)))]


def logistic(label: str, rows: int, max_iter: int = 1000, family: str = "multinomial") -> LogisticRegression:
    """L2-regularised with the weight of one over all rows, as for C = 1."""
    return LogisticRegression(labelCol=label, featuresCol="features", family=family, maxIter=max_iter,
                              regParam=1.0 / max(rows, 1), elasticNetParam=0.0, standardization=False)


def tree(label: str, depth: int | None = 10) -> DecisionTreeClassifier:
    """``None`` is an unbounded tree; Spark grows to depth 30 at most."""
    return DecisionTreeClassifier(labelCol=label, maxDepth=30 if depth is None else depth, seed=SEED)


def forest(label: str, trees: int = 300, depth: int = 10) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt",
                                  seed=SEED, subsamplingRate=1.0)


def fit(train: DataFrame, features: Seq[str], classifier, scaled: bool = False) -> PipelineModel:
    rows = train.count() if scaled else 0
    return Pipeline(stages=[*assembled(features, scaled, rows), classifier]).fit(train)


def accuracy(predicted: DataFrame, label: str) -> DataFrame:
    """Hits, rows and accuracy of a prediction column."""
    return predicted.agg(
        F.count(F.lit(1)).alias("n"), F.sum(flag(F.col("prediction") == F.col(label)).cast("bigint")).alias("correct"),
        F.avg(flag(F.col("prediction") == F.col(label)).cast("double")).alias("accuracy"))


def named(scores: DataFrame, name: str, baseline: float) -> DataFrame:
    return scores.select(F.lit(name).alias("model"), "n", "correct", "accuracy",
                         (F.col("accuracy") - baseline).alias("difference"))


def significance(scores: DataFrame, p0: float) -> DataFrame:
    """Exact test and interval of a model's hits against chance."""
    k, n = F.col("correct"), F.col("n")
    ci = F.col("_ci")
    return (scores.withColumn("p_value", binom_p_value(k, n, p0)).withColumn("_ci", binom_interval(k, n))
            .withColumns({"low": ci["low"], "high": ci["high"]}).drop("_ci"))


def coefficient_importance(model: PipelineModel, features: Seq[str]) -> list[tuple[str, float]]:
    """Mean absolute coefficient over the classes; a table of classes by features, small by nature."""
    matrix = model.stages[-1].coefficientMatrix.toArray()
    return sorted(zip(features, abs(matrix).mean(axis=0).tolist()), key=lambda r: -r[1])


def tree_importance(model: PipelineModel, features: Seq[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist()), key=lambda r: -r[1])


def with_confidence(predicted: DataFrame) -> DataFrame:
    """Class probabilities as an array, and the largest of them."""
    return predicted.withColumn("probabilities", vector_to_array("probability")).withColumn(
        "confidence", F.array_max("probabilities"))


def ablation(df: DataFrame, sets: dict[str, Seq[str]], label: str, baseline: float, mark: str = "is_train",
             marks: dict[str, str] | None = None) -> DataFrame:
    """One scaled logistic model per feature set, all fitted and scored in shared passes over ``df``.

    ``marks`` names a column per set that is true for its training rows, false for its test rows and null for rows it
    does not use; without it all sets share ``mark``.
    """
    flags = {name: F.col((marks or {}).get(name, mark)) for name in sets}
    models = fit_sets(df, sets, label, flags)
    scores = score_sets(df, models, label, {name: ~flag_ for name, flag_ in flags.items()})
    return scores.select("model", "n", "correct", "accuracy", (F.col("accuracy") - baseline).alias(
        "difference")).orderBy(F.col("accuracy").desc(), "model")


def compare(df: DataFrame, features: Seq[str], label: str, baseline: float, classifiers: dict[str, tuple[object, bool]],
            mark: str = "is_train", extra: dict[str, DataFrame] | None = None) -> DataFrame:
    """Accuracy of several models on one split, best first.

    ``classifiers`` maps a name to (classifier, scaled); ``extra`` adds scored
    tables of models that are no Spark ML estimators.
    """
    train, test = split(df, mark)
    rows = [named(accuracy(fit(train, features, c, scaled).transform(test), label), name, baseline)
            for name, (c, scaled) in classifiers.items()]
    rows += [named(s, name, baseline) for name, s in (extra or {}).items()]
    return union_rows(rows).orderBy(F.col("accuracy").desc(), "model")
