"""Models find a planted signal; what is determined about them is checked by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tickloom.functions.stats import binom_interval
from tickloom.operators import hits as H
from tickloom.operators import learn as L
from tickloom.operators import models as M
from tickloom.operators.logistic import fit_sets, score_sets
from tickloom.operators.sequence import sequence

FEATURES = ("a", "b")


@pytest.fixture(scope="module")
def planted(spark):
    """Label 0 to 2 follows ``a`` nine times in ten; ``b`` is noise; ``even`` is drawn from a logistic law of both."""
    rng = random.Random(1)
    rows = []
    for k in range(900):
        a, b = rng.uniform(0, 3), rng.gauss(0, 1)
        label = int(a) if rng.random() < 0.9 else rng.randrange(3)
        even = int(rng.random() < 1 / (1 + math.exp(-(1.5 * (a - 1.5) - 0.7 * b))))
        rows.append((k, a, b, label, even, k < 700))
    return spark.createDataFrame(rows, "pos long, a double, b double, label int, even int, is_train boolean").cache()


def score(df, classifier, scaled=False, features=FEATURES):
    train, test = M.split(df)
    out = M.accuracy(M.fit(train, features, classifier, scaled).transform(test), "label").first()
    assert out.n == 200 and out.accuracy == out.correct / 200
    return out.accuracy


@pytest.mark.parametrize("scaled", [False, True])
def test_logistic(planted, scaled):
    assert score(planted, M.logistic("label", 700), scaled) > 0.75


@pytest.mark.parametrize("make", [lambda: M.tree("label", 5), lambda: M.tree("label", None),
                                  lambda: M.forest("label", 20, 5)])
def test_trees(planted, make):
    assert score(planted, make()) > 0.75


def test_scaler_uses_the_population_deviation(planted):
    train = planted.where("is_train")
    model = M.fit(train, FEATURES, M.tree("label", 1), scaled=True)
    got = np.array([r[0] for r in model.transform(train).select(vector_to_array("features")).collect()])
    assert np.allclose(got.mean(0), 0) and np.allclose(got.std(0), 1)


def test_binomial_coefficients_equal_newton(planted):
    train = planted.where("is_train")
    model = M.fit(train, FEATURES, M.logistic("even", 700, family="binomial"), scaled=True).stages[-1]
    rows = train.select("a", "b", "even").collect()
    x = np.array([(r.a, r.b) for r in rows])
    x = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0)])
    y, w, ridge = np.array([r.even for r in rows]), np.zeros(3), np.diag([0.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    assert np.allclose([model.intercept, *model.coefficients.toArray()], w, atol=1e-4)


def test_importance(planted):
    train = planted.where("is_train")
    by_weight = M.coefficient_importance(M.fit(train, FEATURES, M.logistic("label", 700), True), FEATURES)
    by_tree = M.tree_importance(M.fit(train, FEATURES, M.forest("label", 10, 4)), FEATURES)
    assert by_weight[0][0] == by_tree[0][0] == "a" and abs(sum(v for _, v in by_tree) - 1) < 1e-9


def test_probabilities_bands_and_significance(spark, planted):
    train, test = M.split(planted)
    out = M.with_confidence(M.fit(train, FEATURES, M.logistic("label", 700)).transform(test))
    for r in out.select("probabilities", "confidence").collect():
        assert abs(sum(r.probabilities) - 1) < 1e-9 and r.confidence == max(r.probabilities)
    bands = H.confidence_bands(out, F.col("confidence"), F.col("prediction") == F.col("label")).collect()
    assert bands
    told = M.significance(M.accuracy(out, "label"), 1 / 3).first()
    tail = sum(math.comb(200, k) * (1 / 3) ** k * (2 / 3) ** (200 - k) for k in range(told.correct, 201))
    ends = spark.range(1).select(binom_interval(F.lit(told.correct), F.lit(200)).alias("i")).first().i
    assert told.p_value == pytest.approx(tail, rel=1e-6) and (told.low, told.high) == (ends.low, ends.high)


def test_ablation_and_comparison(planted):
    found = M.ablation(planted, {"a": ("a",), "b": ("b",), "both": FEATURES}, "label", 1 / 3).collect()
    names = [r.model for r in found]
    assert names[-1] == "b" and [r.accuracy for r in found] == sorted((r.accuracy for r in found), reverse=True)
    assert all(r.difference == pytest.approx(r.accuracy - 1 / 3) and r.n == 200 for r in found)
    best = M.compare(planted, FEATURES, "label", 1 / 3, {"tree": (M.tree("label", 4), False),
                                                          "stump on noise": (M.tree("label", 0), False)}).first()
    assert best.model == "tree"


def test_shared_fits_equal_single_ones(planted):
    sets = {"a": ("a",), "both": FEATURES, "late": FEATURES}
    marks = {"a": F.col("is_train"), "both": F.col("is_train"), "late": F.col("is_train") & (F.col("pos") >= 300)}
    models = fit_sets(planted, sets, "label", marks)
    for name, features in sets.items():
        train = planted.where(marks[name])
        single = M.fit(train, features, M.logistic("label", train.count()), scaled=True)
        test = planted.where("NOT is_train")
        same = single.transform(test).select("pos", F.col("prediction").cast("int").alias("single"),
                                             models[name].prediction().alias("shared")).collect()
        assert [r.single for r in same] == [r.shared for r in same]
        scaler, fitted = single.stages[1], single.stages[-1]
        spread = np.array(scaler.std) / single.stages[2].getScalingVec().toArray()
        assert np.allclose(models[name].weights[:, :-1], fitted.coefficientMatrix.toArray() / spread, atol=1e-4)
    scores = {r.model: r for r in score_sets(planted, models, "label", dict.fromkeys(sets, ~F.col("is_train"))).collect()}
    assert {r.n for r in scores.values()} == {200} and scores["both"].accuracy == scores["both"].correct / 200


def test_shared_fits_of_odd_rows(spark, planted):
    marks = {"one class": F.col("is_train") & (F.col("label") == 2), "none": F.lit(False), "null marks": F.lit(None).cast(
        "boolean"), "constant": F.col("is_train")}
    odd = planted.withColumn("c", F.lit(4.0))
    models = fit_sets(odd, {**dict.fromkeys(marks, FEATURES), "constant": ("c",)}, "label", marks)
    assert models["one class"].classes == (2,) and models["none"].classes == models["null marks"].classes == ()
    assert np.all(models["constant"].weights[:, 0] == 0)
    got = odd.select(*[m.prediction().alias(k.replace(" ", "_")) for k, m in models.items()]).distinct().collect()
    counts = odd.where("is_train").groupBy("label").count().orderBy(F.desc("count")).first()
    assert [tuple(r) for r in got] == [(2, None, None, counts.label)]
    empty = M.ablation(planted.limit(0), {"a": ("a",)}, "label", 0.1).collect()
    assert [(r.n, r.correct, r.accuracy) for r in empty] == [(0, 0, None)]


@pytest.mark.parametrize("cut", [None, 40])
def test_sets_are_split_over_their_own_rows(spark, cut):
    rows = [(k, k % 7 if k >= 5 else None, k % 5 if k % 3 else None, k % 2 if k < 199 else None) for k in range(200)]
    seq = sequence(spark.createDataFrame(rows, "k long, f int, g int, y int"), ["k"], rows_per_segment=cut)
    sets = {"f": ("f",), "g": ("g",), "both": ("f", "g")}
    out = L.chronological_sets(seq, sets, "y").frame().orderBy("k").collect()
    for i, features in enumerate(sets.values()):
        whole = [r[0] for r in rows if None not in (r[3], *[r[{"f": 1, "g": 2}[f]] for f in features])]
        first = set(whole[:int(0.8 * len(whole))])
        assert [r[f"mark_{i}"] for r in out] == [(k in first) if k in whole else None for k in range(200)]
