"""Predictors and models."""

from pyspark.sql import functions as F

from tickloom.functions import price as P
from tickloom.operators import learn as L
from tickloom.operators import models as M
from tickloom.operators import hits as H
from tickloom.operators.ensembles import Growth, grow_ensemble
from tickloom.operators.neighbours import nearest_score, nearest_vote
from tickloom.plans import features as X
from tickloom.storage import stored
from workload.base import TICK_SQL, ordered, query, r6, tick_cte

WITH_T = f"WITH {TICK_SQL}"
LABEL = "next_digit"

V1_SQL = tick_cte(None, more=", lag(digit, 2) OVER w AS digit_2_ago, lag(digit, 3) OVER w AS digit_3_ago, lag(digit, 5) OVER w AS digit_5_ago, "
                  "lag(digit, 10) OVER w AS digit_10_ago") + """,
e AS (SELECT *, digit - previous_digit AS digit_change, """ + ", ".join(
    f"CASE WHEN row >= {n - 1} THEN CAST(sum(CAST(coalesce(previous_digit % 2 = 0, false) AS INTEGER)) OVER (ORDER BY time, tie ROWS {n - 1} PRECEDING) AS INTEGER) END AS even_count_{n}"
    for n in X.PARITY_WINDOWS) + " FROM f), p AS (SELECT *, " + ", ".join(
    f"even_count_{n} / {n} * 100 AS even_percentage_{n}" for n in X.PARITY_WINDOWS) + " FROM e)"


def v1_split_sql(need=""):
    known = "".join(f" AND {c} IS NOT NULL" for c in need.split()) if need else ""
    return V1_SQL + f""",
n AS (SELECT *, row_number() OVER (ORDER BY time, tie) - 1 AS pos, count(*) OVER () AS total FROM p WHERE next_digit IS NOT NULL{known}),
x AS (SELECT *, pos < floor(total * 0.8) AS is_train FROM n)"""


def v1_split(spark, d, *need):
    """First-generation features of the global sequence, split by time."""
    seq = X.usable(X.v1(ordered(spark, d, None)), LABEL, *need)
    return L.chronological(seq)


def mode_score_sql(sets, cte):
    parts = []
    for f in sets:
        keys = ", ".join(f)
        known = " AND ".join(f"{k} IS NOT NULL" for k in f)
        parts.append(f"""SELECT '{' + '.join(f)}' AS features, count(*) AS n, CAST(sum(CAST(x.next_digit = m.prediction AS INTEGER)) AS BIGINT) AS correct,
  {r6('avg(CAST(x.next_digit = m.prediction AS INTEGER))', 'accuracy')} FROM x JOIN
  (SELECT {keys}, arg_max(next_digit, n * 100 - next_digit) AS prediction FROM (SELECT {keys}, next_digit, count(*) AS n FROM x WHERE is_train AND {known} GROUP BY ALL) GROUP BY ALL) m
  USING ({keys}) WHERE NOT is_train""")
    return cte + " " + " UNION ALL ".join(parts)


@query("m01_mode_predictor", mode_score_sql([(f,) for f in L.SINGLE_FEATURES], v1_split_sql()))
def _(spark, d):
    return L.mode_scores(v1_split(spark, d).frame(), [(f,) for f in L.SINGLE_FEATURES], LABEL)


@query("m02_mode_combinations", mode_score_sql(L.COMBINATIONS, v1_split_sql()))
def _(spark, d):
    return L.mode_scores(v1_split(spark, d).frame(), L.COMBINATIONS, LABEL)


def in_sample_sql(feature, label):
    return f"""SELECT '{feature}' AS feature, '{label}' AS label, CAST(sum(m) AS BIGINT) AS correct, CAST(sum(n) AS BIGINT) AS n, {r6('sum(m) / sum(n)', 'accuracy')}
  FROM (SELECT max(c) AS m, sum(c) AS n FROM (SELECT {feature}, {label}, count(*) AS c FROM g WHERE {feature} IS NOT NULL AND {label} IS NOT NULL GROUP BY ALL) GROUP BY {feature})"""


@query("m03_in_sample_accuracy", tick_cte(None) + ", g AS (SELECT *, digit % 2 AS parity, next_digit % 2 AS next_parity FROM f) "
       + in_sample_sql("previous_digit", "next_digit") + " UNION ALL " + in_sample_sql("parity", "next_parity"))
def _(spark, d):
    df = ordered(spark, d, None).derive(X.lags, X.next_digit, X.next_parity, back=10, fwd=1).frame().withColumn(
        "parity", P.parity(F.col("digit")))
    return H.union_rows([L.in_sample_accuracy(df, "previous_digit", "next_digit"),
                         L.in_sample_accuracy(df, "parity", "next_parity")])


# ---- Spark ML ---------------------------------------------------------------

ITERATIONS = 1000  # at most; the tolerance ends a fit earlier
TREES = 300


def v1_rows(spark, d):
    """Whole rows of the compared features, written once because every model reads them many times."""
    df = v1_split(spark, d, *M.COMPARED_FEATURES).frame()
    return stored(df.select("pos", "is_train", LABEL, *M.COMPARED_FEATURES, *[f"even_count_{n}" for n in X.PARITY_WINDOWS]))


def v4_rows(spark, d, label=LABEL):
    seq = X.usable(X.v4(ordered(spark, d, None)), *X.V4_FEATURES, LABEL).with_columns(
        {"next_parity": P.parity(F.col("next_digit"))})
    return stored(L.chronological(seq).frame().select("pos", "is_train", LABEL, "next_parity", *X.V4_FEATURES))


def scored(df, features, classifier, label=LABEL, scaled=False, name="model", baseline=0.1):
    train, test = M.split(df)
    model = M.fit(train, features, classifier, scaled)
    return M.named(M.accuracy(model.transform(test), label), name, baseline)


def n_train(df):
    return df.where("is_train").count()


@query("m04_logistic_raw")
def _(spark, d):
    df = v1_rows(spark, d)
    return scored(df, M.COMPARED_FEATURES, M.logistic(LABEL, n_train(df), ITERATIONS), name="logistic")


@query("m05_logistic_scaled")
def _(spark, d):
    df = v4_rows(spark, d)
    return scored(df, X.V4_FEATURES, M.logistic(LABEL, n_train(df), ITERATIONS), scaled=True, name="scaled logistic")


@query("m06_decision_tree")
def _(spark, d):
    df = v1_rows(spark, d)
    return H.union_rows([scored(df, M.COMPARED_FEATURES, M.tree(LABEL, 10), name="depth 10"),
                         scored(df, M.COMPARED_FEATURES, M.tree(LABEL, None), name="deepest")])


def ensemble_score(train, test, random_cuts):
    trees = grow_ensemble(train, M.COMPARED_FEATURES, LABEL, Growth(trees=TREES, random_cuts=random_cuts))
    return M.accuracy(trees.predict(test), LABEL)


@query("m07_random_forest")
def _(spark, d):
    return M.named(ensemble_score(*M.split(v1_rows(spark, d)), False), "random forest", 0.1)


@query("m08_extra_trees")
def _(spark, d):
    return M.named(ensemble_score(*M.split(v1_rows(spark, d)), True), "extra trees", 0.1)


NEAR_FEATURES = ["previous_digit", "digit_change", "even_count_10", "even_count_25"]
NEED = " ".join(NEAR_FEATURES)
DISTANCE = " + ".join(f"(q.{f} - t.{f}) * (q.{f} - t.{f})" for f in NEAR_FEATURES)
KEYS = ", ".join(NEAR_FEATURES)
NEAREST_SQL = v1_split_sql(NEED) + f""", tr AS (SELECT pos, next_digit, {KEYS} FROM x WHERE is_train), te AS (SELECT DISTINCT {KEYS} FROM x WHERE NOT is_train),
k AS (SELECT {', '.join('q.' + f for f in NEAR_FEATURES)}, t.next_digit, row_number() OVER (PARTITION BY {', '.join('q.' + f for f in NEAR_FEATURES)} ORDER BY {DISTANCE}, t.pos) AS r FROM te q, tr t),
v AS (SELECT {KEYS}, next_digit, count(*) AS n FROM k WHERE r <= 50 GROUP BY ALL),
b AS (SELECT {KEYS}, arg_max(next_digit, n * 100 - next_digit) AS prediction FROM v GROUP BY ALL)
"""


def near_rows(spark, d):
    return stored(v1_split(spark, d, *NEAR_FEATURES).frame().select("pos", "is_train", LABEL, *NEAR_FEATURES))


@query("m09_nearest_neighbours", NEAREST_SQL + f"SELECT {KEYS}, prediction FROM b")
def _(spark, d):
    train, test = M.split(near_rows(spark, d))
    return nearest_vote(train, test, NEAR_FEATURES, LABEL, 50)


@query("m09_nearest_score", NEAREST_SQL + f"""SELECT count(*) AS n, CAST(sum(CAST(next_digit = prediction AS INTEGER)) AS BIGINT) AS correct,
  {r6('avg(CAST(next_digit = prediction AS INTEGER))', 'accuracy')} FROM x JOIN b USING ({KEYS}) WHERE NOT is_train""")
def _(spark, d):
    train, test = M.split(near_rows(spark, d))
    return nearest_score(train, test, NEAR_FEATURES, LABEL, 50)


# The vote of ten on features scaled by the training rows. Rounded, so that both sides divide by the same numbers.
SCALED_FEATURES = [*NEAR_FEATURES, "digit_2_ago", "digit_3_ago"]
WHOLE = ", ".join(SCALED_FEATURES)
STEPS = " + ".join(f"(q.z{i} - t.z{i}) * (q.z{i} - t.z{i})" for i in range(len(SCALED_FEATURES)))
SCALED_SQL = v1_split_sql(" ".join(SCALED_FEATURES)) + ", s AS (SELECT " + ", ".join(
    f"round(avg({f}), 6) AS m{i}, round(stddev_pop({f}), 6) AS d{i}" for i, f in enumerate(SCALED_FEATURES)) + f""" FROM x WHERE is_train),
z AS (SELECT pos, is_train, next_digit, {WHOLE}, {', '.join(f'({f} - m{i}) / d{i} AS z{i}' for i, f in enumerate(SCALED_FEATURES))} FROM x, s),
k AS (SELECT {', '.join('q.' + f for f in SCALED_FEATURES)}, t.next_digit, row_number() OVER (PARTITION BY {', '.join('q.' + f for f in SCALED_FEATURES)} ORDER BY {STEPS}, t.pos) AS r
  FROM (SELECT DISTINCT * EXCLUDE (pos, is_train, next_digit) FROM z WHERE NOT is_train) q, (SELECT * FROM z WHERE is_train) t),
v AS (SELECT {WHOLE}, next_digit, count(*) AS n FROM k WHERE r <= 10 GROUP BY ALL)
SELECT {WHOLE}, arg_max(next_digit, n * 100 - next_digit) AS prediction FROM v GROUP BY ALL"""


@query("m09_nearest_scaled", SCALED_SQL)
def _(spark, d):
    rows = stored(v1_split(spark, d, *SCALED_FEATURES).frame().select("pos", "is_train", LABEL, *SCALED_FEATURES))
    told = rows.where("is_train").agg(*[F.round(fn(f), 6) for f in SCALED_FEATURES for fn in (F.avg, F.stddev_pop)]).first()
    scaled = {f"z{i}": (F.col(f) - told[2 * i]) / told[2 * i + 1] for i, f in enumerate(SCALED_FEATURES)}
    train, test = M.split(stored(rows.withColumns(scaled)))
    votes = nearest_vote(train, test, list(scaled), LABEL, 10)
    return test.select(*SCALED_FEATURES, *scaled).distinct().join(votes, list(scaled)).select(*SCALED_FEATURES, "prediction")


@query("m10_model_comparison")
def _(spark, d):
    df = v1_rows(spark, d)
    train, test = M.split(df)
    others = {"random forest": ensemble_score(train, test, False), "extra trees": ensemble_score(train, test, True),
              "nearest neighbours": nearest_score(train, test, M.COMPARED_FEATURES, LABEL, 50)}
    return M.compare(df, M.COMPARED_FEATURES, LABEL, 0.1, {
        "logistic regression": (M.logistic(LABEL, n_train(df), ITERATIONS), False),
        "decision tree": (M.tree(LABEL, 10), False)}, extra=others)


@query("m11_accuracy")
def _(spark, d):
    df = v4_rows(spark, d)
    train, test = M.split(df)
    model = M.fit(train, X.V4_FEATURES, M.tree(LABEL, 5))
    return M.accuracy(model.transform(test), LABEL)


def importance(spark, pairs):
    return spark.createDataFrame([(f, float(v)) for f, v in pairs], "feature string, importance double")


@query("m12_coefficient_importance")
def _(spark, d):
    df = v4_rows(spark, d)
    model = M.fit(df.where("is_train"), X.V4_FEATURES, M.logistic(LABEL, n_train(df), ITERATIONS), scaled=True)
    return importance(spark, M.coefficient_importance(model, X.V4_FEATURES))


@query("m13_tree_importance")
def _(spark, d):
    trees = grow_ensemble(v1_rows(spark, d).where("is_train"), M.COMPARED_FEATURES, LABEL, Growth(trees=TREES))
    return importance(spark, trees.importance())


def with_probabilities(spark, d):
    df = v1_rows(spark, d)
    train, test = M.split(df)
    model = M.fit(train, M.COMPARED_FEATURES, M.logistic(LABEL, n_train(df), ITERATIONS))
    return M.with_confidence(model.transform(test))


@query("m14_class_probabilities")
def _(spark, d):
    return with_probabilities(spark, d).agg(F.avg("confidence").alias("mean"), F.max("confidence").alias("maximum"),
                                            F.min("confidence").alias("minimum"), F.count(F.lit(1)).alias("n"))


@query("a19_confidence_bands")
def _(spark, d):
    out = with_probabilities(spark, d)
    return H.confidence_bands(out, F.col("confidence"), F.col("prediction") == F.col(LABEL))


@query("m15_single_feature_ablation")
def _(spark, d):
    return M.ablation(v4_rows(spark, d), {f: (f,) for f in X.V4_FEATURES}, LABEL, 0.1)


@query("m16_v4_set_ablation")
def _(spark, d):
    return M.ablation(v4_rows(spark, d), M.V4_SETS, LABEL, 0.1)


@query("m16_v3_set_ablation")
def _(spark, d):
    # Each set drops only its own incomplete rows, so the sets differ in size.
    marked = L.chronological_sets(X.v3(ordered(spark, d, None)), M.V3_SETS, LABEL).frame()
    marks = {name: f"mark_{i}" for i, name in enumerate(M.V3_SETS)}
    used = sorted({f for features in M.V3_SETS.values() for f in features})
    return M.ablation(stored(marked.select(LABEL, *used, *marks.values())), M.V3_SETS, LABEL, 0.1, marks=marks)


def parity_model(spark, d):
    df = v4_rows(spark, d)
    train, test = M.split(df)
    model = M.fit(train, X.V4_FEATURES, M.logistic("next_parity", n_train(df), ITERATIONS, "binomial"), scaled=True)
    return model.transform(test)


@query("m17_parity_model")
def _(spark, d):
    return M.named(M.accuracy(parity_model(spark, d), "next_parity"), "parity", 0.5)


@query("a20_prediction_class_counts")
def _(spark, d):
    return parity_model(spark, d).agg(F.count_if(F.col("prediction") == 0).alias("predicted_even"),
                                      F.count_if(F.col("prediction") == 1).alias("predicted_odd"))


@query("m18_model_significance")
def _(spark, d):
    df = v4_rows(spark, d)
    return M.significance(scored(df, X.V4_FEATURES, M.logistic(LABEL, n_train(df), ITERATIONS), scaled=True), 0.1)


# The features of the two earlier models that are tested.
V2_TESTED = ("digit_repeated", "digit_repeated_2_ago", *[f"digit_{k}_count_10" for k in range(10)])
V3_TESTED = ("repeat_streak", "digit_repeated", "digit_entropy_10")


def tested_rows(spark, d, build, features):
    seq = X.usable(build(ordered(spark, d, None)), *features, LABEL)
    return stored(L.chronological(seq).frame().select("pos", "is_train", LABEL, *features))


@query("m18_v2_significance")
def _(spark, d):
    df = tested_rows(spark, d, X.v2, V2_TESTED)
    return M.significance(scored(df, V2_TESTED, M.tree(LABEL, None), name="V2 tree"), 0.1)


@query("m18_v3_significance")
def _(spark, d):
    df = tested_rows(spark, d, X.v3, V3_TESTED)
    return M.significance(scored(df, V3_TESTED, M.logistic(LABEL, n_train(df), ITERATIONS), scaled=True, name="V3 subset"), 0.1)
