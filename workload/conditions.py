"""Signals and thresholds."""

from pyspark.sql import functions as F

from tickloom.operators import conditions as C
from tickloom.operators import hits as H
from tickloom.operators.learn import chronological
from tickloom.plans import features as X
from workload.base import (EVENT_SIGNAL, hit, P0, SIGNAL_SQL, TARGET, inputs, ordered, query, r6, score_sql, signal_cte,
                           signals, usable_cte)

FRAC = "(price - floor(price))"
ROUND = f"least({FRAC}, 1 - {FRAC})"
NEAR = f"{ROUND} <= 0.1"


def v4_usable(spark, d, symbol="event_type"):
    return X.usable(X.v4(ordered(spark, d, symbol)), "delta", "vol10", "next_digit")


@query("c01_fixed_threshold", signal_cte() + f" SELECT symbol, tie, row, {r6('delta', 'delta')}, {r6('vol10', 'vol10')}, next_digit FROM s")
def _(spark, d):
    return signals(spark, d).frame().select("symbol", "tie", "row", "delta", "vol10", "next_digit")


@query("c02_previous_digit", usable_cte() + f" SELECT symbol, tie, next_digit FROM u WHERE {SIGNAL_SQL} AND previous_digit = 4")
def _(spark, d):
    return inputs(spark, d).where(EVENT_SIGNAL.after(4)).frame().select("symbol", "tie", "next_digit")


@query("c03_calm_low_digit", usable_cte(windows=(20,)) + """ SELECT symbol, tie, digit, next_digit, next_digit > 2 AS over_2
  FROM u WHERE vol20 <= 60 AND digit IN (0, 1)""")
def _(spark, d):
    return inputs(spark, d, (20,)).where(C.calm_low_digit(60.0)).frame().select(
        "symbol", "tie", "digit", "next_digit", C.over().alias("over_2"))


def hypothesis_sql(source, rows, strict):
    """Counts of the three hypotheses over ``source`` with thresholds q."""
    ge, le = (">", "<") if strict else (">=", "<=")
    conds = (("H1 near whole", 4, NEAR), ("H2 rise and calm", 9, f"delta {ge} rise AND vol10 <= calm"),
             ("H3 drop and calm", 3, f"delta {le} fall AND vol10 <= calm"))
    return " UNION ALL ".join(
        f"SELECT '{n}' AS hypothesis, {t} AS target_digit, count(*) AS observations, "
        f"coalesce(sum(CAST(next_digit = {t} AS INTEGER)), 0) AS correct FROM {source}, q WHERE {c}" for n, t, c in conds)


def q_sql(source, calm):
    return (f", q AS (SELECT quantile_cont(delta, 0.75) AS rise, quantile_cont(delta, 0.25) AS fall, "
            f"quantile_cont(vol10, {calm}) AS calm FROM {source})")


@query("c04_quantile_thresholds", score_sql(hypothesis_sql("u", "", False), "hypothesis, target_digit", empty="null",
                                            cte=usable_cte() + q_sql("u", 0.5)))
def _(spark, d):
    df = v4_usable(spark, d).store().frame()
    return C.test_hypotheses(df, C.forward_hypotheses(C.usual_thresholds(df)))


@query("c04_threshold_values", usable_cte() + q_sql("u", 0.5) + f" SELECT {r6('rise', 'rise')}, {r6('fall', 'fall')}, {r6('calm', 'calm')} FROM q")
def _(spark, d):
    t = C.usual_thresholds(v4_usable(spark, d).store().frame())
    return spark.range(1).select(F.lit(t["rise"]).alias("rise"), F.lit(t["drop"]).alias("fall"), F.lit(t["calm"]).alias("calm"))


EXPLORED = {
    "large rise": "delta > rise", "large drop": "delta < fall", "small step": "abs(delta) < small",
    "near whole": NEAR, "far from whole": f"{ROUND} >= 0.4", "calm": "vol10 <= calm", "wild": "vol10 >= wild",
    "large rise and calm": "delta > rise AND vol10 <= calm", "large drop and calm": "delta < fall AND vol10 <= calm",
    "near whole and calm": f"{NEAR} AND vol10 <= calm", "near whole and wild": f"{NEAR} AND vol10 >= wild"}
EXPLORED_CTE = usable_cte() + """, q AS (SELECT quantile_cont(delta, 0.75) AS rise, quantile_cont(delta, 0.25) AS fall,
  quantile_cont(abs(delta), 0.25) AS small, quantile_cont(vol10, 0.25) AS calm, quantile_cont(vol10, 0.75) AS wild FROM u),
x AS (""" + " UNION ALL ".join(f"SELECT '{n}' AS condition, next_digit FROM u, q WHERE {c}" for n, c in EXPLORED.items()) + ")"


@query("c05_explored_conditions", EXPLORED_CTE + " SELECT condition, count(*) AS observations FROM x GROUP BY condition")
def _(spark, d):
    df = v4_usable(spark, d).store().frame()
    conds = C.explored_conditions(C.explored_thresholds(df))
    one = df.agg(*[F.count_if(c).alias(n) for n, c in conds.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("condition"), F.col(f"`{n}`").alias("observations"))
                                          for n in conds])).alias("r")).select("r.*").where(F.col("observations") > 0)


@query("a18_condition_profile", score_sql(
    "SELECT condition, sum(n) AS observations, arg_max(next_digit, n * 100 - next_digit) AS highest_digit, max(n) AS correct, "
    "arg_min(next_digit, n * 100 + next_digit) AS lowest_digit, min(n) AS lowest_count, "
    + ", ".join(f"CAST(sum(CASE WHEN next_digit = {k} THEN n ELSE 0 END) AS BIGINT) AS n_{k}" for k in range(10))
    + " FROM z GROUP BY condition HAVING sum(n) >= 100",
    "condition, CAST(highest_digit AS INTEGER) AS highest_digit, CAST(lowest_digit AS INTEGER) AS lowest_digit, lowest_count, "
    + r6("lowest_count / observations", "lowest_probability") + ", " + ", ".join(f"n_{k}" for k in range(10)),
    cte=EXPLORED_CTE + """, z AS (SELECT c.condition, CAST(g.g AS INTEGER) AS next_digit, count(x.next_digit) AS n
  FROM (SELECT DISTINCT condition FROM x) c CROSS JOIN range(10) g(g)
  LEFT JOIN x ON x.condition = c.condition AND x.next_digit = g.g GROUP BY ALL)""").replace(
        "round(CASE WHEN observations > 0 THEN correct / observations - 0.1 ELSE 0.0 END, 6) + 0.0 AS difference,", ""))
def _(spark, d):
    df = v4_usable(spark, d).store().frame()
    return H.profile_conditions(df, C.explored_conditions(C.explored_thresholds(df)), "next_digit")


SPLIT = usable_cte(None) + ", n AS (SELECT *, row_number() OVER (ORDER BY time, tie) - 1 AS pos, count(*) OVER () AS total FROM u)"
DISCOVERY = SPLIT + ", disc AS (SELECT * FROM n WHERE pos < floor(total * 0.7)), conf AS (SELECT * FROM n WHERE pos >= floor(total * 0.7))"


def discovery(spark, d):
    seq = chronological(v4_usable(spark, d, None), 0.7, mark="is_discovery").store()
    df = seq.frame()
    return df.where(F.col("is_discovery")), df.where(~F.col("is_discovery"))


@query("c06_frozen_thresholds", score_sql(hypothesis_sql("conf", "", True), "hypothesis, target_digit", empty="null",
                                          cte=DISCOVERY + q_sql("disc", 0.25)))
def _(spark, d):
    found, confirm = discovery(spark, d)
    t = C.quantiles(found, {"rise": (F.col("delta"), 0.75), "drop": (F.col("delta"), 0.25), "calm": (F.col("vol10"), 0.25)})
    return C.test_hypotheses(confirm, C.frozen_hypotheses(t))


@query("c07_near_whole", usable_cte() + f" SELECT symbol, tie, next_digit FROM u WHERE {NEAR}")
def _(spark, d):
    return v4_usable(spark, d).where(C.near_whole()).frame().select("symbol", "tie", "next_digit")


GRID_D = (-5.0, -10.0, -20.0, -30.0, -60.0, -600.0)
GRID_V = (20.0, 40.0, 60.0, 80.0, 100.0)
GRID_SQL = ("SELECT gd AS delta_threshold, gv AS volatility_threshold, count(u.tie) AS observations, "
            "coalesce(sum(CAST(next_digit = 3 AS INTEGER)), 0) AS correct FROM (VALUES "
            + ", ".join(f"(CAST({a} AS DOUBLE))" for a in GRID_D) + ") a(gd) CROSS JOIN (VALUES "
            + ", ".join(f"(CAST({b} AS DOUBLE))" for b in GRID_V)
            + ") b(gv) LEFT JOIN u ON delta <= gd AND vol10 <= gv GROUP BY ALL")


def grid(spark, d):
    return C.threshold_grid(inputs(spark, d).frame(), hit(), P0, GRID_D, GRID_V)


@query("c08_threshold_grid", score_sql(GRID_SQL, "delta_threshold, volatility_threshold", cte=usable_cte()))
def _(spark, d):
    return grid(spark, d)


BANDS_SQL = "(VALUES ('0-2', 0, 2), ('3-6', 3, 6), ('7-9', 7, 9), ('8-9', 8, 9)) b(band, lo, hi)"


@query("c09_digit_bands", score_sql(
    f"SELECT band, count(s.tie) AS observations, sum(hit) AS correct FROM {BANDS_SQL} JOIN s ON previous_digit BETWEEN lo AND hi GROUP BY band",
    "band", cte=signal_cte()))
def _(spark, d):
    counts = H.counted(signals(spark, d).frame(), hit(), ["previous_digit"])
    return H.scored(H.in_bands(counts, H.between_bands("previous_digit", H.DIGIT_BANDS)), P0)


@query("c09_distance_bands", score_sql(
    "SELECT band, count(s.tie) AS observations, sum(hit) AS correct FROM (VALUES ('0-1', 0, 1), ('2-3', 2, 3), ('4-6', 4, 6)) b(band, lo, hi) "
    "JOIN s ON abs(previous_digit - 3) BETWEEN lo AND hi GROUP BY band", "band", cte=signal_cte()))
def _(spark, d):
    df = signals(spark, d).frame().withColumn("distance", F.abs(F.col("previous_digit") - TARGET))
    return H.scored(H.in_bands(H.counted(df, hit(), ["distance"]), H.between_bands("distance", H.DISTANCE_BANDS)), P0)
