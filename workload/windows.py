"""Sequence features."""

from pyspark.sql import functions as F

from tickloom.functions import price as P
from tickloom.functions import rolling as R
from tickloom.operators import blocks as B
from tickloom.operators.sequence import Sequence
from tickloom.plans import features as X
from workload.base import hit, TICK_SQL, ordered, query, r6, signal_cte, signals, tick_cte

WITH_T = f"WITH {TICK_SQL}"
W = "(PARTITION BY symbol ORDER BY time, tie)"


def rows(n: int, end: int = 0) -> str:
    tail = "CURRENT ROW" if end == 0 else f"{end} PRECEDING"
    return f"(PARTITION BY symbol ORDER BY time, tie ROWS BETWEEN {n - 1 + end} PRECEDING AND {tail})"


def feature_query(name, build, columns, sql, nullable=()):
    """A query of feature columns: Spark builds them, SQL computes them over f."""
    @query(name, f"{tick_cte()} SELECT symbol, tie, {sql} FROM f", nullable)
    def _(spark, d):
        return build(ordered(spark, d)).frame().select("symbol", "tie", *columns)


def lag_sql(k):
    return f"lag(digit, {k}) OVER {W}"


feature_query("w01_lags", lambda s: s.derive(X.lags, back=10), list(X.LAGS),
              ", ".join(f"{lag_sql(k)} AS {n}" for n, k in X.LAGS.items()), list(X.LAGS))
feature_query("w02_next_digit", lambda s: s.derive(X.next_digit, fwd=1), ["next_digit"], "next_digit", ["next_digit"])
feature_query("w03_next_parity", lambda s: s.derive(X.next_parity, fwd=1), ["next_parity"], "next_digit % 2 AS next_parity", ["next_parity"])
feature_query("w04_price_delta", lambda s: s.derive(X.price_delta, back=1), ["delta"], r6("delta", "delta"))
feature_query("w05_forward_delta", lambda s: s.derive(X.forward_delta, fwd=1), ["delta"],
              r6(f"lead(price) OVER {W} - price", "delta"))
feature_query("w06_digit_change",
              lambda s: s.derive(X.lags, back=10).with_columns({
                  "signed": F.col("digit") - F.col("previous_digit"),
                  "absolute": F.abs(F.col("digit") - F.col("previous_digit"))}),
              ["signed", "absolute"], "digit - previous_digit AS signed, abs(digit - previous_digit) AS absolute", ["signed", "absolute"])


@query("w07_rolling_std", tick_cte(windows=(5, 10, 20)) + f" SELECT symbol, tie, {r6('vol5', 'vol5')}, {r6('vol10', 'vol10')}, {r6('vol20', 'vol20')} FROM f")
def _(spark, d):
    seq = ordered(spark, d).derive(X.price_delta, X.volatility(5, 10, 20), back=20)
    return seq.frame().select("symbol", "tie", "vol5", "vol10", "vol20")


@query("w08_live_volatility", tick_cte(windows=(19,)) + f" SELECT symbol, tie, {r6('vol19', 'live_volatility')} FROM f")
def _(spark, d):
    return ordered(spark, d).derive(X.price_delta, X.live_volatility(20), back=20).frame().select(
        "symbol", "tie", "live_volatility")


def repeated(lag):
    return lambda s: s.derive(X.lags, back=10).with_columns({
        "repeated": P.flag(F.col("digit") == F.col("previous_digit" if lag == 1 else "digit_2_ago"))})


feature_query("w09_repeat_flag", repeated(1), ["repeated"],
              f"CAST(coalesce(digit = {lag_sql(1)}, false) AS INTEGER) AS repeated")
feature_query("w10_repeat_flag_2", repeated(2), ["repeated"],
              f"CAST(coalesce(digit = {lag_sql(2)}, false) AS INTEGER) AS repeated")

COUNT_COLUMNS = [f"digit_{k}_count_{n}" for n in X.DIGIT_WINDOWS for k in range(10)]


def guarded(n, expr, kind="INTEGER"):
    return f"CAST(CASE WHEN row >= {n - 1} THEN {expr} END AS {kind})"


feature_query("w11_digit_counts", X.v2, COUNT_COLUMNS, ", ".join(
    f"{guarded(n, f'sum(CAST(digit = {k} AS INTEGER)) OVER {rows(n)}')} AS digit_{k}_count_{n}"
    for n in X.DIGIT_WINDOWS for k in range(10)), COUNT_COLUMNS)
PARITY_NOW = [f"{p}_count_{n}" for n in X.DIGIT_WINDOWS for p in ("even", "odd")]
PARITY_BEFORE = [f"{p}_count_{n}" for n in X.PARITY_WINDOWS for p in ("even", "odd")]
feature_query("w12_parity_counts", X.v2, PARITY_NOW, ", ".join(
    f"{guarded(n, f'sum(CAST(digit % 2 = {v} AS INTEGER)) OVER {rows(n)}')} AS {p}_count_{n}"
    for n in X.DIGIT_WINDOWS for v, p in enumerate(("even", "odd"))), PARITY_NOW)
PREVIOUS_PARITY = tick_cte() + f", e AS (SELECT *, previous_digit % 2 AS pp FROM f) SELECT symbol, tie, "


@query("w13_parity_counts_before", PREVIOUS_PARITY + ", ".join(
    f"{guarded(n, f'sum(CAST(coalesce(pp = {v}, false) AS INTEGER)) OVER {rows(n)}')} AS {p}_count_{n}"
    for n in X.PARITY_WINDOWS for v, p in enumerate(("even", "odd"))) + " FROM e", PARITY_BEFORE)
def _(spark, d):
    return X.v1(ordered(spark, d)).frame().select(
        "symbol", "tie", *PARITY_BEFORE)


@query("w14_even_percentage", PREVIOUS_PARITY + ", ".join(
    [r6(f"CASE WHEN row >= {n - 1} THEN sum(CAST(coalesce(pp = 0, false) AS INTEGER)) OVER {rows(n)} / {n} * 100 END", f"v1_{n}") for n in X.PARITY_WINDOWS]
    + [r6(f"CASE WHEN row >= {n - 1} THEN sum(1 - digit % 2) OVER {rows(n)} / {n} * 100 END", f"v2_{n}") for n in X.DIGIT_WINDOWS]
    + [r6(f"CASE WHEN row >= {n - 1} THEN sum(1 - digit % 2) OVER {rows(n)} / {n} END", f"v3_{n}") for n in X.DIGIT_WINDOWS]) + " FROM e")
def _(spark, d):
    seq = X.v1(ordered(spark, d))
    even = lambda w: {"_even": R.running_count(P.parity(F.col("digit")) == 0, w)}
    seq = seq.derive(even, lambda w: {f"_now_{n}": R.count_in_last(F.col("_even"), w, n) for n in X.DIGIT_WINDOWS}, back=26)
    return seq.frame().select(
        "symbol", "tie", *[F.col(f"even_percentage_{n}").alias(f"v1_{n}") for n in X.PARITY_WINDOWS],
        *[(F.col(f"_now_{n}") / n * 100).alias(f"v2_{n}") for n in X.DIGIT_WINDOWS],
        *[(F.col(f"_now_{n}") / n).alias(f"v3_{n}") for n in X.DIGIT_WINDOWS])


def run_cte(value: str) -> str:
    return f"""{WITH_T}, b AS (SELECT *, {value} AS v FROM t),
c AS (SELECT *, CASE WHEN v = lag(v) OVER {W} THEN 0 ELSE 1 END AS opens FROM b),
g AS (SELECT *, sum(opens) OVER {W} AS run FROM c),
q AS (SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY time, tie) AS len FROM g)"""


def with_runs(spark, d, value) -> Sequence:
    seq = ordered(spark, d).number("pos").with_columns({"parity": P.parity(F.col("digit"))})
    return seq.store().runs(value, "pos", size="run_size")


@query("w15_digit_streak", run_cte("digit") + " SELECT symbol, tie, len AS streak FROM q")
def _(spark, d):
    return with_runs(spark, d, "digit").frame().select("symbol", "tie", F.col("run_length").alias("streak"))


@query("w16_parity_streak", run_cte("digit % 2") + " SELECT symbol, tie, len AS streak FROM q")
def _(spark, d):
    return with_runs(spark, d, "parity").frame().select("symbol", "tie", F.col("run_length").alias("streak"))


@query("w17_longest_parity_run", run_cte("digit % 2") + " SELECT symbol, max(len) AS longest FROM q GROUP BY symbol")
def _(spark, d):
    return with_runs(spark, d, "parity").frame().groupBy("symbol").agg(F.max("run_length").alias("longest"))


def window_counts(n=10, cte="n"):
    counts = ", ".join(f"sum(CAST(digit = {k} AS INTEGER)) OVER {rows(n)} AS c{k}" for k in range(10))
    return f"n{n} AS (SELECT *, {counts} FROM f)"


CELLS = [f"c{k}" for k in range(10)]
MOST = "greatest(" + ", ".join(CELLS) + ")"
LEAST = "least(" + ", ".join(f"CASE WHEN {c} > 0 THEN {c} END" for c in CELLS) + ")"
FIRST = lambda extreme: "CASE " + " ".join(f"WHEN c{k} = {extreme} THEN {k}" for k in range(10)) + " END"
ENTROPY = lambda n: "-(" + " + ".join(f"CASE WHEN c{k} > 0 THEN c{k} / {n} * log2(c{k} / {n}) ELSE 0 END" for k in range(10)) + ")"


def digit_query(name, column, expr, n=10, kind=None):
    value = f"CASE WHEN row >= {n - 1} THEN {expr} END"
    shown = f"CAST({value} AS {kind}) AS {column}" if kind else r6(value, column)

    @query(name, f"{tick_cte()}, {window_counts(n)} SELECT symbol, tie, {shown} FROM n{n}", [column] if kind else [])
    def _(spark, d):
        return X.digit_statistics(ordered(spark, d)).frame().select("symbol", "tie", column)


digit_query("w18_most_common_digit", "most_common_digit_10", FIRST(MOST), kind="INTEGER")
digit_query("w19_least_common_digit", "least_common_digit_10", FIRST(LEAST), kind="INTEGER")
digit_query("w20_concentration", "digit_concentration_10", f"{MOST} / 10")
digit_query("w21_entropy_10", "digit_entropy_10", ENTROPY(10))
digit_query("w21_entropy_25", "digit_entropy_25", ENTROPY(25), n=25)


@query("w22_distribution_shift", tick_cte() + " SELECT symbol, tie, " + r6("CASE WHEN row >= 9 THEN (" + " + ".join(
    f"abs(sum(CAST(digit = {k} AS INTEGER)) OVER {rows(5)} - sum(CAST(digit = {k} AS INTEGER)) OVER {rows(5, 5)})" for k in range(10)) + ") / 5 END",
    "distribution_shift_10") + " FROM f")
def _(spark, d):
    return X.digit_statistics(ordered(spark, d)).frame().select("symbol", "tie", "distribution_shift_10")


@query("w23_position", f"{WITH_T} SELECT tie, row_number() OVER (ORDER BY time, tie) - 1 AS pos FROM t")
def _(spark, d):
    return ordered(spark, d, symbol=None).number("pos").frame().select("tie", "pos")


GAPS = signal_cte() + f""", g AS (SELECT *, row - lag(row) OVER (PARTITION BY symbol ORDER BY row) AS gap FROM s)"""
RUNS = GAPS + f""", o AS (SELECT *, CASE WHEN gap = 1 THEN 0 ELSE 1 END AS opens FROM g),
r AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY symbol ORDER BY row) AS BIGINT) AS run_id FROM o)"""


def signal_gaps(spark, d) -> Sequence:
    seq = signals(spark, d)
    return seq.derive(lambda w: {"gap": F.col("row") - F.lag("row").over(w)}, back=1)


@query("w24_signal_gap", GAPS + " SELECT symbol, tie, row, gap FROM g", ["gap"])
def _(spark, d):
    return signal_gaps(spark, d).frame().select("symbol", "tie", "row", "gap")


@query("w25_consecutive_flag", GAPS + " SELECT symbol, tie, CAST(coalesce(gap = 1, false) AS INTEGER) AS consecutive FROM g")
def _(spark, d):
    return signal_gaps(spark, d).frame().select("symbol", "tie", P.flag(F.col("gap") == 1).alias("consecutive"))


def signal_runs(spark, d) -> Sequence:
    """Signals with the run of adjacent rows they belong to.

    ``run_id`` counts the runs of a symbol, ``run_position`` the signals inside
    a run, ``run_size`` all signals of the run.
    """
    seq = signals(spark, d).number("k").store()
    # Within a run row and k grow together, so their difference names the run.
    seq = seq.with_columns({"_island": F.col("row") - F.col("k")})
    seq = seq.runs("_island", "k", "run_start", "run_position", size="run_size")
    return seq.running({"run_id": (F.when(F.col("run_position") == 1, 1).otherwise(0).cast("bigint"), "sum")})


@query("w26_run_id", RUNS + " SELECT symbol, tie, run_id FROM r")
def _(spark, d):
    return signal_runs(spark, d).frame().select("symbol", "tie", "run_id")


@query("w27_run_position", RUNS + " SELECT symbol, tie, row_number() OVER (PARTITION BY symbol, run_id ORDER BY row) AS run_position FROM r")
def _(spark, d):
    return signal_runs(spark, d).frame().select("symbol", "tie", "run_position")


@query("w28_win_loss_streaks", signal_cte() + """, o AS (SELECT *, CASE WHEN hit = lag(hit) OVER (PARTITION BY symbol ORDER BY k) THEN 0 ELSE 1 END AS opens FROM s),
r AS (SELECT *, sum(opens) OVER (PARTITION BY symbol ORDER BY k) AS run FROM o),
l AS (SELECT symbol, run, hit, count(*) AS len FROM r GROUP BY ALL)
SELECT symbol, coalesce(max(CASE WHEN hit = 1 THEN len END), 0) AS longest_win, coalesce(max(CASE WHEN hit = 0 THEN len END), 0) AS longest_loss
FROM l GROUP BY symbol""")
def _(spark, d):
    seq = signals(spark, d).with_columns({"hit": P.flag(hit())}).number("k").store().runs("hit", "k")
    longest = lambda v: F.coalesce(F.max(F.when(F.col("hit") == v, F.col("run_length"))), F.lit(0).cast("bigint"))
    return seq.frame().groupBy("symbol").agg(longest(1).alias("longest_win"), longest(0).alias("longest_loss"))


@query("w29_running_counters", signal_cte(None) + f""", c AS (SELECT k + 1 AS signals_so_far,
  CAST(sum(hit) OVER (ORDER BY k) AS BIGINT) AS correct_so_far FROM s)
SELECT signals_so_far, correct_so_far, {r6('correct_so_far / signals_so_far', 'accuracy')} FROM c WHERE signals_so_far % 500 = 0""")
def _(spark, d):
    return B.every_nth(signals(spark, d, symbol=None), hit(), 500)


# The first two generations as whole tables.
V1_WHOLE = [*X.LAGS, "next_digit", "parity", "previous_parity", "digit_change", "next_parity", *PARITY_BEFORE]
V1_SHARES = [f"even_percentage_{n}" for n in X.PARITY_WINDOWS]
EVEN_BEFORE = "sum(CAST(coalesce(pp = 0, false) AS INTEGER)) OVER"
LAGS_SQL = ", ".join(f"{lag_sql(k)} AS {n}" for n, k in X.LAGS.items())


@query("features_v1", PREVIOUS_PARITY + LAGS_SQL + f""", next_digit, digit % 2 AS parity, pp AS previous_parity,
  digit - previous_digit AS digit_change, next_digit % 2 AS next_parity, """ + ", ".join(
    [f"{guarded(n, f'sum(CAST(coalesce(pp = {v}, false) AS INTEGER)) OVER {rows(n)}')} AS {p}_count_{n}"
     for n in X.PARITY_WINDOWS for v, p in enumerate(("even", "odd"))]
    + [r6(f"CASE WHEN row >= {n - 1} THEN {EVEN_BEFORE} {rows(n)} / {n} * 100 END", f"even_percentage_{n}")
       for n in X.PARITY_WINDOWS]) + " FROM e", V1_WHOLE)
def _(spark, d):
    return X.v1(ordered(spark, d)).frame().select("symbol", "tie", *V1_WHOLE, *V1_SHARES)


V2_WHOLE = [*X.LAGS, "next_digit", "digit_change", "parity", "previous_parity", "next_parity", "digit_repeated",
            "digit_repeated_2_ago", *COUNT_COLUMNS, *PARITY_NOW]
V2_SHARES = [f"even_percentage_{n}" for n in X.DIGIT_WINDOWS]
V2_STREAKS = ["digit_streak", "parity_streak"]


@query("features_v2", tick_cte() + f""", o AS (SELECT *, CASE WHEN digit = previous_digit THEN 0 ELSE 1 END AS opens,
  CASE WHEN digit % 2 = previous_digit % 2 THEN 0 ELSE 1 END AS parity_opens FROM f),
g AS (SELECT *, sum(opens) OVER {W} AS run, sum(parity_opens) OVER {W} AS parity_run FROM o)
SELECT symbol, tie, {LAGS_SQL}, next_digit, digit - previous_digit AS digit_change, digit % 2 AS parity,
  previous_digit % 2 AS previous_parity, next_digit % 2 AS next_parity,
  CAST(coalesce(digit = previous_digit, false) AS INTEGER) AS digit_repeated,
  CAST(coalesce(digit = {lag_sql(2)}, false) AS INTEGER) AS digit_repeated_2_ago, """ + ", ".join(
    [f"{guarded(n, f'sum(CAST(digit = {k} AS INTEGER)) OVER {rows(n)}')} AS digit_{k}_count_{n}"
     for n in X.DIGIT_WINDOWS for k in range(10)]
    + [f"{guarded(n, f'sum(CAST(digit % 2 = {v} AS INTEGER)) OVER {rows(n)}')} AS {p}_count_{n}"
       for n in X.DIGIT_WINDOWS for v, p in enumerate(("even", "odd"))]
    + [r6(f"CASE WHEN row >= {n - 1} THEN sum(1 - digit % 2) OVER {rows(n)} / {n} * 100 END", f"even_percentage_{n}")
       for n in X.DIGIT_WINDOWS]) + """,
  row_number() OVER (PARTITION BY symbol, run ORDER BY time, tie) AS digit_streak,
  row_number() OVER (PARTITION BY symbol, parity_run ORDER BY time, tie) AS parity_streak FROM g""", V2_WHOLE)
def _(spark, d):
    return X.v2(ordered(spark, d)).frame().select("symbol", "tie", *V2_WHOLE, *V2_SHARES, *V2_STREAKS)


@query("features_v4", tick_cte(windows=(5, 10)) + f""" SELECT symbol, tie, {r6('previous_price', 'previous_price')}, {r6('delta', 'delta')},
  {r6('abs(delta)', 'absolute_delta')}, {r6('vol5', 'vol5')}, {r6('vol10', 'vol10')},
  {r6('least(price - floor(price), 1 - (price - floor(price)))', 'round_distance')},
  {r6('abs(price - floor(price) - 0.5)', 'half_distance')}, previous_digit, next_digit FROM f""", ["previous_digit", "next_digit"])
def _(spark, d):
    return X.v4(ordered(spark, d)).frame().select("symbol", "tie", *X.V4_FEATURES, "next_digit")


@query("features_v3_global", tick_cte(None) + f""", {window_counts(10).replace('PARTITION BY symbol ', '')},
y AS (SELECT *, CASE WHEN digit = previous_digit THEN 0 ELSE 1 END AS opens FROM n10),
z AS (SELECT *, sum(opens) OVER (ORDER BY time, tie) AS run FROM y)
SELECT tie, abs(digit - previous_digit) AS digit_change, CAST(coalesce(digit = previous_digit, false) AS INTEGER) AS digit_repeated,
  row_number() OVER (PARTITION BY run ORDER BY time, tie) AS repeat_streak,
  {r6(f'CASE WHEN row >= 9 THEN {ENTROPY(10)} END', 'digit_entropy_10')},
  {r6('CASE WHEN row >= 9 THEN (c0 + c2 + c4 + c6 + c8) / 10 END', 'even_percentage_10')} FROM z""", ["digit_change"])
def _(spark, d):
    return X.v3(ordered(spark, d, symbol=None)).frame().select(
        "tie", "digit_change", "digit_repeated", "repeat_streak", "digit_entropy_10", "even_percentage_10")
