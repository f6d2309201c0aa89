"""Hit rates, joins, blocks and tests."""

from pyspark.sql import functions as F

from tickloom.functions import price as P
from tickloom.functions import stats as S
from tickloom.operators import blocks as B
from tickloom.operators import conditions as C
from tickloom.operators import dependence as D
from tickloom.operators import hits as H
from tickloom.operators import learn as L
from tickloom.plans import features as X
from workload.base import (EVENT_SIGNAL, hit, P0, SIGNAL_SQL, TICK_SQL, inputs, ordered, part, query, r6, score_sql,
                           signal_cte, signals, tick_cte, ticks, usable_cte)
from workload.conditions import BANDS_SQL, GRID_SQL, grid
from workload.windows import RUNS, signal_runs

WITH_T = f"WITH {TICK_SQL}"
COUNTS = "count(*) AS observations, coalesce(sum(hit), 0) AS correct"


def grouped(key: str, where: str = "true", source: str = "s") -> str:
    head, tail = (f"{key}, ", f"GROUP BY {key.split(' AS ')[-1]}") if key else ("", "")
    return f"SELECT {head}{COUNTS} FROM {source} WHERE {where} {tail}"


@query("a01_hit_test", score_sql(grouped("symbol"), "symbol", cte=signal_cte()))
def _(spark, d):
    return H.hit_test(signals(spark, d).frame(), hit(), P0, ["symbol"])


@query("a01_empty_group", score_sql(grouped("", "delta > 10"), "", empty="null", cte=signal_cte()))
def _(spark, d):
    return H.hit_test(signals(spark, d).where(F.col("delta") > 10).frame(), hit(), P0, empty="null")


@query("a02_by_previous_digit", score_sql(
    "SELECT CAST(g.g AS INTEGER) AS previous_digit, count(s.tie) AS observations, coalesce(sum(hit), 0) AS correct "
    "FROM range(10) g(g) LEFT JOIN s ON previous_digit = g.g GROUP BY ALL", "previous_digit", cte=signal_cte()))
def _(spark, d):
    counts = H.counted(signals(spark, d).frame(), hit(), ["previous_digit"])
    return H.scored(H.fill_groups(counts, "previous_digit", range(10)), P0)


@query("a03_by_digit_distance", score_sql(grouped("abs(previous_digit - 3) AS digit_distance"), "digit_distance", cte=signal_cte()))
def _(spark, d):
    df = signals(spark, d).frame().withColumn("digit_distance", P.digit_distance(F.col("previous_digit"), 3))
    return H.hit_test(df, hit(), P0, ["digit_distance"])


@query("a04_by_hour", score_sql(grouped("CAST(hour(time + INTERVAL 3 HOUR) AS INTEGER) AS hour"), "hour", cte=signal_cte()))
def _(spark, d):
    df = signals(spark, d).frame().withColumn("hour", P.hour_of(F.col("epoch"), "Africa/Nairobi"))
    return H.hit_test(df, hit(), P0, ["hour"])


@query("a04_over_2_by_utc_hour", score_sql(
    "SELECT CAST(hour(time) AS INTEGER) AS hour, count(*) AS observations, sum(CAST(next_digit > 2 AS INTEGER)) AS correct "
    "FROM u WHERE vol20 <= 60 AND digit IN (0, 1) GROUP BY 1", "hour", p0=0.7, cte=usable_cte(windows=(20,))))
def _(spark, d):
    df = inputs(spark, d, (20,)).where(C.calm_low_digit(60.0)).frame().withColumn("hour", P.hour_of(F.col("epoch")))
    return H.hit_test(df, C.over(), 0.7, ["hour"])


POSITIONED = RUNS + ", i AS (SELECT *, row_number() OVER (PARTITION BY symbol, run_id ORDER BY row) AS run_position, " \
    "count(*) OVER (PARTITION BY symbol, run_id) AS run_size FROM r)"


@query("a05_by_run_position", score_sql(grouped("run_position", source="i"), "run_position", cte=POSITIONED))
def _(spark, d):
    return H.hit_test(signal_runs(spark, d).frame(), hit(), P0, ["run_position"])


@query("a06_value_counts", signal_cte() + f""" SELECT CAST(g.g AS INTEGER) AS next_digit, count(s.tie) AS n,
  {r6('count(s.tie) / (SELECT count(*) FROM s)', 'share')}, {r6('count(s.tie) / (SELECT count(*) FROM s) - 0.1', 'difference')}
  FROM range(10) g(g) LEFT JOIN s ON next_digit = g.g GROUP BY g.g""")
def _(spark, d):
    return H.value_counts(signals(spark, d).frame(), "next_digit", range(10), baseline=0.1)


@query("a07_share_by_parity", f"{WITH_T} SELECT CASE WHEN digit % 2 = 0 THEN 'Even' ELSE 'Odd' END AS parity, count(*) AS n, "
       f"{r6('count(*) / (SELECT count(*) FROM t) * 100', 'share')} FROM t GROUP BY 1")
def _(spark, d):
    return H.value_counts(ticks(spark, d).withColumn("parity", P.parity_name(F.col("digit"))), "parity", scale=100.0)


@query("a07_share_by_digit", f"{WITH_T} SELECT digit, count(*) AS n, {r6('count(*) / (SELECT count(*) FROM t) * 100', 'share')} FROM t GROUP BY 1")
def _(spark, d):
    return H.value_counts(ticks(spark, d), "digit", scale=100.0)


PAIRS = tick_cte() + ", c AS (SELECT previous_digit, next_digit, count(*) AS n FROM f WHERE previous_digit IS NOT NULL AND next_digit IS NOT NULL GROUP BY ALL)"


def pairs(spark, d):
    return ordered(spark, d).derive(X.lags, X.next_digit, back=10, fwd=1).frame()


@query("a08_crosstab", PAIRS + f" SELECT previous_digit, next_digit, n, {r6('n / sum(n) OVER (PARTITION BY previous_digit)', 'row_share')} FROM c")
def _(spark, d):
    return H.crosstab(pairs(spark, d), "previous_digit", "next_digit")


@query("a08_crosstab_wide", PAIRS + " SELECT previous_digit, " + ", ".join(
    f"CAST(sum(CASE WHEN next_digit = {k} THEN n ELSE 0 END) AS BIGINT) AS next_digit_{k}" for k in range(10)) + " FROM c GROUP BY 1")
def _(spark, d):
    return H.crosstab_wide(pairs(spark, d), "previous_digit", "next_digit")


BEST = PAIRS + """, b AS (SELECT previous_digit, arg_max(next_digit, n * 100 - next_digit) AS best, max(n) AS best_n,
  CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1)"""


@query("a09_best_class", BEST + f" SELECT previous_digit, best, best_n, n, {r6('best_n / n', 'best_share')} FROM b")
def _(spark, d):
    return H.best_class(H.crosstab(pairs(spark, d), "previous_digit", "next_digit"), "previous_digit", "next_digit")


LAGGED = tick_cte(more=", lag(digit, 2) OVER w AS digit_2_ago, lag(digit, 3) OVER w AS digit_3_ago, lag(digit, 5) OVER w AS digit_5_ago, lag(digit, 10) OVER w AS digit_10_ago")
LAG_NAMES = list(X.LAGS)


@query("a10_mean_best_share", LAGGED + " " + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {r6('avg(m)', 'mean_best_share')}, count(*) AS feature_values FROM (SELECT max(n) / sum(n) AS m FROM "
    f"(SELECT {f}, next_digit, count(*) AS n FROM f WHERE {f} IS NOT NULL AND next_digit IS NOT NULL GROUP BY ALL) GROUP BY {f})"
    for f in LAG_NAMES))
def _(spark, d):
    return H.mean_best_share(pairs(spark, d), LAG_NAMES, "next_digit")


def train_cte(by=None, share=0.8):
    """Usable rows numbered, the first share of them marked as training rows."""
    return LAGGED.replace("PARTITION BY symbol ", part(by)) + f""",
u AS (SELECT *, digit - previous_digit AS digit_change FROM f WHERE digit_10_ago IS NOT NULL AND next_digit IS NOT NULL),
n AS (SELECT *, row_number() OVER ({part(by)}ORDER BY time, tie) - 1 AS pos, count(*) OVER ({part(by)}) AS total FROM u),
x AS (SELECT *, pos < floor(total * {share}) AS is_train FROM n)"""


def split_rows(spark, d, symbol=None, share=0.8):
    seq = ordered(spark, d, symbol).derive(X.lags, X.next_digit, back=10, fwd=1)
    seq = X.usable(seq, "digit_10_ago", "next_digit").with_columns({"digit_change": F.col("digit") - F.col("previous_digit")})
    return L.chronological(seq, share).store()


def mode_sql(features, source="x"):
    keys = ", ".join(features)
    return f"""SELECT {keys}, arg_max(next_digit, n * 100 - next_digit) AS prediction FROM
  (SELECT {keys}, next_digit, count(*) AS n FROM {source} WHERE is_train GROUP BY ALL) GROUP BY ALL"""


@query("a11_mode_per_group", train_cte() + " " + mode_sql(["previous_digit", "digit_change"]))
def _(spark, d):
    return L.mode_model(split_rows(spark, d).frame().where("is_train"), ["previous_digit", "digit_change"], "next_digit")


SIZES = RUNS + ", z AS (SELECT symbol, run_id, count(*) AS run_size FROM r GROUP BY ALL)"


@query("a12_run_length_distribution", SIZES + " SELECT run_size, count(*) AS runs FROM z GROUP BY 1")
def _(spark, d):
    runs = signal_runs(spark, d).frame().where(F.col("run_position") == 1)
    return runs.groupBy("run_size").agg(F.count(F.lit(1)).alias("runs"))


@query("a13_gap_summary", signal_cte() + f""", g AS (SELECT row - lag(row) OVER (PARTITION BY symbol ORDER BY row) AS gap FROM s)
SELECT count(gap) AS n, {r6('avg(gap)', 'mean')}, min(gap) AS minimum, max(gap) AS maximum, {r6('median(gap)', 'median')} FROM g""")
def _(spark, d):
    seq = signals(spark, d).derive(lambda w: {"gap": F.col("row") - F.lag("row").over(w)}, back=1)
    return H.summary(seq.frame(), "gap")


@query("a14_signal_frequency", usable_cte() + f" SELECT {r6(f'avg(CAST({SIGNAL_SQL} AS INTEGER))', 'frequency')}, count(*) AS n FROM u")
def _(spark, d):
    return inputs(spark, d).frame().agg(F.avg(P.flag(EVENT_SIGNAL.holds())).alias("frequency"), F.count(F.lit(1)).alias("n"))


@query("a15_best_row", score_sql(grouped("previous_digit"), "previous_digit", cte=signal_cte())
       + " ORDER BY correct / observations DESC, previous_digit LIMIT 1")
def _(spark, d):
    return H.best_row(H.hit_test(signals(spark, d).frame(), hit(), P0, ["previous_digit"]), "probability", "previous_digit")


def tested_cte(cte, source, keys, name="tst", p0=P0):
    """CTE with unrounded test columns."""
    inner = score_sql(source, keys, p0).replace("round(", "(").replace(", 6) + 0.0 AS", ") AS")
    return f"{cte}, {name} AS ({inner})"


SUMMARY_SQL = f"""count(*) AS tests, count(*) FILTER (probability > 0.1) AS above, count(*) FILTER (p_value < 0.05) AS significant,
  count(*) FILTER (probability > 0.1 AND p_value < 0.05) AS above_and_significant, avg(probability) AS mean_probability,
  min(probability) AS min_probability, max(probability) AS max_probability"""
COUNT_COLUMNS = "tests, above, significant, above_and_significant, " + ", ".join(
    r6(c, c) for c in ("mean_probability", "min_probability", "max_probability"))


@query("a16_counts_over_results", tested_cte(usable_cte(), GRID_SQL, "delta_threshold, volatility_threshold")
       + f", k AS (SELECT {SUMMARY_SQL} FROM tst) SELECT {COUNT_COLUMNS} FROM k")
def _(spark, d):
    return H.significance_counts(grid(spark, d), P0)


BLOCK = 100
BLOCK_SOURCE = f"""SELECT symbol, k // {BLOCK} + 1 AS block, min(epoch) AS start_time, max(epoch) AS end_time, {COUNTS} FROM s
  GROUP BY 1, 2 HAVING count(*) = {BLOCK}"""
BLOCK_KEYS = "symbol, block, start_time, end_time"


def blocks(spark, d, symbol="event_type"):
    return B.signal_blocks(signals(spark, d, symbol), hit(), BLOCK, P0)


@query("a17_combined_total", score_sql(f"SELECT coalesce(sum(observations), 0) AS observations, coalesce(sum(correct), 0) AS correct FROM ({BLOCK_SOURCE})", "",
                                       empty="null", cte=signal_cte()))
def _(spark, d):
    return B.pooled(blocks(spark, d), P0)


# ---- joins, unions, splits --------------------------------------------------

@query("j01_run_size", SIZES + " SELECT r.symbol, tie, run_size FROM r JOIN z ON r.symbol = z.symbol AND r.run_id = z.run_id")
def _(spark, d):
    return signal_runs(spark, d).frame().select("symbol", "tie", "run_size")


def join_sql(features):
    on = " AND ".join(f"x.{f} = m.{f}" for f in features)
    return train_cte() + f", m AS ({mode_sql(features)}) SELECT x.tie, x.next_digit, m.prediction FROM x LEFT JOIN m ON {on} WHERE NOT is_train"


def looked_up(spark, d, features):
    df = split_rows(spark, d).frame()
    model = L.mode_model(df.where("is_train"), features, "next_digit")
    return L.predicted(df.where(~F.col("is_train")), model, features).select("tie", "next_digit", "prediction")


@query("j02_join_on_feature_columns", join_sql(["previous_digit", "digit_change", "digit_2_ago"]), ["prediction"])
def _(spark, d):
    return looked_up(spark, d, ["previous_digit", "digit_change", "digit_2_ago"])


@query("j03_lookup_join", join_sql(["previous_digit"]), ["prediction"])
def _(spark, d):
    return looked_up(spark, d, ["previous_digit"])


@query("p15_dictionary_lookup", join_sql(["digit_change"]), ["prediction"])
def _(spark, d):
    return looked_up(spark, d, ["digit_change"])


@query("j04_union_of_results", score_sql(
    "SELECT 'all' AS grp, " + COUNTS + " FROM s UNION ALL SELECT CAST(previous_digit AS VARCHAR), " + COUNTS + " FROM s GROUP BY 1 "
    f"UNION ALL SELECT band, count(s.tie), sum(hit) FROM {BANDS_SQL} JOIN s ON previous_digit BETWEEN lo AND hi GROUP BY band",
    "grp", cte=signal_cte()))
def _(spark, d):
    counts = H.counted(signals(spark, d).frame(), hit(), ["previous_digit"])
    return H.scored(H.union_rows([
        H.labelled(H.summed(counts), "grp", "all"),
        H.labelled(counts, "grp", F.col("previous_digit")),
        H.labelled(H.in_bands(counts, H.between_bands("previous_digit", H.DIGIT_BANDS)), "grp", F.col("band"))]), P0)


@query("j05_sort_and_head", score_sql(grouped("previous_digit"), "previous_digit", cte=signal_cte())
       + " ORDER BY correct / observations DESC, previous_digit LIMIT 5")
def _(spark, d):
    tested = H.hit_test(signals(spark, d).frame(), hit(), P0, ["previous_digit"])
    return tested.orderBy(F.col("probability").desc(), "previous_digit").limit(5)


def kind_sql(label):
    return f"SELECT {label} AS kind, {COUNTS} FROM i GROUP BY 1"


def two_sided(k, n, p):
    mass = lambda i: f"exp(lgamma({n} + 1.0) - lgamma({i} + 1.0) - lgamma({n} - {i} + 1.0) + {i} * ln({p}) + ({n} - {i}) * ln(1 - {p}))"
    return f"least(1.0, (SELECT sum({mass('i')}) FROM range(0, {n} + 1) r(i) WHERE {mass('i')} <= {mass(k)} * (1 + 1e-7)))"


@query("j06_conditional_label", score_sql(kind_sql("CASE WHEN run_size > 1 THEN 'Clustered' ELSE 'Isolated' END"), "kind",
                                          cte=POSITIONED, p_value=two_sided("correct", "observations", P0)))
def _(spark, d):
    df = signal_runs(spark, d).frame().withColumn("kind", F.when(F.col("run_size") > 1, "Clustered").otherwise("Isolated"))
    return H.hit_test(df, hit(), P0, ["kind"], side="two-sided")


@query("j07_split_80", train_cte("symbol") + " SELECT symbol, tie, pos, is_train FROM x")
def _(spark, d):
    return split_rows(spark, d, "event_type").frame().select("symbol", "tie", "pos", "is_train")


@query("j08_split_70", train_cte(share=0.7) + " SELECT tie, pos, is_train FROM x")
def _(spark, d):
    return split_rows(spark, d, share=0.7).frame().select("tie", "pos", "is_train")


# ---- blocks and time windows ------------------------------------------------

@query("b01_signal_blocks", score_sql(BLOCK_SOURCE, BLOCK_KEYS, cte=signal_cte()))
def _(spark, d):
    return blocks(spark, d)


ROW_BLOCKS = """SELECT pos // 500 + 1 AS block, min(pos) AS start_row, max(pos) AS end_row,
  sum(CAST(on_ AS INTEGER)) AS observations, sum(CAST(on_ AND next_digit = 3 AS INTEGER)) AS correct FROM
  (SELECT *, row_number() OVER (ORDER BY time, tie) - 1 AS pos, delta <= -10 AND vol10 <= 60 AS on_ FROM u) GROUP BY 1"""


@query("b02_row_blocks", score_sql(ROW_BLOCKS, "block, start_row, end_row", empty="null_p", cte=usable_cte(None, forward=True)))
def _(spark, d):
    rows = inputs(spark, d, symbol=None, forward=True)
    return B.row_blocks(rows, EVENT_SIGNAL.holds(), hit(), 500, P0)


TIME_WINDOWS = """SELECT (epoch - (SELECT min(epoch) FROM u)) // 7200 AS "window", min(epoch) AS start_time, max(epoch) AS end_time,
  sum(CAST(delta <= -10 AND vol10 <= 60 AS INTEGER)) AS observations,
  sum(CAST(delta <= -10 AND vol10 <= 60 AND next_digit = 3 AS INTEGER)) AS correct FROM u GROUP BY 1"""


def time_windows(spark, d):
    return B.time_windows(inputs(spark, d).store().frame(), EVENT_SIGNAL.holds(), hit(), 7200, P0)


@query("b03_time_windows", score_sql(TIME_WINDOWS, '"window", start_time, end_time', empty="skip", cte=usable_cte()))
def _(spark, d):
    return time_windows(spark, d)


def forward_sql(train, test, expanding):
    prefix = f"{train} + {test} * (block - 1)" if expanding else str(train)
    b = f"(k - {train}) // {test} + 1"
    source = f"""SELECT *, {prefix} AS training_observations, (SELECT sum(hit) FROM s p WHERE p.k < {prefix}) / ({prefix}) AS tp
  FROM (SELECT {b} AS block, min(epoch) AS start_time, max(epoch) AS end_time, {COUNTS} FROM s WHERE k >= {train}
  GROUP BY 1 HAVING count(*) = {test})"""
    return score_sql(source, f"block, start_time, end_time, CAST(training_observations AS BIGINT) AS training_observations, {r6('tp', 'training_probability')}",
                     cte=signal_cte(None))


@query("b04_walk_forward", forward_sql(400, 100, True))
def _(spark, d):
    return B.walk_forward(signals(spark, d, None), hit(), 400, 100, P0)


@query("b05_frozen_training", forward_sql(400, 100, False))
def _(spark, d):
    return B.walk_forward(signals(spark, d, None), hit(), 400, 100, P0, expanding=False)


@query("b06_checkpoints", score_sql(
    "SELECT c AS checkpoint, c <= (SELECT count(*) FROM s) AS reached, CASE WHEN c <= (SELECT count(*) FROM s) THEN c ELSE 0 END AS observations, "
    "CASE WHEN c <= (SELECT count(*) FROM s) THEN (SELECT sum(hit) FROM s WHERE k < c) ELSE 0 END AS correct "
    "FROM (VALUES (CAST(500 AS BIGINT)), (1000), (1500), (2000), (2500), (3000)) v(c)", "checkpoint, reached", empty="null", cte=signal_cte(None)))
def _(spark, d):
    return B.checkpoints(signals(spark, d, None), hit(), P0)


@query("b07_progress", signal_cte(None) + f""" SELECT count(*) AS observed, CAST(3000 AS BIGINT) AS target,
  CAST(greatest(3000 - count(*), 0) AS BIGINT) AS remaining, {r6('count(*) / 3000 * 100', 'percent')}, count(*) >= 3000 AS ready FROM s""")
def _(spark, d):
    return B.progress(signals(spark, d, None).frame())


def verdict_sql(cte, rules, significant="significant", otherwise="none"):
    whens = " ".join(f"WHEN tests > 0 AND {significant} >= {s} AND above >= tests * {a}"
                     + (" AND mean_probability > 0.1" if m else "") + f" THEN '{n}'" for n, s, a, m in rules)
    return f"{cte}, k AS (SELECT {SUMMARY_SQL} FROM tst) SELECT {COUNT_COLUMNS}, CASE {whens} ELSE '{otherwise}' END AS verdict FROM k"


@query("b08_rolling_verdict", verdict_sql(tested_cte(signal_cte(), BLOCK_SOURCE, BLOCK_KEYS), B.ROLLING_RULES))
def _(spark, d):
    return B.verdict(H.significance_counts(blocks(spark, d), P0), B.ROLLING_RULES, P0)


@query("b08_row_block_verdict", verdict_sql(
    tested_cte(usable_cte(None, forward=True), f"SELECT * FROM ({ROW_BLOCKS}) WHERE observations > 0", "block"),
    B.ROW_BLOCK_RULES, "above_and_significant"))
def _(spark, d):
    rows = inputs(spark, d, symbol=None, forward=True)
    tested = B.row_blocks(rows, EVENT_SIGNAL.holds(), hit(), 500, P0).where(F.col("observations") > 0)
    return B.verdict(H.significance_counts(tested, P0), B.ROW_BLOCK_RULES, P0, significant_column="above_and_significant")


@query("b08_time_window_verdict", verdict_sql(
    tested_cte(usable_cte(), f"SELECT * FROM ({TIME_WINDOWS}) WHERE observations > 0", '"window"'), B.TIME_WINDOW_RULES))
def _(spark, d):
    return B.verdict(H.significance_counts(time_windows(spark, d), P0), B.TIME_WINDOW_RULES, P0)


@query("b09_grid_verdict", verdict_sql(tested_cte(usable_cte(), f"SELECT * FROM ({GRID_SQL}) WHERE observations > 0", "delta_threshold"),
                                       B.GRID_RULES, otherwise="sensitive"))
def _(spark, d):
    tested = grid(spark, d).where(F.col("observations") > 0)
    return B.verdict(H.significance_counts(tested, P0), B.GRID_RULES, P0, otherwise="sensitive")


@query("b10_test_verdict", tested_cte(signal_cte(), grouped("symbol"), "symbol") + """ SELECT symbol, observations, correct,
  CASE WHEN probability > 0.1 AND p_value < 0.05 THEN 'confirmed' WHEN probability > 0.1 THEN 'above baseline' ELSE 'not confirmed' END AS verdict FROM tst""")
def _(spark, d):
    tested = H.hit_test(signals(spark, d).frame(), hit(), P0, ["symbol"])
    return B.test_verdict(tested, P0).select("symbol", "observations", "correct", "verdict")


# ---- statistical tests ------------------------------------------------------

@query("t01_binomial_greater", score_sql(grouped("previous_digit, symbol").replace("GROUP BY previous_digit, symbol", "GROUP BY ALL"),
                                         "previous_digit, symbol", cte=signal_cte()))
def _(spark, d):
    return H.hit_test(signals(spark, d).frame(), hit(), P0, ["previous_digit", "symbol"])


@query("t01_over_2", score_sql("SELECT symbol, count(*) AS observations, sum(CAST(next_digit > 2 AS INTEGER)) AS correct FROM u GROUP BY 1",
                               "symbol", p0=0.7, cte=usable_cte(windows=(20,))))
def _(spark, d):
    return H.hit_test(inputs(spark, d, (20,)).frame(), C.over(), 0.7, ["symbol"])


@query("t02_binomial_two_sided", score_sql(grouped("previous_digit"), "previous_digit", cte=signal_cte(),
                                           p_value=two_sided("correct", "observations", P0)))
def _(spark, d):
    return H.hit_test(signals(spark, d).frame(), hit(), P0, ["previous_digit"], side="two-sided")


def tail_at(k, n, p):
    mass = f"exp(lgamma({n} + 1.0) - lgamma(i + 1.0) - lgamma({n} - i + 1.0) + i * ln({p}) + ({n} - i) * ln(1 - {p}))"
    return f"(SELECT sum({mass}) FROM range({k}, {n} + 1) r(i))"


def interval_sql(alpha, two_sided):
    """Both ends by halving, forty steps."""
    mid_l, mid_h = "((ll + lh) / 2)", "((hl + hh) / 2)"
    below, above = f"{tail_at('k', 'n', mid_l)} < {alpha}", f"{tail_at('k + 1', 'n', mid_h)} < {1 - alpha}"
    high = r6("(hl + hh) / 2", "high") if two_sided else "1.0::DOUBLE AS high"
    return f"""WITH RECURSIVE src AS ({signal_cte()} SELECT symbol, count(*) AS n, CAST(sum(hit) AS BIGINT) AS k FROM s GROUP BY 1),
b AS (SELECT symbol, n, k, 0.0::DOUBLE AS ll, 1.0::DOUBLE AS lh, 0.0::DOUBLE AS hl, 1.0::DOUBLE AS hh, 0 AS step FROM src
  UNION ALL SELECT symbol, n, k, CASE WHEN {below} THEN {mid_l} ELSE ll END, CASE WHEN {below} THEN lh ELSE {mid_l} END,
  CASE WHEN {above} THEN {mid_h} ELSE hl END, CASE WHEN {above} THEN hh ELSE {mid_h} END, step + 1 FROM b WHERE step < 40)
SELECT symbol, n AS observations, k AS correct, CASE WHEN k = 0 THEN 0.0 ELSE {r6('(ll + lh) / 2', 'x').replace(' AS x', '')} END AS low,
  {high} FROM b WHERE step = 40"""


def interval_query(name, side, sql):
    @query(name, sql)
    def _(spark, d):
        counts = H.counted(signals(spark, d).frame(), hit(), ["symbol"])
        ci = S.binom_interval(F.col("correct"), F.col("observations"), side=side)
        return counts.withColumn("ci", ci).select("symbol", "observations", "correct", "ci.low", "ci.high")


interval_query("t03_exact_interval", "greater", interval_sql(0.05, False))
interval_query("t03_two_sided_interval", "two-sided", interval_sql(0.025, True))


def chi_p(x, dof):
    """Lower series of the incomplete gamma function, enough terms for these statistics."""
    a = f"({dof} / 2.0)"
    return (f"1 - (SELECT sum(exp(i * ln({x} / 2) + {a} * ln({x} / 2) - {x} / 2 - lgamma({a} + i + 1))) FROM range(0, 600) r(i))")


@query("t04_goodness_of_fit", f"""{WITH_T}, c AS (SELECT g.g, count(t.tie) AS n FROM range(10) g(g) LEFT JOIN t ON digit = g.g GROUP BY 1),
z AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum((n - tot / 10) * (n - tot / 10) / (tot / 10)) AS x FROM c, (SELECT sum(n) AS tot FROM c))
SELECT n, {r6('x', 'chi_square')}, 9 AS dof, {r6(chi_p('x', 9), 'p_value')} FROM z""")
def _(spark, d):
    return D.uniform_fit(ticks(spark, d))


LAG_COUNTS = f"{WITH_T}, c AS (" + " UNION ALL ".join(
    f"SELECT {k} AS lag, previous, digit AS current, count(*) AS n FROM (SELECT digit, lag(digit, {k}) OVER (ORDER BY time, tie) AS previous FROM t) "
    "WHERE previous IS NOT NULL GROUP BY ALL" for k in D.LAGS) + """),
m AS (SELECT *, sum(n) OVER (PARTITION BY lag) AS tot, sum(n) OVER (PARTITION BY lag, previous) AS rs, sum(n) OVER (PARTITION BY lag, current) AS cs FROM c),
z AS (SELECT lag, CAST(max(tot) AS BIGINT) AS observations, CAST((count(DISTINCT previous) - 1) * (count(DISTINCT current) - 1) AS INTEGER) AS dof,
  max(tot) * (sum(n * n / (rs * cs)) - 1) AS x, sum(n / tot * ln(n * tot / (rs * cs))) AS mi FROM m GROUP BY lag)"""


@query("t05_lag_independence", LAG_COUNTS + f" SELECT lag, observations, dof, {r6('x', 'chi_square')}, {r6(chi_p('x', 'dof'), 'p_value')} FROM z")
def _(spark, d):
    return D.lag_dependence(ordered(spark, d, None)).select("lag", "observations", "dof", "chi_square", "p_value")


@query("t06_mutual_information", LAG_COUNTS + f" SELECT lag, observations, {r6('mi', 'mutual_information')} FROM z")
def _(spark, d):
    return D.lag_dependence(ordered(spark, d, None)).select("lag", "observations", "mutual_information")


PERMUTATIONS = 20
PERM_FEATURES = ["previous_digit", "digit_change"]


def permutation_sql(std, times=PERMUTATIONS):
    return train_cte() + f""", tr AS (SELECT * FROM x WHERE is_train), te AS (SELECT * FROM x WHERE NOT is_train),
p AS (SELECT b.b AS perm, pos, previous_digit, digit_change, row_number() OVER (PARTITION BY b.b ORDER BY
  CAST('0x' || substr(md5(CAST(pos AS VARCHAR) || '-' || CAST(b.b AS VARCHAR)), 1, 15) AS BIGINT), pos) - 1 AS rank FROM tr CROSS JOIN range({times}) b(b)),
l AS (SELECT perm, p.previous_digit, p.digit_change, tr.next_digit FROM p JOIN tr ON tr.pos = p.rank
  UNION ALL SELECT -1, previous_digit, digit_change, next_digit FROM tr),
mo AS (SELECT perm, previous_digit, digit_change, arg_max(next_digit, n * 100 - next_digit) AS prediction FROM
  (SELECT perm, previous_digit, digit_change, next_digit, count(*) AS n FROM l GROUP BY ALL) GROUP BY ALL),
a AS (SELECT perm, avg(CAST(te.next_digit = prediction AS INTEGER)) AS acc FROM te JOIN mo USING (previous_digit, digit_change) GROUP BY perm),
re AS (SELECT acc AS real FROM a WHERE perm = -1), sh AS (SELECT acc FROM a WHERE perm >= 0)
SELECT {r6('max(real)', 'accuracy')}, count(*) AS permutations, {r6('avg(acc)', 'mean_accuracy')}, {r6(f'{std}(acc)', 'std_accuracy')},
  {r6('quantile_cont(acc, 0.95)', 'p95')}, {r6('quantile_cont(acc, 0.99)', 'p99')}, count(*) FILTER (acc >= real) AS at_least_real,
  {r6('(count(*) FILTER (acc >= real) + 1) / (count(*) + 1)', 'p_value')} FROM sh, re"""


def permutations(spark, d, times=PERMUTATIONS):
    df = split_rows(spark, d).frame()
    return D.permutation_scores(df.where("is_train"), df.where(~F.col("is_train")), PERM_FEATURES, "next_digit", "pos", times)


@query("t07_permutation_test", permutation_sql("stddev_pop"))
def _(spark, d):
    return D.permutation_summary(permutations(spark, d))


@query("t07_permutation_test_sample_std", permutation_sql("stddev_samp"))
def _(spark, d):
    return D.permutation_summary(permutations(spark, d), population=False)


REFERENCE_PERMUTATIONS = 500


@query("t07_permutation_test_500", permutation_sql("stddev_pop", REFERENCE_PERMUTATIONS))
def _(spark, d):
    return D.permutation_summary(permutations(spark, d, REFERENCE_PERMUTATIONS))


def counted_permutations(spark, d):
    df = split_rows(spark, d).frame()
    return D.counted_permutation_scores(df.where("is_train"), df.where(~F.col("is_train")), PERM_FEATURES, "next_digit",
                                        REFERENCE_PERMUTATIONS)


# The shuffled tables are drawn by a random generator, which SQL cannot repeat.
@query("t07_permutations_500")
def _(spark, d):
    return D.permutation_summary(counted_permutations(spark, d))


@query("t07_real_accuracy", train_cte() + f""", mo AS (SELECT previous_digit, digit_change, arg_max(next_digit, n * 100 - next_digit) AS prediction FROM
  (SELECT previous_digit, digit_change, next_digit, count(*) AS n FROM x WHERE is_train GROUP BY ALL) GROUP BY ALL)
SELECT count(*) AS n, CAST(sum(CAST(x.next_digit = prediction AS INTEGER)) AS BIGINT) AS correct, {r6('avg(CAST(x.next_digit = prediction AS INTEGER))', 'accuracy')}
FROM x JOIN mo USING (previous_digit, digit_change) WHERE NOT is_train""")
def _(spark, d):
    df = split_rows(spark, d).frame()
    return D.counted_permutation_scores(df.where("is_train"), df.where(~F.col("is_train")), PERM_FEATURES, "next_digit",
                                        0).select("n", "correct", "accuracy")


@query("t08_expected_hits", signal_cte() + f""", c AS ({grouped('symbol')}) SELECT symbol, observations, CAST(correct AS BIGINT) AS correct,
  {r6('observations * 0.1', 'expected')}, {r6('correct - observations * 0.1', 'excess')}, {r6('correct / observations - 0.1', 'difference')} FROM c""")
def _(spark, d):
    return H.with_expected(H.hit_test(signals(spark, d).frame(), hit(), P0, ["symbol"]), P0).select(
        "symbol", "observations", "correct", "expected", "excess", "difference")
