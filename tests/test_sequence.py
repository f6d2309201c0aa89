import random

import numpy as np
import pandas as pd
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickloom.functions import rolling as R
from tickloom.operators.sequence import sequence
from tickloom.plans import features as X
from tickloom.sources import ticks as src

# A hand-made sequence of thirteen ticks, two seconds apart.
PRICES = [614.95, 614.77, 614.77, 615.01, 614.90, 614.80, 614.83, 614.73, 614.63, 614.53, 614.40, 614.33, 614.53]


def frame(spark, rows, schema="time bigint, tie bigint, symbol string, price double"):
    return spark.createDataFrame(rows, schema)


def hand_made(spark):
    df = frame(spark, [(2 * i, i, "A", p) for i, p in enumerate(PRICES)])
    return src.as_ticks(df, "time", "price", "tie", "symbol")


def by_tie(seq, *names):
    return [tuple(r[n] for n in names) for r in sorted(seq.frame().collect(), key=lambda r: r["tie"])]


@pytest.mark.parametrize("rows", [None, 4])
def test_hand_made_values(spark, rows):
    t = src.in_time_order(hand_made(spark), rows_per_segment=rows)
    got = by_tie(X.v4(t), "digit", "delta", "vol10", "next_digit", "round_distance")
    assert [g[0] for g in got] == [5, 7, 7, 1, 0, 0, 3, 3, 3, 3, 0, 3, 3]
    assert [g[1] for g in got][1:] == pytest.approx([-.18, 0, .24, -.11, -.1, .03, -.1, -.1, -.1, -.13, -.07, .2])
    assert [g[2] for g in got][:10] == [None] * 10
    assert [g[2] for g in got][10:] == pytest.approx([0.120023, 0.112071, 0.136072], abs=1e-6)
    assert [g[3] for g in got] == [7, 7, 1, 0, 0, 3, 3, 3, 3, 0, 3, 3, None]
    assert [g[4] for g in got] == pytest.approx([.05, .23, .23, .01, .1, .2, .17, .27, .37, .47, .4, .33, .47])
    got = by_tie(X.v3(t), "digit_change", "repeat_streak", "digit_entropy_10", "distribution_shift_10", "digit_concentration_10")
    assert [g[0] for g in got] == [None, 2, 0, 6, 1, 0, 3, 0, 0, 0, 3, 3, 0]
    assert [g[1] for g in got] == [1, 1, 2, 1, 1, 2, 1, 2, 3, 4, 1, 1, 2]
    assert [g[2] for g in got][9:] == pytest.approx([2.121928, 1.846439, 1.685475, 1.295462], abs=1e-6)
    assert [g[3] for g in got][9:] == pytest.approx([1.6, 1.6, 1.2, 0.8])
    assert [g[4] for g in got][9:] == pytest.approx([.4, .4, .5, .6])
    got = by_tie(X.v1(t), "even_count_10")
    assert [g[0] for g in got] == [None] * 9 + [2, 2, 3, 3]


def random_ticks(seed, n, symbols=3, ties=True):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([0, 0, 1, 5]) if ties else 1
        # One symbol has most of the rows.
        s = "hot" if rng.random() < 0.7 else f"s{rng.randrange(symbols)}"
        rows.append((t, i, s, round(rng.uniform(0, 3), 2)))
    rng.shuffle(rows)
    return rows


def build(seq):
    out = seq.derive(X.price_delta, X.volatility(5, 10),
                     lambda w: {"previous_digit": F.lag("digit").over(w), "next_digit": F.lead("digit").over(w)},
                     back=10, fwd=1, pos="pos", total="total")
    out = out.runs("digit", "pos", size="run_size")
    return out.running({"sum_digit": (F.col("digit").cast("bigint"), "sum"), "left": (F.lit(1).cast("bigint"), "sum", True)})


COLUMNS = ["tie", "symbol", "pos", "total", "delta", "vol5", "vol10", "previous_digit", "next_digit", "run_start", "run_length",
           "run_size", "sum_digit", "left"]


def comparable(seq):
    rows = seq.frame().select(*COLUMNS).toPandas().sort_values("tie").reset_index(drop=True)
    rows["vol5"], rows["vol10"] = rows["vol5"].round(9), rows["vol10"].round(9)
    return rows


@pytest.mark.parametrize("rows_per_segment", [3, 17, 120])
def test_cut_equals_whole(spark, rows_per_segment):
    ticks = src.as_ticks(frame(spark, random_ticks(rows_per_segment, 700)), "time", "price", "tie", "symbol")
    whole = sequence(ticks, ["time", "tie"], ["symbol"])
    cut = sequence(ticks, ["time", "tie"], ["symbol"], rows_per_segment=rows_per_segment)
    assert not whole.split and cut.split
    pd.testing.assert_frame_equal(comparable(build(whole)), comparable(build(cut)))


def test_positions_against_pandas(spark):
    rows = random_ticks(1, 400)
    ticks = src.as_ticks(frame(spark, rows), "time", "price", "tie", "symbol")
    got = sequence(ticks, ["time", "tie"], rows_per_segment=9).number("pos").frame().select("tie", "pos").toPandas()
    want = pd.DataFrame(rows, columns=["time", "tie", "symbol", "price"]).sort_values(["time", "tie"])["tie"].tolist()
    assert got.sort_values("pos")["tie"].tolist() == want
    assert sorted(got["pos"]) == list(range(400))


def test_one_time_holding_most_rows_is_cut_by_the_tie_breaker(spark):
    rows = [(5, i, "A", 1.0) for i in range(300)] + [(i, 1000 + i, "A", 2.0) for i in range(10)]
    ticks = src.as_ticks(frame(spark, rows), "time", "price", "tie", "symbol")
    cut = sequence(ticks, ["time", "tie"], ["symbol"], rows_per_segment=40)
    assert cut.split
    assert cut.df.groupBy("_seg").count().agg(F.max("count")).first()[0] < 150
    whole = sequence(ticks, ["time", "tie"], ["symbol"])
    pd.testing.assert_frame_equal(comparable(build(whole)), comparable(build(cut)))


def test_input_order_does_not_matter(spark):
    rows = random_ticks(2, 200)
    a = comparable(build(src.in_time_order(src.as_ticks(frame(spark, rows), "time", "price", "tie", "symbol"))))
    b = comparable(build(src.in_time_order(src.as_ticks(frame(spark, rows[::-1]), "time", "price", "tie", "symbol"))))
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("n", [0, 1, 9])
def test_short_sequences(spark, n):
    rows = [(i, i, "A", 1.0 + i) for i in range(n)]
    seq = src.in_time_order(src.as_ticks(frame(spark, rows), "time", "price", "tie", "symbol"))
    out = X.v4(seq).frame()
    assert out.count() == n and out.where("vol10 IS NOT NULL").count() == 0
    assert X.v2(seq).frame().where("digit_0_count_10 IS NOT NULL").count() == 0


def test_digit_of_negative_price_and_text(spark):
    df = frame(spark, [("1", "1", "A", "-0.05"), ("2", "2", "A", "abc"), ("3", "3", "A", "NaN"), ("4", "4", "A", "7.10")],
               "time string, tie string, symbol string, price string")
    clean = src.coerced(df, {"time": "bigint", "tie": "bigint", "price": "double"})
    got = by_tie(src.in_time_order(src.as_ticks(clean, "time", "price", "tie", "symbol")).derive(X.price_delta, back=1),
                 "tie", "digit", "delta")
    assert [g[:2] for g in got] == [(1, 5), (4, 0)]
    assert got[1][2] == pytest.approx(7.15)


def test_pandas_agrees_on_rolling_features(spark):
    rng = np.random.default_rng(3)
    prices = np.round(np.cumsum(rng.normal(0, 0.2, 400)) + 100, 2)
    df = frame(spark, [(i, i, "A", float(p)) for i, p in enumerate(prices)])
    seq = src.in_time_order(src.as_ticks(df, "time", "price", "tie", "symbol"), rows_per_segment=50)
    got = pd.DataFrame(by_tie(X.v4(seq), "vol5", "vol10"), columns=["vol5", "vol10"]).astype(float)
    s = pd.Series(prices).diff()
    for w in (5, 10):
        np.testing.assert_allclose(got[f"vol{w}"], s.rolling(w).std(), atol=1e-9)
    d = pd.Series(np.round(prices * 100).astype(int) % 10)
    out = pd.DataFrame(by_tie(X.v2(seq), *[f"digit_{k}_count_25" for k in range(10)])).astype(float)
    for k in range(10):
        np.testing.assert_allclose(out[k], (d == k).rolling(25).sum())


def test_missing_column_fails_while_planning(spark):
    with pytest.raises(ValueError, match="missing columns"):
        src.require_columns(spark.range(1), ["time", "price"])


def test_packed_window_limit(spark):
    with pytest.raises(ValueError):
        R.packed_counts(F.col("x"), None, 64)


KEYS = {"double": lambda r: round(r.randrange(4_000) / 100, 2), "decimal(12,3)": lambda r: Decimal(r.randrange(900)) / 1000,
        "string": lambda r: r.choice("abcd") * r.randrange(1, 9), "timestamp_ntz": lambda r: datetime(2024, 1, 1) + timedelta(
            microseconds=r.randrange(300))}


@pytest.mark.parametrize("rows_per_segment", [7, 100])
@pytest.mark.parametrize("kind", sorted(KEYS))
def test_any_order_column_is_cut_right(spark, kind, rows_per_segment):
    """Small steps, equal values told apart by the tie breaker, nulls, and columns that are no numbers."""
    rng = random.Random(rows_per_segment)
    rows = [(None if rng.random() < 0.02 else KEYS[kind](rng), i, rng.choice("xy")) for i in range(900)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, f"at {kind}, tie int, key string")
    for by in ((), ("key",)):
        seq = sequence(df, ["at", "tie"], by, rows_per_segment=rows_per_segment)
        assert seq.split
        got = {r.tie: r.pos for r in seq.number("pos").frame().collect()}
        ranked = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1]))
        want = {}
        for k in "xy" if by else (None,):
            want |= {r[1]: n for n, r in enumerate(r for r in ranked if k in (None, r[2]))}
        assert got == want
