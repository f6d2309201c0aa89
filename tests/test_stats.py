import math
import random

import pytest
from pyspark.sql import functions as F

from published import LIVE, PUBLISHED
from tickloom.functions import stats as S
from tickloom.functions.price import last_digit


@pytest.mark.parametrize("name", list(PUBLISHED))
def test_published_p_values(spark, name):
    p0, side, rows = PUBLISHED[name]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n bigint, k bigint, expected double").coalesce(1)
    got = df.select("i", "expected", S.binom_p_value(F.col("k"), F.col("n"), p0, side).alias("p")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.p == pytest.approx(r.expected, abs=1e-8)


def test_published_counts_all_used():
    assert sum(len(rows) for _, _, rows in PUBLISHED.values()) == 71


def test_published_live_rows(spark):
    df = spark.createDataFrame(LIVE, "price double, actual int, predicted int, correct int")
    bad = df.where((last_digit(F.col("price")) != F.col("actual"))
                   | ((F.col("actual") == F.col("predicted")).cast("int") != F.col("correct")))
    assert bad.count() == 0


def exact_tail(k, n, p):
    if k <= 0:
        return 1.0
    return math.fsum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k, n + 1))


def test_tails_against_exact_sums(spark):
    rng = random.Random(5)
    cases = [(0, 0), (0, 7), (7, 7), (1, 1)] + [(rng.randint(0, n), n) for n in (1, 2, 5, 30, 200) for _ in range(4)]
    df = spark.createDataFrame([(k, n, p) for k, n in cases for p in (0.1, 0.5, 0.7)], "k bigint, n bigint, p double").coalesce(1)
    k, n, p = F.col("k"), F.col("n"), F.col("p")
    for r in df.select("k", "n", "p", S.binom_at_least(k, n, p).alias("up"), S.binom_at_most(k, n, p).alias("down"),
                       S.binom_pmf(k, n, p).alias("mass"), S.binom_two_sided(k, n, p).alias("both")).collect():
        masses = [math.comb(r.n, i) * r.p ** i * (1 - r.p) ** (r.n - i) for i in range(r.n + 1)]
        assert r.up == pytest.approx(exact_tail(r.k, r.n, r.p), rel=1e-9, abs=1e-14)
        assert r.down == pytest.approx(math.fsum(masses[:r.k + 1]), rel=1e-9, abs=1e-14)
        assert r.mass == pytest.approx(masses[r.k], rel=1e-10)
        assert r.both == pytest.approx(min(1.0, math.fsum(m for m in masses if m <= masses[r.k] * (1 + 1e-7))), rel=1e-9)


def test_large_n_agrees_with_the_normal_limit(spark):
    cases = [(100_200, 10 ** 6), (10 ** 8 + 9_487, 10 ** 9), (10 ** 11 + 300_000, 10 ** 12), (10 ** 11 - 300_000, 10 ** 12)]
    df = spark.createDataFrame(cases, "k bigint, n bigint").coalesce(1)
    for r in df.select("k", "n", S.binom_at_least(F.col("k"), F.col("n"), 0.1).alias("p")).collect():
        z = (r.k - 0.5 - r.n * 0.1) / math.sqrt(r.n * 0.09)
        assert r.p == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), abs=3e-4)


def test_sum_and_integral_agree(spark, monkeypatch):
    df = spark.createDataFrame([(700_400, 10 ** 6), (701_500, 10 ** 6), (699_000, 10 ** 6)], "k bigint, n bigint").coalesce(1)
    summed = [r.p for r in df.select(S.binom_at_least(F.col("k"), F.col("n"), 0.7).alias("p")).collect()]
    monkeypatch.setattr(S, "MAX_TERMS", 10)
    integrated = [r.p for r in df.select(S.binom_at_least(F.col("k"), F.col("n"), 0.7).alias("p")).collect()]
    assert integrated == pytest.approx(summed, rel=1e-5)


def test_interval_ends_have_the_stated_tail(spark):
    df = spark.createDataFrame([(0, 10), (10, 10), (3, 10), (59, 500)], "k bigint, n bigint").coalesce(1)
    k, n = F.col("k"), F.col("n")
    for r in df.select("k", "n", S.binom_interval(k, n).alias("one"), S.binom_interval(k, n, side="two-sided").alias("two")).collect():
        assert r.one.high == 1.0
        if r.k == 0:
            assert r.one.low == r.two.low == 0.0
        else:
            assert exact_tail(r.k, r.n, r.one.low) == pytest.approx(0.05, abs=1e-9)
            assert exact_tail(r.k, r.n, r.two.low) == pytest.approx(0.025, abs=1e-9)
        if r.k == r.n:
            assert r.two.high == 1.0
        else:
            assert 1 - exact_tail(r.k + 1, r.n, r.two.high) == pytest.approx(0.025, abs=1e-9)


def test_chi_square(spark):
    # Closed forms: erfc for one degree of freedom, a finite sum for an even number.
    def even(x, dof):
        return math.exp(-x / 2) * math.fsum((x / 2) ** i / math.factorial(i) for i in range(dof // 2))
    cases = [(x, 1, math.erfc(math.sqrt(x / 2))) for x in (0.01, 1.0, 3.0, 30.0)] + \
            [(x, d, even(x, d)) for d in (2, 8, 80) for x in (0.5, 7.0, 60.0, 120.0, 300.0)]
    df = spark.createDataFrame(cases, "x double, dof int, expected double").coalesce(1)
    for r in df.select("expected", S.chi_square_p_value(F.col("x"), F.col("dof")).alias("p")).collect():
        assert r.p == pytest.approx(r.expected, rel=1e-8, abs=1e-13)


@pytest.mark.parametrize("dof", [10 ** 4, 10 ** 5, 10 ** 6])
def test_chi_square_at_many_degrees_of_freedom(spark, dof):
    """Against the cube-root normal approximation, which is very close there; both sides of the mean."""
    for z in (-3.0, 0.0, 0.5, 3.0):
        statistic = dof * (1 - 2 / (9 * dof) + z * math.sqrt(2 / (9 * dof))) ** 3
        got = spark.range(1).select(S.chi_square_p_value(F.lit(statistic), F.lit(dof))).first()[0]
        assert got == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), abs=2e-5)
