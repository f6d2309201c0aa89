import collections
import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import blocks as B
from tickloom.operators import conditions as C
from tickloom.operators import dependence as D
from tickloom.operators import hits as H
from tickloom.operators import learn as L
from tickloom.operators.neighbours import box_tree, nearest_vote
from tickloom.operators.sequence import sequence
from tickloom.sources import sinks
from tickloom.sources import ticks as src

HIT = None


@pytest.fixture(scope="module", autouse=True)
def outcome(spark):
    global HIT
    HIT = F.col("hit") == 1


def signals(spark, n, seed=0, rows_per_segment=None):
    rng = random.Random(seed)
    rows = [(i, i, int(rng.random() < 0.2)) for i in range(n)]
    df = spark.createDataFrame(rows, "epoch bigint, tie bigint, hit int")
    return sequence(df, ["epoch", "tie"], rows_per_segment=rows_per_segment), [r[2] for r in rows]


@pytest.mark.parametrize("n, whole, any_", [(499, 0, 1), (500, 1, 1), (501, 1, 2)])
def test_block_edges(spark, n, whole, any_):
    seq, _ = signals(spark, n)
    assert B.signal_blocks(seq, HIT, 500, 0.1).count() == whole
    assert B.row_blocks(seq, F.lit(True), HIT, 500, 0.1).count() == any_


@pytest.mark.parametrize("rows_per_segment", [None, 70])
def test_walk_forward_against_loops(spark, rows_per_segment):
    seq, hits = signals(spark, 1030, 4, rows_per_segment)
    for expanding in (True, False):
        got = {r["block"]: r for r in B.walk_forward(seq, HIT, 300, 100, 0.1, expanding).collect()}
        assert sorted(got) == list(range(1, 8))
        for b, r in got.items():
            start = 300 + 100 * (b - 1)
            prefix = hits[:start] if expanding else hits[:300]
            assert r["training_observations"] == len(prefix)
            assert r["training_probability"] == pytest.approx(np.mean(prefix))
            assert r["correct"] == sum(hits[start:start + 100])


@pytest.mark.parametrize("rows_per_segment", [None, 40])
def test_chronological_split(spark, rows_per_segment):
    df = spark.createDataFrame([("hot", i) for i in range(333)] + [("b", i) for i in range(7)], "symbol string, time bigint")
    seq = sequence(df, ["time"], ["symbol"], rows_per_segment=rows_per_segment)
    train = L.chronological(seq, 0.8).frame().where("is_train").groupBy("symbol").agg(F.count("*").alias("n"), F.max("time").alias("t"))
    assert {r["symbol"]: (r["n"], r["t"]) for r in train.collect()} == {"hot": (266, 265), "b": (5, 4)}


def test_too_few_signals_give_no_blocks(spark):
    seq, _ = signals(spark, 120)
    assert B.walk_forward(seq, HIT, 300, 100, 0.1, False).count() == 0


def test_checkpoints_and_running_counters(spark):
    seq, hits = signals(spark, 1200, 9, 90)
    rows = B.checkpoints(seq, HIT, 0.1, (500, 1000, 1500)).orderBy("checkpoint").collect()
    assert [(r["reached"], r["correct"]) for r in rows] == [(True, sum(hits[:500])), (True, sum(hits[:1000])), (False, 0)]
    assert rows[2]["p_value"] is None
    got = {r["signals_so_far"]: r["correct_so_far"] for r in B.every_nth(seq, HIT, 400).collect()}
    assert got == {400: sum(hits[:400]), 800: sum(hits[:800]), 1200: sum(hits)}


def test_empty_groups(spark):
    none = spark.createDataFrame([], "hit int")
    zero, null = (H.hit_test(none, HIT, 0.1, empty=e).first() for e in ("zero", "null"))
    assert (zero["observations"], zero["probability"], zero["p_value"]) == (0, 0.0, 1.0)
    assert null["probability"] is None and null["p_value"] is None
    assert H.hit_test(none, HIT, 0.1, empty="skip").count() == 0


def test_grid_equals_single_conditions(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(-.3, .3), rng.uniform(0, .3), rng.randrange(10)) for _ in range(500)]
    df = spark.createDataFrame(rows, "delta double, vol10 double, next_digit int")
    grid = C.threshold_grid(df, F.col("next_digit") == 3, 0.1).collect()
    assert len(grid) == 30
    for r in grid:
        cell = [d for d, v, d3 in ((a, b, c) for a, b, c in rows) if d <= r["delta_threshold"] and v <= r["volatility_threshold"]]
        hits = [1 for a, b, c in rows if a <= r["delta_threshold"] and b <= r["volatility_threshold"] and c == 3]
        assert (r["observations"], r["correct"]) == (len(cell), len(hits))


def test_bands_and_zero_filled_digits(spark):
    df = spark.createDataFrame([(d, int(d == 3)) for d in (0, 0, 3, 4, 8, 9, 9)], "previous_digit int, hit int")
    counts = H.counted(df, HIT, ["previous_digit"])
    full = {r["previous_digit"]: r["observations"] for r in H.fill_groups(counts, "previous_digit", range(10)).collect()}
    assert full == {0: 2, 1: 0, 2: 0, 3: 1, 4: 1, 5: 0, 6: 0, 7: 0, 8: 1, 9: 2}
    bands = {r["band"]: r["observations"] for r in H.in_bands(counts, H.between_bands("previous_digit", H.DIGIT_BANDS)).collect()}
    assert bands == {"0-2": 2, "3-6": 2, "7-9": 3, "8-9": 3}


@pytest.mark.parametrize("bins", [4_096, 7])
def test_quantiles(spark, monkeypatch, bins):
    """The narrowing search gives the same numbers as sorting."""
    monkeypatch.setattr(C, "BINS", bins)
    rng = random.Random(8)
    values = [rng.choice([rng.gauss(0, 1), 0.25, rng.gauss(0, 1) ** 9]) for _ in range(801)] + [5e-324, 0.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = C.quantiles(df, {str(q): (F.col("v"), q) for q in (0.0, 0.25, 0.333, 0.5, 0.75, 1.0)})
    for q, v in got.items():
        assert v == pytest.approx(np.percentile(values, float(q) * 100), rel=1e-12, abs=1e-15)


def test_uniform_fit_counts_absent_digits(spark):
    df = spark.createDataFrame([(d,) for d in [1] * 30 + [2] * 10], "digit int")
    r = D.uniform_fit(df).first()
    assert r["dof"] == 9 and r["chi_square"] == pytest.approx(sum((o - 4) ** 2 / 4 for o in [30, 10] + [0] * 8))


def test_two_by_two_is_corrected(spark):
    table = [[12, 5], [7, 16]]
    rows = [(1, i, j, table[i][j]) for i in range(2) for j in range(2)]
    r = D.independence(spark.createDataFrame(rows, "lag int, previous int, current int, n bigint")).first()
    t = np.array(table, float)
    e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
    assert r["chi_square"] == pytest.approx((((np.abs(t - e) - 0.5) ** 2) / e).sum())
    assert r["dof"] == 1
    p = t / t.sum()
    assert r["mutual_information"] == pytest.approx((p * np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)))).sum())


def test_permutations_keep_the_labels(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), rng.randrange(10)) for i in range(200)]
    train = spark.createDataFrame(rows, "pos bigint, f int, label int")
    counts = D.shuffled_labels(train, ["f"], "label", "pos", 4).toPandas()
    labels = pd.Series([r[2] for r in rows]).value_counts().sort_index()
    features = pd.Series([r[1] for r in rows]).value_counts().sort_index()
    for _, part in counts.groupby("perm"):
        assert part.groupby("label")["n"].sum().tolist() == labels.tolist()
        assert part.groupby("f")["n"].sum().tolist() == features.tolist()
    cells = counts.sort_values(["f", "label"]).groupby("perm")["n"].apply(tuple)
    assert cells.nunique() > 1


@pytest.mark.parametrize("first", [0, 7])
def test_permutations_rank_the_hashes_of_positions(spark, first):
    """In tasks of whole tables, or over all tasks where positions do not start at 0."""
    rng = random.Random(31)
    rows = [(i + first, rng.choice([None, 1, 2, 2]), rng.choice([-0.0, 0.0, 1.5]), rng.choice([None, 3, 3, 4])) for i in range(1203)]
    train = spark.createDataFrame(rows, "pos bigint, f int, g double, label int").repartition(5)
    got = D.shuffled_labels(train, ["f", "g"], "label", "pos", 12)
    # Positions from 0 need no copy of the rows for every permutation.
    assert ("Generate explode" in got._jdf.queryExecution().optimizedPlan().toString()) == bool(first)
    label = {r[0]: r[3] for r in rows}
    want = collections.Counter()
    for perm in range(12):
        order = sorted(rows, key=lambda r: (int(hashlib.md5(f"{r[0]}-{perm}".encode()).hexdigest()[:15], 16), r[0]))
        want.update((perm, r[1], r[2] + 0.0, label[k]) for k, r in enumerate(order) if k in label)
    assert {(r.perm, r.f, r.g + 0.0, r.label): r.n for r in got.collect()} == want


def test_equal_hashes_are_ranked_by_position():
    hashes = np.array([(i * 7 % 5) << 40 | i * 11 % 2 for i in range(60)], np.uint64)
    cell = np.arange(60, dtype=np.uint64) % 3
    assert D.ranked_cells(hashes, cell, 16).tolist() == [int(cell[i]) for i in sorted(range(60), key=lambda i: (int(hashes[i]), i))]


def test_mode_scores_against_loops(spark):
    rng = random.Random(6)
    rows = [(i < 150, rng.randrange(4), rng.choice([None, 0, 1]), rng.randrange(3)) for i in range(200)]
    df = spark.createDataFrame(rows, "is_train boolean, a int, b int, y int")
    got = {r["features"]: (r["n"], r["correct"]) for r in L.mode_scores(df, [("a",), ("a", "b")], "y").collect()}
    for name, cols in (("a", (1,)), ("a + b", (1, 2))):
        seen = {}
        for r in rows:
            key = tuple(r[c] for c in cols)
            if r[0] and None not in key:
                seen.setdefault(key, []).append(r[3])
        best = {k: min(set(v), key=lambda y: (-v.count(y), y)) for k, v in seen.items()}
        test = [(tuple(r[c] for c in cols), r[3]) for r in rows if not r[0]]
        test = [(k, y) for k, y in test if k in best]
        assert got[name] == (len(test), sum(best[k] == y for k, y in test))


@pytest.mark.parametrize("cell_rows, k", [(1000, 3), (4, 3), (10, 7), (8, 500)])
def test_neighbours_against_brute_force(spark, cell_rows, k):
    rng = random.Random(cell_rows)
    # Half of the training rows are copies of one vector.
    rows = [(i, *((1, 1) if rng.random() < 0.5 else (rng.randrange(12), rng.randrange(12))), rng.randrange(4)) for i in range(300)]
    asked = [(rng.randrange(12), rng.randrange(12)) for _ in range(60)]
    train = spark.createDataFrame(rows, "pos bigint, a int, b int, y int")
    test = spark.createDataFrame(asked, "a int, b int")
    got = {(r["a"], r["b"]): r["prediction"] for r in nearest_vote(train, test, ["a", "b"], "y", k, cell_rows=cell_rows).collect()}
    assert set(got) == set(asked)
    for q, vote in got.items():
        near = sorted(rows, key=lambda r: ((r[1] - q[0]) ** 2 + (r[2] - q[1]) ** 2, r[0]))[:k]
        labels = [r[3] for r in near]
        assert vote == min(set(labels), key=lambda y: (-labels.count(y), y))


def test_neighbours_without_values(spark):
    train = spark.createDataFrame([(0, 1.0, 5), (1, None, 6), (2, float("nan"), 7)], "pos bigint, a double, y int")
    test = spark.createDataFrame([(9.0,), (None,), (float("inf"),), (9.0,)], "a double")
    assert {r["a"]: r["prediction"] for r in nearest_vote(train, test, ["a"], "y", 2).collect()} == {
        9.0: 5, None: None, float("inf"): None}
    assert [r["prediction"] for r in nearest_vote(train.limit(0), test.where("a = 9"), ["a"], "y", 2).collect()] == [None]


@pytest.mark.parametrize("n", [2_000, 20_000])
def test_cells_stay_bounded(spark, n):
    """At any number of rows, also where most rows share the smallest, the largest or an inner value."""
    for heavy in (0, 500, 999):
        rows = spark.range(n).select(
            "id", F.when(F.col("id") % 4 > 0, heavy).otherwise(F.xxhash64("id") % 1000).cast("double").alias("x"),
            F.pmod(F.xxhash64(F.col("id") + 1), F.lit(1000)).cast("double").alias("y"))
        levels, cells = box_tree(rows, ["x", "y"], 100)
        sizes = cells.groupBy("_node").agg(F.count("*").alias("n"), F.count_distinct("x", "y").alias("distinct"))
        assert sizes.where("n > 100 AND distinct > 1").isEmpty()
        assert cells.count() == n and cells.select("id").distinct().count() == n
        assert len(levels) <= 8


def test_back_fill_is_idempotent(spark):
    stored = spark.createDataFrame([("A", 1, 1.0), ("A", 2, 2.0), ("B", 5, 1.0)], "symbol string, time bigint, price double")
    history = spark.createDataFrame([("A", 2, 2.0), ("A", 3, 3.0), ("A", 3, 3.0), ("C", 1, 9.0)], stored.schema)
    added = src.back_fill(stored, history)
    assert sorted((r["symbol"], r["time"]) for r in added.collect()) == [("A", 3), ("C", 1)]
    assert src.back_fill(stored.unionByName(added), history).count() == 0


def test_text_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "A", "2.50", "0"), ("x", "A", "bad", "1")], "time string, symbol string, price string, digit string")
    sinks.append_rows(df.limit(1), str(tmp_path / "t"))
    sinks.append_rows(df.subtract(df.limit(1)), str(tmp_path / "t"))
    raw = src.read_ticks(spark, str(tmp_path / "t"), raw=True)
    clean = src.coerced(raw, {"time": "bigint", "price": "double"})
    assert sorted((r["time"] or 0, r["price"] or 0.0) for r in clean.collect()) == [(0, 0.0), (1, 2.5)]
    assert src.prediction_stats(spark.createDataFrame([], "correct int")).first() == (0, 0)
    assert src.high_water_mark(raw.limit(0)).first()["last_time"] is None


def test_long_history_is_unfolded_in_parts(spark):
    n = 1_000_000
    one = spark.range(1).select(F.lit("A").alias("symbol"), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: F.xxhash64(x) * 1e-9).alias("p"),
                                F.sequence(F.lit(1), F.lit(n)).alias("t"))
    short = spark.createDataFrame([("B", [1.0, 2.0], [5]), ("C", [], []), ("D", None, [1]), ("E", None, None)],
                                  "symbol string, p array<double>, t array<int>")
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    try:
        got = src.zip_history(one.unionByName(short), F.col("p"), F.col("t"), ["symbol"])
        sizes = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(sizes) > 4 and max(sizes) < n / 2
    assert got.where("symbol = 'A'").agg(F.count("*"), F.sum("time"), F.sum(F.expr("price - xxhash64(int(time)) * 1e-9"))).first() == (
        n, n * (n + 1) // 2, 0.0)
    assert sorted(((r.symbol, r.time, r.price) for r in got.where("symbol <> 'A'").collect()), key=repr) == [
        ("B", 5, 1.0), ("B", None, 2.0)]


@pytest.mark.parametrize("bucket_rows", [500, 3])
def test_permutations_from_counts_in_buckets(spark, bucket_rows):
    """Every bucket deals what it got: shuffled hits have the same mean whatever the buckets."""
    rng = random.Random(21)
    rows = [(i, rng.randrange(5), rng.randrange(3), rng.choice([3, 3, 3, 4])) for i in range(800)]
    df = spark.createDataFrame(rows, "pos long, a int, b int, label int")
    train, test = df.where("pos < 600"), df.where("pos >= 600")
    got = {r.perm: (r.correct, r.n) for r in D.counted_permutation_scores(
        train, test, ["a", "b"], "label", 200, bucket_rows=bucket_rows).collect()}
    plain = {r.perm: (r.correct, r.n) for r in D.permutation_scores(train, test, ["a", "b"], "label", "pos", 40).collect()}
    assert len(got) == 201 and got[-1] == plain[-1] and {n for _, n in got.values()} == {200}
    a, b = ([c for k, (c, _) in x.items() if k >= 0] for x in (got, plain))
    assert abs(np.mean(a) - np.mean(b)) < 4 * np.std(b) / np.sqrt(40) + 1e-9
    assert D.counted_permutation_scores(train.limit(0), test, ["a", "b"], "label", 3).where("perm >= 0").count() == 0


def test_permutations_from_counts_follow_those_of_rows(spark):
    """Real accuracy is the same, and the shuffled accuracies have the mean and spread of shuffled rows."""
    rng = random.Random(12)
    rows = [(i, rng.choice([0, 0, 1, 2]), rng.choice([3, 3, 4])) for i in range(600)]
    df = spark.createDataFrame(rows, "pos long, feature int, label int")
    train, test = df.where("pos < 450"), df.where("pos >= 450")
    counted = {r.perm: (r.correct, r.n) for r in D.counted_permutation_scores(train, test, ["feature"], "label", 400).collect()}
    plain = {r.perm: (r.correct, r.n) for r in D.permutation_scores(train, test, ["feature"], "label", "pos", 60).collect()}
    assert len(counted) == 401 and counted[-1] == plain[-1]
    again = {r.perm: (r.correct, r.n) for r in D.counted_permutation_scores(train, test, ["feature"], "label", 400).collect()}
    assert counted == again
    a, b = ([v[0] / v[1] for k, v in x.items() if k >= 0] for x in (counted, plain))
    assert abs(np.mean(a) - np.mean(b)) < 4 * np.std(b) / np.sqrt(60) + 1e-9
    # By hand: labels dealt to the three groups by shuffling the rows themselves.
    train_rows, labels = [r for r in rows if r[0] < 450], [r[2] for r in rows if r[0] < 450]
    by_hand = []
    for _ in range(400):
        rng.shuffle(labels)
        seen = {}
        for (_, f, _), v in zip(train_rows, labels):
            seen.setdefault(f, []).append(v)
        mode = {f: max(sorted(set(v)), key=v.count) for f, v in seen.items()}
        by_hand.append(np.mean([mode[f] == v for i, f, v in rows if i >= 450]))
    assert abs(np.mean(a) - np.mean(by_hand)) < 0.02 and abs(np.std(a) - np.std(by_hand)) < 0.02
