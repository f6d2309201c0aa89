"""Does a digit depend on the ones before it?"""

from __future__ import annotations

from collections.abc import Iterator
from collections.abc import Sequence as Seq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.md5 import heads
from tickloom.functions.stats import chi_square_p_value
from tickloom.operators.ensembles import part_keys, small_batches
from tickloom.operators.hits import value_counts
from tickloom.operators.sequence import Sequence, sequence
from tickloom.storage import stored

LAGS = (1, 2, 3, 5, 10)


def uniform_fit(df: DataFrame, column: str = "digit", values: Seq[int] = tuple(range(10))) -> DataFrame:
    """Chi-square goodness of fit against equal shares; absent values count as zero."""
    counts = value_counts(df, column, values)
    size = len(values)
    one = counts.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("_squares"))
    return one.select(
        "n", (F.col("_squares") * size / F.col("n") - F.col("n")).alias("chi_square"),
        F.lit(size - 1).alias("dof")).withColumn("p_value", chi_square_p_value(F.col("chi_square"), F.col("dof")))


def lag_tables(seq: Sequence, lags: Seq[int] = LAGS, column: str = "digit") -> DataFrame:
    """Counts of (value k rows ago, value now) for every lag k in one pass."""
    c = F.col(column)
    wide = seq.select(column).derive(
        lambda w: {f"_lag{k}": F.lag(c, k).over(w) for k in lags}, back=max(lags)).frame()
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_lag{k}").alias("previous")) for k in lags]))
    return (wide.select(c.alias("current"), pairs.alias("p")).select("p.lag", "p.previous", "current")
            .where(F.col("previous").isNotNull() & F.col("current").isNotNull())
            .groupBy("lag", "previous", "current").agg(F.count(F.lit(1)).alias("n")))


def independence(tables: DataFrame, by: str = "lag", a: str = "previous", b: str = "current") -> DataFrame:
    """Chi-square test (Yates-corrected for two by two) and mutual information of each table."""
    n = F.col("n")
    cells = tables.withColumns({
        "_total": F.sum("n").over(Window.partitionBy(by)),
        "_row": F.sum("n").over(Window.partitionBy(by, a)), "_col": F.sum("n").over(Window.partitionBy(by, b)),
        "_in_row": F.count(F.lit(1)).over(Window.partitionBy(by, a)),
        "_in_col": F.count(F.lit(1)).over(Window.partitionBy(by, b))})
    expected = F.col("_row") * F.col("_col") / F.col("_total")
    per = cells.groupBy(by).agg(
        F.max("_total").alias("observations"),
        F.count_distinct(a).alias("_rows"), F.count_distinct(b).alias("_cols"),
        F.sum(n * n / (F.col("_row") * F.col("_col"))).alias("_fit"),
        F.max(F.abs(n - expected)).alias("_gap"),
        F.sum(1 / F.col("_row") / F.col("_in_row")).alias("_inv_rows"),
        F.sum(1 / F.col("_col") / F.col("_in_col")).alias("_inv_cols"),
        F.sum(n / F.col("_total") * F.log(n * F.col("_total") / (F.col("_row") * F.col("_col"))))
        .alias("mutual_information"))
    dof = ((F.col("_rows") - 1) * (F.col("_cols") - 1)).cast("int")
    total = F.col("observations")
    shrunk = F.greatest(F.col("_gap") - 0.5, F.lit(0.0))
    # In a two-by-two table all four cells are equally far from expectation.
    yates = shrunk * shrunk * total * F.col("_inv_rows") * F.col("_inv_cols")
    out = per.select(by, "observations", dof.alias("dof"),
                     F.when(dof == 0, 0.0).when(dof == 1, yates).otherwise(total * (F.col("_fit") - 1)).alias("chi_square"),
                     "mutual_information")
    return out.withColumn("p_value", chi_square_p_value(F.col("chi_square"), F.col("dof")))


def lag_dependence(seq: Sequence, lags: Seq[int] = LAGS, column: str = "digit") -> DataFrame:
    return independence(lag_tables(seq, lags, column))


TASK_ROWS = 10_000_000


def shuffled_labels(train: DataFrame, features: Seq[str], label: str, pos: str, times: int) -> DataFrame:
    """``times`` random permutations of the training labels, as counts per (perm, features, label).

    Row i of a permutation takes the label at the rank of i in the order of a
    hash of (i, permutation). Up to TASK_ROWS rows whose ``pos`` counts them from 0, a task has all rows as numbers and
    ranks one permutation after the other. Otherwise the ranking is a ``Sequence``, so one permutation may exceed one task.
    """
    told = train.agg(F.count(F.lit(1)), F.min(pos), F.max(pos), F.count_distinct(pos)).first()
    if times and 0 < told[0] <= TASK_ROWS and tuple(told) == (told[0], 0, told[0] - 1, told[0]):
        return shuffled_in_tasks(train, features, label, pos, times)
    ticket = F.concat_ws("-", F.col(pos), F.col("perm"))
    # The first 15 hex digits of the hash as a number.
    order = F.conv(F.substring(F.md5(ticket), 1, 15), 16, 10).cast("bigint")
    # The copies are many more than the rows they come from, so they are spread first.
    spread = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = (train.select(pos, *features).repartition(spread, pos).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
              .withColumn("_h", order))
    ranked = sequence(copies, ["_h", pos], ["perm"]).number("_rank").frame().drop(pos)
    labels = train.select(F.col(pos).alias("_rank"), label)
    return ranked.join(labels, "_rank").groupBy("perm", *features, label).agg(F.count(F.lit(1)).alias("n"))


def numbered(df: DataFrame, names: Seq[str], number: str) -> DataFrame:
    """The different values of the columns, numbered from 0."""
    found = stored(df.select(*names).distinct().withColumn(number, F.monotonically_increasing_id()))
    return stored(found.withColumn(number, (F.row_number().over(Window.orderBy(number)) - 1).cast("int")))


def shuffled_in_tasks(train: DataFrame, features: Seq[str], label: str, pos: str, times: int) -> DataFrame:
    """``shuffled_labels`` of rows whose ``pos`` is 0, 1, 2 and so on; every task gets a copy of them by a shuffle."""
    spark = train.sparkSession
    cells, labels = numbered(train, features, "_cell"), numbered(train, [label], "_label")
    rows = train
    for small, names in ((cells, features), (labels, [label])):
        small = small.select(*[F.col(c).alias(f"_r_{c}") if c in names else F.col(c) for c in small.columns])
        same = F.lit(True)
        for c in names:
            same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        rows = rows.join(small, same).drop(*[f"_r_{c}" for c in names])
    n_cells, n_labels = cells.count(), labels.count()
    names = ("pos", "cell", "label")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({name: pa.array([c.to_numpy().astype("<i4").tobytes()], pa.binary())
                                              for name, c in zip(names, batch.columns)})

    pieces = stored(rows.select(pos, "_cell", "_label").mapInArrow(pack, "pos binary, cell binary, label binary"))
    keys = part_keys(spark, max(1, min(times, 4 * spark.sparkContext.defaultParallelism)))
    dealt = {key: range(k, times, len(keys)) for k, key in enumerate(keys)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[tuple[bytes, ...]]] = {}
        for batch in batches:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
                got.setdefault(key, []).append(tuple(row))
        for key in list(got):
            at, cell, label_ = (np.frombuffer(b"".join(x), "<i4") for x in zip(*got.pop(key)))
            by = np.argsort(at)
            cell, label_ = cell[by].astype(np.uint64), label_[by].astype(np.int64)
            bits = max(1, (n_cells - 1).bit_length())
            for perm, hashes in heads(len(cell), dealt[key]):
                ranked = ranked_cells(hashes, cell, bits).astype(np.int64)
                found, n = counted_pairs(ranked * n_labels + label_, n_cells * n_labels)
                yield pa.RecordBatch.from_pydict({
                    "perm": pa.array(np.full(len(n), perm), pa.int32()), "_cell": pa.array(found // n_labels, pa.int32()),
                    "_label": pa.array(found % n_labels, pa.int32()), "n": pa.array(n, pa.int64())})

    drawn = small_batches(pieces.withColumn("part", F.explode(F.array(*[F.lit(k) for k in keys]))).select(
        "part", *names).repartition(len(keys), "part").mapInArrow(run, "perm int, _cell int, _label int, n long"))
    return drawn.join(cells, "_cell").join(labels, "_label").select("perm", *features, label, "n")


def ranked_cells(hashes: np.ndarray, cell: np.ndarray, bits: int) -> np.ndarray:
    """The cells, numbers of so many bits, in the order of their hashes of 60 bits, equal ones as they stand."""
    # The hash without its last bits and the cell in one number. Hashes that begin alike are told apart by the rest.
    order = np.sort(hashes >> np.uint64(max(0, bits - 4)) << np.uint64(bits) | cell)
    ranked = order & np.uint64((1 << bits) - 1)
    order >>= np.uint64(bits)
    if ((order[1:] == order[:-1]) & (ranked[1:] != ranked[:-1])).any():
        return cell[np.argsort(hashes, kind="stable")]
    return ranked


def counted_pairs(pair: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    if many > len(pair):
        return np.unique(pair, return_counts=True)
    n = np.bincount(pair, minlength=many)
    found = np.flatnonzero(n)
    return found, n[found]


def permutation_scores(train: DataFrame, test: DataFrame, features: Seq[str], label: str, pos: str,
                       times: int) -> DataFrame:
    """Test accuracy of the mode predictor after each shuffle of its training labels.

    ``perm`` -1 is the unshuffled model.
    """
    # Both are read several times.
    train, test = stored(train.select(pos, *features, label)), stored(test.select(*features, label))
    real = (train.groupBy(*features, label).agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(-1).alias("perm"), *features, label, "n"))
    learned = real.unionByName(shuffled_labels(train, features, label, pos, times))
    # Test rows are counted once; every permutation reads the counts.
    test_counts = test.groupBy(*features, label).agg(F.count(F.lit(1)).alias("_test"))
    test_rows = test_counts.groupBy(*features).agg(F.sum("_test").alias("_rows"))
    joined = learned.join(test_counts, [*features, label], "left")
    best = joined.groupBy("perm", *features).agg(
        F.max_by(F.coalesce("_test", F.lit(0)), F.struct(F.col("n"), -F.col(label))).alias("_hits"))
    per = best.join(test_rows, list(features)).groupBy("perm").agg(
        F.sum("_hits").alias("correct"), F.sum("_rows").alias("n"))
    return per.withColumn("accuracy", F.col("correct") / F.col("n"))


BUCKET_ROWS = 500


def counted_permutation_scores(train: DataFrame, test: DataFrame, features: Seq[str], label: str, times: int,
                               seed: int = 42, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """As ``permutation_scores``, with any number of permutations for one scan of the rows.

    A mode predictor sees only how often each label meets each combination of feature values. Shuffled labels are
    therefore drawn as tables: each combination gets its number of labels without replacement from those that are left,
    which is how a random permutation distributes them. The combinations are a stored table in buckets of about
    ``bucket_rows``: a permutation first deals its labels to the buckets, then every bucket deals what it got to its
    combinations in a task of its own. The cost is permutations times combinations and does not depend on the number of
    rows; only the sizes of the buckets and the number of each label reach the driver. Each deal has its own seed, so a
    repeated task draws the same.
    """
    import pandas as pd

    side = [train.select(*features, label, F.lit(1).alias("_train"), F.lit(0).alias("_test")),
            test.select(*features, label, F.lit(0).alias("_train"), F.lit(1).alias("_test"))]
    counts = stored(side[0].unionByName(side[1]).na.drop(subset=[*features, label]).groupBy(*features, label).agg(
        F.sum("_train").alias("_train"), F.sum("_test").alias("_test")))
    labels = sorted(r[0] for r in counts.select(label).distinct().collect())
    by_label = [[F.sum(F.when(F.col(label) == x, F.col(c)).otherwise(0)) for x in labels] or [F.lit(0)]
                for c in ("_train", "_test")]
    tables = counts.groupBy(*features).agg(F.array(*by_label[0]).alias("real"), F.array(*by_label[1]).alias("hits")).where(
        F.aggregate("real", F.lit(0).cast("bigint"), lambda s, x: s + x) > 0)
    buckets = max(1, -(-tables.count() // bucket_rows))
    tables = stored(tables.select(
        F.to_json(F.struct(*features)).alias("key"), F.pmod(F.xxhash64(*features), F.lit(buckets)).cast("int").alias("bucket"),
        "real", "hits"))
    # Of equals the lowest label, which comes first.
    best = F.element_at("hits", F.array_position("real", F.array_max("real")).cast("int"))
    rows = F.aggregate("hits", F.lit(0).cast("bigint"), lambda s, x: s + x)
    per = tables.agg(F.lit(-1).cast("bigint").alias("perm"), F.sum(best).alias("correct"), F.sum(rows).alias("n"))
    if times and not tables.isEmpty():
        sums = [F.sum(F.element_at("real", k + 1)).alias(f"l{k}") for k in range(len(by_label[0]))]
        sizes = sorted(tuple(r) for r in tables.groupBy("bucket").agg(*sums).collect())
        all_labels = np.array(sizes, np.int64).reshape(len(sizes), -1)[:, 1:].sum(0)
        sizes = [(r[0], sum(r[1:])) for r in sizes]

        def deal(frames):
            for frame in frames:
                out = []
                for perm in frame["perm"]:
                    rng, left = np.random.default_rng([seed, int(perm)]), all_labels.copy()
                    for bucket, n in sizes:
                        own = rng.multivariate_hypergeometric(left, n, method="marginals")
                        left -= own
                        out.append((int(perm), bucket, own.tolist()))
                yield pd.DataFrame(out, columns=["perm", "bucket", "labels"])

        def score(key, dealt, cells):
            cells = cells.sort_values("key")
            real, hits = (np.stack(cells[c]).astype(np.int64) for c in ("real", "hits"))
            size, every, out = real.sum(1), np.arange(len(cells)), []
            for perm, labels_ in zip(dealt["perm"], dealt["labels"]):
                rng, left, table = np.random.default_rng([seed, int(perm), key[0] + 1]), np.array(labels_), np.zeros_like(real)
                for i, n in enumerate(size):
                    table[i] = rng.multivariate_hypergeometric(left, n, method="marginals")
                    left = left - table[i]
                out.append((int(perm), int(hits[every, table.argmax(1)].sum()), int(hits.sum())))
            return pd.DataFrame(out, columns=["perm", "correct", "n"])

        spark = train.sparkSession
        tasks = spark.sparkContext.defaultParallelism
        dealt = spark.range(0, times, numPartitions=max(1, min(times, tasks))).select(F.col("id").alias("perm")).mapInPandas(
            deal, "perm long, bucket int, labels array<long>")
        # Few buckets have many permutations each: parts of a bucket's permutations are groups of their own.
        parts = max(1, min(times, 4 * tasks // buckets))
        dealt = dealt.withColumn("part", (F.col("perm") % parts).cast("int"))
        spread = tables.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        drawn = dealt.groupBy("bucket", "part").cogroup(spread.groupBy("bucket", "part")).applyInPandas(
            score, "perm long, correct long, n long")
        per = per.unionByName(drawn.groupBy("perm").agg(F.sum("correct").alias("correct"), F.sum("n").alias("n")))
    return per.withColumn("accuracy", F.col("correct") / F.col("n"))


def permutation_summary(scores: DataFrame, population: bool = True) -> DataFrame:
    """Mean, deviation, upper percentiles of the shuffled scores and the empirical p-value."""
    shuffled = F.when(F.col("perm") >= 0, F.col("accuracy"))
    one = scores.agg(
        F.max(F.when(F.col("perm") < 0, F.col("accuracy"))).alias("accuracy"),
        F.max(F.when(F.col("perm") < 0, F.col("correct"))).alias("_correct"),
        F.collect_list(F.when(F.col("perm") >= 0, F.col("correct"))).alias("_all"),
        F.count(shuffled).alias("permutations"), F.avg(shuffled).alias("mean_accuracy"),
        (F.stddev_pop if population else F.stddev_samp)(shuffled).alias("std_accuracy"),
        F.percentile(shuffled, F.lit(0.95)).alias("p95"), F.percentile(shuffled, F.lit(0.99)).alias("p99"))
    reached = F.size(F.filter("_all", lambda x: x >= F.col("_correct"))).cast("bigint")
    return one.select("accuracy", "permutations", "mean_accuracy", "std_accuracy", "p95", "p99",
                      reached.alias("at_least_real"),
                      ((reached + 1) / (F.col("permutations") + 1)).alias("p_value"))
