"""Multinomial logistic models of many feature sets, fitted together in shared passes over one table.

Each pass is one job that adds up gradient and curvature of every model that is not finished, so the number of scans is
that of the slowest model (Newton steps, mostly six to ten) and does not grow with the number of sets.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from collections.abc import Sequence as Seq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-10


@dataclass(frozen=True)
class Linear:
    """One model: a row of ``weights`` for each class, the intercept last."""

    features: tuple[str, ...]
    classes: tuple[int, ...]
    weights: np.ndarray

    def margins(self) -> list[Column]:
        return [sum((F.col(f).cast("double") * float(w) for f, w in zip(self.features, row)), F.lit(float(row[-1])))
                for row in self.weights]

    def prediction(self) -> Column:
        """The class of the largest margin, the first of equals; null if there was nothing to learn from."""
        if not self.classes:
            return F.lit(None).cast("int")
        margins = F.array(*self.margins())
        at = F.array_position(margins, F.array_max(margins)).cast("int")
        return F.element_at(F.array(*[F.lit(c) for c in self.classes]), at)


class Search:
    """Newton's method for one model on scaled features; a step that does not help is halved."""

    def __init__(self, width: int, classes: int) -> None:
        self.shape = (classes, width + 1)
        self.base = np.zeros(classes * (width + 1))
        self.step = np.zeros_like(self.base)
        self.loss, self.size, self.done = np.inf, 1.0, classes < 2
        ridge = np.ones(self.shape)
        ridge[:, -1] = 0
        self.ridge = ridge.ravel()

    def trial(self) -> np.ndarray:
        return (self.base - self.size * self.step).reshape(self.shape)

    def told(self, loss: float, gradient: np.ndarray, curvature: np.ndarray) -> None:
        here = self.trial().ravel()
        loss += 0.5 * float(self.ridge @ (here * here))
        if loss > self.loss * (1 + 1e-12) and self.size > 1e-6:
            self.size /= 2
            return
        self.base, self.loss, self.size = here, loss, 1.0
        slope = gradient + self.ridge * here
        # Adding one number to all intercepts changes nothing: the shortest of the equal steps is taken.
        self.step = np.linalg.lstsq(curvature + np.diag(self.ridge), slope, rcond=1e-12)[0]
        self.done = float(slope @ self.step) <= TOLERANCE * max(1.0, loss)


def scales(rows: DataFrame, sets: Mapping[str, Seq[str]], marks: Mapping[str, Column]) -> dict[str, np.ndarray]:
    """Mean and population deviation of every feature on the training rows of its set, in one aggregate."""
    columns = [fn(F.when(marks[s], F.col(f).cast("double"))) for s, fs in sets.items() for f in fs
               for fn in (F.avg, F.stddev_pop)]
    got = [0.0 if v is None else float(v) for v in rows.agg(*columns).first()] if columns else []
    out, at = {}, 0
    for s, fs in sets.items():
        out[s] = np.array(got[at:at + 2 * len(fs)]).reshape(-1, 2)
        at += 2 * len(fs)
    return out


def summed(rows: DataFrame, sets: Mapping[str, Seq[str]], label: str, marks: Mapping[str, Column],
           scale: Mapping[str, np.ndarray], classes: Mapping[str, Seq[int]],
           weights: Mapping[str, np.ndarray]) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Loss, gradient and curvature of the named models, in one job.

    What reaches the driver is the square of a model's number of weights, whatever the number of rows.
    """
    names = list(weights)
    every = sorted({f for s in names for f in sets[s]})
    table = rows.select(F.col(label).cast("int").alias("_y"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(
        f"x{i}") for i, f in enumerate(every)], *[F.coalesce(marks[s], F.lit(False)).alias(f"m{i}") for i, s in enumerate(
            names)])
    plan = [([1 + every.index(f) for f in sets[s]], scale[s], np.array(classes[s]), weights[s]) for s in names]
    marked = 1 + len(every)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(1 + w.size + w.size ** 2) for _, _, _, w in plan]
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for k, (places, middle, known, w) in enumerate(plan):
                mine = columns[marked + k]
                if not mine.any():
                    continue
                spread = np.where(middle[:, 1] > 0, middle[:, 1], np.inf)
                x = np.column_stack([(columns[p][mine] - m) / d for p, (m, _), d in zip(places, middle, spread)] + [
                    np.ones(int(mine.sum()))])
                margin = x @ w.T
                margin -= margin.max(1, keepdims=True)
                p = np.exp(margin)
                whole = p.sum(1, keepdims=True)
                p /= whole
                hit = known[None, :] == columns[0][mine][:, None]
                loss = float((np.log(whole[:, 0]) - margin[hit]).sum())
                joint = (p[:, :, None] * x[:, None, :]).reshape(len(x), -1)
                curvature = -joint.T @ joint
                n = x.shape[1]
                for c in range(len(known)):
                    curvature[c * n:(c + 1) * n, c * n:(c + 1) * n] += (x * p[:, c:c + 1]).T @ x
                total[k] += np.concatenate([[loss], ((p - hit).T @ x).ravel(), curvature.ravel()])
        for k, values in enumerate(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, np.int32)), pa.array(np.arange(
                len(values), dtype=np.int32)), pa.array(values)], ["k", "at", "value"])

    parts = table.mapInArrow(run, "k int, at int, value double").groupBy("k", "at").agg(F.sum("value").alias("value"))
    out = [np.zeros(1 + w.size + w.size ** 2) for w in weights.values()]
    for k, at, value in parts.collect():
        out[k][at] = value
    return {s: (float(v[0]), v[1:1 + weights[s].size], v[1 + weights[s].size:].reshape(weights[s].size, -1))
            for s, v in zip(names, out)}


def fit_sets(rows: DataFrame, sets: Mapping[str, Seq[str]], label: str, marks: Mapping[str, Column],
             passes: int = 100) -> dict[str, Linear]:
    """One model per feature set, on its training rows: those for which its mark is true.

    Features are scaled to mean 0 and population deviation 1; the penalty is half the squared weights over all rows,
    without the intercepts. ``rows`` is read once per pass and should be stored. Features of marked rows must not be
    null; a feature of one value gets no weight. Labels are small integers; classes that a set's training rows lack
    are never predicted, and a set without training rows predicts null.
    """
    labels = rows.groupBy(label).agg(*[F.count_if(F.coalesce(marks[s], F.lit(False))).alias(f"n{i}") for i, s in enumerate(
        sets)]).collect()
    classes = {s: sorted(int(r[label]) for r in labels if r[label] is not None and r[f"n{i}"]) for i, s in enumerate(sets)}
    marks = {s: marks[s] & F.col(label).isNotNull() for s in sets}
    scale = scales(rows, sets, marks)
    searches = {s: Search(len(fs), len(classes[s])) for s, fs in sets.items()}
    for _ in range(passes):
        open_ = {s: search.trial() for s, search in searches.items() if not search.done}
        if not open_:
            break
        for s, sums in summed(rows, sets, label, marks, scale, classes, open_).items():
            searches[s].told(*sums)
    out = {}
    for s, fs in sets.items():
        w = searches[s].trial()
        middle, spread = scale[s][:, 0], scale[s][:, 1]
        raw = np.where(spread > 0, w[:, :-1] / np.where(spread > 0, spread, 1.0), 0.0)
        out[s] = Linear(tuple(fs), tuple(classes[s]), np.column_stack([raw, w[:, -1] - raw @ middle]))
    return out


def score_sets(rows: DataFrame, models: Mapping[str, Linear], label: str, tests: Mapping[str, Column]) -> DataFrame:
    """Rows (model, n, correct, accuracy): every model on its own test rows, in one aggregate."""
    sums = []
    for s, model in models.items():
        here = F.coalesce(tests[s], F.lit(False))
        sums.append(F.struct(F.lit(s).alias("model"), F.count_if(here).alias("n"), F.count_if(
            here & (model.prediction() == F.col(label))).alias("correct")))
    one = rows.agg(F.array(*sums).alias("all")).select(F.explode("all").alias("s")).select("s.*")
    return one.withColumn("accuracy", F.try_divide(F.col("correct"), F.col("n")))
