"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.base import per_text, query, table, texts
from tickloom.llm.fit import chance, labelled, logistic, remainder, training_texts

TRAINING_ROWS = 3_000
TRAINING_LINES = 200
FOLDS, HELD_OUT = 5, 0
CUT = 0.3

UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
SIGNS = b"#$%&*|<>{}[]=~^_\\/+@`"
STOPS = b".,;:!?"
SHOUTS = b"!?"
LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
OWN = 14


def line_features(lines: list[str]) -> np.ndarray:
    """One row per line: character classes, words and repetition of this line alone."""
    out = np.zeros((len(lines), OWN))
    seen: set[str] = set()
    for k, line in enumerate(lines):
        raw = line.encode()
        n = len(raw) or 1
        words = line.split()
        count = len(words) or 1
        letters = n - len(raw.translate(None, LETTERS))
        upper = n - len(raw.translate(None, UPPER))
        distinct = len(set(words))
        out[k] = (
            upper / (letters or 1), (n - len(raw.translate(None, SIGNS))) / n,
            (n - len(raw.translate(None, STOPS))) / n,
            (n - len(raw.translate(None, SHOUTS))) / count, (n - len(raw.translate(None, DIGITS))) / n, letters / n,
            1 - distinct / count, min(count, 40) / 40, np.log1p(len(line)) / 8, min(n / count, 30) / 30,
            raw[-1:] in (b".", b"!", b"?", b":"), line[:1].isupper(), line in seen, not words)
        seen.add(line)
    return out


def state_features(own: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Add both neighbours' features and whether there are neighbours; ``bounds`` are the documents' first lines."""
    n = len(own)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    first, last = np.zeros(n), np.zeros(n)
    first[bounds[:-1]] = 1
    last[bounds[1:] - 1] = 1
    before[first == 1] = 0
    after[last == 1] = 0
    return np.column_stack([own, before, after, first, last, np.ones(n)])


def marginals(emit: np.ndarray, trans: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward in the log domain for all documents side by side.

    ``emit``: score of (good - bad) per line; ``trans``: 2 x 2 scores. Gives the chance of good per line,
    the expected number of each transition, and the log normaliser per document.
    """
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    starts, longest = bounds[:-1][order], int(sizes.max(initial=0))
    alive = np.searchsorted(-sizes[order], -np.arange(longest), side="left")  # documents with more than t lines
    e = np.column_stack([np.zeros(len(emit)), emit])
    fwd, back = np.zeros_like(e), np.zeros_like(e)
    for t in range(longest):
        m = alive[t]
        at = starts[:m] + t
        if t == 0:
            fwd[at] = e[at]
        else:
            p = fwd[at - 1]
            fwd[at] = e[at] + np.logaddexp(p[:, :1] + trans[0], p[:, 1:] + trans[1])
    pairs = np.zeros((2, 2))
    ends = bounds[1:] - 1
    total = np.logaddexp(fwd[ends, 0], fwd[ends, 1])
    norm = np.repeat(total, sizes)
    for t in range(longest - 2, -1, -1):
        m = alive[t + 1]
        at = starts[:m] + t
        nxt = e[at + 1] + back[at + 1]
        back[at] = np.logaddexp(trans[:, 0] + nxt[:, :1], trans[:, 1] + nxt[:, 1:])
        joint = fwd[at][:, :, None] + trans + nxt[:, None, :] - norm[at][:, None, None]
        pairs += np.exp(joint).sum(0)
    return np.exp(fwd[:, 1] + back[:, 1] - norm), pairs, total


@dataclass
class LineField:
    """A field over good and bad lines, and the fit from lines to documents."""

    weights: np.ndarray
    trans: np.ndarray
    fit: np.ndarray

    def lines(self, texts_: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chance of good per line, line lengths, and the documents' first lines."""
        split = [t.split("\n") for t in texts_]
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(int)
        own = np.concatenate([line_features(s) for s in split]) if split else np.zeros((0, OWN))
        good, _, _ = marginals(state_features(own, bounds) @ self.weights, self.trans, bounds)
        return good, np.array([len(x) for s in split for x in s], float), bounds


def document_features(good: np.ndarray, lengths: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Length-weighted share of bad text, its amount, and the worst line of each document."""
    bad = np.add.reduceat((1 - good) * lengths, bounds[:-1]) if len(bounds) > 1 else np.zeros(0)
    size = np.add.reduceat(lengths, bounds[:-1]) if len(bounds) > 1 else np.zeros(0)
    worst = np.maximum.reduceat(1 - good, bounds[:-1]) if len(bounds) > 1 else np.zeros(0)
    return np.column_stack([bad / np.maximum(size, 1), np.log1p(bad) / 5, worst])


def train_field(own: np.ndarray, bounds: np.ndarray, document: np.ndarray, rounds: int = 3, steps: int = 100,
                ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by gradient steps on the conditional likelihood.

    Labels belong to documents. All lines of a good document are good. In a bad one the lines that look bad so far
    are bad, at least its worst; at first all are. Labels and field are improved in turn.
    """
    x = state_features(own, bounds)
    sizes = np.diff(bounds)
    line = np.repeat(document, sizes).astype(float)
    weights, trans = logistic(x[:, :-1], line, ridge=1.0), np.zeros((2, 2))
    weights = np.append(weights[1:], weights[0])
    label = line.copy()
    for _ in range(rounds):
        good, _, _ = marginals(x @ weights, trans, bounds)
        label = np.where(line == 1, 1.0, (good >= 0.5).astype(float))
        for d in np.flatnonzero(document == 0):
            at = slice(bounds[d], bounds[d + 1])
            if label[at].min() == 1:
                label[bounds[d] + int(np.argmin(good[at]))] = 0
        inside = np.ones(len(x), bool)
        inside[bounds[:-1]] = False
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[np.flatnonzero(inside) - 1].astype(int), label[inside].astype(int)), 1)
        theta = np.concatenate([weights, trans.ravel()])
        mean, square = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, steps + 1):
            good, pairs, _ = marginals(x @ theta[:-4], theta[-4:].reshape(2, 2), bounds)
            grad = np.concatenate([x.T @ (good - label), (pairs - seen).ravel()]) / len(x) + ridge * theta
            mean = 0.9 * mean + 0.1 * grad
            square = 0.99 * square + 0.01 * grad ** 2
            theta = theta - 0.1 * (mean / (1 - 0.9 ** k)) / (np.sqrt(square / (1 - 0.99 ** k)) + 1e-8)
        weights, trans = theta[:-4], theta[-4:].reshape(2, 2)
    return weights, trans


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, lines: int = TRAINING_LINES) -> LineField:
    """Fit on at most ``rows`` labelled documents (doc_id, quality) outside the held-out fold.

    They are taken in the order of a hash of their id, one row each, as long as their lines together do not exceed
    ``rows`` times ``lines``; so many times 14 numbers bound what reaches the driver, and a document's own length decides
    nothing. Without both labels the field is flat and the score constant.
    """
    chosen = labelled(labels, "quality", FOLDS, HELD_OUT, rows)
    so_far = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    own_lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    sample = training_texts(docs, chosen).withColumn("lines", F.sum(own_lines).over(so_far)).where(
        F.col("lines") <= rows * lines).drop("lines")

    def make():
        def emit(ids: list, text: list) -> dict[str, list]:
            split = [t.split("\n") for t in text]
            return {"doc_id": ids, "own": [line_features(s).astype("f4").tobytes() for s in split],
                    "sizes": [np.array([len(x) for x in s], "f4").tobytes() for s in split]}

        return emit

    found = per_text(sample, "doc_id long, own binary, sizes binary", make).join(
        F.broadcast(sample.select("doc_id", "label")), "doc_id").orderBy("doc_id").collect()
    document = np.array([float(r.label == 1) for r in found])
    width = 3 * OWN + 3
    if not found or document.min() == document.max():
        return LineField(np.zeros(width), np.zeros((2, 2)), logistic(np.zeros((len(found), 3)), document))
    own = np.concatenate([np.frombuffer(r.own, "f4").reshape(-1, OWN) for r in found]).astype(float)
    lengths = np.concatenate([np.frombuffer(r.sizes, "f4") for r in found]).astype(float)
    bounds = np.concatenate([[0], np.cumsum([len(r.sizes) // 4 for r in found])]).astype(int)
    weights, trans = train_field(own, bounds, document)
    good, _, _ = marginals(state_features(own, bounds) @ weights, trans, bounds)
    return LineField(weights, trans, logistic(document_features(good, lengths, bounds), document))


def score_quality(docs: DataFrame, model: LineField, id_col: str = "doc_id", text_col: str = "text",
                  cut: float = CUT) -> DataFrame:
    """Rows (doc_id, score, predicted, good_share), one per input row, nothing shuffled.

    ``score`` is the chance of label 1, ``good_share`` the length-weighted mean of the lines' chances of being good.
    A null or empty text is one empty line. Null ids, repeated rows and other columns are allowed.
    """
    def make():
        def emit(ids: list, text: list) -> dict[str, list]:
            good, lengths, bounds = model.lines(text)
            x = document_features(good, lengths, bounds)
            p = chance(x, model.fit)
            return {"doc_id": ids, "score": p.tolist(), "predicted": (p >= cut).astype(int).tolist(),
                    "good_share": (1 - x[:, 0]).tolist()}

        return emit

    return per_text(texts(docs, id_col, text_col), "doc_id long, score double, predicted int, good_share double", make)


@query("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
                         "predicted", "good_share")
