"""Small fits on bounded samples, shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.base import named, texts
from tickloom.storage import stored


def remainder(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``: the fold that decides what is held out. A null id is in fold 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts, F.lit(0))


def labelled(labels: DataFrame, label: str, parts: int, held_out: int, rows: int) -> DataFrame:
    """At most ``rows`` (doc_id, label) outside the held-out fold, in the order of a hash of the id.

    Null ids and labels do not count; a document labelled more than once counts as 1 if any label is.
    """
    known = labels.select(named("doc_id").cast("long").alias("doc_id"), named(label).cast("int").alias("label")).where(
        "doc_id IS NOT NULL AND label IS NOT NULL")
    once = known.where(remainder(F.col("doc_id"), parts) != held_out).groupBy("doc_id").agg(
        F.max("label").alias("label"))
    return once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def training_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Stored rows (doc_id, text, label), one per chosen id that has a document: of rows repeated under one id the least
    text counts. The documents are read once."""
    both = texts(docs).join(F.broadcast(chosen), "doc_id")
    return stored(both.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Newton steps for an intercept and weights; without both classes the intercept alone says which one there is."""
    full = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(full.shape[1])
    if len(y) == 0 or y.min() == y.max():
        w[0] = -2.0 if len(y) == 0 or y.max() == 0 else 2.0
        return w
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        grad = full.T @ (p - y) + penalty @ w
        hess = (full * (p * (1 - p))[:, None]).T @ full + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def chance(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
