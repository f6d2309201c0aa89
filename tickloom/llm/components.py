"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.storage import stored

CHUNK_EDGES = 1_000_000


def components(edges: DataFrame, rounds: int = 50, chunk: int = CHUNK_EDGES) -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (a, b), component being the smallest node it reaches.

    First every task contracts a chunk of about ``chunk`` edges, whichever they are, to stars. With more than one chunk,
    stars are then merged by alternating large and small stars: every node hands its larger neighbours, then its
    smaller ones, to its smallest. The number of edges never grows and the depth shrinks by a constant factor each
    time. Each round is written to the shared folder, so lineage stays short and lost executors cost one round at
    most. Minima are partial sums; the joins back are plain, so a node with very many edges is split by the
    adaptive skew join. No edges: no rows. Edges may repeat, run either way, or be loops.
    """
    given = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    parts = -(-given.count() // chunk)
    now = stored(given.repartition(max(1, parts)).mapInArrow(stars, "a long, b long"))
    if parts > 1:
        now = merged(now, rounds)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a partition's edges but the smallest of its component, with that smallest."""
    held = [(b["a"].to_numpy(), b["b"].to_numpy()) for b in batches]
    if not held:
        return
    a, b = (np.concatenate(x) for x in zip(*held))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            break
    leaf = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[root[leaf]])], ["a", "b"])


def merged(now: DataFrame, rounds: int) -> DataFrame:
    """Stars of which some share nodes, to stars that share none."""
    mark = fingerprint(now)
    for _ in range(rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = stored(small.union(lowest.select("a", F.col("m").alias("b"))).distinct())
        last, mark = mark, fingerprint(now)
        if mark == last:
            return now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def fingerprint(edges: DataFrame) -> tuple:
    """Count and hash sum of a set of edges: equal for equal sets."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
