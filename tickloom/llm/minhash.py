"""Near duplicates by min-max hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.base import per_text, query, table, texts
from tickloom.llm.components import components
from tickloom.llm.shingles import shared, shingle_sets
from tickloom.storage import stored

SHINGLE_WORDS = 5
PERMUTATIONS = 48
BAND_ROWS = 4
PERCENT = 80
BLOCK = 512


def signature(h: np.ndarray, bounds: np.ndarray, permutations: int, band_rows: int) -> np.ndarray:
    """Band keys (texts x bands): under each permutation the smallest and the largest value of a set are kept, so one
    evaluation gives two values; ``band_rows`` values make a band. Sets must not be empty."""
    rng = np.random.default_rng(7)
    a = rng.integers(0, 2 ** 64, permutations, np.uint64) | np.uint64(1)
    b = rng.integers(0, 2 ** 64, permutations, np.uint64)
    out = np.zeros((len(bounds) - 1, 2 * permutations), np.uint64)
    for k in range(permutations):
        x = h * a[k] + b[k]
        out[:, 2 * k] = np.minimum.reduceat(x, bounds[:-1])
        out[:, 2 * k + 1] = np.maximum.reduceat(x, bounds[:-1])
    mult = rng.integers(0, 2 ** 64, (2 * permutations // band_rows, band_rows), np.uint64) | np.uint64(1)
    bands = out.reshape(len(out), -1, band_rows) * mult
    return (bands.sum(2, dtype=np.uint64) ^ (bands[:, :, 0] >> np.uint64(29))).view(np.int64)


def measured(rows: DataFrame, words: int, permutations: int, band_rows: int) -> DataFrame:
    """Rows (doc_id, n_shingles, set_hash, bands); set_hash and bands are null for an empty set."""
    def make():
        def emit(ids: list, text: list) -> dict[str, list]:
            h, bounds = shingle_sets(text, words)
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            bands: list = [None] * len(ids)
            hashes: list = [None] * len(ids)
            if len(full):
                keys = signature(h, np.append(bounds[:-1][full], bounds[-1]), permutations, band_rows)
                for k, row in zip(full, keys):
                    bands[k] = row.tolist()
                    hashes[k] = xxhash.xxh3_128_digest(h[bounds[k]:bounds[k + 1]].tobytes())
            return {"doc_id": ids, "n_shingles": sizes.tolist(), "set_hash": hashes, "bands": bands}

        return emit

    return per_text(rows, "doc_id long, n_shingles long, set_hash binary, bands array<long>", make)


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough.

    The pairs of one left side lie together, sorted, after that side's own set, so a set travels once per pair and
    once per left side. A left side with very many pairs is cut into parts by a salt, each with its own copy of the set.
    """
    parts = 64
    salted = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(parts)))
    right = salted.join(sets.withColumnRenamed("id", "b"), "b").select("a", "part", F.col("b").alias("id"), "hashes")
    left = salted.select("a", "part").distinct().join(sets.withColumnRenamed("id", "a"), "a").select(
        "a", "part", F.lit(None).cast("long").alias("id"), "hashes")
    dealt = left.union(right).repartition("a", "part").sortWithinPartitions("a", "part", F.col("id").asc_nulls_first())

    def run(batches):
        mine: np.ndarray | None = None
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for a, b, raw in zip(batch["a"].to_pylist(), batch["id"].to_pylist(), batch["hashes"]):
                own = np.frombuffer(raw.as_buffer(), np.uint64)
                if b is None:
                    mine = own.copy()
                    continue
                both = shared(mine, own)
                if 100 * both >= percent * (len(mine) + len(own) - both):
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
                    percent: int = PERCENT, permutations: int = PERMUTATIONS,
                    band_rows: int = BAND_ROWS) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one per input row.

    Two texts are linked when their sets of ``words``-word shingles have a Jaccard index of ``percent`` or more. Texts
    with equal sets become one class first, so copies cost nothing further. Classes that share a band key are
    candidates, and every link is confirmed on the full sets. With the defaults (48 permutations give 96 values, 24
    bands of 4) a pair at 0.8 is missed with a chance of about 3 in a million.

    Candidates that hang together form a family. The sets of a family of up to BLOCK classes meet in one group, where
    all its links are found. In a larger family every class is first compared with the smallest and with a second
    class of its band keys; then those outside the family's largest component are the queries, and meet all classes of
    the family in blocks of about BLOCK queries. So a large group of near copies costs a few comparisons per class
    and its stragglers, no group of unbounded size is in one task, and no link that could join two components is left
    out. A task returns the links that join components, not all of them.

    Null and empty texts have no shingles and stay alone; a null id stays alone as well. Rows repeated with one id
    are one node. Other columns are ignored; an empty table gives no rows. Component ids are the smallest doc_id.
    """
    rows = texts(docs, id_col, text_col)
    thin = stored(measured(rows, words, permutations, band_rows))
    classes = stored(thin.where("set_hash IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_hash").agg(
        F.min(F.struct("doc_id", "n_shingles", "bands")).alias("m")).select(
        "set_hash", F.col("m.doc_id").alias("id"), F.col("m.n_shingles").alias("n"), F.col("m.bands").alias("bands")))
    keyed = classes.select("id", "n", F.posexplode("bands").alias("band", "value")).select(
        "id", "n", F.xxhash64("band", "value").alias("key"))
    full = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("id", "n")).alias("head"), F.min(
        F.struct(F.xxhash64("id", "key"), "id", "n")).alias("other")).where("members > 1")
    members = stored(keyed.join(full, "key").select(
        "id", "n", F.col("head.id").alias("head"), F.col("head.n").alias("head_n"),
        F.col("other.id").alias("other"), F.col("other.n").alias("other_n")))
    families = stored(components(members.select(F.col("id").alias("a"), F.col("head").alias("b"))).select(
        F.col("node").alias("id"), F.col("component").alias("family")))
    sets = stored(shingle_table(rows.join(families.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"),
                                words).dropDuplicates(["id"]))
    sizes = families.groupBy("family").agg(F.count("*").alias("size"))

    large = sizes.where(F.col("size") > BLOCK).select("family")
    edges = None
    if not large.isEmpty():
        inside = stored(members.join(families.join(large, "family"), "id"))
        pairs = [star(inside, centre, percent) for centre in ("head", "other")]
        edges = stored(linked(stored(pairs[0].union(pairs[1]).distinct()), sets, percent))
        found = components(edges).select(F.col("node").alias("id"), "component")
        families = families.join(found, "id", "left")
    families = stored(families.select("id", "family", (F.coalesce("component", "id") if edges else F.col("id")).alias(
        "component")))
    rest = compared(families, sets, percent)
    found = components(edges.union(rest) if edges else rest).select(F.col("node").alias("id"), "component")

    named_ = classes.join(found, "id", "left").select("set_hash", F.coalesce("component", "id").alias("component"))
    out = thin.join(named_, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def star(members: DataFrame, centre: str, percent: int) -> DataFrame:
    """Distinct pairs (a < b) of each member and the centre of its key whose sizes allow the similarity."""
    fits = 100 * F.least("n", f"{centre}_n") >= percent * F.greatest("n", f"{centre}_n")
    return members.where((F.col("id") != F.col(centre)) & fits).select(
        F.least("id", centre).alias("a"), F.greatest("id", centre).alias("b")).distinct()


def compared(families: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components of a family: queries, in blocks, against all its classes.

    ``families`` has rows (id, family, component). Queries are the classes outside the largest component.
    """
    counts = families.groupBy("family", "component").agg(F.count("*").alias("size"))
    whole = counts.groupBy("family").agg(F.sum("size").alias("all"), F.max(F.struct("size", "component")).alias("m"))
    # In a family without links so far every class but one is a query.
    whole = whole.where("all > m.size").select("family", F.col("m.component").alias("largest"), F.ceil(
        (F.col("all") - F.col("m.size")) / BLOCK).cast("int").alias("blocks"))
    told = families.join(whole, "family")
    asked = told.where("component <> largest").select(
        "family", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"), "id",
        "component")
    every = told.select("family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                        F.lit(1).alias("side"), "id", "component")
    dealt = asked.union(every).join(sets, "id").repartition("family", "block").sortWithinPartitions(
        "family", "block", "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, block = None, None
        for batch in batches:
            out: tuple[list, list] = ([], [])
            columns = [batch[c].to_pylist() for c in ("family", "block", "side", "id", "component")]
            for family, number, side, id_, component, raw in zip(*columns, batch["hashes"]):
                if (family, number) != here:
                    here, block = (family, number), Queries(percent)
                own = np.frombuffer(raw.as_buffer(), np.uint64)
                if side == 0:
                    block.add(id_, component, own)
                else:
                    for q in block.links(component, own):
                        out[0].append(q)
                        out[1].append(id_)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


class Queries:
    """The sets of a block of queries, as one sorted list of (shingle, query)."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.ids: list[int] = []
        self.components: list[int] = []
        self.sets: list[np.ndarray] = []
        self.index: tuple[np.ndarray, np.ndarray] | None = None
        self.up: dict[int, int] = {}

    def add(self, id_: int, component: int, own: np.ndarray) -> None:
        self.ids.append(id_)
        self.components.append(component)
        self.sets.append(own.copy())

    def root(self, x: int) -> int:
        while self.up.setdefault(x, x) != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def links(self, component: int, own: np.ndarray) -> list[int]:
        """Queries that this set is linked to and whose component it joins for the first time in this block."""
        if not self.ids:
            return []
        if self.index is None:
            sizes = np.array([len(s) for s in self.sets])
            every, owner = np.concatenate(self.sets), np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(every, kind="stable")
            self.index, self.sizes, self.sets = (every[order], owner[order]), sizes, []
        hashes, owner = self.index
        lo, hi = np.searchsorted(hashes, own, side="left"), np.searchsorted(hashes, own, side="right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(self.ids))
        out = []
        for k in np.flatnonzero(100 * both >= self.percent * (self.sizes + len(own) - both)):
            x, y = self.root(self.components[k]), self.root(component)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                out.append(self.ids[k])
        return out


def shingle_table(rows: DataFrame, words: int) -> DataFrame:
    """Rows (id, hashes): the full sets, as bytes of sorted 64-bit numbers."""
    def make():
        def emit(ids: list, text: list) -> dict[str, list]:
            h, bounds = shingle_sets(text, words)
            return {"id": ids, "hashes": [h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]}

        return emit

    return per_text(rows, "id long, hashes binary", make)


@query("op9_minhash", sql=r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, chr(32))]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], chr(32))) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
b AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b USING (shingle)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL),
p AS (SELECT x, y FROM b JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y
  WHERE 100 * common >= 80 * (i.size + j.size - common)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, p.y FROM r JOIN p ON p.x = r.y),
c AS (SELECT x, min(y) AS component FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.size, 0) AS n_shingles, c.component AS component_id, d.doc_id = c.component AS kept
FROM documents d JOIN c ON c.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""")
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)
