"""Near-duplicate vectors by counting collisions of one-dimensional projections."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.base import named, query, table
from tickloom.llm.components import components
from tickloom.storage import stored

COSINE = 0.98
BLOCK_ROWS = 256
NUMBERS = ("key", "x", "y", "side", "table", "id", "copies", "salt", "value")


@dataclass(frozen=True)
class Projections:
    """``tables`` groups of random directions: ``dims`` to deal vectors into cells, one more to sort each cell by.

    Two vectors collide in a table when they share its cell and the sorted values differ by ``window`` at most, which
    is a window centred at either. ``least`` collisions make a pair worth verifying. For unit vectors at an angle with
    cosine c, differences are normal with deviation sqrt(2 - 2c): that fixes the chance of a collision, and with it
    the recall of the count.
    """

    tables: int = 80
    dims: int = 10
    width: float = 1.0
    window: float = 0.4
    least: int = 2

    def directions(self, size: int) -> np.ndarray:
        """size x (tables * (dims + 1)): the cell directions of all tables, then the sorted ones."""
        return np.random.default_rng(11).standard_normal((size, self.tables * (self.dims + 1)))

    def place(self, unit: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell keys and sorted values, each vectors x tables. ``salt`` (a number per vector) parts the labels."""
        values = unit @ self.directions(unit.shape[1])
        rng = np.random.default_rng(13)
        shift = rng.random(self.tables * self.dims)
        mult = rng.integers(0, 2 ** 64, (self.tables, self.dims), np.uint64) | np.uint64(1)
        cells = np.floor(values[:, :self.tables * self.dims] / self.width + shift).astype(np.int64).view(np.uint64)
        keys = (cells.reshape(len(unit), self.tables, self.dims) * mult).sum(2, dtype=np.uint64)
        keys += np.arange(1, self.tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= salt.view(np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93)
        keys = (keys ^ (keys >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (keys ^ (keys >> np.uint64(32))).view(np.int64), values[:, self.tables * self.dims:]

    def recall(self, cosine: float = COSINE, draws: int = 20_000) -> float:
        """Chance that a pair with this cosine reaches ``least`` collisions, by drawing the differences."""
        rng = np.random.default_rng(17)
        near = np.sqrt(2 - 2 * cosine)
        same = np.maximum(0, 1 - np.abs(rng.standard_normal(draws)) * near / self.width).mean() ** self.dims
        p = same * (np.abs(rng.standard_normal(draws)) * near <= self.window).mean()
        n = self.tables
        fewer, term = 0.0, (1 - p) ** n
        for k in range(self.least):
            fewer += term
            term *= (n - k) / (k + 1) * p / (1 - p)
        return 1 - fewer


def vectors_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """Arrays of one length as a matrix."""
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def by_size(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose arrays have one length."""
    sizes = pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        yield batch.filter(pa.array(sizes == n))


def celled(classes: DataFrame, how: Projections) -> DataFrame:
    """Rows (id, salt, table, key, value): one per vector and table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "embedding"):
                keys, values = how.place(unit(vectors_of(batch, "embedding")), batch["salt"].to_numpy())
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(batch["id"].to_numpy(), how.tables)),
                     pa.array(np.tile(np.arange(how.tables, dtype=np.int32), n)), pa.array(keys.ravel()),
                     pa.array(values.ravel())], ["id", "table", "key", "value"])

    return classes.select("id", "salt", "embedding").mapInArrow(run, "id long, table int, key long, value double")


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of these edges a spanning forest keeps."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep[k] = True
    return keep


def compared(dealt: DataFrame, how: Projections, cosine: float) -> DataFrame:
    """Rows (a, b, links): ``links`` vectors found linked to ``a``, or, where ``b`` is not null, an edge for components.

    ``dealt`` has rows (key, x, y, side, table, id, copies, value, salt, embedding), sorted by key, block pair (x, y)
    and value. The collisions of a pair are counted over all tables in the first one in which it collides, so meeting
    again changes nothing; only pairs that reach the count are verified.
    """
    def block(part: dict[str, np.ndarray], lo: int, hi: int, out: list) -> None:
        same = part["x"][lo] == part["y"][lo]
        here = np.arange(lo, hi)
        left = here if same else here[part["side"][lo:hi] == 0]
        right = here if same else here[part["side"][lo:hi] == 1]
        if len(left) == 0 or len(right) == 0 or (same and len(left) < 2):
            return
        values = part["value"]
        first = np.searchsorted(values[right], values[left] - how.window, side="left")
        last = np.searchsorted(values[right], values[left] + how.window, side="right")
        a = np.repeat(left, last - first)
        if not len(a):
            return
        run = np.arange(len(a)) - np.repeat(np.cumsum(last - first) - (last - first), last - first)
        b = right[np.repeat(first, last - first) + run]
        if same:
            a, b = a[a < b], b[a < b]
        for at in range(0, len(a), 20_000):
            p, q = a[at:at + 20_000], b[at:at + 20_000]
            hit = (part["keys"][p] == part["keys"][q]) & (
                np.abs(part["values"][p] - part["values"][q]) <= how.window)
            counted = (hit.sum(1) >= how.least) & (hit.argmax(1) == part["table"][p])
            p, q = p[counted], q[counted]
            mine = np.einsum("ij,ij->i", part["unit"][p], part["unit"][q]) >= cosine
            out.append((p[mine], q[mine]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            fresh = pa.Table.from_batches([batch])
            held = fresh if held is None else pa.concat_tables([held, fresh])
            group = np.column_stack([held["key"].to_numpy(), held["x"].to_numpy(), held["y"].to_numpy()])
            edges = np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1
            if len(edges):
                yield from finished(held.slice(0, int(edges[-1])))
                held = held.slice(int(edges[-1]))
        if held is not None and held.num_rows:
            yield from finished(held)

    def finished(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for whole in rows.combine_chunks().to_batches():
            for batch in by_size(whole, "embedding"):
                part = {c: batch[c].to_numpy() for c in NUMBERS}
                part["unit"] = unit(vectors_of(batch, "embedding"))
                part["keys"], part["values"] = how.place(part["unit"], part["salt"])
                group = np.column_stack([part["key"], part["x"], part["y"]])
                bounds = np.concatenate([[0], np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1, [len(group)]])
                out: list[tuple[np.ndarray, np.ndarray]] = []
                for lo, hi in zip(bounds[:-1], bounds[1:]):
                    block(part, lo, hi, out)
                if not out:
                    continue
                p, q = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
                ids, copies = part["id"], part["copies"]
                links = np.bincount(np.concatenate([p, q]), np.concatenate([copies[q], copies[p]]), len(ids))
                some = np.flatnonzero(links)
                tree = forest(ids[p], ids[q])
                a = np.concatenate([ids[some], ids[p][tree]])
                b = pa.array(np.concatenate([np.zeros(len(some), np.int64), ids[q][tree]]),
                             mask=np.arange(len(a)) < len(some))
                n = np.concatenate([links[some].astype(np.int64), np.zeros(int(tree.sum()), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(n)], ["a", "b", "links"])

    return dealt.mapInArrow(run, "a long, b long, links long")


def near_vectors(rows: DataFrame, cosine: float = COSINE, how: Projections | None = None, id_col: str = "vec_id",
                 vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per input row: links join vectors of one label and one length
    with at least this cosine.

    Equal vectors of a label become one class with a number of copies. Every class is projected on random directions
    (see ``Projections``) and meets, in each table, the vectors in a window around it in its sorted cell. Pairs with
    enough collisions are verified with the exact cosine; 0.99998 of the pairs just at 0.98 get there with the
    defaults (``Projections.recall``), nearer ones more often. A cell of more than BLOCK_ROWS classes is
    cut into blocks by hash, and pairs of blocks are separate groups, so no group of unbounded size is in one task and
    pairs are never emitted: a task returns the number of links per vector and a spanning forest.

    Vectors that are null, empty, zero, or hold null or non-finite components, rows without a label, and rows without
    an id link with nothing: no links, own component. Rows repeated with one id are one node and are linked to each
    other as any two vectors are. Other columns are ignored; an empty table gives no rows.
    """
    how = how or Projections()
    given = rows.select(named(id_col).cast("long").alias("vec_id"), named(vector_col).alias("embedding"), named(
        label_col).alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull() & F.col(
        "vec_id").isNotNull(), F.lit(False))
    # Adding 0.0 makes a negative zero equal to zero.
    even = F.transform("embedding", lambda x: x + F.lit(0.0).cast("float"))
    given = stored(given.select("vec_id", F.when(usable, even).alias("embedding"), F.when(usable, F.xxhash64(
        F.col("label").cast("string"))).alias("salt")))
    classes = stored(given.where("salt IS NOT NULL").groupBy("salt", "embedding").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("copies")))

    cells = stored(celled(classes, how))
    full = cells.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    blocks = F.ceil(F.col("members") / BLOCK_ROWS).cast("int")
    # Cells survive only with two members or more; each row then meets every block of its cell once.
    met = cells.join(full, "key").withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn(
        "against", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", "table", "id", "value", F.least("block", "against").alias("x"), F.greatest(
        "block", "against").alias("y"), (F.col("block") > F.col("against")).cast("int").alias("side"))
    dealt = met.join(classes, "id").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "value")
    found = stored(compared(dealt, how, cosine))

    links = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    reached = components(found.where("b IS NOT NULL").select("a", "b"))
    known = classes.join(links, classes["id"] == links["a"], "left").join(
        reached, F.col("id") == F.col("node"), "left").select(
        "salt", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component"))
    out = given.join(known, ["salt", "embedding"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias(
        "component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


@query("op10_embedding_dedup", sql="""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, p.y FROM r JOIN p ON p.x = r.y),
c AS (SELECT x, min(y) AS component FROM r GROUP BY x), n AS (SELECT x, count(*) AS links FROM p GROUP BY x)
SELECT vec_id, coalesce(links, 0) AS n_links, component AS component_id, vec_id = component AS kept
FROM embeddings JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id""")
def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
