"""Ranked lexical search of many items at once, their shared term sets evaluated once per document."""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.base import arrow_schema, named, per_text, query, release, table, texts
from tickloom.storage import stored

TOP = 50
# Terms, with repeats over items, that are searched for in one pass over the documents.
BLOCK_TERMS = 200_000
# Pairs of an item with more symbols than this are not mined; the scores are the same.
MINED_SYMBOLS = 400
CELLS = 4_000_000
SCORED = "item_id long, doc_id long, score long"
# Fixed value: bytes that belong to terms, upper case folded to lower; all others part terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


@dataclass
class Sharing:
    """How items are summed: symbols 0 .. len(terms) - 1 are term sets, each further one is the sum of two before it.

    ``terms`` gives the set of every term, ``sums`` the two parts of the further symbols in order, and ``items`` the
    symbols whose sum is the item.
    """
    sets: int
    terms: dict[bytes, int]
    sums: list[tuple[int, int]]
    items: list[list[int]]


def shared_sets(items: list[Iterable[bytes]]) -> Sharing:
    """Mine what items share.

    Terms that occur in the same items are one set. Then the two symbols that occur together in most items
    become a symbol of their own, which takes their place there, until no two occur together in two items: a graph
    whose nodes are evaluated once, however many items need them.
    """
    where = defaultdict(list)
    for k, terms in enumerate(items):
        for t in sorted(set(terms)):
            where[t].append(k)
    groups: dict[tuple[int, ...], int] = {}
    terms = {t: groups.setdefault(tuple(at), len(groups)) for t, at in where.items()}
    holds = [set(at) for at in groups]
    symbols: list[set[int]] = [set() for _ in items]
    for s, at in enumerate(holds):
        for k in at:
            symbols[k].add(s)

    pairs: Counter = Counter()
    for own in symbols:
        common = sorted(s for s in own if len(holds[s]) > 1)
        if len(common) <= MINED_SYMBOLS:
            pairs.update((a, b) for x, a in enumerate(common) for b in common[x + 1:])
    heap = [(-n, p) for p, n in pairs.items() if n > 1]
    heapq.heapify(heap)
    sums: list[tuple[int, int]] = []
    while heap:
        n, (a, b) = heapq.heappop(heap)
        both = holds[a] & holds[b]
        if len(both) < 2:
            continue
        if len(both) < -n:
            heapq.heappush(heap, (-len(both), (a, b)))
            continue
        new = len(holds)
        sums.append((a, b))
        holds.append(both)
        holds[a], holds[b] = holds[a] - both, holds[b] - both
        beside: Counter = Counter()
        for k in both:
            symbols[k] -= {a, b}
            beside.update(s for s in symbols[k] if len(symbols[k]) <= MINED_SYMBOLS)
            symbols[k].add(new)
        for s, m in beside.items():
            if m > 1:
                heapq.heappush(heap, (-m, (s, new)))
    return Sharing(len(groups), terms, sums, [sorted(s) for s in symbols])


class Accumulators:
    """Scores of a block of documents: partial sums of every shared set once, then the items from them."""

    def __init__(self, sharing: Sharing, weight: dict[bytes, int], numbers: list[bytes]) -> None:
        self.sharing = sharing
        self.set_of = np.array([sharing.terms[t] for t in numbers], np.int64)
        self.weight = np.array([weight[t] for t in numbers], np.int64)
        self.items = [np.array(s, np.int64) for s in sharing.items]
        self.size = sharing.sets + len(sharing.sums)

    def scores(self, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Array (items, documents) from postings (document, term number, tf) and the documents' m."""
        parts = np.zeros((self.size, len(m)), np.int64)
        impact = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[owner]))
        np.add.at(parts, (self.set_of[term], owner), impact)
        for k, (a, b) in enumerate(self.sharing.sums, self.sharing.sets):
            np.add(parts[a], parts[b], out=parts[k])
        out = np.zeros((len(self.items), len(m)), np.int64)
        for k, own in enumerate(self.items):
            np.add.reduce(parts[own], axis=0, out=out[k])
        return out


class Best:
    """The best documents of every item so far: highest score, then lowest id."""

    def __init__(self, items: int, top: int) -> None:
        self.top, self.least = top, np.ones(items, np.int64)
        self.rows = [np.zeros(0, np.int64)] * 3
        self.held = 0

    def add(self, scores: np.ndarray, doc_id: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[:, None])
        self.rows = [np.concatenate(x) for x in zip(self.rows, (item, doc_id[doc], scores[item, doc]))]
        if len(self.rows[0]) > 2 * max(self.held, 100_000):
            self.prune()

    def prune(self) -> None:
        item, doc, score = self.rows
        by = np.lexsort((doc, -score, item))
        item, doc, score = item[by], doc[by], score[by]
        first = np.searchsorted(item, np.arange(len(self.least)))
        rank = np.arange(len(item)) - first[item]
        last = rank == self.top - 1
        self.least[item[last]] = score[last]
        keep = rank < self.top
        self.rows = [item[keep], doc[keep], score[keep]]
        self.held = int(keep.sum())


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (item_id, term): the different terms of every item."""
    rows = items.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"))

    def make():
        def emit(ids: list, text: list) -> dict[str, list]:
            found = [(i, t) for i, x in zip(ids, text) for t in set(terms_of(x))]
            return {"item_id": [i for i, _ in found], "term": [t for _, t in found]}
        return emit

    return per_text(rows.where("doc_id IS NOT NULL"), "item_id long, term binary", make).distinct()


def postings(docs: DataFrame, numbers: list[bytes]) -> DataFrame:
    """Rows (doc_id, n, term array<int>, tf array<int>): a document's number of terms, and how often it holds each of
    the numbered ones. Documents without a term have no row."""
    sent = docs.sparkSession.sparkContext.broadcast(numbers)

    def make():
        number = {t: k for k, t in enumerate(sent.value)}

        def emit(ids: list, text: list) -> dict[str, list]:
            out = defaultdict(list, doc_id=[], n=[], term=[], tf=[])
            for i, t in zip(ids, text):
                own = terms_of(t)
                if own:
                    found = Counter(number[w] for w in own if w in number)
                    for name, v in (("doc_id", i), ("n", len(own)), ("term", list(found)), ("tf", list(found.values()))):
                        out[name].append(v)
            return out

        return emit

    return per_text(docs, "doc_id long, n long, term array<int>, tf array<int>", make)


def ranked(docs: DataFrame, items: list[tuple[int, list[bytes]]], top: int) -> DataFrame:
    """Rows (item_id, doc_id, score), the best of every task, for a block of items with their terms."""
    spark = docs.sparkSession
    sharing = shared_sets([terms for _, terms in items])
    numbers = sorted(sharing.terms)
    found = stored(postings(docs, numbers))
    total = found.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    df = {r.term: r.df for r in found.select(F.explode("term").alias("term")).groupBy("term").agg(
        F.count("*").alias("df")).collect()}
    n_docs, n_terms = total.docs, total.terms or 1
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(k, 0) + 1))) for k, t in enumerate(numbers)}
    sent = spark.sparkContext.broadcast((Accumulators(sharing, weight, numbers), [i for i, _ in items]))
    arrow = arrow_schema(spark, SCORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("")
        sums, ids = sent.value
        best = Best(len(ids), top)
        step = max(1, CELLS // (sums.size + len(ids)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                size = part.column("term").value_lengths().to_numpy()
                m = 50 + (50 * part.column("n").to_numpy() * n_docs) // n_terms
                scores = sums.scores(np.repeat(np.arange(len(size)), size),
                                     part.column("term").flatten().to_numpy().astype(np.int64),
                                     part.column("tf").flatten().to_numpy().astype(np.int64), m)
                best.add(scores, part.column("doc_id").to_numpy())
        best.prune()
        item, doc, score = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[item]), pa.array(doc), pa.array(score)],
                                         schema=arrow)

    return found.mapInArrow(run, SCORED)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``top`` best documents of every item, among those with a score above 0.

    Terms are runs of ASCII letters and digits and of other characters beyond ASCII; A-Z count as lower case. The
    score sums, over an item's different terms, floor(1000 * ln((2N + 2) / (2df + 1))) times the term's share of the
    document, all in whole numbers; equal scores come by document id.

    Items are searched for in blocks of about ``block_terms`` terms: whatever their number, only one block is in the
    driver and in the tasks. For a block the documents are read once, and what they hold of the block's terms is stored.
    A task works its documents off in blocks and keeps the best of each item only, so no list of all documents of an
    item or a common term exists anywhere. The tasks' lists are ranked in two steps, so no item is a hot key.

    Null and empty texts have no terms and do not count. Rows with a null id take no part. Documents repeated under one
    id are documents of their own; the rows of one item id are one item. Other columns go. Empty tables give no rows.
    """
    rows = texts(docs, id_col, text_col).where("doc_id IS NOT NULL")
    terms = stored(item_terms(items, item_col, item_text_col))
    blocks = max(1, -(-terms.count() // block_terms))
    found = docs.sparkSession.createDataFrame([], SCORED)
    for block in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        by_item = own.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")).orderBy("item_id")
        items_here = [(r.item_id, [bytes(t) for t in r.terms]) for r in by_item.collect()]
        if items_here:
            found = found.unionByName(ranked(rows, items_here, top))
    best_first = (F.desc("score"), F.asc("doc_id"))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    some = salted.withColumn("place", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*best_first)))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*best_first))
    return some.where(F.col("place") <= top).withColumn("rank", rank).where(F.col("rank") <= top).select(
        "item_id", "rank", "doc_id", "score")


@query("op13_lexical_search", sql=r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+') AS words FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT count(*) AS docs, sum(len(words))::BIGINT AS terms FROM d WHERE len(words) > 0),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term
      FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT doc_id, len(words) AS n, unnest(words) AS term FROM d),
p AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM w WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight
      FROM p, s GROUP BY term),
x AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))
        AS BIGINT) AS score
      FROM i JOIN p USING (term) JOIN f USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
        doc_id, score FROM x WHERE score > 0)
SELECT * FROM r WHERE rank <= 50""")
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
