"""Periodic runs of words, found with an enhanced suffix array."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.base import per_text, query, table, texts

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
PAIRS = 2_000_000
WORD = re.compile("[^\x20\x09-\x0D]+")


def ordered(start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts of the groups of equal numbers in a sorted array, and each entry's group start."""
    first = np.flatnonzero(np.r_[True, start[1:] != start[:-1]])
    return first, np.repeat(first, np.diff(np.r_[first, len(start)]))


def suffix_ranks(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array and, for k = 0, 1, .., the ranks of all positions by their first 2^k symbols.

    Only suffixes that are still tied are sorted again. ``symbols`` must not be equal in two texts that stand
    behind each other, so no tie crosses a text.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int32)
    rank[order] = ordered(symbols[order])[1]
    levels, width = [rank], 1
    tied = np.ones(n, bool)
    while True:
        in_order = rank[order]
        first, group = ordered(in_order)
        size = np.diff(np.r_[first, n])
        tied = np.repeat(size > 1, size)
        if not tied.any():
            return order, levels
        at = np.flatnonzero(tied)
        suffix = order[at]
        after = suffix + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1).astype(np.int64)
        key = group[at].astype(np.int64) * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        order[at] = suffix[by]
        key = key[by]
        # at is in order of groups, so the sorted keys fill the same places; a new group starts at its first place.
        new = np.r_[True, key[1:] != key[:-1]]
        rank = rank.copy()
        rank[order[at]] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        levels.append(rank)
        width *= 2


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """LCP[k]: how many symbols the suffixes at places k - 1 and k of the suffix array have in common; LCP[0] = 0."""
    n = len(order)
    out = np.zeros(n, np.int32)
    k = 1 + np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    a, b = order[k - 1].copy(), order[k].copy()
    for level in range(len(levels) - 1, -1, -1):
        rank = levels[level]
        same = (np.maximum(a, b) < n) & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
        step = same.astype(np.int64) << level
        a, b = a + step, b + step
    out[k] = a - order[k - 1]
    return out


def common_suffixes(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many symbols before position a equal those before b, for every pair."""
    out = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        rank, width = levels[level], 1 << level
        fits = np.minimum(a, b) - out >= width
        x, y = np.where(fits, a - out - width, 0), np.where(fits, b - out - width, 0)
        out += np.where(fits & (rank[x] == rank[y]), width, 0)
    return out


def interval_bounds(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place k in ``at``, where LCP > 0: the first and last place of the part of its LCP interval whose
    children k separates, up to the next k of that interval. Found by jumping over larger values."""
    n = len(lcp)
    left, right = np.arange(n) - 1, np.arange(n) + 1
    padded = np.r_[lcp, -1].astype(np.int64)
    todo = at
    while len(todo):
        todo = todo[padded[left[todo]] >= padded[todo]]
        left[todo] = left[left[todo]]
    todo = at
    while len(todo):
        todo = todo[padded[right[todo]] > padded[todo]]
        right[todo] = right[right[todo]]
    return left[at], right[at] - 1


def branching_squares(order: np.ndarray, lcp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, depth): the words at i .. i + 2 * depth - 1 are a square, and the next word does not prolong it.

    Such a square is two suffixes, i and i + depth, in different children of an LCP interval of that depth. For every
    boundary between children, the suffixes of the smaller side look for i + depth and i - depth on the other side
    by their inverse suffix array entries, so a suffix is asked a logarithmic number of times.
    """
    n = len(order)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    at = np.flatnonzero(lcp > 0)
    low, high = interval_bounds(lcp, at)
    depth = lcp[at].astype(np.int64)
    small_left = at - low <= high - at + 1
    start, stop = np.where(small_left, low, at), np.where(small_left, at, high + 1)
    other, other_stop = np.where(small_left, at, low), np.where(small_left, high + 1, at)
    size = stop - start
    ends = np.cumsum(size)
    begin = 0
    while begin < len(at):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
        part = slice(begin, end)
        many = size[part]
        node = np.repeat(np.arange(begin, end), many)
        place = np.arange(len(node)) - np.repeat(np.cumsum(many) - many, many) + start[node]
        suffix, d = order[place], depth[node]
        for partner in (suffix + d, suffix - d):
            inside = (partner >= 0) & (partner < n)
            where = inverse[np.where(inside, partner, 0)]
            hit = inside & (where >= other[node]) & (where < other_stop[node])
            yield np.minimum(suffix, partner)[hit], d[hit]
        begin = end


def runs_of(symbols: np.ndarray, least_length: int, least_exponent: int) -> np.ndarray:
    """Rows (start, length, period) of the runs, by start and period. Symbols are as for ``suffix_ranks``."""
    none = np.zeros((0, 3), np.int64)
    if len(symbols) < least_length:
        return none
    order, levels = suffix_ranks(symbols)
    lcp = common_prefixes(order, levels)
    found = list(branching_squares(order, lcp))
    if not found:
        return none
    i, period = (np.concatenate(x) for x in zip(*found))
    # Rotating a square to the left as long as the word before it equals its last one leads to the start of its run.
    first = i - common_suffixes(i, i + period, levels)
    end = i + 2 * period
    keep = end - first >= np.maximum(least_length, least_exponent * period)
    first, end, period = first[keep], end[keep], period[keep]
    # Squares of a multiple of the period give the same stretch: the smallest is the period of the run.
    by = np.lexsort((period, end, first))
    first, end, period = first[by], end[by], period[by]
    new = np.r_[True, (first[1:] != first[:-1]) | (end[1:] != end[:-1])][:len(first)]
    out = np.stack([first, end - first, period], 1)[new]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                  least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """Rows (doc_id, n_words, runs, text), one per input row.

    ``runs`` is an array of (start, length, period) in words, by start and period: the stretches whose words a period
    apart are identical, which no neighbouring word extends, of ``least_length`` words and ``least_exponent`` periods
    at least (2 or more). ``text`` has the words that are left when every run keeps its first period only, joined by
    one space. Words are what stands between ASCII white space.

    Texts are independent: nothing is shuffled. Small texts are worked on together; one very long text takes about
    100 bytes a word, and 4 more for each doubling of its longest repeat. Null and empty texts have no words and no
    runs; null ids, repeated rows and other columns make no difference; an empty table gives no rows.
    """
    if least_exponent < 2:
        raise ValueError("a run has two periods at least")

    def make():
        def emit(ids: list, text: list) -> dict[str, list]:
            split = [WORD.findall(t) for t in text]
            number: dict[str, int] = defaultdict()
            number.default_factory = number.__len__
            flat = np.fromiter((number[w] for words in split for w in words), np.int64)
            sizes = np.array([len(words) for words in split], np.int64)
            starts = np.cumsum(sizes) - sizes
            symbols = np.repeat(np.arange(len(split)), sizes) * max(1, len(number)) + flat
            found = runs_of(symbols, least_length, least_exponent)
            owner = np.searchsorted(starts, found[:, 0], "right") - 1
            gone = np.zeros(len(flat) + 1, np.int64)
            np.add.at(gone, found[:, 0] + found[:, 2], 1)
            np.add.at(gone, found[:, 0] + found[:, 1], -1)
            gone = np.cumsum(gone[:-1]) > 0
            found[:, 0] -= starts[owner]
            edges = np.searchsorted(owner, np.arange(len(split) + 1))
            runs, left = [], []
            for k, words in enumerate(split):
                own = found[edges[k]:edges[k + 1]]
                runs.append([dict(zip(("start", "length", "period"), r)) for r in own.tolist()])
                if len(own):
                    stay = ~gone[starts[k]:starts[k] + sizes[k]]
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                left.append(" ".join(words))
            return {"doc_id": ids, "n_words": sizes, "runs": runs, "text": left}

        return emit

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string"
    return per_text(texts(docs, id_col, text_col), schema, make)


def best_run(runs: Column) -> Column:
    """The run of most periods, compared exactly; of equals the one that starts first, then the shortest period."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(runs, none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text) rows; the words of about one text in ten, chosen by its id, repeat with a period from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size("words")
    a = F.expr("pmod(g, size(words))")
    p = F.expr("1 + (size(words) - a) div (3 + g % 8)")
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.element_at("words", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int"))))
    chosen = docs.select("doc_id", "text", h.alias("h"), g.alias("g")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, words)).withColumn("a", F.when(n > 0, a)).withColumn("p", p)
    return chosen.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(again, " ")).otherwise(
        F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(looped(texts(table(spark, sf_dir, "documents")))).withColumn("best", best_run(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
