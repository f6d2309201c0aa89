"""Exact, line, byte-string, near-duplicate text and vector operators against plain versions."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from helpers import SPACE, components, rows, shingle_set
from pyspark.sql import functions as F

from tickloom.llm.components import components as connected
from tickloom.llm.exact import exact_duplicates
from tickloom.llm.lines import deduplicate_lines
from tickloom.llm.minhash import near_duplicates
from tickloom.llm.substrings import remove_repeats
from tickloom.llm.vectors import Projections, near_vectors

DOCS = "doc_id long, text string, kept string, keep_id string, n_lines string"


def documents(spark, pairs):
    """Documents with extra columns named like results."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in pairs], DOCS)


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa mu nu xi pi rho".split())
                    for _ in range(n))


# ---- exact ------------------------------------------------------------------

@pytest.mark.parametrize("digests", [True, False])
def test_exact(spark, digests):
    texts = ["a b", "a  b", "a\tb ", "a b ", "", None, "  ", " ", "\n", "x" * 3000, "x" * 2999 + "y", "x" * 3000, "a\xa0b"]
    pairs = [(k * 3 + 1, t) for k, t in enumerate(texts)] + [(None, "a b"), (None, "only"), (1, "a b")]
    got = exact_duplicates(documents(spark, pairs), digests=digests)
    groups = {}
    for i, t in pairs:
        groups.setdefault(re.sub(SPACE, " ", t or ""), []).append(i)
    want = []
    for i, t in pairs:
        even = re.sub(SPACE, " ", t or "")
        known = [x for x in groups[even] if x is not None]
        keep = min(known) if known else None
        row = (i, keep, len(groups[even]), i == keep)
        want.append((*row, hashlib.sha256(even.encode()).hexdigest()) if digests else row)
    names = ["doc_id", "keep_id", "group_size", "kept"] + ["text_sha256"] * digests
    assert got.columns == names
    assert rows(got, *names) == sorted(want, key=repr)
    assert exact_duplicates(documents(spark, []), digests=digests).count() == 0


# ---- lines ------------------------------------------------------------------

def test_lines(spark):
    pairs = [(1, "a\nb\nc\nd"), (2, "x\na \n\n b\nc\nd\ny"), (3, "a\nb"), (4, "q\nq\nq\nq\nq\nq\nq"), (5, None), (6, ""),
             (7, "\n\na\nb\nc\n\nz"), (None, "a\nb\nc"), (8, "a\nb\nc")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in deduplicate_lines(
        documents(spark, pairs), counts=True).collect()}
    # Windows a b c and b c d of document 2 overlap; the blank line goes with the line before it.
    assert got[1] == ("a\nb\nc\nd", 4, 0) and got[2] == ("x\ny", 6, 4) and got[3] == ("a\nb", 2, 0)
    assert got[4] == ("q\nq\nq", 7, 4)  # windows 1 and 2 overlap the first one
    assert got[5] == (None, 0, 0) and got[6] == ("", 0, 0) and got[7] == ("\n\nz", 4, 3)
    assert got[None] == ("a\nb\nc", 3, 0) and got[8] == ("", 3, 3)
    assert deduplicate_lines(documents(spark, [])).count() == 0
    assert deduplicate_lines(documents(spark, pairs)).columns == documents(spark, []).columns


# ---- byte strings -----------------------------------------------------------

def repeats(pairs, length=50):
    data = sorted((i, (t or "").encode()) for i, t in pairs if i is not None)
    first = {}
    for i, b in data:
        for k in range(len(b) - length + 1):
            first.setdefault(b[k:k + length], i)
    out = {}
    for i, b in data:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if first[b[k:k + length]] < i:
                gone[k:k + length] = [True] * length
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", range(3))
def test_byte_strings(spark, seed):
    rng = random.Random(seed)
    base = [prose(rng, 60) for _ in range(6)] + ["é" * 40 + prose(rng, 20), "z" * 300, "ab" * 100]
    pairs = []
    for i in range(40):
        parts = []
        for _ in range(rng.randint(0, 4)):
            t = rng.choice(base)
            a = rng.randrange(len(t))
            parts.append(t[a:a + rng.randint(20, 120)])
        pairs.append((i, rng.choice(["", " ", "#"]).join(parts) + rng.choice(["", prose(rng, 9)])))
    pairs += [(40, None), (41, ""), (42, "q" * 49), (43, "q" * 50), (44, "q" * 50)]
    got = {r.doc_id: tuple(r)[1:] for r in remove_repeats(documents(spark, pairs)).collect()}
    assert got == repeats(pairs)


def test_byte_strings_edges(spark, monkeypatch):
    text = "the quick brown fox jumps over the lazy dog and runs far away from it"
    frame = documents(spark, [(None, text), (5, text), (5, text), (9, text)])
    got = rows(remove_repeats(frame, with_bytes=True), "doc_id", "n_removed", "kept")
    assert got == sorted([(None, 0, text.encode()), (5, 0, text.encode()), (5, 0, text.encode()), (
        9, len(text), b"")], key=repr)
    assert remove_repeats(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(frame, length=20)


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (found.apply(k).getName() for k in range(found.size())) if name.startswith("shuffle_")}


def test_anchors_leave_the_disk_and_texts_travel_once(spark):
    rng = random.Random(5)
    common = prose(rng, 30)
    pairs = [(i, prose(rng, 20) + common[i:] * (i % 3)) for i in range(30)] + [(30, None), (None, common)]
    frame = documents(spark, pairs)
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffle_files(spark)
        result = remove_repeats(frame)
        # The positions are judged by now; their shuffle, the largest of the query, is not kept for the rest of it.
        for _ in range(50):
            if not (left := shuffle_files(spark) - before):
                break
            time.sleep(0.1)
        assert not left
        got = {r.doc_id: tuple(r)[1:] for r in result.collect() if r.doc_id is not None}
        assert got == repeats(pairs) and any(removed for _, removed, _, _ in got.values())
        assert "ReusedExchange" in result._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)


def test_buffers_are_bounded_by_the_segment(monkeypatch):
    from tickloom.llm import substrings

    # Places of 10 bits: positions beyond the first 1,024 bytes of one buffer would not fit.
    monkeypatch.setattr(substrings, "SEGMENT", 600)
    monkeypatch.setattr(substrings, "PLACE_BITS", 10)
    sizes, whole = [], substrings.cells
    monkeypatch.setattr(substrings, "cells", lambda parts, n: sizes.append(sum(map(len, parts))) or whole(parts, n))
    rng = random.Random(8)
    texts = [prose(rng, n) for n in (900, 3, 40, 20, 700, 0)]
    made = substrings.segments(list(range(6)), texts, 50)
    found = substrings.cells_in_groups(made[2], 50)
    assert max(sizes) <= 600 + 49 and len(sizes) > 10
    starts = sorted((made[0][k], made[1][k] + a + j) for k, a, n in zip(found["part"], found["a"], found["n"]) for j in range(n))
    assert starts == [(k, j) for k, t in enumerate(texts) for j in range(len(t) - 49)]


def test_a_side_whose_hash_is_zero_is_in_the_cell():
    from tickloom.llm import substrings

    # Random texts of one string each: about one side in 16,384 has 14 zero bits.
    rng = np.random.default_rng(7)
    parts = [bytes(row) for row in rng.integers(97, 123, (60_000, 50), np.uint8)]
    found, buf = substrings.cells(parts, 50), substrings.Buffer(parts, 50)
    anchor, side = found["part"] * 50 + found["a"], 17
    grams = substrings.doubled(buf.data, 16) >> np.uint64(24)
    at = np.array([a + np.flatnonzero(grams[a:a + 35] == np.uint64(g))[0] for a, g in zip(anchor, found["gram"])])
    zeros = 0
    for name, there, hashes in (("left", at - anchor >= side, buf.hashes(np.maximum(at - side, 0), at + 16)),
                                ("right", at - anchor <= side, buf.hashes(at, at + 16 + side))):
        zeros += int((there & (hashes >> np.uint64(50) == 0)).sum())
        assert ((found[name] != 0) == there).all()
    assert zeros


def test_long_texts_are_cut_in_segments(monkeypatch):
    from tickloom.llm import substrings

    rng = random.Random(1)
    text = prose(rng, 300)
    monkeypatch.setattr(substrings, "SEGMENT", 100)
    owner, shift, parts = substrings.segments([7], [text], 50)
    found = substrings.cells(parts, 50)
    starts = sorted(a + shift[p] + k for p, a, n in zip(found["part"], found["a"], found["n"]) for k in range(n))
    assert starts == list(range(len(text) - 49))


# ---- near duplicates --------------------------------------------------------

@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, width):
    rng = random.Random(width)
    pairs = []
    for _ in range(12):
        words = prose(rng, rng.randint(1, 90)).split()
        for _ in range(rng.randint(1, 9)):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(["one", "two", "three"])
            pairs.append((len(pairs), rng.choice([" ", "  ", "\n"]).join(copy)))
    pairs += [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one  TWO"), (905, "one"), (905, "one")]
    sets = {i: shingle_set(t, width) for i, t in pairs}

    def linked(a, b):
        both, any_ = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        return bool(sets[a]) and bool(sets[b]) and 100 * both >= 80 * any_

    want = components(sets, linked)
    got = near_duplicates(documents(spark, pairs), words=width)
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(
        ((i, len(sets[i]), want[i], want[i] == i) for i, _ in pairs), key=repr)
    assert near_duplicates(documents(spark, [])).count() == 0
    assert rows(near_duplicates(documents(spark, [(None, "a b c d e f")] * 2)), "component_id", "kept") == [
        (None, True)] * 2


@pytest.mark.parametrize("block", [512, 16])
def test_large_group_of_near_copies(spark, monkeypatch, block):
    """Hundreds of copies that mostly match only the original, which is not the smallest; with a small block they are
    more than one group."""
    from tickloom.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(100)]
    pairs = []
    for k in range(300):
        copy = list(words)
        for at in rng.sample(range(100), 3 if k != 150 else 0):
            copy[at] = f"e{k}_{at}"
        pairs.append((k, " ".join(copy)))
    sets = {i: shingle_set(t, 4) for i, t in pairs}
    want = components(sets, lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert dict(rows(near_duplicates(documents(spark, pairs), words=4), "doc_id", "component_id")) == want


@pytest.mark.parametrize("chunk", [10 ** 6, 60])
def test_components(spark, chunk):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1100)]
    edges += [(5000, k) for k in range(4000, 4200)]
    nodes = sorted({n for e in edges for n in e if e[0] != e[1]})
    near = {frozenset(e) for e in edges}
    got = rows(connected(spark.createDataFrame(edges, "a long, b long"), chunk=chunk), "node", "component")
    assert len(got) == len(nodes)
    got = dict(got)
    assert got == components(nodes, lambda a, b: frozenset((a, b)) in near)
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- vectors ----------------------------------------------------------------

def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    made = []
    for c in range(60):
        centre = rng.standard_normal(24)
        for _ in range(rng.integers(1, 12)):
            made.append((len(made), (centre + rng.standard_normal(24) * rng.choice([0.02, 0.1, 0.15])).astype("f4"),
                         c % 3))
    made += [(len(made) + k, made[k][1] * np.float32(2), made[k][2]) for k in range(5)]
    made += [(len(made) + k, made[7][1], made[7][2]) for k in range(4)]
    data = [(i, v.tolist(), int(l), "n", "c") for i, v, l in made]
    odd = [(9001, None, 1), (9002, [0.0] * 24, 1), (9003, [float("nan")] * 24, 1), (9004, [None] * 24, 1), (9005, [], 1),
           (9006, data[0][1], None), (9007, [float("inf")] + [0.0] * 23, 1), (9008, [1.0, 0.0], 1), (9009, [
               1.0, 0.0], 1), (9010, [-0.0, 0.0], 1), (None, data[0][1], 0)]
    frame = spark.createDataFrame(data + [(*o, "n", "c") for o in odd],
                                  "vec_id long, embedding array<float>, label int, n_links string, component_id string")
    x = np.array([v for _, v, _ in made], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    labels = np.array([l for _, _, l in made])
    near = (x @ x.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    comp = components(range(len(made)), lambda a, b: near[a, b])
    want = [(i, int(near[i].sum()), comp[i], comp[i] == i) for i in range(len(made))]
    want += [(i, 0, i, True) for i, *_ in odd if i not in (9008, 9009)] + [(9008, 1, 9008, True), (9009, 1, 9008, False)]
    got = near_vectors(frame)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert rows(got, *got.columns) == sorted(want, key=repr)
    assert near_vectors(frame.where("false")).count() == 0


def test_cells_in_blocks(spark, monkeypatch):
    """One tight group larger than a block: every link counts once, across blocks and tables."""
    from tickloom.llm import vectors

    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(6)
    x = (rng.standard_normal(16) + 0.03 * rng.standard_normal((120, 16))).astype("f4")
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)],
                                  "vec_id long, embedding array<float>, label int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = (u @ u.T >= 0.98).sum(1) - 1
    got = near_vectors(frame)
    assert rows(got, "vec_id", "n_links", "component_id") == sorted(((i, int(n), 0) for i, n in enumerate(near)), key=repr)
    assert Projections().recall() > 0.9999
    assert got.agg(F.sum("n_links")).first()[0] == near.sum()
