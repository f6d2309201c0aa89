"""Tokenising, packing, and the solver behind the packing."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import rows
from tokenizers import Tokenizer

from tickloom.llm import bins, byte_bpe, packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "  two  spaces ", "don't I'M 'S it's", "é É́ x", "a\x1cb c", "İstanbul ŉ ǆ ß ﬁ", "漢字 かな",
       "<|endoftext|> a", "<|x", "x" * 500, "🙂 👩‍👩‍👧 \U0001F9E0", "a1b2 3.14 +49-30 $5", "tab\tline\nend\r\n", "ª º ² ŀ"]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "n", 0) for k, t in enumerate(texts)],
                                 "doc_id long, text string, n_tokens string, length int")


def long_text(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(["word", "Ünï", " ", "  ", "\n", "12", "'s", "!?", "漢", "\t", "🙂"]) for _ in range(n))


def test_byte_bpe(spark):
    texts = [*ODD, long_text(1, 30_000), "x " * 30_000, " " * 30_000, "y" * 25_000]
    ranks = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    assert isinstance(ranks, tiktoken.Encoding)
    want = []
    for k, t in enumerate(texts):
        ids = ranks.encode_ordinary(t or "")
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(
            (t or "").encode()).hexdigest()))
    got = byte_bpe.round_trip(frame(spark, texts), RANKS)
    assert rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    back = byte_bpe.decode_rows(byte_bpe.encode_rows(frame(spark, texts), RANKS), RANKS)
    assert {r.doc_id: bytes(r.bytes) for r in back.collect()} == {k: (t or "").encode() for k, t in enumerate(texts)}
    assert byte_bpe.round_trip(frame(spark, []), RANKS).count() == 0


def test_chunks_join_to_the_text():
    text = long_text(2, 5_000)
    parts = byte_bpe.chunks(text, 100)
    assert "".join(parts) == text and len(parts) > 10


def test_word_tokens_equal_the_library():
    whole, mine = Tokenizer.from_file(WORDS), packing.WordTokens(WORDS)
    for t in [*ODD, long_text(3, 3_000)] * 2:
        ids = whole.encode(t or "", add_special_tokens=False).ids
        assert mine(t or "") == np.array(ids, "<u4").tobytes(), t


def test_a_batch_encodes_each_part_once():
    tokens, asked = packing.WordTokens(WORDS), []
    make = tokens.parts.make
    tokens.parts.make = lambda parts: asked.extend(parts) or make(parts)
    texts = [f"Word, WORD. word{k % 3} 漢字 {'ünder' * (k % 2)}Word" for k in range(100)]
    got = tokens.batch(texts)
    again = len(asked)
    assert len(set(asked)) == again and tokens.batch(texts) == got and len(asked) == again
    whole = Tokenizer.from_file(WORDS)
    for t, raw in zip(texts, got):
        assert raw == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


@pytest.mark.parametrize("at_once", [3, 200_000])
def test_batches_equal_the_library(monkeypatch, at_once):
    monkeypatch.setattr(packing, "WORDS_AT_ONCE", at_once)
    monkeypatch.setattr(packing, "CACHED_PARTS", 5 * at_once)
    whole, tokens, draw = Tokenizer.from_file(WORDS), packing.WordTokens(WORDS), random.Random(4)
    letters = [chr(c) for c in range(0x250)]
    marks = list(" \n\t\r'sStTmMlLdD<|>") * 6 + ["\u0301", "\u0307", "\u212a", "\u2009", "\u3000", "Σ", "漢", "🙂"]
    drawn = [["".join(draw.choices(letters + marks, k=draw.randrange(60))) for _ in range(20)] for _ in range(60)]
    for texts in [[f"a{c}B" for c in letters], [f"{c}'S" for c in letters], [], ["", " ", "<|endoftext|> x", "<|"],
                  *drawn]:
        got = tokens.batch(texts)
        assert len(got) == len(texts) and len(tokens.parts.new) <= 5 * at_once
        for t, raw in zip(texts, got):
            assert raw == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


@pytest.mark.parametrize("capacity", [16, 4096])
def test_packing(spark, capacity):
    texts = [*ODD, *[long_text(k, k * 9) for k in range(60)], *["same words here"] * 40]
    got = packing.best_fit_packing(frame(spark, texts), WORDS, capacity, with_ids=True).collect()
    whole = Tokenizer.from_file(WORDS)
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.length == len(r.ids) // 4 <= capacity
    for k, t in enumerate(texts):
        parts = sorted(by_doc[k], key=lambda r: r.piece)
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert b"".join(bytes(r.ids) for r in parts) == ids.tobytes()
        assert [r.piece for r in parts] == list(range(-(-len(ids) // capacity)))
        assert [r.start for r in parts] == [p * capacity for p in range(len(parts))]
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // capacity) * 1.1 + 1
    assert packing.best_fit_packing(frame(spark, []), WORDS).count() == 0


def test_repeated_rows_get_places_of_their_own(spark):
    docs = spark.createDataFrame([(1, "one two")] * 7 + [(None, "one two")] * 2, "doc_id long, text string")
    got = packing.best_fit_packing(docs, WORDS, 8).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 9


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(k, room):
        if len(room) >= best[0]:
            return
        if k == len(items):
            best[0] = len(room)
            return
        for j in {r: j for j, r in enumerate(room) if r >= items[k]}.values():
            place(k + 1, [*room[:j], room[j] - items[k], *room[j + 1:]])
        place(k + 1, [*room, capacity - items[k]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_bin_completion_finds_the_optimum(seed):
    rng = np.random.default_rng(seed)
    items = rng.integers(1, 21, 11)
    plan, bound = bins.pack(np.bincount(items, minlength=21), 20)
    used = sum(times for _, times in plan)
    dealt = np.bincount([x for way, times in plan for x in way * times], minlength=21)
    assert (dealt == np.bincount(items, minlength=21)).all() and all(sum(way) <= 20 for way, _ in plan)
    assert bound <= optimum(items.tolist(), 20) == used


def test_bin_completion_beats_best_fit():
    counts = np.zeros(101, int)
    counts[[50, 47, 42, 8, 6, 3, 2]] = 6
    plan, bound = bins.pack(counts, 100)
    assert bound <= sum(t for _, t in plan) <= sum(t for _, t in bins.best_fit(counts, 100))
    many = np.bincount(np.clip(np.random.default_rng(1).lognormal(6.5, 1, 50_000), 1, 4096).astype(int), minlength=4097)
    plan, bound = bins.pack(many, 4096)
    assert sum(t for _, t in plan) <= bound + 2
    assert bins.pack(np.zeros(11, int), 10) == ([], 0)


def test_dominance():
    assert bins.dominates((9,), (5, 4)) and bins.dominates((9, 3), (3, 3, 3)) and not bins.dominates((5, 5), (6, 3))


@pytest.mark.parametrize("seed", [0, 1])
def test_exact_triples_are_packed_nearly_without_waste(seed):
    draw, items = np.random.default_rng(seed), []
    for _ in range(100):
        a = draw.integers(380, 490)
        b = draw.integers(250, (1000 - a) // 2 + 1)
        items += [a, b, 1000 - a - b]
    counts = np.bincount(items, minlength=1001)
    plan, bound = bins.pack(counts, 1000)
    used = sum(np.bincount(way, minlength=1001) * times for way, times in plan)
    assert (used == counts).all() and max(sum(way) for way, _ in plan) <= 1000
    assert bound == 100 and sum(times for _, times in plan) <= 101


def test_a_filling_without_waste_is_found():
    counts = np.zeros(4097, int)
    counts[[1400, 1300, 1296, *range(941, 1001)]] = 1
    ways = bins.fillings(bins.Lengths(counts), 4096 - 1500, 4, 60)
    assert sum(ways[0]) == 2596 and bins.fillings(bins.Lengths(np.zeros(11, int)), 10, 4, 60) == [()]
