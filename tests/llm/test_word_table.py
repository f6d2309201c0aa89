"""Byte-level BPE by distinct words against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from helpers import rows
from tokenizers import Tokenizer

from tickloom.llm import word_table

FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "  two  spaces ", "don't I'M 'S it's we'll 'lla", "é É́ x", "a\x1cb c\x85d\xa0e \x1f x", "İ ŉ ǆ ß ﬁ",
       "漢字 かな。漢字、かな", "<|endoftext|> a<|endoftext|><|endoftext|>", "<|x", "x" * 500, "🙂 👩‍👩‍👧 \U0001F9E0",
       "a1b2 3.14 +49-30 $5", "tab\tline\nend\r\n", "ª º ² ŀ ½x", "“q” – … €5", "  　 z", "ẞꟋ\U00010d40 ٣"]


def long_text(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(["word", "Ünï", " ", "  ", "\n", "12", "'s", "!?", "漢", "\t", "🙂", "<|endoftext|>"])
                   for _ in range(n))


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "n", "w", 0) for k, t in enumerate(texts)],
                                 "doc_id long, text string, n string, word string, ids int")


@pytest.mark.parametrize("bound, sample", [(word_table.SENT_BYTES, 0.5), (1_000, 1.0), (0, 0.0)])
def test_round_trip_equals_the_library(spark, bound, sample):
    texts = [*ODD, long_text(1, 60_000), "x\n" * 80_000, " " * 150_000, "漢" * 5_000 + "。", *["same words here"] * 50]
    texts += [long_text(k, 30) for k in range(100, 140)]
    whole, want = Tokenizer.from_file(FILE), []
    for k, t in enumerate(texts):
        ids = whole.encode(t or "", add_special_tokens=False).ids
        text = whole.decode(ids, skip_special_tokens=False)
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    got = word_table.round_trip(frame(spark, texts), FILE, bound=bound, sample=sample)
    assert rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_texts_are_digested_where_they_are_encoded(spark):
    docs = frame(spark, ["one two", "other"])
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (
        word_table.encode_rows(docs, FILE), word_table.round_trip(docs, FILE))]
    assert plans[0].count("MapInArrow") == plans[1].count("MapInArrow") == 4  # no second worker beside a task's own


def test_frequent_words_keep_their_bound(spark):
    texts = [long_text(k, 300) for k in range(40)] + ["rare%d" % k for k in range(200)]
    docs = word_table.texts(frame(spark, texts))
    for bound in (0, 500, 2_000, 100_000):
        got = word_table.frequent_words(docs, FILE, bound, 1.0).toArrow()
        assert len(set(got.column("word").to_pylist())) == len(got)
        assert sum(len(w.encode()) for w in got.column("word").to_pylist()) + sum(map(len, got.column(
            "ids").to_pylist())) <= bound
    assert len(got) == len({w for t in texts for p in word_table.ByteWords(FILE).parts(t) for w in p})


def test_word_table_finds_whole_words():
    import pyarrow as pa

    table = word_table.WordTable(pa.table({"word": ["a", " b", "cc"], "ids": [b"\1\0\0\0", b"", b"\2\0\0\0\3\0\0\0"]}))
    at = table.find(["cc", "x", " b", "a", "b"])
    assert [table.word[int(k)].as_py() if k >= 0 else None for k in at] == ["cc", None, " b", "a", None]
    assert table.ids[table.edges[at[0]]:table.edges[at[0] + 1]].tolist() == [2, 3] and table.find([]).size == 0


def test_empty_table_repeated_rows_and_null_ids(spark):
    assert word_table.round_trip(frame(spark, []), FILE).count() == 0
    docs = spark.createDataFrame([(1, "one two")] * 7 + [(None, "one two")] * 2 + [(1, "other"), (None, None)],
                                 "doc_id long, text string")
    for bound in (0, word_table.SENT_BYTES):
        got = [(r.doc_id, tuple(r.ids)) for r in word_table.encode_rows(docs, FILE, bound=bound).collect()]
        library = Tokenizer.from_file(FILE)
        a, b = (tuple(library.encode(t).ids) for t in ("one two", "other"))
        assert sorted(got, key=repr) == sorted([(1, a)] * 7 + [(None, a)] * 2 + [(1, b), (None, ())], key=repr)


def test_decode_any_ids(spark):
    library = Tokenizer.from_file(FILE)
    rng = np.random.default_rng(3)
    ids = [rng.integers(0, 50257, n).tolist() for n in (0, 1, 2, 50, 3000)] + [[50256, 50256, 1]]
    given = spark.createDataFrame([*enumerate(ids), (99, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in word_table.decode_rows(given, FILE).collect()}
    assert got == {99: ""} | {k: library.decode(i, skip_special_tokens=False) for k, i in enumerate(ids)}


def test_chunks_do_not_change_the_words():
    words = word_table.ByteWords(FILE)
    for seed in range(20):
        text = long_text(seed, 400) + "かな。漢字、" * 30 + "\n\n x" * 20
        parts = list(word_table.chunks(text, 10))
        assert "".join(parts) == text and len(parts) > 10
        split = [w for p in parts for w in words.marks.split(p)]
        whole = [w for part in words.parts(text) for w in part]
        again = [w for p in parts for part in words.parts(p) for w in part]
        assert whole == again and "".join(split) == text
