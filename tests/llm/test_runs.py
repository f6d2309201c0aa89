"""Periodic runs against a plain search, and the query against its contract."""

import hashlib
import random
import zlib

import pytest
from helpers import rows

from tickloom.llm import runs
from tickloom.llm.base import QUERIES

SPACE = "\x20\t\n\v\f\r"


def words_of(text):
    out = [""]
    for c in text or "":
        if c in SPACE:
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def plain_runs(words, least=6, times=4):
    found, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, times * q):
                found.setdefault((start, i + q - start), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def kept_words(words, found):
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def some_texts():
    rng = random.Random(5)
    out = ["", None, " \n\t", "a", "a " * 5, "a " * 6, "a " * 7 + "b", "ab\x85c\xa0d " * 9, "a b " * 4, "a b " * 3,
           "x a b a b a b a b a y y y y y y y", "\x1c a" * 8]
    for _ in range(150):
        n, letters = rng.randrange(1, 60), rng.choice(["ab", "abc", "a", "abcdefgh"])
        out.append(" ".join(rng.choice(letters) for _ in range(n)))
        unit = [rng.choice(letters) for _ in range(rng.randrange(1, 6))]
        looped = [rng.choice("abz") for _ in range(rng.randrange(4))] + unit * rng.randrange(1, 9) + unit[:2] + ["q"]
        out.append("  ".join(looped * rng.choice([1, 1, 4])))
    fib = ["a", "a b"]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + " " + fib[-2])
    return [*out, fib[-1], "a " * 3000, ("long unit of seven words here now " * 300)]


def frame(spark, texts, first=0):
    return spark.createDataFrame([(k, t, "r", 0, None) for k, t in enumerate(texts, first)],
                                 "doc_id long, text string, runs string, start int, n_words int")


@pytest.mark.parametrize("least, times", [(6, 4), (2, 2), (5, 3)])
def test_runs_equal_plain_search(spark, least, times):
    texts = some_texts()
    got = runs.periodic_runs(frame(spark, texts), least_length=least, least_exponent=times).collect()
    assert len(got) == len(texts)
    for r in got:
        words = words_of(texts[r.doc_id])
        want = plain_runs(words, least, times)
        assert [tuple(x) for x in r.runs] == want, texts[r.doc_id]
        assert r.n_words == len(words) and r.text == kept_words(words, want)


def test_odd_tables(spark):
    assert runs.periodic_runs(frame(spark, [])).count() == 0
    docs = spark.createDataFrame([(None, "a " * 8), (1, "a " * 8), (1, "a " * 8), (1, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, len(r.runs)) for r in runs.periodic_runs(docs).collect()), key=repr)
    assert got == [(1, "", 0), (1, "a", 1), (1, "a", 1), (None, "a", 1)]
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, least_exponent=1)


def expected(doc_id, text):
    words, n = words_of(text), len(words_of(text))
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    lines = "".join("%d,%d,%d\n" % r for r in found)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept_words(words, found).encode()).hexdigest())


def test_query(spark, tmp_path):
    texts = some_texts()
    docs = frame(spark, texts, first=1000)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    want = [expected(1000 + k, t) for k, t in enumerate(texts)]
    assert sum(zlib.crc32(str(1000 + k).encode()) % 10 == 0 for k in range(len(texts))) > 10
    assert rows(got, *got.columns) == sorted(want, key=repr)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                           "collapsed_sha256"]
