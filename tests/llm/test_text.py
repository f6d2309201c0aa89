"""Classifiers and personal data."""

import hashlib
import random
import re

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from tickloom.llm import pii, quality, toxicity
from tickloom.llm.fit import labelled, remainder, training_texts

PLAIN = "stone river light morning table garden window paper winter summer train bread water road field".split()


def words(rng, n):
    return [rng.choice(PLAIN) for _ in range(n)]


# ---- toxicity ---------------------------------------------------------------

@pytest.fixture(scope="module")
def abuse(spark):
    """Toxic documents have a bad word or stem, some written with other signs; one phrase is harmless."""
    rng = random.Random(1)
    docs, labels = [], []
    for k in range(600):
        text, bad = words(rng, rng.randint(15, 60)), k % 5 == 0
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["Grumblefart", "zork" + rng.choice(["en", "ing", "ly"])]))
        elif k % 7 == 0:
            text.insert(3, "zorkish")
            text.insert(4, "cuisine")
        docs.append((k, " ".join(text), "c"))
        labels.append((k, 1, int(bad)))
    docs += [(1000, "You grumblеfart", "c"), (1001, "GRUMBLEF4RT, you", "c"), (1002, "", "c"), (1003, None, "c"),
             (None, "grumblefart", "c"), (1004, "the zorkish cuisine of stone", "c"), (1004, "a river", "c")]
    labels += [(None, 1, 1), (5, 1, None)]
    return (spark.createDataFrame(docs, "doc_id long, text string, score string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_toxicity(abuse):
    docs, labels = abuse
    lexicon = toxicity.learn(docs, labels)
    assert " grumblefart " in lexicon.weights and any(t.startswith(" zork") for t in lexicon.weights)
    got = toxicity.score_toxicity(docs, lexicon)
    found = {(r.doc_id, round(r.score, 9)): r.predicted for r in got.collect()}
    told = {i: p for (i, _), p in found.items()}
    assert all(told[k] == (k % 5 == 0) for k in range(600))
    assert told[1000] == told[1001] == told[None] == 1 and told[1002] == told[1003] == 0 and told[1004] == 0
    left = toxicity.drop_toxic(docs, lexicon)
    assert left.columns == docs.columns and left.count() == docs.count() - 120 - 3
    assert toxicity.score_toxicity(docs.where("false"), lexicon).count() == 0


def test_toxicity_without_labels(abuse):
    docs, labels = abuse
    for none in (labels.where("false"), labels.where("toxic = 0")):
        lexicon = toxicity.learn(docs, none, known={" vile ": 5.0})
        assert list(lexicon.weights) == [" vile "]
        assert 0 <= toxicity.score_toxicity(docs, lexicon).first().score < 0.3


def test_repeated_ids_do_not_multiply(spark, abuse):
    """200 rows for each labelled id: one of them is learned from, and the sample that is collected has a row per id."""
    docs, labels = abuse
    chosen = labelled(labels.where("doc_id < 60"), "toxic", toxicity.FOLDS, toxicity.HELD_OUT, 40)
    many = docs.where("doc_id < 60").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(200))))
    sample = training_texts(many, chosen)
    assert sample.count() == 40 and sample.select("doc_id").distinct().count() == 40
    lexicon = toxicity.learn(docs, labels)
    assert toxicity.features(sample, lexicon, ("label",)).count() == 40
    again = toxicity.learn(docs.unionByName(docs).unionByName(docs), labels)
    assert again.weights == lexicon.weights and np.allclose(again.fit, lexicon.fit)


def test_held_out_labels_do_not_matter(abuse):
    docs, labels = abuse
    fold = remainder(F.col("doc_id"), toxicity.FOLDS) == toxicity.HELD_OUT
    other = labels.withColumn("toxic", F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learn(docs, other) == toxicity.learn(docs, labels)


def test_folding():
    assert toxicity.folded("Mо0n,  L1GHT 42 a-b") == " moon light 42 a b "
    assert toxicity.folded("") == " "


def test_folding_of_runs():
    for text, want in {"a$$": "ass", "1d107": "idiot", "5h17": "shit", "455hole": "asshole", "$h!7": "shit", "b2 269": "bz 269",
                       "f|\u0456r7": "flirt", "c\u0301af\u00e9 na\u00efve": "cafe naive", "8!tch!": "bitch",
                       "h311": "hell", "she||": "she", "1984 12!5 no_1": "1984 12 5 no 1"}.items():
        assert f" {toxicity.alike(want)} " in toxicity.alike(toxicity.folded(text)), text
    assert toxicity.folded("name|age|city") == " nameiageicity name age city "
    assert toxicity.folded("Stop! now") == " stop now " and toxicity.folded("\ud55c\uad6d") == " \ud55c\uad6d "
    rng = random.Random(9)
    for _ in range(3000):  # the short way equals the whole one
        text = "".join(rng.choice("ab1$@ _-\u0663\u00e97") for _ in range(12))
        even = text.translate(toxicity.EVEN)
        assert toxicity.TAIL.sub(toxicity.tail, even) == toxicity.RUN.sub(toxicity.letters, even)
    long = "a" * 300_000 + " " + "a1" * 150_000
    assert len(toxicity.folded(long)) == len(long) + 2


def test_disguised_terms_match(abuse):
    lexicon = toxicity.learn(*abuse)
    lexicon.phrases = []
    automaton = lexicon.matcher()
    plain = toxicity.measure("you grumblefart", automaton)
    assert plain[0] > 0
    for text in ("you 6rum81ef4r7", "you GRUMB|3F@RT", "you gr\u00fcmb!\u00e8fart"):
        assert toxicity.measure(text, automaton)[0] == plain[0], text


# ---- quality ----------------------------------------------------------------

def line(rng, bad):
    text = words(rng, rng.randint(6, 14))
    if not bad:
        return " ".join(text).capitalize() + "."
    kind = rng.randrange(3)
    if kind == 0:
        return " | ".join(text)
    return " ".join(w.upper() + "!!" for w in text) if kind == 1 else " ".join([text[0]] * 12)


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for k in range(300):
        bad = k % 4 == 0
        docs.append((k, "\n".join(line(rng, bad and j > 0) for j in range(rng.randint(2, 9))), "p"))
        labels.append((k, int(not bad), 0))
    docs += [(500, "", "p"), (501, None, "p"), (None, line(rng, False), "p"), (502, "\n\n", "p"), (503, "x" * 200_000, "p")]
    return (spark.createDataFrame(docs, "doc_id long, text string, predicted string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_quality(pages):
    docs, labels = pages
    got = quality.score_quality(docs, quality.learn(docs, labels)).collect()
    assert len(got) == 305 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 300]
    assert sum(r.predicted == (r.doc_id % 4 != 0) for r in held) >= 297
    flat = quality.score_quality(docs, quality.learn(docs, labels.where("false")))
    assert flat.select("score").distinct().count() == 1
    assert quality.score_quality(docs.where("false"), quality.learn(docs, labels.where("false"))).count() == 0


def test_long_documents_are_learned_from(spark, pages):
    """A document's length decides nothing; only all lines together are bounded."""
    docs, labels = pages
    long = docs.where("doc_id < 40").withColumn("text", F.repeat(F.concat("text", F.lit("\n")), 100))
    model = quality.learn(long, labels)
    assert np.abs(model.weights).max() > 0
    again = quality.learn(long.unionByName(long), labels)
    assert np.allclose(model.weights, again.weights) and np.allclose(model.fit, again.fit)
    assert np.abs(quality.learn(long, labels, lines=0).weights).max() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    bounds = np.array([0, 4, 5, 8])
    emit, trans = rng.standard_normal(8), rng.standard_normal((2, 2))
    good, pairs, total = quality.marginals(emit, trans, bounds)
    all_pairs = np.zeros((2, 2))
    for d, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
        weights, seen, moves = [], [], []
        for code in range(2 ** (hi - lo)):
            y = [(code >> j) & 1 for j in range(hi - lo)]
            score = sum(emit[lo + j] * v for j, v in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:]))
            weights.append(np.exp(score))
            seen.append(y)
            moves.append(np.array([[sum((a, b) == (s, t) for a, b in zip(y, y[1:])) for t in (0, 1)] for s in (0, 1)]))
        p = np.array(weights) / sum(weights)
        assert np.allclose(good[lo:hi], p @ np.array(seen)) and np.isclose(total[d], np.log(sum(weights)))
        all_pairs += np.einsum("i,ijk->jk", p, np.array(moves))
    assert np.allclose(pairs, all_pairs)


# ---- personal data ----------------------------------------------------------

# The kinds as the contract words them.
KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def fits(kind, value):
    n = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(n))]
        return 13 <= len(n) <= 19 and sum(d - 9 if d > 9 else d for d in twice) % 10 == 0
    return kind != "phone" or 9 <= len(n) <= 15


def base(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if fits(k, m[0])] for k, p in KINDS.items()}


def test_base_spans(spark):
    rng = random.Random(4)
    bits = ["a", "b.c", "@", ".", "_", "%", "-", " ", "1", "255", "256", "4111111111111111", "+1", "(555)", "é", "𝒳", "\n", "0",
            "4222222222222", " 12 ", "x-y.org", "+49 30 1234567", "8.8.8.8"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["", None, "a@b.c_x@d.e", "0000255.01.1.1", "1.2.3.4.5.6.7.8", "a" * 9000 + "@b.c", "1." * 3000, "1 " * 4000,
              "٣.1.1.1.1", "+" * 50, "a@b" + ".c" * 3000]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)] + [(None, "x 8.8.8.8", 0), (2, texts[2], 0)],
                                 "doc_id long, text string, n_email int")
    got = pii.find_personal_data(docs)
    told = got.select("doc_id", *[F.transform(k, lambda s: F.struct(s["start"], s["end"])).alias(k) for k in KINDS])
    for r in told.collect():
        want = base("x 8.8.8.8" if r.doc_id is None else texts[r.doc_id])
        assert {k: [tuple(s) for s in r[k]] for k in KINDS} == want, r.doc_id
    assert got.count() == len(texts) + 2
    assert pii.find_personal_data(docs.where("false")).count() == 0


def test_revealing_terms(spark):
    """A name that is only ever written next to one address reveals it; common words and one-off words do not."""
    rng = random.Random(5)
    docs = []
    for k in range(200):
        text = words(rng, 30)
        if k % 10 == 0:
            text[14:16] = ["Zebulon", "zeb@mail.example", f"once{k}"]
        docs.append((k, " ".join(text)))
    docs += [(900, docs[0][1]), (901, "nothing here"), (902, None), (903, "Zebulon was here")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.terms for r in pii.find_personal_data(frame).collect()}
    for k in range(0, 200, 10):
        assert [docs[k][1][t.start:t.end] for t in got[k]] == ["Zebulon"]
    assert len(got[900]) == 1 and got[901] == got[902] == got[903] == []
    clean = dict(rows(pii.sanitise(frame), "doc_id", "text"))
    assert "zeb" not in clean[10].lower() and "[EMAIL]" in clean[10] and "once10" in clean[10]
    assert clean[901] == "nothing here" and clean[902] is None and clean[903] == "Zebulon was here"
    general = dict(rows(pii.sanitise(frame, remove=9.0), "doc_id", "text"))
    assert "[NAME] [EMAIL] once10" in general[10]


def test_revealing_terms_of_whole_documents(spark):
    """A name in the head and one in the signature, far from an address that only two texts have, and every mention."""
    rng = random.Random(6)
    docs = [(k, " ".join(words(rng, 60))) for k in range(300)]
    for k in (7, 8):
        docs[k] = (k, f"Zebulon {' '.join(words(rng, 40))} ZEBULON {' '.join(words(rng, 40))} zeb{k}. zeb@mail.example "
                      f"{' '.join(words(rng, 40))} Quagmire once{k}")
    docs += [(400, docs[9][1] + " lone@mail.example seldom"), (401, docs[9][1] + " lone@mail.example seldom")]
    frame = spark.createDataFrame(docs + [(402, docs[-1][1])], "doc_id long, text string")
    got = {r.doc_id: r.terms for r in pii.find_personal_data(frame).collect()}
    for k in (7, 8):
        assert [docs[k][1][t.start:t.end] for t in got[k]] == ["Zebulon", "ZEBULON", "Quagmire"]
    assert not any(t for k, t in got.items() if k not in (7, 8))  # copies of one text prove nothing
    clean = dict(rows(pii.sanitise(frame), "doc_id", "text"))
    assert "zebulon" not in clean[7].lower() and "Quagmire" not in clean[7] and "once7" in clean[7]


def test_sanitise_merges_overlaps(spark):
    frame = spark.createDataFrame([(1, "to +4111111111111111 or 1.1.1.1@x.yz end", "k")],
                                  "doc_id long, text string, cuts string")
    row = pii.sanitise(frame).first()
    assert row.text == "to +[CARD] or [IP] end" and row.cuts == "k"


def test_digest_columns(spark, tmp_path):
    spark.createDataFrame([(1, "mail a@b.cd, 1.2.3.4 and +1 555 123 4567"), (2, None)], "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.op8_pii(spark, str(tmp_path)).collect()}
    spans = "email:5:11,ip:13:20,phone:25:40"
    assert got[1].spans == spans and got[1].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
    assert got[2].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
