"""Ranked search against a plain one."""

import math
import random
import re
from collections import Counter

import pytest
from helpers import rows

from tickloom.llm import search as S

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, top):
    held = [(i, terms(t)) for i, t in docs if i is not None and terms(t)]
    n_docs, n_terms = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    merged = {}
    for i, t in items:
        if i is not None:
            merged.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in merged.items():
        scored = []
        for doc, words in held:
            m, tf, score = 50 + (50 * len(words) * n_docs) // n_terms, Counter(words), 0
            for t in own:
                if tf[t]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += weight * ((10 ** 9 * tf[t]) // (1000 * tf[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc))
        out += [(item, k + 1, doc, -score) for k, (score, doc) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def given(seed, n_docs, n_items):
    rng = random.Random(seed)
    letters = [f"w{k}" for k in range(60)] + ["Ünï", "漢字", "don't", "A-b", "É_x", "3.14", "\x85y", "\x00z"]
    text = lambda n: rng.choice([" ", "\n", ", "]).join(rng.choices(letters, [1 / (k + 1) for k in range(len(letters))], k=n))
    docs = [(k * 7 % 1000, text(rng.randrange(0, 80))) for k in range(n_docs)]
    docs += [(2000, None), (2001, ""), (2002, "..."), (None, "w1 w2"), (2003, "w5 " * 4000), (2004, docs[0][1])]
    shared = [text(6) for _ in range(5)]
    items = [(k, " ".join(rng.sample(shared, 3)) + " " + text(rng.randrange(1, 9))) for k in range(n_items)]
    items += [(900, None), (901, ""), (None, "w1"), (902, "nowhere"), (903, "w1 w1 W1"), (903, "w2"), (904, items[0][1])]
    return docs, items


@pytest.mark.parametrize("top, block", [(50, 100_000), (3, 40), (1, 1)])
def test_search(spark, top, block):
    docs, items = given(top, 300, 30)
    d = spark.createDataFrame([(i, t, "a", 0) for i, t in docs], "doc_id long, text string, item_id string, score int")
    q = spark.createDataFrame([(i, t, "b", 1) for i, t in items], "item_id long, text string, doc_id string, rank int")
    got = S.search(d.repartition(5), q.repartition(3), top, block_terms=max(block, 20))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(got, *got.columns) == sorted(plain_search(docs, items, top), key=repr)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "a")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a c")], "item_id long, text string")
    assert S.search(d.limit(0), q).count() == 0 and S.search(d, q.limit(0)).count() == 0
    got = S.search(d, q).collect()
    assert [r.rank for r in sorted(got)] == [1, 2, 3] and [r.doc_id for r in sorted(got)] == [2, 1, 1]


@pytest.mark.parametrize("seed", range(20))
def test_shared_sets_sum_to_the_items(seed):
    rng = random.Random(seed)
    pool = [str(k).encode() for k in range(30)]
    items = [rng.sample(pool, rng.randrange(0, 12)) for _ in range(25)]
    if seed % 2:
        items += [items[0] + [b"x"], items[0] + [b"y"], items[1] + items[2]]
    shared = S.shared_sets(items)
    of = [set() for _ in range(shared.sets)]
    for t, s in shared.terms.items():
        of[s].add(t)
    for a, b in shared.sums:
        assert not of[a] & of[b]
        of.append(of[a] | of[b])
    for own, terms_ in zip(shared.items, items):
        assert sum(len(of[s]) for s in own) == len(set(terms_)) and set().union(*[of[s] for s in own]) == set(terms_)
    alone = sum(max(0, len(set(t)) - 1) for t in items)
    assert len(shared.sums) + sum(max(0, len(s) - 1) for s in shared.items) < alone
