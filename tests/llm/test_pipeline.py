"""The pipeline and each of its stages on small tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

WORDS = "stone river light morning table garden window paper winter summer train bread water road field".split()
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
MORE = COLUMNS + ", kept string, n_lines string, n_removed int, label string, score string, `a.b` int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ly"]) for _ in range(n))


def row(doc_id, text):
    return (doc_id, text, "en", "hot", 7, "k", "x", 3, "l", "s", 1)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Plain, toxic, copied and nearly copied documents, shared passages, personal data, odd texts and repeated rows."""
    rng = random.Random(9)
    passage = "\n".join(prose(rng, 9) for _ in range(4))
    docs, labels = [], []
    for k in range(120):
        text = "\n".join(prose(rng, 8) for _ in range(4))
        if k % 6 == 0:
            text = text.replace(" ", " grumblefart ", 3)
        labels.append((k, 1, int(k % 6 == 0)))
        docs.append(row(k, text))
    whole = prose(rng, 60)
    docs += [row(200, passage), row(201, "\n\n" + passage), row(202, "  \n" + passage + "\n \t\n"), row(203, None), row(204, ""),
             row(205, "\n \n"), row(206, whole), row(207, whole), row(208, whole + " end"), row(209, "write to a.b@c.example now"),
             row(210, "word " * 30_000), row(211, "once more " + prose(rng, 30)), row(211, None)]
    docs[-1] = docs[-2]  # a repeated row
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, MORE).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return spark.read.parquet(str(path / "documents.parquet")), str(path)


def stage(name):
    return dict(P.STAGES)[name]


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_toxicity_stage(spark, corpus):
    docs, path = corpus
    left = stage("toxicity")(spark, docs, path)
    assert left.columns == docs.columns
    assert ids(left) == [i for i in ids(docs) if i >= 120 or i % 6]


def test_line_stage_drops_what_has_no_text_left(spark, corpus):
    docs, path = corpus
    left = stage("line_dedup")(spark, docs, path)
    assert left.columns == docs.columns
    # 201 and 202 are the passage of 200 between blank lines; null, empty and blank texts pass.
    assert ids(left) == [i for i in ids(docs) if i not in (201, 202)]
    text = {r.doc_id: r for r in left.collect()}
    assert text[203].text is None and text[203].n_chars is None and text[204].text == "" and text[205].text == "\n \n"
    assert text[200].n_chars == len(text[200].text) and text[200].n_lines == "x" and text[200].n_removed == 3
    three = spark.createDataFrame([row(1, "\n\na\nb\nc"), row(2, "\n\na\nb\nc"), row(3, "a\nb\nc")], MORE)
    assert ids(stage("line_dedup")(spark, three, path)) == [1]


def test_minhash_stage(spark, corpus):
    docs, path = corpus
    left = stage("minhash")(spark, docs, path)
    assert left.columns == docs.columns
    assert ids(left) == [i for i in ids(docs) if i not in (201, 202, 207, 208)]


def test_pii_stage(spark, corpus):
    docs, path = corpus
    left = stage("pii")(spark, docs, path)
    assert left.columns == docs.columns and ids(left) == ids(docs)
    text = {r.doc_id: r for r in left.collect()}
    assert "a.b@c.example" not in text[209].text and text[203].text is None and text[204].text == ""
    before = {r.doc_id: r.text for r in docs.collect()}
    assert text[210].text == before[210] and text[209].n_chars == len(text[209].text)


def test_packing_stage(spark, corpus):
    docs, path = corpus
    got = stage("packing")(spark, docs, path).collect()
    assert {r.doc_id for r in got} == set(ids(docs)) and sum(r.piece == 0 for r in got) == docs.count()
    assert max(r.offset + r.length for r in got) <= 4096


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_empty_tables(spark, corpus, name):
    docs, path = corpus
    assert stage(name)(spark, docs.limit(0), path).count() == 0


def test_whole_pipeline(spark, corpus):
    docs, path = corpus
    got = P.run(spark, path)
    want = docs
    for name, fn in P.STAGES[:-1]:
        want = fn(spark, want, path)
    assert {r.doc_id for r in got.collect()} == set(ids(want))
    gone = set(ids(docs)) - {r.doc_id for r in got.collect()}
    assert gone == {*range(0, 120, 6), 201, 202, 207, 208}
    assert got.select(F.countDistinct("sequence_id")).first()[0] >= -(-got.agg(F.sum("length")).first()[0] // 4096)
