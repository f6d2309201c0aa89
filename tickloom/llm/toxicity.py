"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.base import per_text, query, table, texts
from tickloom.llm.fit import chance, labelled, logistic, remainder, training_texts

TRAINING_ROWS = 12_000
LEXICON_TERMS = 4_000
LEAST_WEIGHT, LEAST_EVIDENCE = 1.0, 24.0
PREFIXES = range(4, 9)
WORD_CHARS = 40
FOLDS, HELD_OUT = 4, 2
CUT = 0.3

# Letters of other alphabets that look Latin, and digits and signs written for letters.
LOOKALIKES = str.maketrans({
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "α": "a", "β": "b", "ε": "e", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"})
LETTER_SIGNS = str.maketrans({"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b",
                              "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"})
SIGNS = "0123456789@$!|"
SIGN = re.compile(r"[0-9@$!|]")
# A run of letters and signs with a sign in it; ! and | belong to it only between two others.
RUN = re.compile(r"(?<![^\W\d_])[^\W\d_]*+(?:(?:[0-9@$]|(?<=[^\W_]|[@$])[!|]++(?=[^\W_]|[@$]))[^\W\d_]*+)++")
BAR = re.compile(r"[!|]+")
# Cheaper to look for: a run from its first sign on, and whether the slower RUN is needed at all.
TAIL = re.compile(r"[0-9@$](?:[^\W\d_]++|[0-9@$]++)*+")
BAR_BEFORE = re.compile(r"[!|](?=[^\W_]|[@$])")
HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
MARKS = dict.fromkeys(c for c in (*range(0x300, 0x1F000), *range(0xE0100, 0xE01F0))
                      if unicodedata.category(chr(c)) == "Mn")
EVEN = LOOKALIKES | MARKS
NOT_WORD = re.compile(r"[\W_]+")


def folded(text: str) -> str:
    """Words between single spaces: compatibility forms without marks, case, look-alike letters, signs for letters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", HIDDEN.sub("", text)).lower().translate(EVEN)
        text = unicodedata.normalize("NFC", text)
    else:
        text = text.lower()
    if BAR_BEFORE.search(text):
        text = RUN.sub(letters, text)
    elif SIGN.search(text):
        text = TAIL.sub(tail, text)
    return f" {NOT_WORD.sub(' ', text)} ".replace("  ", " ")


def letters(run: re.Match) -> str:
    """A run with all its signs as letters, if it has a letter; one with ! or | inside also as the words they part."""
    found = run[0]
    if not found.strip(SIGNS):
        return found
    parts = BAR.split(found)
    if len(parts) == 1:
        return found.translate(LETTER_SIGNS)
    return " ".join([found.translate(LETTER_SIGNS), *[p.translate(LETTER_SIGNS) if p.strip(SIGNS) else p for p in parts]])


def tail(run: re.Match) -> str:
    """As ``letters``, for a run without ! and | from its first sign on."""
    before = run.string[run.start() - 1:run.start()]
    if run[0].strip(SIGNS) or before.isalnum() and not before.isdecimal():
        return run[0].translate(LETTER_SIGNS)
    return run[0]


def alike(even: str) -> str:
    """Folded text with one letter for i and l, as 1, ! and | are written for both. Matching is on this form."""
    return even.replace("l", "i")


def forms(word: str) -> list[str]:
    """The terms a word can be found by: itself, and its beginnings."""
    if len(word) > WORD_CHARS:
        word = word[:WORD_CHARS]
        return [f" {word[:k]}" for k in PREFIXES]
    return [f" {word} ", *[f" {word[:k]}" for k in PREFIXES if len(word) > k]]


@dataclass
class Lexicon:
    """Terms with weights, phrases in which they do not count, and the fit that makes a score a chance.

    A term is a word between spaces, or a beginning of words with a space before it.
    """

    weights: dict[str, float]
    phrases: list[str] = field(default_factory=list)
    fit: list[float] = field(default_factory=lambda: [-3.0, 1.0, 1.0])

    def matcher(self) -> ahocorasick.Automaton | None:
        """One automaton for terms (weight) and phrases (negative length)."""
        made = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            made.add_word(alike(term), (max(weight, made.get(alike(term), (weight,))[0]), len(term)))
        for phrase in self.phrases:
            made.add_word(alike(f" {phrase} "), (None, len(phrase) + 2))
        if not len(made):
            return None
        made.make_automaton()
        return made


def measure(text: str, automaton: ahocorasick.Automaton | None) -> tuple[float, float]:
    """Features of a text: log of the matched weight, and of the matched weight per hundred words."""
    if automaton is None:
        return 0.0, 0.0
    even = alike(folded(text))
    hits, freed = [], []
    for end, (weight, length) in automaton.iter(even):
        (freed if weight is None else hits).append((end - length + 1, end, weight))
    total = 0.0
    for start, end, weight in hits:
        if not any(a <= start and end <= b + 1 for a, b, _ in freed):
            total += weight
    words = max(1, even.count(" ") - 1)
    return float(np.log1p(total)), float(np.log1p(100 * total / words))


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, terms: int = LEXICON_TERMS,
          known: dict[str, float] | None = None, phrases: list[str] | None = None) -> Lexicon:
    """Learn a lexicon from labels (doc_id, toxic) outside the held-out fold.

    At most ``rows`` labelled documents are read, one row each, and at most ``terms`` terms kept; both bound what reaches
    the driver.
    Terms are counted with i and l as one letter and named by their usual spelling.
    A term must be in 3 toxic documents, with different neighbours in at least half of them, so that a word of
    a text that was copied many times is none. Its weight is the log ratio of its share of toxic to that of other
    documents, and the log-likelihood ratio of the two shares must reach LEAST_EVIDENCE. Of terms that extend each
    other the most special one that keeps nine tenths of the documents stays.
    Phrases of two words that only other documents have around a term become exceptions.
    ``known`` and ``phrases`` are added as they are. Without usable labels the lexicon is ``known`` alone.
    """
    chosen = labelled(labels, "toxic", FOLDS, HELD_OUT, rows)
    sample = training_texts(docs, chosen)
    spark = docs.sparkSession

    def around():
        def emit(ids: list, text: list) -> dict[str, list]:
            out: dict[str, list] = {"doc_id": [], "term": [], "spelling": [], "context": []}
            for i, t in zip(ids, text):
                words = folded(t).split()
                for k, w in enumerate(words):
                    context = hash_of(words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else "")
                    for form in forms(w):
                        out["doc_id"].append(i)
                        out["term"].append(alike(form))
                        out["spelling"].append(form)
                        out["context"].append(context)
            return out

        return emit

    counts = per_text(sample.where("label = 1"), "doc_id long, term string, spelling string, context long",
                      around).groupBy("term", "spelling", "doc_id", "context").count()
    written = counts.groupBy("term", "spelling").agg(F.sum("count").alias("n")).groupBy("term").agg(
        F.max_by("spelling", F.struct("n", "spelling")).alias("spelling"))
    counts = counts.groupBy("term").agg(
        F.countDistinct("doc_id").alias("docs"), F.countDistinct("context").alias("contexts"))
    candidates = {r.term: r.docs for r in counts.where("docs >= 3 AND contexts >= 3 AND contexts * 2 >= docs").orderBy(
        F.desc("docs"), "term").limit(5 * terms).collect()}
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    weights: dict[str, float] = {}
    if candidates and len(sizes) > 1:
        shared = spark.sparkContext.broadcast(candidates)

        def other():
            own: dict[str, list[str]] = {}

            def emit(ids: list, text: list) -> dict[str, list]:
                found: dict[str, int] = {}
                for t in text:
                    seen: set[str] = set()
                    for w in set(alike(folded(t)).split()):
                        if w not in own:
                            own[w] = [f for f in forms(w) if f in shared.value]
                        seen.update(own[w])
                    for f in seen:
                        found[f] = found.get(f, 0) + 1
                if len(own) > 100_000:
                    own.clear()
                return {"term": list(found), "docs": list(found.values())}

            return emit

        clean = {r.term: r.docs for r in per_text(
            sample.where("label <> 1"), "term string, docs long", other).groupBy("term").agg(
            F.sum("docs").alias("docs")).collect()}
        bad, good = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
        ratio = {t: float(np.log((n + 0.1) / (bad + 1)) - np.log((clean.get(t, 0) + 0.5) / (good + 1)))
                 for t, n in candidates.items()}
        weights = special({t: w for t, w in ratio.items() if w >= LEAST_WEIGHT and evidence(
            candidates[t], bad, clean.get(t, 0), good) >= LEAST_EVIDENCE}, candidates, terms)
        names = {r.term: r.spelling for r in written.where(F.col("term").isin(list(weights))).collect()}
        weights = {names[t]: w for t, w in weights.items()}
    lexicon = Lexicon(weights | (known or {}), list(phrases or []))
    lexicon.phrases += exceptions(sample, lexicon)
    measured = features(sample, lexicon, ("label",))
    found = measured.select("label", "total", "density").collect()
    x = np.array([(r.total, r.density) for r in found]).reshape(-1, 2)
    lexicon.fit = logistic(x, np.array([float(r.label == 1) for r in found])).tolist()
    return lexicon


def evidence(a: int, bad: int, b: int, good: int) -> float:
    """Log-likelihood ratio of a term's two shares against one common share."""
    def part(n: float, of: float) -> float:
        return n * np.log(n / of) if n > 0 else 0.0

    both = (a + b) / (bad + good)
    return 2 * (part(a, bad * both) + part(bad - a, bad * (1 - both)) + part(b, good * both)
                + part(good - b, good * (1 - both)))


def special(weights: dict[str, float], docs: dict[str, int], most: int) -> dict[str, float]:
    """Of terms that extend each other, the most special that loses little; the heaviest ``most``."""
    kept: dict[str, float] = {}
    longer: dict[str, int] = {}  # most documents of a term that extends this one
    for t in weights:
        word = t.strip()
        for k in PREFIXES:
            head = f" {word[:k]}"
            if head != t and len(word) >= k:
                longer[head] = max(longer.get(head, 0), docs[t])
    for t in sorted(weights, key=lambda t: (len(t.strip()), t)):
        if longer.get(t, 0) >= 0.9 * docs[t]:
            continue
        word = t.strip()
        if any(kept.get(f" {word[:k]}", -1.0) >= weights[t] - 1.0 for k in PREFIXES if f" {word[:k]}" != t):
            continue
        kept[t] = weights[t]
    return dict(sorted(kept.items(), key=lambda x: (-x[1] * np.log1p(docs[x[0]]), x[0]))[:most])


def exceptions(sample: DataFrame, lexicon: Lexicon, least: int = 3, most: int = 500) -> list[str]:
    """Two-word phrases around terms, in at least ``least`` other documents and in no toxic one."""
    if not lexicon.weights:
        return []
    weights = lexicon.weights

    def make():
        automaton = Lexicon(weights).matcher()

        def emit(ids: list, text: list) -> dict[str, list]:
            out: dict[str, list] = {"doc_id": [], "phrase": []}
            for i, t in zip(ids, text):
                even = alike(folded(t))
                for end, (_, length) in automaton.iter(even):
                    start = end - length + 1
                    close = even.find(" ", start + 1)
                    before = even.rfind(" ", 0, start) if start > 0 else -1
                    after = even.find(" ", close + 1)
                    for a, b in ((before, close), (start, after)):
                        if a >= 0 and b > a:
                            out["doc_id"].append(i)
                            out["phrase"].append(even[a + 1:b])
            return out

        return emit

    found = per_text(sample, "doc_id long, phrase string", make).distinct().join(
        F.broadcast(sample.select("doc_id", "label")), "doc_id")
    told = found.groupBy("phrase").agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("toxic"),
                                       F.count("*").alias("docs"))
    return [r.phrase for r in told.where(f"toxic = 0 AND docs >= {least}").orderBy(
        F.desc("docs"), "phrase").limit(most).collect()]


def hash_of(*words: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest("\x00".join(words)) - (1 << 63)


def features(docs: DataFrame, lexicon: Lexicon, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, .., total, density) of (doc_id, text, ..)."""
    weights, phrases = lexicon.weights, lexicon.phrases

    def make():
        automaton = Lexicon(weights, phrases).matcher()

        def emit(ids: list, text: list) -> dict[str, list]:
            found = [measure(t, automaton) for t in text]
            return {"doc_id": ids, "total": [f[0] for f in found], "density": [f[1] for f in found]}

        return emit

    out = per_text(docs, "doc_id long, total double, density double", make)
    return out.join(F.broadcast(docs.select("doc_id", *keep)), "doc_id") if keep else out


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text",
                   cut: float = CUT) -> DataFrame:
    """Rows (doc_id, score, predicted), one per input row, nothing shuffled.

    The score is the chance of label 1, from the matched weight and from the matched weight per word; a text without
    terms, an empty one and a null one get the same low score. Null ids, repeated rows and other columns are allowed.
    """
    weights, phrases, fit = lexicon.weights, lexicon.phrases, np.array(lexicon.fit)

    def make():
        automaton = Lexicon(weights, phrases).matcher()

        def emit(ids: list, text: list) -> dict[str, list]:
            p = chance(np.array([measure(t, automaton) for t in text]).reshape(-1, 2), fit)
            return {"doc_id": ids, "score": p.tolist(), "predicted": (p >= cut).astype(int).tolist()}

        return emit

    return per_text(texts(docs, id_col, text_col), "doc_id long, score double, predicted int", make)


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` with a score under ``cut``, all columns; null and empty texts stay."""
    weights, phrases, fit = lexicon.weights, lexicon.phrases, np.array(lexicon.fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Lexicon(weights, phrases).matcher()
        for batch in batches:
            found = [measure(t.as_py() or "", automaton) for t in batch.column(at)]
            yield batch.filter(pa.array(chance(np.array(found).reshape(-1, 2), fit) < cut))

    at = docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names with dots would be read as fields
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
                         "predicted")
