"""From raw documents to packed sequences: every stage works on what the one before has written.

All stages but the last return the columns they were given. Null and empty texts pass, but for what each stage says of them;
rows repeated under one id are kept or dropped together; extra columns, whatever they are called, pass through; an empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.base import named, table
from tickloom.llm.lines import deduplicate_lines
from tickloom.llm.minhash import near_duplicates
from tickloom.llm.packing import best_fit_packing
from tickloom.llm.pii import sanitise
from tickloom.llm.toxicity import drop_toxic, learn
from tickloom.storage import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon rejects go. It is learned on these documents' labels, without the held-out fold.

    Null and empty texts stay. Rows are judged one by one; without labels nothing goes.
    """
    return drop_toxic(docs, learn(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go. A document that had text and has none left goes as well.

    A document has none left if all its lines with text are removed, whatever blank lines stay. Texts that were null, empty
    or blank from the start pass.
    """
    longest = max(map(len, docs.columns))
    aside = {c: c.ljust(longest + 1, "_") for c in ("n_lines", "n_removed") if c in docs.columns}
    done = deduplicate_lines(docs.withColumnsRenamed(aside), counts=True)
    left = done.where("NOT (n_removed > 0 AND n_removed = n_lines)")
    return recounted(left.select(*[named(aside.get(c, c)).alias(c) for c in docs.columns]))


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the smallest id stays.

    Texts without a word, null ones among them, are like no other and stay.
    """
    gone = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*map(named, docs.columns))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are replaced in the text. Null and empty texts stay as they are."""
    return recounted(sanitise(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: its document, its tokens' place and check sum, its sequence and offset.

    Null and empty texts are pieces of the end id alone; every row gives pieces of its own.
    """
    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("line_dedup", line_dedup), ("minhash", minhash),
                                   ("pii", pii), ("packing", packing)]
# SQL can express neither the learned lexicon nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; what a stage returns is written and read again for the next one."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
