"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.base import query, table, texts
from tickloom.storage import stored

PREFIX_CHARS = 256
# A white-space run that is not already one space.
UNEVEN_SPACE = r"\x20*[\x09-\x0D][\x20\x09-\x0D]*|\x20\x20+"


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     prefix_chars: int = PREFIX_CHARS, digests: bool = False) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept) and, with ``digests``, text_sha256; one per input row.

    Texts are equal when they agree after each white-space run became one space. The texts are grouped by
    length; groups of one end there. What survives is grouped by the hash of the first characters as well, and
    only what survives that too by the SHA-256 of the whole text. Without ``digests`` the whole text is hashed for
    those survivors only; with it the digest is part of the result, so the one scan makes it for every row.
    All levels work on thin rows and on counts with partial sums, so a group of any size is never in one task.

    Null text: empty. Null id: compares as larger than any id. Rows repeated with one id and text all come out with
    the same keep_id, and count. Empty table: no rows. Other columns are ignored.
    """
    even = F.regexp_replace("text", UNEVEN_SPACE, " ")
    rows = texts(docs, id_col, text_col).withColumn("text", even)
    keys = [F.length("text").alias("n"), F.xxhash64(F.substring("text", 1, prefix_chars)).alias("prefix")]
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    thin = stored(rows.select("doc_id", *keys, *([digest] if digests else [])))

    lengths = thin.groupBy("n").agg(F.count("*").alias("rows")).where("rows > 1").select("n")
    prefixes = (thin.join(lengths, "n", "left_semi").groupBy("n", "prefix").agg(F.count("*").alias("rows"))
                .where("rows > 1").select("n", "prefix"))
    if digests:
        survivors = thin.join(prefixes, ["n", "prefix"], "left_semi")
    else:
        whole = rows.select("doc_id", *keys, "text").join(prefixes, ["n", "prefix"], "left_semi")
        survivors = stored(whole.select("doc_id", "n", "prefix", digest))
    same = ["n", "prefix", "digest"]
    groups = (survivors.groupBy(*same).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows"))
              .where("rows > 1"))
    if digests:
        placed = thin.join(groups, same, "left")
    else:
        alone = thin.join(prefixes, ["n", "prefix"], "left_anti").select(
            "doc_id", F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("long").alias("rows"))
        placed = survivors.join(groups, same, "left").select("doc_id", "first_id", "rows").union(alone)
    keep = F.coalesce("first_id", "doc_id")
    out = [F.col("doc_id"), keep.alias("keep_id"), F.coalesce("rows", F.lit(1)).alias("group_size"),
           F.col("doc_id").eqNullSafe(keep).alias("kept")]
    return placed.select(*out, *([F.lower(F.hex("digest")).alias("text_sha256")] if digests else []))


@query("op6_exact_dedup", sql=r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), digests=True)
