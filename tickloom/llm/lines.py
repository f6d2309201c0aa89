"""Removal of repeated passages of three lines or more."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.base import arrow_schema, named, per_text, query, table, texts
from tickloom.storage import stored

WINDOW = 3
BLANK = " \t\v\f\r"


def owners(lines: list[str]) -> np.ndarray:
    """For each line the number of its last line with text, itself included; -1 before the first such line."""
    return np.cumsum([bool(x.strip(BLANK)) for x in lines]) - 1


def windows(docs: DataFrame, width: int) -> DataFrame:
    """Rows (code, doc_id, k): a 64-bit hash of every ``width`` consecutive lines with text, and the first one's
    number. Blanks around a line do not count."""
    def make():
        mult = np.random.default_rng(3).integers(0, 2 ** 64, width, np.uint64) | np.uint64(1)

        def emit(ids: list, text: list) -> dict[str, list]:
            codes, who, at = [], [], []
            for i, t in zip(ids, text):
                each = np.array([xxhash.xxh3_64_intdigest(x) for x in (y.strip(BLANK) for y in t.split("\n")) if x],
                                np.uint64)
                n = len(each) - width + 1
                if n < 1 or i is None:
                    continue
                code = np.zeros(n, np.uint64)
                for j in range(width):
                    code = (code ^ (code >> np.uint64(31))) * mult[j] + each[j:j + n]
                codes.append(code.view(np.int64))
                who.append(np.full(n, i, np.int64))
                at.append(np.arange(n, dtype=np.int32))
            none = [np.zeros(0, np.int64)]
            return {"code": np.concatenate(none + codes), "doc_id": np.concatenate(none + who),
                    "k": np.concatenate(none + at)}

        return emit

    return per_text(docs, "code long, doc_id long, k int", make)


def later_windows(rows: DataFrame, width: int) -> DataFrame:
    """Rows (doc_id, starts): the windows of each document that occurred before, in order of (doc_id, line).

    A window that overlaps its first occurrence is no later one. First occurrences are minima with partial sums and
    only those of repeated windows are joined back, so a very common passage is a skewed join at most, never a group
    in one task.
    """
    found = stored(windows(rows, width))
    first = found.groupBy("code").agg(F.min(F.struct("doc_id", "k")).alias("first"), F.count("*").alias("n")).where(
        "n > 1").select("code", F.col("first.doc_id").alias("first_id"), F.col("first.k").alias("first_k"))
    later = found.join(first, "code").where((F.col("doc_id") > F.col("first_id")) | (F.col("k") >= F.col(
        "first_k") + width))
    return later.groupBy("doc_id").agg(F.collect_set("k").alias("starts"))


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      width: int = WINDOW, counts: bool = False) -> DataFrame:
    """The rows and columns of ``docs``, their text without lines in later occurrences of a repeated window.

    Windows are ``width`` consecutive lines with text. The lines of all later windows of a document are merged, so
    overlapping windows take a line once. A blank line goes with the line before it. With ``counts`` two columns
    follow, n_lines and n_removed (both long), which replace columns of that name.

    Documents of fewer lines, empty and null ones stay as they are; so do rows with a null id, which take no part. Rows
    repeated under one id must have one text: they are one document. Other columns pass through.
    """
    later = later_windows(texts(docs, id_col, text_col), width).select(
        F.col("doc_id").alias("later_id"), "starts")
    columns = [c for c in docs.columns if not (counts and c in ("n_lines", "n_removed"))]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in columns)
    schema = fields + ", n_lines long, n_removed long" * counts
    arrow = arrow_schema(docs.sparkSession, schema)
    # The input row travels as one struct, so no column of it can clash with the names used here.
    whole = docs.select(F.struct(*[named(c) for c in columns]).alias("row"), named(id_col).cast("long").alias("doc_id"))
    both = whole.join(later, F.col("doc_id") == F.col("later_id"), "left").select("row", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index(text_col)
        for batch in batches:
            new, n_lines, n_removed = [], [], []
            given = batch.column("row").flatten()
            for text, starts in zip(given[at], batch.column("starts")):
                lines = (text.as_py() or "").split("\n")
                owner = owners(lines)
                n_lines.append(int(owner[-1]) + 1)
                if not starts.is_valid:
                    new.append(text.as_py())
                    n_removed.append(0)
                    continue
                gone = np.zeros(int(owner[-1]) + 2, bool)  # the last place stands for lines before the first text
                k = starts.values.to_numpy()
                for j in range(width):
                    gone[k + j] = True
                new.append("\n".join(x for x, o in zip(lines, owner) if not gone[o]))
                n_removed.append(int(gone.sum()))
            out = list(given)
            out[at] = pa.array(new, pa.string())
            if counts:
                out += [pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(out, arrow)], schema=arrow)

    return both.mapInArrow(run, schema)


@query("op1_line_dedup", sql=r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
t AS (SELECT *, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
o AS (SELECT *, count(*) FILTER (bare <> '') OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM t),
w AS (SELECT doc_id, k, bare AS a, lead(bare) OVER d AS b, lead(bare, 2) OVER d AS c
      FROM o WHERE bare <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
f AS (SELECT *, first_value(doc_id) OVER s AS first_id, first_value(k) OVER s AS first_k
      FROM w WHERE c IS NOT NULL WINDOW s AS (PARTITION BY a, b, c ORDER BY doc_id, k)),
g AS (SELECT DISTINCT doc_id, unnest([k, k + 1, k + 2]) AS k FROM f WHERE doc_id > first_id OR k >= first_k + 3),
r AS (SELECT o.*, g.k IS NOT NULL AS gone FROM o LEFT JOIN g ON o.doc_id = g.doc_id AND o.k = g.k)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text,
  count(*) FILTER (bare <> '') AS n_lines, count(*) FILTER (bare <> '' AND gone) AS n_removed
FROM r GROUP BY doc_id""")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return deduplicate_lines(docs, counts=True)
