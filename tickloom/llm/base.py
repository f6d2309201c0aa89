"""Registry of the text queries and what their operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_CHARS = 1_000_000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and the SQL that must give the same rows."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text): other columns, whatever they are called, go; a null text is empty."""
    return docs.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"))


_kept: dict[str, object] = {}


def per_worker(name: str, make: Callable[[], object]) -> object:
    """An object that a worker process keeps from task to task, until an operator that does not name it runs there."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def per_text(rows: DataFrame, schema: str, make: Callable[[], Callable[[list, list], dict[str, list]]],
             keeps: str = "", chars: int = BATCH_CHARS) -> DataFrame:
    """Apply a batch function to (doc_id, text) rows inside tasks.

    ``make`` is called once per task and gives a function from the ids and texts
    of a batch to named columns, which may hold any number of rows. Batches are cut
    at about ``chars`` characters, so long texts do not add up. What other operators keep in this worker under
    another name than ``keeps`` is let go.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keeps)
        fn = make()
        for batch in batches:
            ids, text = batch.column("doc_id"), batch.column("text")
            sizes = pc.binary_length(text).to_pylist()
            start, size = 0, 0
            for i, n in enumerate(sizes):
                size += n
                if size > chars or i + 1 == len(sizes):
                    part = slice(start, i + 1)
                    out = fn(ids.slice(start, i + 1 - start).to_pylist(), text.slice(start, i + 1 - start).to_pylist())
                    start, size = part.stop, 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    arrow = arrow_schema(rows.sparkSession, schema)
    return rows.select("doc_id", "text").mapInArrow(run, schema)


def release(keeps: str) -> None:
    for name in [n for n in _kept if n != keeps]:
        del _kept[name]


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
