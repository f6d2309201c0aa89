"""Writing results, feature tables and signals."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.price import flag


def write_result(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Replace a small result table; the header is written with it."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_features(df: DataFrame, path: str, partition_by: Seq[str] = ("symbol", "date")) -> None:
    """Replace a feature table, laid out by the given columns.

    ``maxRecordsPerFile`` bounds the files of a partition that holds much of the data.
    """
    (df.write.mode("overwrite").option("maxRecordsPerFile", 20_000_000)
     .partitionBy(*partition_by).parquet(path))


def append_rows(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Append rows; every part file carries the header once."""
    writer = df.write.mode("append")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def signal_detail(signals: DataFrame, target: int, name: str = "h3_signal") -> DataFrame:
    """Signal rows with the constants a reader of the file needs and the outcome as 1 or 0."""
    return signals.withColumns({
        name: F.lit(1), "target_digit": F.lit(target),
        "correct_prediction": flag(F.col("next_digit") == target)})
