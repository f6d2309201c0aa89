"""Reading tick tables and bringing any table into tick form."""

from __future__ import annotations

from collections.abc import Iterable, Sequence as Seq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.price import known, last_digit
from tickloom.operators.sequence import Sequence, epoch_micros, sequence

TICK = T.StructType([
    T.StructField("time", T.LongType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("digit", T.IntegerType()),
])

# The same columns as text, for files whose values may not parse.
RAW_TICK = T.StructType([T.StructField(f.name, T.StringType()) for f in TICK.fields])


def read_ticks(spark: SparkSession, path: str, fmt: str = "csv", raw: bool = False) -> DataFrame:
    """Scan a stored tick table with an explicit schema.

    ``raw`` reads every column as text; follow it with ``coerced``.
    """
    reader = spark.read.schema(RAW_TICK if raw else TICK)
    if fmt == "csv":
        return reader.option("header", True).option("enforceSchema", True).csv(path)
    return reader.format(fmt).load(path)


def read_features(spark: SparkSession, path: str, columns: Seq[str] | None = None) -> DataFrame:
    """Scan a stored feature table, only the wanted columns."""
    df = spark.read.parquet(path)
    return df if columns is None else picked(df, columns, strict=True)


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Fail while planning if a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def picked(df: DataFrame, wanted: Seq[str], strict: bool = False) -> DataFrame:
    """Keep the wanted columns that exist; with ``strict`` all must."""
    if strict:
        require_columns(df, wanted)
    return df.select(*[n for n in wanted if n in df.columns])


def coerced(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast columns; text that does not parse and NaN become null."""
    out = {}
    for name, kind in types.items():
        value = F.col(name).try_cast(kind)
        out[name] = known(value) if kind in ("double", "float") else value
    return df.withColumns(out)


def complete(df: DataFrame, names: Seq[str]) -> DataFrame:
    """Drop rows with null in any of the columns."""
    return df.na.drop(subset=list(names))


def as_ticks(df: DataFrame, time: str, price: str, tie: str, symbol: str | None = None,
             keep: Seq[str] = ()) -> DataFrame:
    """Name the tick columns: time, tie, symbol, price, digit.

    The digit is derived from the price.  Rows without time or price are
    dropped before any neighbour is looked up.  A zone-less timestamp is also
    given as epoch seconds in ``epoch``.
    """
    require_columns(df, [time, price, tie, *([symbol] if symbol else []), *keep])
    kind = df.schema[time].dataType
    if isinstance(kind, T.TimestampNTZType):
        epoch = F.floor(epoch_micros(F.col(time)) / 1_000_000).cast("bigint")
    elif isinstance(kind, T.TimestampType):
        epoch = F.unix_seconds(F.col(time))
    else:
        epoch = F.col(time).cast("bigint")
    value = F.col(price).cast("double")
    # Plain null checks reach the file scan.
    present = df.where(F.col(time).isNotNull() & F.col(price).isNotNull() & ~F.isnan(value))
    return present.select(
        F.col(time).alias("time"), epoch.alias("epoch"), F.col(tie).alias("tie"),
        *([F.col(symbol).alias("symbol")] if symbol else []), value.alias("price"), last_digit(value).alias("digit"),
        *[F.col(k) for k in keep])


def in_time_order(ticks: DataFrame, by: Seq[str] = ("symbol",), **cut) -> Sequence:
    """Order by time and tie breaker."""
    return sequence(ticks, ["time", "tie"], by, **cut)


def in_file_order(ticks: DataFrame, by: Seq[str] = (), **cut) -> Sequence:
    """Order by the ingestion number alone, for data whose times are not sorted."""
    return sequence(ticks, ["tie"], by, **cut)


def last_rows(df: DataFrame, n: int, order: Seq[str]) -> DataFrame:
    """The n latest rows (a top-n per partition, then one merge), in ascending order."""
    latest = df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
    return latest.orderBy(*order)


def high_water_mark(df: DataFrame, time: str = "time") -> DataFrame:
    """Latest stored time; null for an empty table."""
    return df.agg(F.max(time).alias("last_time"))


def stored_rows(df: DataFrame, target: int) -> DataFrame:
    """Rows stored so far and whether the collection target is reached."""
    return df.agg(F.count(F.lit(1)).alias("saved")).select(
        "saved", (F.col("saved") >= target).alias("target_reached"))


HISTORY_PART = 10_000


def zip_history(history: DataFrame, prices: Column, times: Column, keys: Seq[str] = (),
                part: int = HISTORY_PART) -> DataFrame:
    """Parallel arrays of history messages to one row per tick. A missing entry of the shorter array is null; a message
    without one of the arrays gives no rows.

    A message is first cut into parts of at most ``part`` ticks, which Spark deals to its tasks by their bytes, so a message
    of any length is unfolded by many tasks and never as one row.
    """
    cut = history.select(*keys, prices.alias("_prices"), times.alias("_times")).withColumn(
        "_n", F.greatest(F.coalesce(F.size("_prices"), F.lit(0)), F.coalesce(F.size("_times"), F.lit(0)))).where("_n > 0")
    at = F.explode(F.sequence(F.lit(1), F.col("_n"), F.lit(part)))
    parts = cut.withColumn("_at", at).select(
        *keys, *[F.slice(c, F.col("_at"), F.lit(part)).alias(c) for c in ("_prices", "_times")])
    if not history.isStreaming:
        parts = parts.hint("rebalance")
    pairs = F.arrays_zip(F.col("_prices").alias("price"), F.col("_times").alias("time"))
    return parts.select(*keys, F.explode(pairs).alias("t")).select(
        *keys, F.col("t.time").alias("time"), F.col("t.price").alias("price"))


def back_fill(stored: DataFrame, history: DataFrame, by: Seq[str] = ("symbol",)) -> DataFrame:
    """History ticks newer than the stored high-water mark of their symbol.

    Repeating the merge adds nothing, and a tick that occurs in two messages is
    taken once.
    """
    mark = stored.groupBy(*by).agg(F.max("time").alias("_mark"))
    return (history.join(mark, list(by), "left")
            .where(F.col("_mark").isNull() | (F.col("time") > F.col("_mark")))
            .drop("_mark").dropDuplicates([*by, "time"]))


def prediction_stats(predictions: DataFrame) -> DataFrame:
    """Resolved predictions and hits so far; (0, 0) for an empty table."""
    return predictions.agg(
        F.count("correct").alias("predictions"),
        F.coalesce(F.sum("correct"), F.lit(0)).cast("bigint").alias("correct"))
