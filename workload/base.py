"""Registered queries over the given tables, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.conditions import Drop
from tickloom.operators.sequence import Sequence
from tickloom.plans import features as X
from tickloom.sources.ticks import as_ticks, in_time_order

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# The steps of the events table are larger than those of the published ticks.
EVENT_SIGNAL = Drop(delta=-10.0, volatility=60.0)
P0 = 0.1
TARGET = 3


def hit() -> Column:
    """Outcome of the standard signal: the next digit is the target."""
    return F.col("next_digit") == TARGET


def query(name: str, sql: str | None = None, nullable: tuple[str, ...] | list[str] = ()) -> Callable[[Query], Query]:
    """Register a query; whole-number columns that may be null are compared as doubles."""
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return rounded(df.withColumns({c: F.col(c).cast("double") for c in nullable}) if nullable else df)
        QUERIES[name] = run
        if sql is not None:
            cast = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in nullable)
            ORACLE[name] = f"SELECT * REPLACE ({cast}) FROM ({sql})" if nullable else sql
        return fn
    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles as the SQL does; adding 0.0 turns a negative zero into zero."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else F.col(f"`{f.name}`") for f in df.schema.fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str, symbol: str | None = "event_type", keep: tuple[str, ...] = ()) -> DataFrame:
    return as_ticks(table(spark, sf_dir, "events"), "ts", "value", "event_id", symbol, keep)


def ordered(spark: SparkSession, sf_dir: str, symbol: str | None = "event_type") -> Sequence:
    return in_time_order(ticks(spark, sf_dir, symbol), ("symbol",) if symbol else ())


def inputs(spark: SparkSession, sf_dir: str, windows: tuple[int, ...] = (10,), symbol: str | None = "event_type",
           forward: bool = False) -> Sequence:
    """Usable rows: delta, volatility and next digit known; ``row`` is the position before dropping."""
    seq = X.signal_inputs(ordered(spark, sf_dir, symbol), windows, forward, pos="row")
    return X.usable(seq, "delta", *[f"vol{n}" for n in windows], "next_digit")


def signals(spark: SparkSession, sf_dir: str, symbol: str | None = "event_type",
            condition: Column | None = None) -> Sequence:
    cond = EVENT_SIGNAL.holds() if condition is None else condition
    return inputs(spark, sf_dir, symbol=symbol).where(cond).store()


# ---- SQL pieces -------------------------------------------------------------

TICK_SQL = """t AS (SELECT ts AS time, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS epoch, event_id AS tie,
  event_type AS symbol, value AS price,
  CAST(abs(CAST(round(value * 100) AS BIGINT)) % 10 AS INTEGER) AS digit
  FROM events WHERE ts IS NOT NULL AND value IS NOT NULL)"""


def part(by: str | None) -> str:
    return f"PARTITION BY {by} " if by else ""


def tick_cte(by: str | None = "symbol", windows: tuple[int, ...] = (10,), forward: bool = False,
             more: str = "") -> str:
    """WITH t (ticks), d (neighbours), f (volatility)."""
    delta = "lead(price) OVER w - price" if forward else "price - lag(price) OVER w"
    vols = "".join(f", CASE WHEN count(delta) OVER v{n} = {n} THEN stddev_samp(delta) OVER v{n} END AS vol{n}"
                   for n in windows)
    frames = ", ".join(f"v{n} AS ({part(by)}ORDER BY time, tie ROWS {n - 1} PRECEDING)" for n in windows)
    return f"""WITH {TICK_SQL},
d AS (SELECT *, row_number() OVER w - 1 AS row, {delta} AS delta, lag(price) OVER w AS previous_price,
  lag(digit) OVER w AS previous_digit, lead(digit) OVER w AS next_digit{more}
  FROM t WINDOW w AS ({part(by)}ORDER BY time, tie)),
f AS (SELECT *{vols} FROM d WINDOW {frames})"""


def usable_cte(by: str | None = "symbol", windows: tuple[int, ...] = (10,), forward: bool = False) -> str:
    known = " AND ".join(["delta IS NOT NULL", "next_digit IS NOT NULL", *[f"vol{n} IS NOT NULL" for n in windows]])
    return tick_cte(by, windows, forward) + f",\nu AS (SELECT * FROM f WHERE {known})"


SIGNAL_SQL = "delta <= -10 AND vol10 <= 60"


def signal_cte(by: str | None = "symbol", condition: str = SIGNAL_SQL) -> str:
    return usable_cte(by) + f",\ns AS (SELECT *, CAST(next_digit = {TARGET} AS INTEGER) AS hit, " \
        f"row_number() OVER ({part(by)}ORDER BY time, tie) - 1 AS k FROM u WHERE {condition})"


def p_greater(k: str, n: str, p: float) -> str:
    mass = (f"exp(lgamma({n} + 1.0) - lgamma(i + 1.0) - lgamma({n} - i + 1.0) "
            f"+ i * ln({p}) + ({n} - i) * ln(1 - {p}))")
    return f"(CASE WHEN {k} <= 0 THEN 1.0 ELSE (SELECT sum({mass}) FROM range(CAST({k} AS BIGINT), CAST({n} AS BIGINT) + 1) r(i)) END)"


def score_sql(source: str, keys: str, p0: float = P0, empty: str = "zero", cte: str = "", more: str = "",
              p_value: str | None = None) -> str:
    """Hit-test columns over a source with columns ``keys``, observations, correct."""
    none = "NULL" if empty == "null" else "0.0"
    none_p = "NULL" if empty in ("null", "null_p") else "1.0"
    where = "WHERE observations > 0" if empty == "skip" else ""
    head = f"{keys}, " if keys else ""
    tail = f", {more}" if more else ""
    p = p_value or p_greater("correct", "observations", p0)
    return f"""{cte}
SELECT {head}CAST(observations AS BIGINT) AS observations, CAST(correct AS BIGINT) AS correct,
  round(CASE WHEN observations > 0 THEN correct / observations ELSE {none} END, 6) + 0.0 AS probability,
  round(CASE WHEN observations > 0 THEN correct / observations - {p0} ELSE {none} END, 6) + 0.0 AS difference,
  round(CASE WHEN observations > 0 THEN {p} ELSE {none_p} END, 6) + 0.0 AS p_value{tail}
FROM ({source}) {where}"""


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"
