"""Live prediction with a typed state per symbol in Spark's state store: last prices, counters and a pending signal.

A micro-batch of a symbol is worked off with array operations. Its rows meet in one task, so bound a micro-batch with the
source's rate limit, and let micro-batches follow each other in time; ``LivePrediction`` cuts hot symbols and takes
disorder.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tickloom.streaming.live import PREDICTION, Rule

if TYPE_CHECKING:
    import pandas as pd

TICKS = "time bigint, price double, digit int"
TOTALS = ("ticks bigint, signals bigint, predictions bigint, correct bigint, pending boolean, delta double, "
          "volatility double")
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Typed states need the store that keeps them on disk."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


class SymbolProcessor(StatefulProcessor):
    """State of a symbol: its last ``rule.prices`` ticks and its totals. A timer drops a symbol that has been idle."""

    def __init__(self, rule: Rule, idle: int | None, unit: int) -> None:
        self.rule, self.idle, self.unit = rule, idle, unit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", TICKS)
        self.totals = handle.getValueState("totals", TOTALS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd

        rule = self.rule
        old = list(self.buffer.get()) if self.buffer.exists() else []
        ticks, signals, predictions, correct, pending, delta, volatility = self.totals.get() if self.totals.exists() else (
            0, 0, 0, 0, False, None, None)
        come = pd.concat(list(rows)).sort_values(["time", "price"]).drop_duplicates("time")
        last = old[-1][0] if old else None
        come = come[come["time"] > last] if last is not None else come
        if len(come):
            time, price, digit = (np.array([r[k] for r in old] + come[c].tolist()) for k, c in enumerate(
                ("time", "price", "digit")))
            n, first = len(time), len(old)
            step = np.r_[np.nan, np.diff(price)]
            spread = np.full(n, np.nan)
            if n >= rule.prices:
                spread[rule.prices - 1:] = np.lib.stride_tricks.sliding_window_view(step[1:], rule.prices - 1).std(1, ddof=1)
            before = np.r_[-1, digit[:-1]]
            holds = (step <= rule.delta) & (spread <= rule.volatility) & (before == rule.previous_digit)
            if first:
                # The values at the last stored tick need prices that have left the buffer.
                holds[:first], step[first - 1] = False, np.nan if delta is None else delta
                holds[first - 1], spread[first - 1] = pending, np.nan if volatility is None else volatility
            at = np.flatnonzero(holds[max(first - 1, 0):n - 1]) + max(first - 1, 0)
            hit = digit[at + 1] == rule.target
            if len(at):
                yield pd.DataFrame({
                    "symbol": key[0], "signal_time": time[at], "result_time": time[at + 1], "signal_price": price[at],
                    "result_price": price[at + 1], "previous_digit": before[at], "predicted_digit": rule.target,
                    "actual_digit": digit[at + 1], "delta": step[at], "volatility": spread[at], "correct": hit.astype(int)})
            self.totals.update((
                ticks + n - first, signals + int(holds[first:].sum()), predictions + len(at), correct + int(hit.sum()),
                bool(holds[-1]), None if np.isnan(step[-1]) else float(step[-1]),
                None if np.isnan(spread[-1]) else float(spread[-1])))
            self.buffer.put([(int(t), float(p), int(d)) for t, p, d in zip(
                time[-rule.prices:], price[-rule.prices:], digit[-rule.prices:])])
            if self.idle is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(int((time[-1] + self.idle) * 1000 // self.unit))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.buffer.clear()
        self.totals.clear()
        return iter(())

    def close(self) -> None:
        pass


def stateful_predictions(ticks: DataFrame, rule: Rule, idle: int | None = None, unit: int = 1,
                         delay: str = "0 seconds") -> DataFrame:
    """Resolved predictions of a tick stream (symbol, time, price, digit).

    A symbol without a tick for ``idle`` steps of time is dropped and starts anew when it comes again; ``unit`` is the number
    of steps per second, and ticks more than ``delay`` behind the stream are late then. Without ``idle`` every
    symbol stays. Ticks not newer than the last one of their symbol are ignored; of equal times the lowest price
    counts. Start the query inside ``state_store``.
    """
    rows = ticks.select("symbol", "time", "price", "digit")
    if idle is not None:
        rows = rows.withColumn("at", F.timestamp_seconds(F.col("time") / unit)).withWatermark("at", delay)
    return rows.groupBy("symbol").transformWithStateInPandas(
        SymbolProcessor(rule, idle, unit), PREDICTION, "Append", "None" if idle is None else "EventTime")


def symbol_states(spark: SparkSession, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """The states after the last micro-batch of a checkpoint: buffered ticks and totals, one row per tick and symbol."""
    def read(name: str) -> DataFrame:
        return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()

    buffer = read("buffer").select(F.col("key.symbol").alias("symbol"), "list_element.*")
    return buffer, read("totals").select(F.col("key.symbol").alias("symbol"), "value.*")
