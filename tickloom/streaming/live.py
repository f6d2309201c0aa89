"""Live prediction: a signal at one tick is resolved by the next tick of the same symbol.

``LivePrediction`` treats each micro-batch as a batch job over the new ticks and
the last ticks of every symbol, so a symbol with most of the traffic is cut
into segments like any other sequence.  ``symbol_state`` does the same with a
typed state per symbol inside Spark's state store.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.price import flag
from tickloom.operators.sequence import Sequence, sequence
from tickloom.plans import features as X
from tickloom.sources.ticks import prediction_stats

TOTALS = "ticks bigint, predictions bigint, correct bigint"
STATE = f"symbol string, time bigint, price double, digit int, {TOTALS}"
STATUS = f"symbol string, {TOTALS}"
PREDICTION = ("symbol string, signal_time bigint, result_time bigint, signal_price double, result_price double, "
              "previous_digit int, predicted_digit int, actual_digit int, delta double, volatility double, correct int")
TICK = "symbol string, time bigint, price double, digit int"
SIGNAL = "symbol string, time bigint, price double, delta double, live_volatility double, previous_digit int"
CLOSING = "closing"
STATUS_EVERY = 100


@dataclass(frozen=True)
class Rule:
    """What is predicted and when.  The volatility is that of the deltas inside the last ``prices`` prices."""
    delta: float = -0.1
    volatility: float = 0.145358
    previous_digit: int = 4
    target: int = 3
    prices: int = 20

    def holds(self) -> Column:
        return ((F.col("delta") <= self.delta) & (F.col("live_volatility") <= self.volatility)
                & (F.col("previous_digit") == self.previous_digit))


def with_signal(seq: Sequence, rule: Rule) -> Sequence:
    """Delta, live volatility, previous digit, the next tick and whether the rule holds."""
    out = seq.derive(
        X.price_delta, X.live_volatility(rule.prices),
        lambda w: {"previous_digit": F.lag("digit").over(w), "result_time": F.lead("time").over(w),
                   "result_price": F.lead("price").over(w), "actual_digit": F.lead("digit").over(w)},
        back=rule.prices, fwd=1)
    return out.with_columns({"signal": F.coalesce(rule.holds(), F.lit(False))})


def resolved(df: DataFrame, rule: Rule) -> DataFrame:
    """Signals whose next tick has come.  A signal on the last tick stays pending."""
    return df.where(F.col("signal") & F.col("result_time").isNotNull()).select(
        "symbol", F.col("time").alias("signal_time"), "result_time", F.col("price").alias("signal_price"), "result_price",
        "previous_digit", F.lit(rule.target).alias("predicted_digit"), "actual_digit", "delta",
        F.col("live_volatility").alias("volatility"), flag(F.col("actual_digit") == rule.target).alias("correct"))


def distinct_ticks(ticks: DataFrame) -> DataFrame:
    """One tick per symbol and time, the one with the lowest price: the same in batch and stream, in any input order."""
    one = ticks.groupBy("symbol", "time").agg(F.min(F.struct("price", "digit")).alias("_tick"))
    return one.select("symbol", "time", "_tick.price", "_tick.digit")


def batch_predictions(ticks: DataFrame, rule: Rule) -> DataFrame:
    """All predictions of a stored tick table."""
    return resolved(with_signal(sequence(distinct_ticks(ticks), ["time"], ["symbol"]), rule).frame(), rule)


class LivePrediction:
    """``foreachBatch`` handler.  Everything it keeps is a table under ``path``, one version per micro-batch.

    A repeated micro-batch overwrites its own version, so a restart neither loses
    nor doubles a row.  Ticks may come out of order: those newer than the latest
    time seen less ``delay`` are held back until the stream has moved on, so a
    tick is lost only if it comes more than ``delay`` late.  ``close`` takes
    the held ticks in when no more will come; a later micro-batch undoes that.
    Ticks that are not newer than the last one of their symbol are ignored.

    The state has the last ticks of every symbol and its totals, so what is known of a symbol now costs the same
    at any age of the stream. A symbol without a tick for ``idle`` steps of time leaves it and starts anew when
    it comes again. Every ``compact_every`` micro-batches the results so far become one version, and versions that nothing
    needs any more are deleted.
    """

    RESULTS = ("signals", "predictions", "status")
    STEPS = ("come", "held", "input", "rows", "state")

    def __init__(self, spark: SparkSession, path: str, rule: Rule = Rule(), delay: int = 0, idle: int | None = None,
                 every: int = STATUS_EVERY, compact_every: int = 20):
        self.spark, self.path, self.rule, self.delay = spark, path.rstrip("/"), rule, delay
        self.idle, self.every, self.compact_every = idle, every, compact_every
        self._batch, self._closed = -1, False

    def _version(self, name: str, batch: int | str) -> str:
        return f"{self.path}/{name}/closing" if batch == CLOSING else f"{self.path}/{name}/batch={batch}"

    def _read(self, name: str, batch: int | str, schema: str) -> DataFrame:
        if batch == -1:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._version(name, batch))

    def _write(self, df: DataFrame, name: str, batch: int | str) -> DataFrame:
        """Write a version and read it from there on."""
        df.write.mode("overwrite").parquet(self._version(name, batch))
        return self.spark.read.schema(df.schema).parquet(self._version(name, batch))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self._closed, self._batch = False, batch_id
        held = self._read("held", batch_id - 1, TICK)
        come = self._write(distinct_ticks(batch.select("symbol", "time", "price", "digit").unionByName(held)), "come", batch_id)
        latest = come.agg(F.max("time")).first()[0]
        ready = F.col("time") <= (latest or 0) - self.delay
        self._write(come.where(~ready), "held", batch_id)
        self._advance(come.where(ready), batch_id - 1, batch_id)
        if self.compact_every and (batch_id + 1) % self.compact_every == 0:
            self.compact()

    def close(self) -> None:
        """Take in the ticks that are still held back."""
        if self._batch >= 0:
            self._advance(self._read("held", self._batch, TICK), self._batch, CLOSING)
            self._closed = True

    def _advance(self, ticks: DataFrame, before: int, batch: int | str) -> None:
        last = self._read("state", before, STATE)
        marks = last.groupBy("symbol").agg(F.max("time").alias("_mark"))
        none = [F.lit(None).cast("bigint").alias(c.split()[0]) for c in TOTALS.split(", ")]
        fresh = (ticks.join(marks, "symbol", "left")
                 .where(F.col("_mark").isNull() | (F.col("time") > F.col("_mark")))
                 .select("symbol", "time", "price", "digit", *none, F.lit(True).alias("is_new")))
        rows = self._write(last.withColumn("is_new", F.lit(False)).unionByName(fresh), "input", batch)
        seq = with_signal(sequence(rows, ["time"], ["symbol"]), self.rule)
        # The next tick must be new, or the signal was resolved in an earlier batch.
        seq = seq.derive(lambda w: {"_next_new": F.lead("is_new").over(w), "_resolves": F.lag("signal").over(w)}, back=1, fwd=1)
        # Totals so far: those stored with the last old tick, plus what is new since.
        resolves = F.col("is_new") & F.coalesce("_resolves", F.lit(False))
        new = {"ticks": F.col("is_new"), "predictions": resolves,
               "correct": resolves & (F.col("digit") == self.rule.target)}
        seq = seq.running({**{f"_old_{c}": (F.col(c), "max") for c in new},
                           **{f"_new_{c}": (flag(is_one).cast("bigint"), "sum") for c, is_one in new.items()}})
        seq = seq.with_columns({c: F.coalesce(f"_old_{c}", F.lit(0)) + F.col(f"_new_{c}") for c in new})
        done = self._write(seq.frame().select(
            "symbol", "time", "price", "digit", "is_new", "signal", *new, "delta", "live_volatility", "previous_digit",
            "result_time", "result_price", "actual_digit", "_next_new"), "rows", batch)
        self._write(done.where("is_new AND signal").select(
            "symbol", "time", "price", "delta", "live_volatility", "previous_digit"), "signals", batch)
        self._write(resolved(done.where("_next_new"), self.rule), "predictions", batch)
        self._write(done.where(F.col("is_new") & (F.col("ticks") % self.every == 0)).select(
            "symbol", "ticks", "predictions", "correct"), "status", batch)
        newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("time").desc()))
        kept = done.withColumn("_r", newest).where(F.col("_r") <= self.rule.prices + 1)
        if self.idle is not None:
            latest = done.agg(F.max("time")).first()[0] or 0
            alive = kept.groupBy("symbol").agg(F.max("time").alias("_last")).where(F.col("_last") >= latest - self.idle)
            kept = kept.join(alive, "symbol", "left_semi")
        self._write(kept.select(*[c.split()[0] for c in STATE.split(", ")]), "state", batch)

    def compact(self) -> None:
        """One version of every result for all micro-batches so far; older steps go, but for those of the last two."""
        if self._batch < 0:
            return
        for name, schema in zip(self.RESULTS, (SIGNAL, PREDICTION, STATUS)):
            # A repeated micro-batch finds what it has merged before.
            if not any(kind == "upto" and number == self._batch for _, kind, number in self._found(name)):
                self.spark.read.schema(schema).parquet(*self._versions(name)).write.mode("overwrite").parquet(
                    f"{self.path}/{name}/upto={self._batch}")
        for name in (*self.RESULTS, *self.STEPS):
            for path, kind, number in self._found(name):
                if (kind == "upto" and number < self._batch) or (kind == "batch" and number < self._batch - 1):
                    self._files().delete(self._at(path), True)

    def _files(self):
        return self._at(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _found(self, name: str) -> list[tuple[str, str, int]]:
        """Whole versions on storage: path, kind (batch or upto) and micro-batch."""
        files, out = self._files(), []
        if not files.exists(self._at(f"{self.path}/{name}")):
            return out
        for status in files.listStatus(self._at(f"{self.path}/{name}")):
            kind, _, number = status.getPath().getName().partition("=")
            path = status.getPath().toString()
            if number and files.exists(self._at(f"{path}/_SUCCESS")):
                out.append((path, kind, int(number)))
        return out

    def _versions(self, name: str) -> list[str]:
        """Paths that together have a result of all micro-batches, each once."""
        found = self._found(name)
        upto = max((n for _, kind, n in found if kind == "upto"), default=-1)
        return [p for p, kind, n in found if (kind == "upto" and n == upto) or (kind == "batch" and n > upto)]

    def _all(self, name: str, schema: str) -> DataFrame:
        paths = self._versions(name) + ([self._version(name, CLOSING)] if self._closed else [])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def predictions(self) -> DataFrame:
        return self._all("predictions", PREDICTION)

    def signals(self) -> DataFrame:
        return self._all("signals", SIGNAL)

    def state(self) -> DataFrame:
        """The last ticks of every symbol and its totals up to each of them, as the next micro-batch will find them."""
        if self._batch < 0:
            self._batch = max((n for _, kind, n in self._found("state") if kind == "batch"), default=-1)
        return self._read("state", CLOSING if self._closed else self._batch, STATE)

    def accuracy(self) -> DataFrame:
        """Ticks, predictions and hits so far, per symbol; read from the state alone."""
        last = self.state().groupBy("symbol").agg(F.max(F.struct("ticks", "predictions", "correct")).alias("now"))
        return with_accuracy(last.select("symbol", "now.*"))

    def totals(self) -> DataFrame:
        return prediction_stats(self.predictions())

    def status(self) -> DataFrame:
        """One row for every 100th tick of a symbol: predictions resolved and hits up to that tick."""
        return with_accuracy(self._all("status", STATUS))


def with_accuracy(totals: DataFrame) -> DataFrame:
    return totals.withColumn("accuracy", F.when(F.col("predictions") > 0, F.col("correct") / F.col("predictions")))


def run_available(stream: DataFrame, handler, checkpoint: str) -> None:
    """Process all that has arrived, in order, and stop; a later call goes on from the checkpoint."""
    query = (stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def append_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append a stream to a table with exactly-once files."""
    query = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()


def run_until(stream: DataFrame, handler: BoundedCollection, checkpoint: str, seconds: float | None = None) -> bool:
    """Run a stream until the handler's target is reached (true), no more comes within ``seconds``, or it fails.

    Without ``seconds`` it waits for new data for ever. A stream without new data looks for some nearly all the time,
    so an active trigger does not count as data; time runs from the first look that found nothing.
    """
    query = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).start()
    since, last = None, None
    try:
        while not handler.reached() and not query.awaitTermination(0.2):
            status, progress = query.status, query.lastProgress
            batch = progress["batchId"] if progress else None
            if status["isDataAvailable"] or batch != last:
                since, last = None, batch
            elif since is None:
                since = time.monotonic() if status["message"] == "Waiting for data to arrive" else None
            elif seconds is not None and time.monotonic() - since >= seconds:
                break
    finally:
        query.stop()
    return handler.reached()


class BoundedCollection:
    """``foreachBatch`` handler that stores ticks until ``target`` rows are saved, and nothing from then on.

    Of the micro-batch that reaches the target the first ticks in order of (time, symbol, price) are taken, so what is kept
    follows from the order of arrival alone. Each version notes how many rows are saved with it, so no older version is
    read again; a repeated micro-batch replaces its own. ``run_until`` ends the stream at the target.
    """

    def __init__(self, spark: SparkSession, path: str, target: int):
        self.spark, self.path, self.target = spark, path.rstrip("/"), target

    def saved(self, before: int | None = None) -> int:
        """Rows saved, or rows saved by the micro-batches before one."""
        notes = self.spark.read.schema("saved bigint, batch int").option("ignoreMissingFiles", True)
        if not self._exists(f"{self.path}/saved"):
            return 0
        rows = notes.parquet(f"{self.path}/saved")
        return (rows if before is None else rows.where(F.col("batch") < before)).agg(F.max("saved")).first()[0] or 0

    def reached(self) -> bool:
        return self.saved() >= self.target

    def rows(self) -> DataFrame:
        return self.spark.read.schema(TICK + ", batch int").parquet(f"{self.path}/ticks")

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        before = self.saved(batch_id)
        if before >= self.target:
            return
        path = f"{self.path}/ticks/batch={batch_id}"
        come = batch.select("symbol", "time", "price", "digit")
        come.write.mode("overwrite").parquet(path)
        count = self.spark.read.schema(TICK).parquet(path).count()
        if before + count > self.target:
            first = come.orderBy("time", "symbol", "price").limit(self.target - before)
            first.write.mode("overwrite").parquet(path)
            count = self.target - before
        note = self.spark.range(1).select(F.lit(before + count).cast("bigint").alias("saved"))
        note.write.mode("overwrite").parquet(f"{self.path}/saved/batch={batch_id}")


class MarkedCollection:
    """``foreachBatch`` handler that stores only ticks newer than the latest stored one of their symbol.

    The stored table is all it goes by: a stream whose checkpoint is lost starts again, ``back_fill`` closes the gap from a
    bounded history, and nothing is stored twice, whatever the stream repeats. A version is named by ``run``, which
    stands for one checkpoint, and its micro-batch; a repeated micro-batch replaces its own. Each version has the
    marks of its symbols beside it, so finding the marks reads no ticks.
    """

    MARK = "symbol string, last_time bigint, version string"

    def __init__(self, spark: SparkSession, path: str, run: str):
        self.spark, self.path, self.run = spark, path.rstrip("/"), run

    def rows(self) -> DataFrame:
        return self.spark.read.schema(TICK + ", version string").parquet(f"{self.path}/ticks").drop("version")

    def marks(self, but: str | None = None) -> DataFrame:
        """Latest stored time of every symbol, without those of one version."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/marks")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], "symbol string, last_time bigint")
        rows = self.spark.read.schema(self.MARK).parquet(f"{self.path}/marks")
        rows = rows if but is None else rows.where(F.col("version") != but)
        return rows.groupBy("symbol").agg(F.max("last_time").alias("last_time"))

    def back_fill(self, history: DataFrame) -> None:
        """Take in the ticks of a bounded history that are newer than the marks."""
        self._take(history, f"{self.run}-history")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self._take(batch, f"{self.run}-{batch_id}")

    def _take(self, ticks: DataFrame, version: str) -> None:
        marks = self.marks(version)
        come = distinct_ticks(ticks.select("symbol", "time", "price", "digit")).join(marks, "symbol", "left")
        fresh = come.where(F.col("last_time").isNull() | (F.col("time") > F.col("last_time"))).drop("last_time")
        path = f"{self.path}/ticks/version={version}"
        fresh.write.mode("overwrite").parquet(path)
        # The mark comes last: without it the version counts as not stored and is written again.
        self.spark.read.schema(TICK).parquet(path).groupBy("symbol").agg(F.max("time").alias("last_time")).write.mode(
            "overwrite").parquet(f"{self.path}/marks/version={version}")
