"""Ordered operators that run in parallel even on one long sequence.

A window without a small partition key sends a whole sequence to one task.
``Sequence`` cuts every key that has too many rows into segments, contiguous
ranges of its order, and runs each window per (key, segment):

* lag, lead and trailing frames get the few neighbour rows they need copied in
  from the adjacent segments (``derive``);
* positions, running totals and runs are the value inside the segment plus a
  carry from the segments before it (``number``, ``running``, ``runs``).

Segment edges are literals taken from a sample, so a retried task always cuts
at the same place, and any choice of edges gives the same result.  Keys that
fit into one task are not cut and get the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence as Seq
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.storage import stored

ROWS_PER_SEGMENT = 4_000_000
MAX_SEGMENTS = 100_000
SAMPLE_PER_SEGMENT = 30
ROWS_SETTING = "tickloom.segment.rows"

SEG = "_seg"
OWN = "_own"

Stage = Callable[[WindowSpec], dict[str, Column]]


def epoch_micros(c: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    seconds = F.unix_date(F.to_date(c)).cast("bigint") * 86_400 + F.hour(c) * 3_600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


def _same(left: DataFrame, right: DataFrame, names: Seq[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[f"_r_{n}"])
    return cond


def lookup(df: DataFrame, small: DataFrame, on: Seq[str]) -> DataFrame:
    """Left join with a table that has at most ``MAX_SEGMENTS`` rows per use."""
    right = small.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in small.columns])
    out = df.join(F.broadcast(right), _same(df, right, on), "left")
    return out.drop(*[f"_r_{c}" for c in on])


_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Sequence:
    df: DataFrame
    by: tuple[str, ...]
    order: tuple[str, ...]
    split: bool = False
    fresh: bool = True  # a scan or a stored table: cheap to read several times

    # ---- plain DataFrame steps; they keep the cut -------------------------

    def where(self, condition: Column) -> "Sequence":
        return replace(self, df=self.df.where(condition))

    def with_columns(self, columns: dict[str, Column]) -> "Sequence":
        return replace(self, df=self.df.withColumns(columns))

    def without(self, *names: str) -> "Sequence":
        return replace(self, df=self.df.drop(*names))

    def select(self, *names: str) -> "Sequence":
        """Keep the named columns, the key, the order and the cut."""
        keep = list(dict.fromkeys([*self.by, *self.order, *names, *([SEG] if self.split else [])]))
        return replace(self, df=self.df.select(*keep))

    def store(self) -> "Sequence":
        """Write once before several uses; a sequence that fits one task is left lazy."""
        return replace(self, df=stored(self.df), fresh=True) if self.split else self

    def _reusable(self) -> "Sequence":
        """A cut sequence is read more than once per operator, so window results are stored first."""
        return self if self.fresh else self.store()

    def frame(self) -> DataFrame:
        return self.df.drop(SEG)

    # ---- windows ----------------------------------------------------------

    def window(self, descending: bool = False) -> WindowSpec:
        part = [F.col(c) for c in self.by] + ([F.col(SEG)] if self.split else [])
        if descending:
            return Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in self.order])
        return Window.partitionBy(*part).orderBy(*[F.col(c).asc() for c in self.order])

    def _segments(self) -> DataFrame:
        """Rows and start position of each segment of the cut keys."""
        per = (self.df.where(F.col(SEG) >= 0).groupBy(*self.by, SEG)
               .agg(F.count(F.lit(1)).alias("_n")))
        w = Window.partitionBy(*self.by).orderBy(SEG)
        before = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1))
        total = F.sum("_n").over(Window.partitionBy(*self.by))
        return per.withColumns({"_seg_start": F.coalesce(before, F.lit(0)), "_seg_total": total})

    def _halo(self, back: int, fwd: int) -> DataFrame:
        """Copies of the rows next to a segment, marked with that segment."""
        segments = self._segments()
        w = Window.partitionBy(*self.by).orderBy(SEG)
        cut = self.df.where(F.col(SEG) >= 0)
        parts = []
        if back:
            # A segment may be shorter than the frame, so a row can serve several;
            # those out of reach are dropped before the small table is broadcast.
            reach = segments.select(
                *self.by, SEG, (F.col("_seg_start") + F.col("_n")).alias("_end"),
                F.collect_list(F.struct(F.col(SEG).alias("to"), F.col("_seg_start").alias("at")))
                .over(w.rowsBetween(1, back)).alias("_reach"))
            edge = (cut.withColumn("_r", F.row_number().over(self.window(descending=True)))
                    .where(F.col("_r") <= back))
            near = reach.withColumn("_reach", F.filter("_reach", lambda t: t["at"] - F.col("_end") < back))
            parts.append(lookup(edge, near, [*self.by, SEG]).withColumn(
                "_to", F.explode(F.filter("_reach", lambda t: F.col("_r") + t["at"] - F.col("_end") <= back))))
        if fwd:
            reach = segments.select(
                *self.by, SEG, F.col("_seg_start").alias("_end"),
                F.collect_list(F.struct(F.col(SEG).alias("to"), (F.col("_seg_start") + F.col("_n")).alias("at")))
                .over(w.rowsBetween(-fwd, -1)).alias("_reach"))
            edge = cut.withColumn("_r", F.row_number().over(self.window())).where(F.col("_r") <= fwd)
            near = reach.withColumn("_reach", F.filter("_reach", lambda t: F.col("_end") - t["at"] < fwd))
            parts.append(lookup(edge, near, [*self.by, SEG]).withColumn(
                "_to", F.explode(F.filter("_reach", lambda t: F.col("_r") + F.col("_end") - t["at"] <= fwd))))
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return (out.withColumns({SEG: F.col("_to.to"), OWN: F.lit(False)})
                .drop("_r", "_end", "_reach", "_to"))

    def derive(self, *stages: Stage, back: int = 0, fwd: int = 0,
               pos: str | None = None, total: str | None = None) -> "Sequence":
        """Add window columns that look at most ``back`` rows back and ``fwd`` ahead.

        Each stage maps a window to new columns and may use those of the stages
        before it; ``back`` and ``fwd`` cover all stages together.  ``pos`` names
        a 0-based position within the key, ``total`` the rows of the key.
        """
        w = self.window()
        if not self.split:
            df = self.df
            if pos:
                df = df.withColumn(pos, F.row_number().over(w).cast("bigint") - 1)
            if total:
                df = df.withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(*self.by)))
            for stage in stages:
                df = df.withColumns(stage(w))
            return replace(self, df=df, fresh=False)
        base = self._reusable()
        df = base.df.withColumn(OWN, F.lit(True))
        if back or fwd:
            df = df.unionByName(base._halo(back, fwd))
        if pos:
            own = F.col(OWN).cast("bigint")
            df = df.withColumn(pos, F.sum(own).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
        for stage in stages:
            df = df.withColumns(stage(w))
        df = df.where(OWN).drop(OWN)
        if pos or total:
            own_rows = F.count(F.lit(1)).over(Window.partitionBy(*self.by, SEG)) if total else None
            if total:
                df = df.withColumn("_rows", own_rows)
            df = lookup(df, base._segments().drop("_n"), [*self.by, SEG])
            if pos:
                df = df.withColumn(pos, F.col(pos) + F.coalesce("_seg_start", F.lit(0)))
            if total:
                df = df.withColumn(total, F.coalesce("_seg_total", "_rows")).drop("_rows")
            df = df.drop("_seg_start", "_seg_total")
        return replace(self, df=df, fresh=False)

    def number(self, pos: str, total: str | None = None) -> "Sequence":
        """Add the 0-based position of each row within its key."""
        return self.derive(pos=pos, total=total)

    def running(self, columns: dict[str, tuple]) -> "Sequence":
        """Add running ``sum``, ``max`` or ``min`` from the start of the key up to each row.

        A column is (value, how) or (value, how, True); the latter runs from the
        end of the key back to each row.
        """
        plan = {n: (c[0], c[1], len(c) > 2 and c[2]) for n, c in columns.items()}
        back_to_start = Window.unboundedPreceding

        def over(reverse: bool) -> WindowSpec:
            return self.window(descending=reverse).rowsBetween(back_to_start, 0)
        local = {n: _FOLD[how](v).over(over(rev)) for n, (v, how, rev) in plan.items()}
        if not self.split:
            return replace(self, df=self.df.withColumns(local), fresh=False)
        base = self._reusable()
        totals = (base.df.where(F.col(SEG) >= 0).groupBy(*self.by, SEG)
                  .agg(*[_FOLD[how](v).alias(f"_t_{n}") for n, (v, how, _) in plan.items()]))

        def before(reverse: bool) -> WindowSpec:
            step = F.col(SEG).desc() if reverse else F.col(SEG).asc()
            return Window.partitionBy(*self.by).orderBy(step).rowsBetween(back_to_start, -1)
        carry = totals.select(*self.by, SEG, *[_FOLD[how](f"_t_{n}").over(before(rev)).alias(f"_c_{n}")
                                               for n, (_, how, rev) in plan.items()])
        out = lookup(base.df.withColumns(local), carry, [*self.by, SEG])
        merged = {}
        for n, (_, how, _) in plan.items():
            here, prior = F.col(n), F.col(f"_c_{n}")
            if how == "sum":
                merged[n] = F.coalesce(here + prior, here, prior)
            else:
                merged[n] = (F.greatest if how == "max" else F.least)(here, prior)
        return replace(self, df=out.withColumns(merged).drop(*[f"_c_{n}" for n in plan]), fresh=False)

    def runs(self, value: str, pos: str, start: str = "run_start", length: str = "run_length",
             size: str | None = None) -> "Sequence":
        """Runs of equal ``value``: where each starts, rows so far, and rows in all (``size``).

        ``pos`` must hold the position within the key.  A run may span segments.
        """
        v = F.col(value)
        opens = lambda w: {"_opens": F.when((F.col(pos) == 0) | ~v.eqNullSafe(F.lag(v).over(w)), F.col(pos))}
        closes = lambda w: {"_closes": F.when(F.lead(F.lit(1)).over(w).isNull() | ~v.eqNullSafe(F.lead(v).over(w)),
                                              F.col(pos))}
        flagged = self.derive(opens, *([closes] if size else []), back=1, fwd=1 if size else 0)
        wanted = {start: (F.col("_opens"), "max")}
        if size:
            wanted["_end"] = (F.col("_closes"), "min", True)
        out = flagged.running(wanted)
        out = out.with_columns({length: F.col(pos) - F.col(start) + 1})
        if size:
            out = out.with_columns({size: F.col("_end") - F.col(start) + 1})
        return replace(out, df=out.df.drop("_opens", "_closes", "_end"))


def sequence(df: DataFrame, order: Seq[str], by: Seq[str] = (), rows_per_segment: int | None = None,
             max_segments: int = MAX_SEGMENTS) -> Sequence:
    """Order ``df`` by ``order`` within ``by`` and cut the keys that are too long.

    ``order`` must be unique within a key: a time column and a tie breaker, of any types that sort.
    Runs one small aggregate; only if a key is too long also one sample.
    """
    if not order:
        raise ValueError("order needs at least one column")
    order, by = tuple(order), tuple(by)
    spark = df.sparkSession
    if rows_per_segment is None:
        rows_per_segment = int(spark.conf.get(ROWS_SETTING, str(ROWS_PER_SEGMENT)))

    per_key = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    longest, rows = per_key.agg(F.max("_n"), F.sum("_n")).first()
    if not longest or longest <= rows_per_segment:
        return Sequence(df, by, order)

    limit = max(rows_per_segment, math.ceil(rows / max_segments))
    # At most rows / limit keys are longer than limit.
    hot = [r.asDict() for r in per_key.where(F.col("_n") > limit).collect()]
    if not hot:
        return Sequence(df, by, order)
    pieces = [math.ceil(h["_n"] / limit) for h in hot]
    fields = [df.schema[c] for c in by]
    marked = _with_table(df, by, [*fields, T.StructField("_pieces", T.IntegerType())],
                         [(*[h[c] for c in by], n) for h, n in zip(hot, pieces)])
    share = sum(pieces) * SAMPLE_PER_SEGMENT / sum(h["_n"] for h in hot)
    sample = marked.where(F.col("_pieces").isNotNull())
    if share < 0.9:
        sample = sample.sample(fraction=share, seed=7)
    # Rows are placed by all order columns together, so rows that share the first are told apart by the next. The
    # sample of a key has about SAMPLE_PER_SEGMENT rows for each of its segments.
    at = F.struct(*[F.col(c) for c in order])
    drawn = sample.groupBy(*by, "_pieces").agg(F.sort_array(F.collect_list(at)).alias("_drawn"))
    edge = F.transform(F.sequence(F.lit(1), F.col("_pieces") - 1), lambda j: F.element_at(
        "_drawn", F.floor(F.size("_drawn") * j / F.col("_pieces")).cast("int") + 1))
    found = drawn.select(*by, F.array_distinct(edge).alias("_edges"))
    kind = found.schema["_edges"].dataType
    # Only the edges, one less than segments, reach the driver and go back as literals.
    edges = [tuple(r) for r in found.collect()]
    if not edges:
        return Sequence(df, by, order)
    cut = _with_table(df, by, [*fields, T.StructField("_edges", kind)], edges)
    cut = cut.withColumn(SEG, F.when(F.col("_edges").isNull(), F.lit(-1)).otherwise(_rank_among("_edges", at)))
    return Sequence(cut.drop("_edges"), by, order, split=True)


def _with_table(df: DataFrame, by: Seq[str], fields: list[T.StructField], rows: list[tuple]) -> DataFrame:
    """Add columns from a few rows: one per key, or one for all where there is no key."""
    small = df.sparkSession.createDataFrame(rows, T.StructType([
        T.StructField(f.name, f.dataType, True) for f in fields]))
    if "_edges" in small.columns:
        # Runs of edges, so that a row is compared with the first of each run and then inside one run.
        n = F.size("_edges")
        width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
        runs = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")),
                           lambda i: F.slice("_edges", i * width + 1, width))
        small = small.withColumn("_edges", F.struct(
            runs.alias("runs"), F.transform(runs, lambda r: r[0]).alias("heads"), width.alias("width")))
    return lookup(df, small, by) if by else df.join(F.broadcast(small), how="cross")


def _rank_among(edges: str, at: Column) -> Column:
    """How many edges are not above ``at``."""
    heads = F.size(F.filter(F.col(edges)["heads"], lambda e: e <= at))
    inside = F.size(F.filter(F.element_at(F.col(edges)["runs"], heads), lambda e: e <= at))
    return F.when(heads == 0, 0).otherwise((heads - 1) * F.col(edges)["width"] + inside)
