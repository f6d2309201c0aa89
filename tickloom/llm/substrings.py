"""Removal of repeated byte strings, by ranks of positions at doubling depths."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.base import per_text, query, table, texts
from tickloom.llm.shingles import BASE, BYTE, INVERSE, mixed, powers
from tickloom.storage import stored

LENGTH = 50
GRAM = 16
SEGMENT = 16 << 20
PLACE_BITS = 26  # a segment's positions fit into so many bits


def doubled(data: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every position by its next ``depth`` bytes (a power of two).

    The rank at twice the depth is made from the pair of ranks at p and p + depth. Ranks are hashes, so equal strings
    have equal ranks everywhere, with no sort needed to name them.
    """
    rank, n, base = BYTE[data], 1, int(BASE)
    while n < depth:
        rank = rank[:-n] * np.uint64(base) + rank[n:]
        base, n = base * base % 2 ** 64, 2 * n
    return mixed(rank)


def lowest(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each window of ``width``, from minima over doubling widths."""
    n = 1
    while 2 * n <= width:
        key, n = np.minimum(key[:-n], key[n:]), 2 * n
    return np.minimum(key[:n - width], key[width - n:]) if n < width else key


class Buffer:
    """Texts end to end as bytes, with hashes of any part."""

    def __init__(self, parts: list[bytes], length: int) -> None:
        self.data = np.frombuffer(b"".join(parts) + bytes(length + GRAM), np.uint8)
        sizes = np.array([len(p) for p in parts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(
            BYTE[self.data] * powers(BASE, len(self.data)), dtype=np.uint64)])

    def hashes(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Equal for equal strings of one length."""
        return mixed((self.total[hi] - self.total[lo]) * powers(INVERSE, len(self.data))[lo])


def short(hashes: np.ndarray) -> np.ndarray:
    """14 bits of a hash, never 0."""
    return np.maximum(hashes >> np.uint64(50), np.uint64(1))


def cells(parts: list[bytes], length: int) -> dict[str, np.ndarray]:
    """The anchors of all strings of ``length`` bytes, one row per anchor.

    The anchor of such a string is its leftmost gram of smallest rank. Equal strings have it at equal places, so each
    string is compared under its anchor's gram alone. The strings with one anchor start in a row; together they are
    the anchor's cell. Columns: part, ``a`` first start, ``n`` number of starts, ``off`` from the first start to the
    gram, gram, whole (hash of the cell), and short hashes of 33 bytes that end, or begin, with the gram (0: not in the
    cell).
    """
    buf = Buffer(parts, length)
    grams = doubled(buf.data, GRAM)
    place = np.uint64((1 << PLACE_BITS) - 1)
    key = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    anchor = (lowest(key, length - GRAM + 1) & place).astype(np.int64)
    owner = np.repeat(np.arange(len(parts)), buf.ends - buf.starts)
    at = np.flatnonzero(np.arange(len(owner)) + length <= buf.ends[owner])
    if not len(at):
        none = np.zeros(0, np.int64)
        return dict.fromkeys(("part", "a", "n", "off", "gram", "whole", "left", "right"), none)
    who, p = owner[at], anchor[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (p[1:] != p[:-1]) | (who[1:] != who[:-1])
    first = np.flatnonzero(fresh)
    a, b, p, who = at[first], at[np.append(first[1:], len(at)) - 1], p[first], who[first]
    whole = mixed(buf.hashes(a, b + length) + (b - a).astype(np.uint64) * BYTE[1] + (p - a).astype(np.uint64) * BYTE[2])
    side = (length - GRAM) // 2
    left = np.where(p - a >= side, short(buf.hashes(np.maximum(p - side, 0), p + GRAM)), 0).astype(np.int64)
    right = np.where(b + length >= p + GRAM + side, short(buf.hashes(p, np.minimum(p + GRAM + side, len(
        buf.data)))), 0).astype(np.int64)
    return {"part": who, "a": a - buf.starts[who], "n": b - a + 1, "off": p - a,
            "gram": (grams[p] >> np.uint64(24)).astype(np.int64), "whole": (whole >> np.uint64(16)).astype(np.int64),
            "left": left, "right": right}


def segments(ids: list, text: list[str], length: int) -> tuple[list[int], list[int], list[bytes]]:
    """Texts as bytes, very long ones in segments that overlap by one byte less than ``length``."""
    owner, shift, parts = [], [], []
    for k, t in enumerate(text):
        raw = t.encode()
        if ids[k] is None or len(raw) < length:
            continue
        for at in range(0, len(raw) - length + 1, SEGMENT):
            owner.append(k)
            shift.append(at)
            parts.append(raw[at:at + SEGMENT + length - 1])
    return owner, shift, parts


def cells_in_groups(parts: list[bytes], length: int) -> dict[str, np.ndarray]:
    """``cells`` for groups of parts of at most SEGMENT bytes, or of one segment, so that one buffer stays small."""
    found, start, size = [], 0, 0
    for k, part in enumerate(parts):
        if k > start and size + len(part) > SEGMENT:
            found.append((start, cells(parts[start:k], length)))
            start, size = k, 0
        size += len(part)
    found.append((start, cells(parts[start:], length)))
    out = {name: np.concatenate([f[name] for _, f in found]) for name in found[0][1]}
    out["part"] = np.concatenate([f["part"] + at for at, f in found])
    return out


def anchored(rows: DataFrame, length: int) -> DataFrame:
    """Rows (gram, whole, sides, doc_id, a): all cells. ``whole`` also holds ``off`` and ``n`` in its low 12 bits."""
    def make():
        def emit(ids: list, text: list) -> dict[str, list]:
            owner, shift, parts = segments(ids, text, length)
            found = cells_in_groups(parts, length)
            who = np.array(owner, np.int64)[found["part"]] if parts else np.zeros(0, np.int64)
            shift_ = np.array(shift, np.int64)[found["part"]] if parts else np.zeros(0, np.int64)
            known = np.array([0 if i is None else i for i in ids], np.int64)
            return {"gram": found["gram"], "whole": found["whole"] * 4096 + found["off"] * 64 + found["n"],
                    "sides": (found["left"] * (1 << 14) + found["right"]).astype(np.int32),
                    "doc_id": known[who] if len(ids) else who, "a": found["a"] + shift_}

        return emit

    return per_text(rows, "gram long, whole long, sides int, doc_id long, a long", make)


def judged(found: DataFrame, length: int) -> DataFrame:
    """Rows (doc_id, a, n, gram): cells all of whose strings start in a smaller document (``gram`` null), and starts to
    look into.

    Sorted by rank, cells of one gram and one whole content lie together: those not in the smallest document of their
    content are repeated from end to end. Content that is the first of its kind needs a look only where other
    content has the same gram in another document, and agrees on 33 bytes around it. The rest is unique and goes.
    A string has half of its other bytes before or after the gram, so only starts on a side that is shared are left.
    """
    same, gram = Window.partitionBy("gram", "whole"), Window.partitionBy("gram")
    spread = found.repartition("gram").withColumn("first", F.min("doc_id").over(same))
    spread = spread.withColumns({"lo": F.min("doc_id").over(gram), "hi": F.max("doc_id").over(gram), "one": F.min(
        "whole").over(gram), "two": F.max("whole").over(gram)}).where("lo < hi AND (doc_id > first OR one <> two)")
    left, right = F.col("sides").bitwiseAND(0x0FFFC000), F.col("sides").bitwiseAND(0x3FFF)
    spread = spread.withColumns({"left": left, "right": right})
    for side in ("left", "right"):
        near = Window.partitionBy("gram", side)
        spread = spread.withColumn(f"{side}_shared", (F.col(side) != 0) & (
            F.min("whole").over(near) != F.max("whole").over(near)))
    repeated = F.col("doc_id") > F.col("first")
    ask = (~repeated) & (F.col("left_shared") | F.col("right_shared"))
    n = F.col("whole").bitwiseAND(63).cast("int")
    off = F.shiftright("whole", 6).bitwiseAND(63).cast("int")
    side = (length - GRAM) // 2
    lo = F.when(repeated | F.col("left_shared"), 0).otherwise(F.greatest(off - (length - GRAM - side), F.lit(0)))
    hi = F.when(repeated | F.col("right_shared"), n).otherwise(F.least(n, off - side + 1))
    return spread.where(repeated | ask).select("doc_id", (F.col("a") + lo).alias("a"), (hi - lo).alias("n"), F.when(
        ~repeated, F.col("gram")).alias("gram")).where("n > 0")


def windows(packed: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """Rows (string, doc_id, at): the strings of the cells to look into, by 64-bit hash. The last rank: full depth."""
    lists = asked.groupBy("doc_id").agg(F.collect_list(F.struct("a", "n", "gram")).alias("cells"))
    # A left join, as the removal makes it: so both read one shuffle of the texts. Texts without cells give nothing.
    both = packed.join(lists, "doc_id", "left")

    def run(batches):
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            batch = batch.filter(batch["cells"].is_valid())
            for i, raw, cells_ in zip(batch["doc_id"].to_pylist(), batch["packed"].to_pylist(), batch["cells"]):
                fields = cells_.values
                n = fields.field("n").to_numpy().astype(np.int64)
                a, gram = fields.field("a").to_numpy(), fields.field("gram").to_numpy()
                buf = Buffer([zstandard.decompress(raw)], length)
                starts = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                code = buf.hashes(starts, starts + length) ^ (np.repeat(gram, n).view(np.uint64) << np.uint64(20))
                out[0].append(code.view(np.int64))
                out[1].append(np.full(len(starts), i, np.int64))
                out[2].append(starts)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *o])) for o in out],
                                             ["string", "doc_id", "at"])

    return both.mapInArrow(run, "string long, doc_id long, at long")


def compressed(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, packed): texts as Zstandard frames, which is what travels."""
    def make():
        pack = zstandard.ZstdCompressor(level=3)
        return lambda ids, text: {"doc_id": ids, "packed": [pack.compress(t.encode()) for t in text]}

    return per_text(rows, "doc_id long, packed binary", make)


def repeated_spans(packed: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """Rows (doc_id, lo, hi): bytes that go, in spans that may overlap."""
    told = stored(judged(anchored(rows, length), length), drop_shuffles=True)
    strings = windows(packed, told.where("gram IS NOT NULL"), length)
    later = strings.withColumn("first", F.min("doc_id").over(Window.partitionBy("string"))).where("doc_id > first")
    return told.where("gram IS NULL").select("doc_id", F.col("a").alias("lo"), (F.col("a") + F.col("n") + (
        length - 1)).alias("hi")).union(later.select("doc_id", F.col("at"), F.col("at") + length))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   with_bytes: bool = False) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256) and, with ``with_bytes``, kept (binary); one per row.

    Removes each byte covered by a string of ``length`` bytes that also starts in a document with a smaller id. Exact
    up to 48-bit hashes within one gram.

    Positions get ranks at doubling depths: 1, 2, 4, 8 and 16 bytes inside their document, where pairs of ranks at
    growing offsets make the next rank. Spark then sorts by rank the positions that can matter, one anchor for about
    18 bytes, chosen so that equal strings have equal anchors; ranks that one document has alone end there. What is
    left is ranked again at 33 bytes, then by the whole cell, and, where that leaves a doubt, at the full ``length``.

    Null and empty texts, and those shorter than ``length``, stay whole, as do documents with a null id, which are
    not compared. Rows repeated under one id must have one text: they are one document. Other columns are ignored.
    """
    if not 2 * GRAM < length <= 63 + GRAM:
        raise ValueError(f"length must be from {2 * GRAM + 1} to {63 + GRAM}")
    rows = texts(docs, id_col, text_col)
    packed = compressed(rows)
    spans = repeated_spans(packed, rows, length).where("doc_id IS NOT NULL")
    lists = spans.groupBy("doc_id").agg(F.collect_list(F.col("lo") * 128 + (F.col("hi") - F.col("lo"))).alias("spans"))

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {f: [] for f in fields}
            for i, frame, cut in zip(batch["doc_id"].to_pylist(), batch["packed"].to_pylist(), batch["spans"]):
                raw = zstandard.decompress(frame)
                keep = np.ones(len(raw), bool)
                if cut.is_valid:
                    both = cut.values.to_numpy()
                    edge = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(edge, np.minimum(both >> 7, len(raw)), 1)
                    np.add.at(edge, np.minimum((both >> 7) + (both & 127), len(raw)), -1)
                    keep = np.cumsum(edge[:-1]) == 0
                rest = np.frombuffer(raw, np.uint8)[keep].tobytes()
                gone = np.concatenate([[False], ~keep])
                row = (i, len(raw), len(raw) - len(rest), int((gone[1:] & ~gone[:-1]).sum()),
                       hashlib.sha256(rest).hexdigest(), rest)
                for f, v in zip(fields, row):
                    out[f].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    fields = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_bytes
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
    arrow = pa.schema(list(zip(fields, kinds)))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return packed.join(lists, "doc_id", "left").mapInArrow(run, schema + ", kept binary" * with_bytes)


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
