"""Packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.base import per_text, per_worker, query, table, texts
from tickloom.llm.bins import Filling, pack
from tickloom.storage import stored

CAPACITY = 4096
END_ID = 1
CACHED_PARTS = 300_000
WORDS_AT_ONCE = 200_000
BATCH_CHARS = 3_000_000
# Words whose tokens do not depend on the version of a Unicode table: visible ASCII and composed Latin letters, but for
# the one that has two characters in lower case.
PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ɏ]+")
LOWER = "a-zÀ-ÖØ-öø-ʯⱥⱦ"
# Fixed value: the word pattern of the tokenizer file, for plain words in lower case. Breaks part words; a word after
# the mark is not plain and stays whole.
BREAK, WHOLE = "\n", "\0"
PIECES = re.compile(f"{BREAK}|{WHOLE}.*|'s|'t|'re|'ve|'m|'ll|'d|[{LOWER}]+|[0-9]|[^{LOWER}0-9{BREAK}]+")


class Recent:
    """Values of distinct keys, made for many at once where missing. When ``size`` are held they become the old ones,
    and those asked for again stay."""

    def __init__(self, make: Callable[[list], list], size: int) -> None:
        self.make, self.size, self.new, self.old = make, size, {}, {}

    def __call__(self, keys: list) -> list:
        values = list(map(self.new.get, keys))
        gaps = [i for i, v in enumerate(values) if v is None]
        for i in gaps:
            values[i] = self.old.get(keys[i])
        lacking = [i for i in gaps if values[i] is None]
        for i, v in zip(lacking, self.make([keys[i] for i in lacking])):
            values[i] = v
        for i in gaps:
            if len(self.new) >= self.size:
                self.new, self.old = {}, self.new
            self.new[keys[i]] = values[i]
        return values


class WordTokens:
    """Token ids of texts, as bytes of little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and lets nothing cross it, so Arrow finds the distinct words of a batch of texts,
    and only those are cut into parts, matches of the word pattern. The ids of parts are remembered (twice
    ``CACHED_PARTS`` at most): words differ by case and punctuation more than parts do. The merges are the library's
    own; unusual words, and texts with marks of special tokens, go through the library's whole path.
    """

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(file)
        self.model = self.whole.model
        self.letters = ByteLevel(add_prefix_space=False, use_regex=False)
        self.parts = Recent(self.encoded, CACHED_PARTS)

    def __call__(self, text: str) -> bytes:
        return self.batch([text])[0]

    def batch(self, texts: list[str]) -> list[bytes]:
        marked = [i for i, t in enumerate(texts) if "<|" in t]
        plain = list(texts)
        for i in marked:
            plain[i] = ""
        split = pc.ascii_split_whitespace(pa.array(plain, pa.large_string()))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        ids = [self.words(words.slice(at, WORDS_AT_ONCE)) for at in range(0, len(words), WORDS_AT_ONCE)]
        out = joined(pa.concat_arrays([NO_IDS, *ids]).take(coded.indices), split.offsets).to_pylist()
        for i in marked:
            out[i] = self.alone(texts[i])
        return out

    def words(self, words: pa.Array) -> pa.Array:
        lows = [w.lower() if w.isascii() and w.isprintable() or PLAIN.fullmatch(w) else WHOLE + w
                for w in objects(words)]
        coded = pa.array(PIECES.findall(BREAK.join([*lows, ""])), pa.large_string()).dictionary_encode()
        parts, codes = objects(coded.dictionary), coded.indices.to_numpy()
        breaks = parts.index(BREAK)
        parts[breaks] = WHOLE
        ends = np.flatnonzero(codes == breaks)
        offsets = pa.array(np.concatenate([[0], ends + 1]).astype(np.int32))
        return joined(pa.array(self.parts(parts), pa.large_binary()).take(coded.indices), offsets)

    def encoded(self, parts: list[str]) -> list[bytes]:
        return [self.alone(p[1:]) if p.startswith(WHOLE) else self.part(p) for p in parts]

    def part(self, piece: str) -> bytes:
        symbols = piece if piece.isascii() else self.letters.pre_tokenize_str(piece)[0][0]
        return packed([t.id for t in self.model.tokenize(symbols)])

    def alone(self, text: str) -> bytes:
        return packed(self.whole.encode(text, add_special_tokens=False).ids)


NO_IDS = pa.array([], pa.large_binary())


def objects(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


def joined(ids: pa.Array, offsets: pa.Array) -> pa.Array:
    """The bytes between the offsets, end to end."""
    return pc.binary_join(pa.ListArray.from_arrays(offsets, ids), pa.scalar(b"", pa.large_binary()))


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def word_tokens(file: str) -> WordTokens:
    return per_worker(file, lambda: WordTokens(file))


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32) and, with ``with_ids``, ids as bytes: tokens and the end id,
    cut every ``capacity`` ids. Every document gives at least one piece."""
    end = packed([end_id])

    def make():
        tokens = word_tokens(tokenizer_file)

        def cut(ids: list, text: list) -> dict[str, list]:
            out = defaultdict(list)
            for i, t in zip(ids, tokens.batch(text)):
                raw = t + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at:at + 4 * capacity]
                    row = (i, k, at // 4, len(part) // 4, zlib.crc32(part), part)
                    for name, v in zip(("doc_id", "piece", "start", "length", "ids_crc32", "ids"), row):
                        out[name].append(v)
            return out

        return cut

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return per_text(texts(docs, id_col, text_col), schema, make, keeps=tokenizer_file, chars=BATCH_CHARS)


def places(plan: list[tuple[Filling, int]], capacity: int) -> dict[int, np.ndarray]:
    """For each length: columns (first rank, first sequence, pieces per sequence, offset), sorted by rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    base = 0
    for way, times in plan:
        at = 0
        for n in dict.fromkeys(way):
            per = way.count(n)
            rows[n].append((ranks[n], base, per, at))
            ranks[n] += per * times
            at += per * n
        base += times
    return {n: np.array(r, np.int64).T for n, r in rows.items()}


def pack_pieces(cut: DataFrame, capacity: int = CAPACITY, nodes: int = 10_000) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, .., length); sequences hold ``capacity`` ids at most.

    Pieces of one length are alike, so the packing is found on the number of pieces of each length: ``capacity``
    counts at most reach the driver, whatever the input, and so does the plan that goes back. Each piece then takes
    the place of its rank within its length. Ranks are counted in two steps, over a salt that grows with the input,
    so a length that very many pieces have is not ranked in one task. ``cut`` must be a stored table.

    Pieces repeated with equal ids each get a place of their own. No pieces: no rows.
    """
    spark = cut.sparkSession
    found = cut.groupBy("length").agg(F.count("*").alias("pieces")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for r in found:
        counts[r.length] = r.pieces
    plan, _ = pack(counts, capacity, nodes)
    where = spark.sparkContext.broadcast(places(plan, capacity))
    salts = max(8, int(counts.sum() // 200_000))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select(
        "length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(
        Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1).join(sums, ["length", "salt"])
    ranked = ranked.select(*cut.columns, (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                n = int(length[group[0]])
                first, base, per, at = where.value[n]
                j = np.searchsorted(first, rank[group], side="right") - 1
                k = rank[group] - first[j]
                seq[group] = base[j] + k // per[j]
                offset[group] = at[j] + (k % per[j]) * n
            out = [*[batch.column(c) for c in names], pa.array(seq), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(out, [*names, "sequence_id", "offset"])

    names = cut.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, id_col: str = "doc_id",
                     text_col: str = "text", with_ids: bool = False, nodes: int = 10_000) -> DataFrame:
    """Tokenise, cut and pack documents: one row per piece with its sequence and place.

    Null and empty texts are documents of the end id alone. Very long texts are cut, never shortened. Null ids, ties,
    repeated rows and other columns are allowed; an empty table gives no rows. The numbers of sequences do not depend
    on how the input is partitioned; which of several pieces of one length goes where follows their hash and id.
    """
    cut = stored(pieces(docs, tokenizer_file, capacity, END_ID, id_col, text_col, with_ids))
    return pack_pieces(cut, capacity, nodes)


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
