"""Byte-level BPE with a table of distinct words: each is encoded once, its ids go back to where it stands."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.base import BATCH_CHARS, arrow_schema, per_text, per_worker, query, release, table, texts
from tickloom.storage import stored

CHUNK_CHARS = 100_000
# Bound on the table of frequent words that is sent to every task. They are chosen on a share of the rows; the choice
# decides which words are shuffled and has no influence on the ids.
SENT_BYTES = 40_000_000
SAMPLE = 0.05
COMMON = 8_000
# No match of the word pattern goes from a character that is no white space to white space, nor from one of these
# letters to one of these marks, and what follows is matched alike without what came before.
BOUNDARY = re.compile("(?<=\\S)(?=[ \t\n\v\f\r])|(?<=[ぁ-ゖァ-ヺ一-龥])(?=[、。，])")
# Characters whose class is the same in every version of Unicode since the pattern was made; others go to the library.
PLAIN = re.compile("[\0-ɏ‐-‧‰-⁞€]*")
LETTER, NUMBER, SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
# Fixed value: the library's pattern for byte-level words, for plain characters.
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+"
                   f"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def chunks(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """A text in parts of ``size`` characters or a little more, cut where one word ends and the next one starts."""
    start = 0
    while len(text) - start > size:
        cut = BOUNDARY.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def read_json(file: str) -> dict:
    with open(file, encoding="utf-8") as f:
        return json.load(f)


class Splitter:
    """The library's byte-level words of a text. ``special`` gives the strings that are no words but have an id."""

    def __init__(self, file: str, special: dict[str, int]) -> None:
        self.file, self.special = file, special
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file)

    def parts(self, text: str) -> Iterator[list[str]]:
        """The words of a text, a list per part."""
        for chunk in chunks(text):
            pieces = self.marks.split(chunk) if self.special else [chunk]
            for k, piece in enumerate(pieces):
                if k % 2:
                    yield [piece]
                elif PLAIN.fullmatch(piece):
                    yield WORDS.findall(piece)
                else:
                    yield [piece[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(piece)]

    def numbered(self, text: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct words of some texts, the numbers of all words in order, and how many words each text has."""
        number: dict[str, int] = defaultdict()
        number.default_factory = number.__len__
        parts, sizes = [np.zeros(0, np.int32)], []
        for t in text:
            own = [np.fromiter(map(number.__getitem__, part), np.int32, len(part)) for part in self.parts(t)]
            parts += own
            sizes.append(sum(map(len, own)))
        return list(number), np.concatenate(parts), np.array(sizes, np.int64)


class ByteWords(Splitter):
    """Also the ids of one word and the bytes of one id."""

    def __init__(self, file: str) -> None:
        given = read_json(file)
        rules, added = given["pre_tokenizer"], given["added_tokens"]
        if given["normalizer"] or rules["type"] != "ByteLevel" or rules["add_prefix_space"] or not rules[
                "use_regex"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{file} is no plain byte-level vocabulary")
        super().__init__(file, {t["content"]: t["id"] for t in added})

    @cached_property
    def letters(self):
        from tokenizers.pre_tokenizers import ByteLevel

        return ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def ids(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return [t.id for t in self.library.model.tokenize(self.letters(word)[0][0])]

    def pieces(self) -> list[bytes | None]:
        """The bytes of every id, in order of id; none for an id that is not used."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {
            chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        vocabulary = read_json(self.file)["model"]["vocab"]
        out: list[bytes | None] = [None] * (1 + max([*vocabulary.values(), *self.special.values()]))
        for token, i in vocabulary.items():
            out[i] = bytes(byte[c] for c in token)
        for token, i in self.special.items():
            out[i] = token.encode()
        return out


def byte_words(file: str) -> ByteWords:
    return per_worker("byte words " + file, lambda: ByteWords(file))


def word_counts(docs: DataFrame, file: str) -> DataFrame:
    """Rows (word, n): every distinct word of the (doc_id, text) rows and how often it stands there."""
    def make():
        words = byte_words(file)

        def count(ids: list, text: list) -> dict[str, list]:
            distinct, numbers, _ = words.numbered(text)
            return {"word": distinct, "n": np.bincount(numbers, minlength=len(distinct))}

        return count

    return per_text(docs, "word string, n long", make, keeps="byte words " + file).groupBy("word").agg(
        F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, file: str, bound: int, sample: float) -> DataFrame:
    """Stored rows (word, n, ids) of the words that are most frequent in a share of the rows, ``bound`` bytes at most.

    Their least number is a power of two, found from the bytes that the words of each power take.
    """
    counts = stored(word_counts(docs.where(F.rand(7) < sample), file))
    size = F.octet_length("word") * 5 + 16  # at most one id of four bytes for every byte of a word
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.sum(size).alias("bytes")).collect()
    least, total = 62, 0
    for r in sorted(sizes, key=lambda r: -r.k):
        total += r.bytes
        if total > bound:
            break
        least = r.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("byte words " + file)
        words = byte_words(file)
        for batch in batches:
            ids = [packed_ids(words.ids(w)) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], ["word", "n", "ids"])

    chosen = counts.where(F.col("n") >= F.lit(2 ** least)).select("word", "n")
    return stored(chosen.mapInArrow(run, "word string, n long, ids binary"))


def packed_ids(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def entry(word: str, ids: list[int], kind: str) -> bytes:
    """A word and its ids, as numbers of the given kind, in one value. No byte of UTF-8 equals the one between them."""
    return word.encode() + b"\xff" + np.array(ids, kind).tobytes()


def read_entry(value: bytes, kind: str) -> tuple[str, np.ndarray]:
    word, _, ids = value.partition(b"\xff")
    return word.decode(), np.frombuffer(ids, kind)


def hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def lengths(column: pa.Array) -> np.ndarray:
    return pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces flat[start:start + size], one after the other."""
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]


class WordTable:
    """Words with their ids, found by hash and compared as a whole."""

    def __init__(self, rows: pa.Table) -> None:
        code = hashes(rows.column("word").to_pylist())
        by = np.argsort(code, kind="stable")
        self.code = code[by]
        self.word = rows.column("word").combine_chunks().take(pa.array(by))
        column = rows.column("ids").combine_chunks().take(pa.array(by))
        self.edges = np.r_[0, np.cumsum(lengths(column) // 4)].astype(np.int32)
        ids = np.frombuffer(b"".join(column.to_pylist()), "<u4")
        self.ids = ids.astype(np.min_scalar_type(ids.max(initial=0)))

    def find(self, words: list[str]) -> np.ndarray:
        """The row of every word, -1 for a word that is not in the table."""
        if not len(self.code) or not words:
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.code, hashes(words)), len(self.code) - 1)
        same = pc.equal(self.word.take(pa.array(at)), pa.array(words, pa.string()))
        return np.where(same.to_numpy(zero_copy_only=False), at, -1)


def text_key(text: bytes) -> int:
    """What the other words of a text come back by. Texts that share a key by chance get each other's, to no harm."""
    return xxhash.xxh3_64_intdigest(text) - 2 ** 63


def encoded(docs: DataFrame, tokenizer_file: str, id_col: str, text_col: str, bound: int, sample: float, schema: str,
            finish: Callable[[pa.Array, np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """Rows of ``schema``, one per input row: what ``finish`` makes of the doc_ids of some rows, all their ids, and where
    those of each row begin and end. It is called in the task that puts the ids together, so that no second Python worker
    beside that one takes memory and no ids go through Spark that the columns do not hold.

    Texts are split into words, each distinct word is encoded once, and the ids are put back at the places of the word. The
    table of distinct words has two parts. The frequent ones, at most ``bound`` bytes, are at hand in every task. Every
    other word meets its texts by a shuffle on the word, where it is encoded, and its ids go back to these texts; what
    is shuffled there is not frequent, so no word is a hot key. The texts wait for them compressed.
    ``tokenizer_file`` must be at this path on every machine.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    frequent = frequent_words(rows, tokenizer_file, bound, sample).toArrow()
    sent = spark.sparkContext.broadcast(WordTable(frequent))
    common = "".join(frequent.sort_by([("n", "ascending"), ("word", "ascending")]).column("word").to_pylist()[-COMMON:])
    name = f"frequent words {uuid.uuid4().hex}"

    special = ByteWords(tokenizer_file).special
    kind = "<u2" if len(piece_table(tokenizer_file)) <= 2 ** 16 else "<u4"

    def known() -> tuple[Splitter, WordTable]:
        return per_worker(name, lambda: (Splitter(tokenizer_file, special), sent.value))

    def make_others():
        words, table = known()

        def others(ids: list, text: list) -> dict[str, list]:
            distinct, numbers, sizes = words.numbered(text)
            other = table.find(distinct) < 0
            at = np.flatnonzero(other[numbers])
            owner = np.searchsorted(np.cumsum(sizes), at, "right")
            found = np.unique(owner * len(distinct) + numbers[at]) if len(at) else at
            key = np.array([text_key(t.encode()) for t in text], np.int64)
            return {"word": [distinct[k] for k in (found % max(1, len(distinct))).tolist()],
                    "key": key[found // max(1, len(distinct))]}

        return others

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("byte words " + tokenizer_file)
        words, last = byte_words(tokenizer_file), (None, None)
        value = b""
        for batch in batches:
            out = []
            for word, key in zip(batch.column("word").to_pylist(), batch.column("key").to_pylist()):
                if word != last[0]:
                    value = entry(word, words.ids(word), kind)
                if (word, key) != last:
                    out.append((key, value))
                last = (word, key)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array(
                [v for _, v in out], pa.binary())], ["key", "entry"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("")
        squeeze = zstandard.ZstdCompressor(6, dict_data=dictionary(common)).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raw = [t.encode() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(map(text_key, raw), pa.int64()),
                     pa.array([squeeze(t) for t in raw], pa.binary())], ["doc_id", "key", "packed"])

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(name)
        words, table = known()
        for batch in batches:
            for doc_id, text, rest in opened(batch, kind, common):
                distinct, numbers, sizes = words.numbered(text)
                row = table.find(distinct)
                missing = np.flatnonzero(row < 0)
                own = [rest[distinct[k]] for k in missing.tolist()]
                start = table.edges[row].astype(np.int64)
                size = np.where(row < 0, 0, table.edges[row + 1] - start)
                flat = np.concatenate([gathered(table.ids, start, size).astype(np.int32), *own]).astype(np.int32)
                local = np.cumsum(size) - size
                size[missing] = [len(x) for x in own]
                local[missing] = len(flat) - size[missing].sum() + np.cumsum(size[missing]) - size[missing]
                ids = gathered(flat, local[numbers], size[numbers])
                edges = np.r_[0, np.cumsum(size[numbers])][np.r_[0, np.cumsum(sizes)]]
                yield pa.RecordBatch.from_arrays(finish(doc_id, ids, edges), schema=arrow)

    others = per_text(rows, "word string, key long", make_others, keeps=name)
    rest = others.repartition("word").sortWithinPartitions("word", "key").mapInArrow(
        encode, "key long, entry binary").groupBy("key").agg(F.collect_list("entry").alias("rest"))
    waiting = rows.mapInArrow(pack, "doc_id long, key long, packed binary")
    arrow = arrow_schema(spark, schema)
    return waiting.join(rest, "key", "left").select("doc_id", "packed", "rest").mapInArrow(complete, schema)


def encode_rows(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
                bound: int = SENT_BYTES, sample: float = SAMPLE) -> DataFrame:
    """Rows (doc_id, ids array<int>), one per input row, as the tokenizers library encodes without special tokens
    of its own; their strings in a text give their id.

    A null or empty text has no ids; null ids, repeated rows and other columns make no difference; an empty table gives no
    rows. A very long text is split part by part, but its ids are one row.
    """
    def listed(doc_id: pa.Array, ids: np.ndarray, edges: np.ndarray) -> list[pa.Array]:
        return [doc_id, pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32())).cast(of_ids)]

    schema = "doc_id long, ids array<int>"
    of_ids = arrow_schema(docs.sparkSession, schema)[1].type
    return encoded(docs, tokenizer_file, id_col, text_col, bound, sample, schema, listed)


def dictionary(common: str) -> zstandard.ZstdCompressionDict | None:
    """Common words to compress short texts with."""
    raw = common.encode()
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) > 1000 else None


def opened(batch: pa.RecordBatch, kind: str, common: str) -> Iterator[tuple[pa.Array, list[str], dict]]:
    """The rows of a batch in parts of about BATCH_CHARS: ids, texts, and the ids of their other words by word."""
    open_ = zstandard.ZstdDecompressor(dict_data=dictionary(common)).decompress
    start, size, text, rest = 0, 0, [], {}
    packed, others = batch.column("packed"), batch.column("rest")
    for k in range(batch.num_rows):
        text.append(open_(packed[k].as_py()).decode())
        rest.update(read_entry(e, kind) for e in others[k].as_py() or ())
        size += len(text[-1])
        if size > BATCH_CHARS or k + 1 == batch.num_rows:
            yield batch.column("doc_id").slice(start, k + 1 - start), text, rest
            start, size, text, rest = k + 1, 0, [], {}


def joined_pieces(ids: np.ndarray, pieces: pa.Array, chunk: int = 1_000_000) -> bytes:
    """The bytes of a row of ids: each id is matched to the piece table, which is in order of id."""
    out = []
    for at in range(0, len(ids), chunk):
        found = pieces.take(pa.array(ids[at:at + chunk]))
        if found.null_count:
            raise ValueError("an id that the vocabulary does not have")
        ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1 + found.offset)[found.offset:]
        out.append(found.buffers()[2][int(ends[0]):int(ends[-1])].to_pybytes())
    return b"".join(out)


def piece_table(file: str) -> pa.Array:
    return pa.array(ByteWords(file).pieces(), pa.large_binary())


def decode_rows(rows: DataFrame, tokenizer_file: str) -> DataFrame:
    """Rows (doc_id, text) from (doc_id, ids), as the library decodes without leaving special tokens out.

    Every id is joined to the table of pieces, which has one row per id of the vocabulary and is at hand in every task.
    Null ids give an empty text; bytes that are no UTF-8 become replacement characters; an id that the
    vocabulary does not have is an error.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("")
        for batch in batches:
            text = [joined_pieces(np.array(i.values or [], np.int32), pieces).decode("utf-8", "replace")
                    for i in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    pieces = piece_table(tokenizer_file)
    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
               bound: int = SENT_BYTES, sample: float = SAMPLE) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256) of the encoded and decoded texts."""
    def digests(doc_id: pa.Array, ids: np.ndarray, edges: np.ndarray) -> list[pa.Array]:
        encoded_as, decoded_as = [], []
        for start, end in pairwise(edges.tolist()):
            own = ids[start:end]
            encoded_as.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
            text = joined_pieces(own, pieces).decode("utf-8", "replace")
            decoded_as.append(hashlib.sha256(text.encode()).hexdigest())
        return [doc_id, pa.array(np.diff(edges), pa.int64()), pa.array(encoded_as, pa.string()),
                pa.array(decoded_as, pa.string())]

    pieces = piece_table(tokenizer_file)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return encoded(docs, tokenizer_file, id_col, text_col, bound, sample, schema, digests)


@query("op12_word_table_bpe")
def op12_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
