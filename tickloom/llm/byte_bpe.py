"""Byte-level BPE with a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.base import per_text, per_worker, query, table, texts

CHUNK_CHARS = 20_000
# A single space between two other characters that are no white space: whatever the pattern's alternatives, one match
# ends before this space and the next starts with it, so cutting here changes no match.
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    return per_worker(rank_file + pattern, lambda: made(rank_file, pattern))


def made(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, size: int = CHUNK_CHARS) -> list[str]:
    """Cut a text into parts of at least ``size`` characters, at safe places only."""
    out, start = [], 0
    while len(text) - start > size:
        cut = SAFE_CUT.search(text, start + size)
        if cut is None:
            break
        out.append(text[start:cut.start()])
        start = cut.start()
    out.append(text[start:])
    return out


def encode(text: str, enc: tiktoken.Encoding) -> list[int]:
    if len(text) <= CHUNK_CHARS:
        return enc.encode_ordinary(text)
    return [i for part in chunks(text) for i in enc.encode_ordinary(part)]


def encode_rows(docs: DataFrame, rank_file: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids array<int>), one per input row. A null text is empty and has no ids.

    ``rank_file`` must be at this path on every machine. Rows are independent: nothing is shuffled.
    Repeated rows, null ids and other columns make no difference.
    """
    def make():
        enc = encoding(rank_file, pattern)
        return lambda ids, text: {"doc_id": ids, "ids": [encode(t, enc) for t in text]}

    return per_text(texts(docs, id_col, text_col), "doc_id long, ids array<int>", make, keeps=rank_file + pattern)


def decode_rows(rows: DataFrame, rank_file: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Rows (doc_id, bytes binary) from (doc_id, ids). Bytes, as ids may end inside a character; null ids give none."""
    import pyarrow as pa

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            raw = [enc.decode_bytes(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, keeping digests only."""
    def make():
        enc = encoding(rank_file, pattern)

        def digests(ids: list, text: list) -> dict[str, list]:
            out = {"doc_id": ids, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for t in text:
                tokens = encode(t, enc)
                out["n_tokens"].append(len(tokens))
                out["ids_sha256"].append(hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(enc.decode_bytes(tokens)).hexdigest())
            return out

        return digests

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return per_text(texts(docs, id_col, text_col), schema, make, keeps=rank_file + pattern)


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
