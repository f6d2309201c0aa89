"""All registered text queries."""

from tickloom.llm import (  # noqa: F401
    byte_bpe, exact, lines, minhash, packing, pii, quality, runs, search, substrings, toxicity, vectors, word_table)
from tickloom.llm.base import ORACLE, QUERIES  # noqa: F401
