"""Byte-level BPE: texts to token ids and back by a rank file of the tiktoken format.

The merges are tiktoken's. What is added is a cut of long texts at safe boundaries, where the pre-splitting pattern is sure to
start a new match whatever stands on either side, so that the parts give the ids of the whole: after the last letter of a
run of letters, after the last digit of a run of digits, and after other marks (an apostrophe only before white space or a
digit, since it may begin a contraction). Very long white space is a match of its own (its last character goes with
what follows) and is encoded as one; the pattern engine would overflow its stack on it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField

from quillwork.llm.common import append_columns, texts

PART = 1 << 16  # characters a part of a long text has at least
BLANK = 1 << 10  # white space from this length on is encoded apart in long texts

CUT = regex.compile(
    r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\p{White_Space}\p{L}\p{N}'])(?=[\p{White_Space}\p{L}\p{N}])"
    r"|(?<=')(?=[\p{White_Space}\p{N}])"
)
LONG_BLANK = regex.compile(r"\p{White_Space}{%d,}+" % BLANK)


@lru_cache(maxsize=4)
def coder(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file: lines of a base64 token and its rank."""
    with open(SparkFiles.get(path) if "/" not in path else path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, least: int = PART) -> Iterator[str]:
    """``text`` in parts of ``least`` characters or more, cut at safe boundaries; one part if there is none."""
    start = 0
    while len(text) - start > least:
        cut = CUT.search(text, start + least)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str, least: int = PART) -> list[int]:
    """The ids of a whole text. Texts of up to ``least`` characters go to the library as they are."""
    if len(text) <= least:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    start = 0
    for blank in LONG_BLANK.finditer(text):
        stop = blank.end() if blank.end() == len(text) else blank.end() - 1
        for part in parts(text[start : blank.start()], least):
            ids += enc.encode_ordinary(part)
        ids += enc._encode_single_piece(text[blank.start() : stop])
        start = stop
    for part in parts(text[start:], least):
        ids += enc.encode_ordinary(part)
    return ids


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", count: str = "n_tokens") -> DataFrame:
    """``df`` with ``ids array<int>`` and ``count long`` of the whole text; a map without a shuffle.

    Null and empty texts have no ids and count 0. ``path`` is a rank file that every executor has, or the bare name of one
    given to ``SparkContext.addFile``. Columns with the new names are replaced.
    """

    def make():
        enc = coder(path, pattern)

        def fn(batch: pa.RecordBatch) -> list:
            coded = [np.array(encode_text(enc, t), dtype=np.int32) for t in texts(batch, text)]
            ends = np.cumsum([0, *map(len, coded)], dtype=np.int64)
            flat = np.concatenate(coded) if coded else np.zeros(0, np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)), pa.array(np.diff(ends))]

        return fn

    return append_columns(df, [StructField(ids, ArrayType(IntegerType(), False)), StructField(count, LongType())], make, 64)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the raw bytes of ``ids``, which need not be whole characters. Null ids give null, none give no bytes;
    an id the file lacks fails."""

    def make():
        raw = coder(path, pattern).decode_bytes

        def fn(batch: pa.RecordBatch) -> list:
            return [pa.array([None if not v.is_valid else raw(v.values.to_numpy().tolist()) for v in batch.column(ids)], pa.binary())]

        return fn

    return append_columns(df, [StructField(out, BinaryType())], make, 64)
