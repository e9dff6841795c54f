"""Scalar helpers over columns: numbers and strings, hashes and checksums, byte order."""

from __future__ import annotations

import functools
import posixpath

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What separates words (fixed values): space, CR, LF, TAB and FF; vertical tabs and other Unicode spaces are part of words.
WORD_SEPARATORS = "[ \\r\\n\\t\\f]+"
_SPACES = " \t\n\r\f\u000b"


def split_words(col: Column) -> Column:
    """The words of a text, and perhaps empty ones; null gives null. Texts with no separator but spaces are split without a pattern."""
    other = col.contains("\t") | col.contains("\n") | col.contains("\r") | col.contains("\f")
    return F.when(other, F.split(col, WORD_SEPARATORS)).otherwise(F.split(col, " "))


def words(col: Column) -> Column:
    """The words of a text, without empty ones; null gives null."""
    return F.filter(split_words(col), lambda w: w != "")


def padded(col: Column, width: int, fill: str = " ") -> Column:
    """A number as text, filled on its left; longer numbers are whole."""
    text = col.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, fill))


def to_int(col: Column) -> Column:
    """The leading integer of a text, as lenient parsers read it: 0 if there is none."""
    return F.coalesce(F.regexp_extract(col, r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0))


def to_float(col: Column) -> Column:
    """The leading decimal number of a text: 0 if there is none."""
    return F.coalesce(F.regexp_extract(col, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def to_bool(col: Column) -> Column:
    """True for the exact text true alone."""
    return F.coalesce(col == "true", F.lit(False))


def trimmed(col: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(col, F.lit(_SPACES))


def split_on(col: Column, separator: str, clean: bool = False) -> Column:
    """Split at a literal separator; clean: trim the parts and drop empty ones."""
    parts = F.split(col, "\\Q" + separator + "\\E", -1)
    return F.filter(F.transform(parts, trimmed), lambda x: x != "") if clean else parts


def joined(col: Column, separator: str) -> Column:
    return F.array_join(col, separator)


def string_hash(col: Column) -> Column:
    """The 31-fold hash of a key's bytes from 1 on, as an unsigned 32-bit number in a bigint."""
    raw = col.cast("binary")
    byte = F.transform(
        F.when(F.octet_length(raw) > 0, F.sequence(F.lit(1), F.octet_length(raw))).otherwise(F.array().cast("array<int>")),
        lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("bigint"),
    )
    return F.aggregate(byte, F.lit(1).cast("bigint"), lambda h, x: (h * 31 + F.when(x > 127, x - 256).otherwise(x)).bitwiseAND(4294967295))


def partition_by_hash(col: Column, n: int) -> Column:
    """The partition, of n, that the default hash deals a key to; a null key goes to the first."""
    return F.lit(0) if n == 1 else F.coalesce((string_hash(col).bitwiseAND(2147483647) % n).cast("int"), F.lit(0))


def unsigned_order(col: Column) -> list[Column]:
    """Sort keys that order signed integers as their big-endian bytes: negative ones last."""
    return [col < 0, col]


@F.pandas_udf(T.LongType())
def crc32c(values: pd.Series) -> pd.Series:
    """CRC-32C (Castagnoli) of binary values; null gives null."""
    found = [k for k, x in enumerate(values) if x is not None]
    out = pd.Series([None] * len(values), dtype="Int64")
    out.iloc[found] = checksums([values.iloc[k] for k in found]).astype(np.int64)
    return out


#: Bytes of a value that are worked on in one step each, for all values at once.
_BLOCK = 64


@functools.cache
def _castagnoli() -> tuple[np.ndarray, np.ndarray]:
    """The table of a byte, and those that carry each byte of a remainder over a block of zeros."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> 1) ^ np.where(table & 1, np.uint32(0x82F63B78), np.uint32(0))
    carry = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for _ in range(_BLOCK):
        carry = table[carry & 255] ^ (carry >> 8)
    return table, carry


def checksums(values: list[bytes]) -> np.ndarray:
    """CRC-32C of each value.

    Values are filled to whole blocks with zeros in front, which leave a remainder that begins at 0 as it is; the usual start of
    ones is the same as changing the first four bytes. The blocks' remainders are made side by side, and joined a block at a time.
    """
    table, carry = _castagnoli()
    size = np.fromiter(map(len, values), np.int64, len(values))
    blocks = -(-np.maximum(size, 4) // _BLOCK)  # shorter values get what the start of ones leaves over, below
    last = np.cumsum(blocks)
    flat = np.zeros(int(last[-1]) * _BLOCK if len(values) else 0, np.uint8)
    for x, n, end in zip(values, size.tolist(), (last * _BLOCK).tolist(), strict=True):
        flat[end - n : end] = np.frombuffer(x, np.uint8)
        flat[end - n : min(end, end - n + 4)] ^= 255
    rows, each = flat.reshape(-1, _BLOCK), np.zeros(len(flat) // _BLOCK, np.uint32)
    for k in range(_BLOCK):
        each = table[(each ^ rows[:, k]) & 255] ^ (each >> 8)
    state = np.zeros(len(values), np.uint32)
    order = np.argsort(-blocks, kind="stable")
    ranked = blocks[order]
    for k in range(int(blocks.max(initial=0))):
        live = order[: np.searchsorted(-ranked, -k, "left")]  # values of more than k blocks
        s = state[live]
        moved = carry[0][s & 255] ^ carry[1][s >> 8 & 255] ^ carry[2][s >> 16 & 255] ^ carry[3][s >> 24]
        state[live] = moved ^ each[last[live] - blocks[live] + k]
    for n in range(4):  # of fewer than four bytes, the ones that no byte has met are left in the remainder
        state[size == n] ^= np.uint32(0xFFFFFFFF >> (8 * n))
    return state ^ np.uint32(0xFFFFFFFF)


def path_parent(path: str) -> str:
    return posixpath.dirname(path.rstrip("/")) or ("/" if path.startswith("/") else "")


def path_name(path: str) -> str:
    return posixpath.basename(path.rstrip("/"))


def path_is_absolute(path: str) -> bool:
    return path.startswith("/")
