"""Generated records: sort-benchmark rows, and seeded random words, numbers and bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the row generator: a linear congruential generator modulo 2 to the 32, three steps a row.
MULTIPLIER, INCREMENT, STEPS = 3141592621, 663896637, 3


def states(row: np.ndarray) -> np.ndarray:
    """The generator's state before each row, by squaring the step: no row needs the one before it."""
    mask, steps = np.uint64(0xFFFFFFFF), row.astype(np.uint64) * np.uint64(STEPS)
    value, a, c = np.zeros(len(row), np.uint64), MULTIPLIER, INCREMENT
    while steps.any():
        odd = (steps & np.uint64(1)).astype(bool)
        value[odd] = (value[odd] * np.uint64(a) + np.uint64(c)) & mask
        a, c = a * a % (1 << 32), (a + 1) * c % (1 << 32)
        steps >>= np.uint64(1)
    return value


def tera_records(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (rows x 10 bytes) and values (rows x 88 bytes)."""
    state, chars = states(row), []
    for _ in range(STEPS):
        state = (state * np.uint64(MULTIPLIER) + np.uint64(INCREMENT)) & np.uint64(0xFFFFFFFF)
        digits = state // np.uint64(52)
        chars += [(digits // np.uint64(95**k) % np.uint64(95)).astype(np.uint8) + 32 for k in (3, 2, 1, 0)]
    key = np.stack(chars, axis=1)[:, :10]
    number = np.stack([row // 10**k % 10 + 48 for k in range(9, -1, -1)], axis=1).astype(np.uint8)
    leading = (np.cumsum(number != 48, axis=1) == 0)[:, :9]
    number[:, :9][leading] = 32
    letter = (row[:, None] * 8 + np.arange(8)) % 26 + 65
    filler = np.repeat(letter, [10] * 7 + [8], axis=1).astype(np.uint8)
    return np.ascontiguousarray(key), np.concatenate([number, filler], axis=1)


def _fixed(rows: np.ndarray) -> pa.Array:
    size = rows.shape[1]
    ends = pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * size)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, ends, pa.py_buffer(rows.tobytes())])


def teragen(spark: SparkSession, rows: int, splits: int | None = None) -> DataFrame:
    """rows binary records of the sort benchmark, with their numbers (row); every row is there whatever the splits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, value = tera_records(batch.column("id").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("id"), _fixed(key), _fixed(value)], names=["row", "key", "value"])

    return spark.range(0, rows, 1, splits).mapInArrow(run, "row long, key binary, value binary")


class JavaRandom:
    """A 48-bit linear congruential generator with the steps and results of java.util.Random, for seeded test data."""

    def __init__(self, seed: int) -> None:
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def bits(self, n: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        value = self.state >> (48 - n)
        return value - (1 << n) if n == 32 and value >> 31 else value

    def next_int(self, bound: int | None = None) -> int:
        if bound is None:
            return self.bits(32)
        if bound & (bound - 1) == 0:
            return bound * self.bits(31) >> 31
        while True:
            bits = self.bits(31)
            value = bits % bound
            if bits - value + bound - 1 < 1 << 31:
                return value

    def next_long(self) -> int:
        value = (self.bits(32) << 32) + self.bits(32)
        return (value + (1 << 63)) % (1 << 64) - (1 << 63)

    def log_uniform(self, most: int) -> int:
        """Small numbers more often: up to a random power of two below most."""
        return self.next_int(1 << self.next_int(max(1, most.bit_length())))


def dictionary(words: int = 1000, seed: int = 0) -> list[str]:
    """Different invented words of 4 to 12 letters, more of them short, by a seeded rule."""
    rnd, found = JavaRandom(seed), {}
    while len(found) < words:
        size = 4 + min(rnd.next_int(9), rnd.next_int(9))
        found["".join("bdfgklmnprstvz"[rnd.next_int(14)] if k % 2 == 0 else "aeiou"[rnd.next_int(5)] for k in range(size))] = None
    return list(found)


def random_records(spark: SparkSession, rows: int, kind: str = "word", seed: int = 0, choices: int = 1000, length: int = 8) -> DataFrame:
    """rows seeded (key, value) records of words, numbers or bytes; the same seed gives the same rows."""
    draw = lambda salt: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)), F.lit(choices))
    if kind == "number":
        make = lambda salt: draw(salt).cast("string")
    elif kind == "word":
        make = lambda salt: F.translate(F.substring(F.md5(draw(salt).cast("string")), 1, length), "0123456789", "ghijklmnop")
    elif kind == "bytes":
        make = lambda salt: F.substring(F.unhex(F.sha2(draw(salt).cast("string"), 256)), 1, length)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return spark.range(rows).select(make("key").alias("key"), make("value").alias("value"))
