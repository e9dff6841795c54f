"""Approximate nearest neighbours by a permutation index.

Pivots are a fixed number of vectors. A vector is represented by its nearest pivots in order; a shard of vectors posts
them, with their ranks, in a file for each pivot. A query reads the files of its own pivots and sums, for each vector
met there, what two ordered lists lose in footrule distance if both hold a pivot: 2 * (length - the larger rank), from
a total that is equal for all vectors. So the largest sums are the least footrule distances.

Orders of pivots tell a direction and no length, and an inner product is of both. So the sums are read as cosines, by a
rising curve fitted to the pairs of a bounded sample, and a vector's place is by that cosine times its length: for
vectors of one length that is the order of the footrule distances. The best of each shard are ranked again by the inner product
of the original vectors.

Shards and blocks of queries are of fixed sizes, so a task holds one of each however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._shared import written

#: The pivots, the pivots of a vector, rows of a shard and of a block of queries; of each shard, the vectors that are ranked
#: again: a share of its rows, and so many at least for each neighbour asked for; rows of the sample, the first by a hash
#: of the key, whose first different vectors are the pivots and whose pairs give the curve.
PIVOTS, LENGTH, SHARD_ROWS, QUERY_ROWS, SHARE, LEAST, SAMPLE = 256, 64, 8_192, 16_384, 0.15, 25, 1_280


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is neither null nor zero nor holds a null or a number that isn't finite."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.where(x.isNotNull() & ~bad & F.exists(x, lambda v: v != 0))


def nearest_pivots(vectors: np.ndarray, centres: np.ndarray, length: int) -> np.ndarray:
    """The numbers of each vector's nearest pivots, by angle, in order."""
    return np.argsort(-(vectors.astype(float) @ centres.T), axis=1, kind="stable")[:, :length].astype(np.uint8 if len(centres) <= 256 else np.int32)


class Curve:
    """Cosines of vectors by the footrule sums of their pivots' orders, rising, from the pairs of a sample."""

    def __init__(self, sample: np.ndarray, centres: np.ndarray, length: int) -> None:
        most = length * (length + 1) // 2
        unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
        near = nearest_pivots(sample, centres, length)
        files = Files(near, len(centres))
        some = min(len(sample), 256)
        other = ~np.eye(some, len(sample), dtype=bool)
        sums = np.array([files.sums(x) for x in near[:some]]).reshape(some, -1)[other]
        cosine = (unit[:some] @ unit.T)[other]
        bins = np.array_split(np.argsort(sums, kind="stable"), min(64, max(1, len(sums) // 8))) if len(sums) else []
        x = np.array([0.0, *(sums[b].mean() for b in bins), most])
        y = np.array([*(cosine[b].mean() for b in bins), 1.0])
        y = np.minimum(np.maximum.accumulate(np.r_[y[:1] if len(bins) else 0.0, y]), 1.0)
        keep = np.r_[True, np.diff(x) > 0]
        self.values = np.interp(np.arange(most + 1), x[keep], y[keep]) + 1e-9 * np.arange(most + 1)

    def __call__(self, sums: np.ndarray) -> np.ndarray:
        return self.values[sums]


class Files:
    """A file for each pivot: the ranks, from the list's length down to 1, of the vectors that post it (0: it doesn't)."""

    def __init__(self, near: np.ndarray, pivots: int) -> None:
        rows, self.length = near.shape
        self.weight = np.arange(self.length, 0, -1)
        self.ranks = np.zeros((pivots, rows), np.uint8 if self.length < 256 else np.int32)
        self.ranks[near.ravel(), np.repeat(np.arange(rows), self.length)] = np.tile(self.weight, rows)

    def sums(self, near: np.ndarray) -> np.ndarray:
        """Of each vector, the sum of the lesser ranks of the pivots that it shares with a query."""
        shared = np.minimum(self.ranks[near], self.weight[: len(near), None].astype(self.ranks.dtype))
        return shared.sum(axis=0, dtype=np.uint32)


def build_index(df: DataFrame, key: str = "vec_id", vector: str = "embedding", queries: Column | None = None, pivots: int = PIVOTS, length: int = LENGTH, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int, Curve | None]:
    """The index as a written table (key, vector, nearest pivots in order, asked, shard), its number of shards, and its curve.

    Rows without a usable vector, or whose vector has another length than most of the sample's, take no part. asked: whether
    `queries` holds for a row of df.
    """
    asked = F.lit(False) if queries is None else F.coalesce(queries, F.lit(False))
    single = isinstance(df.schema[vector].dataType.elementType, T.FloatType)
    kind = "array<float>" if single else "array<double>"
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast(kind).alias("vector"), asked.alias("asked"))
    rows = usable(rows.where("key is not null"), "vector")
    sample = rows.select("key", "vector").orderBy(F.xxhash64("key"), "key", "vector").limit(max(SAMPLE, pivots)).collect()
    schema = f"key long, vector {kind}, pivots binary, asked boolean, shard int"
    if not sample:
        return df.sparkSession.createDataFrame([], schema), 0, None
    size = max({len(r.vector) for r in sample}, key=lambda n: (sum(len(r.vector) == n for r in sample), n))
    vectors = np.array([r.vector for r in sample if len(r.vector) == size])
    different = vectors[np.sort(np.unique(vectors, axis=0, return_index=True)[1])]
    centres = different[:pivots]
    centres = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    length = min(length, len(centres))
    rest = different[pivots:] if len(different) >= 2 * pivots else different  # pivots are nearer to themselves than others are
    curve = Curve(rest, centres, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = nearest_pivots(_matrix(batch.column("vector")), centres, length)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("vector"), pa.array([x.tobytes() for x in near], pa.binary()), batch.column("asked"), batch.column("shard")], names=["key", "vector", "pivots", "asked", "shard"])

    rows = rows.where(F.size("vector") == size)
    shards = max(1, -(-rows.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(shards)).cast("int"))
    return written(rows.mapInArrow(run, schema), "pivot-index"), shards, curve


class Shard:
    """The inverted files of a shard's rows; of rows with the same key, the first by vector counts."""

    def __init__(self, key: np.ndarray, vector: np.ndarray, near: np.ndarray, pivots: int, curve: Curve) -> None:
        order = np.lexsort([*vector.T[::-1], key])
        keep = order[np.r_[True, key[order][1:] != key[order][:-1]]] if len(key) else order
        self.key, self.vector, self.curve = key[keep], vector[keep].astype(float), curve
        self.size = np.sqrt((self.vector * self.vector).sum(axis=1))
        self.files = Files(near[keep], pivots)

    def search(self, key: int, vector: np.ndarray, near: np.ndarray, k: int, best: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and inner products of the k best: larger product first, then the smaller key."""
        guess = self.curve(self.files.sums(near)) * self.size
        guess[self.key == key] = -np.inf
        found = _first(guess, best)
        found = found[self.key[found] != key]
        score = self.vector[found] @ vector
        if len(found) > 4 * k:  # the k-th largest product and all that tie with it
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            found, score = found[keep], score[keep]
        order = np.lexsort([self.key[found], -score])[:k]
        return self.key[found[order]], score[order]


def _first(value: np.ndarray, n: int) -> np.ndarray:
    """Where the n largest values are; of equal ones the first."""
    if n >= len(value):
        return np.arange(len(value))
    least = np.partition(value, len(value) - n)[len(value) - n]
    more = np.flatnonzero(value > least)
    return np.concatenate([more, np.flatnonzero(value == least)[: n - len(more)]])


def nearest(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, share: float = SHARE, least: int = LEAST, pivots: int = PIVOTS, length: int = LENGTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """For each row of df for which the column `queries` holds, its k nearest other rows found by largest inner product.

    Rows (query_id, rank from 1, vec_id, score), nearest first and ties to the smaller id; fewer if there are fewer
    candidates. share: of each shard's rows that are ranked again by their inner products, of `least` times k at least; 1 makes
    the result exact. `queries` may be of any columns of df. Rows whose vector is null, zero, or holds a null or non-finite component take no
    part, nor rows with a null key, nor those whose vector has another length than most have; repeated rows of a key count
    once, the one with the least vector; an empty table gives no rows; other columns play no part.
    """
    table, shards, curve = build_index(df, key, vector, queries, pivots, length, shard_rows)
    asked = written(table.where("asked").groupBy("key").agg(F.min(F.struct("vector", "pivots")).alias("q")).select("key", "q.*"), "pivot-queries")
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("key", F.lit(3)), F.lit(blocks)).cast("int")).withColumn("shard", every(max(1, shards)))
    table = table.select("key", "vector", "pivots", "shard").withColumn("block", every(blocks))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            numbers = np.uint8 if pivots <= 256 else np.int32
            own = []
            for side in (left, right):
                column = {c: x.combine_chunks() if isinstance(x := side[c], pa.ChunkedArray) else x for c in ("key", "vector", "pivots")}
                near = np.frombuffer(b"".join(column["pivots"].to_pylist()), numbers).reshape(side.num_rows, -1)
                own += [column["key"].to_numpy(zero_copy_only=False), _matrix(column["vector"]), near]
            shard = Shard(*own[:3], pivots, curve)
            best = max(least * k, int(np.ceil(share * len(shard.key))))
            for q, v, near in zip(*own[3:], strict=True):
                keys, score = shard.search(int(q), v.astype(float), near, k, best)
                out.append((np.full(len(keys), q), keys, score))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    found = table.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
