"""Combiners, reducers and folds.

Sums, counts and other built-in folds are Spark's aggregations, which combine before the exchange by themselves. A user's reducer reads
the records of a key as a stream from sorted partitions, so a group may be larger than memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.mapping import Pair, _batched, arrow_schema, made

WRAP = 1 << 32
#: Records that a combiner sorts and groups at once.
COMBINED = 1 << 17


def int_sum(df: DataFrame, wrap: bool = False) -> DataFrame:
    """(key, sum of values) as bigint; wrap: modulo 2 to the 32, as unsigned 32-bit sums are."""
    total = F.sum(F.col("value").cast("bigint"))
    return df.groupBy("key").agg((F.pmod(total, F.lit(WRAP)) if wrap else total).alias("value"))


def count_records(df: DataFrame) -> DataFrame:
    """(key, number of records), whatever the values are."""
    return df.groupBy("key").agg(F.count(F.lit(1)).alias("value"))


def folded(df: DataFrame, **states: Column) -> DataFrame:
    """(key, a column for each named aggregation): folds that Spark has built in."""
    return df.groupBy("key").agg(*(col.alias(name) for name, col in states.items()))


def identity(df: DataFrame, partitions: int | None = None, grouped: bool = False) -> DataFrame:
    """Records grouped and sorted by key; grouped: they are already."""
    return df if grouped else (df.repartition(partitions, "key") if partitions else df.repartition("key")).sortWithinPartitions("key")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[Pair]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


def _over_groups(df: DataFrame, reducer: type | Callable, schema: str, options: dict | None = None, runs: Callable = lambda batches: [_records(batches)]) -> DataFrame:
    """runs: sets of records in key order, over each of which groups are made."""
    out = arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = made(reducer, options)
        step = own.reduce if own else reducer

        def rows() -> Iterator[Pair]:
            yield from (own.setup() or ()) if hasattr(own, "setup") else ()
            for records in runs(batches):
                for key, group in groupby(records, key=itemgetter(0)):  # values not read are passed over
                    yield from step(key, (v for _, v in group)) or ()
            yield from (own.close() or ()) if hasattr(own, "close") else ()

        yield from _batched(rows(), out)

    return df.select("key", "value").mapInArrow(run, schema)


def reduced(df: DataFrame, reducer: type | Callable, schema: str = "key string, value string", partitions: int | None = None, options: dict | None = None, grouped: bool = False) -> DataFrame:
    """A user's reducer: reduce(key, values) yields any number of pairs; values is an iterator that is read but once.

    reducer: a function, or a class with reduce and perhaps configure, setup and close. grouped: df's partitions are already dealt
    and sorted by key.
    """
    return _over_groups(df if grouped else identity(df, partitions), reducer, schema, options)


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[Pair]]:
    """Runs of COMBINED records, each in the order of its keys; records of a key keep theirs."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def run() -> Iterator[Pair]:
        table = pa.Table.from_batches(held)
        key = table.column(0).combine_chunks()
        key = key.cast(pa.binary()) if pa.types.is_string(key.type) else key
        order = pa.compute.sort_indices(pa.table({"k": key, "at": pa.array(range(len(key)))}), [("k", "ascending"), ("at", "ascending")])
        return _records(table.take(order).to_batches())

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= COMBINED:
            yield run()
            held, rows = [], 0
    if rows:
        yield run()


def combined(df: DataFrame, combiner: type | Callable, schema: str = "key string, value string", options: dict | None = None) -> DataFrame:
    """A user's combiner over the records of each partition as they are read, a bounded run in key order at a time.

    There is no exchange before it, and no sort of a whole partition; it must be associative, and may meet a key in several runs.
    """
    return _over_groups(df, combiner, schema, options, _sorted_runs)


def passive(df: DataFrame, mapper: type | Callable, schema: str = "key string, value string", partitions: int | None = None) -> DataFrame:
    """A mapper over the sorted records, without groups: what a job without a reducer does (with the identity)."""
    from millrace.operators.mapping import record_map

    return record_map(identity(df, partitions), mapper, schema)


def fold(df: DataFrame, init: Callable, step: Callable, finish: Callable = lambda key, state: state, schema: str = "key string, value string", merge: Callable | None = None, partitions: int | None = None) -> DataFrame:
    """A user's fold: init(key) makes a state, step(state, value) the next one, finish(key, state) the value.

    merge(state, state), if given, joins states of the same key: then each partition folds its own records first, and hot
    keys bring one state per partition to the exchange. States must then be picklable.
    """
    import pickle

    if merge is None:

        def whole(key, values):  # noqa: ANN001, ANN202
            state = init(key)
            for v in values:
                state = step(state, v)
            yield key, finish(key, state)

        return reduced(df, whole, schema, partitions)

    def part(key, values):  # noqa: ANN001, ANN202
        state = init(key)
        for v in values:
            state = step(state, v)
        yield key, pickle.dumps(state)

    def join(key, values):  # noqa: ANN001, ANN202
        state = None
        for v in values:
            state = pickle.loads(v) if state is None else merge(state, pickle.loads(v))
        yield key, finish(key, state)

    key_type = df.schema["key"].dataType.simpleString()
    return reduced(combined(df, part, f"key {key_type}, value binary"), join, schema, partitions)


def cogrouped(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """A reduce-side join of two sets of records, as the user-level composition that it is: (key, left, right)."""
    return left.select("key", F.col("value").alias("left")).join(right.select("key", F.col("value").alias("right")), "key", how)


def combined_records(df: DataFrame, mapper: type | Callable, schema: str = "key string, value string") -> DataFrame:
    """A mapper as combiner: a record at a time over each partition's records in key order, before any exchange."""
    from millrace.operators.mapping import record_map

    return record_map(df.sortWithinPartitions("key"), mapper, schema)
