"""Mappers: each input record becomes any number of output records.

identity and the other expression mappers stay in the JVM; record_map and arrow_map run Python, a batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import split_words

Pair = tuple


def identity(df: DataFrame) -> DataFrame:
    return df.select("key", "value")


def projected(df: DataFrame, key: Column, value: Column, where: Column | None = None) -> DataFrame:
    """Projection, with a filter before it that reaches the scan."""
    return (df if where is None else df.where(where)).select(key.alias("key"), value.alias("value"))


def tokens(df: DataFrame) -> DataFrame:
    """(word, 1) for each word of a value. Empty words go after the explode, in compiled code."""
    return df.select(F.explode(split_words(F.col("value"))).alias("key"), F.lit(1).alias("value")).where("key <> ''")


def _batched(rows: Iterable[Pair], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[Pair] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)


def made(plug: type | Callable, options: dict | None) -> object | None:
    """A user's object for a task: configured before anything else, if it can be; None for a function."""
    own = plug() if isinstance(plug, type) else None
    if hasattr(own, "configure"):
        own.configure(dict(options or {}))
    return own


def record_map(df: DataFrame, mapper: type | Callable, schema: str = "key string, value string", options: dict | None = None) -> DataFrame:
    """A user's mapper over all records.

    mapper: a function (key, value) that gives or yields pairs; or a class, made once per task, with map(key, value) and
    perhaps configure(options), setup() and close(), of which the last two may yield pairs too.
    """
    out = arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = made(mapper, options)
        step = own.map if own else mapper

        def rows() -> Iterator[Pair]:
            yield from (own.setup() or ()) if hasattr(own, "setup") else ()
            for batch in batches:
                for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield from step(key, value) or ()
            yield from (own.close() or ()) if hasattr(own, "close") else ()

        yield from _batched(rows(), out)

    return df.select("key", "value").mapInArrow(run, schema)


def arrow_map(df: DataFrame, handler: type | Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, options: dict | None = None, commands: Iterable[tuple[str, object]] = ()) -> DataFrame:
    """A handler of whole batches: buffers in, buffers out.

    handler: a function of an iterator of batches; or a class, made once per task, with process(batch), which gives or yields batches, and
    perhaps configure(options), command(name, argument), called for each of `commands` before the first batch, and finish().
    """
    if not isinstance(handler, type):
        return df.mapInArrow(handler, schema)
    commands = list(commands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = made(handler, options)
        given = lambda x: [x] if isinstance(x, pa.RecordBatch) else x or ()
        for name, argument in commands:
            yield from given(own.command(name, argument))
        for batch in batches:
            yield from given(own.process(batch))
        if hasattr(own, "finish"):
            yield from given(own.finish())

    return df.mapInArrow(run, schema)


def table_function(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """A registered table function applied to each row (a lateral join)."""
    view = f"records_{abs(hash((name, *columns)))}_{id(df)}"
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(f"select f.* from {view}, lateral {name}({', '.join(columns)}) as f")
