"""External commands as mappers and reducers: records go to a command's input as lines, its output lines are records.

A command runs once per task, by the shell. It is fed by a thread of its own while its output is read; a command that
fails fails the task.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from threading import Thread

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.mapping import _batched
from millrace.sources.readers import first_split
from millrace.sources.writers import kv_line


def _through(lines: Iterator[str], command: str) -> Iterator[str]:
    process = subprocess.Popen(["/bin/sh", "-c", command], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
    failed: list[BaseException] = []

    def feed() -> None:
        try:
            for line in lines:
                process.stdin.write(line.encode() + b"\n")
        except BrokenPipeError:
            pass  # the command has read all that it wants
        except BaseException as e:  # noqa: BLE001
            failed.append(e)
        finally:
            try:
                process.stdin.close()
            except BrokenPipeError:
                pass

    thread = Thread(target=feed, daemon=True)
    thread.start()
    try:
        for line in process.stdout:
            yield line.removesuffix(b"\n").decode()
        thread.join()
        code = process.wait()
    finally:  # also where nobody reads on
        process.kill()
        process.stdout.close()
        process.wait()
    if code:
        raise RuntimeError(f"{command!r} ended with status {code}")
    if failed:
        raise failed[0]


def piped(df: DataFrame, command: str, column: str = "value") -> DataFrame:
    """The output lines of a command over a column's values as lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (x or "" for batch in batches for x in batch.column(0).to_pylist())
        yield from _batched(((x,) for x in _through(lines, command)), pa.schema([("value", pa.string())]))

    return df.select(F.col(column).cast("string")).mapInArrow(run, "value string")


def pipe_map(df: DataFrame, command: str = "cat", separator: str = "\t") -> DataFrame:
    """A command over the values; each output line is split at its first separator."""
    key, value = first_split(F.col("value"), separator)
    return piped(df, command).select(key.alias("key"), value.alias("value"))


def pipe_reduce(df: DataFrame, command: str = "cat", separator: str = "\t", partitions: int | None = None, grouped: bool = False) -> DataFrame:
    """A command over the records in key order, a line each; its output lines are values with empty keys. grouped: they are in order."""
    ordered = df if grouped else (df.repartition(partitions, "key") if partitions else df.repartition("key")).sortWithinPartitions("key")
    line = F.concat(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(separator), F.coalesce(F.col("value").cast("string"), F.lit("")))
    return piped(ordered.select(line.alias("value")), command).select(F.lit("").alias("key"), "value")


def kv_lines(df: DataFrame, separator: str = "\t") -> DataFrame:
    """Records as the lines that a writer would write."""
    return df.select(kv_line(F.col("key"), F.col("value"), separator).alias("value"))
