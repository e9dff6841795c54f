"""Sorting: within partitions, in total, or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import unsigned_order
from millrace.session import shared_folder

#: A row's number within its partition is the low bits of its identifier (a fixed value of Spark's).
ROW_BITS = 33


def sort_within(df: DataFrame, *keys: str) -> DataFrame:
    """Each partition sorted by its keys' bytes; the order of equal keys is open."""
    return df.sortWithinPartitions(*(keys or ("key",)))


def total_sort(df: DataFrame, *keys: str) -> DataFrame:
    """All partitions sorted, each after the one before it."""
    return df.orderBy(*(keys or ("key",)))


def place_in_partition() -> Column:
    """The number, from 0, of each row of a partition as it stands; partitions may not be joined or split before it is taken."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))


def numbered(ordered: DataFrame, out: str = "place") -> DataFrame:
    """Rows of sorted partitions with their places, from 0, in the whole order.

    The rows are written once, with the numbers of their partitions and their places there; a partition's offset is the rows of
    those before it, of which there is a row for each partition.
    """
    spark = ordered.sparkSession
    path = f"{shared_folder(spark)}/millrace/numbered-{uuid.uuid4().hex}"
    marked = ordered.withColumn("__id", F.monotonically_increasing_id())
    marked.write.parquet(path)
    rows = spark.read.schema(marked.schema).parquet(path)
    part = F.shiftrightunsigned("__id", ROW_BITS).alias("__part")
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    placed = rows.withColumn("__part", part).join(F.broadcast(offsets), "__part")  # a row for each partition
    return placed.withColumn(out, F.col("__offset") + F.col("__id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))).drop("__part", "__id", "__offset")


def byte_order_sort(df: DataFrame, key: str = "key") -> DataFrame:
    """Signed integers in the order of their big-endian bytes."""
    return df.orderBy(*unsigned_order(F.col(key)))


def unsorted(df: DataFrame) -> DataFrame:
    """Records as the exchange brings them: grouping doesn't need an order."""
    return df
