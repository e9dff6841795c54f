"""Partitioners: which partition a record goes to, and the exchange that takes it there."""

from __future__ import annotations

import math
import uuid
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import partition_by_hash
from millrace.operators.ordering import ROW_BITS
from millrace.session import shared_folder

#: Cut points up to which they are compared one by one; keys up to which the driver holds them to pick cut points.
FLAT_CUTS, HELD_KEYS = 32, 100_000


def by_hash(df: DataFrame, n: int, key: str = "key", compatible: bool = False) -> DataFrame:
    """n partitions by a hash of the key; compatible: by the 31-fold hash, else by Spark's own, which is faster."""
    return explicit(df, n, partition_by_hash(F.col(key), n)) if compatible else df.repartition(n, key)


def explicit(df: DataFrame, n: int, partition: Column) -> DataFrame:
    """Each row to the partition whose number a column gives; null is the first."""
    return df.withColumn("__p", F.coalesce(partition.cast("int"), F.lit(0))).repartitionById(n, F.col("__p")).drop("__p")


def total_order(key: Column, cuts: list) -> Column:
    """How many of the sorted cut points are at most the key: cuts[p - 1] <= key < cuts[p] for partition p."""
    if sorted(cuts) != list(cuts):
        raise ValueError("cut points must be sorted")
    if not cuts:
        return F.lit(0)
    literal = lambda xs: F.array(*(F.lit(x) for x in xs))
    passed = lambda xs: F.size(F.filter(xs, lambda c: c <= key))
    if len(cuts) <= FLAT_CUTS:
        return passed(literal(cuts))
    size = math.isqrt(len(cuts) - 1) + 1  # two steps: the run of cuts, then the place in it
    runs = [cuts[k : k + size] for k in range(0, len(cuts), size)]
    run = passed(literal([r[0] for r in runs]))
    inside = passed(F.element_at(F.array(*(literal(r) for r in runs)), F.greatest(run, F.lit(1))))
    return F.when(run == 0, 0).otherwise((run - 1) * size + inside)


def partition_of(key, cuts: list) -> int:  # noqa: ANN001
    """total_order for one key, on the driver."""
    low = bisect_left(cuts, key)
    while low < len(cuts) and cuts[low] == key:
        low += 1
    return low


def sample_cuts(df: DataFrame, n: int, key: str = "key", sample: int | None = 100_000) -> list:
    """n - 1 cut points, or fewer, at even steps of a sorted sample of about `sample` rows; all rows, if there are no more, or for None.

    Rows are taken by a hash of their places, so a key is in the sample as often as its share of the rows demands. The driver
    holds HELD_KEYS keys or so at most; more are counted and sorted by Spark, with the same result.
    """
    keys = df.select(F.col(key).alias("k")).where("k is not null")
    rows = keys.count()
    if sample is not None and rows > sample:
        most = int(sample / rows * (1 << 62))
        keys = keys.where(F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id(), F.lit(17)), 2) < most)
        rows = sample
    if rows > HELD_KEYS:
        return _picked(keys, n)
    found = sorted(r.k for r in keys.collect())
    _enough(len(found), n)
    return pick_cuts(found, n)


def _enough(rows: int, n: int) -> None:
    if n > max(1, rows):
        raise ValueError(f"{n} partitions of {rows} sampled keys")


def _places(rows: int, n: int) -> list[int]:
    """Those of n - 1 even steps among so many rows."""
    step = rows / n
    return [min(rows - 1, int(math.floor(step * i + 0.5))) for i in range(1, n)]


def pick_cuts(keys: list, n: int) -> list:
    """Of sorted keys, those at even steps, each once: equal cut points would have empty partitions between them."""
    return sorted({keys[p] for p in _places(len(keys), n)})


def _picked(keys: DataFrame, n: int) -> list:
    """pick_cuts of a column k of any size: what comes to the driver is a row for each partition, and the cut points.

    Distinct keys are written once, sorted, with their counts, so a hot key is a row; only in the partitions in which a place falls are
    rows numbered.
    """
    spark = keys.sparkSession
    path = f"{shared_folder(spark)}/millrace/cuts-{uuid.uuid4().hex}"
    ordered = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy("k").withColumn("id", F.monotonically_increasing_id())
    ordered.write.parquet(path)
    rows = spark.read.schema(ordered.schema).parquet(path).withColumn("part", F.shiftrightunsigned("id", ROW_BITS))
    sizes = sorted((r.part, r.n) for r in rows.groupBy("part").agg(F.sum("n").alias("n")).collect())
    total = sum(size for _, size in sizes)
    _enough(total, n)
    places, starts, before = _places(total, n), [], 0
    for part, size in sizes:
        if bisect_left(places, before) < bisect_left(places, before + size):
            starts.append((part, before))
        before += size
    held = rows.join(F.broadcast(spark.createDataFrame(starts, "part long, start long")), "part")
    end = F.col("start") + F.sum("n").over(Window.partitionBy("part").orderBy("id"))
    wanted = held.select("k", "n", end.alias("end")).where(total_order(F.col("end") - 1, places) > total_order(F.col("end") - F.col("n") - 1, places))
    cuts = sorted(r.k for r in wanted.select("k").collect())
    written = spark._jvm.org.apache.hadoop.fs.Path(path)
    written.getFileSystem(spark._jsc.hadoopConfiguration()).delete(written, True)
    return cuts


def read_cuts(spark: SparkSession, path: str) -> list[str]:
    """Cut points from a file: the keys of its lines, up to a tab, in the order of their bytes."""
    from millrace.sources import readers

    return sorted({r.key for r in readers.key_value_lines(spark, path).select("key").collect()}, key=str.encode)


def write_cuts(spark: SparkSession, cuts: list, path: str) -> None:
    """Cut points as a file that read_cuts reads."""
    spark.createDataFrame([(str(c),) for c in cuts], "value string").coalesce(1).write.option("lineSep", "\n").text(path)


def by_range(df: DataFrame, n: int, key: str = "key", cuts: list | None = None) -> DataFrame:
    """n partitions in key order: by given cut points, or by those that Spark samples. With fewer cut points the last partitions are empty."""
    if cuts is None:
        return df.repartitionByRange(n, key)
    if len(cuts) > n - 1:
        raise ValueError(f"{n} partitions have {n - 1} cut points, not {len(cuts)}")
    return explicit(df, n, total_order(F.col(key), cuts))


def truncated(df: DataFrame, size: int, key: str = "key") -> DataFrame:
    """Records under the first characters of their keys."""
    return df.withColumn(key, F.substring(key, 1, size))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it is so small that its files would occupy less than half of them; large inputs stay as they are read."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores) if size // max(1, split) + 1 <= cores // 2 else df
