"""The sort benchmark: total order of fixed-prefix records, and the check of its output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import partitioning
from millrace.sources import readers, writers


def sorted_records(df: DataFrame, partitions: int | None = None, cuts: list | None = None) -> DataFrame:
    """Records in total order: partition i before i + 1, each sorted."""
    if cuts is not None:
        return partitioning.by_range(df, len(cuts) + 1, cuts=cuts).sortWithinPartitions("key")
    return (df.repartitionByRange(partitions, "key") if partitions else df.repartitionByRange("key")).sortWithinPartitions("key")


def terasort(spark: SparkSession, source: str, target: str, partitions: int | None = None, compression: str | None = None) -> None:
    writers.write_tera(sorted_records(readers.tera_lines(spark, source), partitions), target, compression)


def summary(df: DataFrame) -> DataFrame:
    """Records and a checksum that doesn't depend on their order."""
    return df.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(F.crc32(F.concat("key", "value"))), F.lit(0)).alias("checksum"))


def order_faults(df: DataFrame) -> DataFrame:
    """records, and faults: keys below the one before them, within a partition or from one to the next. df's own partitions and order count."""

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa
        from pyspark import TaskContext

        first = last = None
        faults = records = 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            records += len(keys)
            for key in keys:
                faults += last is not None and key < last
                first, last = key if first is None else first, key
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([first], pa.binary()), pa.array([last], pa.binary()), pa.array([faults]), pa.array([records])], names=["partition", "first", "last", "faults", "records"])

    ends = df.select(F.col("key").cast("binary")).mapInArrow(run, "partition long, first binary, last binary, faults long, records long")
    before = F.lag("last").over(Window.orderBy("partition"))  # a row for each partition
    return ends.withColumn("before", before).agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum(F.col("faults") + F.coalesce((F.col("before") > F.col("first")).cast("long"), F.lit(0))), F.lit(0)).alias("faults"))
