"""Counters of a job, gathered by the job itself as it runs: no second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def record_bytes() -> Column:
    """The bytes of keys and values."""
    size = lambda c: F.coalesce(F.octet_length(F.col(c).cast("string").cast("binary")), F.lit(0))
    return F.coalesce(F.sum((size("key") + size("value")).cast("bigint")), F.lit(0).cast("bigint"))


class Counters:
    """Named counts of the records and bytes that pass some points of a plan; readable when an action has ended.

    A user's counter is any aggregation: counters.watch(df, "bad lines", n=F.count_if(...)).
    """

    def __init__(self) -> None:
        self.points: dict[str, Observation] = {}

    def watch(self, df: DataFrame, name: str, **more: Column) -> DataFrame:
        own = self.points[name] = Observation()
        metrics = dict(more) if more else {"records": F.count(F.lit(1)), "bytes": record_bytes()}
        return df.observe(own, *(col.alias(k) for k, col in metrics.items()))

    def get(self) -> dict[str, dict[str, int]]:
        """Waits for the action that passes each point."""
        return {name: dict(o.get) for name, o in self.points.items()}


def group_statistics(df: DataFrame, partition: Column) -> DataFrame:
    """Groups and records of each partition."""
    return df.groupBy(partition.alias("partition")).agg(F.count_distinct("key").alias("groups"), F.count(F.lit(1)).alias("records"))
