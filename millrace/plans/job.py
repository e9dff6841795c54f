"""Jobs: read, map, partition, combine, sort, reduce, write, as one lazy DataFrame plan.

A plug-in is a name of the registry, a function from records to records, or a user's mapper or reducer class or record
function (wrapped by user_map and user_reduce). A function with a parameter `options` is given the job's options as a
dictionary, and hands them to configure() of a user's class; a reducer with a parameter `grouped` is told that its partitions are
dealt and sorted already. Sums and counts need no combiner, since Spark combines before each exchange.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import asdict, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import registry
from millrace.operators import counters, mapping, ordering, partitioning, reducing
from millrace.options import JobOptions

Plug = str | Callable | None


def user_map(mapper: type | Callable, schema: str = "key string, value string") -> Callable:
    return lambda df, options=None: mapping.record_map(df, mapper, schema, options)


def user_reduce(reducer: type | Callable, schema: str = "key string, value string") -> Callable:
    return lambda df, options=None, grouped=False: reducing.reduced(df, reducer, schema, options=options, grouped=grouped)


class Job:
    """Built up by its methods, which return it; records() is the plan, run() writes it."""

    def __init__(self, spark: SparkSession, options: JobOptions | None = None, name: str = "job") -> None:
        self.spark, self.options, self.name = spark, options or JobOptions(), name
        self.paths: list[str] = []
        self.frames: list[DataFrame] = []
        self.target: str | None = None
        self.plugs: dict[str, Plug] = dict(self.options.plugs)
        self.counters = counters.Counters()
        self.cuts: list | None = None

    def input(self, *paths: str, frame: DataFrame | None = None) -> Job:
        """Files, read one after another; and records, after those of the files."""
        self.paths += paths
        self.frames += [] if frame is None else [frame.select("key", "value")]
        return self

    def output(self, path: str) -> Job:
        self.target = path
        return self

    def reader(self, plug: Plug) -> Job:
        return self._plug("reader", plug)

    def mapper(self, plug: Plug) -> Job:
        return self._plug("mapper", plug)

    def combiner(self, plug: Plug) -> Job:
        return self._plug("combiner", plug)

    def partitioner(self, plug: Plug | Column, cuts: list | None = None) -> Job:
        """hash, total_order (with cut points, given or in the file that the options name, or sampled by Spark), or a column of partition numbers."""
        self.cuts = cuts
        return self._plug("partitioner", plug)

    def reducer(self, plug: Plug) -> Job:
        return self._plug("reducer", plug)

    def writer(self, plug: Plug) -> Job:
        return self._plug("writer", plug)

    def library(self, libraries: str) -> Job:
        registry.load(libraries)
        return self

    def maps(self, n: int) -> Job:
        """A hint: the partitions that the input is dealt to."""
        self.options = replace(self.options, maps=n)
        return self

    def reduces(self, n: int) -> Job:
        self.options = replace(self.options, partitions=n)
        return self

    def _plug(self, role: str, plug: Plug) -> Job:
        self.plugs[role] = plug
        return self

    def _found(self, role: str) -> Callable:
        plug = self.plugs.get(role)
        return registry.default(role) if plug is None else registry.lookup(plug) if isinstance(plug, str) else plug

    def _dealt(self, df: DataFrame) -> DataFrame:
        n = self.options.partitions or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        how = self._found("partitioner")
        if isinstance(how, Column):
            return partitioning.explicit(df, n, how)
        if how == "total_order":
            return partitioning.by_range(df, n, cuts=self.cuts if self.cuts is not None or not self.options.cuts else partitioning.read_cuts(self.spark, self.options.cuts))
        if how == "hash":
            return partitioning.by_hash(df, n)
        return partitioning.explicit(df, n, how(df, n))

    def _applied(self, role: str, df: DataFrame, **more) -> DataFrame:  # noqa: ANN003
        plug = self.plugs.get(role)
        found = self._found(role) if role != "combiner" else registry.lookup(plug) if isinstance(plug, str) else plug
        known = inspect.signature(found).parameters
        more = {k: v for k, v in more.items() if k in known}
        if "options" in known:
            own = {k: v for k, v in asdict(self.options).items() if k not in ("extra", "plugs")}
            more["options"] = own | self.options.extra
        return found(df, **more)

    def _read(self) -> DataFrame:
        frames = list(self.frames)
        if self.paths:
            reader = self._found("reader")
            more = {"separator": self.options.input_separator} if "separator" in inspect.signature(reader).parameters else {}
            frames.insert(0, reader(self.spark, self.paths, **more))
        if not frames:
            raise ValueError("a job needs input")
        df = reduce(DataFrame.unionByName, frames)
        return df.repartition(self.options.maps) if self.options.maps else df

    def records(self) -> DataFrame:
        """The plan of the job's output records: dealt by the partitioner, and each partition sorted by key before it is reduced.

        Sums and counts are made before and after an exchange of their own; if a number of reduces or a partitioner is named, their
        results are dealt by it. Their partitions are sorted, too.
        """
        df = self.counters.watch(self._read(), "map input")
        mapper, reducer = self._found("mapper"), self._found("reducer")
        counted = self.plugs.get("reducer") is not None and reducer in (reducing.int_sum, reducing.count_records)
        if mapper is mapping.tokens and counted:
            df = partitioning.spread(df)  # neither keeps a state or an order, and splitting is much work on few bytes
        df = self.counters.watch(self._applied("mapper", df), "map output")
        if self.options.partitions == 0:
            return df
        if self.plugs.get("combiner") is not None:
            df = self.counters.watch(self._applied("combiner", df), "combine output")
        if counted:
            df = reducer(df, **({"wrap": self.options.wrap_sums} if reducer is reducing.int_sum else {}))
            df = self.counters.watch(df, "reduce groups", records=F.count(F.lit(1)))
            if self.options.partitions or self.plugs.get("partitioner") is not None:
                df = self._dealt(df)
            return ordering.sort_within(df) if self.options.sort else df
        df = self.counters.watch(self._dealt(df), "reduce input")
        if self.options.sort:
            df = ordering.sort_within(df)
        return self.counters.watch(self._applied("reducer", df, grouped=self.options.sort), "reduce output")

    def run(self) -> dict[str, dict[str, int]]:
        """Write the output; the counters of the points that the plan passed."""
        if not self.target:
            raise ValueError("a job needs an output path")
        writer, options = self._found("writer"), self.options
        more = {"separator": options.separator} if "separator" in inspect.signature(writer).parameters else {}
        writer(self.records(), self.target, compression=options.codec if options.compress else None, **more)
        return self.counters.get()


def word_count(spark: SparkSession, paths: list[str], target: str | None = None) -> Job:
    """Words of text files and their counts, as lines of word, separator and number."""
    job = Job(spark, name="word count").input(*paths).mapper("core.tokens").reducer("core.int_sum").writer("core.text_int")
    return job.output(target) if target else job
