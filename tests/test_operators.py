import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import counters, mapping, ordering, partitioning, pipes, reducing


@pytest.fixture(scope="module")
def pairs(spark):
    """Shuffled keys with values made from them."""
    rows = [(str(i), str(i * 37)) for i in range(20_000)]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "key string, value string").cache()


def test_partitions_hold_their_keys_in_order(spark, pairs):
    """Completeness, order within partitions, partition numbers and values."""
    dealt = ordering.sort_within(partitioning.by_hash(pairs, 10, compatible=True))
    from millrace.functions.text import partition_by_hash

    got = dealt.select("key", "value", F.spark_partition_id().alias("p"), partition_by_hash(F.col("key"), 10).alias("want")).collect()
    assert sorted(int(r.key) for r in got) == list(range(20_000))
    assert all(r.p == r.want and int(r.value) == int(r.key) * 37 for r in got)
    for p in range(10):
        keys = [r.key for r in got if r.p == p]
        assert keys == sorted(keys)


def test_total_order(spark):
    cuts = [f"{100 * k:07d}" for k in range(1, 100)]
    df = spark.range(10_000).select(F.format_string("%07d", "id").alias("key"), "id")
    got = partitioning.by_range(df, 100, cuts=cuts).select("id", F.spark_partition_id().alias("p")).collect()
    assert all(r.p == r.id // 100 for r in got)


@pytest.mark.parametrize("n", [2, 10, 33, 300])
def test_total_order_bounds(spark, n):
    rnd = random.Random(n)
    keys = list({"".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXY", k=rnd.randrange(10))) for _ in range(3000)})
    cuts = partitioning.pick_cuts(sorted(keys), n)
    df = spark.createDataFrame([(k,) for k in keys], "key string").select("key", partitioning.total_order(F.col("key"), cuts).alias("p"))
    for r in df.collect():
        assert r.p == partitioning.partition_of(r.key, cuts)
        assert (r.p == 0 or cuts[r.p - 1] <= r.key) and (r.p == n - 1 or r.key < cuts[r.p])


def test_cut_points(spark):
    df = spark.createDataFrame([(c,) for c in ("a", "b", "c", "d", "zz")], "key string")
    assert [r.p for r in df.select(partitioning.total_order(F.col("key"), ["b", "d"]).alias("p")).collect()] == [0, 1, 1, 2, 2]
    assert partitioning.sample_cuts(df, 5) == ["b", "c", "d", "zz"]
    with pytest.raises(ValueError, match="partitions of"):
        partitioning.sample_cuts(df, 6)
    with pytest.raises(ValueError, match="cut points"):
        partitioning.by_range(df, 2, cuts=["b", "d"])
    with pytest.raises(ValueError, match="sorted"):
        partitioning.total_order(F.col("key"), ["d", "b"])


@pytest.mark.parametrize("sample", [2_000, 100_000])
def test_cuts_of_a_hot_key(spark, sample):
    """A third of the rows have one key: it has a partition, the others are even, and none is empty."""
    df = spark.range(0, 30_000, 1, 5).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.format_string("%06d", F.expr("id * 7919 % 100003"))).alias("key"))
    cuts = partitioning.sample_cuts(df, 9, sample=sample)
    got = {r.p: r.n for r in partitioning.by_range(df, 9, cuts=cuts).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    assert cuts == sorted(set(cuts)) and len(got) == len(cuts) + 1 >= 6
    assert sum(got.values()) == 30_000 and sorted(got.values())[-2] < 2 * 30_000 / 9


@pytest.mark.parametrize(("n", "kinds"), [(1, 5000), (2, 5000), (9, 5000), (50, 3), (400, 5000)])
def test_cuts_of_many_keys_are_picked_by_spark(spark, monkeypatch, n, kinds):
    """The same cut points as of all keys sorted on the driver, which is handed few rows."""
    df = spark.range(0, 20_000, 1, 5).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 != 1, F.concat(F.lit("é"), F.expr(f"id * 7919 % {kinds}"))).alias("key"))
    want = partitioning.pick_cuts(sorted(r.key for r in df.collect() if r.key is not None), n)
    monkeypatch.setattr(partitioning, "HELD_KEYS", 1000, raising=False)
    got, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: got.append(collect(self)) or got[-1])
    assert partitioning.sample_cuts(df, n, sample=1 << 24) == partitioning.sample_cuts(df, n, sample=None) == want
    assert sum(map(len, got)) < 2 * (n + 100)
    with pytest.raises(ValueError, match="partitions of"):
        partitioning.sample_cuts(df, 20_001, sample=None)


def test_places_in_the_whole_order(spark):
    df = spark.range(0, 5_000, 1, 7).selectExpr("(id * 7919) % 5003 as k")
    got = ordering.numbered(df.repartitionByRange(6, "k").sortWithinPartitions("k")).collect()
    assert [r.k for r in sorted(got, key=lambda r: r.place)] == sorted(r.k for r in got) and [*range(5_000)] == sorted(r.place for r in got)
    assert ordering.numbered(df.where("k < 0")).count() == 0


def test_combiner_in_bounded_runs(spark, monkeypatch):
    """No exchange and no sort before it; a key may come several times, its values in their order."""
    monkeypatch.setattr(reducing, "COMBINED", 100)
    df = spark.range(0, 1_000, 1, 1).selectExpr("string(id % 7) as key", "id as value")
    got = reducing.combined(df, lambda k, values: [(k, list(values))], "key string, value array<long>")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    rows = got.collect()
    assert all(r.value == sorted(r.value) for r in rows) and sorted(v for r in rows for v in r.value) == [*range(1_000)] and len(rows) >= 7


def test_batch_handlers_take_commands(spark):
    import pyarrow as pa

    class Handler:
        def configure(self, options):
            self.add = options["add"]

        def command(self, name, argument):
            self.add += {"more": argument, "less": -argument}[name]

        def process(self, batch):
            return pa.RecordBatch.from_arrays([pa.array([x + self.add for x in batch.column(0).to_pylist()], pa.int64())], names=["id"])

        def finish(self):
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64())], names=["id"])

    got = mapping.arrow_map(spark.range(0, 4, 1, 1), Handler, "id long", {"add": 10}, [("more", 5), ("less", 1)])
    assert sorted(r.id for r in got.collect()) == [-1, 14, 15, 16, 17]


def test_a_pipe_that_nobody_reads_on_ends():
    import subprocess

    lines = pipes._through((str(k) for k in range(10**9)), "cat; echo marker-of-this-test > /dev/null")
    assert next(lines) == "0"
    lines.close()
    assert "marker-of-this-test" not in subprocess.run(["ps", "-eo", "cmd"], capture_output=True, text=True).stdout


def test_explicit_partitions(spark):
    got = partitioning.explicit(spark.range(100), 3, F.col("id") % 3).select("id", F.spark_partition_id().alias("p")).collect()
    assert all(r.p == r.id % 3 for r in got)
    nulls = spark.createDataFrame([(None,), ("a",)], "key string")
    assert partitioning.by_hash(nulls, 5, compatible=True).count() == 2
    assert nulls.where("key is null").select(partitioning.total_order(F.col("key"), ["b"]).alias("p")).first().p == 0


def test_mappers(spark):
    df = spark.createDataFrame([("a", "x y"), ("b", "")], "key string, value string")
    assert mapping.identity(df).collect() == df.collect()
    assert Counter(r.key for r in mapping.tokens(df).collect()) == {"x": 1, "y": 1}

    class Counting:
        def setup(self):
            self.n = 0

        def map(self, key, value):
            self.n += 1
            return ()

        def close(self):
            yield "records", str(self.n)

    got = mapping.record_map(df.coalesce(1), Counting).collect()
    assert [(r.key, r.value) for r in got] == [("records", "2")]
    assert mapping.record_map(df.limit(0), lambda k, v: [(k, v)]).count() == 0


def grouped(spark):
    return spark.createDataFrame([(str(i // 3217), f"{i}:{i // 3217}") for i in range(50_000)], "key string, value string")


def test_reducers_see_whole_groups(spark):
    """Groups far larger than a batch, values read in part, and results of any number."""
    df = grouped(spark)
    got = reducing.reduced(df, lambda k, values: [(k, str(sum(1 for _ in values)))], partitions=3).collect()
    assert {r.key: int(r.value) for r in got} == Counter(str(i // 3217) for i in range(50_000))
    got = reducing.reduced(df, lambda k, values: [(k, next(values).split(":")[1])], partitions=3).collect()
    assert sorted(r.key for r in got) == sorted(r.value for r in got) == sorted({str(i // 3217) for i in range(50_000)})


def test_identity_and_passive(spark):
    df = grouped(spark)
    assert reducing.identity(df, 3).exceptAll(df).count() == 0
    got = reducing.passive(df, lambda k, v: [(k, v)], partitions=3)
    assert df.exceptAll(got).count() == 0 and got.count() == 50_000


def test_sums(spark):
    df = spark.createDataFrame([("a", 2**31), ("a", 2**31), ("a", 5), ("b", 1)], "key string, value long")
    assert {r.key: r.value for r in reducing.int_sum(df).collect()} == {"a": 2**32 + 5, "b": 1}
    assert {r.key: r.value for r in reducing.int_sum(df, wrap=True).collect()} == {"a": 5, "b": 1}
    assert {r.key: r.value for r in reducing.count_records(df).collect()} == {"a": 3, "b": 1}


def test_folds(spark):
    df = grouped(spark)
    parts = dict(init=lambda k: 0, step=lambda s, v: s + 1, finish=lambda k, s: f"{k}={s}")
    plain = {r.value for r in reducing.fold(df, **parts).collect()}
    assert plain == {r.value for r in reducing.fold(df, merge=lambda a, b: a + b, **parts).collect()}
    assert "0=3217" in plain


def test_sums_are_combined_before_the_exchange(spark):
    plan = reducing.int_sum(spark.range(10).selectExpr("id % 2 as key", "id as value"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan


def test_pipes(spark):
    df = spark.createDataFrame([("", "b\t2\tx"), ("", "a")], "key string, value string")
    assert sorted((r.key, r.value) for r in pipes.pipe_map(df).collect()) == [("a", ""), ("b", "2\tx")]
    assert sorted(r.value for r in pipes.pipe_reduce(df.selectExpr("value as key", "'v' as value"), "cat").collect()) == ["a\tv", "b\t2\tx\tv"]
    assert [r.value for r in pipes.piped(df.coalesce(1), "wc -l | tr -d ' '").collect()] == ["2"]
    with pytest.raises(Exception, match="status 3"):
        pipes.pipe_map(df, "cat > /dev/null; exit 3").collect()
    many = spark.range(0, 200_000, 1, 2).selectExpr("'' as key", "string(id) as value")
    assert pipes.pipe_map(many).count() == 200_000
    assert pipes.pipe_map(many, "head -n 1").count() == 2


def test_counters(spark):
    own = counters.Counters()
    df = own.watch(spark.createDataFrame([("a", "é"), (None, "xyz")], "key string, value string"), "in")
    own.watch(df, "mine", long_values=F.count_if(F.length("value") > 2)).write.format("noop").mode("overwrite").save()
    assert own.get() == {"in": {"records": 2, "bytes": 6}, "mine": {"long_values": 1}}


def test_cogroup(spark):
    a, b = (spark.createDataFrame(x, "key int, value string") for x in ([(1, "x"), (2, "y")], [(1, "z")]))
    assert [(r.key, r.left, r.right) for r in reducing.cogrouped(a, b, "left").orderBy("key").collect()] == [(1, "x", "z"), (2, "y", None)]


def test_mapper_as_combiner(spark):
    class Runs:
        def setup(self):
            self.key, self.n = None, 0

        def map(self, key, value):
            if key != self.key:
                yield from self.close()
                self.key, self.n = key, 0
            self.n += 1

        def close(self):
            if self.n:
                yield self.key, str(self.n)

    df = spark.createDataFrame([(k, "") for k in "abacab"], "key string, value string").coalesce(1)
    assert [(r.key, r.value) for r in reducing.combined_records(df, Runs).collect()] == [("a", "3"), ("b", "2"), ("c", "1")]


def test_small_inputs_are_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "x"))
    small = partitioning.spread(spark.read.parquet(str(tmp_path / "x")))
    assert small.rdd.getNumPartitions() == 4 and small.count() == 100
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        many = spark.read.parquet(str(tmp_path / "x"))
        assert partitioning.spread(many) is many
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
