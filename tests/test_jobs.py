import glob
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace import cli, registry
from millrace.functions import text as fn
from millrace.options import JobOptions, parse_bool, parse_list, parse_pairs
from millrace.plans import terasort as tera
from millrace.plans.job import Job, user_map, user_reduce, word_count
from millrace.sources import generators, readers, writers
from millrace.streaming import words as streams

TEXT = "the cat\tsat on the mat\r\nthe end\n" * 50


@pytest.fixture
def source(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text(TEXT)
    return str(tmp_path / "in")


def lines_of(path):
    return sorted(x for p in glob.glob(f"{path}/part-*") for x in open(p).read().splitlines())


def test_word_count(spark, source, tmp_path):
    counts = word_count(spark, [source, source], str(tmp_path / "out")).run()
    assert lines_of(tmp_path / "out") == sorted(f"{w}\t{2 * n}" for w, n in Counter(TEXT.split()).items())
    assert counts["map input"]["records"] == 200 and counts["map output"]["records"] == 2 * len(TEXT.split())


def test_default_job_is_sorted_identity(spark, source, tmp_path):
    Job(spark).input(source).output(str(tmp_path / "out")).reduces(1).run()
    assert lines_of(tmp_path / "out") == sorted(TEXT.splitlines())


def test_map_only_job_has_no_exchange(spark, source):
    df = Job(spark).input(source).mapper("core.tokens").reduces(0).records()
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_user_classes_and_combiner(spark, source):
    class Lengths:
        def map(self, key, value):
            for w in value.split():
                yield str(len(w)), "1"

    total = lambda k, values: [(k, str(sum(map(int, values))))]
    job = Job(spark).input(source).mapper(user_map(Lengths)).combiner(lambda df: __import__("millrace.operators.reducing", fromlist=["x"]).combined(df, total)).reducer(user_reduce(total)).reduces(3)
    assert {r.key: int(r.value) for r in job.records().collect()} == Counter(str(len(w)) for w in TEXT.split())


def test_sums_are_dealt_and_sorted(spark):
    """Also sums and counts have the partitions asked for, in key order; output counters say what came out."""
    rows = spark.range(3000).selectExpr("format_string('%03d', id % 300) as key", "1 as value")
    job = Job(spark).input(frame=rows).reducer("core.int_sum").partitioner("core.total_order", ["100", "200"]).reduces(3)
    got = job.records().withColumn("p", F.spark_partition_id()).collect()
    assert [(r.key, r.value, r.p) for r in got] == [(f"{k:03d}", 10, k // 100) for k in range(300)]
    counts = job.counters.get()
    assert (counts["map output"]["records"], counts["reduce groups"]["records"]) == (3000, 300)


def test_counters_of_every_kind_of_job(spark, source):
    job = Job(spark).input(source).mapper("core.tokens").reduces(0)
    words = len(TEXT.split())
    assert job.records().count() == words and job.counters.get()["map output"]["records"] == words
    job = Job(spark).input(source).reducer("core.group_identity").reduces(2)
    job.records().collect()
    counts = job.counters.get()
    assert counts["reduce input"]["records"] == counts["reduce output"]["records"] == 100 and counts["map input"]["bytes"] > 0


def test_several_inputs_of_both_kinds(spark, source):
    rows = spark.createDataFrame([("k", "v")], "key string, value string")
    got = Job(spark).input(source, frame=rows).input(frame=rows).reduces(0).records()
    assert got.count() == 102


def test_options_reach_plug_ins(spark, source):
    class Tagged:
        def configure(self, options):
            self.tag, self.n = options["my.tag"], options["partitions"]

        def map(self, key, value):
            yield self.tag, str(self.n)

    class Joined:
        def configure(self, options):
            self.tag = options["my.tag"]

        def reduce(self, key, values):
            yield key + self.tag, "".join(sorted(set(values)))

    options = JobOptions().with_pairs({"my.tag": "x", "mapred.reduce.tasks": "3"})
    got = Job(spark, options).input(source).mapper(user_map(Tagged)).reducer(user_reduce(Joined)).records().collect()
    assert [(r.key, r.value) for r in got] == [("xx", "3")]


@pytest.mark.parametrize("plug", ["core.group_identity", "core.pipe_reduce", user_reduce(lambda k, v: [(k, ",".join(v))])])
def test_reducers_keep_the_partitions(spark, plug):
    """Records are dealt but once, by the job's partitioner."""
    rows = spark.range(40).selectExpr("string(id % 8) as key", "string(id) as value")
    df = Job(spark).input(frame=rows).partitioner(F.col("key").cast("int") % 4).reducer(plug).reduces(4).records()
    got = df.withColumn("p", F.spark_partition_id()).collect()
    assert got and all(int((r.key or r.value).split("\t")[0]) % 4 == r.p for r in got)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_plug_ins_named_by_options(spark, source, tmp_path):
    names = {"native.mapper.class": "core.tokens", "native.reducer.class": "core.count_records", "native.recordwriter.class": "core.text_int", "native.recordreader.class": "core.lines"}
    Job(spark, JobOptions().with_pairs(names)).input(source).output(str(tmp_path / "out")).run()
    assert lines_of(tmp_path / "out") == sorted(f"{w}\t{n}" for w, n in Counter(TEXT.split()).items())


def test_a_mapper_meets_records_as_they_stand(spark, tmp_path):
    """The order of a small input is that of its files, whatever the number of cores."""

    class Numbered:
        n = 0

        def map(self, key, value):
            self.n += 1
            yield value, str(self.n)

    (tmp_path / "a").write_text("".join(f"{k:04d}\n" for k in range(500)))
    got = Job(spark).input(str(tmp_path / "a")).mapper(user_map(Numbered)).reduces(1).records().collect()
    assert [(r.key, r.value) for r in got] == [(f"{k:04d}", str(k + 1)) for k in range(500)]


def test_cut_points_of_a_file(spark, tmp_path):
    from millrace.operators import partitioning

    rows = spark.range(100).selectExpr("format_string('%03d', id) as key", "id as value")
    partitioning.write_cuts(spark, ["025", "050", "075"], str(tmp_path / "cuts"))
    options = JobOptions().with_pairs({"total.order.partitioner.path": str(tmp_path / "cuts"), "mapred.reduce.tasks": "4"})
    got = Job(spark, options).input(frame=rows).partitioner("core.total_order").records().select("value", F.spark_partition_id().alias("p")).collect()
    assert all(r.p == r.value // 25 for r in got) and len(got) == 100


def test_partitioners(spark, source):
    job = Job(spark).input(frame=spark.range(100).selectExpr("format_string('%03d', id) as key", "id as value")).reduces(4)
    cuts = ["025", "050", "075"]
    got = job.partitioner("core.total_order", cuts).records().select("value", F.spark_partition_id().alias("p")).collect()
    assert all(r.p == r.value // 25 for r in got)
    got = job.partitioner(F.col("value") % 4).records().select("value", F.spark_partition_id().alias("p")).collect()
    assert all(r.p == r.value % 4 for r in got)
    got = job.partitioner(lambda df, n: fn.partition_by_hash(F.col("key"), n)).records()
    assert got.count() == 100


def test_registry(spark):
    registry.register("mine", {"lines": "first"})
    registry.register("mine", {"lines": "second"})
    assert registry.lookup("mine.lines") == registry.lookup("lines") == "second"
    assert registry.lookup("core.lines") is readers.lines
    registry.load("w=millrace.sources.writers")
    assert registry.lookup("w.write_kv") is writers.write_kv
    with pytest.raises(KeyError):
        registry.lookup("mine.none")
    with pytest.raises(KeyError):
        registry.default("none")
    registry._LIBRARIES[:] = registry._LIBRARIES[:1]


def test_options():
    pairs = parse_pairs(["# c", "a = 1", "a=2", "-b=3", "", "mapred.reduce.tasks=5", "mapred.output.compress=true", "mapred.output.compression.codec=org.apache.hadoop.io.compress.SnappyCodec"])
    assert pairs["a"] == "1,2" and "-b" not in pairs
    o = JobOptions().with_pairs(pairs)
    assert (o.partitions, o.compress, o.codec, o.extra["a"]) == (5, True, "snappy", "1,2")
    assert parse_list(" 1, ,2 ", int) == [1, 2] and parse_bool("true") and not parse_bool("TRUE")


def test_command_line(spark, source, tmp_path):
    args = cli.parser().parse_args(["submit", "-input", source, "-output", str(tmp_path / "out"), "-mapper", "core.tokens", "-reducer", "core.count_records", "-writer", "core.text_int", "-reduces", "2", "-D", "mapred.textoutputformat.separator=:"])
    cli.job_of(spark, args).run()
    assert lines_of(tmp_path / "out") == sorted(f"{w}:{n}" for w, n in Counter(TEXT.split()).items())


def test_command_line_formats(spark, source, tmp_path):
    parse = lambda *x: cli.parser().parse_args(["submit", *x])
    spark.createDataFrame([("b", "2"), ("a", "1")], "key string, value string").write.parquet(str(tmp_path / "p"))
    args = parse("-input", str(tmp_path / "p"), "-output", str(tmp_path / "o"), "-inputformat", "parquet", "-outputformat", "json", "-mapper", "JAVA", "-reducer", "JAVA", "-maps", "3", "-reduces", "1")
    job = cli.job_of(spark, args)
    assert job.options.maps == 3
    job.run()
    assert [(r.key, r.value) for r in spark.read.json(str(tmp_path / "o")).collect()] == [("a", "1"), ("b", "2")]
    args = parse("-input", source, "-output", str(tmp_path / "q"), "-maps", "5", "-reduces", "0")
    assert cli.job_of(spark, args).records().rdd.getNumPartitions() == 5


def test_terasort_command(spark, tmp_path, monkeypatch):
    rows = generators.teragen(spark, 3_000, 3)
    writers.write_tera(rows, str(tmp_path / "in"))
    assert cli.main(["terasort", str(tmp_path / "in"), str(tmp_path / "out"), "-reduces", "4"]) == 0
    keys = [line[:10] for p in sorted(glob.glob(str(tmp_path / "out/part-*"))) for line in open(p, "rb").read().split(b"\r\n") if line]
    assert len(keys) == 3_000 and keys == sorted(keys)


def test_terasort(spark, tmp_path):
    rows = generators.teragen(spark, 20_000, 5)
    writers.write_tera(rows, str(tmp_path / "in"))
    tera.terasort(spark, str(tmp_path / "in"), str(tmp_path / "out"), 6)
    parts = sorted(glob.glob(str(tmp_path / "out/part-*")))
    keys = [line[:10] for p in parts for line in open(p, "rb").read().split(b"\r\n") if line]
    assert len(keys) == 20_000 and keys == sorted(keys) and len(parts) > 1
    assert tera.summary(readers.tera_lines(spark, str(tmp_path / "out"))).first() == tera.summary(rows.select("key", "value")).first()
    good, bad = (tera.order_faults(x).first() for x in (tera.sorted_records(rows.select("key", "value"), 6), rows.select("key", "value")))
    assert good.faults == 0 and bad.faults > 0 and good.records == bad.records == 20_000


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("a b\na\n")
    query = streams.word_counts(streams.line_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("stream_words").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {r.key: r.value for r in spark.table("stream_words").collect()} == {"a": 2, "b": 1}


def test_windowed_stream(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:00:01' as t, 'k' as k union all select timestamp'2024-01-01 00:00:09', 'k' union all select timestamp'2024-01-01 00:00:12', 'k'")
    rows.write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    counted = streams.windowed_counts(events, "t", F.col("k"), "10 seconds", "1 minute")
    query = counted.writeStream.format("memory").queryName("stream_windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.value for r in spark.table("stream_windows").collect()) == [1, 2]
