import glob
import random

import pytest
from pyspark.sql import functions as F

from millrace.sources import readers, writers

RAW = b"a\rb\r\nc\n\nd\te\tf\nlast"


@pytest.fixture
def raw(tmp_path):
    (tmp_path / "in.txt").write_bytes(RAW)
    return str(tmp_path / "in.txt")


def test_lines(spark, raw):
    rows = readers.lines(spark, raw).collect()
    assert [r.value for r in rows] == ["a\rb", "c", "", "d\te\tf", "last"]
    assert {r.key for r in rows} == {""}


def test_lines_of_both_terminators(spark, tmp_path):
    rnd = random.Random(3)
    want = ["".join(rnd.choices("ABCXYZ", k=rnd.randrange(32))) for _ in range(5000)]
    (tmp_path / "x").write_bytes(b"".join(x.encode() + (b"\r\n" if k % 2 else b"\n") for k, x in enumerate(want)))
    assert [r.value for r in readers.lines(spark, str(tmp_path / "x")).collect()] == want


def test_split_lines_is_the_line_reader(spark, raw):
    df = spark.createDataFrame([(RAW.decode(),), ("x\n",), ("",), (None,)], "t string").select(readers.split_lines(F.col("t")).alias("l"))
    assert [r.l for r in df.collect()] == [["a\rb", "c", "", "d\te\tf", "last"], ["x"], [], None]


def test_key_value_lines(spark, tmp_path):
    (tmp_path / "x").write_text("a\t1\tx\nnokey\n\tv\n\n")
    got = [(r.key, r.value) for r in readers.key_value_lines(spark, str(tmp_path / "x")).collect()]
    assert got == [("a", "1\tx"), ("nokey", ""), ("", "v"), ("", "")]
    got = [(r.key, r.value) for r in readers.key_value_lines(spark, str(tmp_path / "x"), "1ignored").collect()]
    assert got[0] == ("a\t", "\tx")


def test_tera_and_raw_lines(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"0123456789rest\r\nshort\r\n")
    assert [(bytes(r.key), bytes(r.value)) for r in readers.tera_lines(spark, str(tmp_path / "x")).collect()] == [(b"0123456789", b"rest"), (b"short", b"")]
    assert [r.value for r in readers.raw_lines(spark, str(tmp_path / "x")).collect()] == ["0123456789rest\r\n", "short\r\n"]


def test_writer_rules(spark, tmp_path):
    df = spark.createDataFrame([("k", "v"), ("k", ""), ("", "v"), ("", ""), (None, "n")], "key string, value string").coalesce(1)
    writers.write_kv(df, str(tmp_path / "out"))
    (part,) = glob.glob(str(tmp_path / "out/part-*"))
    assert open(part, "rb").read() == b"k\tv\nk\nv\n\nn\n"


def test_number_and_tera_writers(spark, tmp_path):
    writers.write_text_int(spark.createDataFrame([("", 3)], "key string, value int").coalesce(1), str(tmp_path / "n"), separator=":")
    writers.write_tera(spark.createDataFrame([(bytearray(b"ab"), bytearray(b"c"))], "key binary, value binary").coalesce(1), str(tmp_path / "t"))
    writers.write_raw(spark.createDataFrame([("", "x\n"), ("", "y\n")], "key string, value string").coalesce(1), str(tmp_path / "r"))
    writers.write_raw(spark.createDataFrame([("", "x\ny"), ("", None), ("", "z")], "key string, value string").coalesce(1), str(tmp_path / "u"))
    writers.write_raw(spark.createDataFrame([("", "x\n"), ("", "z")], "key string, value string").coalesce(1), f"file://{tmp_path}/g", compression="gzip")
    assert open(glob.glob(str(tmp_path / "u/part-*"))[0], "rb").read() == b"x\nyz"
    assert sorted(r.value for r in readers.lines(spark, str(tmp_path / "g")).collect()) == ["x", "z"]
    with pytest.raises(FileExistsError):
        writers.write_raw(spark.createDataFrame([("", "z")], "key string, value string"), str(tmp_path / "u"))
    got = [open(glob.glob(str(tmp_path / f"{x}/part-*"))[0], "rb").read() for x in "ntr"]
    assert got == [b":3\n", b"abc\r\n", b"x\ny\n"]


@pytest.mark.parametrize("codec", [c for c in writers.CODECS])
def test_codecs(spark, tmp_path, codec):
    df = spark.range(1000).select(F.col("id").cast("string").alias("key"), F.md5(F.col("id").cast("string")).alias("value"))
    writers.write_kv(df, str(tmp_path / "out"), compression=codec)
    assert readers.key_value_lines(spark, str(tmp_path / "out")).exceptAll(df).count() == 0


def test_unknown_codec(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown codec"):
        writers.write_kv(spark.createDataFrame([("k", "v")], "key string, value string"), str(tmp_path / "out"), compression="zip")


def test_sequence_file_and_frames(spark, tmp_path):
    spark.sparkContext.parallelize([("a", "1"), ("b", "2")]).saveAsSequenceFile(str(tmp_path / "seq"))
    assert sorted((r.key, r.value) for r in readers.sequence_file(spark, str(tmp_path / "seq")).collect()) == [("a", "1"), ("b", "2")]
    df = readers.from_dataframe(spark.range(3), "id", F.col("id") * 2)
    writers.write_frame(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
