import pytest
from pyspark.sql import functions as F

from millrace.functions import text as fn


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("key", "h"), [("", 1), ("abc", 126145), ("hello world", 1923188771), ("é", 4294966279), ("z" * 22, 3443495169)])
def test_string_hash(spark, key, h):
    assert one(spark, fn.string_hash, key) == h
    assert one(spark, lambda c: fn.partition_by_hash(c, 7), key) == (h & 0x7FFFFFFF) % 7
    assert one(spark, lambda c: fn.partition_by_hash(c, 1), key) == 0


def test_words(spark):
    assert one(spark, fn.words, " the  cat\tsat\fon\rthe mat ") == ["the", "cat", "sat", "on", "the", "mat"]
    assert one(spark, fn.words, "a\u000bb c") == ["a\u000bb c"]
    assert one(spark, fn.words, "") == []


def test_lenient_numbers(spark):
    assert [one(spark, fn.to_int, x) for x in ("12", " -7x", "x", "")] == [12, -7, 0, 0]
    assert [one(spark, fn.to_float, x) for x in ("1.5e2z", ".5", "no")] == [150.0, 0.5, 0.0]
    assert [one(spark, fn.to_bool, x) for x in ("true", "True", None)] == [True, False, False]


def test_strings(spark):
    assert one(spark, fn.trimmed, "\t a b\v\n ") == "a b"
    assert one(spark, lambda c: fn.split_on(c, ".."), "a..b....c") == ["a", "b", "", "c"]
    assert one(spark, lambda c: fn.split_on(c, ",", clean=True), " a ,, b") == ["a", "b"]
    assert one(spark, lambda c: fn.padded(c, 5, "0"), 42, "int") == "00042"
    assert one(spark, lambda c: fn.padded(c, 1), 42, "int") == "42"


def test_checksums(spark):
    data = bytearray(b"123456789")
    assert one(spark, F.crc32, data, "binary") == 3421780262
    assert one(spark, fn.crc32c, data, "binary") == 0xE3069283
    assert one(spark, fn.crc32c, None, "binary") is None
    import random

    rnd = random.Random(4)

    def bitwise(value):
        state = 0xFFFFFFFF
        for byte in value:
            state ^= byte
            for _ in range(8):
                state = (state >> 1) ^ (0x82F63B78 if state & 1 else 0)
        return state ^ 0xFFFFFFFF

    values = [rnd.randbytes(n) for n in [*range(70), 127, 128, 129, 1000, 3]]
    assert fn.checksums(values).tolist() == [bitwise(x) for x in values] and len(fn.checksums([])) == 0


def test_unsigned_order(spark):
    rows = spark.createDataFrame([(x,) for x in (-1, 5, 300, -9, 0)], "x long").orderBy(*fn.unsigned_order(F.col("x"))).collect()
    assert [r.x for r in rows] == [0, 5, 300, -9, -1]


def test_paths():
    assert (fn.path_parent("/a/b/"), fn.path_name("/a/b/"), fn.path_is_absolute("a")) == ("/a", "b", False)
    assert (fn.path_parent("/a"), fn.path_parent("a")) == ("/", "")
