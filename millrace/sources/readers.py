"""Record readers: files or DataFrames as (key, value) records.

Lines end at a line feed, and one carriage return before it goes; a lone carriage return is data. (Of an unterminated
last line a trailing carriage return goes too, which the text source can't tell.) Files with the suffixes .gz, .snappy,
.lz4, .bz2 and .deflate are decompressed. Several paths are read one after another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Paths = str | list[str]


def _chomped(col: Column) -> Column:
    return F.when(F.endswith(col, F.lit("\r")), F.left(col, F.length(col) - 1)).otherwise(col)


def _raw(spark: SparkSession, paths: Paths) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(paths)


def split_lines(col: Column) -> Column:
    """The lines of a text column, as the line reader has those of a file."""
    parts = F.split(col, "\n", -1)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(whole, _chomped)


def first_split(line: Column, separator: str = "\t") -> tuple[Column, Column]:
    """A line at its first separator: without one the line is the key, and the value is empty."""
    sep = F.lit(separator[0])
    at = F.instr(line, sep)
    return F.when(at > 0, F.substring(line, F.lit(1), at - 1)).otherwise(line), F.when(at > 0, F.substring(line, at + 1, F.length(line))).otherwise(F.lit(""))


def lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """An empty key, and the line as value."""
    return _raw(spark, paths).select(F.lit("").alias("key"), _chomped(F.col("value")).alias("value"))


def key_value_lines(spark: SparkSession, paths: Paths, separator: str = "\t") -> DataFrame:
    """Lines split at the first separator; of a longer separator the first character counts."""
    key, value = first_split(_chomped(F.col("value")), separator)
    return _raw(spark, paths).select(key.alias("key"), value.alias("value"))


def fixed_prefix(line: Column, size: int = 10) -> tuple[Column, Column]:
    """The first bytes of a line, size at most, and the rest, both binary."""
    raw = line.cast("binary")
    return F.substring(raw, F.lit(1), F.lit(size)), F.substring(raw, F.lit(size + 1), F.greatest(F.octet_length(raw) - size, F.lit(0)))


def tera_lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """Binary records: the first ten bytes of a line, and the rest."""
    key, value = fixed_prefix(_chomped(F.col("value")))
    return _raw(spark, paths).select(key.alias("key"), value.alias("value"))


def raw_lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """An empty key, and the line with its line feed as value: what external commands are fed."""
    return _raw(spark, paths).select(F.lit("").alias("key"), F.concat("value", F.lit("\n")).alias("value"))


def from_dataframe(df: DataFrame, key: Column | str, value: Column | str) -> DataFrame:
    """Any DataFrame as records: two of its columns or expressions."""
    of = lambda x: F.col(x) if isinstance(x, str) else x
    return df.select(of(key).alias("key"), of(value).alias("value"))


def sequence_file(spark: SparkSession, path: str, schema="key string, value string") -> DataFrame:  # noqa: ANN001
    """The records of a Hadoop sequence file, by its own converters."""
    return spark.createDataFrame(spark.sparkContext.sequenceFile(path), schema)
