"""Record writers: (key, value) records as text files, and the lines that they are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codecs that output may be compressed with (fixed values); any other name is an error.
CODECS = ("none", "gzip", "snappy", "lz4", "bzip2", "deflate")


def kv_line(key: Column, value: Column, separator: str = "\t") -> Column:
    """key, separator and value if neither is empty, else the one that isn't; null counts as empty."""
    key, value = (F.coalesce(x.cast("string"), F.lit("")) for x in (key, value))
    return F.when((key != "") & (value != ""), F.concat(key, F.lit(separator), value)).when(value == "", key).otherwise(value)


def text_int_line(key: Column, value: Column, separator: str = "\t") -> Column:
    """key, separator and a decimal number; the separator is always there."""
    return F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(separator), value.cast("bigint").cast("string"))


def tera_line(key: Column, value: Column) -> Column:
    return F.concat(key.cast("binary"), value.cast("binary")).cast("string")


def _write(df: DataFrame, line: Column, path: str, compression: str | None, line_end: str, mode: str) -> None:
    if (compression := compression or "none") not in CODECS:
        raise ValueError(f"unknown codec {compression!r}; known: {', '.join(CODECS)}")
    df.select(line.alias("value")).write.mode(mode).option("compression", compression).option("lineSep", line_end).text(path)


def write_kv(df: DataFrame, path: str, separator: str = "\t", compression: str | None = None, mode: str = "errorifexists") -> None:
    _write(df, kv_line(F.col("key"), F.col("value"), separator), path, compression, "\n", mode)


def write_text_int(df: DataFrame, path: str, separator: str = "\t", compression: str | None = None, mode: str = "errorifexists") -> None:
    _write(df, text_int_line(F.col("key"), F.col("value"), separator), path, compression, "\n", mode)


def write_tera(df: DataFrame, path: str, compression: str | None = None, mode: str = "errorifexists") -> None:
    """key and value as they are, each record ended by CR and LF."""
    _write(df, tera_line(F.col("key"), F.col("value")), path, compression, "\r\n", mode)


def write_raw(df: DataFrame, path: str, compression: str | None = None, mode: str = "errorifexists") -> None:
    """The values' bytes one after another, with nothing between or behind them; a file for each partition."""
    from millrace.sources.datasource import STREAM_CODECS, RawSource

    if (compression := compression or "none") not in STREAM_CODECS:
        raise ValueError(f"unknown codec {compression!r} of raw output; known: {', '.join(STREAM_CODECS)}")
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    if there and mode == "ignore":
        return
    if there and mode not in ("append", "overwrite"):
        raise FileExistsError(path)
    spark.dataSource.register(RawSource)
    values = df.select(F.coalesce(F.col("value").cast("string"), F.lit("")).cast("binary").alias("value"))
    values.write.format("raw_bytes").mode("overwrite" if mode == "overwrite" else "append").option("compression", compression).option("path", path).save()


def write_frame(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", **options: str) -> None:  # noqa: A002
    """Records through any of Spark's own writers."""
    df.write.format(format).mode(mode).options(**options).save(path)
