"""Schemas of key/value records.

Keys and values are text or binary columns; the default binary collation orders and compares them as unsigned bytes.
"""

from __future__ import annotations

from pyspark.sql import types as T

TEXT_KV = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
BINARY_KV = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())])
#: Spark's type for each of the record types that a job may declare (fixed values).
RECORD_TYPES = {
    "text": T.StringType(), "bytes": T.BinaryType(), "byte": T.ByteType(), "bool": T.BooleanType(), "int": T.IntegerType(),
    "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "md5": T.BinaryType(), "unknown": T.BinaryType(),
}


def kv_schema(key: str = "text", value: str = "text") -> T.StructType:
    """The schema of records of two declared types."""
    return T.StructType([T.StructField(name, RECORD_TYPES[kind]) for name, kind in (("key", key), ("value", value))])
