"""What the operators share: tables in the shared folder, size-checked joins, packed arrays, components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import shared_folder

#: Rows up to which the small side of a join is broadcast (rows of a few dozen bytes); beyond it, a shuffle join.
BROADCAST_ROWS = 100_000
#: Rows of one key that a shuffle join leaves together.
HOT_ROWS = 20_000
#: Bytes that go to Python at once, and bytes of text that are worked on at once there, in the pipeline's stages: their tasks
#: share executors one after another, in which what is freed of large blocks of native memory stays with the threads that had them.
BATCH_BYTES, FEW_BYTES = 4 << 20, 1 << 18


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and a lost executor costs nothing that is written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20)  # what a writing task buffers
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.written_to = path
    return read


def dropped(*tables: DataFrame) -> None:
    """Remove written tables that nothing still to be run reads: what was made from them is written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def kept_beside(df: DataFrame, text: str, replaced: list[str]) -> tuple[DataFrame, list[str], str, list[T.StructField]]:
    """df's columns but those replaced, with the text as a string under a free name last: (rows, kept, that name, kept fields)."""
    own = free_name(df, "__text")
    kept = [c for c in df.columns if c not in replaced]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return df.select(*map(quoted, kept), quoted(text).cast("string").alias(own)), kept, own, [df.schema[c] for c in kept]


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """At most so many rows and, but for a single longer one, bytes go to Python at once: an executor holds a few batches of whole texts.

    A setting of the session: plans take it when they are run, so it stays as long as their results may be asked for.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        known = str(spark.conf.get(name)).lower().removesuffix("b")
        if not (known.isdigit() and 0 < int(known) <= most):
            spark.conf.set(name, str(most))


def give_back() -> None:
    """Return to the system what this process has freed: Spark keeps Python workers, and their allocators keep free memory, for later tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema), of which nothing stays in a worker when its task is over: an executor has several workers, and holds what their largest tasks left."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(whole, schema)


def small_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a written table: it is broadcast if its counted rows are few enough, else both sides are shuffled."""
    return big.join(F.broadcast(small) if small.count() <= most else small, on, how)


def _dealt(big: DataFrame, small: DataFrame, on: list[str], hot: DataFrame, how: str, by: list[str], broadcast: bool = True) -> DataFrame:
    """A shuffle join; rows of the keys in `hot` go to __salts partitions by a hash of the columns `by`, and small has a copy for each."""
    salt = F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.col("__salts"))).cast("int")
    left = big.join(F.broadcast(hot), on, "left").withColumn("__salt", salt).drop("__salts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))
    right = small.join(F.broadcast(hot), on, "left").withColumn("__salt", copies).drop("__salts")
    return left.join(right if broadcast else right.hint("merge"), [*on, "__salt"], how).drop("__salt")


def counted_join(big: DataFrame, small: DataFrame, on: list[str], count: str, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join (inner or left) with a written table that has a row per key and, as `count`, how many rows of big have the key.

    It is broadcast if it has `most` rows or fewer (0: never, so that the plan is the same at every size). Beyond that both are shuffled, and keys of many rows are dealt over several
    partitions. How many rows are many is such that there are fewer of these keys than may be broadcast, so no key is too
    hot and no list of keys too long, whatever the input.
    """
    rows, total = small.agg(F.count(F.lit(1)), F.sum(count)).first()
    if rows <= most:
        return big.join(F.broadcast(small.drop(count)), on, how)
    share = max(HOT_ROWS, -(-(total or 0) // BROADCAST_ROWS))
    hot = small.where(F.col(count) > share).select(*on, F.ceil(F.col(count) / share).cast("int").alias("__salts"))
    return _dealt(big, small.drop(count), on, hot, how, big.columns, most > 0)


def dealt_join(big: DataFrame, small: DataFrame, on: str, rows: DataFrame, how: str = "inner") -> DataFrame:
    """Shuffle join (inner or left) with a table that has a row per key, or few; keys of many rows are dealt over several partitions.

    rows: a written table of the columns that tell big's rows apart, the key among them.
    """
    total = rows.count()
    share = max(HOT_ROWS, -(-total // BROADCAST_ROWS))
    if total <= share:  # no key has more
        return big.join(small, on, how)
    counts = rows.groupBy(on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > share)
    hot = written(counts.select(on, F.ceil(F.col("__n") / share).cast("int").alias("__salts")), "hot-keys")
    return _dealt(big, small, [on], hot, how, rows.columns)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of any kinds and lengths as one compressed value."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), a.nbytes))], dtype="<i8")
    return zstandard.ZstdCompressor(level=3).compress(head.tobytes() + b"".join(a.tobytes() for a in arrays))


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 2 * n, 8), 8 + 16 * n, []
    for kind, size in head.reshape(-1, 2):
        dtype = np.dtype(chr(kind))
        out.append(np.frombuffer(raw, dtype, int(size) // dtype.itemsize, at))
        at += int(size)
    return out


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch with about `most` bytes of text, at least a row each: bounds what is held at once."""
    sizes = batch.column(column).cast(pa.binary()) if batch.num_rows else None
    if sizes is None:
        return
    lengths = pa.compute.fill_null(pa.compute.binary_length(sizes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(lengths) // most
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def for_training(doc_id: str = "doc_id") -> Column:
    """Whether labels of a document may be learnt from."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 != 2


def first_by_hash(ids: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """A fixed sample: the `most` rows whose keys have the smallest hashes, as a written table."""
    return written(ids.orderBy(F.xxhash64(key), key).limit(most), "sample")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), the component its smallest node.

    Each round, a node takes the smallest label among its neighbours' and then that label's own label (pointer
    jumping), until nothing changes: the rounds grow with the logarithm of the longest path. Nothing is collected; nodes
    with many neighbours, and labels of many nodes, are dealt over several partitions.
    """
    pairs = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    labels = written(pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), f"{name}-0")
    turn, last = 0, labels
    while True:
        turn += 1
        near = dealt_join(pairs, labels.withColumnRenamed("node", "b"), "b", pairs).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.a, "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("label"))
        half = written(step, f"{name}-{turn}a")
        up = half.select(F.col("node").alias("label"), F.col("label").alias("root"))
        step = written(dealt_join(half, up, "label", half, "left").select("node", "old", F.least("label", F.coalesce("root", "label")).alias("component")), f"{name}-{turn}b")
        dropped(half, last)
        if not step.where("old <> component").limit(1).count():
            dropped(pairs)
            return step.select("node", "component")
        labels, last = step.select("node", "component"), step
