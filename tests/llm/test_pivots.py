import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import pivot_index

NAN = float("nan")


def brute(key, x, k):
    out = {}
    for i in np.flatnonzero(key % 20 == 0):
        s = x @ x[i]
        others = np.flatnonzero(key != key[i])
        out[int(key[i])] = [int(v) for v in key[others[np.lexsort([key[others], -s[others]])][:k]]]
    return out


def vectors(spark, key, x, extra=()):
    rows = [(int(k), [float(c) for c in v], 0, 1, 2) for k, v in zip(key, x, strict=True)] + [(*r, 0, 1, 2) for r in extra]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank int, shard int")


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_over_several_shards(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((6000, 24)).astype(np.float32)
    key = np.arange(6000)
    got = found(pivot_index.nearest(vectors(spark, key, x), F.col("vec_id") % 20 == 0, share=0.15, least=15, shard_rows=2000))
    want = brute(key, x.astype(float), 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


@pytest.mark.parametrize(("kind", "n"), [("lengths vary", 40_000), ("normal", 40_000), ("clusters", 40_000), ("lengths vary", 2_000), ("normal", 2_000)])
def test_recall_at_shipped_constants(spark, kind, n):
    """Several shards or one, a part of each ranked again."""
    rng = np.random.default_rng(3)
    size = 64
    x = rng.standard_normal((n, size))
    if kind == "lengths vary":
        x *= np.exp(0.5 * rng.standard_normal((n, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    elif kind == "clusters":
        x = rng.standard_normal((100, size))[rng.integers(0, 100, n)] + 0.4 * x
    x = x.astype(np.float32)
    key = np.arange(n)
    table = pa.table({"vec_id": key, "embedding": pa.array(list(x), pa.list_(pa.float32()))})
    df = spark.createDataFrame(table)
    got = found(pivot_index.nearest(df, F.col("vec_id") % (n // 100) == 0))
    hits = []
    for i in key[key % (n // 100) == 0]:
        s = x.astype(float) @ x[i].astype(float)
        s[i] = -np.inf
        hits.append(len(set(np.argsort(-s, kind="stable")[:20].tolist()) & set(got[int(i)])) / 20)
    assert np.mean(hits) >= 0.9 and min(hits) >= 0.6, (kind, np.mean(hits), min(hits))


def test_queries_are_of_the_table(spark):
    """A predicate of any column, also of one named as a column of the index, and of a row whose key occurs again."""
    x = np.random.default_rng(5).standard_normal((50, 6)).astype(np.float32)
    df = vectors(spark, np.arange(50), x).withColumn("shard", F.col("vec_id") % 10).withColumn("other", F.col("vec_id") * 2)
    for queries in (F.col("shard") == 3, F.col("other").isin(6, 26, 46, 66, 86)):
        assert set(found(pivot_index.nearest(df, queries))) == {3, 13, 23, 33, 43}
    assert set(found(pivot_index.nearest(df, F.when(F.col("vec_id") == 3, True)))) == {3}


def test_few_rows_ties_and_bad_vectors(spark):
    """Exact where all candidates are ranked again: ties go to the smaller id; unusable vectors take no part."""
    rng = np.random.default_rng(2)
    x = np.repeat(rng.standard_normal((10, 8)).astype(np.float32), 6, axis=0)
    key = np.arange(60)
    bad = [(100, None), (120, [0.0] * 8), (140, [NAN] + [1.0] * 7), (160, [None] + [1.0] * 7), (180, [float("inf")] * 8), (200, []), (220, [1.0] * 3), (None, [1.0] * 8)]
    df = vectors(spark, key, x, bad)
    assert found(pivot_index.nearest(df, F.col("vec_id") % 20 == 0)) == brute(key, x.astype(float), 20)
    assert found(pivot_index.nearest(df.union(df), F.col("vec_id") % 20 == 0)) == brute(key, x.astype(float), 20)


def test_scores_are_inner_products(spark):
    x = np.array([[3, 4], [1, 0], [0, 2]], np.float32)
    rows = pivot_index.nearest(vectors(spark, np.array([0, 1, 2]), x), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in rows] == [(2, 8.0), (1, 3.0)]


def test_none(spark):
    df = vectors(spark, np.zeros(0), np.zeros((0, 2)))
    assert pivot_index.nearest(df, F.lit(True)).count() == 0
    assert pivot_index.nearest(vectors(spark, np.array([0]), np.ones((1, 2))), F.lit(True)).count() == 0


def test_many_equal_vectors(spark):
    """The smaller ids among more equal vectors than a shard ranks again."""
    x = np.ones((3000, 4), np.float32)
    got = found(pivot_index.nearest(vectors(spark, np.arange(3000), x), F.col("vec_id") == 40, least=3, share=0.01, shard_rows=1000))
    assert got == {40: list(range(20))}
