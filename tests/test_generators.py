import numpy as np
import pytest

from millrace.sources import generators as g

GOLDEN = ["2e745e235c7c7624325c", "3735407e3f2757645546", "775b6f7c7c3a4e26482c"]


def test_rows(spark):
    rows = g.teragen(spark, 1000, 7).orderBy("row").collect()
    assert [bytes(r.key).hex() for r in rows[:3]] == GOLDEN
    assert bytes(rows[1].value) == b"         1" + b"".join(bytes([65 + k]) * 10 for k in range(8, 15)) + b"P" * 8
    assert {len(r.key) + len(r.value) for r in rows} == {98} and len(rows) == 1000


def test_states_equal_the_recurrence():
    state, want = 0, []
    for _ in range(200):
        want.append(state)
        for _ in range(g.STEPS):
            state = (state * g.MULTIPLIER + g.INCREMENT) % 2**32
    assert g.states(np.arange(200)).tolist() == want


def test_java_random():
    r = g.JavaRandom(42)
    assert [r.next_int() for _ in range(3)] == [-1170105035, 234785527, -1360544799]
    r = g.JavaRandom(42)
    assert [r.next_int(10) for _ in range(5)] == [0, 3, 8, 4, 0]
    assert all(0 <= r.log_uniform(1000) < 1000 for _ in range(100))


@pytest.mark.parametrize("kind", ["word", "number", "bytes"])
def test_random_records(spark, kind):
    a, b = (g.random_records(spark, 200, kind, seed=s).collect() for s in (1, 1))
    assert a == b and a != g.random_records(spark, 200, kind, seed=2).collect()


def test_unknown_kind(spark):
    with pytest.raises(ValueError, match="unknown kind"):
        g.random_records(spark, 1, "x")


def test_dictionary():
    words = g.dictionary(1000)
    assert len(set(words)) == 1000 and words == g.dictionary(1000) != g.dictionary(1000, 1)
    assert all(4 <= len(w) <= 12 and w.isalpha() for w in words) and g.dictionary(10) == words[:10]


def test_data_source(spark, tmp_path):
    from millrace.sources.datasource import TeraSource

    spark.dataSource.register(TeraSource)
    df = spark.read.format("tera").option("rows", 25_001).option("splits", 4).load()
    assert df.rdd.getNumPartitions() == 4
    assert df.exceptAll(g.teragen(spark, 25_001).select("key", "value")).count() == 0 and df.count() == 25_001
    df.write.format("tera").mode("append").save(str(tmp_path / "out"))
    written = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").iterdir()))
    assert written.count(b"\r\n") == 25_001 and len(written) == 25_001 * 100
    df.limit(10).write.format("tera").mode("append").save(str(tmp_path / "out"))
    for _ in range(2):
        df.limit(100).write.format("tera").mode("overwrite").save(f"file://{tmp_path}/out")
    kept = [p for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")]
    assert sum(len(p.read_bytes()) for p in kept) == 100 * 100 and not any(p.is_dir() for p in kept)
