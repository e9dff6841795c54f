"""Every query of the catalogue against its DuckDB form."""

import glob
import os

import duckdb
import pytest

from millrace import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    own = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        own.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return own


def rows(frame):
    own = frame[sorted(frame.columns)].map(lambda x: list(x) if hasattr(x, "__len__") and not isinstance(x, str) else x)
    return sorted(map(str, own.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name in catalogue.ORACLES:
        assert rows(got) == rows(con.execute(catalogue.ORACLES[name]).df())
    else:
        assert len(got)


def test_lines_of_odd_texts(spark, tmp_path):
    texts = ["", None, "\n", "\r", "\r\n", "\n\n", "a\r\r\nb", "a\n", "\na", "\x00\r", "é\r\n\u0085", " "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    own = duckdb.connect()
    own.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = catalogue.QUERIES["line_reader_crlf"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(own.execute(catalogue.ORACLES["line_reader_crlf"]).df()) and "" in set(got[got.doc_id == 0].line)


def test_cuts_of_more_keys_than_the_driver_holds(spark, tmp_path):
    people = spark.range(0, 120_000, 1, 4).selectExpr("id as c_custkey", "concat('Customer#', id * 7919 % 100003) as c_name")
    people.write.parquet(str(tmp_path / "customer.parquet"))
    own = duckdb.connect()
    own.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    assert rows(catalogue.QUERIES["sampled_cuts"](spark, str(tmp_path)).toPandas()) == rows(own.execute(catalogue.ORACLES["sampled_cuts"]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
