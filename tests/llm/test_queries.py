"""The operators' queries over the smallest tables: against DuckDB where SQL has a form, else against the libraries or bounds."""

import glob
import os
import zlib

import duckdb
import numpy as np
import pytest

from millrace.llm import ppm_scores
from millrace.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    own = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        own.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return own


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda f: sorted(map(str, f[sorted(f.columns)].astype(object).where(f.notna(), None).map(lambda x: int(x) if isinstance(x, float) and x == int(x) else x).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_unigram_base_makes_no_byte_model(spark, monkeypatch):
    """Its columns don't need one, whose strings are most of op3's work."""
    names, written = [], ppm_scores.written
    monkeypatch.setattr(ppm_scores, "written", lambda df, name, *more: names.append(name) or written(df, name, *more))
    assert QUERIES["unigram_base"](spark, DATA).count() and names == ["ppm-chunks", "ppm-words"]


CONTRACT = {
    "op2_seekable_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op3_ppm_scores": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op4_quality_nbsvm": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_signature_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op7_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op8_pivot_index": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op9_toxicity_pu": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_piece_codec": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract(spark, con, name):
    df = QUERIES[name](spark, DATA)
    assert CONTRACT[name].items() <= dict(df.dtypes).items()
    rows = df.collect()
    if "doc_id" in df.columns:
        assert sorted(r.doc_id for r in rows) == sorted(x[0] for x in con.execute("select doc_id from documents").fetchall())
    if "held_out" in df.columns:
        k = 7 if name.startswith("op3") else 4
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % k == 2) for r in rows)


def test_recall(spark, con):
    got = {}
    for r in QUERIES["op8_pivot_index"](spark, DATA).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    table = con.execute("select vec_id, embedding from embeddings").fetchall()
    key, x = np.array([r[0] for r in table]), np.array([r[1] for r in table])
    hits = []
    for i in np.flatnonzero(key % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        want = key[np.lexsort([key, -s])[:20]]
        hits.append(len(set(want.tolist()) & {v for _, v in got[int(key[i])]}) / 20)
    assert np.mean(hits) >= 0.9 and len(got) == len(hits)
