import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import ODD, words

from millrace.llm import ppm_scores as ppm
from millrace.llm._text import Words


def normal_text(text):
    return b" ".join((text or "").encode().lower().split()) + b"\n"


def trained(texts, order):
    trie = {}
    for text in texts:
        before = b"\n" * order
        for byte in normal_text(text):
            for o in range(order + 1):
                seen = trie.setdefault(before[len(before) - o :], {})
                seen[byte] = seen.get(byte, 0) + 1
            before = (before + bytes([byte]))[-order:]
    return trie


def code_length(trie, text, order):
    total, before = 0.0, b"\n" * order
    for byte in normal_text(text):
        total += ppm.next_byte(trie, before, byte, order)
        before = (before + bytes([byte]))[-order:]
    return total


def test_normal_texts():
    texts = [x or "" for x in ODD] + ["A  b", ""]
    norm, begin = ppm.normal(Words([t.encode() for t in texts]))
    assert norm.tobytes() == b"".join(map(normal_text, texts))
    assert [norm[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)] == [normal_text(t) for t in texts]


@pytest.mark.parametrize("order", [2, 5])
def test_probabilities_equal_the_definition(rnd, order):
    texts = [" ".join(words(rnd, 60, 30)) for _ in range(12)] + ["", "zz", "é"]
    other = ["zq w1x1 w2x2 unseen", " ".join(words(rnd, 30, 60)), "日 w3x", ""]
    trie = trained(texts, order)
    code = lambda x: ppm.strings(np.frombuffer(b"".join(map(normal_text, x)), np.uint8), order)
    learnt = Counter(code(texts).tolist())
    value = np.unique(np.concatenate([code(texts), code(other)]))
    count = np.array([learnt[v] for v in value.tolist()], float)
    one = np.zeros((256, 256))
    np.add.at(one, ((value >> np.uint64(8 * order)).astype(int), (value & np.uint64(255)).astype(int)), count)
    u = np.uint64
    pair = ((value >> u(8 * (order - 1))) << u(8)) | (value & u(255))
    two, at = np.unique(pair, return_inverse=True)
    of_two = np.bincount(at, count, len(two))
    got = ppm.log_probabilities(value, count, (two, of_two), one, order)
    three = value >> u(8 * max(1, order - 2))
    for shared in np.unique(three):  # a group of strings alone, with the rows of their last two bytes
        own = three == shared
        rows = np.isin(two >> u(8), pair[own] >> u(8))
        assert np.array_equal(ppm.log_probabilities(value[own], count[own], (two[rows], of_two[rows]), one, order), got[own])
    for text in texts[:3] + other:
        own = code([text])
        assert got[np.searchsorted(value, own)].sum() == pytest.approx(code_length(trie, text, order), abs=1e-9)


def test_a_context_s_probabilities_sum_to_one(rnd):
    trie = trained([" ".join(words(rnd, 80, 20))], 3)
    for before in (b"\n\n\n", b"w1x", b"qqq", b" w1"):
        total = sum(10 ** ppm.next_byte(trie, before, b, 3) for b in range(256))
        assert total <= 1 + 1e-9  # escapes with nothing left to escape to lose a share


def test_query(spark, docs_of, rnd, monkeypatch):
    texts = ODD + [" ".join(words(rnd, rnd.randrange(5, 80), 60)) for _ in range(150)]
    texts += texts[20:25]
    df = docs_of(texts).union(docs_of(["lost w1x1"]).withColumn("doc_id", F.lit(None).cast("long")))
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = {r.doc_id: r for r in ppm.scores(df, ~held).collect()}
    assert len(got) == len(texts) + 1
    train = [t for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 7 != 2]
    count = Counter(w for t in train for w in [*normal_text(t).split(), "end"])
    n, v = sum(count.values()), len(count)
    trie = trained(train, ppm.ORDER)
    for k, t in [*enumerate(texts), (None, "lost w1x1")]:
        own = [*normal_text(t).split(), "end"]
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (len(own), sum(count[w] > 0 for w in own), n)
        assert got[k].base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        if 0 <= (k or -1) - (len(texts) - 5):  # copies of texts 20 to 24
            assert (got[k].base_score, got[k].score) == (got[k - len(texts) + 25].base_score, got[k - len(texts) + 25].score)
        if len(t or "") < 3000:
            assert got[k].score == pytest.approx(code_length(trie, t, ppm.ORDER), rel=1e-4, abs=1e-4)


def test_base_scores_without_the_byte_model(spark, docs_of, rnd, nothing):
    df = docs_of(ODD + [" ".join(words(rnd, rnd.randrange(90), 60)) for _ in range(60)]).union(docs_of(["lost w1x1"]).withColumn("doc_id", F.lit(None).cast("long")))
    train = F.col("doc_id") % 3 != 1
    whole, base = ppm.scores(df, train), ppm.base_scores(df, train)
    assert base.columns == whole.columns[:-1] and base.dtypes == whole.dtypes[:-1]
    assert sorted(map(str, base.collect())) == sorted(map(str, whole.drop("score").collect()))
    assert ppm.base_scores(nothing, F.lit(True)).count() == 0


def test_many_chunks_and_none(spark, docs_of, rnd, nothing, monkeypatch):
    assert ppm.scores(nothing, F.lit(True)).count() == 0
    texts = [" ".join(words(rnd, 50)) for _ in range(60)]
    whole = {r.doc_id: r for r in ppm.scores(docs_of(texts).coalesce(1), F.lit(True)).collect()}
    split = {r.doc_id: r for r in ppm.scores(docs_of(texts).repartition(9), F.lit(True)).collect()}
    for k in whole:
        assert whole[k].base_score == pytest.approx(split[k].base_score) and whole[k].score == pytest.approx(split[k].score, rel=1e-6)
    untaught = ppm.scores(docs_of(["ab"]), F.lit(False)).first()
    assert (untaught.n_known, untaught.train_tokens) == (0, 0) and untaught.score == pytest.approx(-3 * math.log10(256), rel=1e-6)


def test_adaptive_scores(spark, docs_of, rnd, nothing):
    texts = ODD[:13] + [" ".join(words(rnd, 50)) for _ in range(5)]
    got = {r.doc_id: r.score for r in ppm.adaptive_scores(docs_of(texts)).collect()}
    assert got == {k: ppm.adaptive_code_length((t or "").encode()) for k, t in enumerate(texts)}
    assert ppm.adaptive_scores(nothing).count() == 0


def test_equal_texts_have_equal_sums(rnd):
    own = np.random.default_rng(3).standard_normal(700)
    values = np.concatenate([np.random.default_rng(4).standard_normal(991), own, own[:0], own])
    assert len(set(ppm._sums(values, np.array([991, 1691, 1691, 2391])).tolist())) == 2


def test_adaptive_code_length(rnd):
    text = " ".join(words(rnd, 40, 10)).encode()
    twice = ppm.adaptive_code_length(text + b" " + text)
    assert ppm.adaptive_code_length(text) > twice > 1.8 * ppm.adaptive_code_length(text)
    assert ppm.adaptive_code_length(b"") == pytest.approx(-math.log10(256))
