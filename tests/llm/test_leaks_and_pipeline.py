import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import ODD, words

import corpus_pipeline
from millrace.llm import latent_leaks as leaks
from millrace.llm import piece_codec, quality_nbsvm, signature_join, suffix_dedup


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_subsequences(rnd):
    for _ in range(200):
        a, b = (np.array([rnd.randrange(8) for _ in range(rnd.randrange(1, 30))]) for _ in "ab")
        length, found = leaks.subsequence(a, b)
        assert length == leaks.common_length(a, b) == lcs(a.tolist(), b.tolist()) == found.sum()
        assert lcs(a[found].tolist(), b.tolist()) == length
    assert leaks.subsequence(a, b[:0])[0] == leaks.common_length(a, b[:0]) == 0


def items_of(rnd, n=40):
    return [" ".join(f"q{rnd.randrange(900)}" if rnd.random() < 0.7 else f"c{rnd.randrange(5)}" for _ in range(rnd.randrange(15, 60))) for _ in range(n)]


def background(rnd, n):
    return [f"c{rnd.randrange(5)}" if rnd.random() < 0.4 else f"q{rnd.randrange(900)}" if rnd.random() < 0.1 else f"z{rnd.randrange(5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def planted():
    rnd = random.Random(8)
    items = items_of(rnd)
    docs, want = [], set()
    for k in range(150):
        own = background(rnd, rnd.randrange(0, 400))
        if k % 3 == 0:
            i = rnd.randrange(len(items))
            w = items[i].split()
            if k % 2:  # a paraphrase: some words changed, with other signs and case
                w = [f"z{rnd.randrange(5000)}" if rnd.random() < 0.12 else x.upper() + "," for x in w]
            at = rnd.randrange(len(own) + 1)
            own[at:at] = w
            want.add((k, i))
        docs.append(" ".join(own))
    return items, docs, want


@pytest.mark.parametrize("block", [leaks.ITEMS, 15])
def test_planted_leaks(spark, docs_of, planted, monkeypatch, block):
    """Also in blocks of 15 items, two of which share a reading of the documents."""
    monkeypatch.setattr(leaks, "ITEMS", block)
    monkeypatch.setattr(leaks, "AT_ONCE", 2)
    items, docs, want = planted
    bench = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(items)] + [(None, items[0], 1, "x"), (900, None, 1, "x"), (901, "", 1, "x"), (902, "!!", 1, "x")], "item_id long, text string, doc_id int, blob string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(docs_of(docs + ODD), bench).collect()}
    assert len(want - got) <= 1 and not got - want


def test_leaks_held_often(spark, docs_of, rnd):
    """A third of the rows hold one item, a few the others, one of them of common words alone."""
    items = [*items_of(rnd, 12), " ".join(f"c{rnd.randrange(5)}" for _ in range(24))]
    docs, want = [], set()
    for k in range(900):
        own = [f"z{rnd.randrange(5000)}" for _ in range(rnd.randrange(60, 200))]
        i = 0 if k % 3 == 0 else 1 + k // 3 % 12 if k % 30 == 1 else None
        if i is not None:
            w = items[i].split()
            if k % 2 and i < 12:
                w = [f"z{rnd.randrange(5000)}" if rnd.random() < 0.08 else x for x in w]
            at = rnd.randrange(len(own) + 1)
            own[at:at] = w
            want.add((k, i))
        docs.append(" ".join(own))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(docs_of(docs), bench).collect()} == want


def test_an_item_of_common_words(spark):
    """A verbatim copy of an item of which every word is common, and a changed one, in one document each."""
    rnd = random.Random(3)
    some = [f"v{k}" for k in range(300)]
    item = [rnd.choice(some) for _ in range(40)]
    docs = [[rnd.choice(some) for _ in range(200)] for _ in range(200)]
    docs[17][50:50] = item
    changed = [rnd.choice(some) if k in (4, 11, 19, 26, 30) else w for k, w in enumerate(item)]
    docs[31][90:90] = changed
    bench = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    got = leaks.leaks(spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string"), bench)
    assert {r.doc_id for r in got.collect()} == {17, 31}


def every_pair(docs, items):
    """Documents and items of which any passage's neighbourhood is judged a leak."""
    out = set()
    bench = leaks.Benchmark(list(range(len(items))), [t.encode() for t in items])
    for d, text in enumerate(docs):
        counts, at, term = leaks.places([(text or "").encode()], bench.terms)
        for first in range(0, max(1, int(counts[0])), leaks.HALF):
            for k, item in enumerate(bench.items):
                x, z = np.searchsorted(at, (max(0, first - len(item)), min(int(counts[0]), first + 2 * leaks.HALF + len(item))))
                if len(item) and leaks.judged(item, term[x:z])[2]:
                    out.add((d, k))
    return out


def test_against_every_pair(spark, docs_of, planted):
    """All pairs by their longest common subsequence, without a search."""
    items, docs, want = planted
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(docs_of(docs + ODD), bench).collect()}
    every = every_pair(docs + ODD, items)
    assert got <= every and want <= every and len(got) >= 0.97 * len(every)


def test_many_items(spark, docs_of, rnd, monkeypatch):
    """A block of over 400 pieces is searched as well as one of few: the basis keeps each piece's length."""
    items = [" ".join(f"q{rnd.randrange(4000)}" for _ in range(rnd.randrange(15, 60))) for _ in range(300)]
    docs = []
    for text in items:
        own = [f"q{rnd.randrange(4000)}" for _ in range(rnd.randrange(60, 200))]
        at = rnd.randrange(len(own) + 1)
        own[at:at] = text.split()
        docs.append(" ".join(own))
    kept, of = [], leaks._basis

    def basis(table, bench, weight, own):
        out = of(table, bench, weight, own)
        kept.append(np.linalg.norm(bench.vectors(weight) @ out, axis=1))
        return out

    monkeypatch.setattr(leaks, "_basis", basis)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(docs_of(docs), bench).collect()}
    assert len(kept) == 1 and len(kept[0]) > 400 and kept[0].min() > 0.99
    assert got == {(k, k) for k in range(300)}


def test_no_tables(spark, docs_of, nothing, planted):
    bench = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, planted[0][0])], "item_id long, text string")
    assert leaks.leaks(docs_of(planted[1]), bench).count() == 0 == leaks.leaks(nothing, one).count()
    assert leaks.leaks(docs_of([planted[0][0]]), one).count() == 1


def test_pieces_stand_whole_in_a_passage():
    bench = leaks.Benchmark([1, 2, 3], [b"a b c", b" ".join(b"w%d" % k for k in range(75)), b""])
    assert [k for k, _ in bench.pieces] == [0, 1, 1, 1]
    assert {t for k, p in bench.pieces if k == 1 for t in p.tolist()} == set(bench.items[1].tolist())


@pytest.fixture(scope="module")
def corpus(spark):
    """Good texts, junk, near copies, a repeated passage, leaks; labels for half."""
    rnd = random.Random(12)
    passage = words(rnd, 70, 3000)
    items = items_of(rnd, 8)
    kinds, texts = [], []
    for k in range(260):
        own = [f"t{rnd.randrange(6000)}" for _ in range(rnd.randrange(60, 140))]
        kind = ["good", "good", "junk", "copy", "passage", "leak"][k % 6]
        if kind == "junk":
            own = [w.upper() + "!!" for w in own]
        elif kind == "copy" and texts:
            own = texts[k - 3].split()
            own[rnd.randrange(len(own))] = "changed"
        elif kind == "passage":
            own[10:10] = passage
        elif kind == "leak":
            own[20:20] = items[k % 8].split()
        kinds.append(kind)
        texts.append(" ".join(own))
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)] + [(1000, None, None, None, None), (1001, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = corpus_folder(spark, docs, [(k, int(kind != "junk"), 0) for k, kind in enumerate(kinds) if k % 2 == 0 or kind == "junk"], items)
    return kinds, texts, docs, folder


def corpus_folder(spark, docs, labels, items):
    import tempfile

    folder = tempfile.mkdtemp()
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, corpus):
    """Each stage on what the one before it kept, against what was planted and plain Python."""
    from tests.llm.test_duplicates import brute_components, brute_passages

    kinds, texts, docs, folder = corpus
    kept, columns = docs, docs.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = stage(spark, kept, folder).cache()
        assert kept.columns == columns and kept.schema["n_chars"] == docs.schema["n_chars"]
        after = {r.doc_id: r.text for r in kept.collect()}
        if name == "quality":
            assert sum(kinds[k] == "junk" for k in after if k < 1000) <= 1 and sum(kinds[k] != "junk" for k in before if k < 1000 and k not in after) <= 1
        elif name == "near_duplicates":
            want = brute_components(before)
            assert set(after) == {c for _, c in want.values()}
        elif name == "repeated_passages":
            _, cuts = brute_passages(before, 50)
            assert set(after) == set(before) and len(cuts) > 20
            for k, t in before.items():
                assert (after[k] or "").split() == [w for i, w in enumerate((t or "").split()) if i not in cuts.get(k, ())]
        else:
            items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert set(before) - set(after) == {k for k, t in before.items() if any(i in (t or "") for i in items)}
            assert len(after) < len(before)
    last = corpus_pipeline.STAGES[4][1](spark, kept, folder)
    assert ids(last) == ids(kept) and {"n_tokens", "ids_sha256", "decoded_sha256"} <= set(last.columns)
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == ids(kept)


def test_one_doc_id_on_several_texts(spark, corpus):
    """No stage fails on rows of one doc_id; passages are cut from each text by its own words."""
    _, texts, docs, folder = corpus
    more = spark.createDataFrame([(4, " ".join(["lone", *texts[10].split()[:90], *texts[4].split()[5:]]), "en", "s", 1), (4, texts[4], "en", "s", 1), (5, None, "en", "s", 1), (4, "short", "en", "s", 1)], docs.schema)
    both = docs.unionByName(more)
    cut = corpus_pipeline.repeated_passages(spark, both, folder)
    assert cut.count() == both.count() and cut.where("doc_id = 4 and text = 'short'").count() == 1
    kept = both
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, folder).cache()
        assert kept.count() > 0
    assert {r.doc_id for r in kept.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_call_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "benchmark_leaks", "tokens"]
    assert signature_join and suffix_dedup and piece_codec


def test_empty_corpus(spark, tmp_path, corpus):
    docs = corpus[2].limit(0)
    folder = corpus_folder(spark, docs, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_clashing_columns(spark, corpus):
    _, _, docs, folder = corpus
    more = docs.withColumns({c: F.lit(1) for c in ("__score", "score", "component", "__cuts", "ids", "__text")})
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, more, folder).columns == more.columns
    assert corpus_pipeline.STAGES[4][1](spark, more, folder).count() == docs.count()


def test_workers_give_memory_back(spark):
    """Texts that are learnt from take hundreds of megabytes of the workers that read them and fit the model, which Spark keeps for the next stages."""

    def probe(batches):
        import re
        from pathlib import Path

        import pyarrow as pa

        for batch in batches:
            held = sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024
            yield pa.RecordBatch.from_arrays([pa.array([float(held)])], names=["mb"])

    def largest():
        return spark.range(0, 64, 1, 64).mapInArrow(probe, "mb double").agg(F.max("mb")).first()[0]

    text = "array_join(transform(sequence(1, 400), x -> concat('w', pmod(xxhash64(id, x), 20000))), ' ') as text"
    docs = spark.range(0, 12_000, 1, 1).selectExpr("id as doc_id", text)
    labels = spark.range(12_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    before = largest()
    quality_nbsvm.train(docs, labels)
    assert largest() - before < 60


def test_no_workers_but_those_of_arrow(spark, docs_of, planted):
    """The leaks' table holds no rows that come from the driver by Python, which takes another daemon in each executor."""
    bench = spark.createDataFrame([], "item_id long, text string")
    found = leaks.leaks(docs_of(planted[1]), bench)
    assert "LogicalRDD" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.schema.simpleString() == spark.createDataFrame([], leaks.SCHEMA).schema.simpleString()
