"""The signature join and the suffix arrays against brute force."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import ODD, words

from millrace.llm import signature_join as join
from millrace.llm import suffix_dedup as suffix
from millrace.llm._shared import components
from millrace.llm._text import Words


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_components(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(texts, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {k: (len(sets[k]), find(k)) for k in texts}


def edited(rnd, own, share):
    return [f"e{rnd.randrange(10**6)}" if rnd.random() < share else w for w in own]


def family(rnd, n, size, share):
    base = words(rnd, size, 10_000)
    return [" ".join(edited(rnd, base, share)) for _ in range(n)]


@pytest.mark.parametrize("leaf", [3, join.LEAF])
def test_join_equals_brute_force(spark, docs_of, rnd, monkeypatch, leaf):
    monkeypatch.setattr(join, "LEAF", leaf)
    monkeypatch.setattr(join, "FREQUENT", 4)
    texts = list(ODD)
    for n, size, share in ((25, 60, 0.02), (25, 200, 0.015), (12, 40, 0.03), (20, 120, 0.025), (5, 8, 0.05)):
        texts += family(rnd, n, size, share)
    passage = " ".join(words(rnd, 60))  # shared by texts that are otherwise unlike
    texts += [" ".join(words(rnd, rnd.randrange(5, 80))) + " " + passage + " " + " ".join(words(rnd, 20)) for _ in range(30)]
    texts += [texts[30].upper(), "  " + texts[31].replace(" ", "\n "), texts[40], texts[40]]
    rnd.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component) for r in join.linked(docs_of(texts)).collect()}
    want = brute_components(dict(enumerate(texts)))
    assert got == want
    assert len({c for _, c in want.values()}) < len(texts) - 50


def test_join_at_the_threshold(spark, docs_of):
    """Exactly 0.8 links, and a chain of links is a component."""
    w = [f"w{k}" for k in range(40)]
    a, b = " ".join(w[:13]), " ".join(w[1:14])  # 9 shingles each, 8 shared of 10
    c = " ".join([*w[:12], "x"])
    d = " ".join(w[2:15])
    got = {r.doc_id: r.component for r in join.linked(docs_of([a, b, c, d])).collect()}
    assert got == {k: c for k, (_, c) in brute_components(dict(enumerate([a, b, c, d]))).items()} and got[0] == got[1] == got[3]


def test_join_odd_rows(spark, docs_of, nothing):
    assert join.linked(nothing).count() == 0
    df = docs_of(["a b c", "a b c", None, ""]).union(docs_of(["a b c"]).withColumn("doc_id", F.lit(None).cast("long"))).union(docs_of(["a b c"]))
    got = sorted(((r.doc_id, r.n_shingles, r.component) for r in join.linked(df).collect()), key=str)
    assert got == sorted([(0, 1, 0), (0, 1, 0), (1, 1, 0), (2, 0, 2), (3, 0, 3), (None, 1, None)], key=str)


def test_join_one_key_on_several_texts(spark, rnd):
    """One text of the key counts, for all its rows."""
    base = words(rnd, 60)
    texts = [(1, " ".join(base)), (7, " ".join([*base[:-1], "x"])), (7, " ".join(words(rnd, 30))), (9, " ".join(words(rnd, 40)))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    counts = df.select("text", F.xxhash64("text").alias("tag")).where("doc_id = 7").orderBy("tag").first()
    got = sorted((r.doc_id, r.n_shingles, r.component) for r in join.linked(df).collect())
    own = (7, len(shingles(counts.text)), 1 if counts.text == texts[1][1] else 7)
    assert got == sorted([(1, 56, 1), own, own, (9, 36, 9)])


@pytest.mark.parametrize("hot", [3, 10**6])
def test_join_with_hot_keys(spark, docs_of, rnd, monkeypatch, hot):
    """A third of all rows are copies, another third near copies; the hot keys of every join are dealt over partitions."""
    from millrace.llm import _shared

    for name, value in (("HOT_ROWS", hot), ("BROADCAST_ROWS", 5)):
        monkeypatch.setattr(_shared, name, value)
    monkeypatch.setattr(_shared.counted_join, "__defaults__", ("inner", 5))
    monkeypatch.setattr(_shared.small_join, "__defaults__", ("inner", 5))
    monkeypatch.setattr(join, "LEAF", 4)
    monkeypatch.setattr(join, "TOGETHER", 2)
    texts = [" ".join(words(rnd, 80))] * 40 + family(rnd, 40, 150, 0.012) + family(rnd, 20, 100, 0.03) + [" ".join(words(rnd, 40)) for _ in range(20)]
    rnd.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component) for r in join.linked(docs_of(texts)).collect()}
    assert got == brute_components(dict(enumerate(texts)))


def test_bounds_never_refuse_a_link(rnd):
    for _ in range(300):
        base = np.random.default_rng(rnd.randrange(10**9)).integers(0, 2**63, rnd.randrange(1, 600)).astype(np.uint64)
        x, y = np.unique(base), np.unique(np.r_[base[: int(len(base) * rnd.uniform(0.7, 1))], np.random.default_rng(1).integers(0, 2**63, rnd.randrange(40)).astype(np.uint64)])
        if not len(y):
            continue
        shared = len(np.intersect1d(x, y))
        p, q = (np.frombuffer(join.signature(s), np.uint64) for s in (x, y))
        assert join.most_overlap(len(x), p, len(y), q) >= shared
        if join.links(shared, len(x), len(y)):
            none = np.zeros(0, np.uint64)
            assert set(join.first_shingles(x, none, none).tolist()) & set(join.first_shingles(y, none, none).tolist())


def test_tree_traversal_finds_what_pairs_do(rnd):
    g = np.random.default_rng(4)
    sets = []
    for _ in range(12):
        base = g.integers(0, 2**63, int(g.integers(5, 400))).astype(np.uint64)
        sets += [np.unique(np.r_[base[g.random(len(base)) > 0.08], g.integers(0, 2**63, 3).astype(np.uint64)]) for _ in range(10)]
    sets.sort(key=len)
    n = np.array([len(s) for s in sets])
    bits = np.stack([join.folded(np.frombuffer(join.signature(s), np.uint64), join.TREE_BITS // 64) for s in sets])
    node = join.TreeNode(np.arange(len(sets)), n, np.arange(len(sets)), np.zeros(len(sets), int), bits)
    got = set(join.TreeNode.pairs(node, node, 80))
    want = {(a, b) for a, b in combinations(range(len(sets)), 2) if join.links(len(np.intersect1d(sets[a], sets[b])), n[a], n[b])}
    assert want <= got and want and len(got) < 0.5 * len(sets) ** 2 / 2


def test_components(spark):
    rnd = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(k, k) == find(k) for k in root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_passages(texts, window):
    """Of each text the words in repeated windows, and those in windows that stand first elsewhere."""
    places = defaultdict(list)
    for k, t in texts.items():
        w = (t or "").encode().split()
        for a in range(len(w) - window + 1):
            places[tuple(w[a : a + window])].append((k, a))
    spans, cuts = defaultdict(set), defaultdict(set)
    for own in places.values():
        if len(own) > 1:
            for k, a in own:
                spans[k].update(range(a, a + window))
            for k, a in sorted(own)[1:]:
                cuts[k].update(range(a, a + window))
    return dict(spans), dict(cuts)


def as_sets(rows, column):
    return {r.doc_id: {w for s in r[column] for w in range(s.start, s.end)} for r in rows if r[column]}


def passages(rnd):
    shared = [words(rnd, n) for n in (50, 51, 60, 90, 49, 300)]
    texts = list(ODD) + ["w0 " * 130, "a b " * 70]
    for _ in range(80):
        own = words(rnd, rnd.randrange(0, 150))
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(shared)
            a = rnd.randrange(0, max(1, len(p) - 45))
            at = rnd.randrange(len(own) + 1)
            own[at:at] = p if rnd.random() < 0.5 else p[a : a + rnd.randrange(40, 70)]
        texts.append(" ".join(own))
    return texts + texts[30:33] + ["\t ".join(texts[40].split())]


@pytest.mark.parametrize("most", [2, suffix.MOST_ENTRIES, 0])
def test_passages_equal_brute_force(spark, docs_of, rnd, monkeypatch, most):
    """By sorted entries alone, by grouped windows alone, and by both."""
    monkeypatch.setattr(suffix, "MOST_ENTRIES", most)
    monkeypatch.setattr(suffix, "SORTED", 20)
    texts = passages(rnd)
    rows = suffix.repeated_passages(docs_of(texts)).collect()
    spans, cuts = brute_passages(dict(enumerate(texts)), 50)
    assert as_sets(rows, "spans") == spans and as_sets(rows, "cuts") == cuts
    assert all(a.end < b.start for r in rows for a, b in zip(r.spans, r.spans[1:]))


def test_cuts(spark, docs_of, rnd, nothing):
    texts = passages(rnd)
    df = docs_of(texts).withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: r for r in suffix.without_repeats(df).collect()}
    _, cuts = brute_passages(dict(enumerate(texts)), 50)
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        if k not in cuts:
            assert got[k].text == t
        else:
            w = t.encode().split()
            assert got[k].text.encode().split() == [x for i, x in enumerate(w) if i not in cuts[k]]
            assert got[k].n_chars == len(got[k].text)
    assert suffix.without_repeats(nothing).count() == 0
    twice = suffix.without_repeats(docs_of(texts[50:60]).union(docs_of(texts[50:60])))
    assert twice.count() == 20 and twice.columns == nothing.columns


def test_one_doc_id_on_several_texts(spark, rnd):
    """Each text is a document of its own, whatever its length; null ids take no part."""
    shared = words(rnd, 60)
    long = " ".join(words(rnd, 500) + shared + words(rnd, 300))
    texts = [long, " ".join(shared), " ".join(words(rnd, 30) + shared + words(rnd, 3)), "", " ".join(words(rnd, 80)), long]
    df = spark.createDataFrame([(7, t) for t in texts] + [(9, " ".join(words(rnd, 9) + shared)), (None, long)], "doc_id long, text string")
    rows = suffix.repeated_passages(df).collect()
    assert sorted((r.doc_id, *(s.end - s.start for s in r.spans)) for r in rows) == [(7, 60), (7, 60), (7, 860), (9, 60)]
    assert sorted(sum(s.end - s.start for s in r.cuts) for r in rows) == [0, 60, 60, 60]
    left = [len((r.text or "").split()) for r in suffix.without_repeats(df).collect()]
    assert sum(left) == sum(len(t.split()) for t in texts) + 69 + 860 - sum(sum(s.end - s.start for s in r.cuts) * (2 if r.spans[0].end - r.spans[0].start == 860 else 1) for r in rows)


def test_many_places_of_a_passage(spark, rnd):
    """A passage in most texts, each time with other words around it: more entries under a head than are sorted."""
    shared = words(rnd, 55)
    texts = [" ".join([f"a{k}", *shared, f"b{k}", f"c{k}"]) for k in range(700)] + ["one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = suffix.repeated_passages(df).collect()
    assert len(rows) == 700 and all(r.spans == [(1, 56)] for r in rows)
    assert sorted(r.doc_id for r in rows if not r.cuts) == [0] and all(r.cuts == [(1, 56)] for r in rows if r.doc_id)


def test_words_with_low_bytes_are_told_apart(spark, rnd):
    base = words(rnd, 49)
    texts = [" ".join([*base, x, *words(rnd, 9)]) for x in ("b", "b\x01", "b", "b\x01c", "b\x00", "b")]
    rows = suffix.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    spans, cuts = brute_passages(dict(enumerate(texts)), 50)
    assert as_sets(rows, "spans") == spans and as_sets(rows, "cuts") == cuts and set(spans) == {0, 2, 5}


def test_hot_keys_of_a_join(spark):
    """Keys of many rows are dealt over several partitions; no row is lost or doubled."""
    from millrace.llm import _shared

    big = spark.range(9000).selectExpr("if(id % 3 = 0, 0, id % 50) as k", "id as v")
    small = _shared.written(big.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low")).where("k < 40"), "test-small")
    old, (_shared.HOT_ROWS, _shared.BROADCAST_ROWS) = (_shared.HOT_ROWS, _shared.BROADCAST_ROWS), (100, 90)
    try:
        rows = _shared.counted_join(big, small, ["k"], "n", most=10).collect()
    finally:
        _shared.HOT_ROWS, _shared.BROADCAST_ROWS = old
    got = {(r.k, r.v, r.low) for r in rows}
    assert got == {(r.k, r.v, r.low) for r in big.join(small, "k").collect()} and len(rows) == len(got)


def test_cut_text():
    text = b"  a b\n c  d e "
    assert suffix.cut_text(text, [(1, 3)]) == b"  a d e " and suffix.cut_text(text, [(0, 5)]) == b"  "
    assert suffix.cut_text(text, []) == text and suffix.cut_text(text, [(0, 1), (3, 4)]) == b"  b\n c  e "


def test_windows_share_their_minimiser(rnd):
    passage = " ".join(words(rnd, 50))
    texts = [f"{' '.join(words(rnd, a))} {passage} {' '.join(words(rnd, b))}".encode() for a, b in ((0, 0), (13, 40), (200, 3))]
    own = Words(texts, lower=False)
    text, p, a, b = suffix.minimiser_suffixes(own)
    offsets = set()
    for k, before in enumerate((0, 13, 200)):
        start = own.first[k] + before
        (hit,) = [i for i in range(len(p)) if text[i] == k and a[i] <= start <= b[i]]
        offsets.add(int(p[hit] - start))
    assert len(offsets) == 1 and 0 <= offsets.pop() < suffix.PLACES
