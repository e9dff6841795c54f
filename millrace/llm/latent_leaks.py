"""Benchmark decontamination by latent semantic retrieval.

Terms are the benchmark's words. A document's passages are 64 words long, a new one every 32; a benchmark item's pieces
are 32 words long, one after another and one at its end, so a passage holds any piece that stands in the document whole. Vectors are TF-IDF, with
the words' counts in all documents; terms that make up more than a four-thousandth of all words have no weight, but where
they are among the rarer half of a piece's: copies of a leak make its words common, and must not blank it.

1. Documents are read once: what is kept of them is where terms stand. Other words match nothing.
2. The right singular vectors of the passages' matrix, in which the pieces have rows of a large weight, come from a
   randomised range: one pass over all passages multiplies the matrix's square with probing vectors, all pieces of the
   block and 32 random ones, and a Nystroem step on the driver, of the size of terms times probes, gives the basis. The
   rank follows the pieces, so that the basis keeps their whole length and a cosine means the same for any benchmark.
3. Passages whose projection has a cosine of 0.33 or more with a piece's are candidates for its item, and so are those that
   hold 0.55 of the piece's squared length, however long their other terms make them: a piece that stands whole in a
   passage is always found. All passages are held against all pieces, by blocks.
4. A candidate's neighbourhood is read for the longest common subsequence with the item. 0.8 of the item's words, in order,
   are a copy; 0.55 are a paraphrase if most of the item's answer, its last words, is among them.

Items are taken in blocks, so what is broadcast, and the basis, are bounded however large the benchmark is. The documents
are read once for many blocks, with the terms of all of these; a block takes its own terms' places from what was kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._shared import BATCH_BYTES, FEW_BYTES, mapped, packed, raw_texts, slices, small_batches, unpacked, written
from millrace.llm._text import SPACE, Words

#: Words of half a passage, which is a piece's length; items of a block, about, and bytes of
#: their texts; blocks for which the documents are read once; probing vectors beyond the pieces';
#: the share of all words from which on a term has no weight but in the rarer half of a piece; the pieces' weight among the passages.
HALF, ITEMS, ITEM_BYTES, AT_ONCE, EXTRA, STOP, WEIGHT = 32, 512, 1 << 17, 64, 32, 1 / 4_000, 1e3
COSINE, HELD, COPY, PARAPHRASE = 0.33, 0.55, 0.8, 0.55
#: The answer is an item's last words: such a share, three at least; so much of it must be found.
ANSWER, ANSWERED = 0.2, 0.6
#: Signs and white space are between words, so that a paraphrase's punctuation doesn't matter.
BETWEEN = SPACE.copy()
BETWEEN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class Benchmark:
    """The items of a block as sequences of terms, and their pieces."""

    def __init__(self, ids: list[int], texts: list[bytes]) -> None:
        words = Words(texts, between=BETWEEN)
        self.ids, self.terms = np.array(ids, np.int64), np.unique(words.hash)
        self.items = [np.searchsorted(self.terms, words.hash[a:b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        self.pieces: list[tuple[int, np.ndarray]] = []
        for k, item in enumerate(self.items):
            last = max(0, len(item) - HALF)
            self.pieces += [(k, item[a : a + HALF]) for a in sorted({*range(0, last, HALF), last}) if len(item)]

    def weights(self, counts: np.ndarray, total: int) -> np.ndarray:
        """Of each term, from its count among `total` words: none if it is common, but the rarer half of each piece's terms has one."""
        common = counts > STOP * total
        for _, piece in self.pieces:
            own = np.unique(piece)
            common[own[np.argsort(counts[own], kind="stable")[: -(-len(own) // 2)]]] = False
        return np.where(common, 0, np.log1p(total / (counts + 1)))

    def vectors(self, weight: np.ndarray) -> np.ndarray:
        """A row of unit length for each piece."""
        out = np.zeros((len(self.pieces), len(self.terms)), np.float32)
        for row, (_, piece) in zip(out, self.pieces, strict=True):
            np.add.at(row, piece, weight[piece])
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def places(texts: list[bytes], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of words of each text; where terms stand among the words of all texts; and which."""
    words = Words(texts, between=BETWEEN)
    at = np.minimum(np.searchsorted(terms, words.hash), len(terms) - 1)
    found = np.flatnonzero(terms[at] == words.hash)
    return np.diff(words.first), found, at[found]


def _halves(counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each place its half passage; of each half passage its text and number there. A text has one at least, and whole ones begin at its start."""
    first = np.concatenate([[0], np.cumsum(counts)])
    size = np.maximum(1, -(-counts // HALF))
    begin = np.concatenate([[0], np.cumsum(size)])
    text = np.searchsorted(first, at, "right") - 1
    half = begin[text] + (at - first[text]) // HALF
    of = np.repeat(np.arange(len(counts)), size)
    return half, of, np.arange(begin[-1]) - begin[of]


def _run_sums(key: np.ndarray, row: np.ndarray, table: np.ndarray, runs: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and, for each run of equal ones, the sum of the table's rows; some runs at once, whose rows stay in the cache."""
    new = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)] if len(key) else np.zeros(1, np.int64)
    for a in range(0, len(new) - 1, runs):
        cut = new[a : a + runs + 1]
        yield key[cut[:-1]], np.add.reduceat(table[row[cut[0] : cut[-1]]], cut[:-1] - cut[0], axis=0)


def _sums(half: np.ndarray, term: np.ndarray, table: np.ndarray, n: int) -> np.ndarray:
    """For each half passage, the sum of its terms' rows of the table."""
    out = np.zeros((n, table.shape[1]), np.float32)
    for key, sums in _run_sums(half, term, table):
        out[key] = sums
    return out


def _blocks(blob: bytes, columns: int, own: np.ndarray | None) -> Iterator[tuple]:
    """Runs of texts of a row: (ids, counts, places, terms), the shorter the more columns of sums are held for them.

    own: the number of each term in the block of items, -1 for those of other blocks; None if all are its own.
    """
    most = max(1, (1 << 24) // columns)
    ids, counts, at, term = unpacked(blob)
    if own is not None:
        term = own[term]
        at, term = at[term >= 0], term[term >= 0]
    first = np.concatenate([[0], np.cumsum(counts)])
    held = np.concatenate([[0], np.searchsorted(at, first[1:])])
    start = 0
    while start < len(counts):
        stop = max(start + 1, int(np.searchsorted(held, held[start] + most, "right")) - 1)
        p, t = at[held[start] : held[stop]].astype(np.int64) - first[start], term[held[start] : held[stop]]
        yield ids[start:stop], counts[start:stop].astype(np.int64), p, t
        start = stop


def common_length(item: np.ndarray, words: np.ndarray) -> int:
    """The length of a longest common subsequence, by bits of one integer."""
    place: dict[int, int] = {}
    for j, t in enumerate(item.tolist()):
        place[t] = place.get(t, 0) | 1 << j
    full = (1 << len(item)) - 1
    row = full
    for w in words.tolist():
        if m := place.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(item) - row.bit_count()


def subsequence(item: np.ndarray, words: np.ndarray) -> tuple[int, np.ndarray]:
    """The length of a longest common subsequence, and which of the item's words are in one."""
    if not len(words) or not len(item):
        return 0, np.zeros(len(item), bool)
    best = np.zeros((len(words) + 1, len(item) + 1), np.int32)
    for i, w in enumerate(words):
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], np.where(item == w, best[i, :-1] + 1, 0)))
    found, i, j = np.zeros(len(item), bool), len(words), len(item)
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            found[j - 1] = True
            i, j = i - 1, j - 1
    return int(best[-1, -1]), found


def judged(item: np.ndarray, words: np.ndarray) -> tuple[float, bool, bool]:
    """The share of the item's words in order (0 if it is too small), whether its answer is found, and whether it is a leak."""
    if common_length(item, words) < PARAPHRASE * len(item):
        return 0.0, False, False
    length, found = subsequence(item, words)
    answer = found[-max(3, int(np.ceil(ANSWER * len(item)))) :]
    share, answered = length / max(1, len(item)), bool(answer.mean() >= ANSWERED) if len(answer) else False
    return share, answered, share >= COPY or (share >= PARAPHRASE and answered)


def _basis(table: DataFrame, bench: Benchmark, weight: np.ndarray, own: np.ndarray | None = None, seed: int = 5) -> np.ndarray:
    """The right singular vectors of the weighted passages of `table` and the pieces."""
    pieces = bench.vectors(weight).astype(np.float64)
    rng = np.random.default_rng(seed)
    probes = np.concatenate([pieces, rng.standard_normal((EXTRA, len(weight)))]).T
    shared = table.sparkSession.sparkContext.broadcast((weight.astype(np.float32), probes.astype(np.float32), own))
    rows = 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, probe, terms = shared.value
        total, weighted = np.zeros(probe.shape), probe * w[:, None]
        for blob in (x for b in batches for x in b.column("blob").to_pylist()):
            for _, counts, at, term in _blocks(blob, probe.shape[1], terms):
                half, of, _ = _halves(counts, at)
                used = w[term] > 0
                half, term = half[used], term[used]
                if not len(half):
                    continue
                y = _sums(half, term, weighted, len(of))
                # a passage is a half and the next one of the same text, or a text's only half
                pair = np.flatnonzero(of[1:] == of[:-1])
                single = np.flatnonzero(np.bincount(of, minlength=len(counts))[of] == 1)
                both = np.zeros_like(y)
                both[single] = y[single]
                sums = y[pair] + y[pair + 1]
                both[pair] += sums
                both[pair + 1] += sums
                order = np.argsort(term, kind="stable")
                for key, sums in _run_sums(term[order], half[order], both):
                    total[key] += sums * w[key, None]
        salt = TaskContext.get().partitionId() % 32
        for k in range(-(-len(total) // rows)):  # a row at a time, as the table may be large
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([salt]), pa.array([total[k * rows : (k + 1) * rows].tobytes()], pa.binary())], names=["rows", "salt", "sums"])

    def add(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer()) for x in part["sums"])
        return pa.table({"rows": part["rows"][:1], "salt": part["salt"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "rows long, salt long, sums binary"
    parts = mapped(table.select("blob"), run, schema).groupBy("rows", "salt").applyInArrow(add, schema).groupBy("rows").applyInArrow(add, schema)
    z = np.concatenate([np.frombuffer(r.sums) for r in sorted(parts.collect(), key=lambda r: r.rows)] or [np.zeros(probes.size)]).reshape(probes.shape)
    z = z + WEIGHT * max(1.0, np.abs(z).max()) * pieces.T @ (pieces @ probes)
    # Nystroem: the square is nearly z (probes' z)^-1 z', of which the left singular vectors of z L^-T are the eigenvectors
    core = probes.T @ z
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    kept = values > 1e-10 * max(values.max(initial=0), 1e-300)
    basis, size, _ = np.linalg.svd(z @ (vectors[:, kept] / np.sqrt(values[kept])), full_matrices=False)
    return basis[:, size > 1e-7 * size.max(initial=1)]


SCHEMA = "doc_id long, item_id long, share double, answered boolean, cosine double, start_word int, end_word int"


def _places(docs: DataFrame, terms: np.ndarray) -> tuple[DataFrame, np.ndarray, int]:
    """Where the terms stand in the documents, a written table of packed rows; how often each stands; and the number of all words."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, words = np.zeros(len(shared.value), np.int64), 0
        for batch in (part for b in batches for part in slices(b, most=FEW_BYTES)):
            counts, at, term = places(raw_texts(batch), shared.value)
            n += np.bincount(term, minlength=len(n))
            words += int(counts.sum())
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([packed(ids, counts.astype(np.int32), at.astype(np.int32), term.astype(np.int32))], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names=["blob", "term", "n"])
        keys = np.r_[np.flatnonzero(n), -1]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.binary()), pa.array(keys), pa.array(np.r_[n[keys[:-1]], words])], names=["blob", "term", "n"])

    table = written(mapped(docs, read, "blob binary, term long, n long"), "leaks-places")
    counts, total = np.zeros(len(terms)), 1
    for r in table.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row per term
        if r.term < 0:
            total = max(1, r.n)
        else:
            counts[r.term] = r.n
    return table.where("blob is not null").select("blob"), counts, total


def _of_block(table: DataFrame, bench: Benchmark, counts: np.ndarray, total: int, number: np.ndarray | None) -> DataFrame:
    """The leaks of a block's items; counts: of its terms; number: as `own` of _blocks."""
    spark = table.sparkSession
    weight = bench.weights(counts, total)
    basis = _basis(table, bench, weight, number)
    pieces = bench.vectors(weight) @ basis
    scale = np.maximum(np.linalg.norm(pieces, axis=1), 1e-9)
    size = np.array([np.linalg.norm(np.bincount(p) * weight[: p.max() + 1]) for _, p in bench.pieces]).astype(np.float32)
    # what a term adds at most to any cosine, before it is divided by the passage's length; and to any piece's held share
    # (a passage's projection times a piece's is the sum of its terms' rows of this, one number for each piece)
    adds = (basis @ (pieces / scale[:, None]).T * weight[:, None]).astype(np.float32)
    most = np.abs(adds).max(axis=1, initial=0), np.abs(adds / size).max(axis=1, initial=0)
    shared = spark.sparkContext.broadcast((bench, weight.astype(np.float32), adds, size, most, number))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w, adds_, size_, (bound, share_bound), terms = shared.value
        item_of = np.array([k for k, _ in own.pieces])
        for blob in (x for b in batches for x in b.column("blob").to_pylist()):
            rows: dict[tuple[int, int], tuple] = {}
            for ids, counts_, at, term in _blocks(blob, adds_.shape[1], terms):
                half, of, place_in = _halves(counts_, at)
                used = w[term] > 0
                h, t = half[used], term[used]
                if not len(h):
                    continue
                # a passage's length counts each term's weights together, in its whole vector and not in the projection
                pair = np.append(of[1:] == of[:-1], False)
                second = pair[h - 1] & (h > 0)
                key, times = np.unique(np.concatenate([h, h[second] - 1]) * len(w) + np.concatenate([t, t[second]]), return_counts=True)
                place, kind = key // len(w), key % len(w)
                length = np.sqrt(np.bincount(place, (times * w[kind]) ** 2, len(of)))
                near = np.bincount(place, times * bound[kind], len(of)) >= COSINE * length
                some = np.flatnonzero((length > 0) & (near | (np.bincount(place, times * share_bound[kind], len(of)) >= HELD)))
                wanted = np.zeros(len(of) + 1, bool)
                wanted[some] = wanted[some + 1] = True
                y = _sums(h[wanted[h]], t[wanted[h]], adds_, len(of) + 1)
                first = np.concatenate([[0], np.cumsum(counts_)])
                for a in range(0, len(some), 1024):
                    mine = some[a : a + 1024]
                    along = y[mine]
                    along[pair[mine]] += y[mine[pair[mine]] + 1]
                    for i, j in zip(*np.nonzero(along >= np.minimum(COSINE * length[mine, None].astype(np.float32), HELD * size_)), strict=True):
                        p, k = mine[i], item_of[j]
                        text, item = of[p], own.items[k]
                        low = max(0, place_in[p] * HALF - len(item))
                        high = min(int(counts_[text]), place_in[p] * HALF + 2 * HALF + len(item))
                        known = rows.get((int(ids[text]), int(k)))
                        if known and known[0] >= 1:
                            continue
                        x, z = np.searchsorted(at, (first[text] + low, first[text] + high))
                        share, answered, leak = judged(item, term[x:z])
                        cosine = float(along[i, j] / length[p])
                        if leak and (known is None or (share, cosine) > (known[0], known[2])):
                            rows[int(ids[text]), int(k)] = (share, answered, cosine, low, high)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([int(own.ids[k]) for _, k in rows], pa.int64()), *(pa.array([r[c] for r in rows.values()], kind) for c, kind in enumerate((pa.float64(), pa.bool_(), pa.float64(), pa.int32(), pa.int32())))], names=["doc_id", "item_id", "share", "answered", "cosine", "start_word", "end_word"])

    return mapped(table, search, SCHEMA)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, share, answered, cosine, start_word, end_word) for each document that holds an item.

    A-Z are lower-cased; words are what ASCII signs and white space leave. share: of the item's words in order;
    answered: whether most of the item's last words are among them; the words from start_word to end_word hold them.
    Documents and items with null ids take no part; null and empty texts, and items without words, match
    nothing; items with the same text are found alike, repeated rows of a
    document once each. Texts of any length are read whole; empty tables give no rows; other columns play no part.
    """
    small_batches(docs.sparkSession, size=BATCH_BYTES)
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    count, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-count // ITEMS), -(-(size or 0) // ITEM_BYTES))
    items = written(items.dropDuplicates(["item_id", "text"]).withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), "leaks-items")
    # rows of the driver would come by Python workers of their own, beside those that are already there
    found = docs.sparkSession.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(SCHEMA)))
    for first in range(0, blocks, AT_ONCE):
        rows = items.where(F.col("block").between(first, first + AT_ONCE - 1)).orderBy("block", "item_id", "text").collect()
        texts: dict[int, list] = {}
        for r in rows:
            texts.setdefault(r.block, []).append(r)
        benches = [Benchmark([r.item_id for r in x], [(r.text or "").encode() for r in x]) for x in texts.values()]
        benches = [b for b in benches if len(b.terms)]
        if not benches:
            continue
        terms = np.unique(np.concatenate([b.terms for b in benches]))
        table, counts, total = _places(docs, terms)
        for bench in benches:
            of = np.searchsorted(terms, bench.terms)
            number = None
            if len(benches) > 1:
                number = np.full(len(terms), -1, np.int32)
                number[of] = np.arange(len(of))
            found = found.unionByName(_of_block(table, bench, counts[of], total, number))
    return found
