"""Scores of texts by prediction by partial matching, beside those of a unigram model.

A text is its words, lower-cased (A-Z), joined by single spaces, and an end. The byte model is a trie of the contexts of up
to five bytes before each byte. Where the longest known context has not been followed by the byte, the model escapes to the
next shorter one and excludes there what the longer one has been followed by; a context followed d times by d' different
bytes gives (2c - 1) / 2d to one that came c times and d' / 2d to the escape, of what isn't excluded; behind the empty
context, all other bytes are equally likely. The unigram model is what op3's contract calls base.

The trie isn't gathered anywhere. Texts are written in chunks; a chunk names its distinct words and six-byte strings once,
in parts by hash; a part sums what all chunks have; the probability of a byte depends on its string alone and is computed
for each distinct string once, where all strings that share their last three context bytes meet (what shorter contexts
need comes as a table: of the last two bytes the rows of those contexts, of the last one 256 x 256 counts); and each chunk gets back the values of its own words and strings. So what moves is in
proportion to the chunks' distinct contents, every task holds a chunk or a part, and nothing depends on the number of texts: strings
of six bytes that share three are 2^24 at most, however large the corpus is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import packed, raw_texts, slices, small_batches, unpacked, written
from millrace.llm._text import Words, mixed

_U = np.uint64
#: Bytes of the longest context; bytes of a chunk, of what is worked on at once, and, for choosing the number of parts, of input a part.
ORDER, CHUNK_BYTES, BLOCK_BYTES, PART_BYTES = 5, 1 << 24, 1 << 20, 1 << 25
#: What stands for the end of a text among the hashes of words.
END = _U(0x0E0D0E0D0E0D0E0D)
_BLOBS = "kind string, chunk string, part int, blob binary"


def normal(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The texts as they are modelled, each ending in a line feed, and where each begins (and the last ends)."""
    b = words.buffer.copy()
    keep = np.zeros(len(b), bool)
    edge = np.zeros(len(b) + 1, np.int8)
    edge[words.start] += 1
    edge[words.end] -= 1
    keep |= np.cumsum(edge[:-1]).astype(bool)
    b[words.end], keep[words.end] = 32, True
    counts = np.diff(words.first)
    last = np.where(counts > 0, words.end[np.maximum(words.first[1:] - 1, 0)] if len(words.end) else 0, words.offset[1:] - 1)
    b[last], keep[last] = 10, True
    size = np.concatenate([[0], np.cumsum(keep)])
    return b[keep], np.concatenate([[0], size[last + 1]])


def strings(norm: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte, its context's bytes from the nearest on and itself, in one number; before a text are line feeds."""
    code, before = np.zeros(len(norm), np.uint64), np.zeros(len(norm), np.uint8)
    for j in range(1, order + 1):
        own = np.concatenate([np.full(min(j, len(norm)), 10, np.uint8), norm[:-j]])
        before = own if j == 1 else np.where(before == 10, np.uint8(10), own)
        code = (code << _U(8)) | before
    return (code << _U(8)) | norm


def log_probabilities(code: np.ndarray, count: np.ndarray, two: tuple[np.ndarray, np.ndarray], one: np.ndarray, order: int = ORDER) -> np.ndarray:
    """log10 of the probability of each string's last byte.

    code: distinct strings, sorted, among them all of their contexts' last three bytes; count: how often each was learnt;
    two: all strings' last two context bytes and last byte, sorted, of the context bytes of `code` at least, and their counts;
    one[context byte, byte]: the counts of all strings by their last context byte.
    """
    n, sym = len(code), (code & _U(255)).astype(np.int64)
    total, still = np.zeros(n), np.ones(n, bool)
    zero, upper = one.sum(axis=0), None
    for o in range(order, -1, -1):
        if o >= 2:
            edge = code if o == order else ((code >> _U(8 * (order - o + 1))) << _U(8)) | (code & _U(255))
            if o == 2:
                known, c = two
                at = np.searchsorted(known, edge)
            else:
                known, at = np.unique(edge, return_inverse=True)
                c = np.bincount(at, count, len(known))
            new = np.r_[True, known[1:] >> _U(8) != known[:-1] >> _U(8)]
            place, first = np.cumsum(new) - 1, np.flatnonzero(new)
            all_, kinds = np.add.reduceat(c, first), np.add.reduceat((c > 0).astype(float), first)
            own, context = c[at], place[at]
            all_, kinds = all_[context], kinds[context]
        else:
            row = (code >> _U(8 * order)).astype(np.int64)
            own = one[row, sym] if o == 1 else zero[sym]
            all_ = one.sum(axis=1)[row] if o == 1 else np.full(n, zero.sum())
            kinds = (one > 0).sum(axis=1).astype(float)[row] if o == 1 else np.full(n, float((zero > 0).sum()))
        rest, left = all_, kinds
        if upper is not None:  # without what the longer context has been followed by
            if o >= 1:
                u_place, u_known, u_example, u_c, u_at, u_count = upper
                below = own[u_example] if o >= 2 else one[(u_known >> _U(16)).astype(np.int64), (u_known & _U(255)).astype(np.int64)]
                gone = np.bincount(u_place, below * (u_c > 0), u_count)[u_place[u_at]]
                gone_kinds = np.bincount(u_place, u_c > 0, u_count)[u_place[u_at]]
            else:  # behind one byte of context: its row of the table
                gone = ((one > 0) * zero[None, :]).sum(axis=1)[row]
                gone_kinds = (one > 0).sum(axis=1)[row]
            rest, left = all_ - gone, kinds - gone_kinds
        live = still & (left > 0)
        hit = live & (own > 0)
        total[hit] += np.log10((2 * own[hit] - 1) / (2 * rest[hit]))
        miss = live & ~hit
        total[miss] += np.log10(left[miss] / (2 * rest[miss]))
        still &= ~hit
        if o >= 2:
            example = np.zeros(len(known), np.int64)  # of the strings, one with this edge
            example[at] = np.arange(n)
            upper = (place, known, example, c, at, len(first))
    total[still] -= math.log10(max(1, 256 - int((zero > 0).sum())))
    return total


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The sums of the runs between edges, each by its own values alone: equal runs have equal sums."""
    out, some = np.zeros(len(edges) - 1), edges[1:] > edges[:-1]
    if some.any():
        out[some] = np.add.reduceat(values.astype(float), edges[:-1][some])
    return out


def _parts(values: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(values ^ _U(0x2545F4914F6CDD1D)) % _U(parts)).astype(np.int64)


def _summed(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    value, at = np.unique(np.concatenate([x for x, _ in pairs]), return_inverse=True)
    return value, np.bincount(at, np.concatenate([c for _, c in pairs]), len(value)).astype(np.int64)


def _chunks(docs: DataFrame, parts: int, order: int | None) -> DataFrame:
    """Rows of kind T (a chunk's texts), W and G (its distinct words and strings of a part, with their training counts); no order: no strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        ids, norms, words_, grams, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"{task}-{made}"
            keys = pa.concat_arrays(ids)
            rows = [("T", name, -1, packed(keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False), np.concatenate(norms)))]
            for kind, own in (("W", words_), ("G", grams))[: 1 if order is None else 2]:
                value, count = _summed(own)
                part = _parts(value, parts)
                by = np.argsort(part, kind="stable")
                for p, places in zip(*(lambda u: (u[0], np.split(by, u[1][1:])))(np.unique(part[by], return_index=True)), strict=True):
                    rows.append((kind, name, int(p), packed(np.diff(value[places], prepend=_U(0)), count[places].astype(np.uint32))))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)][:2] + [pa.array([x[2] for x in rows], pa.int32()), pa.array([x[3] for x in rows], pa.binary())], names=["kind", "chunk", "part", "blob"])

        for batch in (part for b in batches for part in slices(b, most=BLOCK_BYTES)):
            words = Words(raw_texts(batch))
            norm, begin = normal(words)
            train = np.array(batch.column("train").to_pylist(), bool)
            ids.append(batch.column("doc_id"))
            norms.append(norm)
            learnt = np.repeat(train, np.diff(words.first))
            words_.append(_summed([(words.hash, learnt.astype(np.int64)), (np.array([END]), np.array([train.sum()]))]))
            if order is not None:
                grams.append(_summed([(strings(norm, order), np.repeat(train, np.diff(begin)).astype(np.int64))]))
            held += len(norm)
            if held >= CHUNK_BYTES:
                yield flush()
                ids, norms, words_, grams, held, made = [], [], [], [], 0, made + 1
        if ids:
            yield flush()

    return docs.mapInArrow(run, _BLOBS)


def _unpacked_part(table: pa.Table) -> tuple[list[str], list[np.ndarray], list[np.ndarray]]:
    rows = [unpacked(x) for x in table["blob"].to_pylist()]
    return table["chunk"].to_pylist(), [np.cumsum(x[0], dtype=np.uint64) for x in rows], [x[1].astype(np.int64) for x in rows]


def _word_sums(table: pa.Table) -> pa.Table:
    """Each chunk's words' counts in all chunks, and a row with the part's sum and its learnt words."""
    chunks, values, counts = _unpacked_part(table)
    value, count = _summed(list(zip(values, counts, strict=True)))
    part = table["part"][0].as_py()
    rows = [(c, part, packed(count[np.searchsorted(value, v)].astype(np.uint32 if count.max(initial=0) < 1 << 32 else np.int64)), None, None) for c, v in zip(chunks, values, strict=True)]
    rows.append((None, part, None, int(count.sum()), int((count > 0).sum())))
    kinds = (pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["chunk", "part", "blob", "total", "distinct"])


def _string_sums(table: pa.Table) -> pa.Table:
    _, values, counts = _unpacked_part(table)
    value, count = _summed(list(zip(values, counts, strict=True)))
    return pa.table({"part": pa.array(np.full(len(value), table["part"][0].as_py(), np.int32)), "code": pa.array(value.view(np.int64)), "n": pa.array(count)})


def _string_values(own: DataFrame, parts: int, order: int) -> DataFrame:
    """For the chunks' distinct strings (rows of kind G), the model's values of them, in the same order."""
    grams = written(own.repartition(parts, "part").groupBy("part").applyInArrow(_string_sums, "part int, code long, n long"), "ppm-strings")
    near = F.shiftrightunsigned("code", 8 * order).cast("int").alias("near")
    one = np.zeros((256, 256))
    for r in grams.groupBy(near, F.col("code").bitwiseAND(F.lit(255)).cast("int").alias("byte")).agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        one[r.near, r.byte] = r.n

    def model(part: pa.Table, shorter: pa.Table) -> pa.Table:
        code, pair = (x["code"].to_numpy().view(np.uint64) for x in (part, shorter))
        if not len(code):
            return part.slice(0, 0).select(["part", "code"]).append_column("value", pa.array([], pa.float64()))
        at, by = np.argsort(code), np.argsort(pair)
        two = pair[by], shorter["n"].to_numpy()[by].astype(float)
        value = log_probabilities(code[at], part["n"].to_numpy()[at].astype(float), two, one, order)
        return pa.table({"part": part["part"].take(pa.array(at)), "code": pa.array(code[at].view(np.int64)), "value": pa.array(value)})

    pair = F.shiftrightunsigned("code", 8 * (order - 1))
    last_three = F.pmod(F.xxhash64(F.shiftrightunsigned("code", 8 * max(1, order - 2))), F.lit(parts))
    dealt = grams.withColumns({"contexts": last_three, "pair": pair})
    pairs = written(grams.groupBy(pair.alias("pair"), F.col("code").bitwiseAND(F.lit(255)).alias("byte")).agg(F.sum("n").alias("n")), "ppm-pairs")
    shorter = written(dealt.select("contexts", "pair").distinct().join(pairs, "pair").select("contexts", (F.shiftleft("pair", 8) + F.col("byte")).alias("code"), "n"), "ppm-shorter")
    by = lambda x: x.groupBy("contexts")
    valued = written(by(dealt.select("contexts", "part", "code", "n")).cogroup(by(shorter)).applyInArrow(model, "part int, code long, value double"), "ppm-model")

    def back(asked: pa.Table, known: pa.Table) -> pa.Table:
        """Each chunk's strings' values."""
        code = known["code"].to_numpy().view(np.uint64)
        at = np.argsort(code)
        code, value = code[at], known["value"].to_numpy()[at].astype(np.float32)
        chunks, values, _ = _unpacked_part(asked)
        blobs = [packed(value[np.searchsorted(code, v)]) for v in values]
        return pa.table({"kind": pa.array(["G"] * len(chunks), pa.string()), "chunk": pa.array(chunks, pa.string()), "part": asked["part"], "blob": pa.array(blobs, pa.binary())})

    return own.groupBy("part").cogroup(valued.groupBy("part")).applyInArrow(back, _BLOBS)


def scores(docs: DataFrame, train, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """For each row its key, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the whole text).

    train: a column that holds for the rows to learn from; null is false. A null text is empty and has an end only, as has one without words. Texts
    of any length are scored whole; equal texts get equal scores; repeated rows are learnt as often as they stand; rows with
    a null key are scored too. Without rows to learn from, each byte has the probability 1/256 and known words are none. An
    empty table gives no rows; other columns play no part. Words are told apart by 64-bit hashes.
    """
    if order < 2:
        raise ValueError("contexts have two bytes at least")
    return _scored(docs, train, key, text, order)


def base_scores(docs: DataFrame, train, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of scores but for the last, to the last bit, by the same chunks and parts: the byte model, which only that one needs, isn't made."""
    return _scored(docs, train, key, text, None)


def _scored(docs: DataFrame, train, key: str, text: str, order: int | None) -> DataFrame:
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, -(-total // PART_BYTES))
    table = written(_chunks(docs, parts, order), "ppm-chunks", "kind")
    of = lambda kind: table.where(F.col("kind") == kind).select("chunk", "part", "blob")

    words = written(of("W").repartition(parts, "part").groupBy("part").applyInArrow(_word_sums, "chunk string, part int, blob binary, total long, distinct long"), "ppm-words")
    sums = words.where("chunk is null").agg(F.sum("total"), F.sum("distinct")).first()
    learnt, distinct = sums[0] or 0, sums[1] or 0

    values = words.where("chunk is not null").select(F.lit("W").alias("kind"), "chunk", "part", "blob")
    if order is not None:
        values = values.unionByName(_string_values(of("G"), parts, order))

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for blob in texts["blob"].to_pylist():
            ids, lost, norm = unpacked(blob)
            blocks = []
            ends = np.flatnonzero(norm == 10) + 1
            cuts = np.flatnonzero(np.diff(ends // BLOCK_BYTES)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ends)], strict=True):
                own = norm[ends[a - 1] if a else 0 : ends[b - 1]]
                words = Words(own.tobytes().split(b"\n")[:-1], lower=False)
                word = np.unique(words.hash, return_inverse=True)
                gram = (words.hash[:0],) * 2 if order is None else np.unique(strings(own, order), return_inverse=True)
                blocks.append((words.first, word[0], word[1].astype(np.int32), np.flatnonzero(own == 10) + 1, gram[0], gram[1].astype(np.int32)))

            def table_of(kind: str, distinct_: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
                value = np.unique(np.concatenate(distinct_))
                part, result = _parts(value, parts), np.zeros(len(value))
                rows = found.filter(pa.compute.equal(found["kind"], kind))
                for p, blob_ in zip(rows["part"].to_pylist(), rows["blob"].to_pylist(), strict=True):
                    result[part == p] = unpacked(blob_)[0]
                return value, result

            word, times = table_of("W", [np.append(x[1], END) for x in blocks])
            gram, value = table_of("G", [x[4] for x in blocks]) if order is not None else (None, None)
            end_times = times[np.searchsorted(word, END)]
            n_tokens, known, base, bits = [], [], [], []
            for first, w, w_at, end, g, g_at in blocks:
                c = times[np.searchsorted(word, w)][w_at]
                n_tokens.append(np.diff(first) + 1)
                known.append(_sums(c > 0, first) + (end_times > 0))
                base.append(_sums(np.log10(c + 1), first) + math.log10(end_times + 1))
                if order is not None:
                    bits.append(np.add.reduceat(value[np.searchsorted(gram, g)][g_at], np.concatenate([[0], end[:-1]])))
            n, k, s = (np.concatenate(x) for x in (n_tokens, known, base))
            columns = {"doc_id": pa.array(ids, pa.int64(), mask=lost), "n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array(np.rint(k).astype(np.int64)), "train_tokens": pa.array(np.full(len(n), learnt)), "base_score": pa.array(s - n * math.log10(learnt + distinct + 1))}
            out.append(pa.table(columns if order is None else columns | {"score": pa.array(np.concatenate(bits))}))
        return pa.concat_tables(out) if out else pa.schema([(c, pa.float64() if c.endswith("score") else pa.int64()) for c in names]).empty_table()

    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", *["score"] * (order is not None)]
    schema = ", ".join(f"{c} {'double' if c.endswith('score') else 'long'}" for c in names)
    return of("T").groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(score, schema)


def adaptive_code_length(text: bytes, order: int = ORDER) -> float:
    """log10 of a text's probability under a trie that has learnt but what stands before each byte (a byte at a time)."""
    words = Words([text])
    norm = normal(words)[0].tobytes()
    trie: dict[bytes, dict[int, int]] = {}
    total, before = 0.0, b"\n" * order
    for byte in norm:
        total += next_byte(trie, before, byte, order)
        for o in range(order + 1):
            seen = trie.setdefault(before[len(before) - o :], {})
            seen[byte] = seen.get(byte, 0) + 1
        before = (before + bytes([byte]))[-order:]
    return total


def adaptive_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """For each row its key and the adaptive score of its whole text: every text is learnt from its own start on, alone.

    A null text is empty and has an end only; rows with a null key are scored too; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b)):
            score = [adaptive_code_length(x, order) for x in raw_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def next_byte(trie: dict[bytes, dict[int, int]], before: bytes, byte: int, order: int) -> float:
    """log10 of the probability of a byte behind a context, by the definition above."""
    total, gone = 0.0, set()
    for o in range(order, -1, -1):
        seen = {k: c for k, c in trie.get(before[len(before) - o :], {}).items() if k not in gone}
        if not seen:
            continue
        n = sum(seen.values())
        if byte in seen:
            return total + math.log10((2 * seen[byte] - 1) / (2 * n))
        total += math.log10(len(seen) / (2 * n))
        gone |= set(seen)
    return total - math.log10(max(1, 256 - len(gone)))
