"""Repeated passages by a sparse suffix array.

A passage is repeated if its 50 words, or any 50 successive words of it, stand in the corpus twice. Of all suffixes, those
at minimisers are kept: of 26 successive places, the one whose next five words have the least hash (the first of equals).
The choice depends on content alone, and each window of 50 words has one in its first 26 places, at the same offset
wherever it stands, with 25 words of the window after it. So equal windows have suffixes that agree in 25 words.

1. A suffix's stretch is all windows that chose it, from the first one's start on its left to the last one's end on its
   right: 75 words at most. A suffix whose first 25 words (its head, by hash) stand nowhere else repeats nothing.
2. Suffixes with the same head and the same stretch are one entry of the array, with their number and their first place:
   so a hot passage is one entry. An entry that is alone under its head repeats whatever is in its stretch, if it
   stands for several suffixes.
3. The other entries are sorted by their words from the suffix on. Neighbours are compared word by word; those that agree in
   25 words or more are one run. Sorted by the words before the suffix, from the nearest on, neighbours are compared
   again. So matches extend to both sides: two entries hold the same window, with d words before the suffix, if no
   neighbours between them differ within 50 - d words to the right, nor within d words to the left.
4. Heads with more than MOST_ENTRIES entries (where a hot passage ends, each of its places goes on differently) aren't
   gathered: their entries' windows are grouped by hashes of 128 bits, counted before they are shuffled. The result is the same.
5. A document's repeated windows are joined to passages. A window's first place, by doc_id and position, is kept; the
   words that its other places cover may be cut.

Contexts are bounded, however long a match is: a long match is the union of its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import BATCH_BYTES, FEW_BYTES, counted_join, dropped, free_name, mapped, raw_texts, slices, small_batches, small_join, written
from millrace.llm._text import Words, mixed, prefix_sums, runs, span_hash

#: Words of a window, places among which a minimiser is chosen, and words whose hash is compared.
WINDOW, PLACES, GRAM = 50, 26, 5
#: Entries of a head that a task sorts; entries that it sorts at once, about.
MOST_ENTRIES, SORTED = 500, 8_000
SPAN = "array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _least(g: np.ndarray, size: int) -> np.ndarray:
    """For each i, where the least of g[i : i + size] is, the first of equals."""
    at, span = np.arange(len(g)), 1
    while span < size:
        step = min(span, size - span)
        left, right = at[: len(at) - step], at[step:]
        at, span = np.where(g[left] <= g[right], left, right), span + step
    return at


def minimiser_suffixes(words: Words, window: int = WINDOW, places: int = PLACES) -> tuple[np.ndarray, ...]:
    """(text, suffix, first window, last window) as places in `words`, for the windows that lie within a text."""
    n = len(words.hash) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    chosen = _least(runs(words.hash, GRAM), places)[:n]
    text = np.searchsorted(words.first, np.arange(len(words.hash)), "right") - 1
    at = np.flatnonzero(text[:n] == text[window - 1 :])
    new = np.flatnonzero(np.r_[True, (chosen[at][1:] != chosen[at][:-1]) | (text[at][1:] != text[at][:-1])]) if len(at) else at
    last = np.r_[new[1:], len(at)] - 1 if len(at) else at
    return text[at[new]], chosen[at[new]], at[new], at[last]


def _suffixes(docs: DataFrame, window: int, places: int) -> DataFrame:
    """(head, stretch, doc_id, tag, place): place is where the suffix is, and how far its first and last window are before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, most=FEW_BYTES)):
            words = Words(raw_texts(batch), lower=False)
            text, p, a, b = minimiser_suffixes(words, window, places)
            sums = prefix_sums(words.hash)
            head = span_hash(sums, p, p + window - places + 1)
            stretch = mixed(span_hash(sums, a, b + window) + ((p - a) * 64 + (b - a)).astype(np.uint64))
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False)[text].astype(np.int64) for c in ("doc_id", "tag"))
            place = ((p - words.first[text]) * 64 + (p - a)) * 64 + (b - a)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (head.view(np.int64), stretch.view(np.int64), ids, tags, place.astype(np.int64))], names=["head", "stretch", "doc_id", "tag", "place"])

    return mapped(docs, run, "head long, stretch long, doc_id long, tag long, place long")


def _of_entries(docs: DataFrame) -> Iterator[tuple]:
    """For each text with entries: (doc_id, tag, its words, the entries' numbers), whose windows begin at `place // 4096 - place // 64 % 64`."""
    for batch in docs:
        for part in slices(batch, most=FEW_BYTES):
            for doc, tag, text, entries in zip(part.column("doc_id").to_pylist(), part.column("tag").to_pylist(), raw_texts(part), part.column("entries"), strict=True):
                x = entries.values
                yield doc, tag, text, [x.field(c).to_numpy(zero_copy_only=False) for c in ("head", "stretch", "n", "place")]


def _contexts(docs: DataFrame, window: int) -> DataFrame:
    """The words of each entry from the suffix on (after), and before it from the nearest on (before)."""
    names = ["head", "stretch", "n", "doc_id", "tag", "place", "after", "before"]
    kinds = [pa.int64()] * 6 + [pa.binary()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for doc, tag, text, (head, stretch, n, place) in _of_entries(batches):
            words = text.split()  # at the same bytes as Words
            for h, s, k, at in zip(head.tolist(), stretch.tolist(), n.tolist(), place.tolist(), strict=True):
                p, back, size = at // 4096, at // 64 % 64, at % 64
                rows.append((h, s, k, doc, tag, at, b" ".join(words[p : p - back + size + window]), b" ".join(words[p - back : p][::-1])))
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return mapped(docs, run, "head long, stretch long, n long, doc_id long, tag long, place long, after binary, before binary")


def common_words(rows: list[list[bytes]]) -> np.ndarray:
    """How many words each row has in common with the one before it, from the first on."""
    out = np.zeros(len(rows), np.int32)
    for i in range(1, len(rows)):
        a, b = rows[i - 1], rows[i]
        n = 0
        for x, y in zip(a, b, strict=False):
            if x != y:
                break
            n += 1
        out[i] = n
    return out


def matched(head: np.ndarray, n: np.ndarray, first: np.ndarray, place: np.ndarray, after: list[list[bytes]], before: list[list[bytes]], window: int, places: int) -> tuple[np.ndarray, np.ndarray]:
    """For entries sorted by (head, after): whether each window of an entry's is repeated, and whether it stands first in the entry.

    first: the entries' order by their first places; n: how many suffixes an entry stands for. A row per entry, a column per
    window of its stretch, from the first on.
    """
    back, last = place // 64 % 64, place % 64
    right = common_words(after)
    right[1:][head[1:] != head[:-1]] = 0
    run = np.cumsum(right < window - places + 1)
    by_left = np.array(sorted(range(len(before)), key=lambda i: (run[i], before[i])), np.int64)
    left = common_words([before[i] for i in by_left])
    left[1:][run[by_left][1:] != run[by_left][:-1]] = -1
    left[:1] = -1
    again, own = np.zeros((len(n), 64), bool), np.zeros((len(n), 64), bool)
    group = np.zeros(len(n), np.int64)
    for d in range(places):  # words of the window before the suffix
        held = np.flatnonzero((back >= d) & (back - d <= last))
        if not len(held):
            continue
        group[by_left] = np.cumsum(left < d)
        same = np.cumsum(right < window - d) * (len(n) + 1) + group
        _, at = np.unique(same[held], return_inverse=True)
        total = np.bincount(at, n[held])
        least = np.full(len(total), np.iinfo(np.int64).max)
        np.minimum.at(least, at, first[held])
        again[held, (back - d)[held]] = total[at] > 1
        own[held, (back - d)[held]] = least[at] == first[held]
    return again, own


def _spans(kept: np.ndarray, window: int) -> list[dict]:
    """The union of windows, in words from the first window's start."""
    at = np.flatnonzero(kept)
    return [{"start": a, "end": b} for a, b in _joined(at, at + window)]


def _sorted_entries(contexts: DataFrame, window: int, places: int) -> DataFrame:
    """(head, stretch, spans, rest) of entries: the union of their repeated windows, and of those that stand first elsewhere."""

    def judged(rows: list[tuple]) -> pa.RecordBatch:
        rows = [(*r[:6], r[6].split(b" "), r[7].split(b" ") if r[7] else []) for r in rows]
        rows.sort(key=lambda r: (r[0], r[6], r[7], r[1]))  # by words: bytes below the space would come between
        rows = [r for i, r in enumerate(rows) if not i or r[:2] != rows[i - 1][:2]]  # a row of docs may be there twice
        head, stretch, n, doc, tag, place = (np.array(x, np.int64) for x in list(zip(*rows, strict=True))[:6])
        first = np.empty(len(rows), np.int64)
        first[np.lexsort([place // 4096, tag, doc])] = np.arange(len(rows))
        again, own = matched(head, n, first, place, [r[6] for r in rows], [r[7] for r in rows], window, places)
        spans = [_spans(x, window) for x in again]
        rest = [_spans(x, window) if x.any() else [] for x in again & ~own]
        return pa.RecordBatch.from_arrays([pa.array(head), pa.array(stretch), pa.array(spans, _SPANS), pa.array(rest, _SPANS)], names=["head", "stretch", "spans", "rest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(rows) >= SORTED and row[0] != rows[-1][0]:  # whole heads
                    yield judged(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield judged(rows)

    ordered = contexts.repartition("head").sortWithinPartitions("head", "after", "before", "stretch")
    return mapped(ordered, run, f"head long, stretch long, spans {SPAN}, rest {SPAN}")


def _grouped_entries(docs: DataFrame, window: int) -> DataFrame:
    """As _sorted_entries, by hashes of the windows: nothing is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, tag, text, (head, stretch, n, place) in _of_entries(batches):
            words = Words([text], lower=False)
            size = place % 64 + 1
            of = np.repeat(np.arange(len(place)), size)
            offset = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            start = (place // 4096 - place // 64 % 64)[of] + offset
            content = span_hash(prefix_sums(words.hash), start, start + window).view(np.int64)
            same = [np.full(len(of), x, np.int64) for x in (doc, tag)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (head[of], content, stretch[of], offset.astype(np.int32), n[of], *same, start.astype(np.int32))], names=["head", "content", "stretch", "offset", "n", "doc_id", "tag", "start"])

    windows = mapped(docs, run, "head long, content long, stretch long, offset int, n long, doc_id long, tag long, start int")
    windows = written(windows.dropDuplicates(["head", "stretch", "offset"]), "passages-windows")
    place = F.struct("doc_id", "tag", "start")
    groups = windows.groupBy("head", "content").agg(F.sum("n").alias("n_"), F.count(F.lit(1)).alias("rows"), F.min(place).alias("first")).where("n_ > 1").drop("n_")
    found = counted_join(windows, written(groups, "passages-first"), ["head", "content"], "rows").select("head", "stretch", "offset", (place == F.col("first")).alias("own"))
    gathered = found.groupBy("head", "stretch").agg(F.collect_list(F.struct("offset", "own")).alias("found"))  # 26 at most

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("found"):
                again, own = np.zeros(64, bool), np.zeros(64, bool)
                offset = x.values.field("offset").to_numpy(zero_copy_only=False)
                again[offset], own[offset] = True, x.values.field("own").to_numpy(zero_copy_only=False).astype(bool)
                out.append((_spans(again, window), _spans(again & ~own, window)))
            yield pa.RecordBatch.from_arrays([batch.column("head"), batch.column("stretch"), *(pa.array([x[k] for x in out], _SPANS) for k in range(2))], names=["head", "stretch", "spans", "rest"])

    return mapped(gathered, spans, f"head long, stretch long, spans {SPAN}, rest {SPAN}")


def _joined(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of spans, as spans that don't touch."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    return list(zip(starts[new].tolist(), ends[np.r_[np.flatnonzero(new)[1:] - 1, len(ends) - 1]].tolist(), strict=True))


def tagged(docs: DataFrame, tag: str = "tag") -> DataFrame:
    """docs with a hash of the text, which tells rows with the same doc_id apart."""
    return docs.withColumn(tag, F.xxhash64(F.col("text").cast("string")))


def repeated_passages(docs: DataFrame, window: int = WINDOW, places: int = PLACES) -> DataFrame:
    """(doc_id, tag, spans, cuts) for each document with a repeated passage, in words from the text's start.

    spans: the union of its repeated windows. cuts: the union of those windows whose content stands first elsewhere, by
    (doc_id, tag, position). tag: the text's hash, as `tagged` has it: rows of one doc_id with several texts are
    documents of their own. Words are runs of bytes other than 0x20 and 0x09 to 0x0D, compared as they are. Null and empty texts
    and those of fewer words than a window repeat nothing; null doc_ids take no part. Rows of the same doc_id and
    text repeat each other, are one row here, and what they share stands first in each of them. An empty table gives no rows; texts
    are read whole; other columns play no part.
    """
    if not 0 < places <= min(64, window - GRAM):
        raise ValueError("places must be 1 to 64, and leave five words of a window")
    small_batches(docs.sparkSession, size=BATCH_BYTES)
    docs = tagged(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    # joins are by shuffles at every size: their sides grow with the documents
    suffixes = written(_suffixes(docs, window, places), "passages-suffixes")
    equal = written(suffixes.groupBy("head").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "passages-equal")
    held = written(counted_join(suffixes, equal, ["head"], "rows", most=0), "passages-kept")
    dropped(suffixes, equal)
    entries = written(held.groupBy("head", "stretch").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "tag", "place")).alias("first")), "passages-entries")
    several = written(entries.groupBy("head").agg(F.count(F.lit(1)).alias("rows"), F.count(F.lit(1)).alias("entries")).where("rows > 1"), "passages-heads")
    open_ = written(counted_join(entries, several, ["head"], "rows"), "passages-open")

    def fetched(some: DataFrame) -> DataFrame:
        """The texts of the entries' first places."""
        asked = written(some.groupBy("first.doc_id", "first.tag").agg(F.collect_list(F.struct("head", "stretch", "n", "first.place")).alias("entries")), "passages-asked")
        return docs.join(asked.hint("merge"), ["doc_id", "tag"])

    parts = [written(_sorted_entries(_contexts(fetched(open_.where(F.col("entries") <= MOST_ENTRIES)), window), window, places), "passages-sorted")]
    if (hot := open_.where(F.col("entries") > MOST_ENTRIES)).limit(1).count():
        parts.append(written(_grouped_entries(fetched(hot), window), "passages-grouped"))
    size = (F.col("first.place") % 64).cast("int") + window
    whole = F.array(F.struct(F.lit(0).alias("start"), size.alias("end"))).cast(SPAN)
    alone = small_join(entries.where("n > 1"), several.select("head"), ["head"], "left_anti").select("head", "stretch", "n", "first", whole.alias("spans"), F.array().cast(SPAN).alias("rest"))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    result = alone.unionByName(open_.select("head", "stretch", "n", "first").join(found, ["head", "stretch"])).where(F.size("spans") > 0)
    result = written(result, "passages-found")
    dropped(entries, several, open_, *parts)

    low = F.floor(F.col("place") / 4096).cast("int") - (F.floor(F.col("place") / 64) % 64).cast("int")
    shifted = lambda c: F.transform(c, lambda x: F.struct((x["start"] + F.col("low")).alias("start"), (x["end"] + F.col("low")).alias("end")))
    places_ = counted_join(held, result, ["head", "stretch"], "n", most=0).withColumn("low", low)
    cuts = F.when(F.struct("doc_id", "tag", "place") == F.col("first"), F.col("rest")).otherwise(F.col("spans"))
    gathered = places_.select("doc_id", "tag", shifted(F.col("spans")).alias("spans"), shifted(cuts).alias("cuts")).groupBy("doc_id", "tag").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "cuts")))

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for column in ("spans", "cuts"):
                ends = ((x.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end")) for x in batch.column(column))
                out.append(pa.array([[{"start": a, "end": b} for a, b in _joined(*x)] for x in ends], _SPANS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), *out], names=["doc_id", "tag", "spans", "cuts"])

    return mapped(gathered, passages, f"doc_id long, tag long, spans {SPAN}, cuts {SPAN}")


def cut_text(text: bytes, cuts: list[tuple[int, int]]) -> bytes:
    """The text without the words of the cuts and the white space that follows each cut."""
    words = Words([text], lower=False, hashes=False)
    starts = np.r_[words.start, len(text)]
    out, at = [], 0
    for a, b in cuts:
        out.append(text[at : starts[a]])
        at = starts[b]
    return b"".join([*out, text[at:]])


def without_repeats(docs: DataFrame, window: int = WINDOW, places: int = PLACES) -> DataFrame:
    """docs with each repeated passage cut but at its first place; a column n_chars becomes the new text's length.

    All other columns and all rows are kept, also those whose text becomes empty; texts without a cut are not touched.
    """
    name, tag = free_name(docs, "__cuts"), free_name(docs, "__tag")
    found = written(repeated_passages(docs, window, places).where(F.size("cuts") > 0).select("doc_id", F.col("tag").alias(tag), F.col("cuts").alias(name)), "passages-cuts")
    joined = small_join(tagged(docs, tag), found, ["doc_id", tag], "left")

    @F.pandas_udf("string")
    def cut(text, cuts):  # noqa: ANN001, ANN202
        return text.combine(cuts, lambda t, c: t if t is None or c is None else cut_text(t.encode(), [(x["start"], x["end"]) for x in c]).decode())

    # rows without a cut don't go to Python: the two kinds are taken apart by a filter
    changed = joined.where(F.col(name).isNotNull()).withColumn("text", cut(F.col("text").cast("string"), name))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    order = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    return changed.select(order).unionByName(joined.where(F.col(name).isNull()).select(order))
