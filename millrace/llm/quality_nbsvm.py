"""A quality classifier: naive Bayes support vectors.

A text's features are indicators of its n-grams: single words and pairs of words, and up to three successive word shapes
(letter case, digits, signs, length, whether the word repeats the one before). Each indicator is scaled by its class
log-count ratio, texts are brought to unit length, and a linear model with hinge loss is fitted by dual coordinate
descent. Margins become probabilities by a logistic curve fitted to the training margins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._shared import BATCH_BYTES, FEW_BYTES, first_by_hash, for_training, kept_beside, mapped, packed, raw_texts, slices, small_batches, small_join, unpacked, written
from millrace.llm._text import Words, mixed, runs

#: Buckets of features; labelled rows that are learnt from (those with the smallest hashes of doc_id); texts that must
#: hold a feature; passes, and the cost of an error.
BUCKETS, SAMPLE, LEAST_TEXTS, PASSES, COST = 1 << 18, 12_000, 8, 12, 4.0


def _shapes(words: Words) -> np.ndarray:
    """A small code of each word's form."""
    b = words.buffer
    count = lambda mask: (s := np.concatenate([[0], np.cumsum(mask)]))[words.end] - s[words.start]
    lower, upper, digit = (count((b >= x) & (b <= y)) for x, y in ((97, 122), (65, 90), (48, 57)))
    wide = count(b >= 128)
    size = words.end - words.start
    sign = size - lower - upper - digit - wide
    again = np.zeros(len(size), bool)
    again[1:] = words.hash[1:] == words.hash[:-1]
    again[words.first[:-1][words.first[:-1] < len(size)]] = False
    last = np.where(sign > 0, b[words.end - 1] if len(size) else 0, 0)
    code = np.zeros(len(size), np.uint64)
    for part in (lower > 0, np.minimum(upper, 3), digit > 0, wide > 0, np.minimum(sign, 4), np.minimum(np.log2(np.maximum(size, 1)).astype(int), 5), again, last):
        code = code * np.uint64(257) + part.astype(np.uint64)
    return mixed(code + np.uint64(0x51ED27))


def features(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram, with repetitions."""
    words = Words(texts, lower=False)
    shapes = _shapes(words)
    text = np.searchsorted(words.first, np.arange(len(words.hash)), "right") - 1
    of, found = [], []
    for salt, (h, size) in enumerate(((words.hash, 1), (words.hash, 2), (shapes, 1), (shapes, 2), (shapes, 3))):
        n = len(h) - size + 1
        if n > 0:
            inside = text[:n] == text[size - 1 :]
            of.append(text[:n][inside])
            found.append((mixed(runs(h, size) + np.uint64(salt + 1))[inside] % np.uint64(buckets)).astype(np.int64))
    return (np.concatenate(of), np.concatenate(found)) if of else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def indicators(texts: list[bytes], keep: np.ndarray | None = None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) but once each, of the buckets that `keep` holds for."""
    of, found = features(texts, buckets)
    if keep is not None:
        held = keep[found]
        of, found = of[held], found[held]
    both = np.unique(of * buckets + found)
    return both // buckets, both % buckets


@dataclass
class Model:
    ratio: np.ndarray  # log-count ratios, 0 for features that aren't used
    weight: np.ndarray  # of the scaled indicators
    bias: float
    slope: float
    middle: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        of, found = indicators(texts, self.ratio != 0, len(self.ratio))
        r = self.ratio[found]
        dot = np.bincount(of, r * self.weight[found], len(texts))
        length = np.sqrt(np.bincount(of, r * r, len(texts)))
        margin = dot / np.maximum(length, 1e-9) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * (margin - self.middle), -40, 40)))

    def dump(self) -> bytes:
        return packed(self.ratio.astype(np.float32), self.weight.astype(np.float32), np.array([self.bias, self.slope, self.middle]))

    @staticmethod
    def load(blob: bytes) -> Model:
        ratio, weight, rest = unpacked(blob)
        return Model(ratio, weight, *map(float, rest))


def fit(rows: list[np.ndarray], label: np.ndarray, buckets: int = BUCKETS, passes: int = PASSES, cost: float = COST, seed: int = 7) -> Model:
    """rows: the distinct buckets of each text; label: 0 or 1. Rows of one class, or none, give a constant score."""
    n, y = len(rows), np.where(label > 0, 1.0, -1.0)
    ratio, weight = np.zeros(buckets), np.zeros(buckets)
    if not n or (label > 0).all() or not (label > 0).any():
        return Model(ratio, weight, 0.0, 0.0 if not n else 40.0 * (1 if y[0] > 0 else -1), -1.0)
    flat, ends = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    held = np.repeat(label > 0, [len(r) for r in rows])
    p, q = np.bincount(flat[held], minlength=buckets), np.bincount(flat[~held], minlength=buckets)
    used = p + q >= min(LEAST_TEXTS, max(1, n // 20))
    p, q = np.where(used, p + 1.0, 0), np.where(used, q + 1.0, 0)
    ratio[used] = np.log((p[used] / p.sum()) / (q[used] / q.sum()))
    texts = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        f = flat[a:b][ratio[flat[a:b]] != 0]
        x = ratio[f]
        texts.append((f, x / max(np.sqrt((x * x).sum()), 1e-9)))
    # errors of the rarer class cost more, so that both weigh the same; the bias is a feature that is always 1
    most = np.where(y > 0, cost * n / (2 * (y > 0).sum()), cost * n / (2 * (y < 0).sum()))
    alpha, bias, rng = np.zeros(n), 0.0, np.random.default_rng(seed)
    square = np.array([x @ x for _, x in texts]) + 1.0
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(n):
            f, x = texts[i]
            slope = y[i] * (weight[f] @ x + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), most[i])
            step = (new - alpha[i]) * y[i]
            if step:
                worst = max(worst, abs(step))
                alpha[i] = new
                weight[f] += step * x
                bias += step
        if worst < 1e-3:
            break
    margin = np.array([weight[f] @ x for f, x in texts]) + bias
    a, b = 1.0, 0.0
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    for _ in range(50):  # Newton steps of a logistic curve
        z = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        s, d = z * (1 - z), z - target
        h = np.array([[(s * margin * margin).sum() + 1e-6, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([(d * margin).sum(), d.sum()]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return Model(ratio, weight, bias, a, -b / a if a else 0.0)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled documents: those for training with the smallest hashes of doc_id.

    A document with several labels has the largest; null labels and null doc_ids teach nothing.
    """
    small_batches(docs.sparkSession, size=BATCH_BYTES)
    known = labels.where(for_training() & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("__label"))
    chosen = first_by_hash(known, sample)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, most=FEW_BYTES)):
            of, found = indicators(raw_texts(batch))
            cut = np.searchsorted(of, np.arange(1, batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__label"), pa.array([x.astype(np.int32).tobytes() for x in np.split(found, cut)], pa.binary())], names=["doc_id", "label", "found"])

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "label", "found")), strict=True)), key=lambda x: (x[0], x[2]))
        made = fit([np.frombuffer(x[2], np.int32) for x in got], np.array([x[1] for x in got]))
        yield pa.RecordBatch.from_arrays([pa.array([made.dump()], pa.binary())], names=["model"])

    found = mapped(small_join(docs.select("doc_id", F.col("text").cast("string").alias("text")), chosen, ["doc_id"]), rows, "doc_id long, label int, found binary")
    made = mapped(found.repartition(1), model, "model binary").collect()
    return Model.load(made[0].model) if made else fit([], np.zeros(0))


def scored(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for each whole text, higher if label 1 is likelier.

    Null and empty texts, and texts without a known n-gram, get the model's score of no features; equal texts get equal
    scores; an empty table gives an empty one. Only the text is used; a column named as `out` is replaced.
    """
    small_batches(docs.sparkSession, size=BATCH_BYTES)
    blob = docs.sparkSession.sparkContext.broadcast(model.dump())
    rows, keep, text, fields = kept_beside(docs, "text", [out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.load(blob.value)
        for batch in (part for b in batches for part in slices(b, text, FEW_BYTES)):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(own.score(raw_texts(batch, text)))], names=[*keep, out])

    return mapped(rows, run, T.StructType([*fields, T.StructField(out, T.DoubleType())]))
