"""A toxicity classifier by non-negative positive-unlabelled learning.

It learns from confirmed toxic texts and from unlabelled ones, which hold toxic texts too, at the rate of the class
prior. A text's features are indicators of its words and of their first letters. The risk is

    prior * risk(positives as positive) + max(0, risk(unlabelled as negative) - prior * risk(positives as negative));

where the bracket of a batch is negative, the step goes against its gradient, so that the model doesn't fit negative
risk. The loss is logistic, so scores estimate probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._shared import first_by_hash, for_training, kept_beside, packed, raw_texts, slices, small_batches, small_join, unpacked
from millrace.llm._text import NO_LETTER, Words, mixed

#: Buckets of features; texts of either kind that are learnt from (the smallest hashes of doc_id); letters of the word
#: starts; toxic texts that must hold a feature (so many, and such a share of them), how much likelier it must be in toxic
#: texts than in others, and by how many standard deviations.
BUCKETS, SAMPLE, STARTS, LEAST_TEXTS, LEAST_SHARE, LIKELIER, SURE = 1 << 20, 8_000, (4, 5, 6, 7, 8), 6, 0.006, 2.5, 5.0
STEPS, BATCH, RATE, SHRINK = 1_500, 8_192, 0.05, 3e-4


def indicators(texts: list[bytes], keep: np.ndarray | None = None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) but once each, of the buckets that `keep` holds for."""
    words = Words(texts, between=NO_LETTER)
    text = np.searchsorted(words.first, np.arange(len(words.hash)), "right") - 1
    both = []
    for salt, size in enumerate((None, *STARTS)):
        h = words.hash if size is None else words.hashed(np.minimum(words.start + size, words.end))
        long = slice(None) if size is None else words.end - words.start > size
        found = (mixed(h[long] + np.uint64(salt + 1)) % np.uint64(buckets)).astype(np.int64)
        of = text[long]
        if keep is not None:
            held = keep[found]
            of, found = of[held], found[held]
        both.append(of * buckets + found)
    both = np.unique(np.concatenate(both))
    return both // buckets, both % buckets


@dataclass
class Model:
    buckets: np.ndarray  # sorted
    weight: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.full = np.zeros(BUCKETS)
        self.full[self.buckets] = self.weight

    def score(self, texts: list[bytes]) -> np.ndarray:
        of, found = indicators(texts, self.full != 0)
        z = np.bincount(of, self.full[found], len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def dump(self) -> bytes:
        return packed(self.buckets.astype(np.int64), self.weight, np.array([self.bias]))

    @staticmethod
    def load(blob: bytes) -> Model:
        buckets, weight, bias = unpacked(blob)
        return Model(buckets, weight, float(bias[0]))


def distinct(rows: list[np.ndarray], common: float = 0.05) -> list[np.ndarray]:
    """The texts without later copies and near copies, told by least hashes of the features that few texts hold."""
    if not rows:
        return rows
    rare = np.bincount(np.concatenate(rows), minlength=BUCKETS) <= max(2, common * len(rows))
    seen: list[set[tuple]] = [set(), set(), set()]
    out = []
    for x in rows:
        held = x[rare[x]].astype(np.uint64)
        if len(held) < 4:  # too few to tell a near copy by
            names = [(x.tobytes(),)] * 3
        else:
            least = [int(mixed(held + np.uint64(salt << 32)).min()) for salt in range(1, 7)]
            names = [tuple(least[k : k + 2]) for k in (0, 2, 4)]
        if not any(name in known for name, known in zip(names, seen, strict=True)):
            out.append(x)
        for name, known in zip(names, seen, strict=True):
            known.add(name)
    return out


def loss(rows: list[np.ndarray], sign: float, weight: np.ndarray, bias: float) -> tuple[float, np.ndarray]:
    """The mean logistic loss of texts, as arrays of features, taken as of a class (1 or -1), and its gradient (the bias last)."""
    size = np.array([len(x) for x in rows])
    of, found = np.repeat(np.arange(len(rows)), size), np.concatenate(rows)
    z = np.bincount(of, weight[found], len(rows)) + bias
    slope = -sign / (1 + np.exp(np.clip(sign * z, -40, 40))) / len(rows)
    return float(np.logaddexp(0, -sign * z).mean()), np.append(np.bincount(found, slope[of], len(weight)), slope.sum())


def risk(positive: list[np.ndarray], unlabelled: list[np.ndarray], weight: np.ndarray, bias: float, prior: float) -> tuple[float, float, np.ndarray]:
    """The non-negative risk, its bracket, and the direction to step against: the gradient, or, where the bracket is negative, the bracket's turned."""
    (as_positive, up), (as_negative, down) = (loss(positive, sign, weight, bias) for sign in (1, -1))
    other, un = loss(unlabelled, -1, weight, bias)
    bracket = other - prior * as_negative
    slope = prior * up + un - prior * down if bracket >= 0 else prior * down - un
    return prior * as_positive + max(0.0, bracket), bracket, slope


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = STEPS, seed: int = 11) -> Model:
    """Texts as arrays of distinct buckets; copies count once. Without texts of either kind the score is the prior."""
    positive, unlabelled = distinct(positive), distinct(unlabelled)
    prior = min(max(prior, 1e-3), 0.999)
    start = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Model(np.zeros(0, np.int64), np.zeros(0), start)
    p, u = (np.bincount(np.concatenate(x), minlength=BUCKETS) for x in (positive, unlabelled))
    ratio = ((p + 0.5) / (len(positive) + 1)) / ((u + 0.5) / (len(unlabelled) + 1))
    expected = len(positive) * (u + 0.5) / (len(unlabelled) + 1)
    sure = (p - expected) / np.sqrt(expected * (1 + len(positive) / len(unlabelled)))
    used = np.flatnonzero((sure >= SURE) & (p >= min(max(LEAST_TEXTS, LEAST_SHARE * len(positive)), len(positive))) & (ratio >= min(LIKELIER, 0.5 / prior)))
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    rows = [[r[r >= 0] for r in (place[x] for x in kind)] for kind in (positive, unlabelled)]
    weight, bias, rng = np.zeros(len(used)), start, np.random.default_rng(seed)
    first, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1)

    for step in range(1, steps + 1):
        # large batches: the bracket of a small one is often negative by chance, which holds scores near the prior
        batch = ([kind[i] for i in rng.choice(len(kind), BATCH, replace=False)] if len(kind) > BATCH else kind for kind in rows)
        _, _, slope = risk(*batch, weight, bias, prior)
        slope[:-1] += SHRINK * weight
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
        move = RATE * (1 - step / (steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    return Model(used, weight, float(bias))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, prior: float | None = None) -> Model:
    """Fit on at most `sample` confirmed toxic documents and as many documents whatever their labels, of those for training.

    prior: the share of toxic documents; if None, their share of the labelled documents for training. A document with
    several labels has the largest; null labels and null doc_ids teach nothing.
    """
    small_batches(docs.sparkSession)
    known = labels.where(for_training() & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    if prior is None:
        prior = known.agg(F.avg("label")).first()[0] or 0.01
    some = first_by_hash(known.where("label = 1").select("doc_id"), sample).withColumn("__kind", F.lit(0))
    chosen = some.unionByName(first_by_hash(docs.where(for_training() & F.col("doc_id").isNotNull()).select("doc_id"), sample).withColumn("__kind", F.lit(1)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b)):
            of, found = indicators(raw_texts(batch))
            cut = np.searchsorted(of, np.arange(1, batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__kind"), pa.array([x.astype(np.int32).tobytes() for x in np.split(found, cut)], pa.binary())], names=["doc_id", "kind", "found"])

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("kind", "doc_id", "found")), strict=True)), key=lambda x: x)
        made = fit(*([np.frombuffer(x[2], np.int32) for x in got if x[0] == kind] for kind in (0, 1)), prior)
        yield pa.RecordBatch.from_arrays([pa.array([made.dump()], pa.binary())], names=["model"])

    found = small_join(docs.select("doc_id", F.col("text").cast("string").alias("text")), chosen, ["doc_id"]).mapInArrow(rows, "doc_id long, kind int, found binary")
    made = found.repartition(1).mapInArrow(model, "model binary").collect()
    return Model.load(made[0].model) if made else fit([], [], prior)


def scored(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """docs with the probability that each whole text is toxic.

    Null and empty texts, and texts without a known feature, get the model's score of no features; equal texts get equal
    scores; an empty table gives an empty one. Only the text is used; a column named as `out` is replaced.
    """
    small_batches(docs.sparkSession)
    blob = docs.sparkSession.sparkContext.broadcast(model.dump())
    rows, keep, text, fields = kept_beside(docs, "text", [out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.load(blob.value)
        for batch in (part for b in batches for part in slices(b, text)):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(own.score(raw_texts(batch, text)))], names=[*keep, out])

    return rows.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.DoubleType())]))
