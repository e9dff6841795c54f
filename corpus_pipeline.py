"""The corpus pipeline: each stage reads what the one before it kept, and its decisions take effect.

1. Quality: documents that the classifier rejects go.
2. Near duplicates: of each group of documents linked by shingles, the one with the smallest doc_id stays.
3. Repeated passages: each stands at its first place only; documents stay, with shorter texts.
4. Benchmark leaks: documents that hold a benchmark item go.
5. Tokens: what is left is encoded and decoded.

Null texts count as empty in every stage; rows with a null doc_id are in no group, and stay. Of rows with one doc_id and
several texts, stages 1 and 3 decide each by its own text; stages 2 and 4 keep or drop them together, by the text
that counts (2) or by any (4). An empty table passes through. Columns beside those of documents are kept by stages 1 to 4.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import latent_leaks, piece_codec, quality_nbsvm, signature_join, suffix_dedup
from millrace.llm._shared import free_name, small_join, written
from millrace.llm.queries import op10_digest, table

#: The least score of a document that stays.
LEAST_QUALITY = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least LEAST_QUALITY."""
    model = quality_nbsvm.train(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "__score")
    return quality_nbsvm.scored(docs, model, score).where(F.col(score) >= LEAST_QUALITY).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of each component that has its smallest doc_id."""
    gone = signature_join.linked(docs).where("component < doc_id").select("doc_id").distinct()
    return small_join(docs, written(gone, "pipeline-copies"), ["doc_id"], "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each repeated passage cut but at its first place."""
    return suffix_dedup.without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    gone = latent_leaks.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return small_join(docs, written(gone, "pipeline-leaks"), ["doc_id"], "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left."""
    coded = piece_codec.encode_decode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return op10_digest(coded)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]
#: Neither the classifier nor the latent search nor the tokenizer has a form in SQL: the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; what each stage keeps is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
