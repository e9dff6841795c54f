"""The operators' queries over the given tables, and their DuckDB forms where SQL has one."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import latent_leaks, piece_codec, pivot_index, ppm_scores, quality_nbsvm, signature_join, suffix_dedup, token_counts, toxicity_pu, warc_bundles
from millrace.session import shared_folder

QUERIES: dict = {}
ORACLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_passages(table(spark, sf_dir, "documents")).withColumn("span", F.explode("spans"))
    inside = F.filter("cuts", lambda c: (c["start"] >= F.col("span.start")) & (c["end"] <= F.col("span.end")))
    cut = F.aggregate(inside, F.lit(0), lambda n, c: n + c["end"] - c["start"])
    return found.select("doc_id", F.col("span.start").alias("start_word"), F.col("span.end").alias("end_word"), cut.alias("cut_words"))


def op2_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/millrace/warc-{uuid.uuid4().hex}"
    warc_bundles.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc_bundles.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_ppm_scores(spark: SparkSession, sf_dir: str, scores=ppm_scores.scores) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return scores(table(spark, sf_dir, "documents"), ~held_out).withColumn("held_out", held_out)


def _classified(spark: SparkSession, sf_dir: str, classifier, least: float) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifier.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return classifier.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op4_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, quality_nbsvm, 0.7)


def op5_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent_leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.linked(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", F.col("component").alias("component_id"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op8_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, toxicity_pu, 0.3)


def op10_digest(coded: DataFrame) -> DataFrame:
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.concat_ws(" ", F.col("ids").cast("array<string>"))).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return op10_digest(piece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")))


QUERIES |= {f.__name__: f for f in (op1_suffix_dedup, op2_seekable_warc, op3_ppm_scores, op4_quality_nbsvm, op5_latent_leaks, op6_signature_join, op7_token_counts, op8_pivot_index, op9_toxicity_pu, op10_piece_codec)}

def unigram_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op3 SQL can express: all its columns but the model's own score."""
    kept = op3_ppm_scores(spark, sf_dir, ppm_scores.base_scores).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))
    return kept


def pivot_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 with all rows of each shard ranked again, which SQL can express."""
    found = pivot_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, share=1.0)
    return found.withColumn("score", F.round("score", 6))


QUERIES |= {f.__name__: f for f in (unigram_base, pivot_exact)}

ORACLES["pivot_exact"] = """
with e as (select vec_id, embedding::double[] as v from embeddings where embedding is not null),
p as (select q.vec_id as query_id, e.vec_id, list_inner_product(q.v, e.v) as s from e q join e on q.vec_id % 20 = 0 and q.vec_id <> e.vec_id),
r as (select *, (row_number() over (partition by query_id order by s desc, vec_id))::int as rank from p)
select query_id, rank, vec_id, round(s, 6) as score from r where rank <= 20
"""

ORACLES["op2_seekable_warc"] = """
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as x from pages),
r as (select *, max(page_id) over (partition by x) as newest from p)
select page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(x, (1 + 5 * (k // 4))::int, 5))::bigint >> (15 - 5 * (k % 4))::int) & 31))::int, 1)), 'string_agg', '') as payload_digest,
  case when newest is distinct from page_id then 'revisit' else 'response' end as record_type,
  case when newest is distinct from page_id then newest end as refers_to
from r
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
_CRC_SQL = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, 1 + length(doc_id::varchar)), lambda i: ascii((doc_id::varchar)[i])::bigint)), lambda s, x: xor(t[(xor(s, x) & 255) + 1], s >> 8)), 4294967295)"
ORACLES["unigram_base"] = f"""
with t as materialized (select list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, range(8)::bigint[]), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))) as t),
d as (select doc_id, {_CRC_SQL} % 7 = 2 as held_out, list_append({_WORDS}, ' end') as w from documents, t),
x as (select doc_id, held_out, unnest(w) as g from d),
c as (select g, count(*) as n from x where not held_out group by g),
s as (select sum(n)::bigint as n, count(*) as v from c)
select doc_id, held_out, count(*) as n_tokens, count(c.n) as n_known, any_value(s.n) as train_tokens,
  round(sum(log10((coalesce(c.n, 0) + 1) / (s.n + s.v + 1))), 3) as base_score
from x left join c on x.g = c.g cross join s group by doc_id, held_out
"""
ORACLES["op6_signature_join"] = f"""
with recursive w as (select doc_id, {_WORDS} as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w),
e as (select doc_id, len(s) as n, unnest(s) as g from sets),
links as (select a.doc_id as a, b.doc_id as b from e a join e b on a.g = b.g and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join links l on r.b = l.a)
select s.doc_id, len(s.s)::bigint as n_shingles, r.component_id
from sets s join (select a, min(b) as component_id from reach group by a) r on s.doc_id = r.a
"""

ORACLES["op1_suffix_dedup"] = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
x as (select doc_id, unnest(range(0, len(w) - 49)) as s, w from w where len(w) >= 50),
y as (select doc_id, s, array_to_string(w[s + 1:s + 50], ' ') as g from x),
z as (select doc_id, s, count(*) over (partition by g) as n, row_number() over (partition by g order by doc_id, s) > 1 as later from y),
r as (select doc_id, s, later from z where n > 1),
i as (select *, sum(case when s <= p + 50 then 0 else 1 end) over (partition by doc_id order by s) as k from (select *, lag(s) over (partition by doc_id order by s) as p from r)),
spans as (select doc_id, min(s) as a, max(s) + 50 as b from i group by doc_id, k),
j as (select *, sum(case when s <= p + 50 then 0 else 1 end) over (partition by doc_id order by s) as k from (select doc_id, s, lag(s) over (partition by doc_id order by s) as p from r where later)),
cuts as (select doc_id, min(s) as a, max(s) + 50 as b from j group by doc_id, k)
select spans.doc_id, spans.a::int as start_word, spans.b::int as end_word, coalesce(sum(cuts.b - cuts.a), 0)::int as cut_words
from spans left join cuts on spans.doc_id = cuts.doc_id and cuts.a >= spans.a and cuts.b <= spans.b group by spans.doc_id, spans.a, spans.b
"""
