"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, embedding_dedup, exact_dedup, hilbert_shards, jaccard_join, language_id, packing, perspectives, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_holdout(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate_perspectives(spark, table(spark, sf_dir, "conversations"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(spark, docs.where(~in_holdout(F.col("doc_id"))))
    found = language_id.identify(spark, docs, model)
    return found.select("doc_id", in_holdout(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(spark, table(spark, sf_dir, "documents"), 4, 85, 100)


def op5_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_through_warc(spark, table(spark, sf_dir, "pages"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_duplicates(spark, table(spark, sf_dir, "embeddings"), 0.95)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(spark, table(spark, sf_dir, "documents"))


def op9_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.hilbert_shards(spark, table(spark, sf_dir, "documents"), 16)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(spark, docs, toxicity.fit(spark, docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_harmonic_packing, op2_perspective_rotation, op3_language_id, op4_jaccard_join, op5_chunked_warc, op6_byte_bpe, op7_embedding_dedup, op8_exact_dedup, op9_hilbert_sharding, op10_toxicity)
}

_OP8 = r"""
with texts as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
groups as (select norm, min(doc_id) as keep_id, count(*) as group_size from texts group by norm)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(texts.norm) as text_sha256 from texts join groups on texts.norm = groups.norm
"""

_OP5 = """
with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages),
first as (select html, min(page_id) as page_id from p where n >= 100 group by html)
select p.page_id, cast(n as bigint) as payload_bytes, sha256(p.html) as payload_digest,
  case when first.page_id is null or first.page_id = p.page_id then 'response' else 'revisit' end as record_type,
  case when first.page_id <> p.page_id then first.page_id end as refers_to
from p left join first on n >= 100 and p.html = first.html
"""

ORACLES: dict[str, str] = {"op2_perspective_rotation": perspectives.ORACLE, "op5_chunked_warc": _OP5, "op8_exact_dedup": _OP8}
