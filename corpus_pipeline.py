"""From raw documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes it and hands what it reads back to the next.

All stages but the last keep or drop whole rows, never by id alone: ids may be
null or repeat, and each row is judged by its own text. Null, empty and
letterless texts go in the first stage; given to a later one, they are clean
(toxicity), equal to each other (exact dedup: null, empty and blank texts are
two groups, nothing and one space), linked with nothing (near copies) and the
end token alone (packing). Texts are read whole, however long. Columns beyond
``doc_id``, ``text`` and ``lang`` are carried along and never read, whatever
their names. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import exact_dedup, jaccard_join, language_id, packing, toxicity
from driftline.llm.queries import in_holdout, table
from driftline.llm.storage import Workspace, small_or_shuffled


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects, letterless ones included."""
    model = language_id.fit(spark, docs.where(~in_holdout(F.col("doc_id"))))
    return language_id.identify(spark, docs, model, whole_rows=True).where("not rejected").select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose severity is more likely above zero than not."""
    model = toxicity.fit(spark, docs, table(spark, sf_dir, "labels"))
    return toxicity.score(spark, docs, model, whole_rows=True).where("not toxic").select("row.*")


def _one_of_each(docs: DataFrame, found: DataFrame, sign: Column, name: str) -> DataFrame:
    """``docs`` without the rows that ``found(doc_id, text_sha256, kept)`` drops
    by id and signed text, and one row of those that it keeps together."""
    work = Workspace(docs.sparkSession, name)
    counts = work.write(found.groupBy("doc_id", "text_sha256").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"), "changed")
    changed = small_or_shuffled(counts.select(F.col("doc_id").alias("other_id"), F.col("text_sha256").alias("other_sha"), F.col("kept").alias("stays")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), sign.alias("sha"))
    marked = rows.join(changed, F.col("id").eqNullSafe(F.col("other_id")) & F.col("sha").eqNullSafe(F.col("other_sha")), "left")
    rest = marked.where("stays is null").select("row.*")
    return rest.unionByName(marked.where("stays").dropDuplicates(["id", "sha"]).select("row.*"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts, one with its smallest id."""
    found = exact_dedup.exact_duplicates(spark, docs)
    return _one_of_each(docs, found, F.sha2(exact_dedup.normalised(F.col("text")), 256), "copies")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that five-word shingles link at a Jaccard
    similarity of 0.8 or more, one with its smallest id."""
    found = jaccard_join.jaccard_components(spark, docs, 5, 8, 10)
    return _one_of_each(docs, found, F.sha2("text", 256), "near")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document into sequences; rows are pieces."""
    return packing.pack_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("packing", pack),
]

#: Its models and its tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
