"""Corpus pipeline: raw documents to packed token ids, five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that ``run``
writes as Parquet to the shared checkpoint folder and rereads, so a lost
executor costs at most the stage it was working on.  All stages but the last
return the columns of documents.

Defined results: null texts, empty texts and texts without a letter go in the
first stage; very long texts are worked on whole; rows that repeat id and text
count once from the second stage on, rows without an id stay unless they copy
another's text; ties go to the smaller id; an empty table passes all stages
empty; extra columns travel along up to the last stage.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.llm import decontaminate, language_id, minhash_dedup, mix_sources, pack_tokens
from clientele.llm.common import delete_path, prepare, shared_path, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learned language (model and floor fitted on the labelled rows).

    Texts without a letter go, and texts whose letters and letter sequences no learned language has; how short a text
    is, or how close two learned languages are, does not matter.
    """
    prepare(spark)
    model = language_id.train(docs)
    floor = language_id.fit_floor(docs, model) if model.langs else 0.0
    found = language_id.predict(docs, model, pred_col="_lang_pred", score_col="_lang_score", fit_col="_lang_fit")
    known = (F.col("_lang_pred") != language_id.UNDETERMINED) & (F.col("_lang_fit") >= floor)
    # Without any labelled row there is no model to reject by: only texts without a letter go.
    keep = known if model.langs else F.col("text").rlike(r"\p{L}")
    return found.where(keep).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    prepare(spark)
    return minhash_dedup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    prepare(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order that holds each source at its target weight."""
    prepare(spark)
    return mix_sources.interleave(docs, mix_sources.source_weights(docs))


def pack_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token-id sequences of all documents, in mix order from group to group."""
    prepare(spark)
    return pack_tokens.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix_to_weights),
    ("pack_tokens", pack_token_ids),
]

# Hashed models and token packing have no SQL form; tests/llm checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table; the intermediate tables go once the next stage is written."""
    prepare(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
