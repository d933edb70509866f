"""A training corpus from documents: language, near-duplicates, benchmark passages, personal data, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remarkt.llm.byte_cnn import UNKNOWN, identify
from remarkt.llm.chosen_path import near_duplicates
from remarkt.llm.nnls_packing import packing_report
from remarkt.llm.sanitise import sanitise
from remarkt.llm.scratch import delete, scope, shared_dir
from remarkt.llm.suffix_leaks import without_leaks

#: Documents whose language is less likely than this go, as those without any do.
LEAST_SCORE = 0.4
#: Words of a shingle and least similarity, in hundredths, of near-duplicates.
SHINGLE, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known, all columns as they were. Null texts and those without a letter go; repeated rows stay; an empty table gives an empty result."""
    row = F.struct(*(docs[c] for c in docs.columns))
    found = identify(docs.select(row.alias("row"), "text"), docs, keep=("row",))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, that of the smallest id (of several texts with it, of the smallest digest); of rows equal in id and text one.

    Documents are alike at 0.8 or more of their shingles of five words. Rows without an id, without a text or without words are in no group. Of rows equal in id and text, the one of the
    smallest digest of its other columns stays, in every run. An empty table gives an empty result.
    """
    digest = F.coalesce(F.md5(docs["text"]), F.lit("")).alias("_digest")
    groups = near_duplicates(docs.select("doc_id", digest, "text"), shingle=SHINGLE, percent=PERCENT, key=("_digest",)).where("component is not null")
    # the others of each group go, by id and digest of text
    first = groups.groupBy("component").agg(F.min(F.struct("doc_id", "_digest")).alias("first"))
    gone = groups.select("component", "doc_id", "_digest").distinct().join(first, "component").where(F.struct("doc_id", "_digest") != F.col("first")).select(F.col("doc_id").alias("_id"), F.col("_digest").alias("_gone"))
    others = [docs[c] for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(*(docs[c] for c in docs.columns))
    rows = docs.select(docs["doc_id"].alias("_doc"), digest, row.alias("row"), F.xxhash64(F.to_json(F.struct(F.lit(0), *others))).alias("_order"))
    one = rows.groupBy("_doc", "_digest").agg(F.min_by("row", "_order").alias("row"))
    return one.join(gone, (F.col("_doc") == F.col("_id")) & (one["_digest"] == F.col("_gone")), "left_anti").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, all columns as they were. Null and empty texts have none and stay, repeated rows too; an empty table or benchmark takes nothing away."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; personal data and terms that disclose it are replaced in their text, n_chars is that of the new one. Null and empty texts stay as they are, repeated rows change alike; an empty table gives an empty result."""
    return sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens. Null and empty texts are one token; repeated rows are packed each; an empty table gives an empty result."""
    return packing_report(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("personal_data", personal_data), ("pack", pack)]

#: Learnt models, iteration and tokenizers are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over all documents; each is written in the shared folder and read by the next. What a stage needs meanwhile goes at its end, its rows once the next stage's are written; the last one's stay, for they are what is returned."""
    path = f"{shared_dir(spark)}/remarkt-pipeline-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scope(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(f"{path}/{name}")
        if before:
            delete(spark, f"{path}/{before}")
        before = name
        docs = spark.read.schema(made.schema).parquet(f"{path}/{name}")
    return docs
