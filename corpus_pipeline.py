"""A corpus pipeline of five stages over ``documents``: quality, language, near copies, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.llm.op2_run_length_dedup import dedup_bytes
from geolith.llm.op4_jaccard_join import near_duplicates
from geolith.llm.op5_packing import pack
from geolith.llm.op6_language_id import UNDETERMINED, identify, learn_model
from geolith.llm.op10_quality_rules import Limits, quality
from geolith.llm.shared import Stored, small

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose language is less certain than this is rejected.
LEAST_SCORE = 0.2
#: A line over 20 documents of its host is frequent, however large the host.
LIMITS = Limits()


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that are frequent in their host; ``n_chars`` follows a changed text.

    A document without text fails. Repeated rows are judged alike and all stay or go; other nulls don't matter.
    """
    found = quality(docs, limits=LIMITS, keep_text=True, extra=("lang", "source", "n_chars"))
    found = found.where(F.col("kept") & (F.col("row") >= 0))  # on a row number, so that the rules are not moved into the filter and computed twice
    length = F.when(F.col("removed_words") > 0, F.length("clean_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.withColumn("n_chars", length).withColumnRenamed("clean_text", "text").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was recognised, with it as their ``lang``.

    A document without a letter goes, and all do if no row has a ``lang`` to learn from. Repeated rows are judged
    alike; ties go to the first family and language in alphabetical order.
    """
    found = identify(docs, learn_model(docs, F.lit(True)), extra=tuple(F.col(c) for c in COLUMNS if c not in ("doc_id", "lang")))
    found = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of near copies: all its different rows, once each. Rows without an id stay."""
    stored = Stored(spark)
    found = stored(near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") != F.col("component_id")).alias("copy"), (F.count("*") > 1).alias("repeated")).where("copy or repeated"))
    copies, repeated = (small(found.where(x).select("doc_id")) for x in ("copy", "repeated and not copy"))
    own = docs.where("doc_id is not null").join(copies, "doc_id", "left_anti")
    twice = own.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    rest = docs.where("doc_id is null").union(own.join(repeated, "doc_id", "left_anti").select(*docs.columns))
    return rest.select(*COLUMNS).union(twice.select(*COLUMNS))


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of smaller id has; those left without text go."""
    found = dedup_bytes(docs, keep_text=True, extra=("lang", "source", "n_chars")).where(F.btrim("kept_text") != "")
    length = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.withColumn("n_chars", length).withColumnRenamed("kept_text", "text").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("suffix-array dedup", passages_stage),
    ("packing", packing_stage),
]

#: The language models and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each stage's rows are written to the shared folder, read again, and deleted after the next stage."""
    stored = Stored(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        stored.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
