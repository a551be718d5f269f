"""Corpus pipeline: quality rules, quality classifier, line dedup, near-dedup, packing.

Every stage takes rows with nulls in any column, repeated rows, empty texts and an empty table; other columns of documents pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.llm import linededup, neardup, packing, quality_model, rules
from sluice.llm.scratch import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the adaptive rules reject; null and empty texts fail the base rule."""
    rows = docs.select("text", "lang", "source", F.struct(*docs.columns).alias("row"))  # a struct, so that no column clashes with a measure
    return rules.judge(rows, keep=["row"]).where("kept").select("row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose predicted label is 0. The model learns from the labelled rows of the whole table, since the rules have taken most bad ones away; without any label every document stays."""
    model = quality_model.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.score(docs, model, keep=docs.columns, name="__score").where("__score >= 0.5").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that many documents repeat; a document may become empty but stays, and so do rows without a doc_id, as they are."""
    out = linededup.without_repeated_lines(docs)
    return out.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies. Rows without a doc_id stay, and all rows of a doc_id that stays."""
    gone = neardup.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__gone"), F.lit(False).alias("__never")).distinct()
    # A hash of the text deals rows without an id over all tasks; they meet nothing.
    rows = docs.withColumns({"__id": F.coalesce("doc_id", F.xxhash64("text")), "__none": F.col("doc_id").isNull()})
    return rows.join(gone, (F.col("__id") == F.col("__gone")) & (F.col("__none") == F.col("__never")), "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 1,024 tokens; an empty text is its final id."""
    return packing.pack(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("packing", pack_sequences),
]

#: The model and the tokenizer can't be written in SQL; tests/llm/test_edges.py holds every stage and the packed ids of run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
