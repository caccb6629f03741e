"""The corpus pipeline: five stages, each written as Parquet and reread as the next one's documents.

Defined cases
  null or empty text       judged, kept and encoded like any other; linked with nothing, contaminated by nothing
  null doc_id              its row passes the stages that go by documents and is encoded at the end
  very long texts          read whole by every stage
  ties                     of linked documents the smallest doc_id stays; of repeated lines the largest doc_id's
  repeated rows            rows of one doc_id stay or go together
  extra columns            carried through all stages but the last
  empty tables             no documents: no rows; no labels: every score is 0.5, nothing is rejected; no items: nothing is contaminated
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidscan.llm import bpe, decontam, line_dedup, ngram_join, quality
from braidscan.llm.registry import tokenizer_file
from braidscan.runtime import Scratch, table


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs, columns as they are, but for the documents of rows."""
    gone = rows.select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, but for the largest document's; every document stays, though it may be left empty."""
    return line_dedup.rewrite_texts(docs)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    groups = ngram_join.jaccard_groups(docs)
    return _without(docs, groups.filter(F.col("doc_id") != F.col("component_id")))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _without(docs, decontam.contaminated(docs, table(spark, sf_dir, "benchmark")))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.tokenize(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_join_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: The classifier and the tokenizer have no SQL form; tests hold the operators against brute force and run() against its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
