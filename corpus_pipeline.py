"""A pipeline from raw documents to token ids, in stages that are each written as Parquet and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import compression_classifier
from lexloom.llm.byte_bpe import bpe
from lexloom.llm.ngram_join import one_of_each
from lexloom.llm.source_mix import mixed_rows
from lexloom.llm.store import shared_dir
from lexloom.llm.suffix_dedup import PASSAGE, suffix_dedup

#: What the second stage takes for near copies; see lexloom.llm.ngram_join.
NEAR = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted to the labels, doesn't reject."""
    model = compression_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return compression_classifier.keep_good(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id."""
    return one_of_each(docs, threshold=NEAR)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of PASSAGE words that also stand elsewhere; documents of which nothing but white space is left go.

    Passages are counted in words here, so that one of over 50 words is found
    in any language; the 400 bytes of op7 are more than most such passages have.
    """
    others = {c: f"_other{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    left = suffix_dedup(docs.withColumnsRenamed(others), length=PASSAGE, unit="words", keep_text=True, carry=tuple(others.values())).withColumn("n_chars", F.length("text").cast("long"))
    left = left.select("doc_id", "text", "n_chars", *[F.col(n).alias(c) for c, n in others.items()])
    return left.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with its number of tokens and the hashes of ids and decoded bytes."""
    return bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=True, carry=("source",))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeats),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", tokens),
]

#: SQL can't express the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/stage-{i}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
