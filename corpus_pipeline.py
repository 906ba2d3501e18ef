"""A corpus pipeline of five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, jaccard_join, piece_sampling, quality_rules, substring_dedup
from gridloom.llm.common import SCRATCH, drop_scratch, stored

def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go: null, empty and short texts among them. An empty table stays empty."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents with similarity of 0.8 or more, the one of least id stays. Texts without words stay
    all; a document with a null id stays only where its class has no other; of repeated rows one stays."""
    return jaccard_join.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in a 35-word window that is repeated anywhere go; texts that lose words are joined by spaces anew, with their
    n_chars. Null and short texts stay as they are, and so do further columns, whatever their names."""
    hold = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    cut = substring_dedup.remove_repeats(docs.select(*[F.col(f"`{c}`").alias(a) for c, a in hold.items()]), hold["text"])
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*[F.when(F.col("n_removed") > 0, new[c]).otherwise(F.col(a)).alias(c) if c in new else F.col(a).alias(c) for c, a in hold.items()])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or all of a shorter one, go. Null and empty texts stay."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents plus their sampled piece ids (`piece_ids`, null for null), which decode to the text."""
    return piece_sampling.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece encoding and decoding", pieces),
]

#: Sampled segmentations can't be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table is written and read again; what it left behind, and its predecessor's table, is deleted."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(SCRATCH)
    for i, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage_{i}")
        drop_scratch(since=mark, but=(docs,))
    return docs
