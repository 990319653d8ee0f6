"""A training corpus from documents: five stages, each written as Parquet and read again before the next.

Null and repeated rows, empty tables and further columns fare as the operators' docstrings say; every stage passes on
all columns of its input but the last, which gives each document's ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.llm import bpe, jaccard_join, line_dedup, mixing, quality_model
from wireloom.llm.common import cut, table

#: Near duplicates share at least this percentage of their runs of five words.
SHINGLE_WORDS, SHINGLE_PERCENT = 5, 80


def _lengths(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of the documents of this stage."""
    net = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_model.score(docs, net, name="wireloom_score")
    return scored.filter(F.col("wireloom_score") >= quality_model.ACCEPT).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sources share."""
    return _lengths(line_dedup.dedup(docs).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; documents without an id all stay."""
    found = jaccard_join.join(docs, SHINGLE_WORDS, SHINGLE_PERCENT)
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias("wireloom_gone"))
    return docs.join(gone, F.col("doc_id") == F.col("wireloom_gone"), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, in which a document is repeated as often as it is taken, by shard and place."""
    return _lengths(mixing.written(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, 4 bytes an id, and whether decoding them gives its text."""
    slim = docs.select("doc_id", "source", "text")
    coded = bpe.round_trip(slim)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing to target weights", mixed),
    ("BPE encoding and decoding", encoded),
]
#: A learned classifier and hashed draws have no SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
