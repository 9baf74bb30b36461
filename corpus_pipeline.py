"""Corpus pipeline: quality rules, quality classifier, line dedup, SimHash near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All stages but the last return the columns of documents.

Null texts: the rules reject them (no words), as they do empty texts. An empty table passes
through every stage as an empty table with its columns. Decisions fall on rows, told apart by
doc_id (null is a value like any other) and text: rows of one doc_id with other texts are judged
each on its own, and of equal rows SimHash keeps one. Further columns pass through to the last
stage whatever their names; only names that begin with ``__`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm.common import stored
from fairline.llm.line_dedup import dedup_lines
from fairline.llm.packing import pieces
from fairline.llm.quality_classifier import scored
from fairline.llm.quality_rules import ledger, measure, rejected
from fairline.llm.simhash import near_duplicates

#: SQL cannot express the classifier and the packing. Tests hold the SimHash stage against brute force and the
#: rules against rows with known verdicts; the other stages are tested for rows and columns, their operators by themselves.
ORACLE_SQL = None


def _text_hash() -> Column:
    return F.xxhash64("text").alias("__hash")


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without the rows that (doc_id, __hash) of ``rows`` names; null ids match each other."""
    rows = rows.select(F.col("doc_id").alias("__id"), "__hash")
    return docs.join(rows, docs["doc_id"].eqNullSafe(rows["__id"]) & (F.xxhash64(docs["text"]) == rows["__hash"]), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that no rule of policy web-1 rejects; each row is judged on its own text."""
    whole = docs.select(F.struct(*docs.columns).alias("__doc"), "text")
    return ledger(measure(whole, keep=("__doc",))).where(~rejected("web-1")).select("__doc.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a score of 0.5 or more; only ids and hashes of rejected rows are joined back."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = scored(docs.select("doc_id", "text", _text_hash()), labels, keep=("__hash",))
    return _without(docs, stored(judged.where("score < 0.5").select("doc_id", "__hash").distinct(), "rejected"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines; n_chars follows the text. Every document stays, maybe empty."""
    got = dedup_lines(docs, removed="__removed")
    return got.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row in each component of linked fingerprints: the smallest doc_id, nulls last, then the smallest hash of the text."""
    found = near_duplicates(docs.select("doc_id", "text", _text_hash()), keep=("__hash",))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__hash")
    named = found.select("component_fp", place.alias("__place"))
    best = named.groupBy("component_fp").agg(F.min("__place").alias("__first"))
    rows = named.join(best, "component_fp").groupBy("__place").agg(F.min("__first").alias("__first"), F.count("*").alias("__n"))
    rows = stored(rows.where((F.col("__place") != F.col("__first")) | (F.col("__n") > 1)), "simhash-rows")
    single = _without(docs, rows.select("__place.doc_id", "__place.__hash"))
    # Equal rows that are the first of their component: one of each stays.
    again = rows.where("__place = __first").select(F.col("__place.doc_id").alias("__id"), "__place.__hash")
    same = docs["doc_id"].eqNullSafe(again["__id"]) & (F.xxhash64(docs["text"]) == again["__hash"])
    return single.unionByName(docs.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens in sequences with little padding."""
    return pieces(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
