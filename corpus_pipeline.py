"""A training corpus from raw documents: five stages, each written and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontaminate, line_templates, near_copies, quality_classifier
from ledgerloom.llm.common import cut


def _judged(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], made: tuple[str, ...], keep: str) -> DataFrame:
    """The rows of ``docs`` that ``judge`` (which adds the columns ``made``) keeps, whatever their own columns are called."""
    own = {c: f"__own_{k}" for k, c in enumerate(docs.columns) if c.lower() in made}
    kept = judge(docs.withColumnsRenamed(own)).where(keep)
    return kept.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _judged(docs, lambda d: quality_classifier.classify(d, model, d.columns), ("expected_grade", "p_poor_or_better", "p_good", "kept"), "kept")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose templates recur; ``n_chars`` follows the text."""
    left = line_templates.drop_recurring_lines(docs)
    return left.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return near_copies.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _judged(docs, lambda d: decontaminate.find_leaks(d, benchmark, d.columns), ("n_leaks", "items", "lcs", "cosine"), "n_leaks = 0")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's tokens, with the digests of ids and of what they decode to."""
    return bpe.encode_texts(docs, ids=True).drop("decoded")


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe", tokens)]

#: No stage but the last could be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
