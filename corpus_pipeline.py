"""A training corpus from ``documents``, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
kept; its result is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``docs``.  The tables that a stage wrote on its way
are deleted when the next stage begins (unless its ``docs`` still reads them), so write a
stage's result before going on.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revisionlens.llm import decontam, kneserney, mixing, neardup, tokens
from revisionlens.llm.common import checked_broadcast, prepare, table, written
from revisionlens.session import checkpoint_dir, delete_tables, recorded_tables


#: Column that tells the rows of a stage's input apart: ids can be null or repeat.
ROW = "pipeline_row"


#: Tables of the stage before.
_LEFT: list[str] = []


def _stage(f):
    """A stage that deletes its predecessor's tables first."""
    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = "\n".join(docs.inputFiles()) if _LEFT else ""
        gone = [p for p in _LEFT if p.rsplit("/", 1)[1] not in read]
        delete_tables(spark, gone)
        _LEFT[:] = [p for p in _LEFT if p not in gone]
        with recorded_tables() as made:
            out = f(spark, docs, sf_dir)
        _LEFT.extend(made)
        return out
    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    rows = _rows(docs)
    scores = kneserney.quality_scores(rows, table(spark, sf_dir, "labels"), row_id=ROW)
    return _without(rows, scores.filter("not kept").select(F.col("row_id").alias(ROW)))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest ``doc_id`` (null is the largest).

    Each row is compared on its own.  Rows of one ``doc_id`` that have no words are one document.
    """
    rows = _rows(docs)
    found = neardup.near_duplicates(rows, doc_id=ROW).select(F.col("doc_id").alias(ROW), "n_shingles", "component_id")
    found = found.join(rows.select(ROW, F.col("doc_id").alias("id")), ROW)
    some = F.col("n_shingles") > 0
    found = found.select(ROW, "id", F.when(some, F.col("component_id")).alias("component"), F.when(~some, F.col("id")).alias("short"),
                         F.when(~some & F.col("id").isNull(), F.col(ROW)).alias("alone"))
    found = written(found, "near-rows")
    first = found.groupBy("component", "short", "alone").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", ROW)).alias("first"))
    first = written(first.select(F.col(f"first.{ROW}").alias(ROW)), "near-first")
    return _without(rows, found.select(ROW).join(first, ROW, "left_anti"))


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    rows = _rows(docs)
    found = decontam.contamination(rows.select(F.col(ROW).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(rows, found.filter("contaminated").select(F.col("doc_id").alias(ROW)))


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: documents repeat as often as they are taken."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


@_stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in ORC files; returns what the files hold of each document."""
    return tokens.tokenized(docs)


def _rows(docs: DataFrame) -> DataFrame:
    """``docs`` with a written id of each row: the operators' verdicts are by row."""
    prepare(docs.sparkSession)
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def _without(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """``rows`` without the rejected ones and their ids: the ids are broadcast if their count is bounded, else both sides shuffle."""
    ids = written(rejected.distinct(), "rejected")
    return rows.join(checked_broadcast(ids, ids.count()), ROW, "left_anti").drop(ROW)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("token_ids", token_ids)]

#: The model's floating-point sums and the tokenizer can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; one row per document of the mix."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
