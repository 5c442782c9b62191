"""Training-corpus pipeline: language, exact copies, near copies, benchmark leaks, packing.

Every stage takes all that its predecessor kept. All but the last return the columns of ``documents``. Decisions are carried back to
the rows by document id and text, so that null or repeated ids cannot mix up rows; rows that repeat both share their decision. Empty
tables pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstrata.functions.tables import join_path
from linkstrata.llm.catalog import as_evidence, tokenizer_path
from linkstrata.llm.common import bitmap, in_bitmap, stage
from linkstrata.llm.exact import exact_duplicates
from linkstrata.llm.language import UNDETERMINED, predict_language
from linkstrata.llm.leaks import leaked_items
from linkstrata.llm.packing import pack_snippets
from linkstrata.llm.simhash import near_duplicate_snippets

ORACLE_SQL = None
LEAST_LANGUAGE_SCORE = 0.5


def _digest() -> Column:
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


def _row_id() -> Column:
    """Id and text as one id: different for any two rows that differ in either."""
    return F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), _digest())


def _whole(docs: DataFrame) -> Column:
    """The whole row as one column, so that no name of it can clash."""
    return F.struct(*docs.columns).alias("document")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with a score of at least 0.5; those without a letter, with null or with undecided text go."""
    rows = docs.select(F.col("doc_id").alias("evidence_id"), F.col("text").alias("snippet"), "lang", _whole(docs))
    found = predict_language(rows, carry="document")
    return found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("document.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of identical texts: that with the largest id."""
    found = exact_duplicates(as_evidence(docs)).filter(F.col("evidence_id").eqNullSafe(F.col("keep_id")))
    kept = found.groupBy(F.col("evidence_id").alias("kept_id"), F.col("content_hash").alias("kept_digest")).agg(F.count(F.lit(1)).alias("copies"))
    kept = stage(kept, "kept-documents")
    rows = docs.select(_whole(docs), F.col("doc_id").alias("id"), _digest().alias("digest"))
    rows = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")))
    if not kept.filter("copies > 1").isEmpty():
        rows = rows.filter("copies = 1").unionByName(rows.filter("copies > 1").dropDuplicates(["kept_id", "kept_digest"]))
    return rows.select("document.*")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents whose row id is not among the ``evidence_id`` of ``gone``. Only those that a bitmap of the ids lets through are shuffled."""
    lost = stage(gone.select(F.col("evidence_id").alias("gone_id")).distinct(), "gone-documents")
    marks = stage(bitmap(lost.select(F.xxhash64("gone_id").alias("mark")), "mark"), "gone-marks")
    rows = docs.select(_whole(docs), _row_id().alias("id"))
    sure = in_bitmap(rows, [F.xxhash64("id")], marks, inside=False)
    rest = in_bitmap(rows, [F.xxhash64("id")], marks).join(lost, F.col("id") == F.col("gone_id"), "left_anti")
    return sure.unionByName(rest).select("document.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    rows = docs.select(_row_id().alias("evidence_id"), F.col("text").alias("snippet"))
    return _without(docs, near_duplicate_snippets(rows).filter("evidence_id <> component_id"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    items = spark.read.parquet(join_path(sf_dir, "benchmark.parquet")).select("item_id", F.col("text").alias("message"))
    rows = docs.select(_row_id().alias("evidence_id"), F.col("text").alias("snippet"))
    return _without(docs, leaked_items(rows, items))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training windows; ``ids`` are little-endian unsigned 32-bit numbers."""
    return pack_snippets(as_evidence(docs), tokenizer_path("byte_bpe_50k.json")).withColumnRenamed("evidence_id", "doc_id")


STAGES = [
    ("language", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage's result is stored as Parquet and read again by the next."""
    docs = spark.read.parquet(join_path(sf_dir, "documents.parquet"))
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
