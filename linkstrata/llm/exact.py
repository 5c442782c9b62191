"""Exact deduplication of evidence by an extendible-hash index on shared files."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkstrata.llm.common import lookup_weighted, partitions, snippet, stage

MAX_DEPTH = 40


def _prefix(bits: Column | str, depth: int) -> Column:
    return F.shiftrightunsigned(bits, 64 - depth)


def hash_directory(entries: DataFrame, bucket_rows: int) -> DataFrame:
    """Directory of the index: ``cell`` (leading ``global_depth`` bits of the hash), ``local_depth``, ``bucket``.

    The directory doubles until no cell holds more than ``bucket_rows`` distinct hashes. A cell's local depth is the least
    number of leading bits whose rows fit one bucket; all cells that share those bits point to the same bucket. Equal hashes
    cannot be split; they stay in one bucket as a chain.
    """
    hashes = entries.select("hash").distinct()
    count = hashes.count()
    depth = max(1, math.ceil(math.log2(max(1, count) / bucket_rows)) if count > bucket_rows else 1)
    while True:
        cells = hashes.groupBy(_prefix("hash", depth).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        fullest = cells.agg(F.max("n")).first()[0] or 0
        if fullest <= bucket_rows or depth >= MAX_DEPTH:
            break
        depth += 1
    cells = stage(cells, "directory-cells")
    levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("level")).withColumn(
        "stem", F.expr(f"shiftright(cell, {depth} - level)")
    )
    fitting = levels.groupBy("level", "stem").agg(F.sum("n").alias("held")).filter(F.col("held") <= bucket_rows)
    local = levels.join(fitting, ["level", "stem"], "left_semi").groupBy("cell").agg(F.min("level").alias("local_depth"))
    return (
        cells.join(local, "cell", "left")
        .select("cell", F.lit(depth).alias("global_depth"), F.coalesce("local_depth", F.lit(depth)).alias("local_depth"))
        .withColumn("bucket", F.expr("concat(local_depth, ':', shiftright(cell, global_depth - local_depth))"))
    )


def build_snippet_index(evidence: DataFrame, bucket_rows: int = 50_000) -> DataFrame:
    """Extendible-hash index of the distinct snippets, stored in the shared folder.

    Columns: ``bucket``, ``hash``, ``chain`` (position among different snippets of equal hash), ``content_hash`` (SHA-256 in
    lowercase hex), ``keep_id`` (largest evidence_id), ``group_size``. Snippets are compared byte by byte: the grouping key is the
    whole text, combined on the map side, so a snippet that a third of all rows repeat reaches its owner as one row per map task.
    Owner tasks hold ranges of the hash, that is whole runs of buckets.
    """
    texts = evidence.select("evidence_id", snippet().alias("snippet")).withColumn("hash", F.xxhash64("snippet"))
    entries = stage(
        texts.groupBy("hash", "snippet")
        .agg(F.max("evidence_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("hash", F.sha2("snippet", 256).alias("content_hash"), "keep_id", "group_size"),
        "index-entries",
    )
    directory = hash_directory(entries, bucket_rows)
    depth = directory.agg(F.max("global_depth")).first()[0] or 1
    chains = Window.partitionBy("hash").orderBy("content_hash", F.col("keep_id").desc_nulls_last())
    owned = entries.withColumn("cell", _prefix("hash", depth)).join(directory.select("cell", "bucket"), "cell")
    owned = owned.repartitionByRange(partitions(evidence.sparkSession), "hash").withColumn("chain", F.row_number().over(chains))
    return stage(owned.select("bucket", "hash", "chain", "content_hash", "keep_id", "group_size"), "snippet-index")


def exact_duplicates(evidence: DataFrame, bucket_rows: int = 50_000) -> DataFrame:
    """Groups of evidence with identical snippets; the row with the largest ``evidence_id`` stays.

    Reads ``evidence_id`` (any ordered type) and ``snippet``. Returns one row per input row: ``evidence_id``, ``keep_id``,
    ``group_size`` (rows), ``kept``, ``content_hash``.

    Null snippets count as empty, and empty ones form a group like any other. Null ids rank below all others; a group of only
    null ids has a null ``keep_id``. Where several rows repeat the kept id and snippet, exactly one of them is ``kept``. Snippets
    of any length are hashed and compared whole. An empty table gives an empty result.
    """
    rows = stage(
        evidence.select("evidence_id", snippet().alias("snippet")).select(
            "evidence_id", F.xxhash64("snippet").alias("hash"), F.sha2("snippet", 256).alias("content_hash"), F.monotonically_increasing_id().alias("_row")
        ),
        "snippet-rows",
    )
    index = build_snippet_index(evidence, bucket_rows)
    shared = index.filter("group_size > 1").select("hash", "content_hash", "keep_id", "group_size")
    found = lookup_weighted(rows, shared, ["hash", "content_hash"], "group_size", rows.count())
    found = found.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("evidence_id")).otherwise(F.col("keep_id")))
    again = (
        rows.groupBy("hash", "content_hash", "evidence_id").agg(F.count(F.lit(1)).alias("_copies"), F.min("_row").alias("_first"))
        .filter("_copies > 1").select("hash", "content_hash", F.col("evidence_id").alias("_id"), "_first", "_copies")
    )
    same = (F.col("f.hash") == F.col("a.hash")) & (F.col("f.content_hash") == F.col("a.content_hash")) & F.col("f.evidence_id").eqNullSafe(F.col("a._id"))
    return found.alias("f").join(again.alias("a"), same, "left").select(
        "f.evidence_id", "f.keep_id", F.coalesce("f.group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("f.evidence_id").eqNullSafe(F.col("f.keep_id")) & F.coalesce(F.col("a._first") == F.col("f._row"), F.lit(True))).alias("kept"),
        "f.content_hash",
    )
