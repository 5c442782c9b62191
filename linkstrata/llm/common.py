"""Helpers of the text operators: stored stages, skew-proof lookups, column choice."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkstrata.functions.tables import join_path, work_dir

HEAVY = 1000


def fresh_path(spark, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``)."""
    return join_path(work_dir(spark), f"llm-{name}-{uuid.uuid4().hex}")


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, outlives executors, gives true sizes to the planner."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def snippet(name: str = "snippet") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def share(id_column: str, parts: int) -> Column:
    """Fold of a row: crc32 of the id as text, modulo ``parts``. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_column).cast("string"), F.lit("")), "UTF-8")), F.lit(parts))


def lookup_weighted(rows: DataFrame, dim: DataFrame, keys: Sequence[str], weight: str, total: int) -> DataFrame:
    """Left join to a table with unique, non-null keys whose ``weight`` is the number of rows that carry the key.

    Keys with at least 1/1000 of ``total`` rows are at most 1000 by arithmetic; these are broadcast, so that their rows are not
    dealt by key at all. Every other key has less than 1/1000 of the rows and takes the shuffled join.
    """
    heavy = dim.filter(F.col(weight) * HEAVY >= F.lit(total))
    light = dim.filter(F.col(weight) * HEAVY < F.lit(total))
    hit = rows.join(F.broadcast(heavy), list(keys), "inner")
    miss = rows.join(F.broadcast(heavy.select(*keys)), list(keys), "left_anti").join(light, list(keys), "left")
    return hit.unionByName(miss.select(*hit.columns))


def bitmap(keys: DataFrame, column: str, bits: int = 24) -> DataFrame:
    """A set of bigint keys as at most 2^(bits-6) rows (``slot``, ``mask``): a filter that may let others pass, but loses none."""
    place = F.pmod(F.col(column), F.lit(1 << bits))
    rows = keys.select(F.shiftright(place, 6).alias("slot"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    return rows.groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))


def in_bitmap(rows: DataFrame, keys: Sequence[Column], marks: DataFrame, inside: bool = True, bits: int = 24) -> DataFrame:
    """Rows of which at least one of ``keys`` may be in the bitmap, or with ``inside`` off, rows of which surely none is.

    The bitmap's size is bounded, so it is broadcast; ``rows`` are not shuffled.
    """
    hits, columns = [], rows.columns
    for i, key in enumerate(keys):
        rows = rows.withColumn(f"_place{i}", F.pmod(key, F.lit(1 << bits)))
        mark = marks.select(F.col("slot").alias(f"_slot{i}"), F.col("mask").alias(f"_mask{i}"))
        rows = rows.join(F.broadcast(mark), F.shiftright(F.col(f"_place{i}"), 6) == F.col(f"_slot{i}"), "left")
        hits.append(F.expr(f"coalesce(shiftrightunsigned(_mask{i}, cast(_place{i} & 63 AS int)) & 1, 0)"))
    found = sum(hits[1:], hits[0])
    return rows.filter(found > 0 if inside else found == 0).select(*columns)
