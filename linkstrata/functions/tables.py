"""Keyed-table helpers shared by all operators.

Input order is data in this domain ("first row wins"), so every table that needs it
carries an explicit ``pos`` column and ties are always broken by named columns.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 8 * 1024 * 1024  # of compressed columns: many times that in memory still fits
SPREAD = 32
BYTES_PER_TASK = 4 * 1024 * 1024  # of stored input: rows with long keys take fifty times that and more in a hash table


def work_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage: ``spark.checkpoint.dir``; a temp folder only in local mode."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is not None:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="linkstrata-")
    context.setCheckpointDir(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialize to reliable storage; survives executor loss, cuts the plan."""
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Materialize as Parquet in the shared folder: for large tables, which are compressed, read by column and have a known size there."""
    path = join_path(work_dir(df.sparkSession), f"stored-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Slices:
    """A table in the shared folder that grows by whole folders: what is written is never written again, and all of it is read as one table."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, join_path(work_dir(spark), f"{name}-{uuid.uuid4().hex}")
        self.count, self.schema = 0, None

    def add(self, df: DataFrame) -> DataFrame:
        """Writes the rows as a new slice and reads them back."""
        self.schema = self.schema or df.schema
        path = join_path(self.path, f"slice={self.count}")
        df.select(*self.schema.names).write.parquet(path)
        self.count += 1
        return self.spark.read.schema(self.schema).parquet(path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def join_path(base: str, *parts: str) -> str:
    return os.path.join(base, *parts)


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], chooser) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])
    chosen = df.groupBy(*keys).agg(chooser(F.struct(*rest), ordering).alias("_row"))
    return chosen.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key. An aggregate (map-side combine), so hot keys do not pile up in one task."""
    return _pick(df, keys, order, F.min_by)


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return _pick(df, keys, order, F.max_by)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rn") -> DataFrame:
    """First k rows per key. Spark plans a partial group limit before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn") -> DataFrame:
    """Row number per key without putting a whole key into one task.

    Rows are range-partitioned by (keys, order), numbered inside each range slice, and
    shifted by the number of rows of the same key in earlier slices.
    """
    spark = df.sparkSession
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    by = [*keys, *order]
    staged = checkpointed(
        df.repartitionByRange(slices, *[F.col(c) for c in by]).withColumn("_slice", F.spark_partition_id())
    )
    inner = Window.partitionBy("_slice", *keys).orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        staged.groupBy("_slice", *keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    rows = staged.withColumn("_local", F.row_number().over(inner))
    return (
        rows.join(offsets, ["_slice", *keys])
        .withColumn(name, (F.col("_local") + F.col("_before")).cast("bigint"))
        .select(*df.columns, name)
    )


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], **values: tuple[str, Column]) -> DataFrame:
    """Adds to each row the sum, min or max over the earlier rows of its key, without putting a whole key into one task.

    ``values``: new column -> ("sum" | "min" | "max", column). Rows are sliced by range as in :func:`numbered`; what the earlier slices of a
    key hold is one row per slice. ``order`` must tell all rows of a key apart where the result depends on it. Null where nothing precedes.
    """
    folds = {"sum": F.sum, "min": F.min, "max": F.max}
    combine = {"sum": lambda a, b: F.coalesce(a + b, a, b), "min": F.least, "max": F.greatest}
    slices = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    by = [*[F.col(k) for k in keys], *[F.col(o) if isinstance(o, str) else o for o in order]]
    staged = checkpointed(
        df.select(*df.columns, *[v.alias(f"_v_{n}") for n, (_, v) in values.items()]).repartitionByRange(slices, *by).withColumn("_slice", F.spark_partition_id())
    )
    inner = Window.partitionBy("_slice", *keys).orderBy(*by[len(keys):]).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    held = staged.groupBy("_slice", *keys).agg(*[folds[f](f"_v_{n}").alias(f"_h_{n}") for n, (f, _) in values.items()])
    held = held.select("_slice", *keys, *[folds[f](f"_h_{n}").over(outer).alias(f"_b_{n}") for n, (f, _) in values.items()])
    rows = staged.select("*", *[folds[f](f"_v_{n}").over(inner).alias(f"_i_{n}") for n, (f, _) in values.items()])
    return rows.join(held, ["_slice", *keys]).select(*df.columns, *[combine[f](F.col(f"_b_{n}"), F.col(f"_i_{n}")).alias(n) for n, (f, _) in values.items()])


def estimated_bytes(df: DataFrame) -> int:
    """Optimizer size estimate of a plan (file sizes and column pruning included)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def input_bytes(df: DataFrame) -> int:
    """Size of the files a plan reads; unlike :func:`estimated_bytes` joins do not multiply it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    found = [leaves.apply(i) for i in range(leaves.size())]
    return sum(int(str(leaf.stats().sizeInBytes())) for leaf in found if leaf.nodeName().startswith("LogicalRelation"))


def gathered(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys in one task, in as many tasks as the size of the input asks for; aggregates by these and further keys move no row again.

    One task more than the session's number, unless the rows are read as they are stored: after an aggregate by the same keys Spark would drop a move to equally many tasks, and may then
    put all rows, few before a join that multiplies them, into one task.
    """
    plain = df._jdf.queryExecution().optimizedPlan().children().isEmpty()  # a stored table, in which no row has moved
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) + (0 if plain else 1), -(-input_bytes(df) // BYTES_PER_TASK))
    return df.repartition(tasks, *keys)


def lookup(df: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Left or inner join of a dimension with unique keys to rows whose key may be very hot.

    The dimension is broadcast when its estimated size is small; otherwise it is copied ``SPREAD``
    times and the rows of one key are spread over that many partitions by a hash of their other columns.
    """
    if how not in ("left", "inner"):
        raise ValueError("only left and inner lookups can be spread")
    if estimated_bytes(dim) <= BROADCAST_LIMIT_BYTES:
        return df.join(F.broadcast(dim), list(on), how)
    plain = [f.name for f in df.schema.fields if f.name not in on and f.dataType.typeName() not in ("map", "array", "struct")]
    salted = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    rows = df.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(SPREAD)).cast("int") if plain else F.lit(0))
    return rows.join(salted, [*on, "_salt"], how).drop("_salt")


def empty_like(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)
