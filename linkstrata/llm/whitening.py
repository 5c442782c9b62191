"""Whitening of vectors by the covariance of their distinct values.

Nodes, edges, companies and evidence carry no vectors, so this operator is general: it takes any table with an id and an array column.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkstrata.llm.common import lookup_weighted, stage

SCALE = 256
SMALLEST_SHARE = 1e-12
LONG_BITS = 62


def finite(vector: Column) -> Column:
    """Not null, no null and no non-finite entry."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))


def fixed_point(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("bigint"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, size)


def _exact_sums(x: np.ndarray, weight: np.ndarray) -> list[int]:
    """Weighted column sums, in Python numbers where 64 bits could be too few."""
    reach = int(np.abs(x).max(initial=0)).bit_length() + int(weight.sum()).bit_length()
    if reach > LONG_BITS:
        return [int(v) for v in (x.astype(object) * weight.astype(object)[:, None]).sum(axis=0)]
    return (x * weight[:, None]).sum(axis=0).tolist()


def _square_deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n*x - S)^2 of each row; None where it does not fit a bigint."""
    reach = max(n * int(np.abs(x).max(initial=0)), max(map(abs, sums), default=0)).bit_length() + 1
    if 2 * reach + len(sums).bit_length() <= LONG_BITS:
        apart = x * n - np.array(sums, dtype=np.int64)
        return (apart * apart).sum(axis=1).tolist()
    apart = x.astype(object) * n - np.array(sums, dtype=object)
    return [int(v) if v < 2**63 else None for v in (apart * apart).sum(axis=1)]


def _weight(batch: pa.RecordBatch, counted: bool) -> np.ndarray:
    held = batch.column(1).to_numpy().astype(np.int64)
    return held if counted else np.ones(len(held), dtype=np.int64)


def column_sums(groups: DataFrame, size: int, counted: bool) -> list[int]:
    """Exact weighted sum of each dimension over ``x``, ``copies``; one row a dimension leaves a task."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * size
        for batch in batches:
            part = _exact_sums(_matrix(batch.column(0), size), _weight(batch, counted))
            total = [a + b for a, b in zip(total, part)]
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], names=["dim", "part"])

    parts = groups.select("x", "copies").mapInArrow(add, "dim int, part decimal(38,0)")
    found = {r["dim"]: int(r["total"]) for r in parts.groupBy("dim").agg(F.sum("part").alias("total")).collect()}  # one row a dimension
    return [found.get(i, 0) for i in range(size)]


def covariance(groups: DataFrame, mean: np.ndarray, total: int, counted: bool) -> np.ndarray:
    """Weighted covariance of ``x`` with divisor ``total``: each task multiplies its centred block of rows; the blocks' products are added by matrix row."""
    size = len(mean)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product = np.zeros((size, size))
        for batch in batches:
            centred = _matrix(batch.column(0), size) - mean
            product += (centred * _weight(batch, counted)[:, None]).T @ centred
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(product), pa.list_(pa.float64()))], names=["dim", "part"])

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [key[0]], "part": [np.sum(np.stack(frame["part"].to_numpy()), axis=0)]})

    parts = groups.select("x", "copies").mapInArrow(multiply, "dim int, part array<double>")
    rows = parts.groupBy("dim").applyInPandas(add, "dim int, part array<double>").toPandas().sort_values("dim")  # one row a dimension
    return np.stack(rows["part"].to_numpy()) / total


def principal_axes(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of those that are above rounding; signs are fixed by the largest entry."""
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > SMALLEST_SHARE * max(float(np.trace(cov)), 0.0)]
    vectors = vectors[:, order]
    if len(order):
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    return values[order], vectors


def identity_error(white: DataFrame, size: int, total: int, counted: bool) -> float:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity, over the fit list."""
    weight = F.col("copies") if counted else F.lit(1)
    columns = [F.col("whitened")[i] for i in range(size)]
    means = white.agg(*[(F.sum(c * weight) / total).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    found = white.agg(*[(F.sum((columns[i] - means[i]) * (columns[j] - means[j]) * weight) / total).alias(f"v{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[at] - (i == j)) for at, (i, j) in enumerate(pairs))


def whiten_vectors(
    rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 4, scale: int = SCALE, counted: bool = False,
) -> DataFrame:
    """Coordinates of every vector along the main axes of the covariance, scaled to unit variance.

    Entries become whole numbers, x = floor(scale * c). Rows with equal x form one group; the fit list has each group once, or with ``counted`` once for every
    row. Sums over the list are exact; the covariance is a matrix product of centred blocks, added up in Spark, so that the driver gets one matrix of
    the vectors' dimension. Each distinct vector is whitened once and joined back to its rows; vectors of 1/1000 of the rows or more are looked up by broadcast.

    Returns for each row and component: the id, ``component`` (from 1, by falling variance), ``n`` (length of the fit list), ``deviation`` (sum over dimensions of
    (n*x-S)^2, exact; null if it does not fit a bigint), ``whitened``, ``explained`` (share of the whole variance), ``identity_error`` (one value).

    Rows whose vector is null, or holds null or non-finite entries, are left out. Null ids and repeated rows are kept as rows. Vectors shorter than the
    longest count as zero in the dimensions they lack. Components without variance, as when all vectors are equal, have no rows; so an empty table gives
    an empty result. Other columns are ignored.
    """
    usable = rows.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector")).filter(finite(F.col("vector")))
    kind = usable.schema["id"].dataType.simpleString()
    nothing = rows.sparkSession.createDataFrame([], f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    nothing = nothing.withColumnRenamed("id", id_column)
    sizes = usable.agg(F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")).first()
    size = sizes["most"]
    if not size:
        return nothing
    x = fixed_point(F.col("vector"), scale)
    if sizes["least"] < size:
        x = F.slice(F.concat(x, F.array_repeat(F.lit(0).cast("bigint"), size)), 1, size)
    usable = usable.select("id", x.alias("x"))
    groups = stage(usable.groupBy("x").agg(F.count(F.lit(1)).alias("copies")), "distinct-vectors")
    count = groups.agg(F.count(F.lit(1)).alias("distinct"), F.sum("copies").alias("rows")).first()
    total = count["rows"] if counted else count["distinct"]
    sums = column_sums(groups, size, counted)
    mean = np.array([float(Fraction(s, total)) for s in sums])
    cov = covariance(groups, mean, total, counted)
    values, axes = principal_axes(cov, components)
    if not len(values):
        return nothing
    project = axes / np.sqrt(values)

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = _matrix(batch.column(0), size)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(_square_deviations(block, total, sums), pa.int64()), pa.array(list((block - mean) @ project), pa.list_(pa.float64())),
            ], names=["x", "copies", "deviation", "whitened"])

    white = stage(groups.select("x", "copies").mapInArrow(whiten, "x array<bigint>, copies bigint, deviation bigint, whitened array<double>"), "whitened-vectors")
    error = identity_error(white, len(values), total, counted)
    explained = F.array(*[F.lit(float(v / np.trace(cov))) for v in values])
    found = lookup_weighted(usable, white, ["x"], "copies", count["rows"])
    return found.select("id", "deviation", F.posexplode("whitened").alias("at", "white")).select(
        F.col("id").alias(id_column), (F.col("at") + 1).cast("int").alias("component"), F.lit(total).cast("bigint").alias("n"), "deviation",
        F.col("white").alias("whitened"), explained[F.col("at")].alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
