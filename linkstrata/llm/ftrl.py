"""Sparse linear classifiers trained with follow-the-regularised-leader updates.

Examples are rows of (label, feature numbers, counts). Parts of a bounded sample are trained in parallel tasks; after each round
the tasks' states are averaged. The state is two dense arrays of fixed size, so what goes to the driver and back does not grow.
Examples are stored once and read by each round where they are: no round shuffles them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXAMPLE = "turn bigint, label int, steps binary, counts binary"
NAMES = ["turn", "label", "steps", "counts"]


@dataclass(frozen=True)
class Settings:
    """``l1`` and ``l2`` are the elastic-net penalties; ``alpha`` and ``beta`` set the step of each coordinate. ``shards``: tasks at most."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.0
    l2: float = 0.0
    shards: int = 8
    rounds: int = 4


def weights(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """Weights that the accumulated gradients stand for; zero within the l1 penalty."""
    beyond = np.sign(z) * np.maximum(np.abs(z) - s.l1, 0)
    return (-beyond / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)).astype(np.float32)


def probabilities(logits: np.ndarray) -> np.ndarray:
    """Softmax over two or more classes along the first axis; a single row of logits is a logistic regression."""
    if logits.shape[0] == 1:
        return 1 / (1 + np.exp(-np.clip(logits, -60, 60)))
    shifted = np.exp(logits - logits.max(axis=0))
    return shifted / shifted.sum(axis=0)


def learn(z: np.ndarray, n: np.ndarray, examples, s: Settings) -> None:
    """One pass of updates in place; ``z`` and ``n`` are (outputs, features)."""
    outputs = z.shape[0]
    for label, ids, vals in examples:
        zs, ns = z[:, ids], n[:, ids]
        w = weights(zs, ns, s)
        target = np.zeros(outputs, dtype=np.float32)
        if outputs == 1:
            target[0] = label
        else:
            target[label] = 1
        gradient = (probabilities(w @ vals) - target)[:, None] * vals
        square = gradient * gradient
        z[:, ids] = zs + gradient - (np.sqrt(ns + square) - np.sqrt(ns)) / s.alpha * w
        n[:, ids] = ns + square


def encode(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(turn, label, ascending feature numbers, counts) as ``EXAMPLE`` rows; differences of the numbers compress well."""
    packed = [(t, y, np.diff(ids, prepend=0).astype("<u4").tobytes(), counts.astype("<u4").tobytes()) for t, y, ids, counts in rows]
    types = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*packed) if packed else ((),) * 4, types)], names=NAMES)


def decode(frame: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(label, feature numbers, counts) of ``EXAMPLE`` rows in the order of their turns."""
    frame = frame.sort_values(["turn", "label"], kind="stable")
    for label, steps, counts in zip(frame["label"], frame["steps"], frame["counts"]):
        yield label, np.cumsum(np.frombuffer(steps, dtype="<u4"), dtype=np.int64), np.frombuffer(counts, dtype="<u4")


def train(examples: DataFrame, outputs: int, features: int, s: Settings, vector: Callable) -> np.ndarray:
    """Weights (outputs, features) learned from a stored ``EXAMPLE`` table; all zero if it has no rows.

    ``vector`` turns numbers and counts into numbers and values. Each task goes through its rows starting from the state that all
    tasks share; a round ends by averaging the states of the tasks that had rows.
    """
    spark = examples.sparkSession
    z = np.zeros((outputs, features), dtype=np.float32)
    n = np.zeros_like(z)
    for _ in range(s.rounds):
        state = spark.sparkContext.broadcast((z, n))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own_z, own_n = (a.copy() for a in state.value)
            seen = 0
            for frame in frames:
                seen += len(frame)
                learn(own_z, own_n, ((label, *vector(ids, counts)) for label, ids, counts in decode(frame)), s)
            if seen:
                yield pd.DataFrame({"z": [own_z.tobytes()], "n": [own_n.tobytes()]})

        states = examples.coalesce(s.shards).mapInPandas(run, "z binary, n binary").collect()  # at most ``shards`` rows
        if not states:
            break
        z = np.mean([np.frombuffer(r.z, dtype=np.float32) for r in states], axis=0).reshape(z.shape)
        n = np.mean([np.frombuffer(r.n, dtype=np.float32) for r in states], axis=0).reshape(n.shape)
        state.unpersist()
    return weights(z, n, s)


def in_sample(identifier: str, fraction: float):
    """True for about this fraction of identifiers."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col(identifier).cast("string")), 11) < F.lit(int(min(1.0, fraction) * (1 << 53)))


def turn(identifier: str):
    """Place of a row in the order of training, by a hash of its identifier."""
    return F.xxhash64(F.lit("turn"), F.col(identifier).cast("string")).alias("turn")
