"""Quality of evidence: logistic regression on hashed word n-grams."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstrata.llm.common import share, snippet, stage
from linkstrata.llm.ftrl import EXAMPLE, Settings, encode, in_sample, probabilities, train, turn

FEATURES = 1 << 18
REMEMBERED = 200_000
SETTINGS = Settings(alpha=2.0, beta=1.0, l1=0.001, l2=0.0, shards=6, rounds=8)
_SHAPES = ((re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() else "a" if m[0].islower() else "Aa" if m[0].istitle() else "aA"), (re.compile(r"\d+"), "0"))
_KNOWN: dict[bytes, int] = {}


def _hashes(word: bytes) -> int:
    """Hash of the word in the upper and of its shape in the lower 32 bits. A shape keeps punctuation and says how letters are cased."""
    shape = word.decode()
    for pattern, replacement in _SHAPES:
        shape = pattern.sub(replacement, shape)
    return zlib.crc32(word.lower()) << 32 | zlib.crc32(shape.encode())


def word_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of hashed word n-grams: words and word pairs, shapes in ones, twos and threes, and words said twice."""
    words = text.encode().split()
    new = {w for w in words if w not in _KNOWN}
    if len(_KNOWN) + len(new) > REMEMBERED:
        _KNOWN.clear()
        new = set(words)
    _KNOWN.update((w, _hashes(w)) for w in new)
    both = np.array([_KNOWN[w] for w in words], dtype=np.uint64)
    word, shape = (both >> np.uint64(32)).astype(np.uint32), (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def mixed(parts: list[np.ndarray], kind: int) -> np.ndarray:
        value = np.full(len(parts[0]), kind * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        for part in parts:
            value = (value ^ part) * np.uint32(2654435761)
            value ^= value >> np.uint32(15)
        return value & np.uint32(FEATURES - 1)

    grams = [mixed([word], 1), mixed([word[:-1], word[1:]], 2), mixed([shape], 3), mixed([shape[:-1], shape[1:]], 4), mixed([shape[:-2], shape[1:-1], shape[2:]], 5)]
    grams.append(mixed([np.zeros(int((word[1:] == word[:-1]).sum()), dtype=np.uint32)], 6))
    ordered = np.sort(np.concatenate(grams))
    if not len(ordered):
        return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[starts].astype(np.int32), np.diff(np.append(starts, len(ordered)))


def vector(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vector of damped counts with a constant feature appended."""
    vals = 1 + np.log(counts)
    norm = math.sqrt(float(vals @ vals))
    vals = vals / norm if norm else vals
    return np.append(ids, FEATURES), np.append(vals, 1).astype(np.float32)


def score_quality(evidence: DataFrame, opinions: DataFrame, folds: int = 5, held_out_fold: int = 0, threshold: float = 0.3, sample_rows: int = 20_000, settings: Settings = SETTINGS) -> DataFrame:
    """Quality of every whole snippet: ``evidence_id``, ``held_out``, ``score`` (0 to 1, higher is better), ``predicted`` (1 from ``threshold`` on).

    Reads ``evidence_id`` and ``snippet`` of ``evidence``, and ``evidence_id`` and ``status`` of ``opinions``, the quality opinions: 1 for passed, 0 for not. Opinions
    on rows whose crc32 of the id modulo ``folds`` is ``held_out_fold`` are not learned from. Of the others about ``sample_rows``, chosen by a hash
    of the id, train the weights. A score uses the snippet alone.

    Null snippets count as empty; empty ones get the score of the constant feature. Opinions with a null id or status are ignored; rows that
    several opinions are about are learned from once per opinion. Without opinions every score is 0.5. Null ids are in the fold of the empty text.
    Repeated rows are scored each. Snippets of any length are read whole. An empty table gives an empty result.
    """
    spark = evidence.sparkSession
    usable = opinions.filter(F.col("evidence_id").isNotNull() & F.col("status").isNotNull() & (share("evidence_id", folds) != held_out_fold))
    total = usable.count()
    chosen = in_sample("evidence_id", sample_rows / total if total else 0)
    known = usable.filter(chosen).select(F.col("evidence_id").alias("_id"), F.col("status").cast("int").alias("status"))
    texts = evidence.filter(chosen).select("evidence_id", snippet().alias("snippet"))
    labelled = texts.join(known, F.col("evidence_id") == F.col("_id")).select(turn("evidence_id"), "snippet", "status")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield encode([(turn, status, *word_grams(text)) for turn, text, status in zip(*(c.to_pylist() for c in batch.columns))])

    examples = stage(labelled.mapInArrow(featured, EXAMPLE), "quality-examples", compression="zstd")
    learned = spark.sparkContext.broadcast(train(examples, 1, FEATURES + 1, settings, vector))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = learned.value
        for batch in batches:
            found = []
            for text in batch:
                ids, vals = vector(*word_grams(text))
                found.append(float(probabilities((weights[:, ids] @ vals)[:, None])[0, 0]))
            yield pd.Series(found, dtype="float64")

    rows = evidence.select("evidence_id", (share("evidence_id", folds) == held_out_fold).alias("held_out"), scored(snippet()).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
