"""Language of evidence: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstrata.llm.common import share, snippet, stage
from linkstrata.llm.ftrl import EXAMPLE, Settings, decode, encode, in_sample, probabilities, train, turn

FEATURES = 1 << 16
ORDERS = (1, 2, 3)
UNDETERMINED = "und"
SETTINGS = Settings(alpha=0.5, beta=1.0, l1=0.002, l2=0.002, shards=6, rounds=3)
TEMPERATURES = np.exp(np.linspace(math.log(0.05), math.log(5), 93))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of the lower-cased text: their numbers, ascending, and counts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    mixed = np.zeros(len(codes), dtype=np.uint32)
    grams = []
    for order in range(1, max(ORDERS) + 1):
        if len(codes) < order:
            break
        mixed = mixed[:len(codes) - order + 1] * np.uint32(2654435761) + codes[order - 1:] + np.uint32(order)
        if order in ORDERS:
            scattered = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(2246822519)
            grams.append((scattered >> np.uint32(16)).astype(np.uint16))
    if not grams:
        return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)
    ordered = np.sort(np.concatenate(grams), kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[starts].astype(np.int32), np.diff(np.append(starts, len(ordered)))


def vector(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit TF-IDF vector with a constant feature appended."""
    vals = (1 + np.log(counts)) * idf[ids]
    norm = math.sqrt(float(vals @ vals))
    vals = vals / norm if norm else vals
    return np.append(ids, FEATURES), np.append(vals, 1).astype(np.float32)


def gram_weights(evidence: DataFrame) -> np.ndarray:
    """Inverse document frequency of every hashed n-gram over all rows given."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents = np.zeros(FEATURES + 1, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                held[gram_counts(text.as_py())[0]] += 1
                documents += 1
        held[FEATURES] = documents
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[used])], names=["gram", "n"])

    counts = evidence.select(snippet().alias("snippet")).mapInArrow(tally, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    df = np.zeros(FEATURES + 1, dtype=np.int64)
    for row in counts.collect():  # at most FEATURES + 1 rows
        df[row["gram"]] = row["n"]
    return np.log((1 + df[FEATURES]) / (1 + df[:FEATURES])) + 1


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Temperature of the grid with the least mean negative log-likelihood; ``logits`` are (classes, rows)."""
    if not len(labels) or logits.shape[0] < 2:
        return 1.0
    losses = [-np.log(np.maximum(probabilities(logits / t)[labels, np.arange(len(labels))], 1e-12)).mean() for t in TEMPERATURES]
    return float(TEMPERATURES[int(np.argmin(losses))])


def predict_language(evidence: DataFrame, folds: int = 3, held_out_fold: int = 1, sample_rows: int = 20_000, settings: Settings = SETTINGS, carry: str | None = None) -> DataFrame:
    """Language of every whole snippet: ``evidence_id``, ``held_out``, ``lang_pred``, ``score`` (0 to 1), and the column ``carry`` as it is.

    Reads ``evidence_id``, ``snippet`` and ``lang``. The project's records have no language field; ``lang`` is a column that the caller adds, null where unknown.
    Rows whose crc32 of the id modulo ``folds`` is ``held_out_fold`` are held out. Of the others, all with a language give the document
    frequencies and the languages; about ``sample_rows`` of them, chosen by a hash of the id, train the weights, and a tenth of these the temperature instead.
    A prediction uses the snippet alone.

    Null snippets and snippets without a letter get ``und`` and score 0; so do all rows if no language can be learned. Null ids are in
    the fold of the empty text. Repeated rows are scored each. Snippets of any length are read whole. Ties go to the first language in
    alphabetical order. An empty table gives an empty result.
    """
    spark = evidence.sparkSession
    learnable = evidence.filter((share("evidence_id", folds) != held_out_fold) & F.col("lang").isNotNull()).select("evidence_id", "snippet", "lang")
    totals = {r["lang"]: r["n"] for r in learnable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    languages = sorted(totals)
    model = None
    if languages:
        idf = spark.sparkContext.broadcast(gram_weights(learnable))
        number = {name: i for i, name in enumerate(languages)}

        def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield encode([(turn, number[lang], *gram_counts(text)) for turn, text, lang in zip(*(c.to_pylist() for c in batch.columns))])

        chosen = learnable.filter(in_sample("evidence_id", sample_rows / sum(totals.values())))
        examples = stage(chosen.select(turn("evidence_id"), snippet().alias("snippet"), "lang").mapInArrow(featured, EXAMPLE), "language-examples", compression="zstd")
        learned = train(examples.filter("turn % 10 <> 0"), len(languages), FEATURES + 1, settings, lambda ids, counts: vector(ids, counts, idf.value))
        held = spark.sparkContext.broadcast(learned)

        def logits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                rows = [(label, *vector(ids, counts, idf.value)) for label, ids, counts in decode(frame)]
                yield pd.DataFrame({"label": [r[0] for r in rows], "logits": [(held.value[:, ids] @ vals).tolist() for _, ids, vals in rows]})

        checks = examples.filter("turn % 10 = 0").mapInPandas(logits, "label int, logits array<double>").collect()  # a tenth of the sample
        scale = temperature(np.array([c["logits"] for c in checks], dtype=np.float64).reshape(len(checks), len(languages)).T, np.array([c["label"] for c in checks], dtype=np.int64))
        model = spark.sparkContext.broadcast((languages, idf.value, learned, scale))

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                if model is None or text is None or not has_letter(text):
                    rows.append((UNDETERMINED, 0.0))
                    continue
                names, weight, learned, scale = model.value
                ids, vals = vector(*gram_counts(text), weight)
                chances = probabilities((learned[:, ids] @ vals).astype(np.float64)[:, None] / scale)[:, 0] if len(names) > 1 else np.ones(1)
                best = int(np.argmax(chances))
                rows.append((names[best], float(chances[best])))
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    more = [carry] if carry else []
    scored = evidence.select("evidence_id", (share("evidence_id", folds) == held_out_fold).alias("held_out"), predicted("snippet").alias("_found"), *more)
    return scored.select("evidence_id", "held_out", "_found.lang_pred", "_found.score", *more)
