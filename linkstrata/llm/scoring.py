"""Language-model scores of evidence: log probability of whole snippets."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstrata.llm import gru
from linkstrata.llm.common import share, snippet, stage

END = b""
KNOWN_SHARE = 1 << 17
LEAST_COUNT = 2
CARRIED = 4
SPELLING = 64
COUNTED = 200_000
CHUNK_TOKENS = 3_000_000
STORED_TOKENS = 1_000_000
ROUNDS = 3
PIECE = 1 << 14
AVERAGED = 256


def words_of(text: str) -> list[bytes]:
    """Words of the text with A-Z lower-cased, then the end."""
    return [*text.encode().lower().split(), END]


def spelling_class(word: bytes) -> int:
    """Class of a rarer word by its last two bytes."""
    return zlib.crc32(word[-2:]) % SPELLING


def word_counts(evidence: DataFrame) -> DataFrame:
    """``word`` (bytes; empty is the end of a text), ``spelling``, ``n`` over all rows given; combined in each task before the shuffle."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def drained() -> pa.RecordBatch:
            words = list(held)
            spelling = [spelling_class(w) for w in words]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(spelling, pa.int32()), pa.array(list(held.values()), pa.int64())], names=["word", "spelling", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                held.update(words_of(text.as_py()))
                if len(held) >= COUNTED:
                    yield drained()
        yield drained()

    counted = evidence.select(snippet().alias("snippet")).mapInArrow(tally, "word binary, spelling int, n bigint")
    return counted.groupBy("word", "spelling").agg(F.sum("n").alias("n"))


class Lexicon:
    """Known words: token number, log10(count + 1) and the fixed part of the score of each.

    ``known`` are words with at least a given share of all tokens, so that their number is bounded. Those seen ``least`` times (LEAST_COUNT if that is more) have an
    embedding and a learned place in a class; classes are about as many as the root of these words, with about equal shares of the tokens. A rarer word has the probability (count + 1) / (tokens + words + 1) within its spelling class, where an unseen word
    counts as one more word of the class, never seen.
    """

    def __init__(self, known: list[tuple[bytes, int, int]], classes: dict[int, tuple[int, int]], total: int, least: int = LEAST_COUNT):
        frequent = sorted((w for w in known if w[0] != END and w[2] >= max(least, LEAST_COUNT)), key=lambda w: (-w[2], w[0]))
        end = next((n for w, _, n in known if w == END), 0)
        parts = math.ceil(math.sqrt(len(frequent)))
        mass, before, bounds = sum(n for _, _, n in frequent), 0, [0, 1]
        for i, (_, _, n) in enumerate(frequent):
            if i and before * parts // mass > (before - frequent[i - 1][2]) * parts // mass:
                bounds.append(1 + i)
            before += n
        if frequent:
            bounds.append(1 + len(frequent))
        self.layout = gru.Layout(tuple(bounds), SPELLING)
        ranked = [(END, 0, end), *frequent]
        width = [classes.get(c, (0, 0)) for c in range(SPELLING)]
        self.class_log = np.array([math.log(n + v + 1) for n, v in width])
        numbered = {w for w, _, _ in ranked}
        rare = [w for w in known if w[0] not in numbered]
        self.place = {w: i for i, (w, _, _) in enumerate(ranked + rare)}
        counts = np.array([n for _, _, n in ranked + rare], dtype=np.float64)
        self.numbers = np.array([*range(len(ranked)), *(len(ranked) + c for _, c, _ in rare)], dtype=np.int64)
        self.log_count = np.log10(counts + 1)
        self.fixed = np.zeros(len(counts))
        if rare:
            spelling = np.array([c for _, c, _ in rare])
            self.fixed[len(ranked):] = np.log(counts[len(ranked):] + 1) - self.class_log[spelling]
        sizes = np.array([sum(n for _, _, n in ranked[a:b]) for a, b in zip(bounds, bounds[1:])] + [n for n, _ in width], dtype=np.float64)
        self.class_bias = np.log((sizes + 1) / (sizes + 1).sum())
        self.word_bias = np.log(np.array([n for _, _, n in ranked], dtype=np.float64) + 1)

    def read(self, text: str) -> tuple[np.ndarray, int, float, float, list[bytes]]:
        """Token numbers; known tokens, their summed log10(count + 1), the fixed part of the score (natural log), and the other words."""
        words = words_of(text)
        places = np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        unknown = np.flatnonzero(places < 0)
        found = places[places >= 0]
        numbers = np.empty(len(words), dtype=np.int64)
        numbers[places >= 0] = self.numbers[found]
        logs = self.log_count[found]
        others = [words[i] for i in unknown]
        spelling = np.fromiter(map(spelling_class, others), dtype=np.int64, count=len(others))
        numbers[unknown] = self.layout.frequent + spelling
        return numbers, int(np.count_nonzero(logs > 0)), float(logs.sum()), float(self.fixed[found].sum() - self.class_log[spelling].sum()), others


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """One long array cut into parameters of the shapes of ``like``."""
    parts = np.split(flat.astype(np.float32), np.cumsum([v.size for v in like.values()])[:-1])
    return {key: part.reshape(value.shape) for part, (key, value) in zip(parts, like.items())}


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    values, sizes = column.flatten().to_numpy().astype(np.int64), np.diff(column.offsets.to_numpy())
    return np.split(values, np.cumsum(sizes)[:-1]) if len(sizes) else []


def encode_snippets(rows: DataFrame, lexicon) -> DataFrame:
    """Every row as token numbers, once for training and scoring.

    Adds to ``evidence_id`` and ``held_out``: ``row`` (unique), ``tokens``, ``seen`` (tokens of the lexicon that training has seen), ``logs`` (their summed log10(count + 1)),
    ``fixed`` (fixed part of the score) and ``others`` (words that are not in the lexicon).
    """
    kind = rows.schema["evidence_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, base = lexicon.value, TaskContext.get().partitionId() << 33
        done, held, size = 0, [], 0

        def drained(id_type) -> pa.RecordBatch:
            nonlocal done, held, size
            offsets = np.concatenate([[0], np.cumsum([len(h[2][0]) for h in held])]).astype(np.int32)
            out = pa.RecordBatch.from_arrays([
                pa.array([base | done + i for i in range(len(held))], pa.int64()), pa.array([h[0] for h in held], id_type), pa.array([h[1] for h in held], pa.bool_()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([h[2][0] for h in held]).astype(np.int32))),
                *[pa.array([h[2][i] for h in held], t) for i, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.list_(pa.binary())))],
            ], names=["row", "evidence_id", "held_out", "tokens", "seen", "logs", "fixed", "others"])
            done += len(held)
            held, size = [], 0
            return out

        for batch in batches:
            for identifier, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                held.append((identifier, out, lex.read(text.as_py())))
                size += len(held[-1][2][0])
                if size >= STORED_TOKENS:
                    yield drained(batch.schema.field(0).type)
            if held:
                yield drained(batch.schema.field(0).type)

    wanted = rows.select("evidence_id", "held_out", snippet().alias("snippet"))
    return wanted.mapInArrow(encode, f"row bigint, evidence_id {kind}, held_out boolean, tokens array<int>, seen bigint, logs double, fixed double, others array<binary>")


def training_rounds(encoded: DataFrame) -> list[DataFrame]:
    """Tokens of all rows that are not held out, dealt by a hash to ROUNDS rounds; every row is in one."""
    return [encoded.filter(~F.col("held_out") & (F.pmod(F.xxhash64("row"), F.lit(ROUNDS)) == i)).select("tokens") for i in range(ROUNDS)]


def train_model(encoded: DataFrame, lexicon, settings: gru.Settings) -> dict[str, np.ndarray]:
    """Learns the recurrent model from all rows that are not held out, at every size of input.

    Every round goes once over its share of the rows: each task learns from its partition of the stored tokens, batch by batch, and the tasks'
    parameters are averaged in Spark by the tokens that they saw, piece by piece and in two steps, so that the driver gets one set of them.
    """
    spark = encoded.sparkSession
    p = gru.start(lexicon.value.layout, lexicon.value.class_bias, lexicon.value.word_bias, settings)
    for rows in training_rounds(encoded):
        state = spark.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer = gru.Trainer(state.value, lexicon.value.layout, settings)
            held, size = [], 0
            for batch in batches:
                held += _lists(batch.column(0))
                size += len(batch.column(0).flatten())
                if size >= CHUNK_TOKENS:
                    trainer.learn(held)
                    held, size = [], 0
            trainer.learn(held)
            if trainer.tokens:
                values = np.concatenate([v.ravel() for v in trainer.p.values()])
                pieces = [values[i:i + PIECE].tobytes() for i in range(0, len(values), PIECE)]
                n, task = len(pieces), TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(n), pa.int32()), pa.array([task] * n, pa.int64()), pa.array([trainer.tokens] * n, pa.int64()), pa.array(pieces, pa.binary())], names=["piece", "task", "weight", "value"],
                )

        def average(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("task")
            total = sum(w * np.frombuffer(v, dtype=np.float32).astype(np.float64) for v, w in zip(frame["value"], frame["weight"]))
            weight = int(frame["weight"].sum())
            return pd.DataFrame({"piece": frame["piece"].iloc[:1].to_numpy(), "task": [int(frame["task"].iloc[0]) // AVERAGED], "weight": [weight], "value": [(total / weight).astype(np.float32).tobytes()]})

        schema = "piece int, task bigint, weight bigint, value binary"
        learned = rows.mapInArrow(run, schema)
        some = learned.groupBy("piece", F.floor(F.col("task") / AVERAGED)).applyInPandas(average, schema)
        found = some.groupBy("piece").applyInPandas(average, schema).select("piece", "value").toPandas()  # as large as one model
        if len(found):
            p = _shaped(np.frombuffer(b"".join(found.sort_values("piece")["value"]), dtype=np.float32), p)
        state.unpersist()
    return p


def score_snippets(evidence: DataFrame, folds: int = 7, held_out_fold: int = 2, settings: gru.Settings = gru.Settings(), known_share: int = KNOWN_SHARE) -> DataFrame:
    """Log10 probability of every whole snippet by a gated recurrent language model, and by word frequencies for comparison.

    Reads ``evidence_id`` and ``snippet``. Rows whose crc32 of the id modulo ``folds`` is ``held_out_fold`` are not learned from. Tokens are words
    between ASCII white space, A-Z lower-cased, then one end. Returns ``evidence_id``, ``held_out``, ``n_tokens``, ``n_known`` (tokens seen in
    training), ``train_tokens`` (N), ``base_score``: sum of log10((c+1)/(N+V+1)) with a token's count c and V distinct training tokens, and
    ``score``: the model's log10 probability of the tokens.

    Word counts are taken over all training rows. Words with 1/``known_share`` of the tokens have a place in the model. Words with less than a CARRIED-th of
    that are not sent to tasks; their counts are joined, and since each has so few tokens no key of that join is hot. The recurrent weights learn from all training rows, each
    seen once (see ``train_model``); texts are read twice, to count and to number their words. Null and empty snippets are the end alone. Null ids are in
    the fold of the empty text. Repeated rows are scored each. Snippets of any length are scored whole. An empty table gives an empty result.
    """
    spark = evidence.sparkSession
    rows = evidence.select("evidence_id", (share("evidence_id", folds) == held_out_fold).alias("held_out"), "snippet")
    counts = stage(word_counts(rows.filter("NOT held_out")), "word-counts", compression="zstd")
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = int(size["n"]), int(size["v"])
    least = max(LEAST_COUNT, -(-total // known_share))
    is_known = (F.col("n") * (known_share * CARRIED) >= total) | (F.length("word") == 0)
    known = [(bytes(r["word"]), r["spelling"], r["n"]) for r in counts.filter(is_known).collect()]  # at most CARRIED * known_share + 1 rows
    rarer = counts.filter((F.col("n") < least) & (F.length("word") > 0))
    classes = {r["spelling"]: (r["n"], r["v"]) for r in rarer.groupBy("spelling").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    lexicon = spark.sparkContext.broadcast(Lexicon(sorted(known), classes, total, least))
    encoded = stage(encode_snippets(rows, lexicon), "lm-tokens", compression="zstd")
    model = spark.sparkContext.broadcast(train_model(encoded, lexicon, settings))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = lexicon.value.layout
        held: list[pa.RecordBatch] = []
        size = 0

        def drained() -> pa.RecordBatch:
            nonlocal held, size
            texts = [t for b in held for t in _lists(b.column(1))]
            logs = gru.score_texts(model.value, layout, texts)
            rows = np.concatenate([b.column(0).to_numpy() for b in held])
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(rows), pa.array([len(t) for t in texts], pa.int64()), pa.array(logs)], names=["row", "n_tokens", "model"])

        for batch in batches:
            held.append(batch)
            size += len(batch.column(1).flatten())
            if size >= CHUNK_TOKENS:
                yield drained()
        if held:
            yield drained()

    scored = encoded.select("row", "tokens").mapInArrow(score, "row bigint, n_tokens bigint, model double")
    rest = counts.filter(~is_known).select("word", "n")
    others = encoded.select("row", F.explode("others").alias("word")).join(rest, "word").groupBy("row").agg(
        F.count(F.lit(1)).alias("more_seen"), F.sum(F.log10(F.col("n") + 1)).alias("more_logs")
    )
    logs = F.coalesce("more_logs", F.lit(0.0))
    return encoded.select("row", "evidence_id", "held_out", "seen", "logs", "fixed").join(scored, "row").join(others, "row", "left").select(
        "evidence_id", "held_out", "n_tokens", (F.col("seen") + F.coalesce("more_seen", F.lit(0))).cast("bigint").alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("logs") + logs - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"), ((F.col("model") + F.col("fixed")) / math.log(10) + logs).alias("score"),
    )
