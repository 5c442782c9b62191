"""Ranked search of evidence for review items: range-maximum tables over posting lists, best document intervals first."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstrata.functions.tables import top_rows
from linkstrata.llm.common import stage

BEST = 50
BLOCK_TERMS = 200_000
SHARD_POSTINGS = 400_000
BATCH = 128
MERGE_PARTS = 64
UNIT = 1_000_000_000
LETTERS_AND_DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
FOLD = bytes(b if b >= 128 else (bytes([b]).lower()[0] if b in LETTERS_AND_DIGITS else 32) for b in range(256))  # bytes between terms become blanks


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, only A-Z lower-cased."""
    return text.translate(FOLD).split()


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Shard:
    """Posting lists of some documents, with a sparse table of the place of the largest impact in every run of 2^k postings.

    Documents are numbered by length, so that near numbers have like impacts. A posting list is a slice of the flat arrays, ascending by document.
    """

    def __init__(self, document: np.ndarray, term: np.ndarray, count: np.ndarray, lengths: np.ndarray, weights: np.ndarray, documents: int, all_terms: int):
        by_length = np.argsort(lengths, kind="stable")
        self.documents = by_length
        number = np.empty(len(lengths), dtype=np.int64)
        number[by_length] = np.arange(len(lengths))
        measure = 50 + (50 * lengths * documents) // all_terms
        impact = weights[term] * ((UNIT * count) // (1000 * count + 20 * measure[document]))
        self.size = len(lengths)
        key = term * self.size + number[document]
        order = np.argsort(key)
        order = order[impact[order] > 0]
        self.key, self.impact = key[order], impact[order]
        self.document = number[document[order]]
        longest = int(np.bincount(term[order]).max()) if len(order) else 0
        levels = [np.arange(len(order), dtype=np.int32)]
        for k in range(1, longest.bit_length()):
            half = 1 << (k - 1)
            left, right = levels[-1][:-half], levels[-1][half:]
            level = levels[-1].copy()  # the tail, where a run would pass the end, is never asked for
            level[:len(right)] = np.where(self.impact[left] >= self.impact[right], left, right)
            levels.append(level)
        self.table = np.stack(levels)
        self.log = np.zeros(longest + 1, dtype=np.int64)
        for k in range(1, longest.bit_length()):
            self.log[1 << k:] = k

    def _bounds(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the largest impacts of the terms' postings in [left, right), and the document of the largest of them, for each row."""
        filled = right > left
        run = np.where(filled, right - left, 1)
        k = self.log[run]
        start = np.where(filled, left, 0)
        a, b = self.table[k, start], self.table[k, start + run - (1 << k)]
        first = self.impact[a] >= self.impact[b]
        place = np.where(first, a, b)
        top = np.where(filled, self.impact[place], 0)
        best = top.argmax(axis=1)
        return top.sum(axis=1), self.document[place[np.arange(len(place)), best]]

    def search(self, terms: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
        """(score, document row) of at least the best ``k`` documents with score above 0 and not below ``least``; all that tie with the last are among them.

        Open intervals are held with their bound. The best are opened together: the document of the largest impact is scored from its own postings and
        the interval is split there. An interval is dropped once its bound is below the k-th score found so far.
        """
        left = np.searchsorted(self.key, terms * self.size)
        right = np.searchsorted(self.key, (terms + 1) * self.size)
        here = right > left
        if not here.any():
            return []
        terms, left, right = terms[here] * self.size, left[here][None, :], right[here][None, :]
        bound, split = self._bounds(left, right)
        found_score, found_document = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        least = max(least, 1)
        while len(bound):
            if len(bound) > BATCH:
                order = np.argpartition(-bound, BATCH)
                now, later = order[:BATCH], order[BATCH:]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, dtype=np.int64)
            low, high, middle = left[now], right[now], split[now]
            at = np.searchsorted(self.key, terms[None, :] + middle[:, None])
            at = np.clip(at, low, high)
            probe = np.minimum(at, len(self.key) - 1)
            holds = (at < high) & (self.document[probe] == middle[:, None])
            found_score = np.concatenate([found_score, np.where(holds, self.impact[probe], 0).sum(axis=1)])
            found_document = np.concatenate([found_document, middle])
            if len(found_score) >= k:
                least = max(least, int(np.partition(found_score, len(found_score) - k)[len(found_score) - k]))
                kept = found_score >= least
                found_score, found_document = found_score[kept], found_document[kept]
            new_left, new_right = np.concatenate([low, at + holds]), np.concatenate([at, high])
            new_bound, new_split = self._bounds(new_left, new_right)
            bound, split = np.concatenate([bound[later], new_bound]), np.concatenate([split[later], new_split])
            left, right = np.concatenate([left[later], new_left]), np.concatenate([right[later], new_right])
            open_ = bound >= least
            if not open_.all():
                bound, split, left, right = bound[open_], split[open_], left[open_], right[open_]
        return list(zip(found_score[found_score >= least].tolist(), self.documents[found_document[found_score >= least]].tolist()))


def term_counts(evidence: DataFrame, numbers) -> DataFrame:
    """``evidence_id``, ``n`` (all terms with repeats), ``terms`` and ``counts`` of the terms in the broadcast ``numbers``, for every row."""
    kind = evidence.schema["evidence_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = numbers.value.get
        for batch in batches:
            lengths, terms, counts, offsets = [], [], [], [0]
            for text in batch.column(1):
                words = terms_of(text.as_py() or b"")
                held = Counter(map(get, words))
                held.pop(None, None)
                lengths.append(len(words))
                terms.extend(held.keys())
                counts.extend(held.values())
                offsets.append(len(terms))
            at = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int32())),
            ], names=["evidence_id", "n", "terms", "counts"])

    rows = evidence.select("evidence_id", F.col("snippet").cast("binary").alias("snippet"))
    return rows.mapInArrow(count, f"evidence_id {kind}, n bigint, terms array<int>, counts array<int>")


def _best(found: list[tuple], k: int) -> list[tuple]:
    """The best k of (score, id); equal scores by ascending id, null ids last."""
    return sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] if f[1] is not None else 0))[:k]


def _search_block(evidence: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """``item``, ``evidence_id``, ``score``, ``part``: for each (item, terms) the best k rows of every task."""
    spark = evidence.sparkSession
    kind = evidence.schema["evidence_id"].dataType.simpleString()
    words = sorted({t for _, terms in items for t in terms})
    number = {t: i for i, t in enumerate(words)}
    numbers = spark.sparkContext.broadcast(number)  # at most the terms of one block
    counted = stage(term_counts(evidence, numbers), "term-counts")
    size = counted.filter("n > 0").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    documents, all_terms = size["documents"], size["terms"]
    holding = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()  # at most the terms of one block
    weights = np.zeros(len(words), dtype=np.int64)
    for r in holding:
        weights[r["term"]] = term_weight(documents, r["df"])
    asked = spark.sparkContext.broadcast((weights, [(i, np.array(sorted(number[t] for t in terms), dtype=np.int64)) for i, terms in items]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries = asked.value
        best: dict[int, list[tuple]] = {i: [] for i, _ in queries}
        held, postings, id_type = [], 0, None

        def look() -> None:
            together = pa.Table.from_batches(held).combine_chunks()
            ids, (lengths, terms, counts) = together.column(0), (together.column(i) for i in (1, 2, 3))
            document = pc.list_parent_indices(terms).to_numpy().astype(np.int64)
            shard = Shard(
                document, pc.list_flatten(terms).to_numpy().astype(np.int64), pc.list_flatten(counts).to_numpy().astype(np.int64), lengths.to_numpy(), weights, documents, all_terms,
            )
            for item, query in queries:
                least = best[item][-1][0] if len(best[item]) == k else 0
                found = shard.search(query, k, least)
                if found:
                    best[item] = _best(best[item] + [(score, ids[row].as_py()) for score, row in found], k)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                held.append(part)
                postings += pc.sum(pc.list_value_length(part.column(2))).as_py() or 0
                if postings >= SHARD_POSTINGS:
                    look()
                    held, postings = [], 0
        if held:
            look()
        if id_type is not None:
            rows = [(i, d, s) for i, found in best.items() for s, d in found]
            part = TaskContext.get().partitionId() % MERGE_PARTS
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], id_type), pa.array([r[2] for r in rows], pa.int64()), pa.array([part] * len(rows), pa.int32()),
            ], names=["item", "evidence_id", "score", "part"])

    return counted.filter(F.size("terms") > 0).mapInArrow(search, f"item bigint, evidence_id {kind}, score bigint, part int")


def rank_snippets(evidence: DataFrame, items: DataFrame, k: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The best ``k`` evidence rows for every review item.

    Reads ``evidence_id`` and ``snippet``; ``item_id`` and ``message`` of the review items. Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z
    lower-cased. N rows have a term, L is the number of all their terms, n that of one row, df the rows that hold a term, tf its occurrences in one. A term weighs
    w = floor(1000*ln((2N+2)/(2df+1))); a row's score is the sum over the item's distinct terms of w*((10^9*tf) div (1000*tf+20*m)), m = 50+((50*n*N) div L).
    Returns ``item_id``, ``rank`` (from 1), ``evidence_id``, ``score``, without rows of score 0; equal scores by ascending id, null ids last.

    Counts are over all rows. Every task cuts its rows into shards of bounded size and searches each for every item (see ``Shard``); the scores to beat
    are carried from shard to shard, and the best k of each task and item are merged in two steps. Items are taken in blocks of about
    ``block_terms`` distinct terms, so that neither the broadcast nor the driver's share grows with them.

    Null and empty snippets have no term and are never found. A row that is there twice is found twice. Items without a term have no result; each item row is ranked, so
    an item id that is there twice has its ranks twice. Empty tables give an empty result. Other columns are ignored.
    """
    asked = stage(items.select("item_id", F.col("message").cast("binary").alias("message")).withColumn("item", F.monotonically_increasing_id()), "asked-items")
    letters = asked.agg(F.coalesce(F.sum(F.length("message")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(letters / 2 / block_terms))  # a term and the gap behind it take two bytes at least
    found = None
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select("item", "message").collect()
        part = _search_block(evidence, [(r["item"], sorted(set(terms_of(bytes(r["message"] or b""))))) for r in rows], k)
        found = part if found is None else found.unionByName(part)
    order = [F.col("score").desc(), F.col("evidence_id").asc_nulls_last()]
    best = top_rows(top_rows(found, ["item", "part"], order, k).drop("rn"), ["item"], order, k, rank="rank")
    return best.join(asked.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "evidence_id", "score")
