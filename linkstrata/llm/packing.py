"""Packing of evidence token sequences into training windows of several lengths."""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from linkstrata.llm.common import snippet
from linkstrata.llm.tokens import encoder

CONTEXTS = (256, 512, 1024, 2048)
STEP_TOKENS = 64 * 2048
FLUSH_BYTES = 8 * 1024 * 1024


class Packer:
    """Packs the documents of one partition; every finished window is exactly as long as its context.

    A piece is (length, number, evidence_id, start in the document, ids, tokens of the document). Contexts are powers of two.
    """

    def __init__(self, contexts: Sequence[int], step_tokens: int):
        self.contexts = sorted(contexts)
        if any(c < 1 or c & (c - 1) for c in self.contexts):
            raise ValueError("contexts must be powers of two")
        self.step_tokens = step_tokens
        self.pool: list[tuple] = []
        self.numbers = count()
        self.sequences = count()
        self.steps = count()
        self.open_steps: dict[int, list[int]] = defaultdict(lambda: [-1, 0])
        self.rows: list[tuple] = []
        self.held = 0

    def add(self, evidence_id, ids: bytes) -> None:
        """Cuts full windows of the longest context off a document and routes the rest by its length."""
        total, top, at = len(ids) // 4, self.contexts[-1], 0
        while total - at >= top:
            self._emit([self._piece(evidence_id, at, ids[4 * at:4 * (at + top)], total)], top)
            at += top
        if total > at:
            insort(self.pool, self._piece(evidence_id, at, ids[4 * at:], total))

    def _piece(self, evidence_id, start: int, ids: bytes, total: int) -> tuple:
        return len(ids) // 4, next(self.numbers), evidence_id, start, ids, total

    def _split(self, piece: tuple, size: int) -> tuple[tuple, tuple]:
        _, _, evidence_id, start, ids, total = piece
        return self._piece(evidence_id, start, ids[:4 * size], total), self._piece(evidence_id, start + size, ids[4 * size:], total)

    def pack(self, last: bool = False) -> None:
        """Packs the pool, longest tier first.

        The longest document opens a window of the least context that holds it. The gap is filled by the longest documents that
        fit, which come from the same or shorter tiers; what is left of the gap is filled by the head of the shortest document.
        A window that cannot be filled waits for more documents, or is cut into powers of two at the end.
        """
        pool = self.pool
        while pool:
            piece = pool.pop()
            context = self.contexts[bisect_left(self.contexts, piece[0])]
            window, gap = [piece], context - piece[0]
            while gap and pool:
                at = bisect_right(pool, gap, key=lambda p: p[0]) - 1
                if at >= 0:
                    window.append(pool.pop(at))
                else:
                    head, tail = self._split(pool.pop(0), gap)
                    window.append(head)
                    insort(pool, tail)
                gap -= window[-1][0]
            if not gap:
                self._emit(window, context)
            elif last:
                self._finish(window)
            else:
                self.pool = sorted(window)
                return

    def _finish(self, window: list[tuple]) -> None:
        """Cuts a last window into parts whose lengths are the powers of two that add up to it."""
        left = sum(p[0] for p in window)
        while left:
            size = 1 << (left.bit_length() - 1)
            part, room = [], size
            while room:
                piece = window.pop(0)
                if piece[0] > room:
                    piece, tail = self._split(piece, room)
                    window.insert(0, tail)
                part.append(piece)
                room -= piece[0]
            self._emit(part, size)
            left -= size

    def _emit(self, window: list[tuple], context: int) -> None:
        sequence, offset, step = next(self.sequences), 0, self.open_steps[context]
        if step[0] < 0 or step[1] + context > self.step_tokens:
            step[:] = [next(self.steps), 0]
        step[1] += context
        for length, _, evidence_id, start, ids, total in window:
            self.rows.append((evidence_id, start, length, ids, total, sequence, offset, context, step[0]))
            offset += length
            self.held += len(ids)


def pack_snippets(evidence: DataFrame, tokenizer: str, end_id: int = 1, contexts: Sequence[int] = CONTEXTS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Packs the token ids of all evidence into windows of several context sizes.

    Reads ``evidence_id`` and ``snippet``; ``tokenizer`` is the path of a vocabulary file, ``end_id`` ends each document. Returns
    one row per piece of a document: ``evidence_id``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit numbers),
    ``doc_tokens``, ``sequence_id``, ``offset``, ``context`` (length of the sequence), ``step_group``. Every window is full, so no padding is
    needed: its length is one of ``contexts``, or a smaller power of two for the last few of a partition. All windows of a step group
    have the same length and together at most ``step_tokens`` ids; all groups but the last of a partition and length have just as many.

    Each partition of the input packs its own rows in one pass, without a shuffle; ids of sequences and groups carry the partition
    in their upper bits. Null snippets count as empty and are packed as the end id alone. Null or repeated ids are packed like
    others. Very long documents are cut into whole windows first. An empty table gives an empty result.
    """
    longest = max(contexts)
    if step_tokens < longest:
        raise ValueError("a step must hold at least one window")
    rows = evidence.select("evidence_id", snippet().alias("snippet"))
    id_type = rows.schema["evidence_id"].dataType.simpleString()
    end = struct.pack("<I", end_id)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        packer = Packer(contexts, step_tokens)
        encode = encoder(tokenizer).encode
        kind = None

        def drained() -> pa.RecordBatch:
            columns = list(zip(*packer.rows))
            columns[5] = [base | s for s in columns[5]]
            columns[8] = [base | s for s in columns[8]]
            packer.rows, packer.held = [], 0
            types = (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = ["evidence_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "context", "step_group"]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)

        pooled = 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for identifier, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                packer.add(identifier, ids)
                pooled += len(ids)
                if pooled >= FLUSH_BYTES:
                    packer.pack()
                    pooled = 0
                    if packer.rows:
                        yield drained()
        packer.pack(last=True)
        if packer.rows:
            yield drained()

    return rows.mapInArrow(pack, (
        f"evidence_id {id_type}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, context bigint, step_group bigint"
    ))
