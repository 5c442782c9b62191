"""Token sequences of evidence as length-delimited binary records with an offset index."""

from __future__ import annotations

import random
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstrata.functions.tables import join_path
from linkstrata.llm.common import partitions, snippet
from linkstrata.llm.files import load, publish
from linkstrata.llm.tokens import encoder

# Fixed values of the file format: a frame is the payload's length (unsigned 64 bit), the masked checksum of those eight bytes, the
# payload, and the masked checksum of the payload (unsigned 32 bit, all little-endian). A masked checksum is the CRC-32 turned
# right by 15 bits plus the constant, modulo 2^32. A payload is the kind of the id (0 null, 1 integer, 2 text), the length of its
# text, the text in UTF-8, the width of a token id in bytes (2 or 4) and the token ids. An index entry has the frame's offset, its
# length and the number of token ids before it in the file.
MASK = 0xA282EAD8
FRAME = struct.Struct("<QI")
CHECK = struct.Struct("<I")
HEAD = struct.Struct("<BI")
ENTRY = "<QQQ"
ENTRY_BYTES = struct.calcsize(ENTRY)
BATCH_BYTES = 8 * 1024 * 1024


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, CHECK.pack(masked(length)), payload, CHECK.pack(masked(payload))))


def unframe(data: bytes | memoryview, offset: int, length: int) -> memoryview:
    """Payload of the frame at ``offset``; raises ValueError if a length or checksum is wrong."""
    view = memoryview(data)[offset:offset + length]
    if len(view) != length or length < 16:
        raise ValueError(f"record at {offset} is cut off")
    size, check = FRAME.unpack_from(view)
    if masked(view[:8]) != check or size != length - 16:
        raise ValueError(f"record at {offset} has a wrong length")
    payload = view[12:12 + size]
    if CHECK.unpack_from(view, 12 + size)[0] != masked(payload):
        raise ValueError(f"record at {offset} has a wrong checksum")
    return payload


def pack_payload(identifier, ids: bytes) -> bytes:
    name = b"" if identifier is None else str(identifier).encode()
    kind = 0 if identifier is None else 1 if isinstance(identifier, int) else 2
    numbers = np.frombuffer(ids, dtype="<u4")
    width = 2 if not len(numbers) or int(numbers.max()) < 65536 else 4
    return b"".join((HEAD.pack(kind, len(name)), name, bytes([width]), numbers.astype(f"<u{width}").tobytes()))


def unpack_payload(payload: memoryview) -> tuple[str | None, bytes]:
    kind, size = HEAD.unpack_from(payload)
    at = HEAD.size + size
    name = None if kind == 0 else bytes(payload[HEAD.size:at]).decode()
    return name, np.frombuffer(payload[at + 1:], dtype=f"<u{payload[at]}").astype("<u4").tobytes()


def write_token_records(evidence: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Tokenizes whole snippets and writes them as framed records in ascending ``evidence_id`` order.

    Reads ``evidence_id`` (integer or text) and ``snippet``; ``tokenizer`` is the path of a vocabulary file, ``end_id`` ends each
    sequence. Writes ``shard-NNNNN.rec`` and its offset index ``shard-NNNNN.idx`` under ``path``, a shard per range of ids, and
    the table ``shards`` there, which it returns: ``shard``, ``n_records``, ``n_tokens``, ``n_bytes``.

    Null snippets count as empty and give the end id alone. Null ids come first. Rows that repeat an id each have a record, ordered
    by a hash of the snippet. Long snippets are never cut. An empty table writes no shard and an empty ``shards`` table.
    """
    spark = evidence.sparkSession
    rows = evidence.select("evidence_id", snippet().alias("snippet")).withColumn("tie", F.xxhash64("snippet"))
    ranged = rows.repartitionByRange(partitions(spark), "evidence_id", "tie").sortWithinPartitions("evidence_id", "tie")
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        entries: list[bytes] = []
        totals = [0, 0]

        def frames() -> Iterator[bytes]:
            encode = encoder(tokenizer).encode
            for batch in batches:
                for identifier, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = encode(text.as_py()) + end
                    data = frame(pack_payload(identifier, ids))
                    entries.append(struct.pack(ENTRY, totals[0], len(data), totals[1]))
                    totals[0] += len(data)
                    totals[1] += len(ids) // 4
                    yield data

        source = frames()
        first = next(source, None)
        if first is None:
            return
        base = join_path(path, f"shard-{shard:05d}")
        publish(f"{base}.rec", _chained(first, source))
        publish(f"{base}.idx", iter((b"".join(entries),)))
        yield pa.RecordBatch.from_pylist([{"shard": shard, "n_records": len(entries), "n_tokens": totals[1], "n_bytes": totals[0]}])

    shards = ranged.select("evidence_id", "snippet").mapInArrow(write, "shard bigint, n_records bigint, n_tokens bigint, n_bytes bigint")
    shards.write.parquet(join_path(path, "shards"))
    return spark.read.schema(shards.schema).parquet(join_path(path, "shards"))


def _chained(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


def read_token_records(spark: SparkSession, path: str, shuffle_seed: int | None = None) -> DataFrame:
    """Reads framed records through their offset index, checking each length and checksum.

    Returns ``shard``, ``position`` (in the shard), ``evidence_id`` as text, ``first_token`` (ids before it in the shard), ``ids``
    (little-endian unsigned 32-bit numbers). With ``shuffle_seed`` the records of a shard come in a random order that the seed
    and shard fix. A wrong frame raises an error that names the record.
    """
    shards = spark.read.schema("shard bigint, n_records bigint, n_tokens bigint, n_bytes bigint").parquet(join_path(path, "shards"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                base = join_path(path, f"shard-{shard:05d}")
                data, index = load(f"{base}.rec"), load(f"{base}.idx")
                order = list(range(len(index) // ENTRY_BYTES))
                if shuffle_seed is not None:
                    random.Random(f"{shuffle_seed}-{shard}").shuffle(order)
                rows: list[tuple] = []
                held = 0
                for position in order:
                    offset, length, first = struct.unpack_from(ENTRY, index, position * ENTRY_BYTES)
                    name, ids = unpack_payload(unframe(data, offset, length))
                    rows.append((shard, position, name, first, ids))
                    held += len(ids)
                    if held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    spread = shards.select("shard").repartition(partitions(spark))
    return spread.mapInArrow(read, "shard bigint, position bigint, evidence_id string, first_token bigint, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    names = ("shard", "position", "evidence_id", "first_token", "ids")
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=list(names))
