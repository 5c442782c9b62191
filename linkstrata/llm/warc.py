"""Evidence pages as WARC archives: writer with revisit records and a salvage reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstrata.functions.tables import join_path
from linkstrata.llm.common import lookup_weighted, partitions, snippet, stage
from linkstrata.llm.files import load, publish

# Fixed values of the WARC and gzip formats.
VERSION = b"WARC/1.1"
VERSION_LINE = b"WARC/1."
END_OF_HEAD = b"\r\n\r\n"
MEMBER_MAGIC = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DEFAULT_DATE = "1970-01-01T00:00:00Z"
CHUNK = 1 << 16
BATCH_BYTES = 8 * 1024 * 1024
FOUND = (
    "file string, offset bigint, end bigint, status string, reason string, evidence_id string, record_type string, refers_to string, "
    "url string, retrieved_at string, payload binary, payload_digest string, payload_bytes bigint"
)


def _plain(value: object) -> str:
    """A header value on one line."""
    return quote(str(value), safe=" !\"#$%&'()*+,/:;<=>?@[\\]^`{|}~") if not str(value).isprintable() or not str(value).isascii() else str(value)


def encode_record(evidence_id, payload: bytes, refers_to=None, revisit: bool = False, url=None, retrieved_at=None, content_type=None) -> bytes:
    """One record as a gzip member. A revisit has the HTTP head only; its headers state the full payload's digest and length."""
    digest = hashlib.sha256(payload).hexdigest()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: {_plain(content_type or 'text/html; charset=utf-8')}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    name = "" if evidence_id is None else quote(str(evidence_id), safe="")
    lines = [
        VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {digest} {revisit}')}>",
        f"WARC-Date: {_plain(retrieved_at or DEFAULT_DATE)}", f"WARC-Target-URI: {_plain(url or 'urn:evidence:' + name)}",
        "Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if evidence_id is not None:
        lines.append(f"WARC-Evidence-ID: {name}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To-Evidence: {quote(str(refers_to), safe='')}"]
    lines.append(f"Content-Length: {len(block)}")
    raw = "\r\n".join(lines).encode() + END_OF_HEAD + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse_record(data: memoryview, at: int) -> tuple[int, dict]:
    """Record at ``at`` of plain WARC data: its end and fields. Raises ValueError if a check fails."""
    if bytes(data[at:at + len(VERSION_LINE)]) != VERSION_LINE:
        raise ValueError("no version line")
    size = 4096
    while True:  # headers are short; look further only if they are not
        window = bytes(data[at:at + size])
        stop = window.find(END_OF_HEAD)
        if stop >= 0:
            break
        if at + size >= len(data):
            raise ValueError("header is cut off")
        size *= 4
    headers = {}
    for line in window[:stop].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("malformed header line")
        headers[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdigit():
        raise ValueError("no content length")
    begin = at + stop + len(END_OF_HEAD)
    end = begin + int(headers["content-length"])
    if end + 4 > len(data) or bytes(data[end:end + 4]) != b"\r\n\r\n":
        raise ValueError("block is cut off")
    block = data[begin:end]
    algorithm, _, digest = headers.get("warc-block-digest", "").partition(":")
    if algorithm == "sha256" and hashlib.sha256(block).hexdigest() != digest:
        raise ValueError("wrong block digest")
    kind = headers.get("warc-type", "")
    body = bytes(block)
    if headers.get("content-type", "").startswith("application/http"):
        body = body.partition(END_OF_HEAD)[2]
    found = hashlib.sha256(body).hexdigest()
    stated = headers.get("warc-payload-digest", "")
    if kind == "revisit":
        digest, length, body = stated.removeprefix("sha256:"), int(headers.get("warc-payload-length", "0")), None
    else:
        if stated.startswith("sha256:") and stated[7:] != found:
            raise ValueError("wrong payload digest")
        digest, length = found, len(body)
    return end + 4, {
        "evidence_id": _named(headers.get("warc-evidence-id")), "record_type": kind, "refers_to": _named(headers.get("warc-refers-to-evidence")),
        "url": headers.get("warc-target-uri"), "retrieved_at": headers.get("warc-date"), "payload": body, "payload_digest": digest, "payload_bytes": length,
    }


def _named(value: str | None) -> str | None:
    return None if value is None else unquote(value)


class Damaged(ValueError):
    """A gzip member that fails: ``content`` is what it held before the damage was noticed."""

    def __init__(self, reason: str, content: bytes):
        super().__init__(reason)
        self.content = content


def inflate_member(data: memoryview, at: int) -> tuple[int, bytes]:
    """Gzip member at ``at``: its end and content. Raises Damaged if it is damaged or cut off."""
    unpacker = zlib.decompressobj(31)
    parts, position = [], at
    while not unpacker.eof:
        chunk = data[position:position + CHUNK]
        if not len(chunk):
            raise Damaged("member is cut off", b"".join(parts))
        before = unpacker.copy()
        try:
            parts.append(unpacker.decompress(chunk))
        except zlib.error as error:
            try:
                for i in range(len(chunk)):  # an error drops the output of its whole call
                    parts.append(before.decompress(chunk[i:i + 1]))
            except zlib.error:
                pass
            raise Damaged(f"damaged member: {error}", b"".join(parts)) from None
        position += len(chunk)
    return position - len(unpacker.unused_data), b"".join(parts)


def _salvage(data: bytes, mark: bytes, read) -> Iterator[tuple[int, int, str | None, object]]:
    """(start, end, reason, result) of each unit; a failed check quarantines the bytes up to the next mark that reads well."""
    view, at = memoryview(data), 0
    while at < len(data):
        try:
            end, result = read(view, at)
            yield at, end, None, result
            at = end
            continue
        except ValueError as error:
            reason = str(error)
        start, at = at, data.find(mark, at + 1)
        while at >= 0:
            try:
                end, result = read(view, at)
                break
            except ValueError:
                at = data.find(mark, at + 1)
        if at < 0:
            yield start, len(data), reason, None
            return
        yield start, at, reason, None
        yield at, end, None, result
        at = end


def _proven(record: memoryview) -> bool:
    """Whether the record states a digest of its block that can be checked, and has it."""
    head, _, rest = bytes(record).partition(END_OF_HEAD)
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    algorithm, _, digest = headers.get(b"warc-block-digest", b"").decode("latin-1").partition(":")
    if algorithm not in ("sha256", "sha1"):
        return False
    found = hashlib.new(algorithm, rest[:int(headers[b"content-length"])])
    return digest.lower() in (found.hexdigest(), base64.b32encode(found.digest()).decode().lower())


def _before_damage(content: bytes) -> list[dict]:
    """Records of a damaged member that their own digests prove. A member of one record counts as a whole: without its checksum it is none."""
    view = memoryview(content)
    found = [(start, end, fields) for start, end, reason, fields in _salvage(content, VERSION_LINE, parse_record) if reason is None and _proven(view[start:end])]
    if len(found) == 1 and found[0][:2] == (0, len(content)):
        return []
    return [fields for _, _, fields in found]


def _unit(view: memoryview, at: int, certain: bool) -> tuple[int | None, list[dict], str | None]:
    """Record or member at ``at``: its end, rows, and the failed check. The end of a damaged member that still holds records is None.

    Raises ValueError if there is nothing of use; unless ``certain``, a member without a record counts as such.
    """
    if bytes(view[at:at + len(VERSION_LINE)]) == VERSION_LINE:
        end, fields = parse_record(view, at)
        return end, [{"status": "record", "reason": None, **fields}], None
    if bytes(view[at:at + len(MEMBER_MAGIC)]) != MEMBER_MAGIC:
        raise ValueError("no member and no version line")
    try:
        end, content = inflate_member(view, at)
    except Damaged as error:
        rows = [{"status": "record", "reason": None, **fields} for fields in _before_damage(error.content)]
        if not rows:
            raise
        return None, rows, str(error)
    rows = [
        {"status": "gap" if inner else "record", "reason": inner and f"inside a member: {inner}", **(fields or {})}
        for _, _, inner, fields in _salvage(content, VERSION_LINE, parse_record)
    ]
    if not certain and all(r["status"] == "gap" for r in rows):
        raise ValueError("member without a record")
    return end, rows, None


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of one archive, plain, gzip or mixed, in order of their offsets.

    Records carry the byte range of their member. Each quarantined range is a row with ``status`` gap and the failed check; after it
    the reader goes on at the nearer of the next member and the next version line that read well. Records of a damaged
    member that come before the damage carry the range of the gap.
    """
    view, at = memoryview(data), 0
    gap: tuple[int, str, list[dict]] | None = None  # start, failed check, records that its member still held

    def closed(end: int) -> Iterator[dict]:
        start, reason, rows = gap
        for row in rows:
            yield {"offset": start, "end": end, **row}
        yield {"offset": start, "end": end, "status": "gap", "reason": reason}

    ahead = {mark: -1 for mark in (VERSION_LINE, MEMBER_MAGIC)}

    def onward(start: int) -> int:
        """The next mark of either kind; each is looked for once only."""
        for mark, place in ahead.items():
            if place < start:
                found = data.find(mark, start)
                ahead[mark] = found if found >= 0 else len(data)
        return min(ahead.values())

    while at < len(data):
        try:
            end, rows, reason = _unit(view, at, certain=gap is None)
        except ValueError as error:
            gap = gap or (at, str(error), [])
            at = onward(at + 1)
            continue
        if gap:
            yield from closed(at)
            gap = None
        if end is None:
            gap = (at, reason, rows)
            at = onward(at + 1)
            continue
        for row in rows:
            yield {"offset": at, "end": end, **row}
        at = end
    if gap:
        yield from closed(len(data))


def payload_copies(evidence: DataFrame, least_bytes: int) -> DataFrame:
    """``evidence_id``, ``digest``, ``refers_to`` of the rows whose payload another row with a smaller id has too."""
    rows = stage(evidence.select("evidence_id", F.sha2(snippet(), 256).alias("digest"), F.octet_length(snippet()).alias("size")), "payloads")
    groups = (
        rows.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("evidence_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND refers_to IS NOT NULL")
    )
    found = lookup_weighted(rows, groups, ["digest"], "n", rows.count())
    return found.filter("refers_to IS NOT NULL AND NOT (evidence_id <=> refers_to)").select("evidence_id", "digest", "refers_to").distinct()


def write_warc(evidence: DataFrame, path: str, least_bytes: int = 100) -> DataFrame:
    """Writes one WARC record per evidence row, payload the snippet in UTF-8, as gzip members of ``part-NNNNN.warc.gz``.

    Reads ``evidence_id`` and ``snippet``, and ``url``, ``retrieved_at``, ``content_type`` where they are present. Of rows with
    equal payloads of at least ``least_bytes`` bytes, that with the smallest id is written as response, others as revisit of it. Returns
    the table ``files`` under ``path``: ``file``, ``n_records``, ``n_bytes``.

    Null snippets are empty payloads. Null ids rank last: such a row is a revisit if any other row has the payload, else a response. Rows that repeat the
    smallest id and its payload are responses too. Null urls, dates and types get defaults. An empty table writes no archive.
    """
    spark = evidence.sparkSession
    optional = [F.col(c).cast("string").alias(c) if c in evidence.columns else F.lit(None).cast("string").alias(c) for c in ("url", "retrieved_at", "content_type")]
    rows = evidence.select("evidence_id", snippet().alias("payload"), *optional).withColumn("_digest", F.sha2("payload", 256)).alias("r")
    copies = payload_copies(evidence, least_bytes).alias("c")
    same = F.col("r.evidence_id").eqNullSafe(F.col("c.evidence_id")) & (F.col("r._digest") == F.col("c.digest"))
    marked = rows.join(copies, same, "left").select("r.evidence_id", "r.payload", "c.refers_to", "r.url", "r.retrieved_at", "r.content_type")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():05d}.warc.gz"
        written = [0]

        def members() -> Iterator[bytes]:
            for batch in batches:
                for i in range(batch.num_rows):
                    identifier, payload, refers, url, date, kind = (c[i].as_py() for c in batch.columns)
                    written[0] += 1
                    yield encode_record(identifier, payload.encode(), refers, refers is not None, url, date, kind)

        source = members()
        first = next(source, None)
        if first is None:
            return

        def everything() -> Iterator[bytes]:
            yield first
            yield from source

        size = publish(join_path(path, name), everything())
        yield pa.RecordBatch.from_pylist([{"file": name, "n_records": written[0], "n_bytes": size}])

    files = marked.mapInArrow(write, "file string, n_records bigint, n_bytes bigint")
    files.write.parquet(join_path(path, "files"))
    return spark.read.schema(files.schema).parquet(join_path(path, "files"))


def read_warc(spark: SparkSession, path: str, pattern: str = "*.warc*") -> DataFrame:
    """Reads all archives of a folder, one file per task step, and salvages what damaged ones still hold.

    Returns ``file``, ``offset``, ``end``, ``status`` (record or gap), ``reason`` of a gap, and for records ``evidence_id`` and ``refers_to`` as
    text, ``record_type``, ``url``, ``retrieved_at``, ``payload`` (null for revisits), ``payload_digest`` (lower-case hex SHA-256) and
    ``payload_bytes`` of the full payload. After a failed check (gzip data, header, length, digest) the reader looks for the next
    member or version line, whichever is nearer, that reads well, and logs the bytes between as a gap; records of a damaged member before
    its damage are kept if their own digests prove them. A folder without archives gives an empty result.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in salvage(load(name)):
                    rows.append({"file": name, **row})
                    held += len(row.get("payload") or b"") + 200
                    if held >= BATCH_BYTES:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    return listed.repartition(partitions(spark)).mapInArrow(read, FOUND)


SCHEMA = pa.schema([(n, pa.int64() if t == "bigint" else pa.binary() if t == "binary" else pa.string()) for n, t in (f.strip().split(" ") for f in FOUND.split(","))])


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in SCHEMA.names} for r in rows], schema=SCHEMA)


def quarantined(found: DataFrame) -> DataFrame:
    """The byte ranges that the reader could not use: ``file``, ``offset``, ``end``, ``reason``."""
    return found.filter("status = 'gap'").select("file", "offset", "end", "reason")
