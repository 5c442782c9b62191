"""Token records, archives and packing: exact round trips and damaged files."""

import hashlib
import os
import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_samples import EMPTY, evidence, plain, texts
from tokenizers import Tokenizer

from linkstrata.llm.common import fresh_path
from linkstrata.llm.packing import Packer, pack_snippets
from linkstrata.llm.records import frame, read_token_records, unframe, write_token_records
from linkstrata.llm.tokens import encoder
from linkstrata.llm.warc import encode_record, quarantined, read_warc, salvage, write_warc

ROWS = EMPTY + [(i, t) for i, t, _ in texts(n=24)]
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PIECES = st.lists(st.sampled_from(["a", "The", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\xa0", "　", "'s", "'", "I'll", "é", "é", "́", "<|endoftext|>", "12", "ß", "!!", "Σ", "漢字", "x" * 70, "​", "🙂", "\0"]), max_size=14)


@pytest.fixture(scope="module")
def libraries():
    return {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=250, deadline=None)
@given(pieces=PIECES)
def test_encoder_equals_the_library(path, pieces):
    text = "".join(pieces)
    whole = Tokenizer.from_file(path) if path not in _LIBRARIES else _LIBRARIES[path]
    _LIBRARIES[path] = whole
    ids = whole.encode(text, add_special_tokens=False).ids
    assert encoder(path).encode(text) == struct.pack(f"<{len(ids)}I", *ids)


_LIBRARIES: dict = {}


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def test_token_records(spark, libraries):
    rows = [*ROWS, (None, "null id")]
    path = fresh_path(spark, "records")
    shards = write_token_records(evidence(spark, rows, twice=True), path, WORD).collect()
    rows = [*rows, rows[-1]]
    want = sorted((str(i) if i is not None else None, b"".join(struct.pack("<I", x) for x in ids_of(libraries[WORD], t))) for i, t in rows if i is not None)
    got = read_token_records(spark, path).collect()
    assert sorted((r["evidence_id"], bytes(r["ids"])) for r in got if r["evidence_id"] is not None) == want
    assert sum(r["evidence_id"] is None for r in got) == sum(i is None for i, _ in rows)
    ordered = sorted(got, key=lambda r: (r["shard"], r["position"]))
    numbers = [int(r["evidence_id"]) if r["evidence_id"] is not None else -1 for r in ordered]
    assert numbers == sorted(numbers)
    first = defaultdict(int)
    for r in ordered:
        assert r["first_token"] == first[r["shard"]]
        first[r["shard"]] += len(r["ids"]) // 4
    assert {s["shard"]: s["n_tokens"] for s in shards} == dict(first) and sum(s["n_records"] for s in shards) == len(rows)
    mixed = read_token_records(spark, path, shuffle_seed=4)
    assert plain(mixed) == plain(read_token_records(spark, path))
    assert [r["position"] for r in mixed.collect()] != [r["position"] for r in read_token_records(spark, path).collect()]


def test_text_ids_and_wrong_checksum(spark):
    path = fresh_path(spark, "records")
    write_token_records(spark.createDataFrame([("ev ü", "text"), (None, None)], "evidence_id string, snippet string"), path, WORD)
    assert {r["evidence_id"] for r in read_token_records(spark, path).collect()} == {"ev ü", None}
    data = bytearray(frame(b"payload"))
    assert bytes(unframe(bytes(data), 0, len(data))) == b"payload"
    for at in range(len(data)):
        broken = data.copy()
        broken[at] ^= 4
        with pytest.raises(ValueError):
            unframe(bytes(broken), 0, len(broken))
    with pytest.raises(ValueError):
        unframe(bytes(data[:-1]), 0, len(data))


def test_empty_tables(spark):
    none, path = evidence(spark, []), fresh_path(spark, "none")
    assert write_token_records(none, path, WORD).collect() == [] and read_token_records(spark, path).collect() == []
    assert pack_snippets(none, BYTE).collect() == []
    path = fresh_path(spark, "none")
    assert write_warc(none, path).collect() == [] and read_warc(spark, path).collect() == []


def test_packing(spark, libraries):
    rows = ROWS  # one of them has a null id
    pieces = pack_snippets(evidence(spark, rows, twice=False), BYTE, contexts=(256, 512, 1024, 2048), step_tokens=4096).collect()
    docs, sequences, steps = defaultdict(list), defaultdict(list), defaultdict(set)
    for p in pieces:
        docs[p["evidence_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
        steps[p["step_group"], p["context"]].add(p["sequence_id"])
        assert len(p["ids"]) == 4 * p["length"] > 0
    for i, t in rows:
        own = sorted(docs[i], key=lambda p: p["start"])
        ids = ids_of(libraries[BYTE], t)
        assert b"".join(bytes(p["ids"]) for p in own) == struct.pack(f"<{len(ids)}I", *ids)
        assert [p["start"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))] and {p["doc_tokens"] for p in own} == {len(ids)}
    for parts in sequences.values():
        parts.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in parts] == [sum(q["length"] for q in parts[:k]) for k in range(len(parts))]
        total = sum(p["length"] for p in parts)
        assert total == parts[0]["context"] and total & (total - 1) == 0 and total <= 2048
    assert all(len(s) * context <= 4096 for (_, context), s in steps.items()) and len({g for g, _ in steps}) == len(steps)
    assert len(sequences) <= sum(len(p["ids"]) for p in pieces) / 4 / 256 + 3 * 9


def test_short_documents_fill_gaps():
    packer = Packer((256, 512, 1024, 2048), 1 << 17)
    for number, size in enumerate([1500, 300, 248, 700, 324, 200, 56]):
        packer.add(number, bytes(4 * size))
    packer.pack(last=True)
    windows = defaultdict(list)
    for identifier, _, length, _, _, sequence, *_ in packer.rows:
        windows[sequence].append((identifier, length))
    assert sorted(windows.values()) == sorted([[(0, 1500), (4, 324), (5, 200), (6, 24)], [(3, 700), (1, 300), (6, 24)], [(2, 248), (6, 8)]])


def page(i, payload, **more):
    return encode_record(i, payload, url=f"http://example.org/{i}", **more)


def test_archives(spark):
    long = "shared payload " * 20
    rows = [*ROWS, (700, long), (701, long), (699, long), (None, long), (800, "short"), (801, "short"), (802, "naïve\r\n\r\nWARC/1.1\r\n" * 9)]
    path = fresh_path(spark, "warc")
    files = write_warc(evidence(spark, rows, twice=False), path).collect()
    found = read_warc(spark, path)
    assert quarantined(found).collect() == [] and sum(f["n_records"] for f in files) == len(rows)
    least = {}
    for i, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    want = []
    for i, t in rows:
        data = (t or "").encode()
        again = len(data) >= 100 and i != least[t]
        want.append((None if i is None else str(i), "revisit" if again else "response", str(least[t]) if again else None, hashlib.sha256(data).hexdigest(), len(data), None if again else data))
    assert plain(found.select("evidence_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload")) == sorted(want, key=repr)


def records(rows):
    return [r["evidence_id"] for r in rows if r["status"] == "record"]


def test_salvage_of_members():
    members = [page(i, random.Random(i).randbytes(400)) for i in range(6)]
    data = b"".join(members)
    ends = [sum(map(len, members[:k + 1])) for k in range(6)]
    assert records(salvage(data)) == list("012345")
    broken = bytearray(data)
    broken[ends[1] + 60] ^= 0xFF
    rows = list(salvage(bytes(broken)))
    assert records(rows) == list("01345") and [(r["offset"], r["end"]) for r in rows if r["status"] == "gap"] == [(ends[1], ends[2])]
    rows = list(salvage(data[:ends[3] - 7]))
    assert records(rows) == list("012") and rows[-1]["status"] == "gap" and rows[-1]["end"] == ends[3] - 7
    rows = list(salvage(data[:ends[0]] + b"\x1f\x8b\x08 noise \x1f\x8b\x08" + data[ends[0]:]))
    assert records(rows) == list("012345") and sum(r["end"] - r["offset"] for r in rows if r["status"] == "gap") == 13
    assert [r["status"] for r in salvage(b"nothing of use")] == ["gap"] and list(salvage(b"")) == []


def test_salvage_of_plain_archives():
    raw = [zlib.decompress(page(i, b"payload %d " % i * 9), 31) for i in range(4)]
    data = b"".join(raw)
    assert records(salvage(data)) == list("0123")
    broken = bytearray(data)
    broken[len(raw[0]) + len(raw[1]) - 20] ^= 1
    rows = list(salvage(bytes(broken)))
    assert records(rows) == list("023") and [r["reason"] for r in rows if r["status"] == "gap"] == ["wrong block digest"]
    packer = zlib.compressobj(wbits=31)
    assert records(salvage(packer.compress(bytes(broken)) + packer.flush() + page(9, b"after"))) == list("0239")


def test_salvage_after_a_damaged_first_line():
    raw = [zlib.decompress(page(i, b"payload %d " % i * 9), 31) for i in range(4)]
    rows = list(salvage(b"XARC" + b"".join(raw)[4:]))
    assert records(rows) == list("123") and [(r["offset"], r["end"]) for r in rows if r["status"] == "gap"] == [(0, len(raw[0]))]
    rows = list(salvage(b"junk" + raw[0] + page(7, b"member") + raw[1]))
    assert records(rows) == list("071") and [(r["offset"], r["end"]) for r in rows if r["status"] == "gap"] == [(0, 4)]


def test_salvage_of_one_damaged_member():
    rng = random.Random(4)
    raw = b"".join(zlib.decompress(page(i, rng.randbytes(30_000)), 31) for i in range(9))
    whole = zlib.compress(raw, wbits=31)
    for damage in (whole[:150_000], whole[:-3], whole[:150_000] + bytes(60) + whole[150_060:], b"junk" + whole[:150_000]):
        rows = list(salvage(damage + page("after", b"next")))
        got = records(rows)
        assert len(got) >= 5 and got[:4] == list("0123") and got[-1] == "after"
        assert any(r["status"] == "gap" and r["end"] == len(damage) for r in rows)


def test_damaged_archive_in_spark(spark, tmp_path):
    data = page(1, b"first") + page(2, b"second") + page("three/ü", b"third")
    (tmp_path / "a.warc.gz").write_bytes(data[:40] + b"????" + data[44:])
    os.makedirs(tmp_path / "empty")
    found = read_warc(spark, str(tmp_path))
    assert sorted(r["evidence_id"] for r in found.filter("status = 'record'").collect()) == ["2", "three/ü"]
    gap = quarantined(found).collect()
    assert len(gap) == 1 and gap[0]["offset"] == 0 and gap[0]["end"] == len(page(1, b"first"))
