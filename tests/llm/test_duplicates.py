"""Exact copies, near copies by SimHash, duplicate lines and leaked items against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from llm_samples import EMPTY, evidence, plain, texts
from pyspark.sql import functions as F

from linkstrata.llm.components import components
from linkstrata.llm.exact import exact_duplicates, hash_directory
from linkstrata.llm.leaks import leaked_items
from linkstrata.llm.lines import duplicate_lines, without_lines
from linkstrata.llm.simhash import fingerprint, fingerprint_links, near_duplicate_snippets

ROWS = EMPTY + [(i, t) for i, t, _ in texts()]


def test_exact_duplicates(spark):
    rows = [*ROWS, ROWS[-1], (500, None), (None, "only null ids"), (None, "only null ids")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want, seen = [], set()
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        kept = i == keep and (t or "") not in seen
        if kept:
            seen.add(t or "")
        want.append((i, keep, len(groups[t or ""]), kept, hashlib.sha256((t or "").encode()).hexdigest()))
    assert plain(exact_duplicates(evidence(spark, rows, twice=False), bucket_rows=8)) == sorted(want, key=repr)


def test_directory_doubles_until_buckets_fit(spark):
    entries = spark.range(4000).select(F.xxhash64("id").alias("hash"))
    directory = hash_directory(entries, 100).collect()
    depth = directory[0]["global_depth"]
    assert depth >= 6 and {r["global_depth"] for r in directory} == {depth}
    held = defaultdict(int)
    bucket = {r["cell"]: r["bucket"] for r in directory}
    for r in entries.collect():
        held[bucket[(r["hash"] & (2**64 - 1)) >> (64 - depth)]] += 1
    assert max(held.values()) <= 100 and sum(held.values()) == 4000
    assert any(r["local_depth"] < depth for r in directory) or len(held) == len(bucket)


def slow_fingerprint(text, k=4):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\r\x0b\x0c":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def reachable(values, near):
    root = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i in range(len(values)):
            for j in range(len(values)):
                if near(values[i], values[j]) and root[j] < root[i]:
                    root[i], changed = root[j], True
    return root


def test_fingerprint():
    for _, text in ROWS[:20]:
        assert fingerprint(text or "", 4) & (2**64 - 1) == slow_fingerprint(text or "")
    assert fingerprint("Ä B\x1cC ÉA", 4) & (2**64 - 1) == slow_fingerprint("Ä B\x1cC ÉA")


def test_near_duplicates(spark):
    rows = [r for r in ROWS if r[0] != 300]
    found = plain(near_duplicate_snippets(evidence(spark, rows, twice=True)))
    rows = [*rows, rows[-1]]
    prints = [slow_fingerprint(t or "") for _, t in rows]
    root = reachable(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    assert found == sorted(((i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, root)), key=repr)
    assert len({f[2] for f in found}) < len(found)


@pytest.mark.parametrize("subtree", [1000, 8])
def test_trie_join_loses_no_link(spark, subtree):
    rng = random.Random(5)
    values = {0, 1, 3, 7, 15, 31, 2**64 - 1}
    for _ in range(60):
        v = rng.getrandbits(64)
        values.add(v)
        for _ in range(rng.randint(0, 6)):
            for _ in range(rng.randint(1, 5)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(int(v) for v in np.array(sorted(values), dtype=np.uint64).view(np.int64))
    root = reachable(values, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    links = fingerprint_links(spark.createDataFrame([(v,) for v in values], "fingerprint long"), 4, subtree)
    got = {r["node"]: r["root"] for r in components(links, "fingerprint", "link").collect()}
    assert [got.get(v, v) for v in values] == [values[r] for r in root]


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(chain, "a", "b").collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[p + 1:] == b[p + 1:] or a[p:] == b[p + 1:] or a[p + 1:] == b[p:]


def slow_lines(rows, least):
    lines = [((i is not None, i or 0, n), line) for i, t in rows for n, line in enumerate((t or "").split("\n"))]
    out = []
    for i, t in rows:
        copies, near, dropped = 0, 0, []
        for n, line in enumerate((t or "").split("\n")):
            place = (i is not None, i or 0, n)
            if not line.strip():
                continue
            if any(p < place and other == line for p, other in lines):
                copies += 1
            elif len(line) >= least and any(p < place and len(other) >= least and one_edit(line, other) for p, other in lines):
                near += 1
            else:
                continue
            dropped.append(n)
        out.append((i, len((t or "").split("\n")), copies, near, dropped))
    return sorted(out, key=repr)


def test_duplicate_lines(spark):
    base = ["All rights reserved by the owner.", "page 11 of this long report", "short", "éàü ñandú über größe ohne"]
    rows = [*EMPTY, (10, "\n".join(base)), (11, base[0] + "\nAll rights reserved by the owner\n" + base[1].replace("11", "12")), (12, "page 1 of this long report\nshort\nshirt\n\nshort"),
            (13, base[3].replace("ü", "u", 1) + "\n" + base[3][1:] + "\nx" + base[3]), (14, "aaaaaaaaaaaaaaaaaaaa\naaaaaaaaaaaaaaaaaaa"), (15, "aaaaaaaaaaaaaaaaaaa"), (None, base[2])]
    rng = random.Random(9)
    for i in range(20, 60):
        line = list(rng.choice(base[:2]) + rng.choice(["", " again and again"]))
        for _ in range(rng.randint(0, 2)):
            line[rng.randrange(len(line))] = rng.choice("abc ")
        rows.append((i, "".join(line)))
    got = plain(duplicate_lines(evidence(spark, rows, twice=False)))
    assert got == slow_lines(rows, 16)
    assert sum(r[3] for r in got) > 10


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("bound", [2, 3])
def test_duplicate_lines_within_more_edits(spark, bound):
    rng = random.Random(bound)
    base = ["".join(rng.choice("abcde ñ") for _ in range(n)) + "." for n in (16, 25, 40, 90)]
    lines = []
    for _ in range(90):
        line = list(rng.choice(base))
        for _ in range(rng.randint(0, 2 * bound)):
            at = rng.randrange(len(line))
            line[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
        lines.append("".join(line))
    got = {r["evidence_id"]: (r["n_copies"], r["n_near"]) for r in duplicate_lines(evidence(spark, list(enumerate(lines)), twice=False), max_edits=bound).collect()}
    want = {}
    for i, line in enumerate(lines):
        near = len(line) >= 16 and any(len(x) >= 16 and edits(line, x) <= bound for x in lines[:i])
        want[i] = (1, 0) if line in lines[:i] else (0, int(near))
    assert got == want
    assert sum(n for _, n in got.values()) > 10 and {edits(a, b) for a in lines for b in lines} >= {bound, bound + 1}


def test_lines_are_taken_out(spark):
    rows = evidence(spark, [(1, "one line of some length\nsame"), (2, "same\none line of some length\nother"), (3, None)], twice=False)
    kept = without_lines(rows, duplicate_lines(rows))
    assert {r["evidence_id"]: r["snippet"] for r in kept.collect()} == {1: "one line of some length\nsame", 2: "other", 3: None}


def slow_leaks(rows, items, k=5, share=0.8):
    def grams(text, size):
        words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        return {" ".join(words[i:i + size]) for i in range(len(words) - size + 1)}, len(words)

    best = {}
    for d, text in rows:
        for item, message in items:
            size = min(k, grams(message, 1)[1])
            if size:
                own = grams(message, size)[0]
                both = own & grams(text, size)[0]
                if len(both) / len(own) >= share:
                    best[d, item] = max(best.get((d, item), (0,)), (len(both) / len(own), len(both), len(own)))
    return sorted(((d, i, s, n, c) for (d, i), (c, s, n) in best.items()), key=repr)


def test_leaked_items(spark):
    rng = random.Random(2)
    rows = [r for r in ROWS if r[1]]
    items = [(None, "null id item words here"), (0, None), (1, ""), (2, "?!"), (3, "Ion"), (4, "two words"), (5, "some words some words some words some words")]
    for n in range(10, 40):
        words = rng.choice(rows)[1].split()
        at = rng.randrange(max(1, len(words) - 30))
        passage = words[at:at + rng.randint(3, 60)]
        for _ in range(rng.randint(0, 3)):
            passage[rng.randrange(len(passage))] = "changed"
        items.append((n, " ".join(passage).upper() + "!"))
    rows += [(900, "x two, WORDS y"), (901, "null id item: words here"), (None, "two words"), (902, "some words " * 5)]
    table = spark.createDataFrame([(*i, "x") for i in items], "item_id long, message string, words string")
    got = plain(leaked_items(evidence(spark, rows), table))
    assert got == slow_leaks(rows, items) and len(got) > 20


def test_empty_tables(spark):
    none = evidence(spark, [])
    items = spark.createDataFrame([], "item_id long, message string")
    for df in (exact_duplicates(none), near_duplicate_snippets(none), duplicate_lines(none), leaked_items(none, items), leaked_items(evidence(spark, ROWS[:9]), items)):
        assert df.collect() == []


def test_text_ids(spark):
    rows = spark.createDataFrame([("b", "same text"), ("a", "same text"), ("c", "another text")], "evidence_id string, snippet string")
    assert {r["evidence_id"]: (r["keep_id"], r["kept"]) for r in exact_duplicates(rows).collect()} == {"a": ("b", False), "b": ("b", True), "c": ("c", True)}
    assert {r["evidence_id"]: r["component_id"] for r in near_duplicate_snippets(rows).collect()} == {"a": "a", "b": "a", "c": "c"}
