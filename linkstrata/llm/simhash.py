"""Near-duplicate evidence by SimHash fingerprints and a binary-trie self-join."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstrata.llm.common import lookup_weighted, snippet, stage
from linkstrata.llm.components import components

SEED = 42
BITS = 64
HALF = 32
FRONTIER = 400_000
SMALL = 12


def fingerprint(text: str, shingle_words: int) -> int:
    """SimHash of one text as a signed 64-bit number: bit set if set in over half of the shingle hashes; zero without words."""
    words = text.encode().lower().split()  # bytes: lower-cases A-Z only, splits at ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = list(accumulate((len(w) + 1 for w in words), initial=-1))
        hashes = [xxhash.xxh64_intdigest(joined[a + 1:b], SEED) for a, b in zip(ends, ends[shingle_words:])]
    values = np.array(hashes, dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(values), 65536):
        part = values[i:i + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view("<i8")[0])


def snippet_fingerprints(evidence: DataFrame, shingle_words: int = 4) -> DataFrame:
    """``evidence_id`` and the ``fingerprint`` (bigint) of the whole snippet; null and wordless snippets have zero."""

    @F.pandas_udf("bigint")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t, shingle_words) for t in batch], dtype="int64")

    return evidence.select("evidence_id", of(snippet()).alias("fingerprint"))


def _union(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Joins the trees of linked positions; ``parent`` is fully compressed before and after, roots are smallest positions."""
    while len(left):
        a, b = parent[left], parent[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        if not len(left):
            return
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = parent[parent]
            if np.array_equal(further, parent):
                break
            parent[:] = further


def trie_links(values: np.ndarray, roots: list[tuple[int, int, int, int, int]], level: int, lead_bits: int, max_bits: int) -> np.ndarray:
    """Positions' component roots from walking pairs of trie nodes.

    ``values`` are distinct sorted uint64; a trie node at depth d is a range of them that share the first d bits. ``roots`` are the
    node pairs to start from (from, to, from, to, bits that differ already) at depth ``level``. A pair's children are compared
    with the differing bits added up, and dropped once these exceed ``lead_bits`` within the first 32 bits or ``max_bits`` after.
    Small nodes are compared outright. Linked values are merged as they are found, so that no list of pairs is kept.
    """
    n = len(values)
    parent = np.arange(n, dtype=np.int64)
    ones: dict[int, np.ndarray] = {}
    stack = [(level, np.array(roots, dtype=np.int64).reshape(-1, 5).T)]
    while stack:
        depth, pairs = stack.pop()
        if pairs.shape[1] > FRONTIER:
            half = pairs.shape[1] // 2
            stack += [(depth, pairs[:, :half]), (depth, pairs[:, half:])]
            continue
        af, at, bf, bt, diff = pairs
        count = (at - af) * (bt - bf)
        small = (count <= SMALL) | (depth >= BITS)
        if small.any():
            c, wide = count[small], (bt - bf)[small]
            offset = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            wide = np.repeat(wide, c)
            i, j = np.repeat(af[small], c) + offset // wide, np.repeat(bf[small], c) + offset % wide
            near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= max_bits)
            _union(parent, i[near], j[near])
            af, at, bf, bt, diff = pairs[:, ~small]
        if not len(af):
            continue
        if depth not in ones:
            bit = ((values >> np.uint64(BITS - 1 - depth)) & np.uint64(1)).astype(np.int32)
            ones[depth] = np.concatenate(([0], np.cumsum(bit, dtype=np.int32)))
        total = ones[depth]
        am, bm = at - (total[at] - total[af]), bt - (total[bt] - total[bf])
        itself = (af == bf) & (at == bt)
        budget = lead_bits if depth < HALF else max_bits
        children = [
            np.stack(x) for x in ((af, am, bf, bm, diff), (am, at, bm, bt, diff), (af, am, bm, bt, diff + 1), (am, at, bf, bm, np.where(itself, BITS + 1, diff + 1)))
        ]
        merged = np.concatenate(children, axis=1)
        merged = merged[:, (merged[0] < merged[1]) & (merged[2] < merged[3]) & (merged[4] <= budget)]
        if merged.shape[1]:
            stack.append((depth + 1, merged))
    return parent


def fingerprint_links(fingerprints: DataFrame, max_bits: int = 4, subtree_rows: int = 32_768) -> DataFrame:
    """Links (``fingerprint``, ``link``) that connect all distinct fingerprints within ``max_bits`` bits of each other.

    The links are a spanning forest of the pairs: enough for components, and never more than the values that a task holds.
    Of two near values one 32-bit half differs in at most half of the bits. So two tries are walked: one reads the high half
    first and allows ``max_bits // 2`` differing bits there, the other reads the low half first and allows the bits that are left
    when the high half had more. The upper part of each trie is cut at a depth that leaves about ``subtree_rows`` values below a
    node; each pair of nodes that may hold near values is one group of the shuffle.
    """
    total = fingerprints.count()
    depth = min(HALF, max(0, math.ceil(math.log2(max(1, total) / subtree_rows))))
    tries = []
    for number, lead in enumerate((max_bits // 2, max_bits - max_bits // 2 - 1)):
        if lead < 0:
            continue
        flips = [0]
        for _ in range(lead):
            flips = sorted({f ^ (1 << b) for f in flips for b in range(depth)} | set(flips))
        turned = F.col("fingerprint") if number == 0 else F.expr("shiftleft(fingerprint, 32) | shiftrightunsigned(fingerprint, 32)")
        rows = fingerprints.select(turned.alias("bits")).withColumn("stem", F.shiftrightunsigned("bits", BITS - depth) if depth else F.lit(0).cast("bigint"))
        rows = rows.withColumn("other", F.explode(F.array(*[F.lit(f).cast("bigint") for f in flips]))).withColumn("other", F.col("other").bitwiseXOR(F.col("stem")))
        tries.append(rows.select(F.lit(number).alias("trie"), F.least("stem", "other").alias("low"), F.greatest("stem", "other").alias("high"), F.lit(lead).alias("lead"), "bits"))
    rows = tries[0]
    for more in tries[1:]:
        rows = rows.unionByName(more)

    def walk(key, frame: pd.DataFrame) -> pd.DataFrame:
        number, low, high, lead = (int(k) for k in key)
        values = np.unique(frame["bits"].to_numpy(dtype=np.int64).view(np.uint64))
        if low == high:
            start = [(0, len(values), 0, len(values), 0)]
        else:
            cut = int(np.searchsorted(values, np.uint64(high) << np.uint64(BITS - depth)))
            start = [(0, cut, cut, len(values), (low ^ high).bit_count())] if 0 < cut < len(values) else []
        parent = trie_links(values, start, depth, lead, max_bits)
        moved = np.flatnonzero(parent != np.arange(len(values)))
        pair = np.stack([values[moved], values[parent[moved]]])
        if number:
            pair = (pair << np.uint64(HALF)) | (pair >> np.uint64(HALF))
        pair = pair.view(np.int64)
        return pd.DataFrame({"fingerprint": pair[0], "link": pair[1]})

    return rows.groupBy("trie", "low", "high", "lead").applyInPandas(walk, "fingerprint bigint, link bigint")


def near_duplicate_snippets(evidence: DataFrame, shingle_words: int = 4, max_bits: int = 4, subtree_rows: int = 32_768) -> DataFrame:
    """Groups of near-duplicate evidence: ``evidence_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    Reads ``evidence_id`` (any ordered type) and ``snippet``. Snippets are lower-cased (A-Z), cut into words at ASCII white space,
    and hashed in shingles of ``shingle_words`` words, repeats included; fewer words make one shingle of the whole. Fingerprints link at
    ``max_bits`` or fewer differing bits; ``component_id`` is the smallest evidence_id reachable over links. One row per input row.

    Null, empty and wordless snippets have the fingerprint zero and are linked like any other. Null ids never name a component
    unless it has no other. Repeated rows fall together. Very long snippets are hashed whole. An empty table gives an empty result.
    """
    rows = stage(snippet_fingerprints(evidence, shingle_words), "fingerprints")
    distinct = stage(rows.groupBy("fingerprint").agg(F.min("evidence_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    joined = components(fingerprint_links(distinct.select("fingerprint"), max_bits, subtree_rows), "fingerprint", "link")
    members = stage(distinct.join(joined.withColumnRenamed("node", "fingerprint"), "fingerprint", "left"), "fingerprint-members")
    grouped = members.filter("root IS NOT NULL")
    named = stage(grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "components")
    total = named.agg(F.coalesce(F.sum("members"), F.lit(0)).alias("n")).first()["n"]
    linked = lookup_weighted(grouped, named, ["root"], "members", total).select("fingerprint", "n", "component_id")
    alone = members.filter("root IS NULL AND n > 1").select("fingerprint", "n", F.col("least").alias("component_id"))
    found = lookup_weighted(rows, linked.unionByName(alone), ["fingerprint"], "n", rows.count())
    return found.select(
        "evidence_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        F.when(F.col("n").isNull(), F.col("evidence_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
