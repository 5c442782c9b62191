"""Line deduplication of evidence by a deletion-neighbourhood join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkstrata.llm.common import bitmap, in_bitmap, lookup_weighted, snippet, stage

LEAST_CHARS = 16
SEGMENT = 64


def _digest(line: Column) -> Column:
    """The first 128 bits of the line's SHA-256."""
    return F.unhex(F.substring(F.sha2(line, 256), 1, 32))


def _half_keys() -> list[Column]:
    """Four hashes of the column ``line`` of which any two lines one edit apart share one.

    One edit leaves either the first half or the last half of the shorter line intact in both lines; a line may be the shorter or
    the longer of a pair, so it states both halves for its own length and for one character less.
    """
    keys = []
    for base in (F.col("length"), F.col("length") - 1):
        half = (base / 2).cast("int")
        keys.append(F.xxhash64(F.lit("head"), base, F.substring(F.col("line"), F.lit(1), half)))
        keys.append(F.xxhash64(F.lit("tail"), base, F.right(F.col("line"), base - half)))
    return keys


def _segments(base: Column) -> Column:
    """Segments of the column ``line`` seen as a line of ``base`` characters: hash of the text around a segment, and the segment.

    Boundaries before a segment count from the start and those after it from the end, so that a line with one character more has
    the same surroundings, and one more character in the segment that holds the edit.
    """
    def segment(k: Column) -> Column:
        behind = base - F.least(base, (k + 1) * SEGMENT)
        around = F.xxhash64(base, k, F.substring(F.col("line"), F.lit(1), k * SEGMENT), F.right(F.col("line"), behind))
        return F.struct(around.alias("around"), F.substring(F.col("line"), k * SEGMENT + 1, F.length("line") - k * SEGMENT - behind).alias("middle"))

    return F.transform(F.sequence(F.lit(0), F.ceil(base / SEGMENT).cast("int") - 1), segment)


def _without_each() -> Column:
    """The column ``middle`` without its first, second, ... character."""
    return F.transform(
        F.sequence(F.lit(1), F.length("middle")), lambda i: F.concat(F.substring("middle", F.lit(1), i - 1), F.substring(F.col("middle"), i + 1, F.length("middle")))
    )


def line_variants(rows: DataFrame) -> DataFrame:
    """Deletion variants of lines as hashed keys: ``digest``, ``first``, ``kind``, ``key``.

    ``placed``: the line without one character, with its place; lines that share one differ by a replaced character. ``cut``: the
    line without one character; a line whose ``whole`` has the same key differs by an inserted one. A key is made of the hash of the text
    around a segment and of the variant of the segment: one edit leaves all but one segment as it is. This keeps the work for a
    long line near linear, and segments whose surroundings no other line has need no variants.
    """
    sides = [
        rows.select("digest", "first", F.lit(own).alias("own"), F.explode(_segments(F.col("length") - (0 if own else 1))).alias("s")).select("digest", "first", "own", "s.*")
        for own in (True, False)
    ]
    segments = stage(sides[0].unionByName(sides[1]), "line-segments")
    shared = segments.groupBy("around").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("around")
    near = stage(segments.join(shared, "around", "left_semi"), "near-segments")
    own, longer = near.filter("own"), near.filter("NOT own")
    whole = own.select("digest", "first", F.lit("whole").alias("kind"), F.xxhash64("around", "middle").alias("key"))
    placed = own.select("digest", "first", "around", F.posexplode(_without_each()).alias("place", "rest")).select(
        "digest", "first", F.lit("placed").alias("kind"), F.xxhash64("around", "place", "rest").alias("key")
    )
    cut = longer.select("digest", "first", "around", F.explode(F.array_distinct(_without_each())).alias("rest")).select(
        "digest", "first", F.lit("cut").alias("kind"), F.xxhash64("around", "rest").alias("key")
    )
    return whole.unionByName(placed).unionByName(cut)


def lines_within(rows: DataFrame, max_edits: int) -> DataFrame:
    """Lines within ``max_edits`` edits of an earlier line: column ``digest``.

    A line is cut into ``max_edits + 1`` parts, so that one of them is intact in any line within the bound, at most ``max_edits`` characters
    further on or back. Each line looks for such parts of the lines of every length within the bound; pairs that share one
    are checked by edit distance. No pair is missed; lines that share a common part are paired one by one.
    """
    def part(length: Column, i: int) -> tuple[Column, Column]:
        begin = F.floor(length * i / (max_edits + 1)).cast("int")
        return begin, F.floor(length * (i + 1) / (max_edits + 1)).cast("int") - begin

    def key(length: Column, i: int, shift: int) -> Column:
        begin, size = part(length, i)
        inside = (length >= 0) & (begin + shift >= 0) & (begin + shift + size <= F.col("length"))
        return F.when(inside, F.xxhash64(length, F.lit(i), F.substring(F.col("line"), begin + shift + 1, size)))

    bound, numbers = range(-max_edits, max_edits + 1), range(max_edits + 1)
    held = rows.select(F.col("digest").alias("earlier"), F.col("first").alias("earlier_first"), F.explode(F.array(*[key(F.col("length"), i, 0) for i in numbers])).alias("key"))
    sought = rows.select("digest", "first", F.explode(F.array_distinct(F.array(*[key(F.col("length") + more, i, shift) for more in bound for i in numbers for shift in bound]))).alias("key"))
    met = sought.filter("key IS NOT NULL").join(held, "key").filter("earlier_first < first AND earlier != digest").select("digest", "earlier").distinct()
    pairs = stage(met, "line-pairs")
    there = rows.select(F.col("digest").alias("earlier"), F.col("line").alias("earlier_line"))
    return pairs.join(rows.select("digest", "line"), "digest").join(there, "earlier").filter(F.levenshtein("line", "earlier_line", max_edits) >= 0).select("digest").distinct()


def near_lines(lines: DataFrame, least_chars: int = LEAST_CHARS, max_edits: int = 1) -> DataFrame:
    """Lines within ``max_edits`` edits of an earlier line: column ``digest``. A bound of one has a path of its own, described here; for others see ``lines_within``.

    ``lines`` has distinct lines: ``digest``, ``line``, and their earliest place ``first`` (any ordered value). Only lines with at least
    ``least_chars`` characters that share a half with another line emit variants. A variant's lines meet in an aggregate of the earliest place, so
    that no group of lines is paired; each line is then checked against the earliest line of each of its variants by edit distance.
    """
    rows = lines.filter(F.length("line") >= least_chars).withColumn("length", F.length("line"))
    if max_edits != 1:
        return lines_within(rows, max_edits)
    halves = rows.select(F.explode(F.array(*_half_keys())).alias("half")).groupBy("half").agg(F.count(F.lit(1)).alias("n"))
    marks = stage(bitmap(halves.filter("n > 1"), "half"), "shared-halves")
    chosen = stage(in_bitmap(rows, _half_keys(), marks), "likely-lines")
    variants = stage(line_variants(chosen), "line-variants")
    sides = {kind: variants.filter(F.col("kind") == kind) for kind in ("placed", "cut", "whole")}
    pairs = None
    for one, other in (("placed", "placed"), ("cut", "whole"), ("whole", "cut")):
        earliest = sides[other].groupBy("key").agg(F.min(F.struct("first", "digest")).alias("e"), F.count(F.lit(1)).alias("n"))
        if one == other:
            earliest = earliest.filter("n > 1")
        met = sides[one].join(earliest, "key").filter(F.col("e.first") < F.col("first")).select("digest", F.col("e.digest").alias("earlier"))
        pairs = met if pairs is None else pairs.unionByName(met)
    pairs = stage(pairs.filter("digest != earlier").distinct(), "line-pairs")
    own = chosen.select("digest", "line")
    there = chosen.select(F.col("digest").alias("earlier"), F.col("line").alias("earlier_line"))
    return pairs.join(own, "digest").join(there, "earlier").filter(F.levenshtein("line", "earlier_line", 1) >= 0).select("digest").distinct()


def duplicate_lines(evidence: DataFrame, least_chars: int = LEAST_CHARS, max_edits: int = 1) -> DataFrame:
    """Lines of snippets that repeat an earlier line, or come within ``max_edits`` edits of one.

    Reads ``evidence_id`` (any ordered type) and ``snippet``; lines end at a line feed and are numbered from 0. Earlier means a
    smaller evidence_id, then a smaller number. A line is a copy if an equal line is earlier. Otherwise it is near if any earlier
    line, kept or not, is at most ``max_edits`` inserted, deleted or replaced characters away and both have at least ``least_chars`` characters. Returns one row per
    input row: ``evidence_id``, ``n_lines``, ``n_copies``, ``n_near``, ``dropped`` (numbers of copies and near lines, ascending).

    Lines without a visible character are never dropped. Null snippets count as empty: one blank line. Rows that repeat an evidence_id hold the
    same place, so equal lines at equal numbers are kept in each. Null ids come first. Lines of any length are compared whole. An
    empty table gives an empty result.
    """
    rows = evidence.select("evidence_id", F.monotonically_increasing_id().alias("_row"), snippet().alias("snippet"))
    numbered = rows.select("evidence_id", "_row", F.posexplode(F.split("snippet", "\n")).alias("number", "line"))
    visible = F.col("line").rlike(r"\S")
    place = F.struct("evidence_id", "number")
    slim = stage(numbered.select("evidence_id", "_row", "number", F.when(visible, _digest(F.col("line"))).alias("digest")), "line-places")
    lines = stage(
        numbered.filter(visible).groupBy("line").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .select(_digest(F.col("line")).alias("digest"), "line", "first", "n"), "distinct-lines", compression="zstd",
    )
    near = near_lines(lines.select("digest", "line", "first"), least_chars, max_edits).withColumn("near", F.lit(True))
    known = lines.select("digest", "first", "n").join(near, "digest", "left").filter("n > 1 OR near")
    marked = lookup_weighted(slim.filter("digest IS NOT NULL"), known, ["digest"], "n", slim.count()).withColumn(
        "copy", F.coalesce(F.struct("evidence_id", "number") > F.col("first"), F.lit(False))
    ).withColumn("alike", F.coalesce(F.col("near"), F.lit(False)) & ~F.col("copy"))
    hits = marked.filter("copy OR alike").groupBy("_row").agg(
        F.sum(F.col("copy").cast("bigint")).alias("n_copies"), F.sum(F.col("alike").cast("bigint")).alias("n_near"), F.array_sort(F.collect_set("number")).alias("dropped"),
    )
    rows = slim.groupBy("_row", "evidence_id").agg(F.count(F.lit(1)).alias("n_lines"))
    return rows.join(hits, "_row", "left").select(
        "evidence_id", "n_lines", F.coalesce("n_copies", F.lit(0)).cast("bigint").alias("n_copies"), F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
    )


def without_lines(evidence: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Evidence with the ``dropped`` lines of ``duplicate_lines`` taken out of ``snippet``; ids must be unique and not null."""
    dropped = duplicates.select(F.col("evidence_id").alias("_id"), F.col("dropped").alias("_dropped"))
    kept = F.filter(F.split(snippet(), "\n"), lambda line, i: ~F.array_contains(F.col("_dropped"), i))
    return evidence.join(dropped, F.col("evidence_id") == F.col("_id"), "left").withColumn(
        "snippet", F.when(F.size("_dropped") > 0, F.array_join(kept, "\n")).otherwise(F.col("snippet"))
    ).select(*evidence.columns)
