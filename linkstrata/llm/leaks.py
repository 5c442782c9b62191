"""Review items that leaked into evidence: size-partitioned MinHash containment search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkstrata.llm.common import bitmap, in_bitmap, snippet, stage

SMALL_ROWS = 50_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(size: int | Column) -> Column:
    """Runs of ``size`` words of the column ``words``, joined by a space; none if there are fewer words."""
    starts = F.when(F.size("words") >= size, F.sequence(F.lit(1), F.size("words") - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice("words", i, size), " "))


def small(table: DataFrame) -> DataFrame:
    """Marks a table for broadcast if it is proved to have few rows; a larger one takes the shuffled join."""
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table


def item_shingles(review_items: DataFrame, shingle_words: int) -> DataFrame:
    """``item_id``, ``size`` (words of a shingle), ``n_shingles``, ``shingles`` (distinct) of the items that have a word."""
    rows = review_items.select("item_id", words(snippet("message")).alias("words")).filter(F.size("words") > 0).distinct()
    rows = rows.withColumn("size", F.least(F.size("words"), F.lit(shingle_words)))
    rows = rows.select("item_id", "size", F.array_distinct(shingles(F.col("size"))).alias("shingles"))
    return rows.select("item_id", "size", F.size("shingles").alias("n_shingles"), "shingles")


def item_sketches(items: DataFrame, containment: float) -> DataFrame:
    """MinHash sketch of each item as rows ``item_id``, ``hash``.

    Items are partitioned by size: partition p holds those with 2^p to 2^(p+1)-1 shingles. Its sketches keep the k least hashes,
    with k one more than the shingles that the largest item of the partition may miss. A document that contains enough of an
    item then has at least one shingle of the item's sketch, so the search loses nothing.
    """
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n_shingles")) + 1) - 1
    kept = (F.floor(largest * F.lit(1 - containment) + F.lit(1e-9)) + 1).cast("int")
    hashes = F.array_sort(F.transform("shingles", lambda s: F.xxhash64(s)))
    return items.select("item_id", F.explode(F.slice(hashes, 1, kept)).alias("hash"))


def leaked_items(evidence: DataFrame, review_items: DataFrame, shingle_words: int = 5, containment: float = 0.8) -> DataFrame:
    """Review items whose message a snippet contains: ``evidence_id``, ``item_id``, ``n_shared``, ``n_shingles``, ``containment``.

    Reads ``evidence_id`` and ``snippet``, and ``item_id`` and ``message`` of ``review_items``. Texts are compared as lower-cased words of letters and
    digits. An item is found if at least ``containment`` of its distinct shingles of ``shingle_words`` words are shingles of the
    snippet; an item with fewer words is one shingle of all its words. All rows are searched whole for all items: first by the
    items' MinHash sketches, then exactly, by the texts of the shingles.

    Null and empty messages, and messages without a word, are never found; null and empty snippets contain nothing. Rows that repeat an
    evidence_id are searched one by one, and a pair is returned once, with its highest containment. Messages that repeat an item_id
    are items of their own, and the best counts. Null ids are returned as null. Empty tables give an empty result.
    """
    items = stage(item_shingles(review_items, shingle_words).withColumn("entry", F.monotonically_increasing_id()), "item-shingles")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most ``shingle_words`` values
    sketches = stage(item_sketches(items.withColumn("item_id", F.col("entry")), containment).withColumnRenamed("item_id", "entry").distinct(), "item-sketches")
    texts = stage(items.select("entry", "item_id", "n_shingles", F.explode("shingles").alias("shingle")), "item-texts")

    def exploded(rows: DataFrame, *keys: str) -> DataFrame:
        found = F.concat(*[shingles(k) for k in sizes]) if sizes else F.array().cast("array<string>")
        return rows.withColumn("words", words(F.col("snippet"))).select(*keys, found.alias("found"))

    rows = evidence.select("evidence_id", snippet().alias("snippet"))
    hashed = exploded(rows, "evidence_id").select("evidence_id", F.explode(F.array_distinct(F.transform("found", lambda s: F.xxhash64(s)))).alias("hash"))
    candidates = stage(hashed.join(small(sketches), "hash").select("evidence_id", "entry").distinct(), "leak-candidates")
    mark = F.xxhash64(F.coalesce(F.col("evidence_id").cast("string"), F.lit("")))
    marks = stage(bitmap(candidates.select(mark.alias("mark")), "mark"), "leak-marks")
    searched = in_bitmap(rows, [mark], marks).withColumn("_row", F.monotonically_increasing_id())
    verified = (
        exploded(searched, "_row", "evidence_id").select("_row", "evidence_id", F.explode(F.array_distinct("found")).alias("shingle"))
        .join(small(texts), "shingle").groupBy("_row", "evidence_id", "entry", "item_id", "n_shingles").agg(F.count(F.lit(1)).alias("n_shared"))
    )
    wanted = candidates.select(F.col("evidence_id").alias("_id"), F.col("entry").alias("_entry"))
    verified = verified.filter(F.col("n_shared") / F.col("n_shingles") >= containment).join(
        wanted, F.col("evidence_id").eqNullSafe(F.col("_id")) & (F.col("entry") == F.col("_entry")), "left_semi"
    )
    ratio = (F.col("n_shared") / F.col("n_shingles")).alias("containment")
    best = verified.select("evidence_id", "item_id", F.struct(ratio, "n_shared", "n_shingles").alias("found"))
    return best.groupBy("evidence_id", "item_id").agg(F.max("found").alias("found")).select(
        "evidence_id", "item_id", F.col("found.n_shared").cast("bigint").alias("n_shared"), F.col("found.n_shingles").cast("bigint").alias("n_shingles"), "found.containment",
    )
