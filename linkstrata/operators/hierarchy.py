"""The two hierarchies and everything that walks them.

* aggregation hierarchy: ``parent_id`` with the L0-L1 flow boundary cut and ``contains``
  edges as fallback; used to roll companies up.
* classification tree: the raw ``parent_id`` column; used for paths, branches, subtrees.

Both are walked by path doubling: after round k a row knows its nearest 2^k ancestors, so
the number of rounds is log2(depth), not depth. Cycles are cut at the first repeated id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstrata import constants as K
from linkstrata.functions.tables import checkpointed, first_by, lookup

KEY = "industry_id"


def flow_boundary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """L1 ids joined to an L0 node by a flow edge in either direction."""
    level = nodes.select(KEY, "id", "level").filter(F.col("level").isin(0, 1))
    flows = edges.filter(F.col("relation_type") == K.FLOW).select(KEY, "source", "target")
    both = flows.join(level.select(KEY, F.col("id").alias("source"), F.col("level").alias("ls")), [KEY, "source"]).join(
        level.select(KEY, F.col("id").alias("target"), F.col("level").alias("lt")), [KEY, "target"]
    )
    ends = F.when((F.col("ls") == 0) & (F.col("lt") == 1), F.col("target")).when(
        (F.col("ls") == 1) & (F.col("lt") == 0), F.col("source")
    )
    return both.select(KEY, ends.alias("id")).filter(F.col("id").isNotNull()).distinct()


def aggregation_parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(industry_id, id, parent_id) of the roll-up hierarchy; only rows that have a parent."""
    boundary = flow_boundary(nodes, edges).withColumn("_cut", F.lit(True))
    roots = nodes.filter(F.col("level") == 0).select(KEY, F.col("id").alias("parent_id"), F.lit(True).alias("_parent_is_root"))
    declared = (
        nodes.select(KEY, "id", F.nullif(F.col("parent_id"), F.lit("")).alias("parent_id"))
        .join(boundary, [KEY, "id"], "left")
        .join(roots, [KEY, "parent_id"], "left")
        .select(KEY, "id", F.when(~(F.col("_cut").isNotNull() & F.col("_parent_is_root").isNotNull()), F.col("parent_id")).alias("declared"))
    )
    contains = (
        edges.filter((F.col("relation_type") == K.CONTAINS) & (F.col("source") != "") & (F.col("target") != ""))
        .groupBy(KEY, F.col("target").alias("id"))
        .agg(F.min_by("source", F.struct("pos", "source")).alias("by_edge"))
    )
    return (
        declared.join(contains, [KEY, "id"], "full_outer")
        .select(KEY, "id", F.coalesce("declared", "by_edge").alias("parent_id"))
        .filter(F.col("parent_id").isNotNull())
    )


def tree_parents(nodes: DataFrame) -> DataFrame:
    """Raw parent links whose parent exists."""
    links = nodes.filter(F.coalesce(F.col("parent_id"), F.lit("")) != "").select(KEY, "id", "parent_id")
    known = nodes.select(KEY, F.col("id").alias("parent_id")).distinct()
    return links.join(known, [KEY, "parent_id"], "left_semi").select(KEY, "id", "parent_id")


def _cut_cycle(own: str = "id"):
    ids = F.transform("path", lambda x: x)
    seen = F.concat(F.array(own), ids)
    repeats = F.filter(F.sequence(F.lit(1), F.size("path")), lambda i: F.array_position(seen, F.get(ids, i - 1)) < i + 1)
    first = F.array_min(repeats)
    clean = F.size(F.array_distinct(seen)) == F.size(seen)
    return F.when(clean, F.col("path")).otherwise(F.slice("path", F.lit(1), first - 1)), clean


def ancestor_paths(parents: DataFrame) -> DataFrame:
    """(industry_id, id, path): ancestors nearest first, for every row of ``parents``."""
    path, clean = _cut_cycle()
    current = checkpointed(
        parents.select(KEY, "id", F.array("parent_id").alias("path")).select(KEY, "id", path.alias("path"), clean.alias("open"))
    )
    reach = 1
    while not current.filter("open").isEmpty():
        step = current.select(KEY, F.col("id").alias("_last"), F.col("path").alias("_more"))
        grown = (
            current.filter("open")
            .withColumn("_last", F.element_at("path", -1))
            .join(step, [KEY, "_last"], "left")
            .select(KEY, "id", F.concat("path", F.coalesce("_more", F.array().cast("array<string>"))).alias("path"))
            .select(KEY, "id", path.alias("path"), clean.alias("_clean"))
        )
        reach *= 2
        full = F.col("_clean") & (F.size("path") == reach)
        current = checkpointed(
            grown.select(KEY, "id", "path", full.alias("open")).unionByName(current.filter("NOT open"))
        )
    return current.select(KEY, "id", "path")


def closure(paths: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(industry_id, id, ancestor, dist). With ``nodes`` every node is also its own ancestor at 0."""
    above = paths.select(KEY, "id", F.posexplode("path").alias("_i", "ancestor")).select(
        KEY, "id", "ancestor", (F.col("_i") + 1).alias("dist")
    )
    if nodes is None:
        return above
    own = nodes.select(KEY, "id", F.col("id").alias("ancestor"), F.lit(0).alias("dist"))
    return own.unionByName(above)


def with_ancestors(df: DataFrame, closure_above: DataFrame, column: str, mark: str) -> DataFrame:
    """Every row as it is, and once more for each ancestor of its node in ``column``; ``mark`` tells the added rows."""
    above = closure_above.groupBy(KEY, F.col("id").alias(column)).agg(F.collect_set("ancestor").alias("_above"))  # at most as long as the tree is deep
    own = F.array(F.struct(F.col(column).alias("n"), F.lit(False).alias("m")))
    higher = F.transform(F.array_remove(F.coalesce("_above", F.array().cast("array<string>")), F.col(column)), lambda a: F.struct(a.alias("n"), F.lit(True).alias("m")))
    steps = F.concat(own, F.coalesce(higher, F.array().cast("array<struct<n: string, m: boolean>>")))
    rows = lookup(df, above, [KEY, column]).withColumn("_step", F.explode(steps))
    return rows.select(*[F.col("_step.n").alias(c) if c == column else F.col(c) for c in df.columns], F.col("_step.m").alias(mark))


def lineage(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Root-to-node names joined by `` / `` and the governing L1 branch, per node.

    ``branch_role`` is the L1's position when it is upstream or downstream, else ``contains``.
    A node that is itself L1 governs its own branch.
    """
    me = nodes.select(
        KEY, F.col("id").alias("ancestor"),
        F.struct(
            F.col("id"), F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("id")).alias("name"),
            "level", "chain_position",
        ).alias("_n"),
    )
    steps = (
        closure(paths, nodes)
        .join(me, [KEY, "ancestor"])
        .groupBy(KEY, "id")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("o"), "_n"))).alias("_steps"))
    )
    level_one = F.filter("_steps", lambda s: s["_n"]["level"] == 1)
    branch = F.get(level_one, F.lit(0))["_n"]
    return steps.select(
        KEY, "id",
        F.array_join(F.transform("_steps", lambda s: s["_n"]["name"]), " / ").alias("path"),
        F.coalesce(branch["id"], F.lit("")).alias("branch_id"),
        F.when(branch.isNotNull(), branch["name"]).otherwise("").alias("branch_name"),
        F.when(branch["chain_position"].isin("upstream", "downstream"), branch["chain_position"])
        .otherwise(K.CONTAINS).alias("branch_role"),
    )


def subtree(paths: DataFrame, tops: DataFrame) -> DataFrame:
    """Ids at or below each ``(industry_id, id)`` of ``tops``; column ``top`` names the start."""
    starts = tops.select(KEY, F.col("id").alias("top")).distinct()
    below = closure(paths).withColumnRenamed("ancestor", "top").join(starts, [KEY, "top"], "left_semi")
    return starts.select(KEY, "top", F.col("top").alias("id")).unionByName(below.select(KEY, "top", "id"))


def tree_listing(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Depth-first listing: ``sort_key`` is the id path from the root, ``line`` the indented text.

    An L1 without a parent hangs under the first root id. Order the result by
    (industry_id, sort_key); rows that reach no root are left out.
    """
    roots = nodes.filter(F.col("level") == 0).groupBy(KEY).agg(F.min("id").alias("_root"))
    ids = F.concat(F.reverse(F.coalesce("path", F.array().cast("array<string>"))), F.array("id"))
    top_level = nodes.select(KEY, F.col("id").alias("_top"), F.col("level").alias("_top_level"))
    walked = (
        nodes.select(KEY, "id", "name", "level")
        .join(paths, [KEY, "id"], "left")
        .select(KEY, "id", "name", "level", ids.alias("_ids"))
        .withColumn("_top", F.get("_ids", F.lit(0)))
        .join(top_level, [KEY, "_top"])
        .join(roots, KEY)
    )
    key = F.when(F.col("_top_level") == 1, F.concat(F.array("_root"), "_ids")).otherwise(F.col("_ids"))
    return (
        walked.filter(F.col("_top_level").isin(0, 1))
        .withColumn("sort_key", key)
        .withColumn("depth", F.size("sort_key") - 1)
        .select(
            KEY, "id", "sort_key", "depth",
            F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- L"), F.col("level").cast("string"), F.lit(" "),
                     F.col("name"), F.lit(" (`"), F.col("id"), F.lit("`)")).alias("line"),
        )
    )
