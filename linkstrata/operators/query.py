"""Read-side queries over stored graphs: filter, neighbours, flow relations, listings.

Filters arrive as a table (one row per request and industry) or as plain values, so one job
answers many requests.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstrata import constants as K
from linkstrata.functions import text as X
from linkstrata.functions.tables import first_by, gathered, lookup, numbered, stored, top_rows

KEY = "industry_id"


def filter_nodes(
    nodes: DataFrame,
    q: str | None = None,
    positions: Sequence[str] = (),
    levels: Sequence[int] = (),
    mode: str = "file",
) -> DataFrame:
    """``file``: trimmed, case-sensitive over name and descriptions; ``stored``: same, not trimmed;
    ``offline``: lower-cased over name, descriptions, node type and tags."""
    out = nodes
    needle = (q or "") if mode == "stored" else (q or "").strip()
    if needle:
        if mode == "offline":
            tags = F.array_join("tags", " ")
            parts = ["name", "description", "business_description", "node_type"]
            haystack = F.lower(F.concat_ws(" ", *[F.nullif(F.col(p), F.lit("")) for p in parts], F.nullif(tags, F.lit(""))))
            out = out.filter(F.contains(haystack, F.lit(needle.lower())))
        else:
            hit = F.lit(False)
            for column in ("name", "description", "business_description"):
                hit = hit | F.contains(F.coalesce(F.col(column), F.lit("")), F.lit(needle))
            out = out.filter(hit)
    if positions:
        out = out.filter(F.col("chain_position").isin(*positions))
    if levels:
        out = out.filter(F.col("level").isin(*levels))
    return out


def induced_edges(edges: DataFrame, nodes: DataFrame, relation_types: Sequence[str] = ()) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    ids = nodes.select(KEY, "id").distinct()
    if relation_types:
        edges = edges.filter(F.col("relation_type").isin(*relation_types))
    return edges.join(ids.withColumnRenamed("id", "source"), [KEY, "source"], "left_semi").join(
        ids.withColumnRenamed("id", "target"), [KEY, "target"], "left_semi"
    ).select(*edges.columns)


def filter_graph(nodes: DataFrame, edges: DataFrame, relation_types: Sequence[str] = (), **filters) -> tuple[DataFrame, DataFrame]:
    chosen = filter_nodes(nodes, **filters)
    return chosen, induced_edges(edges, chosen, relation_types)


def incident_edges(edges: DataFrame, centres: DataFrame) -> DataFrame:
    """One row per (centre, incident edge); a self-loop counts once."""
    points = centres.select(KEY, F.col("id").alias("centre")).distinct()
    as_source = edges.withColumn("centre", F.col("source"))
    as_target = edges.filter(F.col("source") != F.col("target")).withColumn("centre", F.col("target"))
    return as_source.unionByName(as_target).join(points, [KEY, "centre"], "left_semi")


def neighbour_nodes(edges: DataFrame, nodes: DataFrame, centres: DataFrame) -> DataFrame:
    """(industry_id, centre, id, name, level): the centre and both ends of its incident edges."""
    hits = incident_edges(edges, centres)
    own = centres.select(KEY, F.col("id").alias("centre"), F.col("id").alias("id"))
    ends = hits.select(KEY, "centre", F.explode(F.array("source", "target")).alias("id"))
    members = own.unionByName(ends).distinct()
    return members.join(nodes.select(KEY, "id", "name", "level"), [KEY, "id"]).select(KEY, "centre", "id", "name", "level")


def split_flow(edges: DataFrame, centres: DataFrame) -> DataFrame:
    """Incident edges labelled child / upstream / downstream / other as seen from the centre."""
    side = (
        F.when((F.col("relation_type") == K.CONTAINS) & (F.col("source") == F.col("centre")), "child")
        .when((F.col("relation_type") == K.FLOW) & (F.col("target") == F.col("centre")), "upstream")
        .when((F.col("relation_type") == K.FLOW) & (F.col("source") == F.col("centre")), "downstream")
        .otherwise("other")
    )
    return incident_edges(edges, centres).select(KEY, "centre", F.col("id").alias("edge_id"), "source", "target", "relation_type", side.alias("side"))


def relation_sentences(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    names = nodes.select(KEY, "id", F.col("name").alias("n"))
    named = (
        edges.join(names.select(KEY, F.col("id").alias("source"), F.col("n").alias("sn")), [KEY, "source"], "left")
        .join(names.select(KEY, F.col("id").alias("target"), F.col("n").alias("tn")), [KEY, "target"], "left")
    )
    text = X.relation_sentence(F.col("relation_type"), F.coalesce("sn", "source"), F.coalesce("tn", "target"))
    return named.select(KEY, F.col("id").alias("edge_id"), text.alias("sentence"))


def node_flow_relations(nodes: DataFrame, l2_edges: DataFrame, projected: DataFrame, centres: DataFrame) -> DataFrame:
    """L1 centres see projected edges, L2 centres projected and L2 edges; other levels give no rows."""
    info = centres.join(nodes.select(KEY, "id", "level"), [KEY, "id"]).filter(F.col("level").isin(1, 2))
    cols = [KEY, "id", "source", "target", "relation_layer", "confidence"]
    relations = projected.select(*cols).unionByName(l2_edges.select(*cols))
    points = info.select(KEY, F.col("id").alias("centre"), "level")
    return (
        incident_edges(relations, info).join(points, [KEY, "centre"])
        .filter((F.col("level") == 2) | (F.col("relation_layer") == K.PROJECTION_LAYER))
        .select(KEY, "centre", F.col("id").alias("edge_id"), "source", "target", "relation_layer", "confidence")
    )


def unsupported_centres(nodes: DataFrame, centres: DataFrame) -> DataFrame:
    """Centres that are unknown or of a level without flow relations."""
    known = nodes.select(KEY, "id", "level")
    return centres.join(known, [KEY, "id"], "left").filter(~F.coalesce(F.col("level").isin(1, 2), F.lit(False))).select(
        KEY, "id", F.when(F.col("level").isNull(), "node_not_found").otherwise("level_not_supported").alias("error")
    )


def question_context(nodes: DataFrame, edges: DataFrame, question: str, max_nodes: int = 30, max_edges: int = 40, **filters) -> DataFrame:
    """Context lines for a question: filter hits first, then keyword hits, cut to the top rows per graph."""
    chosen, chosen_edges = filter_graph(nodes, edges, **filters)
    found, found_edges = filter_graph(nodes, edges, q=question.strip())

    def union(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.withColumn("_src", F.lit(0)).unionByName(b.withColumn("_src", F.lit(1)))
        return first_by(both, [KEY, "id"], ["_src", "pos"])

    order = [F.col("_src"), F.col("pos"), F.col("id")]
    node_text = F.concat(
        F.lit("- ["), F.col("id"), F.lit("] "), F.col("name"), F.lit(" | "), F.col("chain_position"), F.lit(" | level="),
        F.col("level").cast("string"), F.lit(" | "), F.coalesce("description", F.lit("")),
    )
    edge_text = F.concat(
        F.lit("- "), F.col("source"), F.lit(" -["), F.col("relation_type"), F.lit("]-> "), F.col("target"), F.lit(": "),
        F.coalesce("description", F.lit("")),
    )
    node_lines = top_rows(union(chosen, found), [KEY], order, max_nodes).select(KEY, F.lit("node").alias("kind"), "rn", node_text.alias("line"))
    edge_lines = top_rows(union(chosen_edges, found_edges), [KEY], order, max_edges).select(KEY, F.lit("edge").alias("kind"), "rn", edge_text.alias("line"))
    return node_lines.unionByName(edge_lines)


def list_industries(manifest: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Manifest rows with live counts; a pending entry with a graph reads as ready."""
    node_counts = nodes.groupBy(KEY).agg(F.count(F.lit(1)).alias("_nodes"))
    edge_counts = edges.groupBy(KEY).agg(F.count(F.lit(1)).alias("_edges"))
    status = F.coalesce("status", F.lit("pending"))
    return (
        manifest.join(node_counts, KEY, "left").join(edge_counts, KEY, "left")
        .select(
            KEY, F.coalesce("name", KEY).alias("name"),
            F.when((status == "pending") & F.col("_nodes").isNotNull(), "ready").otherwise(status).alias("status"),
            F.when(F.col("_nodes").isNotNull(), F.col("_nodes")).otherwise(F.coalesce("node_count", F.lit(0))).cast("bigint").alias("node_count"),
            F.when(F.col("_nodes").isNotNull(), F.coalesce("_edges", F.lit(0))).otherwise(F.coalesce("edge_count", F.lit(0))).cast("bigint").alias("edge_count"),
        )
    )


def overlay_industries(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored industry rows override manifest rows; unknown stored industries are appended."""
    s = stored.select(KEY, *[F.col(c).alias("_" + c) for c in ("name", "status", "node_count", "edge_count")])
    return manifest.join(s, KEY, "full_outer").select(
        KEY, F.coalesce("_name", "name", KEY).alias("name"),
        F.coalesce("_status", "status", F.lit("pending")).alias("status"),
        F.coalesce("_node_count", "node_count", F.lit(0)).cast("bigint").alias("node_count"),
        F.coalesce("_edge_count", "edge_count", F.lit(0)).cast("bigint").alias("edge_count"),
    )


def visible_levels(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(KEY).agg(
        F.array_sort(F.collect_set("level")).alias("levels"), F.max("level").alias("max_level"),
        F.count(F.lit(1)).alias("node_count"),
    )


# --- companies ------------------------------------------------------------------
def company_rollup(attachments: DataFrame, companies: DataFrame, closure: DataFrame, include_descendants: bool = True) -> DataFrame:
    """Companies visible at every node: direct ones and those of all roll-up descendants.

    ``closure`` holds every node with itself (dist 0) and its ancestors. One row per
    (node, company): number of distinct direct nodes and whether the node itself is direct.
    """
    known = companies.select("company_id").distinct()
    # the pairs of a company in a graph stay in one task while they are repeated for the ancestors and counted
    direct = gathered(attachments.select(KEY, F.col("node_id").alias("id"), "company_id"), KEY, "company_id").distinct()
    direct = direct.join(known, "company_id", "left_semi")
    h = closure if include_descendants else closure.filter(F.col("dist") == 0)
    return (
        lookup(direct, h, [KEY, "id"], "inner")
        .groupBy(KEY, F.col("ancestor").alias("node_id"), "company_id")
        .agg(F.count(F.lit(1)).alias("direct_node_count"), (F.min("dist") == 0).alias("is_direct"))
    )


def company_rollup_details(attachments: DataFrame, companies: DataFrame, nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """Long form: one row per (node, company, direct node) with name, reason and confidence."""
    known = companies.select("company_id", "comcode", F.col("name").alias("company_name"))
    direct = first_by(
        attachments.select(KEY, F.col("node_id").alias("id"), "company_id", "reason", "confidence", (-F.col("pos")).alias("_o")),
        [KEY, "id", "company_id"], ["_o"],
    ).drop("_o")
    names = nodes.select(KEY, "id", F.col("name").alias("direct_node_name"))
    return (
        direct.join(known, "company_id").join(names, [KEY, "id"], "left").join(closure, [KEY, "id"])
        .select(
            KEY, F.col("ancestor").alias("node_id"), "company_id", "comcode", "company_name", F.col("id").alias("direct_node_id"),
            F.coalesce("direct_node_name", "id").alias("direct_node_name"), F.coalesce("reason", F.lit("")).alias("reason"),
            F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        )
    )


def company_page(rollup: DataFrame, companies: DataFrame, limit: int = 500, offset: int = 0, locale: str | None = None) -> DataFrame:
    """One page of companies per node, ordered by name then code, with the total.

    ``offset + limit`` rows per node are kept by a group limit before the shuffle; deeper pages
    should filter to one node and use :func:`company_ranks`. Names are compared once for all companies, which get a number in this order; rows of the
    roll-up are ordered by that number, and only those of the page get their names.
    """
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    rollup = stored(rollup)  # read by the page and by the totals
    name = F.collate("name", locale) if locale else F.col("name")
    info = companies.select("company_id", "comcode", F.col("name").alias("company_name"), name.alias("_name"))
    order = stored(numbered(info, [], ["_name", "comcode"], "_no").select("company_id", "company_name", "_no"))
    totals = rollup.groupBy(KEY, "node_id").agg(F.count(F.lit(1)).alias("total"))
    placed = lookup(rollup, order.select("company_id", "_no"), ["company_id"], "inner")
    page = top_rows(placed, [KEY, "node_id"], [F.col("_no")], offset + limit).filter(F.col("rn") > offset)
    return page.join(order.select("company_name", "_no"), "_no").join(totals, [KEY, "node_id"]).select(
        KEY, "node_id", F.col("rn").cast("bigint").alias("rank"), "company_id", "company_name", "direct_node_count", "is_direct", "total"
    )


def company_ranks(rollup: DataFrame, companies: DataFrame) -> DataFrame:
    """Position of every company at every node without a per-node sort in one task."""
    info = companies.select("company_id", "comcode", F.col("name").alias("company_name"))
    return numbered(rollup.join(info, "company_id"), [KEY, "node_id"], ["company_name", "comcode"], "rank")


def multi_node_companies(rollup: DataFrame, expanded: DataFrame) -> DataFrame:
    """Companies over several expanded nodes; direct at any of them wins."""
    chosen = expanded.select(KEY, F.col("id").alias("node_id")).distinct()
    return rollup.join(chosen, [KEY, "node_id"], "left_semi").groupBy(KEY, "company_id").agg(
        F.count(F.lit(1)).alias("node_count"),
        F.when(F.max("is_direct"), "direct").otherwise("rolled_up").alias("link_type"),
    )


def node_company_links(rollup: DataFrame, expanded: DataFrame) -> DataFrame:
    chosen = expanded.select(KEY, F.col("id").alias("node_id")).distinct()
    return rollup.join(chosen, [KEY, "node_id"], "left_semi").select(
        KEY, "node_id", "company_id", F.when(F.col("is_direct"), "direct").otherwise("rolled_up").alias("link_type")
    )


def compact_nodes(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """Narrow node projection with its path."""
    return nodes.join(lines.select(KEY, "id", "path"), [KEY, "id"], "left").select(
        KEY, "id", "name", "level", "chain_position", F.coalesce("path", "name").alias("path"),
        X.or_default(F.col("business_description"), F.col("description"), F.lit("")).alias("description"),
    )


def batches(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Batch index (from 1) of fixed size, in key order, without a whole-key sort in one task."""
    ranked = numbered(df, keys, order, "_rn")
    return ranked.withColumn("batch_index", (F.floor((F.col("_rn") - 1) / F.lit(max(1, size))) + 1).cast("bigint")).drop("_rn")


def search_plan(industries: DataFrame) -> DataFrame:
    """Ten search queries per industry from the fixed templates."""
    templates = F.array(*[F.lit(t) for t in K.SEARCH_TEMPLATES])
    return industries.select(KEY, "name", F.posexplode(templates).alias("_i", "_t")).select(
        KEY, (F.col("_i") + 1).cast("bigint").alias("query_no"), F.replace("_t", F.lit("{industry_name}"), F.col("name")).alias("query")
    )


def limit_branches(branches: DataFrame, n: int) -> DataFrame:
    """First n branches per graph; n <= 0 keeps all."""
    if n <= 0:
        return branches
    return top_rows(branches, [KEY], [F.col("pos"), F.col("id")], n).drop("rn")
