"""Bring loose node and edge tables into the closed graph schema, with the legality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkstrata import constants as K
from linkstrata.functions import text as X
from linkstrata.functions.tables import checkpointed, first_by, last_by, lookup

KEY = "industry_id"
NODE_OUT = (
    KEY, "pos", "id", "name", "node_type", "tags", "industry", "level", "chain_position", "parent_id", "description",
    "business_description", "is_key_node", "chain_segment", "source_urls", "evidence_ids", "confidence", "updated_at",
)
EDGE_OUT = (
    KEY, "pos", "id", "source", "target", "relation_type", "relation_weight", "description", "source_urls",
    "evidence_ids", "confidence", "updated_at",
)


def _strings() -> Column:
    return F.array().cast("array<string>")


def _filled(arr: Column, fallback: Column) -> Column:
    return F.when(F.coalesce(F.size(arr), F.lit(0)) > 0, arr).otherwise(fallback)


def graph_defaults(graphs: DataFrame, as_of: str) -> DataFrame:
    """Per graph: distinct source-basis urls in order, their evidence ids, name and update stamp."""
    urls = X.ordered_distinct(F.transform("source_basis", lambda s: s["url"]))
    return graphs.select(
        KEY,
        urls.alias("default_urls"),
        X.default_evidence_ids(urls).alias("default_evidence"),
        X.or_default(F.col("industry"), F.col(KEY)).alias("default_industry"),
        X.or_default(F.col("generated_at"), F.lit(as_of)).alias("default_updated"),
    )


def standardize_nodes(nodes: DataFrame, defaults: DataFrame) -> DataFrame:
    """Closed column list with all fallbacks; one row in, one row out."""
    c = F.col
    level, position = F.coalesce(c("level"), F.lit(0)).cast("int"), F.coalesce("chain_position", F.lit("support"))
    description = X.or_default(c("business_description"), c("description"), F.lit(""))
    urls = _filled(c("source_urls"), F.coalesce("default_urls", _strings()))
    level_tag = F.concat(F.lit("level_"), level.cast("string"))
    return lookup(nodes, defaults, [KEY]).select(
        KEY, "pos", "id", "name",
        X.or_default(c("node_type"), X.node_type(c("level"), c("chain_position"))).alias("node_type"),
        _filled(c("tags"), F.array(level_tag, position)).alias("tags"),
        X.or_default(c("industry"), c("default_industry"), c(KEY)).alias("industry"),
        level.alias("level"),
        position.alias("chain_position"),
        F.coalesce("parent_id", F.lit("")).alias("parent_id"),
        description.alias("description"),
        description.alias("business_description"),
        F.coalesce("is_key_node", level <= 1).alias("is_key_node"),
        X.or_default(c("chain_segment"), X.segment_label(position)).alias("chain_segment"),
        urls.alias("source_urls"),
        _filled(c("evidence_ids"), F.coalesce("default_evidence", _strings())).alias("evidence_ids"),
        F.coalesce("confidence", F.when(F.size(urls) > 0, K.DEFAULT_CONFIDENCE).otherwise(0.0)).alias("confidence"),
        X.or_default(c("updated_at"), c("default_updated")).alias("updated_at"),
        *[c(x) for x in ("deprecated", "has_company_field") if x in nodes.columns],
    )


def root_ids(nodes: DataFrame) -> DataFrame:
    """First root per graph by input order."""
    return (
        nodes.filter(X.is_root(F.col("level"), F.col("chain_position")))
        .groupBy(KEY).agg(F.min_by("id", F.struct("pos", "id")).alias("root_id"))
    )


def fill_parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Blank parents take the first contains edge; then the L1 rule decides.

    With duplicate ids only the last row of an id is filled, as in a by-id index.
    """
    last = nodes.groupBy(KEY, "id").agg(F.max("pos").alias("_last_pos"))
    ids = last.select(KEY, "id")
    by_edge = (
        edges.filter(F.col("relation_type") == K.CONTAINS)
        .join(ids.withColumnRenamed("id", "source"), [KEY, "source"], "left_semi")
        .groupBy(KEY, F.col("target").alias("id"))
        .agg(F.min_by("source", F.struct("pos", "source")).alias("_by_edge"))
    )
    filled = (
        nodes.join(last, [KEY, "id"], "left").join(by_edge, [KEY, "id"], "left")
        .withColumn(
            "parent_id",
            F.when((F.col("parent_id") == "") & (F.col("pos") == F.col("_last_pos")), F.coalesce("_by_edge", F.lit("")))
            .otherwise(F.col("parent_id")),
        )
        .drop("_by_edge", "_last_pos")
    )
    return apply_level_one_rule(filled)


def apply_level_one_rule(nodes: DataFrame) -> DataFrame:
    """Upstream/downstream L1 lose their parent; other L1 without parent hang under the first root."""
    orphan = (F.col("level") == 1) & (F.col("parent_id") == "") & F.col("root_id").isNotNull()
    return (
        lookup(nodes, root_ids(nodes), [KEY])
        .withColumn(
            "parent_id",
            F.when(X.is_level_one_flow(F.col("level"), F.col("chain_position")), F.lit(""))
            .when(orphan, F.col("root_id")).otherwise(F.col("parent_id")),
        )
        .drop("root_id")
    )


def tree_edge_keys(nodes: DataFrame) -> DataFrame:
    """One contains key per node whose parent exists (by-id index: last row of an id)."""
    index = last_by(nodes.select(KEY, "id", "pos", "parent_id"), [KEY, "id"], ["pos"])
    known = index.select(KEY, F.col("id").alias("source"))
    return (
        index.filter(F.col("parent_id") != "")
        .select(KEY, F.col("parent_id").alias("source"), F.col("id").alias("target"))
        .join(known, [KEY, "source"], "left_semi")
        .select(KEY, "source", "target", F.lit(K.CONTAINS).alias("relation_type"))
    )


def flow_edge_keys(nodes: DataFrame) -> DataFrame:
    """Upstream L1 -> root and root -> downstream L1."""
    up = F.col("chain_position") == "upstream"
    level_one = nodes.filter(X.is_level_one_flow(F.col("level"), F.col("chain_position"))).select(KEY, "id", "chain_position")
    return (
        lookup(level_one, root_ids(nodes), [KEY], "inner")
        .select(
            KEY,
            F.when(up, F.col("id")).otherwise(F.col("root_id")).alias("source"),
            F.when(up, F.col("root_id")).otherwise(F.col("id")).alias("target"),
            F.lit(K.FLOW).alias("relation_type"),
        )
        .distinct()
    )


def legal_edge_keys(nodes: DataFrame) -> DataFrame:
    """Tree keys and flow keys, at most one per unordered node pair; ``pos`` 0 = tree, 1 = flow."""
    tree = tree_edge_keys(nodes).withColumn("pos", F.lit(0).cast("bigint"))
    level = last_by(nodes.select(KEY, "id", "pos", "level"), [KEY, "id"], ["pos"]).drop("pos")
    flow = (
        flow_edge_keys(nodes)
        .join(level.select(KEY, F.col("id").alias("source"), F.col("level").alias("_ls")), [KEY, "source"])
        .join(level.select(KEY, F.col("id").alias("target"), F.col("level").alias("_lt")), [KEY, "target"])
        .filter("(_ls = 1 AND _lt = 0) OR (_ls = 0 AND _lt = 1)")
        .select(KEY, "source", "target", "relation_type", F.lit(1).cast("bigint").alias("pos"))
    )
    paired = (
        tree.unionByName(flow)
        .withColumn("_a", F.least("source", "target")).withColumn("_b", F.greatest("source", "target"))
    )
    return first_by(paired, [KEY, "_a", "_b"], ["pos", "source", "target"]).drop("_a", "_b")


def standardize_edges(keys: DataFrame, raw_edges: DataFrame, nodes: DataFrame, defaults: DataFrame) -> DataFrame:
    """Attach attributes of the last raw edge with the same key, then the fallbacks."""
    raw = last_by(
        raw_edges.select(
            KEY, "source", "target", "relation_type", "pos", "id", "relation_weight", "description", "source_urls",
            "evidence_ids", "confidence", "updated_at",
            *[c for c in ("deprecated",) if c in raw_edges.columns],
        ),
        [KEY, "source", "target", "relation_type"], ["pos", "id"],
    ).drop("pos")
    urls = last_by(nodes.select(KEY, "id", "pos", F.col("source_urls").alias("_u")), [KEY, "id"], ["pos"]).drop("pos")
    c = F.col
    joined = (
        keys.join(raw, [KEY, "source", "target", "relation_type"], "left")
        .join(urls.select(KEY, c("id").alias("source"), c("_u").alias("_us")), [KEY, "source"], "left")
        .join(urls.select(KEY, c("id").alias("target"), c("_u").alias("_ut")), [KEY, "target"], "left")
    )
    union = F.array_sort(
        F.array_distinct(F.concat(F.coalesce("_us", _strings()), F.coalesce("_ut", _strings()), F.coalesce("default_urls", _strings())))
    )
    edge_urls = _filled(c("source_urls"), union)
    return lookup(joined, defaults, [KEY]).select(
        KEY, "pos",
        X.or_default(c("id"), X.edge_id(c("source"), c("relation_type"), c("target"))).alias("id"),
        "source", "target", "relation_type",
        F.coalesce("relation_weight", F.lit(1.0)).alias("relation_weight"),
        F.coalesce("description", F.lit("")).alias("description"),
        edge_urls.alias("source_urls"),
        _filled(c("evidence_ids"), X.default_evidence_ids(edge_urls)).alias("evidence_ids"),
        F.coalesce("confidence", F.when(F.size(edge_urls) > 0, K.DEFAULT_CONFIDENCE).otherwise(0.0)).alias("confidence"),
        X.or_default(c("updated_at"), c("default_updated")).alias("updated_at"),
        *[c(x) for x in ("deprecated",) if x in joined.columns],
    )


def singleton_leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Removal report: leaves (level >= 2) that are the only contains child of a parent above L0."""
    info = last_by(nodes.select(KEY, "id", "pos", "name", "level"), [KEY, "id"], ["pos"]).drop("pos")
    links = (
        edges.filter(F.col("relation_type") == K.CONTAINS).select(KEY, "source", "target")
        .join(info.select(KEY, F.col("id").alias("source"), F.col("name").alias("parent_name"), F.col("level").alias("_pl")), [KEY, "source"])
        .join(info.select(KEY, F.col("id").alias("target"), F.col("name").alias("child_name"), F.col("level").alias("_cl")), [KEY, "target"])
    )
    only = links.groupBy(KEY, "source").agg(
        F.count(F.lit(1)).alias("_n"), F.max("target").alias("child_id"), F.max("parent_name").alias("parent_name"),
        F.max("child_name").alias("child_name"), F.max("_pl").alias("_pl"), F.max("_cl").alias("_cl"),
    ).filter("_n = 1 AND _pl <> 0 AND _cl >= 2")
    has_children = links.select(KEY, F.col("source").alias("child_id")).distinct()
    return only.join(has_children, [KEY, "child_id"], "left_anti").select(
        KEY, F.col("source").alias("parent_id"), "parent_name", "child_id", "child_name"
    )


def drop_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove ids ``gone(industry_id, id)`` and every edge that touches them."""
    ids = gone.select(KEY, "id").distinct()
    kept = nodes.join(ids, [KEY, "id"], "left_anti")
    edges = edges.join(ids.withColumnRenamed("id", "source"), [KEY, "source"], "left_anti").join(
        ids.withColumnRenamed("id", "target"), [KEY, "target"], "left_anti"
    )
    return kept, edges


def remove_singleton_leaves(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One pass: (nodes, edges, report)."""
    report = singleton_leaves(nodes, edges)
    kept, left = drop_nodes(nodes, edges, report.select(KEY, F.col("child_id").alias("id")))
    return kept.select(*nodes.columns), left.select(*edges.columns), report


def standardize_graph(
    graphs: DataFrame, nodes: DataFrame, edges: DataFrame, as_of: str, collapse: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all graphs in standard form. ``as_of`` replaces "now".

    The filled nodes and the full edge set are read several times below, so each is cut once.
    """
    defaults = graph_defaults(graphs, as_of)
    std = checkpointed(fill_parents(standardize_nodes(nodes, defaults), edges))
    out = checkpointed(standardize_edges(legal_edge_keys(std), edges, std, defaults))
    if not collapse:
        return std, out
    std, out, _ = remove_singleton_leaves(std, out)
    return std, out


def standard_header(graphs: DataFrame, as_of: str) -> DataFrame:
    """Graph-level columns after standardization."""
    return graphs.select(
        KEY, "industry",
        F.coalesce("version", F.lit(K.DEFAULT_GRAPH_VERSION)).alias("version"),
        F.lit(K.GRAPH_SCHEMA_VERSION).alias("schema_version"),
        X.or_default(F.col("generated_at"), F.lit(as_of)).alias("generated_at"),
        F.coalesce("scope", F.lit(K.DEFAULT_GRAPH_SCOPE)).alias("scope"),
        "source_basis",
    )


def load_defaults_nodes(nodes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Read-time defaults of the query side (lighter than standardization)."""
    c = F.col
    description = X.or_default(c("description"), F.coalesce("business_description", F.lit("")))
    business = X.or_default(c("business_description"), F.coalesce("description", F.lit("")))
    return lookup(nodes, manifest.select(KEY, c("name").alias("_industry")), [KEY]).select(
        KEY, "pos", "id", "name",
        X.or_default(c("node_type"), X.node_type(c("level"), c("chain_position"))).alias("node_type"),
        _filled(c("tags"), F.array(F.concat(F.lit("level_"), c("level").cast("string")), c("chain_position"))).alias("tags"),
        X.or_default(c("industry"), c("_industry"), c(KEY)).alias("industry"),
        "level", "chain_position",
        X.or_default(c("chain_segment"), c("chain_position")).alias("chain_segment"),
        F.nullif(c("parent_id"), F.lit("")).alias("parent_id"),
        description.alias("description"), business.alias("business_description"),
        F.coalesce("is_key_node", F.coalesce("level", F.lit(0)) <= 1).alias("is_key_node"),
        F.coalesce("source_urls", _strings()).alias("source_urls"),
        F.coalesce("evidence_ids", _strings()).alias("evidence_ids"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "updated_at",
    )


def load_defaults_edges(edges: DataFrame) -> DataFrame:
    c = F.col
    return edges.select(
        KEY, "pos", X.or_default(c("id"), X.edge_id(c("source"), c("relation_type"), c("target"))).alias("id"),
        "source", "target", "relation_type",
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("relation_weight", F.lit(1.0)).alias("relation_weight"),
        F.coalesce("source_urls", _strings()).alias("source_urls"),
        F.coalesce("evidence_ids", _strings()).alias("evidence_ids"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "updated_at",
    )
