"""Delivery tables, offline snapshot rows and report lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstrata import constants as K
from linkstrata.functions import text as X
from linkstrata.functions.tables import BROADCAST_LIMIT_BYTES, estimated_bytes, first_by, gathered, lookup, numbered
from linkstrata.operators.hierarchy import closure

KEY = "industry_id"


def delivery_metadata(spark, extra: DataFrame | None = None) -> DataFrame:
    """industry_id, code, delivery name, ind_id: the fixed table, plus callers' own rows."""
    fixed = spark.createDataFrame([tuple(r) for r in K.DELIVERY_INDUSTRIES], f"{KEY} string, code string, delivery_name string, ind_id string")
    return fixed if extra is None else fixed.unionByName(extra)


def missing_metadata(industries: DataFrame, metadata: DataFrame) -> DataFrame:
    """Industries without a delivery mapping; they cannot be exported."""
    return industries.select(KEY).join(metadata.select(KEY), KEY, "left_anti")


def mapped(industries: DataFrame, metadata: DataFrame, *columns: str) -> DataFrame:
    """Delivery mapping of each industry, with further ``columns`` of it; an industry without a mapping is an error, never left out."""
    unknown = F.raise_error(F.concat(F.lit("no delivery mapping for industry "), F.col(KEY))).cast("string")
    rows = industries.select(KEY, *columns).join(metadata.select(KEY, "code", "delivery_name", "ind_id"), KEY, "left")
    return rows.select(KEY, F.coalesce("code", unknown).alias("code"), "delivery_name", "ind_id", *columns)


def industry_rows(metadata: DataFrame, industries: DataFrame) -> DataFrame:
    return mapped(industries, metadata).select(KEY, "code", F.col("delivery_name").alias("name"), "ind_id")


def _headed(df: DataFrame, headers: DataFrame, metadata: DataFrame, as_of: str) -> DataFrame:
    """Rows with code, delivery name and effective date: the day of the header's ``generated_at``. Rows without a header are an error."""
    date = F.substring(X.or_default(F.col("generated_at"), F.lit(as_of)), 1, 10)
    head = mapped(headers, metadata, "generated_at").select(KEY, "code", "delivery_name", date.alias("effective_date"))
    unknown = F.raise_error(F.concat(F.lit("no header for industry "), F.col(KEY))).cast("string")
    return lookup(df, head, [KEY], "left").withColumn("code", F.coalesce("code", unknown))


def node_rows(nodes: DataFrame, graphs: DataFrame, metadata: DataFrame, as_of: str) -> DataFrame:
    c = F.col
    return _headed(nodes, graphs, metadata, as_of).select(
        KEY, X.delivery_id(c("id"), c(KEY), c("code")).alias("节点id"), F.lit(K.NODE_TYPE_ROOT).alias("节点类型"), c("name").alias("节点名称"),
        F.concat(F.lit("level_"), F.coalesce("level", F.lit(0)).cast("string")).alias("节点标签"), c("delivery_name").alias("节点行业"),
        X.or_default(c("business_description"), F.coalesce("description", F.lit(""))).alias("业务描述"), F.lit("").alias("公司列表"),
        F.when(F.coalesce("is_key_node", F.lit(False)), "TRUE").otherwise("FALSE").alias("关键节点"),
        X.delivery_segment(c("level"), c("chain_position"), c("chain_segment")).alias("产业链环节"), c("code").alias("节点行业code"),
        c("effective_date").alias("生效时间"), F.lit("").alias("失效时间"),
    )


def _coded(nodes: DataFrame, metadata: DataFrame) -> DataFrame:
    """(industry_id, id, name, did): delivery ids are computed once per node, not per row that names it."""
    unknown = F.raise_error(F.concat(F.lit("no delivery mapping for industry "), F.col(KEY))).cast("string")
    code = lookup(nodes.select(KEY, "id", "name"), metadata.select(KEY, "code"), [KEY], "left").withColumn("code", F.coalesce("code", unknown))
    return code.select(KEY, "id", "name", X.delivery_id(F.col("id"), F.col(KEY), F.col("code")).alias("did"))


def edge_rows(edges: DataFrame, nodes: DataFrame, graphs: DataFrame, metadata: DataFrame, as_of: str) -> DataFrame:
    """Start is the edge's target, end its source. ``edges`` is ordered by ``layer_no`` if present (main first, then overlays), then ``pos``."""
    c = F.col
    edges = edges if "layer_no" in edges.columns else edges.withColumn("layer_no", F.lit(0))
    ids = nodes.select(KEY, "id")
    known = (
        edges.withColumn("_key", X.or_default(c("id"), F.concat("source", F.lit("->"), "target")))
        .join(ids.withColumnRenamed("id", "source"), [KEY, "source"], "left_semi")
        .join(ids.withColumnRenamed("id", "target"), [KEY, "target"], "left_semi")
    )
    rows = first_by(
        known.select(KEY, "_key", "layer_no", "pos", "source", "target", "relation_type", "relation_weight", "description", "confidence"),
        [KEY, "_key"], ["layer_no", "pos", "source", "target"],
    )
    coded = _coded(nodes, metadata)
    named = rows.join(coded.select(KEY, c("id").alias("source"), c("name").alias("_sn"), c("did").alias("_sd")), [KEY, "source"]).join(
        coded.select(KEY, c("id").alias("target"), c("name").alias("_tn"), c("did").alias("_td")), [KEY, "target"]
    )
    return _headed(named.withColumnRenamed("_key", "id"), graphs, metadata, as_of).select(
        KEY, c("_td").alias("起点节点id"), c("_tn").alias("起点节点名称"), c("_sd").alias("终点节点id"), c("_sn").alias("终点节点名称"),
        F.when(c("relation_type") == K.CONTAINS, "SUBORDINATE_TO").otherwise("DOWNSTREAM_OF").alias("关系类型"),
        F.coalesce("relation_weight", F.lit(1.0)).alias("关系权重"), F.coalesce("description", F.lit("")).alias("关系描述"), c("confidence").alias("置信度"),
        F.lit("").alias("强度"), c("effective_date").alias("开始时间"), F.lit("").alias("结束时间"),
    )


def node_industry_rows(nodes: DataFrame, graphs: DataFrame, metadata: DataFrame, as_of: str) -> DataFrame:
    c = F.col
    return _headed(nodes, graphs, metadata, as_of).select(
        KEY, X.delivery_id(c("id"), c(KEY), c("code")).alias("起点节点id"), c("name").alias("起点节点名称"), c("code").alias("终点节点code"),
        c("delivery_name").alias("终点节点名称"), F.lit("BELONGS_TO_INDUSTRY").alias("关系类型"), c("effective_date").alias("开始时间"), F.lit("").alias("结束时间"),
    )


def _known_attachments(attachments: DataFrame, companies: DataFrame, nodes: DataFrame) -> DataFrame:
    return attachments.join(companies.select(KEY, "company_id").distinct(), [KEY, "company_id"], "left_semi").join(
        nodes.select(KEY, F.col("id").alias("node_id")), [KEY, "node_id"], "left_semi"
    )


def company_rows(attachments: DataFrame, companies: DataFrame, nodes: DataFrame, payloads: DataFrame, metadata: DataFrame, as_of: str) -> DataFrame:
    """Distinct attached companies (``companies`` per industry); ``payloads`` are the headers of the attachment payloads, whose date counts."""
    c = F.col
    ids = _known_attachments(attachments, companies, nodes).select(KEY, "company_id").distinct()
    info = companies.select(KEY, "company_id", "comcode", "name").dropDuplicates([KEY, "company_id"])
    return _headed(ids.join(info, [KEY, "company_id"]), payloads, metadata, as_of).select(
        KEY, c("comcode").alias("节点code"), F.lit("公司").alias("节点类型"), c("name").alias("节点名称"), F.lit("").alias("证券代码"),
        c("effective_date").alias("生效时间"), F.lit("").alias("失效时间"), F.lit("").alias("业务描述"),
    )


def company_edge_rows(
    attachments: DataFrame, companies: DataFrame, nodes: DataFrame, paths: DataFrame, payloads: DataFrame, metadata: DataFrame, as_of: str,
    aggregate_upward: bool = True,
) -> DataFrame:
    """Company-node rows: the direct node and, when rolling up, every classification ancestor; dated by the attachment payload.

    The pairs of a company in a graph stay in one task while they are repeated for the ancestors, made distinct and named, in tasks sized by the input.
    """
    c = F.col
    pairs = gathered(_known_attachments(attachments, companies, nodes).select(KEY, "company_id", "node_id"), KEY, "company_id").distinct()
    if aggregate_upward:
        above = closure(paths, nodes).select(KEY, c("id").alias("node_id"), "ancestor")
        pairs = lookup(pairs, above, [KEY, "node_id"], "inner").select(KEY, "company_id", c("ancestor").alias("node_id")).distinct()
    info = companies.select(KEY, "company_id", "comcode", c("name").alias("company_name")).dropDuplicates([KEY, "company_id"])
    coded = _coded(nodes, metadata).select(KEY, c("id").alias("node_id"), c("name").alias("node_name"), "did")
    coded = F.broadcast(coded) if estimated_bytes(nodes.select(KEY, "id", "name")) <= BROADCAST_LIMIT_BYTES else coded
    named = pairs.join(info, [KEY, "company_id"]).join(coded, [KEY, "node_id"])
    return _headed(named.withColumnRenamed("node_id", "id"), payloads, metadata, as_of).select(
        KEY, c("comcode").alias("起点节点code"), c("company_name").alias("起点节点名称"), c("did").alias("终点节点id"),
        c("node_name").alias("终点节点名称"), F.lit("BELONGS_TO_IND_NODE").alias("主体产业链关系"), c("effective_date").alias("开始时间"),
        F.lit("").alias("结束时间"), F.lit("联网搜索").alias("数据来源"),
    )


def delivery_id_collisions(node_delivery: DataFrame) -> DataFrame:
    return node_delivery.groupBy(KEY, F.col("节点id").alias("delivery_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def eligible_industries(manifest: DataFrame, nodes: DataFrame, attachment_status: DataFrame) -> DataFrame:
    """Not pending, a graph with nodes, and ready attachments."""
    with_nodes = nodes.select(KEY).distinct()
    ready = attachment_status.filter(F.col("overlay_status") == "ready").select(KEY)
    return manifest.filter(F.coalesce("status", F.lit("pending")) != "pending").join(with_nodes, KEY, "left_semi").join(ready, KEY, "left_semi").select(
        KEY, "name", "status"
    )


def snapshot_rows(
    eligible: DataFrame, nodes: DataFrame, edges: DataFrame, attachments: DataFrame, companies: DataFrame, l2_edges: DataFrame, projected: DataFrame,
    flow_ready: DataFrame,
) -> DataFrame:
    """Offline snapshot as rows (industry_id, section, item_key, payload JSON).

    Rows instead of one document per industry: a very large graph is then many rows, never one value.
    ``flow_ready`` lists industries whose flow overlay matches the graph.
    """
    c = F.col
    ids = eligible.select(KEY)
    level = nodes.select(KEY, "id", "level")

    def section(df: DataFrame, name: str, key) -> DataFrame:
        payload = F.to_json(F.struct(*[x for x in df.columns]))
        return df.select(KEY, F.lit(name).alias("section"), key.alias("item_key"), payload.alias("payload"))

    def within(df: DataFrame) -> DataFrame:
        return df.join(ids, KEY, "left_semi")

    def levelled(df: DataFrame) -> DataFrame:
        flows = within(df.filter(c("relation_type") == K.FLOW)).join(flow_ready.select(KEY), KEY, "left_semi")
        return flows.join(level.select(KEY, c("id").alias("source"), c("level").alias("_s")), [KEY, "source"]).join(
            level.select(KEY, c("id").alias("target"), c("level").alias("_t")), [KEY, "target"]
        )

    l2 = levelled(l2_edges).filter("_s = 2 AND _t = 2").drop("_s", "_t").withColumn("relation_layer", F.lit(K.L2_FLOW_LAYER))
    cross = levelled(projected).filter("(_s = 1 AND _t = 2) OR (_s = 2 AND _t = 1)").drop("_s", "_t").withColumn("relation_layer", F.lit(K.PROJECTION_LAYER))
    main = within(edges)
    layer = F.coalesce("relation_layer", F.lit(K.MAIN_LAYER)) if "relation_layer" in edges.columns else F.lit(K.MAIN_LAYER)
    kept = _known_attachments(within(attachments), companies, nodes)
    return (
        section(within(nodes), "nodes", c("id"))
        .unionByName(section(main.withColumn("relation_layer", layer), "edges", c("id")))
        .unionByName(section(within(companies), "companies", c("company_id")))
        .unionByName(section(kept, "attachments", F.concat("company_id", F.lit("->"), "node_id")))
        .unionByName(section(l2, "l2_edges", c("id")))
        .unionByName(section(cross, "projected_edges", c("id")))
    )


def snapshot_flow_ready(flow_meta: DataFrame, current: DataFrame) -> DataFrame:
    """Industries whose flow overlay may go into a snapshot: a known schema version, built on the graph as it is now.

    ``flow_meta``: industry_id, schema_version, graph_fingerprint of the stored overlays. ``current``: industry_id, graph_fingerprint.
    """
    known = flow_meta.filter(F.col("schema_version").isin(*K.SNAPSHOT_FLOW_VERSIONS)).select(KEY, "graph_fingerprint")
    return known.join(current.select(KEY, "graph_fingerprint"), [KEY, "graph_fingerprint"], "left_semi").select(KEY).distinct()


def snapshot_counts(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy(KEY, "section").agg(F.count(F.lit(1)).alias("n"))


# --- report lines -----------------------------------------------------------------------
REPORT_TITLES = {
    "graph": "图谱校验报告", "company_attachments": "公司节点挂载硬规则校验报告", "l2_flow": "L2 上下游关系硬规则校验报告", "update": "更新检查报告",
}


def report_lines(kind: str, summary: DataFrame, issues: DataFrame) -> DataFrame:
    """Markdown lines (industry_id, line_no, line): title, one bullet per summary column, then one per issue."""
    c = F.col
    facts = [x for x in summary.columns if x != KEY]
    title = F.concat(F.lit("# "), c(KEY), F.lit(" " + REPORT_TITLES[kind]))
    head = F.array(
        title, F.lit(""), *[F.concat(F.lit(f"- {x}："), F.coalesce(c(x).cast("string"), F.lit(""))) for x in facts], F.lit(""), F.lit("## 问题列表"), F.lit("")
    )
    top = summary.select(KEY, F.posexplode(head).alias("i", "line")).select(KEY, (c("i") + 1).cast("bigint").alias("line_no"), "line")
    text = F.concat(F.lit("- ["), c("severity"), F.lit("] "), c("code"), F.lit(" "), F.coalesce("item_id", F.lit("")), F.lit("："), c("message"))
    ranked = numbered(issues.select(KEY, "severity", "code", "item_id", "message"), [KEY], ["severity", "code", "item_id", "message"], "rn")
    body = ranked.select(KEY, (c("rn") + F.lit(len(facts) + 5)).cast("bigint").alias("line_no"), text.alias("line"))
    none = summary.select(KEY).join(issues.select(KEY).distinct(), KEY, "left_anti").select(
        KEY, F.lit(len(facts) + 6).cast("bigint").alias("line_no"), F.lit("未发现阻断性问题。").alias("line")
    )
    return top.unionByName(body).unionByName(none)
