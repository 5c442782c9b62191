"""Small graphs as literal rows."""

NODE_SCHEMA = (
    "industry_id string, pos bigint, id string, name string, node_type string, tags array<string>, industry string, level int, chain_position string, "
    "parent_id string, description string, business_description string, is_key_node boolean, chain_segment string, source_urls array<string>, "
    "evidence_ids array<string>, confidence double, updated_at string"
)
EDGE_SCHEMA = (
    "industry_id string, pos bigint, id string, source string, target string, relation_type string, relation_weight double, description string, "
    "source_urls array<string>, evidence_ids array<string>, confidence double, updated_at string"
)
GRAPH_SCHEMA = (
    "industry_id string, industry string, version string, schema_version string, generated_at string, scope string, "
    "source_basis array<struct<name: string, url: string, note: string>>"
)
COMPANY_SCHEMA = (
    "company_id string, comcode string, name string, short_name string, is_listed boolean, is_abroad_listed boolean, indunamesw string, "
    "indunamesw1 string, indunamesw2 string, indunamesw3 string"
)
ATTACHMENT_SCHEMA = (
    "industry_id string, pos bigint, company_id string, node_id string, reason string, confidence double, match_method string, "
    "taxonomy_column string, taxonomy_value string"
)


def nodes(spark, rows, industry="t"):
    """rows: (id, name, level, position, parent[, description])."""
    data = []
    for pos, row in enumerate(rows):
        node_id, name, level, position, parent = row[:5]
        text = row[5] if len(row) > 5 else None
        data.append((industry, pos, node_id, name, None, None, None, level, position, parent, text, None, None, None,
                     [f"https://example.com/{node_id}"], [f"ev_{node_id}"], None, None))
    return spark.createDataFrame(data, NODE_SCHEMA)


def edges(spark, rows, industry="t"):
    """rows: (source, target, relation)."""
    data = [(industry, pos, None, s, t, r, None, None, None, None, None, None) for pos, (s, t, r) in enumerate(rows)]
    return spark.createDataFrame(data, EDGE_SCHEMA)


def graphs(spark, industry="t"):
    return spark.createDataFrame([(industry, "测试行业", None, None, "2024-05-01T00:00:00", None, [])], GRAPH_SCHEMA)


FLOW_NODES = [
    ("root", "测试行业", 0, "root", ""),
    ("l1_raw", "原料", 1, "upstream", "root"),
    ("l1_product", "产品", 1, "downstream", "root"),
    ("l1_process", "加工", 1, "midstream", "root"),
    ("grain", "粮食作物", 2, "upstream", "l1_raw", "白酒生产所需的主要粮食原料。"),
    ("sugar", "糖料作物", 2, "upstream", "l1_raw", "含糖食品的上游原料。"),
    ("liquor", "白酒", 2, "downstream", "l1_product", "以粮食作物为主要原料酿造。"),
    ("milling", "粮食加工", 2, "midstream", "l1_process", "将粮食作物加工为食品原料。"),
    ("candy", "糖果", 2, "downstream", "l1_product", "使用糖类原料生产的食品。"),
]
FLOW_EDGES = [(p, i, "contains") for i, _, _, _, p, *_ in FLOW_NODES if p]

ROLL_NODES = [
    ("food_beverage_000", "测试行业", 0, "root", None),
    ("food_beverage_001", "上游环节", 1, "upstream", "food_beverage_000"),
    ("food_beverage_002", "上游子分类", 2, "upstream", "food_beverage_001"),
    ("food_beverage_003", "非隶属流向节点", 2, "midstream", None),
]
ROLL_EDGES = [
    ("food_beverage_001", "food_beverage_000", "upstream_downstream"),
    ("food_beverage_001", "food_beverage_002", "contains"),
    ("food_beverage_001", "food_beverage_003", "upstream_downstream"),
]


def companies(spark, rows):
    """rows: (id, listed, abroad)."""
    return spark.createDataFrame(
        [(i, i.removeprefix("sw_"), f"{i} Ltd", i, a, b, "软件开发", "", "", "") for i, a, b in rows], COMPANY_SCHEMA
    )


def attachments(spark, pairs, industry="t"):
    return spark.createDataFrame(
        [(industry, pos, c, n, f"reason {pos}", 0.9, "agent_web_search", None, None) for pos, (c, n) in enumerate(pairs)], ATTACHMENT_SCHEMA
    )


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
