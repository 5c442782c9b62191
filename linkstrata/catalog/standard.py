"""Queries for scalar rules, standardization and singleton removal."""

from pyspark.sql import functions as F

from linkstrata import constants as K
from linkstrata.catalog.registry import AS_OF, KEY, joined, query
from linkstrata.functions import text as X
from linkstrata.operators import standardize as ST
from linkstrata.operators.companies import with_tree_path

RAW = ("raw_nodes", "raw_edges", "graphs")
_DEFAULTS = ("defaults", """SELECT industry_id, industry, generated_at, 'https://basis.example.org/' || industry_id || '/a;https://basis.example.org/' || industry_id || '/b' AS urls,
'source_001;source_002' AS ev FROM graphs""")
_STD0 = ("std0", """SELECT r.industry_id, r.pos, r.id, r.name, r.level, r.chain_position, coalesce(r.parent_id, '') AS parent_id,
coalesce(nullif(r.business_description, ''), nullif(r.description, ''), '') AS description,
CASE WHEN r.level = 0 OR r.chain_position = 'root' THEN '产业链' WHEN r.level <= 1 THEN '产业链环节' ELSE '细分环节' END AS node_type,
'level_' || r.level || ';' || r.chain_position AS tags, coalesce(nullif(r.industry, ''), d.industry) AS industry, r.level <= 1 AS is_key_node,
CASE r.chain_position WHEN 'root' THEN 'root' WHEN 'upstream' THEN '上游' WHEN 'midstream' THEN '中游' WHEN 'downstream' THEN '下游' WHEN 'support' THEN '支持' END AS chain_segment,
CASE WHEN r.source_urls = '' THEN d.urls ELSE r.source_urls END AS source_urls, CASE WHEN r.evidence_ids = '' THEN d.ev ELSE r.evidence_ids END AS evidence_ids,
coalesce(r.confidence, 0.75) AS confidence, d.generated_at AS updated_at, r.has_company_field
FROM raw_nodes r JOIN defaults d ON d.industry_id = r.industry_id""")
_FILLED = (
    ("by_edge", """SELECT e.industry_id, e.target AS id, arg_min(e.source, e.pos) AS src FROM raw_edges e
WHERE e.relation_type = 'contains' AND EXISTS (SELECT 1 FROM raw_nodes n WHERE n.industry_id = e.industry_id AND n.id = e.source) GROUP BY ALL"""),
    ("rooted", "SELECT industry_id, arg_min(id, pos) AS root_id FROM std0 WHERE level = 0 OR chain_position = 'root' GROUP BY ALL"),
    ("filled", """SELECT s.* REPLACE (CASE WHEN s.level = 1 AND s.chain_position IN ('upstream', 'downstream') THEN ''
WHEN s.level = 1 AND (CASE WHEN s.parent_id = '' AND s.pos = m.last THEN coalesce(b.src, '') ELSE s.parent_id END) = '' THEN r.root_id
WHEN s.parent_id = '' AND s.pos = m.last THEN coalesce(b.src, '') ELSE s.parent_id END AS parent_id)
FROM std0 s JOIN (SELECT industry_id, id, max(pos) AS last FROM std0 GROUP BY ALL) m ON m.industry_id = s.industry_id AND m.id = s.id
LEFT JOIN by_edge b ON b.industry_id = s.industry_id AND b.id = s.id LEFT JOIN rooted r ON r.industry_id = s.industry_id"""),
)
_LEGAL = (
    ("lastrow", "SELECT * FROM filled QUALIFY row_number() OVER (PARTITION BY industry_id, id ORDER BY pos DESC) = 1"),
    ("tree_keys", """SELECT c.industry_id, c.parent_id AS source, c.id AS target, 'contains' AS relation_type, 0 AS kind FROM lastrow c
JOIN lastrow p ON p.industry_id = c.industry_id AND p.id = c.parent_id"""),
    ("flow_keys", """SELECT DISTINCT f.industry_id, CASE WHEN f.chain_position = 'upstream' THEN f.id ELSE r.root_id END AS source,
CASE WHEN f.chain_position = 'upstream' THEN r.root_id ELSE f.id END AS target, 'upstream_downstream' AS relation_type, 1 AS kind
FROM filled f JOIN rooted r ON r.industry_id = f.industry_id WHERE f.level = 1 AND f.chain_position IN ('upstream', 'downstream')"""),
    ("flow_legal", """SELECT k.* FROM flow_keys k JOIN lastrow s ON s.industry_id = k.industry_id AND s.id = k.source JOIN lastrow t ON t.industry_id = k.industry_id AND t.id = k.target
WHERE (s.level = 1 AND t.level = 0) OR (s.level = 0 AND t.level = 1)"""),
    ("legal", """SELECT * FROM (SELECT * FROM tree_keys UNION ALL SELECT * FROM flow_legal)
QUALIFY row_number() OVER (PARTITION BY industry_id, least(source, target), greatest(source, target) ORDER BY kind, source, target) = 1"""),
    ("raw_last", "SELECT * FROM raw_edges QUALIFY row_number() OVER (PARTITION BY industry_id, source, target, relation_type ORDER BY pos DESC) = 1"),
    ("url_union", """SELECT industry_id, source, target, string_agg(DISTINCT u, ';' ORDER BY u) AS urls, count(DISTINCT u) AS n FROM (
  SELECT k.industry_id, k.source, k.target, unnest(string_split(s.source_urls || ';' || t.source_urls || ';' || d.urls, ';')) AS u FROM legal k
  JOIN lastrow s ON s.industry_id = k.industry_id AND s.id = k.source JOIN lastrow t ON t.industry_id = k.industry_id AND t.id = k.target
  JOIN defaults d ON d.industry_id = k.industry_id) WHERE u <> '' GROUP BY ALL"""),
    ("std_edges_all", """SELECT k.industry_id, k.source || '__' || k.relation_type || '__' || k.target AS id, k.source, k.target, k.relation_type,
coalesce(r.relation_weight, 1.0) AS relation_weight, coalesce(r.description, '') AS description,
coalesce(nullif(r.source_urls, ''), u.urls) AS source_urls,
array_to_string(list_transform(range(1, len(string_split(coalesce(nullif(r.source_urls, ''), u.urls), ';')) + 1), lambda i: 'source_' || lpad(cast(i AS varchar), 3, '0')), ';') AS evidence_ids,
coalesce(r.confidence, 0.75) AS confidence, d.generated_at AS updated_at
FROM legal k JOIN url_union u ON u.industry_id = k.industry_id AND u.source = k.source AND u.target = k.target JOIN defaults d ON d.industry_id = k.industry_id
LEFT JOIN raw_last r ON r.industry_id = k.industry_id AND r.source = k.source AND r.target = k.target AND r.relation_type = k.relation_type"""),
    ("kids", """SELECT e.industry_id, e.source, count(*) AS n, max(e.target) AS child FROM std_edges_all e WHERE relation_type = 'contains' GROUP BY ALL"""),
    ("single", """SELECT k.industry_id, k.source AS parent_id, p.name AS parent_name, k.child AS child_id, c.name AS child_name FROM kids k
JOIN lastrow p ON p.industry_id = k.industry_id AND p.id = k.source JOIN lastrow c ON c.industry_id = k.industry_id AND c.id = k.child
LEFT JOIN kids g ON g.industry_id = k.industry_id AND g.source = k.child WHERE k.n = 1 AND p.level <> 0 AND c.level >= 2 AND g.n IS NULL"""),
    ("std_nodes", "SELECT f.* FROM filled f ANTI JOIN single s ON s.industry_id = f.industry_id AND s.child_id = f.id"),
    ("std_edges", """SELECT e.* FROM std_edges_all e ANTI JOIN single s ON s.industry_id = e.industry_id AND (s.child_id = e.source OR s.child_id = e.target)"""),
)
STD = (_DEFAULTS, _STD0) + _FILLED + _LEGAL
_NODE_COLS = "industry_id, pos, id, name, node_type, tags, industry, level, chain_position, parent_id, description, description AS business_description, is_key_node, chain_segment, source_urls, evidence_ids, confidence, updated_at, has_company_field"
_EDGE_COLS = "industry_id, id, source, target, relation_type, relation_weight, description, source_urls, evidence_ids, confidence, updated_at"


def standard_nodes(g):
    return ST.standardize_nodes(g("raw_nodes"), ST.graph_defaults(g("graphs"), AS_OF))


def standardized(g, collapse=True):
    return ST.standardize_graph(g("graphs"), g("raw_nodes"), g("raw_edges"), AS_OF, collapse)


@query("p01_node_type", """SELECT industry_id, pos, id, CASE WHEN level = 0 OR chain_position = 'root' THEN '产业链' WHEN level <= 1 THEN '产业链环节' ELSE '细分环节' END AS node_type FROM raw_nodes""", ("raw_nodes",))
def _(g):
    return g("raw_nodes").select(KEY, "pos", "id", X.node_type(F.col("level"), F.col("chain_position")).alias("node_type"))


@query("p02_root_and_flow_flags", """SELECT industry_id, pos, id, level = 0 OR chain_position = 'root' AS is_root, level = 1 AND chain_position IN ('upstream', 'downstream') AS is_flow FROM raw_nodes""", ("raw_nodes",))
def _(g):
    level, position = F.col("level"), F.col("chain_position")
    return g("raw_nodes").select(KEY, "pos", "id", X.is_root(level, position).alias("is_root"), X.is_level_one_flow(level, position).alias("is_flow"))


@query("p03_default_evidence", "SELECT industry_id, urls AS default_urls, ev AS default_evidence, industry AS default_industry, generated_at AS default_updated FROM defaults", ("graphs",), (_DEFAULTS,))
def _(g):
    return joined(ST.graph_defaults(g("graphs"), AS_OF), "default_urls", "default_evidence")


@query("p04_standard_node_columns", f"SELECT {_NODE_COLS} FROM std0", RAW, (_DEFAULTS, _STD0))
def _(g):
    return joined(standard_nodes(g), "tags", "source_urls", "evidence_ids")


@query("p05_standard_edge_columns", f"SELECT {_EDGE_COLS} FROM std_edges_all", RAW, STD)
def _(g):
    return joined(standardized(g, collapse=False)[1].drop("pos"), "source_urls", "evidence_ids")


@query("p06_parent_fill", "SELECT industry_id, pos, id, parent_id FROM filled WHERE level <> 1", RAW, (_DEFAULTS, _STD0) + _FILLED)
def _(g):
    return ST.fill_parents(standard_nodes(g), g("raw_edges")).filter("level <> 1").select(KEY, "pos", "id", "parent_id")


@query("p07_level_one_parents", "SELECT industry_id, id, parent_id FROM filled WHERE level = 1", RAW, (_DEFAULTS, _STD0) + _FILLED)
def _(g):
    return ST.fill_parents(standard_nodes(g), g("raw_edges")).filter("level = 1").select(KEY, "id", "parent_id")


@query("p08_tree_edges", "SELECT industry_id, source, target, relation_type FROM tree_keys", RAW, STD[:7])
def _(g):
    return ST.tree_edge_keys(ST.fill_parents(standard_nodes(g), g("raw_edges")))


@query("p09_level_one_flow_edges", "SELECT industry_id, source, target, relation_type FROM flow_keys", RAW, STD[:8])
def _(g):
    return ST.flow_edge_keys(ST.fill_parents(standard_nodes(g), g("raw_edges")))


@query("u05_one_edge_per_pair", "SELECT industry_id, source, target, relation_type, cast(kind AS bigint) AS pos FROM legal", RAW, STD[:10])
def _(g):
    return ST.legal_edge_keys(ST.fill_parents(standard_nodes(g), g("raw_edges")))


@query("m01_standard_nodes", f"SELECT {_NODE_COLS} FROM std_nodes", RAW, STD)
def _(g):
    return joined(standardized(g)[0], "tags", "source_urls", "evidence_ids")


@query("m01_standard_edges", f"SELECT {_EDGE_COLS} FROM std_edges", RAW, STD)
def _(g):
    return joined(standardized(g)[1].drop("pos"), "source_urls", "evidence_ids")


@query("m02_singleton_leaves", "SELECT industry_id, parent_id, parent_name, child_id, child_name FROM single", RAW, STD)
def _(g):
    return ST.singleton_leaves(*standardized(g, collapse=False))


@query("p10_segment_label", """SELECT industry_id, id, chain_segment AS label, CASE WHEN level <> 1 THEN '' ELSE chain_segment END AS delivery_label FROM nodes""", ("nodes",))
def _(g):
    c = F.col
    return g("nodes").select(KEY, "id", X.segment_label(c("chain_position")).alias("label"), X.delivery_segment(c("level"), c("chain_position"), c("chain_segment")).alias("delivery_label"))


@query("p11_delivery_id", """SELECT n.industry_id, n.id, d.code || CASE WHEN length(t) < 6 THEN lpad(t, 6, '0') ELSE t END AS delivery_id FROM (
SELECT industry_id, id, replace(substr(id, length(industry_id) + 2), '_', '') AS t FROM nodes) n JOIN delivery_codes d ON d.industry_id = n.industry_id""", ("nodes", "delivery_codes"))
def _(g):
    return g("nodes").join(g("delivery_codes"), KEY).select(KEY, "id", X.delivery_id(F.col("id"), F.col(KEY), F.col("code")).alias("delivery_id"))


@query("p12_safe_file_name", """SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[<>:"/\\\\|?*]', '', 'g')), ''), 'industry') AS file_name FROM pages""")
def _(g):
    return g("pages").select("page_id", X.safe_file_name(F.col("url")).alias("file_name"))


@query("p13_three_valued_flag", """SELECT pos, CASE WHEN trim(islisted) = '' THEN NULL ELSE lower(trim(islisted)) IN ('1', 'true', 'yes', 'y') END AS listed,
CASE WHEN trim(isabroadlisted) = '' THEN NULL ELSE lower(trim(isabroadlisted)) IN ('1', 'true', 'yes', 'y') END AS abroad FROM company_file""", ("company_file",))
def _(g):
    return g("company_file").select("pos", X.three_valued_flag(F.col("islisted")).alias("listed"), X.three_valued_flag(F.col("isabroadlisted")).alias("abroad"))


@query("p14_company_id", "SELECT pos, 'sw_' || trim(comcode) AS company_id FROM company_file", ("company_file",))
def _(g):
    return g("company_file").select("pos", X.company_id(F.col("comcode")).alias("company_id"))


@query("p15_name_normalization", "SELECT doc_id, regexp_replace(lower(text), '\\s+', '', 'g') AS norm FROM documents")
def _(g):
    return g("documents").select("doc_id", X.normalized_name(F.col("text")).alias("norm"))


@query("p16_process_step_name", """SELECT industry_id, pos, id, CASE WHEN regexp_matches(name, '制备|清洗|破碎|混合|制曲|糖化|发酵|蒸馏|陈酿|勾调|灌装包装|过滤灌装')
THEN NOT regexp_matches(name, '发酵调味品|发酵乳|发酵配料|发酵设备|发酵剂|灌装包装设备') ELSE regexp_matches(name, '(工艺|流程|处理工序|加工步骤)$') END AS is_step FROM raw_nodes""", ("raw_nodes",))
def _(g):
    return g("raw_nodes").select(KEY, "pos", "id", X.looks_like_process_step(F.col("name")).alias("is_step"))


@query("p17_match_label", "SELECT company_id, lower(regexp_replace(regexp_replace(indunamesw, '\\s+', '', 'g'), '[ⅠⅡⅢⅣⅤⅥ]+$', '')) AS label FROM companies", ("companies",))
def _(g):
    return g("companies").select("company_id", X.match_label(F.col("indunamesw")).alias("label"))


@query("p18_tree_label", """SELECT company_id, trim(regexp_replace(trim(regexp_replace(indunamesw3, '\\s*[Ⅰ-Ⅹ]+\\s*$', '')), '\\s+', ' ', 'g')) AS label,
trim(regexp_replace(trim(regexp_replace(indunamesw2, '\\s*[Ⅰ-Ⅹ]+\\s*$', '')), '\\s+', ' ', 'g')) AS label2 FROM companies""", ("companies",))
def _(g):
    return g("companies").select("company_id", X.tree_label(F.col("indunamesw3")).alias("label"), X.tree_label(F.col("indunamesw2")).alias("label2"))


@query("p19_tree_path", """SELECT company_id, CASE WHEN l3 = '' THEN l1 || ' > ' || l2 || CASE WHEN leaf <> l2 THEN ' > ' || leaf ELSE '' END ELSE l1 || ' > ' || l2 || ' > ' || l3 END AS path
FROM (SELECT company_id, indunamesw1 AS l1, rtrim(indunamesw2, 'Ⅱ') AS l2, rtrim(indunamesw3, 'Ⅲ') AS l3, rtrim(rtrim(indunamesw, 'Ⅱ'), 'Ⅲ') AS leaf FROM companies)""", ("companies",))
def _(g):
    return with_tree_path(g("companies"), "company_id").select("company_id", F.array_join("path", " > ").alias("path"))


@query("p20_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def _(g):
    return g("documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("m01_standard_header", f"""SELECT industry_id, industry, coalesce(version, '{K.DEFAULT_GRAPH_VERSION}') AS version, '{K.GRAPH_SCHEMA_VERSION}' AS schema_version,
coalesce(nullif(CASE WHEN industry_id LIKE 'sm%' THEN '' ELSE generated_at END, ''), '{AS_OF}') AS generated_at, coalesce(scope, '{K.DEFAULT_GRAPH_SCOPE}') AS scope FROM graphs""", ("graphs",))
def _(g):
    from linkstrata.operators.standardize import standard_header

    graphs = g("graphs").withColumn("generated_at", F.when(F.col(KEY).like("sm%"), "").otherwise(F.col("generated_at")))
    return standard_header(graphs, AS_OF).drop("source_basis")


@query("p20_graph_fingerprint", """SELECT m.industry_id, true AS has_form, true AS same_when_dealt_anew, NOT EXISTS (SELECT 1 FROM nodes n WHERE n.industry_id = m.industry_id AND n.level = 3 AND n.confidence < 0.42) AS same_with_new_names,
NOT EXISTS (SELECT 1 FROM edges e WHERE e.industry_id = m.industry_id AND e.confidence > 0.98) AS same_without_sure_edges, false AS same_in_new_order, (SELECT count(*) FROM manifest) AS n_distinct FROM manifest m""", ("nodes", "edges", "manifest"))
def _(g):
    from linkstrata.operators.publish import graph_fingerprint

    n, e = g("nodes"), g("edges")
    mark = F.col("graph_fingerprint")
    first = graph_fingerprint(g("graphs"), n, e)
    renamed = n.withColumn("name", F.when((F.col("level") == 3) & (F.col("confidence") < 0.42), F.concat("name", F.lit(" new"))).otherwise(F.col("name")))
    others = {
        "same_when_dealt_anew": (n.repartition(5), e.repartition(3)), "same_with_new_names": (renamed, e), "same_without_sure_edges": (n, e.filter("confidence <= 0.98")),
        "same_in_new_order": (n.withColumn("pos", F.col("pos") + 1), e),
    }
    out = first.withColumn("has_form", mark.rlike("^[0-9a-f]{64}$"))
    for name, (nodes, edges) in others.items():
        other = graph_fingerprint(g("graphs"), nodes, edges).select(KEY, mark.alias("_other"))
        out = out.join(other, KEY).withColumn(name, mark == F.col("_other")).drop("_other")
    distinct = first.agg(F.countDistinct(mark).alias("n_distinct"))
    return out.drop("graph_fingerprint").withColumn("n_distinct", distinct.scalar())


@query("p21_confidence_clamp", """SELECT industry_id, pos, company_id, greatest(0.0, least(1.0, coalesce(try_cast(confidence AS double), 0.75))) AS confidence FROM web_matches""", ("web_matches",))
def _(g):
    return g("web_matches").select(KEY, "pos", "company_id", X.clamp_confidence(F.col("confidence")).alias("confidence"))


@query("p23_pair_id", """SELECT industry_id, source, target, 'p_' || substr(sha256(least(source, target) || chr(0) || greatest(source, target)), 1, 16) AS pair_id,
cast('0x' || substr(sha256('p_' || substr(sha256(least(source, target) || chr(0) || greatest(source, target)), 1, 16)), 1, 8) AS bigint) / 4294967295.0 < 0.03 AS audit FROM edges""", ("edges",))
def _(g):
    pid = X.pair_id(F.col("source"), F.col("target"))
    return g("edges").select(KEY, "source", "target", pid.alias("pair_id"), X.audit_selected(pid, 0.03).alias("audit"))


@query("p27_edge_id", """SELECT industry_id, pos, coalesce(nullif(id, ''), source || '__' || relation_type || '__' || target) AS id FROM raw_edges""", ("raw_edges",))
def _(g):
    c = F.col
    return g("raw_edges").select(KEY, "pos", X.or_default(c("id"), X.edge_id(c("source"), c("relation_type"), c("target"))).alias("id"))


@query("s02_graph_defaults_nodes", """SELECT r.industry_id, r.pos, r.id, r.name, CASE WHEN r.level = 0 OR r.chain_position = 'root' THEN '产业链' WHEN r.level <= 1 THEN '产业链环节' ELSE '细分环节' END AS node_type,
'level_' || r.level || ';' || r.chain_position AS tags, coalesce(nullif(r.industry, ''), m.name) AS industry, r.level, r.chain_position, r.chain_position AS chain_segment,
nullif(r.parent_id, '') AS parent_id, coalesce(nullif(r.description, ''), r.business_description) AS description, coalesce(nullif(r.business_description, ''), r.description) AS business_description,
r.level <= 1 AS is_key_node, r.source_urls, r.evidence_ids, coalesce(r.confidence, 0.0) AS confidence, r.updated_at
FROM raw_nodes r JOIN manifest m ON m.industry_id = r.industry_id""", ("raw_nodes", "manifest"))
def _(g):
    return joined(ST.load_defaults_nodes(g("raw_nodes"), g("manifest")), "tags", "source_urls", "evidence_ids")


@query("s02_graph_defaults_edges", """SELECT industry_id, pos, source || '__' || relation_type || '__' || target AS id, source, target, relation_type, coalesce(description, '') AS description,
coalesce(relation_weight, 1.0) AS relation_weight, source_urls, evidence_ids, coalesce(confidence, 0.0) AS confidence, updated_at FROM raw_edges""", ("raw_edges",))
def _(g):
    return joined(ST.load_defaults_edges(g("raw_edges")), "source_urls", "evidence_ids")
