"""Queries that go through files: scans, sinks, delivery tables, snapshot, reports, parsing."""

from pyspark.sql import functions as F

from linkstrata import constants as K
from linkstrata.catalog.graph import _PROJ
from linkstrata.catalog.registry import AS_OF, H, KEY, query
from linkstrata.operators import companies as C
from linkstrata.operators import export as E
from linkstrata.operators import publish as P
from linkstrata.operators import query as Q
from linkstrata.operators import validate as V
from linkstrata.operators.flow import project_flows
from linkstrata.plans import delivery as D
from linkstrata.sources import files as FI
from linkstrata.sources import responses as R
from linkstrata.sources import schemas as S
from linkstrata.sources.delimited import write_delimited


@query("s01_graph_parts_scan", """SELECT industry_id, id, name, level, parent_id, confidence, array_length(string_split(tags, ';')) AS tag_count FROM nodes""", ("nodes",))
def _(g):
    path = g.fresh_path("graph_nodes")
    FI.write_graph_parts(g("nodes"), path)
    back = FI.read_graph_parts(g.spark, path, g("nodes").schema)
    return back.select(KEY, "id", "name", "level", "parent_id", "confidence", F.size("tags").cast("bigint").alias("tag_count"))


@query("s03_manifest_roundtrip", "SELECT industry_id, name, status, node_count, edge_count FROM manifest", ("manifest",))
def _(g):
    path = g.fresh_path("manifest")
    FI.write_manifest(g("manifest"), path)
    return FI.read_manifest(g.spark, path, lines=True).select(KEY, "name", "status", "node_count", "edge_count")


@query("s04_json_lines", "SELECT 'ev_' || page_id AS evidence_id, url, sha256(url) AS content_hash FROM pages")
def _(g):
    path = g.fresh_path("evidence")
    FI.write_json_lines(g("pages").select(F.concat(F.lit("ev_"), "page_id").alias("evidence_id"), "url", F.sha2("url", 256).alias("content_hash")), path)
    return FI.read_json_lines(g.spark, path, S.EVIDENCE).select("evidence_id", "url", "content_hash")


_MASTER = ("master", """SELECT trim(comcode) AS comcode, trim(chiname) AS name, trim(chinameabbr) AS short_name,
CASE WHEN trim(islisted) = '' THEN NULL ELSE lower(trim(islisted)) IN ('1', 'true', 'yes', 'y') END AS is_listed,
CASE WHEN trim(isabroadlisted) = '' THEN NULL ELSE lower(trim(isabroadlisted)) IN ('1', 'true', 'yes', 'y') END AS is_abroad_listed,
indunamesw, indunamesw1, indunamesw2, indunamesw3, 'sw_' || trim(comcode) AS company_id FROM company_file WHERE trim(chiname) <> '' AND trim(comcode) <> ''
QUALIFY row_number() OVER (PARTITION BY trim(comcode) ORDER BY pos) = 1""")


@query("s06_company_csv_scan", "SELECT * FROM master", ("company_file",), (_MASTER,))
def _(g):
    path = g.fresh_path("companies")
    g("company_file").write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return FI.read_companies(g.spark, path).drop("pos")


# files of four charsets in one folder; every third name has quotes and a line break
_MIXED = ("mixed_file", """SELECT * REPLACE (CASE WHEN pos % 3 = 0 AND chiname <> '' THEN chiname || '，"甲"' || chr(10) || '公司' ELSE chiname END AS chiname) FROM company_file""")


@query("s06_company_csv_charsets", "SELECT * FROM master", ("company_file",), (_MIXED, (_MASTER[0], _MASTER[1].replace("FROM company_file", "FROM mixed_file"))))
def _(g):
    c = F.col
    root = g.fresh_path("mixed-companies")
    rows = g("company_file").withColumn("chiname", F.when((c("pos") % 3 == 0) & (c("chiname") != ""), F.concat("chiname", F.lit('，"甲"\n公司'))).otherwise(c("chiname")))
    for i, charset in enumerate(("utf-8-sig", "utf-8", "gb18030", "gbk")):
        part = rows.filter(F.pmod(F.floor(c("pos") / 10), F.lit(4)) == i)
        known = part.select(*[F.replace(x, F.lit("\u2003"), F.lit("\u3000")).alias(x) if part.schema[x].dataType.typeName() == "string" else c(x) for x in part.columns])
        write_delimited(known, f"{root}/{charset}", charset)
    return FI.read_companies(g.spark, f"{root}/*").drop("pos")


@query("s07_taxonomy_csv_scan", "SELECT indunamesw, indunamesw1, indunamesw2, nullif(indunamesw3, '') AS indunamesw3 FROM companies", ("companies",))
def _(g):
    path = g.fresh_path("taxonomy")
    g("companies").select(*K.TAXONOMY_COLUMNS).write.option("header", True).csv(path)
    return FI.read_taxonomy_rows(g.spark, path).select("indunamesw", "indunamesw1", "indunamesw2", "indunamesw3")


TAXONOMY = ("tax_paths", """SELECT leaf_label AS indunamesw, n AS level, l1 AS indunamesw1, l2 AS indunamesw2, x3 AS indunamesw3, path AS indunamesw_path,
string_agg(DISTINCT leaf, '|' ORDER BY leaf) AS raw_leaf_names, string_agg(DISTINCT raw_path, '|' ORDER BY raw_path) AS raw_paths, count(DISTINCT company_id) AS occurrence_count
FROM (SELECT *, CASE WHEN x3 = '' THEN 2 ELSE 3 END AS n, CASE WHEN x3 = '' THEN l2 ELSE x3 END AS leaf_label, l1 || ' > ' || l2 || CASE WHEN x3 = '' THEN '' ELSE ' > ' || x3 END AS path,
  indunamesw1 || ' > ' || indunamesw2 || CASE WHEN indunamesw3 = '' THEN '' ELSE ' > ' || indunamesw3 END AS raw_path,
  unnest(CASE WHEN indunamesw3 = '' THEN [indunamesw] ELSE [indunamesw, indunamesw3] END) AS leaf
  FROM (SELECT *, indunamesw1 AS l1, rtrim(indunamesw2, 'Ⅱ') AS l2, CASE WHEN indunamesw3 <> '' THEN rtrim(indunamesw3, 'Ⅲ')
        WHEN rtrim(rtrim(indunamesw, 'Ⅱ'), 'Ⅲ') <> rtrim(indunamesw2, 'Ⅱ') THEN rtrim(rtrim(indunamesw, 'Ⅱ'), 'Ⅲ') ELSE '' END AS x3 FROM companies)) GROUP BY ALL""")


@query("s08_taxonomy_table_sink", "SELECT * FROM tax_paths", ("companies",), (TAXONOMY,))
def _(g):
    path = g.fresh_path("taxonomy_table")
    table = FI.refresh_taxonomy_table(g("companies"), path)
    if FI.write_csv_if_changed(table, path):
        raise RuntimeError("an unchanged taxonomy table was written again")
    return table


# --- delivery ---------------------------------------------------------------------------------
_HEAD = ("head", """SELECT n.industry_id, n.id, d.code, d.delivery_name, d.code || CASE WHEN length(t) < 6 THEN lpad(t, 6, '0') ELSE t END AS did FROM (
SELECT industry_id, id, replace(substr(id, length(industry_id) + 2), '_', '') AS t FROM nodes) n JOIN delivery_codes d ON d.industry_id = n.industry_id""")
DT = ("nodes", "edges", "delivery_codes")
DA = ("nodes", "edges", "delivery_codes", "attachments", "companies", "payloads")
_DAY = "(SELECT coalesce(nullif(substr(y.generated_at, 1, 10), ''), '2024-06-01') FROM payloads y WHERE y.industry_id = {}.industry_id)"
_LISTED = ("listed", "SELECT a.* FROM attachments a JOIN companies c ON c.company_id = a.company_id WHERE c.is_listed")


def _people(g):
    return C.filter_listed(g("attachments"), C.payload_companies(g("attachments"), g("companies")))


@query("s09_delivery_industry", "SELECT industry_id, code, delivery_name AS name, ind_id FROM delivery_codes", ("delivery_codes",))
def _(g):
    return E.industry_rows(g("delivery_codes"), g("graphs"))


@query("s09_missing_metadata", "SELECT industry_id FROM manifest", ("manifest",))
def _(g):
    return E.missing_metadata(g("manifest"), E.delivery_metadata(g.spark))


_S10 = """SELECT n.industry_id, h.did AS "节点id", '产业链' AS "节点类型", n.name AS "节点名称", 'level_' || n.level AS "节点标签", h.delivery_name AS "节点行业",
coalesce(nullif(n.business_description, ''), n.description) AS "业务描述", '' AS "公司列表", CASE WHEN n.is_key_node THEN 'TRUE' ELSE 'FALSE' END AS "关键节点",
CASE WHEN n.level = 1 THEN n.chain_segment ELSE '' END AS "产业链环节", h.code AS "节点行业code", '2024-05-01' AS "生效时间", '' AS "失效时间"
FROM nodes n JOIN head h ON h.industry_id = n.industry_id AND h.id = n.id"""


@query("s10_delivery_nodes", _S10, DT, (_HEAD,))
def _(g):
    return E.node_rows(g("nodes"), g("graphs"), g("delivery_codes"), AS_OF)


_S11 = """SELECT e.industry_id, t.did AS "起点节点id", tn.name AS "起点节点名称", s.did AS "终点节点id", sn.name AS "终点节点名称",
CASE WHEN e.relation_type = 'contains' THEN 'SUBORDINATE_TO' ELSE 'DOWNSTREAM_OF' END AS "关系类型", e.relation_weight AS "关系权重", e.description AS "关系描述", e.confidence AS "置信度",
'' AS "强度", '2024-05-01' AS "开始时间", '' AS "结束时间"
FROM (SELECT industry_id, source, target, relation_type, relation_weight, description, confidence FROM edges
      UNION ALL SELECT industry_id, source, target, relation_type, relation_weight, description, confidence FROM {overlays}) e
JOIN head s ON s.industry_id = e.industry_id AND s.id = e.source JOIN head t ON t.industry_id = e.industry_id AND t.id = e.target
JOIN nodes sn ON sn.industry_id = e.industry_id AND sn.id = e.source JOIN nodes tn ON tn.industry_id = e.industry_id AND tn.id = e.target"""


@query("s11_delivery_edges", _S11.format(overlays="l2_edges"), DT + ("l2_edges",), (_HEAD,))
def _(g):
    cols = [KEY, "id", "source", "target", "relation_type", "relation_weight", "description", "confidence", "pos"]
    extra = g("l2_edges").select(*cols).withColumn("layer_no", F.lit(1))
    return E.edge_rows(g("edges").select(*cols).withColumn("layer_no", F.lit(0)).unionByName(extra), g("nodes"), g("graphs"), g("delivery_codes"), AS_OF)


_S12 = """SELECT n.industry_id, h.did AS "起点节点id", n.name AS "起点节点名称", h.code AS "终点节点code", h.delivery_name AS "终点节点名称",
'BELONGS_TO_INDUSTRY' AS "关系类型", '2024-05-01' AS "开始时间", '' AS "结束时间" FROM nodes n JOIN head h ON h.industry_id = n.industry_id AND h.id = n.id"""


@query("s12_delivery_node_industry", _S12, DT, (_HEAD,))
def _(g):
    return E.node_industry_rows(g("nodes"), g("graphs"), g("delivery_codes"), AS_OF)


_S13 = """SELECT DISTINCT a.industry_id, c.comcode AS "节点code", '公司' AS "节点类型", c.name AS "节点名称", '' AS "证券代码", """ + _DAY.format("a") + """ AS "生效时间", '' AS "失效时间", '' AS "业务描述"
FROM listed a JOIN companies c ON c.company_id = a.company_id"""


@query("s13_delivery_companies", _S13, DA, (_LISTED,))
def _(g):
    a, people = _people(g)
    return E.company_rows(a, people, g("nodes"), g("payloads"), g("delivery_codes"), AS_OF)


_CE = """SELECT DISTINCT x.industry_id, c.comcode AS "起点节点code", c.name AS "起点节点名称", h.did AS "终点节点id", n.name AS "终点节点名称", 'BELONGS_TO_IND_NODE' AS "主体产业链关系",
""" + _DAY.format("x") + """ AS "开始时间", '' AS "结束时间", '联网搜索' AS "数据来源" FROM {pairs} x JOIN companies c ON c.company_id = x.company_id
JOIN head h ON h.industry_id = x.industry_id AND h.id = x.node_id JOIN nodes n ON n.industry_id = x.industry_id AND n.id = x.node_id"""


_S14 = _CE.format(pairs="""(SELECT a.industry_id, a.company_id, h0.ancestor AS node_id FROM listed a JOIN h h0 ON h0.industry_id = a.industry_id AND h0.id = a.node_id)""")


@query("s14_delivery_company_nodes", _S14, DA, (_LISTED, _HEAD) + H)
def _(g):
    a, people = _people(g)
    return E.company_edge_rows(a, people, g("nodes"), g("agg_paths"), g("payloads"), g("delivery_codes"), AS_OF)


@query("s15_delivery_company_nodes_direct", _CE.format(pairs="listed"), DA, (_LISTED, _HEAD))
def _(g):
    a, people = _people(g)
    return E.company_edge_rows(a, people, g("nodes"), g("agg_paths"), g("payloads"), g("delivery_codes"), AS_OF, aggregate_upward=False)


def overlay_meta(g):
    """Stored overlay headers, with every kind of defect somewhere."""
    c = F.col
    current = current_state(g)
    kind = F.substring(c(KEY), 1, 3)
    return current.filter(kind != "sta").select(
        KEY, F.when(kind == "med", "other").otherwise(c(KEY)).alias("payload_industry_id"),
        F.when(kind == "lar", "v0").otherwise(K.ATTACHMENT_SCHEMA_VERSION).alias("schema_version"), (kind != "pro").alias("shape_ok"),
        F.when(kind == "eco", F.lit("old")).otherwise(c("graph_fingerprint")).alias("graph_fingerprint"), "source_hash",
    )


def current_state(g):
    fingerprint = P.graph_fingerprint(g("graphs"), g("nodes"), g("edges"))
    return fingerprint.withColumn("source_hash", P.table_hash(g("companies")).scalar())


_STATUS = ("overlay", """SELECT industry_id, CASE substr(industry_id, 1, 3) WHEN 'sta' THEN 'missing' WHEN 'lar' THEN 'invalid' WHEN 'pro' THEN 'invalid' WHEN 'med' THEN 'stale' WHEN 'eco' THEN 'stale'
ELSE 'ready' END AS overlay_status FROM manifest""")


@query("m14_overlay_status", "SELECT * FROM overlay", ("manifest",), (_STATUS,))
def _(g):
    return P.overlay_status(g("manifest"), overlay_meta(g), current_state(g))


_READY = ("overlay", "SELECT industry_id, CASE WHEN industry_id LIKE 'med%' THEN 'stale' ELSE 'ready' END AS overlay_status FROM manifest")


def _ready(g):
    return g("manifest").select(KEY, F.when(F.col(KEY).like("med%"), "stale").otherwise("ready").alias("overlay_status"))


@query("f12_delivery_eligibility", """SELECT m.industry_id, m.name, m.status FROM manifest m JOIN overlay o ON o.industry_id = m.industry_id
WHERE m.status <> 'pending' AND o.overlay_status = 'ready'""", ("manifest",), (_READY,))
def _(g):
    return E.eligible_industries(g("manifest"), g("nodes"), _ready(g))


def _file(name: str, select: str, ready: bool = False) -> str:
    cells = ", ".join(f'"{c}"' for c in D.HEADERS[name])
    gate = " WHERE industry_id IN (SELECT industry_id FROM overlay WHERE overlay_status = 'ready')" if ready else ""
    return f"SELECT industry_id, '{name}' AS file, concat_ws('|', {cells}) AS line FROM ({select}) f{gate}"


_OVERLAYS = (
    ("members", """SELECT industry_id, sp AS source, target, source AS ls, target AS lt, id, relation_weight, confidence FROM both_l2
UNION ALL SELECT industry_id, source, tp, source, target, id, relation_weight, confidence FROM both_l2"""),
    ("overlays", """SELECT x.* FROM (
SELECT industry_id, source, target, relation_type, relation_weight, description, confidence FROM l2_edges UNION ALL
SELECT m.industry_id, m.source, m.target, 'upstream_downstream', arg_min(m.relation_weight, {'s': m.ls, 't': m.lt}),
any_value(s.name) || '是' || any_value(t.name) || '的跨层上游投影，由 ' || count(DISTINCT m.id) || ' 条 L2 上下游关系推导。', min(m.confidence)
FROM members m JOIN nodes s ON s.industry_id = m.industry_id AND s.id = m.source JOIN nodes t ON t.industry_id = m.industry_id AND t.id = m.target
GROUP BY m.industry_id, m.source, m.target) x JOIN overlay o ON o.industry_id = x.industry_id AND o.overlay_status = 'ready'"""),
)


@query("s16_delivery_bundle", "\nUNION ALL ".join((
    _file("industry_node", "SELECT industry_id, code, delivery_name AS name, ind_id FROM delivery_codes"), _file("industrynode_node", _S10), _file("industrynode_industry_edge", _S12),
    _file("industrynode_edge", _S11.format(overlays="overlays")), _file("company_node", _S13, True), _file("company_industrynode_edge_node", _S14, True),
    _file("company_industrynode_edge_node_不聚合", _CE.format(pairs="listed"), True),
)), DA + ("manifest", "l2_edges"), (_LISTED, _READY, _HEAD) + H + _PROJ + _OVERLAYS)
def _(g):
    tables = D.delivery_tables(
        g("graphs"), g("nodes"), g("edges"), g("l2_edges"), project_flows(g("l2_edges"), g("nodes"), AS_OF), g("attachments"), g("companies"),
        g("agg_paths"), g("delivery_codes"), _ready(g), _ready(g), g("payloads"), AS_OF,
    )
    paths = D.write_bundle(tables, g.fresh_path("delivery"))
    out = None
    for name, path in paths.items():
        rows = FI.read_delivery(g.spark, path).select(KEY, F.lit(name).alias("file"), F.concat_ws("|", *D.HEADERS[name]).alias("line"))
        out = rows if out is None else out.unionByName(rows)
    return out


_FLOW_VERSIONS = {"lar": K.SNAPSHOT_FLOW_VERSIONS[0], "pro": "industry_l2_flow_relations_v0.1"}  # by industry prefix; others have the current one


def flow_meta(g):
    """Stored flow overlays: two schema versions that are known, one that is not, and a stale fingerprint."""
    kind, version = F.substring(KEY, 1, 3), F.lit(K.FLOW_SCHEMA_VERSION)
    for prefix, value in _FLOW_VERSIONS.items():
        version = F.when(kind == prefix, value).otherwise(version)
    current = current_state(g)
    return current.select(KEY, version.alias("schema_version"), F.when(kind == "eco", "old").otherwise(F.col("graph_fingerprint")).alias("graph_fingerprint"))


_S17 = """SELECT x.industry_id, x.section, x.item_key FROM (
SELECT industry_id, 'nodes' AS section, id AS item_key FROM nodes UNION ALL SELECT industry_id, 'edges', id FROM edges
UNION ALL SELECT DISTINCT industry_id, 'companies', company_id FROM attachments UNION ALL SELECT industry_id, 'attachments', company_id || '->' || node_id FROM attachments
UNION ALL SELECT industry_id, 'l2_edges', id FROM l2_edges WHERE substr(industry_id, 1, 3) NOT IN ('pro', 'eco')
UNION ALL SELECT industry_id, 'projected_edges', id FROM projected WHERE substr(industry_id, 1, 3) NOT IN ('pro', 'eco')) x
JOIN manifest m ON m.industry_id = x.industry_id AND m.status <> 'pending' JOIN overlay o ON o.industry_id = x.industry_id AND o.overlay_status = 'ready'"""


def _snapshot(g):
    eligible = E.eligible_industries(g("manifest"), g("nodes"), _ready(g))
    return E.snapshot_rows(
        eligible, g("nodes"), g("edges"), g("attachments"), C.payload_companies(g("attachments"), g("companies")), g("l2_edges"),
        project_flows(g("l2_edges"), g("nodes"), AS_OF), E.snapshot_flow_ready(flow_meta(g), current_state(g)),
    )


@query("s17_offline_snapshot", _S17, DA + ("manifest", "l2_edges"), (_READY,) + _PROJ)
def _(g):
    return _snapshot(g).select(KEY, "section", "item_key")


@query("s17_snapshot_counts", f"SELECT industry_id, section, count(*) AS n FROM ({_S17}) GROUP BY ALL", DA + ("manifest", "l2_edges"), (_READY,) + _PROJ)
def _(g):
    return E.snapshot_counts(_snapshot(g))


@query("s17_snapshot_nodes", """SELECT n.industry_id, n.id, n.name, n.level, n.chain_position, n.parent_id, n.description, n.source_urls, n.confidence FROM nodes n
JOIN manifest m ON m.industry_id = n.industry_id AND m.status <> 'pending' JOIN overlay o ON o.industry_id = n.industry_id AND o.overlay_status = 'ready'""", DA + ("manifest",), (_READY,))
def _(g):
    kinds = "id string, name string, level int, chain_position string, parent_id string, description string, source_urls array<string>, confidence double"
    rows = _snapshot(g).filter("section = 'nodes'").select(KEY, F.from_json("payload", kinds).alias("p")).select(KEY, "p.*")
    return rows.withColumn("source_urls", F.array_join("source_urls", ";"))


@query("s18_graph_upsert", """SELECT n.industry_id, count(*) AS node_count, (SELECT count(*) FROM edges e WHERE e.industry_id = n.industry_id) AS edge_count,
count(*) FILTER (WHERE level = 2) AS renamed FROM nodes n GROUP BY ALL""", ("nodes", "edges"))
def _(g):
    keep = [KEY, "id", "name", "level"]
    old = g("nodes").filter("level <= 2").select(*keep)
    new = g("nodes").filter("level >= 2").withColumn("name", F.concat("name", F.lit(" *"))).select(*keep)
    link = [KEY, "source", "relation_type", "target", "confidence"]
    dangling = g("edges").withColumn("target", F.concat("target", F.lit("_none"))).select(*link)
    nodes, edges, counts = P.upsert_graph(old, g("edges").filter("pos < 3000000000000").select(*link), new, g("edges").select(*link).unionByName(dangling))
    renamed = nodes.groupBy(KEY).agg(F.count_if((F.col("level") == 2) & F.col("name").endswith(" *")).alias("renamed"))
    return counts.join(renamed, KEY)


@query("s18_industry_rows", """SELECT m.industry_id, m.name, (SELECT count(*) FROM nodes n WHERE n.industry_id = m.industry_id AND n.level >= 2) AS node_count, 2 * (SELECT count(*) FROM edges e WHERE e.industry_id = m.industry_id) AS edge_count,
CASE WHEN m.industry_id LIKE 'med%' THEN m.status ELSE 'demo' END AS status FROM manifest m""", ("nodes", "edges", "manifest"))
def _(g):
    import_edges = g("edges").unionByName(g("edges").withColumn("target", F.concat("target", F.lit("_none"))))
    imported = P.industry_rows(g("manifest"), g("nodes").filter("level >= 2"), import_edges)
    old = g("manifest").select(KEY, "name", F.lit(0).cast("bigint").alias("node_count"), F.lit(0).cast("bigint").alias("edge_count"), "status")
    quiet = imported.withColumn("status", F.when(F.col(KEY).like("med%"), F.lit(None)).otherwise(F.col("status")))
    return P.upsert(old, quiet, [KEY])


@query("s20_search_plan", "SELECT industry_id, cast(query_no AS bigint) AS query_no, name || ' ' || tail AS query FROM manifest, (VALUES "
       + ", ".join(f"({i + 1}, '{t.split('} ')[1]}')" for i, t in enumerate(K.SEARCH_TEMPLATES)) + ") v(query_no, tail)", ("manifest",))
def _(g):
    return Q.search_plan(g("manifest"))


_LINES = ("lines", f"""SELECT batch_id, unnest(regexp_split_to_array(replace(line, '```', ''), '{K.LINE_END}')) AS line FROM verdict_lines""")


@query("s21_verdict_parse", """SELECT batch_id, pair_id, max(verdict) AS verdict FROM (
SELECT batch_id, lower(regexp_extract(line, '(?i)^\\s*(p_[0-9a-f]{16})\\s*:\\s*(A_TO_B|B_TO_A|NO)\\s*$', 1)) AS pair_id,
upper(regexp_extract(line, '(?i)^\\s*(p_[0-9a-f]{16})\\s*:\\s*(A_TO_B|B_TO_A|NO)\\s*$', 2)) AS verdict FROM lines)
WHERE (batch_id, pair_id) IN (SELECT (batch_id, pair_id) FROM verdict_lines) GROUP BY ALL HAVING count(*) = 1""", ("verdict_lines",), (_LINES,))
def _(g):
    responses = g("verdict_lines").select("batch_id", F.col("line").alias("raw_response"))
    return R.parse_verdicts(responses, g("verdict_lines").select("batch_id", "pair_id"))


@query("s22_company_match_parse", """SELECT industry_id, leaf_id AS batch_id, company_id, 'returned' AS result_status, cast(i AS int) AS match_no, CASE WHEN i = 0 THEN leaf_id ELSE branch_id END AS node_id,
'order ' || o AS reason, CASE WHEN i = 0 THEN '0.9' ELSE 'high' END AS confidence FROM supply, (VALUES (0), (1)) v(i) WHERE o % 6 <> 0 AND o % 10 <> 1
UNION ALL SELECT industry_id, leaf_id, company_id, 'agent_omitted_filled_empty', NULL, NULL, NULL, NULL FROM supply WHERE o % 6 = 0 OR o % 10 = 1""", ("supply",))
def _(g):
    c = F.col
    body = F.format_string(
        'answer {"results":[{"company_id":"%s","matched_nodes":[{"node_id":"%s","reason":"order %d","confidence":0.9},{"node_id":"%s","reason":"order %d","confidence":"high"}]}]} end',
        "company_id", "leaf_id", "o", "branch_id", "o",
    )
    raw = F.when(c("o") % 6 == 0, '{"results":[]}').when(c("o") % 10 == 1, "no answer").otherwise(body)
    batch = F.concat("leaf_id", F.lit("|"), "company_id").alias("batch_id")
    rows = g("supply")
    out = R.parse_company_matches(rows.select(KEY, batch, raw.alias("raw_response")), rows.select(KEY, batch, "company_id"))
    return out.select(KEY, F.split("batch_id", "[|]")[0].alias("batch_id"), "company_id", "result_status", "match_no", "node_id", "reason", "confidence")


@query("s22_unreadable_responses", "SELECT industry_id, leaf_id || '|' || company_id AS batch_id FROM supply WHERE o % 10 = 1", ("supply",))
def _(g):
    raw = F.when(F.col("o") % 10 == 1, "no answer").otherwise('x {"results":[]} y')
    return R.unreadable_responses(g("supply").select(KEY, F.concat("leaf_id", F.lit("|"), "company_id").alias("batch_id"), raw.alias("raw_response")))
