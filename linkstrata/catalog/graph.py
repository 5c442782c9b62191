"""Queries over stored graphs: filters, walks, listings."""

from pyspark.sql import functions as F

from linkstrata.catalog.registry import AGG_PARENT, AS_OF, H, KEY, LINE, TREE, joined, query
from linkstrata.operators import hierarchy as HI
from linkstrata.operators import query as Q
from linkstrata.operators.companies import payload_companies

G = ("nodes", "edges")


def _centres(g):
    return g("nodes").filter("level = 2").select(KEY, "id")


@query("f01_graph_filter_nodes", """SELECT industry_id, id, name, level FROM nodes WHERE (contains(name, 'Brand#1') OR contains(description, 'Brand#1'))
AND chain_position IN ('upstream', 'midstream') AND level IN (2, 3)""", ("nodes",))
def _(g):
    return Q.filter_nodes(g("nodes"), " Brand#1 ", ["upstream", "midstream"], [2, 3]).select(KEY, "id", "name", "level")


@query("f01_graph_filter_edges", """SELECT e.industry_id, e.id, e.source, e.target FROM edges e JOIN pick a ON a.industry_id = e.industry_id AND a.id = e.source
JOIN pick b ON b.industry_id = e.industry_id AND b.id = e.target WHERE e.relation_type = 'contains'""", G,
       (("pick", "SELECT industry_id, id FROM nodes WHERE contains(name, 'bolt') OR contains(description, 'bolt')"),))
def _(g):
    _, edges = Q.filter_graph(g("nodes"), g("edges"), ["contains"], q="bolt")
    return edges.select(KEY, "id", "source", "target")


@query("f02_graph_filter_stored", "SELECT industry_id, id FROM nodes WHERE contains(name, ' gear') OR contains(description, ' gear')", ("nodes",))
def _(g):
    return Q.filter_nodes(g("nodes"), " gear", mode="stored").select(KEY, "id")


@query("f03_graph_filter_offline", """SELECT industry_id, id FROM nodes WHERE contains(lower(concat_ws(' ', nullif(name, ''), nullif(description, ''),
nullif(business_description, ''), nullif(node_type, ''), replace(tags, ';', ' '))), 'level_2 up')""", ("nodes",))
def _(g):
    return Q.filter_nodes(g("nodes"), "LEVEL_2 Up", mode="offline").select(KEY, "id")


@query("j01_aggregation_parents", "SELECT industry_id, id, parent AS parent_id FROM agg_parent WHERE parent IS NOT NULL", G, AGG_PARENT)
def _(g):
    return HI.aggregation_parents(g("nodes"), g("edges"))


@query("j01_ancestor_closure", "SELECT industry_id, id, ancestor, dist FROM h", G, H)
def _(g):
    return HI.closure(HI.ancestor_paths(HI.aggregation_parents(g("nodes"), g("edges"))), g("nodes"))


@query("j01_descendant_counts", "SELECT industry_id, ancestor AS id, count(*) - 1 AS descendant_count FROM h GROUP BY ALL", G, H)
def _(g):
    return HI.closure(g("agg_paths"), g("nodes")).groupBy(KEY, F.col("ancestor").alias("id")).agg((F.count("*") - 1).alias("descendant_count"))


@query("j02_induced_subgraph", """SELECT e.industry_id, e.id FROM edges e JOIN nodes a ON a.industry_id = e.industry_id AND a.id = e.source
JOIN nodes b ON b.industry_id = e.industry_id AND b.id = e.target WHERE a.confidence >= 0.6 AND b.confidence >= 0.6""", G)
def _(g):
    return Q.induced_edges(g("edges"), g("nodes").filter("confidence >= 0.6")).select(KEY, "id")


@query("j03_neighbours", """SELECT DISTINCT c.industry_id, c.id AS centre, n.id, n.name, n.level FROM nodes c
JOIN (SELECT industry_id, source AS a, target AS b FROM edges UNION ALL SELECT industry_id, target, source FROM edges
      UNION ALL SELECT industry_id, id, id FROM nodes) x ON x.industry_id = c.industry_id AND x.a = c.id
JOIN nodes n ON n.industry_id = c.industry_id AND n.id = x.b WHERE c.level = 2""", G)
def _(g):
    return Q.neighbour_nodes(g("edges"), g("nodes"), _centres(g))


@query("j04_lineage_path", "SELECT industry_id, id, path FROM line", ("nodes",), LINE)
def _(g):
    return HI.lineage(g("nodes"), g("tree_paths")).select(KEY, "id", "path")


@query("j05_branch_role", "SELECT industry_id, id, branch_id, branch_name, branch_role FROM line", ("nodes",), LINE)
def _(g):
    return HI.lineage(g("nodes"), g("tree_paths")).select(KEY, "id", "branch_id", "branch_name", "branch_role")


@query("j07_subtree", "SELECT t.industry_id, t.ancestor AS top, t.id FROM th t JOIN nodes n ON n.industry_id = t.industry_id AND n.id = t.ancestor WHERE n.level = 1", ("nodes",), TREE)
def _(g):
    return HI.subtree(g("tree_paths"), g("nodes").filter("level = 1").select(KEY, "id"))


@query("w08_tree_listing", """SELECT industry_id, id, row_number() OVER (PARTITION BY industry_id ORDER BY id) AS line_no,
repeat('  ', level) || '- L' || level || ' ' || name || ' (`' || id || '`)' AS line FROM nodes""", ("nodes",))
def _(g):
    from linkstrata.functions.tables import numbered

    rows = HI.tree_listing(g("nodes"), g("tree_paths")).withColumn("_k", F.array_join("sort_key", "/"))
    return numbered(rows, [KEY], ["_k"], "line_no").select(KEY, "id", "line_no", "line")


@query("j17_flow_split", """SELECT c.industry_id, c.id AS centre, e.id AS edge_id, e.source, e.target, e.relation_type,
CASE WHEN e.relation_type = 'contains' AND e.source = c.id THEN 'child' WHEN e.relation_type = 'upstream_downstream' AND e.target = c.id THEN 'upstream'
     WHEN e.relation_type = 'upstream_downstream' AND e.source = c.id THEN 'downstream' ELSE 'other' END AS side
FROM nodes c JOIN edges e ON e.industry_id = c.industry_id AND (e.source = c.id OR e.target = c.id) WHERE c.level <= 1""", G)
def _(g):
    return Q.split_flow(g("edges"), g("nodes").filter("level <= 1"))


@query("p25_relation_sentence", """SELECT e.industry_id, e.id AS edge_id, CASE WHEN e.relation_type = 'contains'
THEN coalesce(t.name, e.target) || ' 隶属于 ' || coalesce(s.name, e.source) ELSE coalesce(t.name, e.target) || ' 是 ' || coalesce(s.name, e.source) || ' 的下游' END AS sentence
FROM edges e LEFT JOIN nodes s ON s.industry_id = e.industry_id AND s.id = e.source LEFT JOIN nodes t ON t.industry_id = e.industry_id AND t.id = e.target""", G)
def _(g):
    return Q.relation_sentences(g("edges"), g("nodes"))


_PROJ = (
    ("both_l2", """SELECT e.*, s.parent_id AS sp, t.parent_id AS tp FROM l2_edges e JOIN nodes s ON s.industry_id = e.industry_id AND s.id = e.source AND s.level = 2
JOIN nodes t ON t.industry_id = e.industry_id AND t.id = e.target AND t.level = 2 WHERE s.parent_id <> t.parent_id"""),
    ("seen", """SELECT industry_id, sp AS source, target, 'source_parent_to_target' AS role, * EXCLUDE (industry_id, source, target) FROM both_l2 UNION ALL
SELECT industry_id, source, tp, 'source_to_target_parent', * EXCLUDE (industry_id, source, target) FROM both_l2"""),
    ("projected", """SELECT industry_id, source || '__upstream_downstream__' || target AS id, source, target, min(confidence) AS confidence FROM seen GROUP BY ALL"""),
)


@query("j16_node_flow_relations", """SELECT c.industry_id, c.id AS centre, r.id AS edge_id, r.source, r.target, r.relation_layer, r.confidence FROM nodes c
JOIN (SELECT industry_id, id, source, target, 'l1_l2_flow_projection' AS relation_layer, confidence FROM projected
      UNION ALL SELECT industry_id, id, source, target, relation_layer, confidence FROM l2_edges) r
  ON r.industry_id = c.industry_id AND (r.source = c.id OR r.target = c.id)
WHERE c.level = 2 OR (c.level = 1 AND r.relation_layer = 'l1_l2_flow_projection')""", ("nodes", "l2_edges"), _PROJ)
def _(g):
    from linkstrata.operators.flow import project_flows

    projected = project_flows(g("l2_edges"), g("nodes"), AS_OF)
    return Q.node_flow_relations(g("nodes"), g("l2_edges"), projected, g("nodes").select(KEY, "id"))


@query("j16_unsupported_levels", "SELECT industry_id, id, 'level_not_supported' AS error FROM nodes WHERE level NOT IN (1, 2)", ("nodes",))
def _(g):
    return Q.unsupported_centres(g("nodes"), g("nodes").select(KEY, "id"))


_CTX = (
    ("hit", """SELECT *, CASE WHEN level <= 1 THEN 0 ELSE 1 END AS src FROM nodes WHERE level <= 1 OR contains(name, 'ring') OR contains(description, 'ring')"""),
    ("word", "SELECT industry_id, id FROM nodes WHERE contains(name, 'ring') OR contains(description, 'ring')"),
    ("low", "SELECT industry_id, id FROM nodes WHERE level <= 1"),
    ("edge_hit", """SELECT e.*, 0 AS src FROM edges e JOIN low a ON a.industry_id = e.industry_id AND a.id = e.source JOIN low b ON b.industry_id = e.industry_id AND b.id = e.target
UNION ALL SELECT e.*, 1 FROM edges e JOIN word a ON a.industry_id = e.industry_id AND a.id = e.source JOIN word b ON b.industry_id = e.industry_id AND b.id = e.target"""),
    ("edge_one", "SELECT * FROM edge_hit QUALIFY row_number() OVER (PARTITION BY industry_id, id ORDER BY src) = 1"),
)


@query("j21_question_context", """SELECT industry_id, 'node' AS kind, cast(rn AS int) AS rn, '- [' || id || '] ' || name || ' | ' || chain_position || ' | level=' || level || ' | ' || description AS line
FROM (SELECT *, row_number() OVER (PARTITION BY industry_id ORDER BY src, pos, id) AS rn FROM hit) WHERE rn <= 30
UNION ALL SELECT industry_id, 'edge', cast(rn AS int), '- ' || source || ' -[' || relation_type || ']-> ' || target || ': ' || description
FROM (SELECT *, row_number() OVER (PARTITION BY industry_id ORDER BY src, pos, id) AS rn FROM edge_one) WHERE rn <= 40""", G, _CTX)
def _(g):
    return Q.question_context(g("nodes"), g("edges"), " ring ", levels=[0, 1])


@query("j22_industry_listing", """SELECT m.industry_id, m.name, CASE WHEN m.status = 'pending' THEN 'ready' ELSE m.status END AS status,
(SELECT count(*) FROM nodes n WHERE n.industry_id = m.industry_id) AS node_count, (SELECT count(*) FROM edges e WHERE e.industry_id = m.industry_id) AS edge_count
FROM manifest m""", ("nodes", "edges", "manifest"))
def _(g):
    return Q.list_industries(g("manifest"), g("nodes"), g("edges"))


@query("j22_industry_overlay", """SELECT coalesce(m.industry_id, s.industry_id) AS industry_id, coalesce(s.name, m.name) AS name, coalesce(s.status, m.status) AS status,
coalesce(s.n, m.node_count, 0) AS node_count, coalesce(s.n * 2, m.edge_count, 0) AS edge_count
FROM manifest m FULL JOIN (SELECT CASE WHEN industry_id LIKE 'p%' THEN industry_id || '_db' ELSE industry_id END AS industry_id, 'db ' || industry_id AS name, 'demo' AS status, count(*) AS n
      FROM nodes WHERE industry_id < 'm' OR industry_id LIKE 'p%' GROUP BY ALL) s ON s.industry_id = m.industry_id""", ("nodes", "manifest"))
def _(g):
    stored = g("nodes").filter("industry_id < 'm' OR industry_id LIKE 'p%'").groupBy(KEY).agg(F.count("*").alias("node_count")).select(
        F.when(F.col(KEY).like("p%"), F.concat(KEY, F.lit("_db"))).otherwise(F.col(KEY)).alias("_id"), F.concat(F.lit("db "), KEY).alias("name"),
        F.lit("demo").alias("status"), "node_count", (F.col("node_count") * 2).alias("edge_count"),
    ).withColumnRenamed("_id", KEY)
    return Q.overlay_industries(g("manifest"), stored)


@query("a12_visible_levels", """SELECT industry_id, string_agg(DISTINCT cast(level AS string), ';' ORDER BY cast(level AS string)) AS levels, max(level) AS max_level, count(*) AS node_count
FROM nodes GROUP BY ALL""", ("nodes",))
def _(g):
    return joined(Q.visible_levels(g("nodes")), "levels")


# --- companies at nodes -----------------------------------------------------------------
_ROLL = H + (
    ("roll", """SELECT h.industry_id, h.ancestor AS node_id, a.company_id, count(DISTINCT a.node_id) AS direct_node_count, min(h.dist) = 0 AS is_direct
FROM attachments a JOIN h ON h.industry_id = a.industry_id AND h.id = a.node_id JOIN companies c ON c.company_id = a.company_id GROUP BY ALL"""),
)
GA = ("nodes", "edges", "attachments", "companies")


def rollup(g):
    return Q.company_rollup(g("attachments"), g("companies"), HI.closure(g("agg_paths"), g("nodes")))


@query("j15_company_rollup", "SELECT * FROM roll", GA, _ROLL)
def _(g):
    return rollup(g)


@query("j15_company_rollup_direct", """SELECT a.industry_id, a.node_id, a.company_id, count(DISTINCT a.node_id) AS direct_node_count, true AS is_direct
FROM attachments a JOIN companies c ON c.company_id = a.company_id GROUP BY ALL""", ("attachments", "companies"))
def _(g):
    return Q.company_rollup(g("attachments"), g("companies"), HI.closure(g("agg_paths"), g("nodes")), include_descendants=False)


@query("j15_company_details", """SELECT a.industry_id, h.ancestor AS node_id, a.company_id, c.comcode, c.name AS company_name, a.node_id AS direct_node_id, n.name AS direct_node_name, a.reason, a.confidence
FROM attachments a JOIN h ON h.industry_id = a.industry_id AND h.id = a.node_id JOIN companies c ON c.company_id = a.company_id
JOIN nodes n ON n.industry_id = a.industry_id AND n.id = a.node_id""", GA, H)
def _(g):
    return Q.company_rollup_details(g("attachments"), g("companies"), g("nodes"), HI.closure(g("agg_paths"), g("nodes")))


@query("j15_companies_per_node", "SELECT industry_id, node_id, count(*) AS company_count, count(*) FILTER (WHERE is_direct) AS direct_company_count FROM roll GROUP BY ALL", GA, _ROLL)
def _(g):
    return rollup(g).groupBy(KEY, "node_id").agg(F.count("*").alias("company_count"), F.count_if("is_direct").alias("direct_company_count"))


@query("j18_multi_node_companies", """SELECT r.industry_id, r.company_id, count(*) AS node_count, CASE WHEN bool_or(r.is_direct) THEN 'direct' ELSE 'rolled_up' END AS link_type
FROM roll r JOIN nodes n ON n.industry_id = r.industry_id AND n.id = r.node_id WHERE n.chain_position = 'upstream' AND n.level >= 2 GROUP BY ALL""", GA, _ROLL)
def _(g):
    return Q.multi_node_companies(rollup(g), g("nodes").filter("chain_position = 'upstream' AND level >= 2"))


@query("j18_node_company_links", """SELECT r.industry_id, r.node_id, r.company_id, CASE WHEN r.is_direct THEN 'direct' ELSE 'rolled_up' END AS link_type
FROM roll r JOIN nodes n ON n.industry_id = r.industry_id AND n.id = r.node_id WHERE n.level = 2""", GA, _ROLL)
def _(g):
    return Q.node_company_links(rollup(g), g("nodes").filter("level = 2"))


@query("t01_company_page", """SELECT r.industry_id, r.node_id, r.rn AS rank, r.company_id, r.company_name, r.direct_node_count, r.is_direct, r.total FROM (
SELECT r.*, c.name AS company_name, row_number() OVER (PARTITION BY r.industry_id, r.node_id ORDER BY c.name, c.comcode) AS rn,
count(*) OVER (PARTITION BY r.industry_id, r.node_id) AS total FROM roll r JOIN companies c ON c.company_id = r.company_id) r WHERE rn > 10 AND rn <= 30""", GA, _ROLL)
def _(g):
    return Q.company_page(rollup(g), g("companies"), limit=20, offset=10)


@query("t02_company_order", """SELECT r.industry_id, r.node_id, r.company_id, row_number() OVER (PARTITION BY r.industry_id, r.node_id ORDER BY c.name, c.comcode) AS rank
FROM roll r JOIN companies c ON c.company_id = r.company_id""", GA, _ROLL)
def _(g):
    return Q.company_ranks(rollup(g), g("companies")).select(KEY, "node_id", "company_id", "rank")


@query("t02_company_order_locale", """SELECT r.industry_id, r.node_id, r.rn AS rank, r.company_id FROM (
SELECT r.*, row_number() OVER (PARTITION BY r.industry_id, r.node_id ORDER BY c.name, c.comcode) AS rn FROM roll r JOIN companies c ON c.company_id = r.company_id) r WHERE rn <= 10""", GA, _ROLL)
def _(g):
    return Q.company_page(rollup(g), g("companies"), limit=10, locale="zh").select(KEY, "node_id", "rank", "company_id")


@query("t03_recent_sources", """SELECT industry_id, url, rn FROM (SELECT industry_id, url, cast(row_number() OVER (PARTITION BY industry_id ORDER BY pos DESC, url) AS int) AS rn
FROM (SELECT industry_id, pos, unnest(string_split(source_urls, ';')) AS url FROM nodes WHERE source_urls <> '')) WHERE rn <= 20""", ("nodes",))
def _(g):
    from linkstrata.operators.merge import recent_sources

    return recent_sources(g("nodes").select(KEY, "pos", F.explode("source_urls").alias("url"))).select(KEY, "url", "rn")


@query("t04_stable_edge_order", """SELECT industry_id, id, row_number() OVER (PARTITION BY industry_id ORDER BY source, target, id) AS rank FROM edges""", ("edges",))
def _(g):
    from linkstrata.functions.tables import numbered

    return numbered(g("edges").select(KEY, "id", "source", "target"), [KEY], ["source", "target", "id"], "rank").select(KEY, "id", "rank")


@query("p24_compact_nodes", """SELECT n.industry_id, n.id, n.name, n.level, n.chain_position, l.path, coalesce(nullif(n.business_description, ''), nullif(n.description, ''), '') AS description
FROM nodes n JOIN line l ON l.industry_id = n.industry_id AND l.id = n.id""", ("nodes",), LINE)
def _(g):
    return Q.compact_nodes(g("nodes"), g("lines"))


@query("w06_company_batches", """SELECT industry_id, company_id, cast(floor((row_number() OVER (PARTITION BY industry_id ORDER BY company_id) - 1) / 10) + 1 AS bigint) AS batch_index
FROM (SELECT DISTINCT industry_id, company_id FROM attachments)""", ("attachments",))
def _(g):
    return Q.batches(g("attachments").select(KEY, "company_id").distinct(), [KEY], ["company_id"], 10)


@query("f16_branch_limit", "SELECT industry_id, id FROM (SELECT *, row_number() OVER (PARTITION BY industry_id ORDER BY pos, id) AS rn FROM nodes WHERE level = 1) WHERE rn <= 4", ("nodes",))
def _(g):
    return Q.limit_branches(g("nodes").filter("level = 1"), 4).select(KEY, "id")


@query("f04_listed_companies_at_nodes", """SELECT DISTINCT a.industry_id, a.company_id FROM attachments a JOIN companies c ON c.company_id = a.company_id WHERE c.is_listed""", ("attachments", "companies"))
def _(g):
    from linkstrata.operators.companies import listed_companies

    return listed_companies(payload_companies(g("attachments"), g("companies"))).select(KEY, "company_id")
