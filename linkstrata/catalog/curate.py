"""Queries that merge, check, repair and publish graphs."""

from pyspark.sql import functions as F

from linkstrata.catalog.company import SINGLE, alive_nodes
from linkstrata.catalog.graph import G
from linkstrata.catalog.registry import AS_OF, KEY, LINE, joined, query
from linkstrata.catalog.standard import RAW, STD, standardized
from linkstrata.functions import text as X
from linkstrata.operators import merge as M
from linkstrata.operators import publish as P
from linkstrata.operators import validate as V
from linkstrata.plans import curation as CU

URLS = "(SELECT coalesce(string_agg(DISTINCT u, ';' ORDER BY u), '') FROM unnest(string_split({}, ';')) x(u) WHERE u <> '')"


# --- staged merge ----------------------------------------------------------------------------
@query("a03_merge_staged_nodes", f"""SELECT f.industry_id, f.id, f.name, f.level, f.parent_id, m.confidence, CASE WHEN m.n > 1 THEN {URLS.format('m.urls')} ELSE f.source_urls END AS source_urls
FROM (SELECT * FROM staged_nodes QUALIFY row_number() OVER (PARTITION BY industry_id, id ORDER BY graph_no, pos) = 1) f
JOIN (SELECT industry_id, id, max(confidence) AS confidence, count(*) AS n, string_agg(source_urls, ';') AS urls FROM staged_nodes GROUP BY ALL) m ON m.industry_id = f.industry_id AND m.id = f.id""", ("staged_nodes",))
def _(g):
    return joined(M.merge_nodes(g("staged_nodes")).select(KEY, "id", "name", "level", "parent_id", "confidence", "source_urls"), "source_urls")


def _staged_edges(g):
    return g("staged_nodes").filter("parent_id <> ''").select(
        KEY, "graph_no", "pos", F.col("parent_id").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("relation_type"), "source_urls", "evidence_ids", "confidence")


@query("a03_merge_staged_edges", """SELECT industry_id, parent_id AS source, id AS target, 'contains' AS relation_type, max(confidence) AS confidence FROM staged_nodes WHERE parent_id <> '' GROUP BY ALL""", ("staged_nodes",))
def _(g):
    return M.merge_edges(_staged_edges(g)).select(KEY, "source", "target", "relation_type", "confidence")


@query("a03_node_conflicts", """SELECT industry_id, id, min(name) AS name, max(name) AS other_name, count(*) AS copies FROM staged_nodes GROUP BY industry_id, id HAVING count(DISTINCT name) > 1""", ("staged_nodes",))
def _(g):
    return M.node_conflicts(g("staged_nodes"))


# seed and branch graphs without attributes of edges, each with sources of its own; in some industries a branch renames its L1 node
def _staged(g):
    c = F.col
    nodes = g("staged_nodes").withColumn("name", F.when(c(KEY).like("pro%"), c("name")).otherwise(F.replace("name", F.lit(" (renamed)"), F.lit(""))))
    nodes = nodes.withColumn("business_description", F.lit("")).select("*", *[F.lit(None).cast(t).alias(n) for n, t in (
        ("node_type", "string"), ("tags", "array<string>"), ("industry", "string"), ("is_key_node", "boolean"), ("chain_segment", "string"), ("updated_at", "string"))])
    links = nodes.filter("parent_id <> ''").select(KEY, "graph_no", "pos", c("parent_id").alias("source"), c("id").alias("target"), F.lit("contains").alias("relation_type"), *[
        F.lit(None).cast(t).alias(n) for n, t in (("id", "string"), ("relation_weight", "double"), ("description", "string"), ("source_urls", "array<string>"), ("evidence_ids", "array<string>"),
                                                  ("confidence", "double"), ("updated_at", "string"))])
    seeds = g("graphs").withColumn("graph_no", F.lit(0))
    own = lambda tail, name: F.struct(F.lit(name).alias("name"), F.concat(F.lit("https://basis.example.org/"), KEY, tail).alias("url"), F.lit("branch").alias("note"))
    heads = nodes.filter("graph_no > 0").select(KEY, "graph_no").distinct().join(g("graphs").drop("source_basis"), KEY).withColumn(
        "source_basis", F.array(own(F.concat(F.lit("/branch"), c("graph_no").cast("string")), "Branch"), own(F.lit("/a"), "Report A of a branch")))
    return seeds.unionByName(heads.select(*seeds.columns)), nodes, links


def _merged(g, name):
    """One table of the merge, which runs once in a session; only tables that are asked for are written."""
    return g.remember(f"staged_{name}_out", lambda: getattr(g.once("staged_merge", lambda: CU.merge_staged(*_staged(g), AS_OF)), name))


_URL_LIST = "list_sort(list_distinct(list_filter(string_split({}, ';'), lambda u: u <> '')))"
_STAGED = SINGLE[:2] + (
    ("own", """SELECT s.*, CASE WHEN source_urls = '' AND graph_no = 0 THEN 'https://basis.example.org/' || industry_id || '/a;https://basis.example.org/' || industry_id || '/b'
WHEN source_urls = '' THEN 'https://basis.example.org/' || industry_id || '/branch' || graph_no || ';https://basis.example.org/' || industry_id || '/a' ELSE source_urls END AS urls,
CASE WHEN evidence_ids = '' THEN 'source_001;source_002' ELSE evidence_ids END AS evids,
'https://basis.example.org/' || industry_id || CASE WHEN graph_no = 0 THEN '/b' ELSE '/branch' || graph_no END || ';https://basis.example.org/' || industry_id || '/a' AS basis
FROM staged_nodes s WHERE industry_id NOT LIKE 'pro%' AND NOT EXISTS (SELECT 1 FROM single x WHERE x.industry_id = s.industry_id AND x.child_id = s.id)"""),
    ("tops", """SELECT industry_id, id, arg_min(replace(name, ' (renamed)', ''), graph_no) AS name, any_value(level) AS level, arg_min(CASE WHEN level = 1 AND chain_position IN ('upstream', 'downstream') THEN '' ELSE parent_id END, graph_no) AS parent_id,
max(confidence) AS confidence, CASE WHEN count(*) > 1 THEN array_to_string(list_sort(list_distinct(string_split(string_agg(urls, ';'), ';'))), ';') ELSE any_value(urls) END AS source_urls,
CASE WHEN count(*) > 1 THEN array_to_string(list_sort(list_distinct(string_split(string_agg(evids, ';'), ';'))), ';') ELSE any_value(evids) END AS evidence_ids FROM own GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY industry_id, id")),
    ("kin", "SELECT industry_id, parent_id, count(*) AS n, max(id) AS id, max(level) AS level FROM tops WHERE parent_id <> '' GROUP BY ALL"),
    ("lone", """SELECT k.industry_id, k.id FROM kin k JOIN tops p ON p.industry_id = k.industry_id AND p.id = k.parent_id WHERE k.n = 1 AND p.level <> 0 AND k.level >= 2
AND NOT EXISTS (SELECT 1 FROM kin c WHERE c.industry_id = k.industry_id AND c.parent_id = k.id)"""),
    ("outn", "SELECT * FROM tops t ANTI JOIN lone l ON l.industry_id = t.industry_id AND l.id = t.id"),
    ("oute", """SELECT c.industry_id, CASE WHEN c.level = 1 AND c.chain_position = 'upstream' THEN c.id ELSE p.id END AS source, CASE WHEN c.level = 1 AND c.chain_position = 'upstream' THEN p.id ELSE c.id END AS target,
CASE WHEN c.level = 1 AND c.chain_position IN ('upstream', 'downstream') THEN 'upstream_downstream' ELSE 'contains' END AS relation_type, """
     + _URL_LIST.format("c.urls || ';' || p.urls || ';' || c.basis") + """ AS urls FROM own c JOIN own p ON p.industry_id = c.industry_id AND p.graph_no = c.graph_no
AND p.id = CASE WHEN c.level = 1 THEN c.industry_id || '_000' ELSE c.parent_id END JOIN outn o ON o.industry_id = c.industry_id AND o.id = c.id WHERE c.level > 0"""),
)
TS = G + ("staged_nodes", "graphs")


@query("m19_merged_nodes", "SELECT industry_id, id, name, level, parent_id, confidence, source_urls, evidence_ids FROM outn", TS, _STAGED)
def _(g):
    return joined(_merged(g, "nodes").select(KEY, "id", "name", "level", "parent_id", "confidence", "source_urls", "evidence_ids"), "source_urls", "evidence_ids")


@query("m19_merged_edges", """SELECT industry_id, source || '__' || relation_type || '__' || target AS id, source, target, relation_type, cast(1 AS double) AS relation_weight, cast(0.75 AS double) AS confidence,
array_to_string(urls, ';') AS source_urls, len(urls) AS evidence_count FROM oute""", TS, _STAGED)
def _(g):
    e = _merged(g, "edges").withColumn("evidence_count", F.size("evidence_ids").cast("bigint"))
    return joined(e.select(KEY, "id", "source", "target", "relation_type", "relation_weight", "confidence", "source_urls", "evidence_count"), "source_urls")


@query("m19_source_basis", """SELECT industry_id, 0 AS place, 'Report A' AS name, 'https://basis.example.org/' || industry_id || '/a' AS url FROM graphs WHERE industry_id NOT LIKE 'pro%'
UNION ALL SELECT industry_id, 1, 'Report B', 'https://basis.example.org/' || industry_id || '/b' FROM graphs WHERE industry_id NOT LIKE 'pro%' UNION ALL SELECT industry_id, 2, 'No link', '' FROM graphs WHERE industry_id NOT LIKE 'pro%'
UNION ALL SELECT industry_id, 2 + row_number() OVER (PARTITION BY industry_id ORDER BY graph_no), 'Branch', 'https://basis.example.org/' || industry_id || '/branch' || graph_no FROM (SELECT DISTINCT industry_id, graph_no FROM staged_nodes WHERE graph_no > 0 AND industry_id NOT LIKE 'pro%')""", TS)
def _(g):
    return _merged(g, "graphs").select(KEY, F.posexplode("source_basis").alias("place", "b")).select(KEY, F.col("place").cast("bigint").alias("place"), "b.name", "b.url")


@query("m19_conflicts", "SELECT industry_id, id, min(name) AS name, max(name) AS other_name, count(*) AS copies FROM staged_nodes WHERE industry_id LIKE 'pro%' GROUP BY industry_id, id HAVING count(DISTINCT name) > 1", TS)
def _(g):
    return _merged(g, "conflicts")


def _basis(g):
    return g("graphs").select(KEY, F.posexplode("source_basis").alias("pos", "b")).select(KEY, "pos", "b.*")


@query("u07_source_basis_merge", """SELECT industry_id, 'Report A' AS name, 'https://basis.example.org/' || industry_id || '/a' AS url FROM graphs
UNION ALL SELECT industry_id, 'Report B', 'https://basis.example.org/' || industry_id || '/b' FROM graphs UNION ALL SELECT industry_id, 'No link', '' FROM graphs""", ("graphs",))
def _(g):
    first = _basis(g).withColumn("graph_no", F.lit(0))
    again = first.withColumn("graph_no", F.lit(1)).withColumn("note", F.lit("later"))
    return M.merge_source_basis(first.unionByName(again)).select(KEY, "name", "url")


_BR = ("br", "SELECT n.*, l.branch_id FROM nodes n JOIN line l ON l.industry_id = n.industry_id AND l.id = n.id WHERE n.level >= 1")
_NS = ("ns", """SELECT *, CASE WHEN level >= 2 THEN branch_id || '_' || CASE WHEN rn < 1000 THEN lpad(cast(rn AS varchar), 3, '0') ELSE cast(rn AS varchar) END ELSE id END AS new_id
FROM (SELECT *, row_number() OVER (PARTITION BY industry_id, branch_id, level >= 2 ORDER BY pos, id) AS rn FROM br)""")


def _branch_nodes(g):
    return g("nodes").filter("level >= 1").join(g("lines").select(KEY, "id", "branch_id"), [KEY, "id"]).select(*g("nodes").columns, "branch_id")


_BR_BY_ID = ("br", "SELECT *, industry_id || '_' || split_part(substr(id, length(industry_id) + 2), '_', 1) AS branch_id FROM nodes WHERE level >= 1")


@query("w05_branch_namespacing", """SELECT a.industry_id, a.branch_id, a.new_id AS id, coalesce(p.new_id, a.parent_id) AS parent_id, a.name
FROM ns a LEFT JOIN ns p ON p.industry_id = a.industry_id AND p.branch_id = a.branch_id AND p.id = a.parent_id""", ("nodes",), (_BR_BY_ID, _NS))
def _(g):
    loose = _branch_nodes(g).withColumn("id", F.concat(F.lit(" "), "id"))
    edges = g("edges").withColumn("branch_id", F.col("source"))
    nodes, _, _ = M.namespace_branches(loose, edges)
    return nodes.select(KEY, "branch_id", "id", "parent_id", "name")


@query("j23_branch_membership", """SELECT industry_id, branch_id, 'node_outside_branch' AS error, id AS item_id FROM (SELECT *, CASE WHEN level >= 2 AND confidence < 0.45 THEN industry_id || '_003' ELSE branch_id END AS b FROM br) WHERE level >= 2 AND b <> branch_id
UNION ALL SELECT industry_id, b, 'too_few_nodes', cast(count(*) FILTER (WHERE level >= 2) AS varchar) FROM (SELECT *, CASE WHEN level >= 2 AND confidence < 0.45 THEN industry_id || '_003' ELSE branch_id END AS b FROM br) GROUP BY industry_id, b HAVING count(*) FILTER (WHERE level >= 2) < 60"""
       .replace("SELECT industry_id, branch_id, 'node_outside", "SELECT industry_id, b AS branch_id, 'node_outside"), ("nodes",), LINE + (_BR,))
def _(g):
    placed = _branch_nodes(g).withColumn("branch_id", F.when((F.col("level") >= 2) & (F.col("confidence") < 0.45), F.concat(KEY, F.lit("_003"))).otherwise(F.col("branch_id")))
    return M.branch_membership(placed, g("tree_paths"), min_new=60)


@query("a05_position_coverage", """SELECT industry_id, count(*) FILTER (WHERE chain_position = 'upstream') AS upstream, count(*) FILTER (WHERE chain_position = 'midstream') AS midstream,
count(*) FILTER (WHERE chain_position = 'downstream' AND NOT industry_id LIKE 'eco%') AS downstream, count(*) FILTER (WHERE chain_position = 'support') AS support,
CASE WHEN count(*) FILTER (WHERE chain_position = 'downstream' AND NOT industry_id LIKE 'eco%') = 0 THEN 'downstream' ELSE '' END AS missing_positions FROM nodes WHERE level = 1 GROUP BY industry_id""", ("nodes",))
def _(g):
    drop = F.col(KEY).like("eco%") & (F.col("chain_position") == "downstream")
    return M.position_coverage(g("nodes").filter("level = 1").withColumn("chain_position", F.when(drop, "other").otherwise(F.concat(F.lit(" "), F.initcap("chain_position")))))


@query("f11_failed_branches", """SELECT r.industry_id, r.branch_id, r.status, r.has_graph, CASE WHEN n.id IS NULL THEN 'unknown_branch' ELSE 'retry' END AS action FROM work_records r
LEFT JOIN nodes n ON n.industry_id = r.industry_id AND n.id = r.branch_id WHERE r.status <> 'ok' OR NOT r.has_graph""", ("nodes", "work_records"))
def _(g):
    return M.failed_branches(g("work_records"), g("nodes")).select(KEY, "branch_id", "status", "has_graph", "action")


@query("f09_quality_gate", "SELECT industry_id, stage, branch_id, status = 'pass' AND try_cast(score AS int) >= 80 AND focus = '' AS passed FROM opinion_records", ("opinion_records",))
def _(g):
    c = F.col
    return g("opinion_records").select(KEY, "stage", "branch_id", X.quality_passed(c("status"), c("score"), c("blocking"), c("focus")).alias("passed"))


@query("m22_branch_assembly", """SELECT m.industry_id, m.industry_id NOT LIKE 'sta%' AS skeleton_passed, r.n AS branch_count, r.bad AS failed_count, r.lost AS lost_count, m.industry_id NOT LIKE 'sta%' AND r.bad = 0 AS candidate_allowed FROM manifest m
JOIN (SELECT b.industry_id, count(*) AS n, count(*) FILTER (WHERE status <> 'ok' OR NOT has_graph OR n.id IS NULL) AS bad, count(*) FILTER (WHERE n.id IS NULL) AS lost FROM branch_records b
LEFT JOIN nodes n ON n.industry_id = b.industry_id AND n.id = b.branch_id AND n.level = 1 GROUP BY ALL) r ON r.industry_id = m.industry_id""", ("manifest", "branch_records", "nodes"))
def _(g):
    passed = g("manifest").select(KEY, (~F.col(KEY).like("sta%")).alias("skeleton_passed"))
    return M.branch_assembly(g("branch_records"), passed, g("nodes"))


@query("p26_quality_opinions", """SELECT industry_id, stage, branch_id, branch_name, CASE WHEN revised THEN 'auto_revised' ELSE coalesce(nullif(status, ''), 'unknown') END AS status, coalesce(nullif(status, ''), 'unknown') AS initial_status,
CASE WHEN NOT revised THEN 'not_revised' WHEN post_status IS NULL THEN 'auto_revised_not_rechecked' WHEN lower(post_status) = 'pass' AND try_cast(post_score AS int) >= 80 THEN 'rechecked_pass' ELSE 'rechecked_needs_review' END AS revision_status,
score, score AS initial_score, CASE WHEN revised AND post_status IS NOT NULL THEN post_score END AS final_score, revised FROM opinion_records""", ("opinion_records",))
def _(g):
    return M.quality_opinions(g("opinion_records"))


# --- evidence -----------------------------------------------------------------------------------
_EVID = (
    ("items", """SELECT industry_id, 0 AS kind, cast(i AS bigint) AS pos, '' AS item, 0 AS upos, u AS url, t AS title, s AS snippet FROM (SELECT industry_id, unnest([0, 1, 2]) AS i,
  'https://basis.example.org/' || industry_id || (CASE i WHEN 1 THEN '/b' ELSE '/a' END) AS u, CASE i WHEN 0 THEN 'Report A' WHEN 1 THEN 'Report B' ELSE 'Report A2' END AS t, CASE i WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'again' END AS s FROM graphs)
UNION ALL SELECT industry_id, 1, pos, id, unnest(range(len(string_split(source_urls, ';')))), unnest(string_split(source_urls, ';')), '', description FROM nodes WHERE source_urls <> ''
UNION ALL SELECT industry_id, 2, pos, id, unnest(range(len(string_split(source_urls, ';')))), unnest(string_split(source_urls, ';')), '', description FROM edges WHERE source_urls <> ''"""),
    ("firsts", "SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY industry_id, url ORDER BY kind, pos, item, upos) = 1"),
    ("texts", "SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY industry_id, url ORDER BY kind, CASE WHEN kind = 0 THEN -pos ELSE pos END, item, upos) = 1"),
    ("evid", """SELECT f.industry_id, f.url, t.title, t.snippet, row_number() OVER (PARTITION BY f.industry_id ORDER BY f.kind, f.pos, f.item, f.upos) AS rn FROM firsts f JOIN texts t ON t.industry_id = f.industry_id AND t.url = f.url"""),
)


@query("a13_evidence_table", """SELECT industry_id, industry_id || '_ev_' || CASE WHEN rn < 10000 THEN lpad(cast(rn AS varchar), 4, '0') ELSE cast(rn AS varchar) END AS evidence_id, url, title, sha256(url || snippet) AS content_hash, snippet FROM evid""", G + ("graphs",), _EVID)
def _(g):
    return M.evidence_table(_basis(g), g("nodes"), g("edges"), AS_OF).select(KEY, "evidence_id", "url", "title", "content_hash", "snippet")


_SHARE = ("share", "SELECT DISTINCT industry_id, unnest(string_split(source_urls, ';')) AS url FROM nodes WHERE level <= 1 AND source_urls <> ''")


@query("m09_shared_evidence", f"""SELECT n.industry_id, n.id, (SELECT coalesce(string_agg(DISTINCT u, ';' ORDER BY u), '') FROM unnest(string_split(n.source_urls, ';')) x(u)
WHERE u <> '' AND NOT EXISTS (SELECT 1 FROM share s WHERE s.industry_id = n.industry_id AND s.url = u)) AS own_urls,
(SELECT count(*) FROM (SELECT url FROM share s WHERE s.industry_id = n.industry_id UNION SELECT u FROM unnest(string_split(n.source_urls, ';')) x(u) WHERE u <> '')) AS url_count FROM nodes n""", ("nodes",), (_SHARE,))
def _(g):
    shared = g("nodes").filter("level <= 1").select(KEY, F.explode("source_urls").alias("url"))
    return joined(M.item_evidence_urls(g("nodes"), shared), "own_urls")


# merge with evidence: the shared part are the urls of L0 and L1, with ids of their own
_CAND = SINGLE[:2] + (
    ("stdn", """SELECT industry_id, id, level, CASE WHEN source_urls = '' THEN 'https://basis.example.org/' || industry_id || '/a;https://basis.example.org/' || industry_id || '/b' ELSE source_urls END AS urls,
CASE WHEN evidence_ids = '' THEN 'source_001;source_002' ELSE evidence_ids END AS ids FROM formal_nodes n WHERE NOT EXISTS (SELECT 1 FROM single s WHERE s.industry_id = n.industry_id AND s.child_id = n.id)"""),
    ("share", "SELECT DISTINCT industry_id, unnest(string_split(source_urls, ';')) AS url FROM nodes WHERE level <= 1 AND industry_id NOT LIKE 'med%'"),
    ("vals", """SELECT DISTINCT industry_id, id, 'url' AS kind, unnest(string_split(urls, ';')) AS v FROM stdn UNION SELECT DISTINCT industry_id, id, 'evidence_id', unnest(string_split(ids, ';')) FROM stdn"""),
    ("shared", "SELECT industry_id, 'url' AS kind, url AS v FROM share UNION ALL SELECT industry_id, 'evidence_id', 'ev:' || url FROM share"),
    ("beyond", "SELECT * FROM vals x ANTI JOIN shared s ON s.industry_id = x.industry_id AND s.kind = x.kind AND s.v = x.v"),
)
TC = G + ("formal_nodes", "formal_edges", "graphs")


def _candidate(g):
    def evidence():
        share = g("nodes").filter("level <= 1").select(KEY, F.explode("source_urls").alias("url")).distinct()
        dead = F.col(KEY).like("med%")
        return share.select(KEY, F.when(~dead, F.col("url")).alias("url"), F.concat(F.lit("ev:"), "url").alias("evidence_id"))

    names = ("cand_nodes", "cand_edges", "cand_node_evidence", "cand_edge_evidence")
    if names[0] not in g._known:
        r = CU.merge_candidate(g("graphs"), g("formal_nodes"), g("formal_edges"), evidence(), AS_OF)
        for name, df in zip(names, (r.nodes, r.edges, r.node_evidence, r.edge_evidence)):
            g.remember(name, lambda df=df: df)
    return [g(n) for n in names], evidence()


_OWN = "(SELECT coalesce(string_agg(v, ';' ORDER BY v), '') FROM beyond b WHERE b.industry_id = n.industry_id AND b.id = n.id AND b.kind = '{0}') AS {1}"
_SIZE = "(SELECT count(*) FROM beyond b WHERE b.industry_id = n.industry_id AND b.id = n.id AND b.kind = '{0}') + (SELECT count(*) FROM shared s WHERE s.industry_id = n.industry_id AND s.kind = '{0}') AS {1}"


@query("m09_node_evidence", f"SELECT n.industry_id, n.id, {_OWN.format('url', 'own_urls')}, {_SIZE.format('url', 'url_count')}, {_OWN.format('evidence_id', 'own_ids')}, {_SIZE.format('evidence_id', 'id_count')} FROM stdn n", TC, _CAND)
def _(g):
    return joined(_candidate(g)[0][2], "own_urls", "own_ids")


_EDGE_CAND = _CAND[:4] + (
    ("stde", """SELECT e.industry_id, e.id, CASE WHEN e.source_urls = '' THEN list_distinct(string_split(c.urls || ';' || p.urls || ';https://basis.example.org/' || e.industry_id || '/a;https://basis.example.org/' || e.industry_id || '/b', ';'))
ELSE string_split(e.source_urls, ';') END AS urls, e.evidence_ids AS ids FROM formal_edges e JOIN stdn c ON c.industry_id = e.industry_id AND c.id = e.target JOIN stdn p ON p.industry_id = e.industry_id AND p.id = e.source"""),
    ("evals", """SELECT DISTINCT industry_id, id, 'url' AS kind, unnest(urls) AS v FROM stde UNION SELECT DISTINCT industry_id, id, 'evidence_id',
unnest(CASE WHEN ids = '' THEN list_transform(range(1, len(urls) + 1), lambda i: 'source_' || lpad(cast(i AS varchar), 3, '0')) ELSE string_split(ids, ';') END) FROM stde"""),
    ("shared", _CAND[5][1]),
    ("beyond", _CAND[6][1].replace("vals x", "evals x")),
)


@query("m09_edge_evidence", f"SELECT n.industry_id, n.id, {_OWN.format('url', 'own_urls')}, {_SIZE.format('url', 'url_count')}, {_OWN.format('evidence_id', 'own_ids')}, {_SIZE.format('evidence_id', 'id_count')} FROM stde n", TC, _EDGE_CAND)
def _(g):
    return joined(_candidate(g)[0][3], "own_urls", "own_ids")


@query("m09_expanded_roots", """SELECT n.industry_id, n.id, x.kind, x.v AS value FROM stdn n JOIN vals x ON x.industry_id = n.industry_id AND x.id = n.id WHERE n.level <= 1
UNION SELECT n.industry_id, n.id, s.kind, s.v FROM stdn n JOIN shared s ON s.industry_id = n.industry_id WHERE n.level <= 1""", TC, _CAND)
def _(g):
    (nodes, *_), evidence = _candidate(g)
    return M.expand_evidence(nodes.filter("level <= 1"), evidence)


_DUP = ("dup", """SELECT industry_id, keep, id AS dropped, name FROM (SELECT industry_id, id, name, first_value(id) OVER w AS keep, row_number() OVER w AS rn FROM raw_nodes
WINDOW w AS (PARTITION BY industry_id, regexp_replace(lower(name), '\\s+', '', 'g') ORDER BY pos, id)) WHERE rn > 1""")


@query("m09_duplicate_names", 'SELECT industry_id, keep, dropped AS "drop", name FROM dup', ("raw_nodes",), (_DUP,))
def _(g):
    return M.duplicate_name_report(g("raw_nodes"))


_CON = ("con", "SELECT *, first_value(relation_type) OVER (PARTITION BY industry_id, source, target ORDER BY pos) AS kept_type FROM raw_edges")


@query("m09_relation_conflicts", "SELECT industry_id, source, target, kept_type, relation_type AS dropped_type FROM con WHERE relation_type <> kept_type", ("raw_edges",), (_CON,))
def _(g):
    return M.relation_conflicts(g("raw_edges"))[1]


@query("u06_checked_sources", """SELECT 'i' || page_id % 4 AS industry_id, url, 'existing' AS origin FROM pages UNION ALL SELECT 'i' || page_id % 4, url || '?new', 'checked' FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT 'i' || page_id % 4, url, 'checked' FROM pages WHERE page_id % 3 = 1""")
def _(g):
    c = F.col
    key = F.concat(F.lit("i"), c("page_id") % 4).alias(KEY)
    old = g("pages").select(key, c("page_id").alias("pos"), F.concat(c("page_id"), F.lit(":"), "url").alias("content_hash"), "url")
    kind = c("pos") % 3
    # every third source has a new url, every third a new hash, the rest are known already
    new = old.withColumn("url", F.when(kind == 0, F.concat("url", F.lit("?new"))).otherwise(c("url"))).withColumn(
        "content_hash", F.when(kind == 1, F.concat(F.lit("n:"), "pos")).otherwise(c("content_hash")))
    twice = new.unionByName(new.withColumn("pos", c("pos") + 1_000_000))
    return M.merge_checked_sources(old, twice).select(KEY, "url", "origin")


# --- updates --------------------------------------------------------------------------------------
ET = ("nodes", "edges", "event_targets")


def _updates(g):
    c = F.col
    e = g("event_targets")

    def of(kind):
        return e.filter(c("event_type") == kind)

    added = of("view").select(
        KEY, c("event_id").alias("pos"), F.when(c("value") < 10, c("node_id")).otherwise(F.concat("parent_id", F.lit("_9"), "event_id")).alias("id"), F.concat(F.lit("new "), "event_id").alias("name"),
        F.lit(3).alias("level"), "parent_id", F.lit("added").alias("description"))
    links = of("view").select(KEY, c("event_id").alias("pos"), F.lit("").alias("id"), c("parent_id").alias("source"), F.concat("parent_id", F.lit("_9"), "event_id").alias("target"), F.lit("contains").alias("relation_type"))
    node_patch = of("purchase").select(KEY, c("node_id").alias("id"), c("event_id").alias("pos"), F.create_map(
        F.lit("description"), F.concat(F.lit("event "), "event_id"), F.when(c("value") > 20, "confidence").otherwise("updated_at"), F.when(c("value") > 20, "0.25").otherwise("2024-06-01")).alias("patch"))
    edge_patch = of("click").select(KEY, F.lit("").alias("id"), c("parent_id").alias("source"), c("node_id").alias("target"), F.lit("contains").alias("relation_type"), c("event_id").alias("pos"),
                                    F.create_map(F.lit("relation_weight"), F.lit("2.5")).alias("patch"))
    gone = of("signup").select(KEY, c("node_id").alias("id"), F.lit("node").alias("item_type"))
    return added, links, node_patch, edge_patch, gone


@query("m11_update_nodes", """SELECT n.industry_id, n.id, coalesce((SELECT 'event ' || max(event_id) FROM event_targets e WHERE e.event_type = 'purchase' AND e.node_id = n.id), n.description) AS description,
CASE WHEN EXISTS (SELECT 1 FROM event_targets e WHERE e.event_type = 'purchase' AND e.value > 20 AND e.node_id = n.id) THEN 0.25 ELSE n.confidence END AS confidence,
EXISTS (SELECT 1 FROM event_targets e WHERE e.event_type = 'signup' AND e.node_id = n.id) AS deprecated FROM nodes n
UNION ALL SELECT industry_id, parent_id || '_9' || event_id, 'added', NULL, false FROM event_targets WHERE event_type = 'view' AND value >= 10""", ET)
def _(g):
    nodes, _ = M.apply_update(g("nodes"), g("edges"), *_updates(g))
    return nodes.select(KEY, "id", "description", "confidence", "deprecated")


@query("m11_update_edges", """SELECT e.industry_id, e.id, CASE WHEN EXISTS (SELECT 1 FROM event_targets t WHERE t.event_type = 'click' AND t.node_id = e.target AND t.parent_id = e.source) THEN cast(2.5 AS double) ELSE 1.0 END AS relation_weight FROM edges e
UNION ALL SELECT industry_id, parent_id || '__contains__' || parent_id || '_9' || event_id, NULL FROM event_targets WHERE event_type = 'view'""", ET)
def _(g):
    _, edges = M.apply_update(g("nodes"), g("edges"), *_updates(g))
    return edges.select(KEY, "id", "relation_weight")


_ACTION = "CASE event_type WHEN 'view' THEN 'add_node' WHEN 'purchase' THEN 'modify_node' WHEN 'click' THEN 'modify_edge' WHEN 'signup' THEN 'remove_or_deprecate' ELSE 'review_item' END"


@query("a16_proposal_counts", """SELECT industry_id, count(*) FILTER (WHERE event_type = 'view') AS add_node_count, cast(0 AS bigint) AS add_edge_count, count(*) FILTER (WHERE event_type = 'purchase') AS modify_node_count, count(*) FILTER (WHERE event_type = 'click') AS modify_edge_count,
count(*) FILTER (WHERE event_type = 'signup') AS remove_or_deprecate_count, count(*) FILTER (WHERE event_type = 'error') AS review_item_count FROM event_targets GROUP BY ALL""", ("event_targets",))
def _(g):
    return M.proposal_counts(g("event_targets").withColumn("action", F.expr(_ACTION)))


@query("f13_update_gate", """SELECT m.industry_id, CASE WHEN m.industry_id LIKE 'eco%' THEN 'rejected' ELSE 'proposed' END AS proposal_status,
NOT (m.industry_id LIKE 'eco%' OR m.industry_id LIKE 'lar%' OR m.industry_id LIKE 'med%') AS can_apply FROM manifest m""", ("manifest",))
def _(g):
    k = F.substring(F.col(KEY), 1, 3)
    proposals = g("manifest").select(KEY, F.when(k == "eco", "rejected").otherwise("proposed").alias("proposal_status"))
    rollup = g("manifest").select(KEY, F.when(k == "lar", 2).otherwise(0).alias("error_count"))
    review = g("manifest").select(KEY, F.when(k == "med", "error").otherwise("warning").alias("severity"))
    return P.update_gate(proposals, rollup, review, "apply")


@query("f13_publish", """SELECT n.industry_id, n.id FROM nodes n WHERE n.industry_id NOT LIKE 's%' UNION ALL SELECT industry_id, id FROM nodes WHERE industry_id LIKE 's%' AND confidence >= 0.5""", ("nodes",))
def _(g):
    gate = g("manifest").select(KEY, F.col(KEY).like("s%").alias("can_apply"))
    return P.publish(g("nodes"), g("nodes").filter("confidence >= 0.5"), gate).select(KEY, "id")


@query("a15_manifest_counts", """SELECT m.industry_id, m.name, CASE WHEN m.industry_id LIKE 's%' THEN 'ready' ELSE m.status END AS status, n.c AS node_count, e.c AS edge_count FROM manifest m
JOIN (SELECT industry_id, count(*) AS c FROM nodes GROUP BY ALL) n ON n.industry_id = m.industry_id JOIN (SELECT industry_id, count(*) AS c FROM edges GROUP BY ALL) e ON e.industry_id = m.industry_id""", G + ("manifest",))
def _(g):
    return P.manifest_counts(g("manifest"), g("nodes"), g("edges"), g("manifest").filter(F.col(KEY).like("s%")))


# --- repairs -----------------------------------------------------------------------------------------
def _repairs(g):
    c = F.col
    kind = c("event_type")
    name = F.concat("parent_id", F.lit("->"), "node_id")
    edge = F.concat("parent_id", F.lit("__contains__"), "node_id")
    return g("event_targets").select(
        KEY, c("event_id").alias("pos"),
        F.when(kind.isin("purchase", "error"), "update_node").when(kind == "view", "update_edge").when(kind == "click", "delete_edge").otherwise("drop_node").alias("action"),
        F.when(kind == "purchase", c("node_id")).when(kind == "error", F.concat("node_id", F.lit("_x"))).when(kind == "view", name).when(kind == "click", F.when(c("value") < 20, edge).otherwise(F.lit("none"))).otherwise(c("node_id")).alias("target_id"),
        F.create_map(F.lit("confidence"), F.lit("0.9"), F.lit("name"), F.lit("never"), F.lit("relation_weight"), F.lit("1.5")).alias("changes"),
        F.array(F.lit("company_list")).alias("remove_fields"),
    )


@query("m12_repair_nodes", """SELECT n.industry_id, n.id, n.name, CASE WHEN EXISTS (SELECT 1 FROM event_targets e WHERE e.event_type = 'purchase' AND e.node_id = n.id) THEN 0.9 ELSE n.confidence END AS confidence FROM nodes n""", ET)
def _(g):
    return M.repair_nodes(g("nodes"), M.ordered_repairs(_repairs(g)))[0].select(KEY, "id", "name", "confidence")


@query("m12_repair_edges", """SELECT e.industry_id, e.id, CASE WHEN EXISTS (SELECT 1 FROM event_targets t WHERE t.event_type = 'view' AND t.node_id = e.target AND t.parent_id = e.source) THEN cast(1.5 AS double) ELSE 1.0 END AS relation_weight FROM edges e
WHERE NOT EXISTS (SELECT 1 FROM event_targets t WHERE t.event_type = 'click' AND t.value < 20 AND t.node_id = e.target AND t.parent_id = e.source)""", ET)
def _(g):
    return M.apply_repairs(g("nodes"), g("edges"), _repairs(g))[1].select(KEY, "id", "relation_weight")


# deletions by id are in force for all later events of the edge
_GUARD = (
    ("dead", "SELECT node_id, min(event_id) AS since FROM event_targets WHERE event_type = 'click' AND value < 20 GROUP BY node_id"),
    ("guards", """SELECT e.industry_id, CASE WHEN event_type = 'click' THEN 'warning' ELSE 'error' END AS severity, CASE WHEN event_type = 'error' THEN e.node_id || '_x' WHEN event_type = 'view' THEN parent_id || '->' || e.node_id
WHEN event_type = 'click' AND value < 20 THEN parent_id || '__contains__' || e.node_id WHEN event_type = 'click' THEN 'none' ELSE e.node_id END AS item_id,
CASE event_type WHEN 'error' THEN 'node_target_not_unique' WHEN 'view' THEN 'edge_target_not_unique' WHEN 'click' THEN 'edge_to_delete_not_found' ELSE 'action_not_allowed' END AS reason
FROM event_targets e LEFT JOIN dead d ON d.node_id = e.node_id WHERE event_type IN ('error', 'signup') OR (event_type = 'click' AND value >= 20) OR (event_type IN ('click', 'view') AND event_id > since)"""),
)


@query("m12_repair_guardrails", "SELECT * FROM guards", ET, _GUARD)
def _(g):
    return M.apply_repairs(g("nodes"), g("edges"), _repairs(g))[2]


# per leaf edge, events in order: views patch it by its first ends, clicks change its target (by id), purchases patch it by the new ends, signups and errors
# delete it by the first and by the new ends
_ORDERED = (
    ("turns", """SELECT industry_id, parent_id, node_id, event_id, event_type, value, row_number() OVER (PARTITION BY industry_id, parent_id, node_id ORDER BY event_id) AS k FROM event_targets"""),
    ("run(industry_id, parent_id, node_id, k, alive, moved, weight, conf, guard, event_id, event_type)", """SELECT DISTINCT industry_id, parent_id, node_id, cast(0 AS bigint), true, false, cast(NULL AS double), cast(NULL AS double), false, cast(NULL AS bigint), '' FROM turns
UNION ALL SELECT r.industry_id, r.parent_id, r.node_id, t.k,
r.alive AND NOT ((t.event_type = 'signup' AND NOT r.moved) OR (t.event_type = 'error' AND r.moved)), r.moved OR (t.event_type = 'click' AND r.alive),
CASE WHEN t.event_type = 'view' AND r.alive AND NOT r.moved THEN t.value ELSE r.weight END, CASE WHEN t.event_type = 'purchase' AND r.alive AND r.moved THEN 0.25 ELSE r.conf END,
NOT (r.alive AND (t.event_type = 'click' OR (t.event_type IN ('view', 'signup') AND NOT r.moved) OR (t.event_type IN ('purchase', 'error') AND r.moved))), t.event_id, t.event_type
FROM run r JOIN turns t ON t.industry_id = r.industry_id AND t.parent_id = r.parent_id AND t.node_id = r.node_id AND t.k = r.k + 1"""),
    ("ends", "SELECT * FROM run QUALIFY k = max(k) OVER (PARTITION BY industry_id, parent_id, node_id)"),
)


def _ordered(g):
    def build():
        c = F.col
        kind = c("event_type")
        old, new, edge = (F.concat("parent_id", F.lit(t), "node_id", F.lit(e)) for t, e in (("->", ""), ("->", "_moved"), ("__contains__", "")))
        repairs = g("event_targets").select(
            KEY, c("event_id").alias("pos"), F.when(kind.isin("signup", "error"), "delete_edge").otherwise("update_edge").alias("action"),
            F.when(kind.isin("view", "signup"), old).when(kind == "click", edge).otherwise(new).alias("target_id"),
            F.when(kind == "view", F.create_map(F.lit("relation_weight"), c("value").cast("string"))).when(kind == "click", F.create_map(F.lit("target"), F.concat("node_id", F.lit("_moved"))))
            .otherwise(F.create_map(F.lit("confidence"), F.lit("0.25"))).alias("changes"), F.array().cast("array<string>").alias("remove_fields"))
        edges, guard = M.repair_edges(g("edges"), M.ordered_repairs(repairs))
        return edges.select(KEY, "id", "target", "relation_weight", "confidence"), guard

    names = ("ordered_edges", "ordered_guard")
    if names[0] not in g._known:
        for name, df in zip(names, build()):
            g.remember(name, lambda df=df: df)
    return [g(n) for n in names]


@query("m12_ordered_edges", """SELECT e.industry_id, e.id, CASE WHEN r.moved THEN e.target || '_moved' ELSE e.target END AS target, coalesce(r.weight, e.relation_weight) AS relation_weight, coalesce(r.conf, e.confidence) AS confidence
FROM edges e LEFT JOIN ends r ON r.industry_id = e.industry_id AND r.parent_id = e.source AND r.node_id = e.target AND e.relation_type = 'contains' WHERE r.alive IS NOT FALSE""", ET, _ORDERED)
def _(g):
    return _ordered(g)[0]


@query("m12_ordered_guardrails", """SELECT industry_id, CASE WHEN event_type IN ('signup', 'error') THEN 'warning' ELSE 'error' END AS severity,
CASE WHEN event_type IN ('view', 'signup') THEN parent_id || '->' || node_id WHEN event_type = 'click' THEN parent_id || '__contains__' || node_id ELSE parent_id || '->' || node_id || '_moved' END AS item_id,
CASE WHEN event_type IN ('signup', 'error') THEN 'edge_to_delete_not_found' ELSE 'edge_target_not_unique' END AS reason FROM run WHERE guard""", ET, _ORDERED)
def _(g):
    return _ordered(g)[1]


@query("m12_repair_attachments", """SELECT industry_id, company_id, node_id, CASE WHEN pos % 3 = 0 THEN reason ELSE 'checked' END AS reason, CASE WHEN pos % 5 = 0 THEN confidence WHEN pos % 5 = 1 THEN 1.0 ELSE 0.5 END AS confidence FROM attachments WHERE pos % 2 = 0""", ("attachments",))
def _(g):
    return M.repair_attachments(g("attachments"), _proposed(g))[0].select(KEY, "company_id", "node_id", "reason", "confidence")


def _proposed(g):
    c = F.col
    return g("attachments").select(
        KEY, "company_id", F.when(c("pos") % 2 == 0, c("node_id")).otherwise(F.concat("node_id", F.lit("_new"))).alias("node_id"), F.when(c("pos") % 3 == 0, " ").otherwise("checked").alias("reason"),
        F.when(c("pos") % 5 == 0, "high").when(c("pos") % 5 == 1, "2.0").otherwise("0.5").alias("confidence"))


@query("m12_attachment_guardrails", "SELECT industry_id, 'error' AS severity, company_id || '->' || node_id || '_new' AS item_id, 'new_attachment_not_allowed' AS reason FROM attachments WHERE pos % 2 = 1", ("attachments",))
def _(g):
    return M.repair_attachments(g("attachments"), _proposed(g))[1]


# --- tree surgery ---------------------------------------------------------------------------------------
_COR = LINE[:1] + (
    ("tops", "SELECT industry_id, arg_min(id, pos) AS id FROM nodes WHERE name = 'Brand#1' GROUP BY ALL"),
    ("gone", "SELECT t.industry_id, t.id FROM th t JOIN tops x ON x.industry_id = t.industry_id AND x.id = t.ancestor"),
)


def _corrected(g):
    graphs = g("graphs").select(KEY)
    moves = graphs.select(KEY, F.lit("size class 3").alias("name"), F.lit("upstream").alias("chain_position"))
    renames = graphs.select(KEY, F.lit("size class 4").alias("name"), F.lit("services").alias("new_name"), F.lit("support services").alias("description"))
    return M.correct_taxonomy(g("nodes"), g("edges"), moves, renames, graphs.select(KEY, F.lit("Brand#1").alias("name")), g("tree_paths"))


@query("m15_taxonomy_correction", """SELECT n.industry_id, n.id, CASE WHEN n.name = 'size class 4' THEN 'services' ELSE n.name END AS name, CASE WHEN n.name = 'size class 4' THEN 'support services' ELSE n.description END AS description,
CASE WHEN n.name = 'size class 3' THEN 'upstream' ELSE n.chain_position END AS chain_position, CASE WHEN n.name = 'size class 3' THEN '' ELSE n.parent_id END AS parent_id, CASE WHEN n.name = 'size class 3' THEN 'level_1;upstream' ELSE n.tags END AS tags
FROM nodes n ANTI JOIN gone x ON x.industry_id = n.industry_id AND x.id = n.id""", ("nodes",), _COR)
def _(g):
    return joined(_corrected(g)[0].select(KEY, "id", "name", "description", "chain_position", "parent_id", "tags"), "tags")


@query("m15_correction_report", """SELECT industry_id, 'removed' AS change, id, '' AS detail FROM gone UNION ALL SELECT industry_id, 'repositioned', id, 'upstream' FROM nodes WHERE name = 'size class 3'
UNION ALL SELECT industry_id, 'renamed', id, 'services' FROM nodes WHERE name = 'size class 4'""", ("nodes",), _COR)
def _(g):
    return _corrected(g)[2]


_TRANS = (
    ("cutoff", """SELECT c.industry_id, c.id FROM nodes c JOIN nodes d ON d.industry_id = c.industry_id AND d.name = 'Brand#2' AND d.level = 2 AND (c.id = d.id OR starts_with(c.id, d.id || '_'))"""),
    ("moved", """SELECT n.industry_id, n.id AS old_id, n.name, n.level, n.parent_id, 1 AS step, n.id AS walk FROM nodes n ANTI JOIN cutoff x ON x.industry_id = n.industry_id AND x.id = n.id WHERE n.level >= 2 AND starts_with(n.id, n.industry_id || '_001_')
UNION ALL SELECT n.industry_id, n.id, n.name, n.level + 1, n.parent_id, 2, n.id FROM nodes n ANTI JOIN cutoff x ON x.industry_id = n.industry_id AND x.id = n.id WHERE starts_with(n.id, n.industry_id || '_002')
UNION ALL SELECT industry_id, 'manual', 'spare link', 2, '', 3, '' FROM nodes WHERE level = 0"""),
    ("numbered", """SELECT *, industry_id || '_101_' || CASE WHEN rn < 1000 THEN lpad(cast(rn AS varchar), 3, '0') ELSE cast(rn AS varchar) END AS id FROM (SELECT *, row_number() OVER (PARTITION BY industry_id ORDER BY step, walk) AS rn FROM moved)"""),
)


@query("m16_subtree_transplant", """SELECT a.industry_id, a.id, a.name, a.level, coalesce(p.id, a.industry_id || '_101') AS parent_id FROM numbered a LEFT JOIN numbered p ON p.industry_id = a.industry_id AND p.old_id = a.parent_id""", ("nodes",), _TRANS)
def _(g):
    gr = g("graphs").select(KEY)
    branch = F.concat(KEY, F.lit("_101")).alias("branch_id")
    step = lambda n, tail, whole: gr.select(KEY, branch, F.lit(n).alias("step"), F.concat(KEY, F.lit(tail)).alias("old_id"), F.lit(2).alias("start_level"), F.lit(whole).alias("whole"))
    none = F.array().cast("array<string>")
    branches = gr.select(KEY, branch, F.lit("midstream").alias("chain_position"), F.lit("中游").alias("chain_segment"), none.alias("source_urls"), none.alias("evidence_ids"))
    manual = gr.select(KEY, branch, F.lit(3).alias("step"), F.lit("spare").alias("key"), F.lit("spare link").alias("name"), F.lit(2).alias("level"), F.lit("spare").alias("description"), F.lit("").alias("parent_key"), F.lit("").alias("template_key"))
    drops = g("nodes").filter("name = 'Brand#2' AND level = 2").select(KEY, "id")
    nodes, _ = M.transplant(g("nodes"), g("tree_paths"), step(1, "_001", False).unionByName(step(2, "_002", True)), branches, manual, drops, AS_OF)
    return nodes.select(KEY, "id", "name", "level", "parent_id")


# manual nodes under manual nodes and under a copy; templates by default the parent, one of them comes too late
_MANUAL = (("rack", "", ""), ("shelf", "manual:rack", ""), ("drawer", "manual:shelf", ""), ("kit", "old:{}_002", ""), ("tool", "manual:kit", ""), ("bit", "manual:tool", ""),
           ("loan", "", "manual:bit"), ("early", "", "manual:late"), ("late", "manual:loan", "old:{}_001_001"))
_FOREST = _TRANS[:1] + (
    ("man", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', '{p}', '{t or p}')" for i, (k, p, t) in enumerate(_MANUAL, 3)) + ") v(step, key, parent_key, template_key)"),
    ("moved", _TRANS[1][1].split("UNION ALL SELECT industry_id, 'manual'")[0] + """UNION ALL SELECT industry_id, 'manual:' || key, key, 2, replace(parent_key, '{}', industry_id), step, '' FROM nodes, man WHERE level = 0"""),
    _TRANS[2],
    ("byid", "SELECT *, CASE WHEN starts_with(old_id, 'manual:') THEN old_id ELSE 'old:' || old_id END AS key FROM numbered"),
    ("root(industry_id, key, spot)", """SELECT b.industry_id, b.key, b.key FROM byid b WHERE starts_with(b.key, 'manual:') UNION ALL
SELECT r.industry_id, r.key, CASE WHEN t.rn < c.rn THEN t.key ELSE '' END FROM root r JOIN byid c ON c.industry_id = r.industry_id AND c.key = r.spot JOIN man m ON 'manual:' || m.key = r.spot
LEFT JOIN byid t ON t.industry_id = r.industry_id AND t.key = replace(m.template_key, '{}', r.industry_id) WHERE starts_with(r.spot, 'manual:')"""),
    ("heir", "SELECT industry_id, key, spot FROM root WHERE spot IS NULL OR NOT starts_with(spot, 'manual:')"),
)


@query("m16_manual_forest", """SELECT a.industry_id, a.id, a.name, CASE WHEN a.parent_id = '' THEN a.industry_id || '_101' ELSE coalesce(p.id, a.industry_id || '_101') END AS parent_id,
CASE WHEN starts_with(a.key, 'old:') THEN n.source_urls ELSE coalesce(o.source_urls, 'https://branch.example.org/' || a.industry_id) END AS source_urls FROM byid a
LEFT JOIN byid p ON p.industry_id = a.industry_id AND p.key = CASE WHEN starts_with(a.key, 'old:') THEN 'old:' || a.parent_id ELSE a.parent_id END LEFT JOIN nodes n ON n.industry_id = a.industry_id AND n.id = a.old_id
LEFT JOIN heir h ON h.industry_id = a.industry_id AND h.key = a.key LEFT JOIN nodes o ON o.industry_id = a.industry_id AND 'old:' || o.id = h.spot""", ("nodes",), _FOREST)
def _(g):
    gr = g("graphs").select(KEY)
    branch = F.concat(KEY, F.lit("_101")).alias("branch_id")
    step = lambda n, tail, whole: gr.select(KEY, branch, F.lit(n).alias("step"), F.concat(KEY, F.lit(tail)).alias("old_id"), F.lit(2).alias("start_level"), F.lit(whole).alias("whole"))
    branches = gr.select(KEY, branch, F.lit("midstream").alias("chain_position"), F.lit("中游").alias("chain_segment"),
                         F.array(F.concat(F.lit("https://branch.example.org/"), KEY)).alias("source_urls"), F.array(F.lit("branch_ev")).alias("evidence_ids"))
    manual = None
    for i, (key, parent, template) in enumerate(_MANUAL, 3):
        own = lambda text: F.replace(F.lit(text), F.lit("{}"), F.col(KEY))
        row = gr.select(KEY, branch, F.lit(i).alias("step"), F.lit(key).alias("key"), F.lit(key).alias("name"), F.lit(2).alias("level"), F.lit("").alias("description"), own(parent).alias("parent_key"), own(template).alias("template_key"))
        manual = row if manual is None else manual.unionByName(row)
    drops = g("nodes").filter("name = 'Brand#2' AND level = 2").select(KEY, "id")
    nodes, _ = M.transplant(g("nodes"), g("tree_paths"), step(1, "_001", False).unionByName(step(2, "_002", True)), branches, manual, drops, AS_OF)
    return joined(nodes.select(KEY, "id", "name", "parent_id", "source_urls"), "source_urls")


# --- graph rules ---------------------------------------------------------------------------------------------
_DEPTH = (
    ("links", """SELECT DISTINCT industry_id, source, target FROM raw_edges e WHERE relation_type = 'contains' AND EXISTS (SELECT 1 FROM raw_nodes n WHERE n.industry_id = e.industry_id AND n.id = e.source)
AND EXISTS (SELECT 1 FROM raw_nodes n WHERE n.industry_id = e.industry_id AND n.id = e.target)"""),
    ("walk(industry_id, id, d)", """SELECT DISTINCT industry_id, id, 0 FROM raw_nodes WHERE level = 0 OR chain_position = 'root' UNION ALL SELECT w.industry_id, l.target, w.d + 1 FROM walk w JOIN links l ON l.industry_id = w.industry_id AND l.source = w.id WHERE w.d < 20"""),
    ("depth", "SELECT n.industry_id, greatest(0, max(n.level), (SELECT coalesce(max(d), 0) FROM walk w WHERE w.industry_id = n.industry_id)) AS max_contains_depth FROM raw_nodes n GROUP BY n.industry_id"),
)
_GR = _DEPTH + (
    ("nn", "SELECT *, regexp_replace(lower(name), '\\s+', '', 'g') AS norm FROM raw_nodes"),
    ("ek", "SELECT *, source || '->' || target AS k FROM raw_edges"),
    ("found", """SELECT industry_id, 'error' AS severity, 'duplicate_node_id' AS code, id AS item_id FROM nn GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT industry_id, 'error', 'node_missing_source', id FROM nn WHERE source_urls = ''
UNION ALL SELECT industry_id, 'warning', 'node_low_confidence', id FROM nn WHERE coalesce(confidence, 0) < 0.5
UNION ALL SELECT industry_id, 'error', 'company_field_present', id FROM nn WHERE has_company_field
UNION ALL SELECT industry_id, 'error', 'invalid_level', id FROM nn WHERE level < 0
UNION ALL SELECT industry_id, 'warning', 'process_step_node_name', id FROM nn WHERE level >= 2 AND (name LIKE '%清洗' OR name LIKE '%加工步骤')
UNION ALL SELECT industry_id, 'warning', 'duplicate_node_name', arg_min(id, pos) FROM nn WHERE norm <> '' GROUP BY industry_id, norm HAVING count(*) > 1
UNION ALL SELECT industry_id, 'warning', 'node_count_below_target', '' FROM nn GROUP BY industry_id HAVING count(*) < 120
UNION ALL SELECT industry_id, 'warning', 'level_one_breadth_low', '' FROM nn GROUP BY industry_id HAVING count(*) FILTER (WHERE level = 1) < 5
UNION ALL SELECT industry_id, 'error', 'edge_missing_source_node', k FROM ek e WHERE NOT EXISTS (SELECT 1 FROM nn n WHERE n.industry_id = e.industry_id AND n.id = e.source)
UNION ALL SELECT industry_id, 'error', 'edge_missing_target_node', k FROM ek e WHERE NOT EXISTS (SELECT 1 FROM nn n WHERE n.industry_id = e.industry_id AND n.id = e.target)
UNION ALL SELECT industry_id, 'error', 'invalid_relation_type', k FROM ek WHERE relation_type NOT IN ('contains', 'upstream_downstream')
UNION ALL SELECT industry_id, 'error', 'edge_missing_source', k FROM ek WHERE source_urls = ''
UNION ALL SELECT industry_id, 'warning', 'edge_low_confidence', k FROM ek WHERE coalesce(confidence, 0) < 0.5
UNION ALL SELECT industry_id, 'error', 'relation_conflict', k FROM ek GROUP BY industry_id, k HAVING count(DISTINCT relation_type) > 1
UNION ALL SELECT industry_id, 'warning', 'isolated_node', id FROM nn n WHERE chain_position <> 'root' AND NOT EXISTS (SELECT 1 FROM ek e WHERE e.industry_id = n.industry_id AND (e.source = n.id OR e.target = n.id))
UNION ALL SELECT industry_id, 'warning', 'contains_depth_below_target', '' FROM depth WHERE max_contains_depth < 4"""),
)
RG = ("raw_nodes", "raw_edges")


def raw_issues(g):
    return g.remember("raw_graph_issues", lambda: V.graph_issues(g("raw_nodes"), g("raw_edges")))


@query("v_graph_rules", "SELECT * FROM found", RG, _GR)
def _(g):
    return V.graph_issues(g("raw_nodes"), g("raw_edges")).select(KEY, "severity", "code", "item_id")


_GR_STD = tuple((n, q.replace("raw_nodes", "std_nodes").replace("raw_edges", "std_edges")) for n, q in _GR)


@query("v_graph_rules_standardized", "SELECT industry_id, severity, code, count(*) AS n FROM found GROUP BY ALL", RAW, STD + _GR_STD)
def _(g):
    n, e = standardized(g)
    return V.graph_issues(n, e).groupBy(KEY, "severity", "code").agg(F.count("*").alias("n"))


@query("a09_contains_depth", "SELECT * FROM depth", RG, _DEPTH)
def _(g):
    return V.contains_depth(g("raw_nodes"), g("raw_edges"))


@query("a10_issue_rollup", "SELECT industry_id, count(*) FILTER (WHERE severity = 'error') AS error_count, count(*) FILTER (WHERE severity = 'warning') AS warning_count, CASE WHEN count(*) FILTER (WHERE severity = 'error') = 0 THEN 'pass' ELSE 'fail' END AS status FROM found GROUP BY ALL", RG, _GR)
def _(g):
    return V.issue_rollup(raw_issues(g), g("manifest"))


@query("f10_repairable_split", """SELECT industry_id, code, code <> 'duplicate_node_id' AS repairable, count(*) AS n FROM found WHERE severity = 'error' GROUP BY ALL""", RG, _GR)
def _(g):
    return V.split_repairable(raw_issues(g)).groupBy(KEY, "code", "repairable").agg(F.count("*").alias("n"))


@query("a11_graph_profile", """SELECT industry_id, 'level' AS metric, 'L' || level AS key, count(*) AS n FROM nodes GROUP BY ALL UNION ALL
SELECT n.industry_id, 'branch_size', l.branch_id, count(*) FROM nodes n JOIN line l ON l.industry_id = n.industry_id AND l.id = n.id WHERE n.level >= 2 GROUP BY ALL UNION ALL
SELECT industry_id, 'duplicate_name', trim(name), count(*) FROM nodes GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT industry_id, 'flow_below_level_one', '', cast(0 AS bigint) FROM nodes WHERE level = 0""", ("nodes",), LINE)
def _(g):
    return V.graph_profile(g("nodes"), g("edges"), g("lines"))


@query("a14_minimal_change", """SELECT industry_id, 'node_change_too_large' AS code, 'nodes' AS item_id FROM (SELECT industry_id, count(*) AS n0,
count(*) FILTER (WHERE NOT (level = 3 AND confidence < 0.6) AND NOT (level = 2 AND confidence < 0.5)) AS n1 FROM nodes GROUP BY ALL) WHERE n0 - n1 > greatest(5, floor(n0 * 0.15))
UNION ALL SELECT industry_id, 'edge_change_too_large', 'edges' FROM (SELECT industry_id, count(*) AS e0, count(*) FILTER (WHERE confidence >= 0.5) AS e1 FROM edges GROUP BY ALL)
WHERE e0 - e1 > greatest(10, floor(e0 * 0.15))""", ("nodes", "edges"))
def _(g):
    return V.minimal_change(g("nodes"), g("edges"), alive_nodes(g), g("edges").filter("confidence >= 0.5")).select(KEY, "code", "item_id")


@query("m10_review_queue", """SELECT industry_id, type, count(*) AS n FROM (SELECT industry_id, 'validation_issue' AS type FROM found WHERE severity = 'error' OR code IN ('duplicate_node_name', 'isolated_node')
UNION ALL SELECT industry_id, 'duplicate_node_candidate' FROM dup UNION ALL SELECT industry_id, 'relation_conflict_candidate' FROM con WHERE relation_type <> kept_type
UNION ALL SELECT industry_id, 'format_repair_issue' FROM guards
UNION ALL SELECT industry_id, 'quality_evaluation_opinion' FROM opinion_records WHERE status <> 'pass' OR revised) GROUP BY ALL""", RG + ("event_targets", "opinion_records"), _GR + (_DUP, _CON) + _GUARD)
def _(g):
    queue = M.review_queue(
        raw_issues(g), M.duplicate_name_report(g("raw_nodes")), M.relation_conflicts(g("raw_edges"))[1], M.apply_repairs(g("nodes"), g("edges"), _repairs(g))[2], M.quality_opinions(g("opinion_records")))
    return queue.groupBy(KEY, "type").agg(F.count("*").alias("n"))


@query("m17_final_validation")
def _(g):
    return final(g)[0]


def final(g):
    names = ("final_report", "final_review", "final_status")
    if names[0] not in g._known:
        r = CU.final_validation(g("graphs"), g("raw_nodes"), g("raw_edges"), _repairs(g), M.quality_opinions(g("opinion_records")), AS_OF)
        for name, df in zip(names, (r.report, r.review, r.status)):
            g.remember(name, lambda df=df: df)
    return [g(n) for n in names]


@query("m17_final_review_queue")
def _(g):
    return final(g)[1].groupBy(KEY, "type").agg(F.count("*").alias("n"))


_SMALL = ("small", """SELECT industry_id, count(*) AS n FROM (SELECT b.industry_id, b.id FROM nodes b LEFT JOIN nodes x ON x.industry_id = b.industry_id AND x.level >= 2 AND starts_with(x.id, b.id || '_')
WHERE b.level = 1 GROUP BY ALL HAVING count(x.id) < 8) GROUP BY ALL""")
_COUNTS = """(SELECT count(*) FROM nodes x WHERE x.industry_id = m.industry_id) - (SELECT count(*) FROM single s WHERE s.industry_id = m.industry_id) AS node_count,
(SELECT count(*) FROM edges x WHERE x.industry_id = m.industry_id) - (SELECT count(*) FROM single s WHERE s.industry_id = m.industry_id) AS edge_count"""


@query("m19_rebuild_from_branches", f"""SELECT m.industry_id, {_COUNTS} FROM manifest m WHERE m.industry_id NOT IN (SELECT industry_id FROM small)
UNION ALL SELECT industry_id, cast(0 AS bigint), -n FROM small""", G + ("manifest",), SINGLE[:2] + (_SMALL,))
def _(g):
    seed_nodes = g("nodes").filter("level <= 1")
    seed_edges = g("edges").join(seed_nodes.select(KEY, F.col("id").alias("target")), [KEY, "target"], "left_semi").select(*g("edges").columns)
    numbered = _branch_nodes(g).withColumn("graph_no", F.substring(F.element_at(F.split("branch_id", "_"), -1), 1, 3).cast("int"))
    links = g("edges").filter("relation_type = 'contains'").join(numbered.select(KEY, F.col("id").alias("target"), "branch_id", "graph_no"), [KEY, "target"]).filter(F.col("source") != F.concat(KEY, F.lit("_000")))
    nodes, edges, failures = CU.rebuild_from_branches(g("graphs"), seed_nodes, seed_edges, numbered, links.select(*g("edges").columns, "branch_id", "graph_no"), AS_OF)
    counts = nodes.groupBy(KEY).agg(F.count("*").alias("node_count")).join(edges.groupBy(KEY).agg(F.count("*").alias("edge_count")), KEY)
    return counts.select(KEY, "node_count", "edge_count").unionByName(failures.groupBy(KEY).agg(F.lit(0).cast("bigint").alias("node_count"), (-F.count("*")).alias("edge_count")))


_UPD = SINGLE[:2] + (
    ("cur", """SELECT industry_id, id, parent_id, level FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM single s WHERE s.industry_id = n.industry_id AND s.child_id = n.id)
UNION ALL SELECT industry_id, parent_id || '_9' || event_id, parent_id, 3 FROM event_targets WHERE event_type = 'view' AND value >= 10
UNION ALL SELECT DISTINCT industry_id, node_id, parent_id, 3 FROM event_targets WHERE event_type = 'view' AND value < 10 AND node_id IN (SELECT child_id FROM single)"""),
    ("kin", "SELECT industry_id, parent_id, count(*) AS n, max(id) AS id, max(level) AS level FROM cur WHERE parent_id <> '' GROUP BY ALL"),
    ("lone", """SELECT k.industry_id, k.id FROM kin k JOIN cur p ON p.industry_id = k.industry_id AND p.id = k.parent_id WHERE k.n = 1 AND p.level <> 0 AND k.level >= 2
AND NOT EXISTS (SELECT 1 FROM kin c WHERE c.industry_id = k.industry_id AND c.parent_id = k.id)"""),
)


@query("m11_update_candidate", """SELECT m.industry_id, (SELECT count(*) FROM cur x WHERE x.industry_id = m.industry_id) - (SELECT count(*) FROM lone x WHERE x.industry_id = m.industry_id) AS node_count,
(SELECT count(DISTINCT e.node_id) FROM event_targets e JOIN cur x ON x.industry_id = e.industry_id AND x.id = e.node_id WHERE e.industry_id = m.industry_id AND e.event_type = 'signup'
AND e.node_id NOT IN (SELECT id FROM lone)) AS deprecated_count FROM manifest m""", ET + ("manifest",), _UPD)
def _(g):
    n, e = CU.propose_update(g("graphs"), g("nodes"), g("edges"), *_updates(g), AS_OF)
    return n.groupBy(KEY).agg(F.count("*").alias("node_count"), F.count_if("deprecated").alias("deprecated_count"))


@query("f13_publish_candidates", f"SELECT m.industry_id, 'ready' AS status, {_COUNTS}, true AS can_apply FROM manifest m", G + ("manifest",), SINGLE[:2])
def _(g):
    _, _, entries, gate = CU.publish_candidates(g("manifest"), g("graphs"), g("nodes"), g("edges"), g("nodes"), g("edges"), AS_OF)
    return entries.join(gate, KEY).select(KEY, "status", "node_count", "edge_count", "can_apply")
