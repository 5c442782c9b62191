"""Queries over companies: catalogs, scope, matching, curation, rules."""

import re

from pyspark.sql import functions as F

from linkstrata import constants as K
from linkstrata.functions import text as X
from linkstrata.functions.tables import checkpointed, stored
from linkstrata.catalog.files import TAXONOMY, current_state
from linkstrata.catalog.registry import AS_OF, H, KEY, joined, query
from linkstrata.operators import companies as C
from linkstrata.operators import flow as FL
from linkstrata.operators import hierarchy as HI
from linkstrata.operators import validate as V
from linkstrata.plans import overlays as O
from linkstrata.plans.attachment import Formal, run_attachment
from linkstrata.plans.overlays import attach_companies
from linkstrata.sources.store import publish_version, read_published

VALUES = ("vals", """SELECT company_id, col_no, column_name, value FROM (SELECT company_id, 0 AS col_no, 'indunamesw' AS column_name, indunamesw AS value FROM companies
UNION ALL SELECT company_id, 1, 'indunamesw1', indunamesw1 FROM companies UNION ALL SELECT company_id, 2, 'indunamesw2', indunamesw2 FROM companies
UNION ALL SELECT company_id, 3, 'indunamesw3', indunamesw3 FROM companies) WHERE value <> ''""")
CATALOG = ("cat", "SELECT column_name, value, count(*) AS company_count FROM vals GROUP BY ALL")
RULES = ("rules", """SELECT s.industry_id, s.rule_pos, s.value_pos, trim(s.column_name) AS column_name, trim(s.value) AS value, s.reason FROM scope_rules s
WHERE EXISTS (SELECT 1 FROM cat c WHERE c.column_name = trim(s.column_name) AND c.value = trim(s.value))
QUALIFY row_number() OVER (PARTITION BY industry_id, trim(s.column_name), trim(s.value) ORDER BY rule_pos, value_pos) = 1""")
LABEL = "lower(regexp_replace(regexp_replace({}, '\\s+', '', 'g'), '[ⅠⅡⅢⅣⅤⅥ]+$', ''))"
FULL = ("full_rules", f"""SELECT * FROM rules UNION ALL SELECT DISTINCT n.industry_id, (SELECT coalesce(max(r.rule_pos), -1) + 1 FROM rules r WHERE r.industry_id = n.industry_id), 0, 'indunamesw', c.value, '{K.REASON_SCOPE_COMPLETION}' FROM nodes n
JOIN cat c ON c.column_name = 'indunamesw' AND {LABEL.format('c.value')} = {LABEL.format('n.name')}
WHERE n.level <> 0 AND NOT EXISTS (SELECT 1 FROM rules r WHERE r.industry_id = n.industry_id AND r.column_name = 'indunamesw' AND r.value = c.value)""")
CHOSEN = ("chosen", "SELECT DISTINCT r.industry_id, v.company_id FROM vals v JOIN rules r ON r.column_name = v.column_name AND r.value = v.value")
EXACT = (
    ("labels", f"SELECT industry_id, id, name, level, {LABEL.format('name')} AS label FROM nodes WHERE level <> 0"),
    ("deep", "SELECT * FROM labels QUALIFY level = max(level) OVER (PARTITION BY industry_id, label)"),
    ("exact", f"""SELECT s.industry_id, s.company_id, d.id AS node_id, '申万分类“' || v.value || '”与产业节点“' || d.name || '”精确对应' AS reason, cast(0.9 AS double) AS confidence,
'deterministic_taxonomy_exact' AS match_method, v.column_name AS taxonomy_column, v.value AS taxonomy_value FROM chosen s JOIN vals v ON v.company_id = s.company_id
JOIN deep d ON d.industry_id = s.industry_id AND d.label = {LABEL.format('v.value')}
QUALIFY row_number() OVER (PARTITION BY s.industry_id, s.company_id, d.id ORDER BY v.col_no DESC) = 1"""),
)
BASE = (VALUES, CATALOG, RULES, CHOSEN)
T = ("nodes", "companies", "scope_rules")


def rules(g):
    return C.normalize_scope(g("scope_rules"), C.taxonomy_catalog(g("companies")))


def selected(g):
    return g.remember("selected_companies", lambda: C.select_by_scope(g("companies"), rules(g)))


def matches(g):
    return g.remember("taxonomy_matches", lambda: C.taxonomy_matches(g("nodes"), g("companies"), selected(g)))


@query("a01_taxonomy_catalog", 'SELECT column_name AS "column", value, company_count FROM cat', ("companies",), (VALUES, CATALOG))
def _(g):
    return C.taxonomy_catalog(g("companies"))


@query("a02_taxonomy_paths", "SELECT * FROM tax_paths", ("companies",), (TAXONOMY,))
def _(g):
    return C.taxonomy_paths(g("companies"))


@query("p24_compact_tree", "SELECT indunamesw_path AS path, indunamesw AS leaf_name, level FROM tax_paths", ("companies",), (TAXONOMY,))
def _(g):
    return C.compact_tree(C.taxonomy_paths(g("companies")))


_SEL = ("valid", """SELECT s.industry_id, s.pos, t.indunamesw_path AS path, t.indunamesw AS name, t.level, trim(s.reason) AS reason,
CASE WHEN lower(trim(s.suggested_role)) IN ('core', 'upstream', 'downstream', 'support') THEN lower(trim(s.suggested_role)) ELSE 'core' END AS suggested_role
FROM taxonomy_selection s JOIN tax_paths t ON t.indunamesw_path = trim(s.path) QUALIFY row_number() OVER (PARTITION BY s.industry_id, t.indunamesw_path ORDER BY s.pos) = 1""")


def _selection(g):
    # selections name two-level paths: take the tree at level 2
    paths = C.taxonomy_paths(g("companies").withColumn("indunamesw3", F.lit("")).withColumn("indunamesw", F.col("indunamesw2")))
    return C.selected_taxonomy(g("taxonomy_selection"), paths)


_TWO = ("tax_paths", """SELECT DISTINCT indunamesw1 || ' > ' || rtrim(indunamesw2, 'Ⅱ') AS indunamesw_path, rtrim(indunamesw2, 'Ⅱ') AS indunamesw, 2 AS level FROM companies""")


@query("f15_taxonomy_selection", "SELECT * FROM valid", ("companies", "taxonomy_selection"), (_TWO, _SEL))
def _(g):
    return _selection(g)


@query("f15_role_coverage", """SELECT industry_id, core, upstream, downstream, support, array_to_string(list_filter([CASE WHEN core = 0 THEN 'core' END, CASE WHEN downstream = 0 THEN 'downstream' END,
CASE WHEN upstream = 0 THEN 'upstream' END], lambda x: x IS NOT NULL), ', ') AS missing_roles FROM (SELECT industry_id, count(*) FILTER (WHERE suggested_role = 'core') AS core,
count(*) FILTER (WHERE suggested_role = 'upstream') AS upstream, count(*) FILTER (WHERE suggested_role = 'downstream') AS downstream, count(*) FILTER (WHERE suggested_role = 'support') AS support FROM valid GROUP BY ALL)""",
       ("companies", "taxonomy_selection"), (_TWO, _SEL))
def _(g):
    return C.taxonomy_role_coverage(_selection(g))


@query("f04_domestic_listed", "SELECT company_id, name FROM companies WHERE is_listed", ("companies",))
def _(g):
    return C.listed_companies(g("companies")).select("company_id", "name")


_PC = ("pc", "SELECT DISTINCT a.industry_id, c.* FROM attachments a JOIN companies c ON c.company_id = a.company_id")


@query("f05_listed_filter", "SELECT a.industry_id, a.company_id, a.node_id FROM attachments a JOIN companies c ON c.company_id = a.company_id WHERE c.is_listed", ("companies", "attachments"))
def _(g):
    return C.filter_listed(g("attachments"), C.payload_companies(g("attachments"), g("companies")))[0].select(KEY, "company_id", "node_id")


@query("f05_listed_filter_stats", """SELECT industry_id, count(*) AS company_count_before, count(*) FILTER (WHERE is_listed) AS company_count_after, count(*) - count(*) FILTER (WHERE is_listed) AS company_removed,
any_value(a_before) AS attachment_count_before, any_value(a_after) AS attachment_count_after, any_value(a_before) - any_value(a_after) AS attachment_removed, count(*) FILTER (WHERE is_listed) AS listed_domestic_count,
count(*) FILTER (WHERE is_listed IS NOT TRUE AND is_abroad_listed) AS listed_abroad_only_count, count(*) FILTER (WHERE NOT is_listed) AS removed_false, count(*) FILTER (WHERE is_listed IS NULL) AS removed_null
FROM pc JOIN (SELECT a.industry_id, count(*) AS a_before, count(*) FILTER (WHERE c.is_listed) AS a_after FROM attachments a JOIN companies c ON c.company_id = a.company_id GROUP BY ALL) x USING (industry_id) GROUP BY ALL""",
       ("companies", "attachments"), (_PC,))
def _(g):
    return C.listed_filter_stats(g("attachments"), C.payload_companies(g("attachments"), g("companies")))


@query("f06_scope_selection", "SELECT * FROM chosen", T, BASE)
def _(g):
    return C.select_by_scope(g("companies"), rules(g))


@query("f07_scope_normalization", 'SELECT industry_id, rule_pos, cast(value_pos AS int) AS value_pos, column_name AS "column", value, reason FROM rules', T, BASE)
def _(g):
    return rules(g).withColumn("value_pos", F.col("value_pos").cast("int"))


@query("j14_scope_completion", 'SELECT industry_id, column_name AS "column", value, reason FROM full_rules', T, BASE + (FULL,))
def _(g):
    return C.complete_scope(rules(g), g("nodes"), C.taxonomy_catalog(g("companies"))).select(KEY, "column", "value", "reason")


@query("m23_scope_report", """SELECT r.industry_id, count(DISTINCT r.rule_pos) AS rule_count, count(*) AS value_count, (SELECT count(*) FROM companies) AS total_company_count,
(SELECT count(*) FROM companies WHERE is_listed) AS eligible_company_count, (SELECT count(*) FROM chosen c WHERE c.industry_id = r.industry_id) AS selected_company_count FROM rules r GROUP BY r.industry_id""", T, BASE)
def _(g):
    return C.scope_report(g("companies"), rules(g), selected(g))


@query("j13_taxonomy_matches", "SELECT * FROM exact", T, BASE + EXACT)
def _(g):
    return matches(g)


@query("w07_deepest_level", "SELECT industry_id, id, label, level FROM deep", ("nodes",), EXACT[:2])
def _(g):
    from pyspark.sql import Window

    labels = C._node_labels(g("nodes"))
    ranked = labels.withColumn("r", F.rank().over(Window.partitionBy(KEY, "label").orderBy(F.desc("level"))))
    return ranked.filter("r = 1").select(KEY, "id", "label", "level")


_M3 = (
    ("cand", """SELECT industry_id, -1 AS pos, company_id, node_id, reason, cast(confidence AS varchar) AS confidence, match_method FROM exact
UNION ALL SELECT w.industry_id, w.pos, w.company_id, w.node_id, trim(w.reason), w.confidence, coalesce(nullif(w.match_method, ''), 'agent_web_search') FROM web_matches w
JOIN chosen s ON s.industry_id = w.industry_id AND s.company_id = w.company_id"""),
    ("uniq", """SELECT c.* REPLACE (greatest(0.0, least(1.0, coalesce(try_cast(c.confidence AS double), 0.75))) AS confidence) FROM cand c
JOIN nodes n ON n.industry_id = c.industry_id AND n.id = c.node_id AND n.level <> 0
QUALIFY row_number() OVER (PARTITION BY c.industry_id, c.company_id, c.node_id ORDER BY c.pos DESC) = 1"""),
    ("nested", """SELECT DISTINCT a.industry_id, a.company_id, h.ancestor AS node_id FROM uniq a JOIN h ON h.industry_id = a.industry_id AND h.id = a.node_id AND h.dist > 0"""),
    ("built", """SELECT u.* FROM uniq u ANTI JOIN nested x ON x.industry_id = u.industry_id AND x.company_id = u.company_id AND x.node_id = u.node_id"""),
)
TM = ("nodes", "edges", "companies", "scope_rules", "web_matches")
COLS = [KEY, "pos", "company_id", "node_id", "reason", "confidence", "match_method", "taxonomy_column", "taxonomy_value"]


def built(g):
    def build():
        exact = matches(g).withColumn("pos", F.lit(-1).cast("bigint")).withColumn("confidence", F.col("confidence").cast("string"))
        both = exact.select(*COLS).unionByName(g("web_matches").select(*COLS))
        return C.build_attachments(both, selected(g), g("nodes"), HI.closure(g("agg_paths")))

    return g.remember("built_attachments", build)


@query("m03_build_attachments", "SELECT industry_id, company_id, node_id, reason, confidence, match_method FROM built", TM, BASE + EXACT + H + _M3)
def _(g):
    both = matches(g).withColumn("pos", F.lit(-1).cast("bigint")).withColumn("confidence", F.col("confidence").cast("string")).select(*COLS).unionByName(g("web_matches").select(*COLS))
    return C.build_attachments(both, selected(g), g("nodes"), HI.closure(g("agg_paths"))).select(KEY, "company_id", "node_id", "reason", "confidence", "match_method")


@query("a08_attachment_summary", """SELECT b.industry_id, count(*) AS attachment_count, count(DISTINCT b.company_id) AS attached_company_count, count(*) FILTER (WHERE match_method = 'deterministic_taxonomy_exact') AS exact_count,
count(*) FILTER (WHERE match_method = 'agent_web_search') AS web_search_count, count(*) FILTER (WHERE n.level = 1) AS direct_l1_attachment_count,
greatest(0, (SELECT count(*) FROM chosen c WHERE c.industry_id = b.industry_id) - count(DISTINCT b.company_id)) AS unmatched_company_count
FROM built b JOIN nodes n ON n.industry_id = b.industry_id AND n.id = b.node_id GROUP BY b.industry_id""", TM, BASE + EXACT + H + _M3)
def _(g):
    return C.attachment_summary(built(g), g("nodes"), selected(g))


@query("a08_direct_level_one", """SELECT a.industry_id, a.company_id, a.node_id, n.name AS node_name, a.reason FROM (SELECT industry_id, company_id, reason,
CASE WHEN pos % 7 = 0 THEN industry_id || '_' || split_part(substr(node_id, length(industry_id) + 2), '_', 1) ELSE node_id END AS node_id FROM attachments) a
JOIN nodes n ON n.industry_id = a.industry_id AND n.id = a.node_id AND n.level = 1""", ("attachments", "nodes"))
def _(g):
    branch = F.concat(F.col(KEY), F.lit("_"), F.get(F.split(F.expr(f"substr(node_id, length({KEY}) + 2)"), "_"), 0))
    raised = g("attachments").withColumn("node_id", F.when(F.col("pos") % 7 == 0, branch).otherwise(F.col("node_id")))
    return C.direct_level_one(raised, g("nodes"))


@query("a08_method_counts", "SELECT industry_id, match_method, count(*) AS n FROM attachments GROUP BY ALL", ("attachments",))
def _(g):
    return C.method_counts(g("attachments"))


def collapsed(g, which, threshold=30):
    """One of the tables of the collapse: nodes, edges, pairs or removed; of its tables only those that are asked for are written."""
    tables = g.once("fold", lambda: C.collapse_low_coverage(g("nodes"), g("edges"), g("attachments"), g("companies"), threshold))
    return g.remember(f"fold_{which}", lambda: dict(zip(("nodes", "edges", "pairs", "removed"), tables))[which])


# The tree has three levels, so the fixpoint is three unrolled rounds; a round removes leaves with <= 30 companies.
_FOLD = H[:3] + (
    ("p0", "SELECT industry_id, company_id, node_id, pos FROM attachments"),
    ("t0", "SELECT n.industry_id, n.id, n.level, a.parent FROM nodes n LEFT JOIN agg_parent a ON a.industry_id = n.industry_id AND a.id = n.id"),
)


def _round(i):
    return (
        (f"g{i}", f"""SELECT t.industry_id, t.id, t.parent, count(DISTINCT p.company_id) AS n FROM t{i} t LEFT JOIN p{i} p ON p.industry_id = t.industry_id AND p.node_id = t.id
WHERE t.level > 0 AND t.parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t{i} c WHERE c.industry_id = t.industry_id AND c.parent = t.id) GROUP BY ALL HAVING count(DISTINCT p.company_id) <= 30"""),
        (f"p{i + 1}", f"""SELECT DISTINCT p.industry_id, p.company_id, coalesce(g.parent, p.node_id) AS node_id FROM p{i} p LEFT JOIN g{i} g ON g.industry_id = p.industry_id AND g.id = p.node_id"""),
        (f"t{i + 1}", f"SELECT t.* FROM t{i} t ANTI JOIN g{i} g ON g.industry_id = t.industry_id AND g.id = t.id"),
    )


FOLD = _FOLD + sum((_round(i) for i in range(4)), ()) + (("gone", "SELECT * FROM g0 UNION ALL SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3"),)
TF = ("nodes", "edges", "attachments", "companies")


@query("m04_low_coverage_nodes", "SELECT n.industry_id, n.id, n.name, n.level FROM nodes n JOIN t4 t ON t.industry_id = n.industry_id AND t.id = n.id", TF, FOLD)
def _(g):
    return C.collapse_low_coverage(g("nodes"), g("edges"), g("attachments"), g("companies"), 30)[0].select(KEY, "id", "name", "level")


@query("m04_low_coverage_attachments", "SELECT DISTINCT industry_id, company_id, node_id FROM p4", TF, FOLD)
def _(g):
    return collapsed(g, "pairs").select(KEY, "company_id", "node_id")


@query("m04_low_coverage_removals", "SELECT industry_id, id, parent AS parent_id, n AS direct_company_count FROM gone", TF, FOLD)
def _(g):
    return collapsed(g, "removed").select(KEY, "id", "parent_id", "direct_company_count")


# coverage prune over graphs with planned nodes that nothing is attached to
def _wide(parts):
    return tuple((re.sub(r"\bnodes\b", "wide_nodes", n), re.sub(r"\bedges\b", "wide_edges", re.sub(r"\bnodes\b", "wide_nodes", q))) for n, q in parts)


_COVER = _wide(H) + (
    ("keep", """SELECT DISTINCT h.industry_id, h.ancestor AS id FROM attachments a JOIN h ON h.industry_id = a.industry_id AND h.id = a.node_id
UNION SELECT industry_id, id FROM wide_nodes WHERE level = 0 OR chain_position = 'root'"""),
)
TW = ("wide_nodes", "wide_edges", "attachments", "companies")


def _pruned(g):
    nodes, edges = g("wide_nodes"), g("wide_edges")
    above = HI.closure(g.remember("wide_paths", lambda: HI.ancestor_paths(HI.aggregation_parents(nodes, edges))))
    return C.prune_to_coverage(nodes, edges, g("attachments"), g("companies"), above)


@query("m05_coverage_prune_nodes", "SELECT n.industry_id, n.id, n.level FROM wide_nodes n JOIN keep k ON k.industry_id = n.industry_id AND k.id = n.id", TW, _COVER)
def _(g):
    return _pruned(g)[0].select(KEY, "id", "level")


@query("m05_coverage_prune_edges", """SELECT e.industry_id, e.id FROM wide_edges e JOIN keep a ON a.industry_id = e.industry_id AND a.id = e.source
JOIN keep b ON b.industry_id = e.industry_id AND b.id = e.target""", TW, _COVER)
def _(g):
    return _pruned(g)[1].select(KEY, "id")


@query("m05_coverage_removed", "SELECT n.industry_id, n.id, n.name, n.level FROM wide_nodes n ANTI JOIN keep k ON k.industry_id = n.industry_id AND k.id = n.id", TW, _COVER)
def _(g):
    return _pruned(g)[3]


SINGLE = (
    ("kids", "SELECT industry_id, source, count(*) AS n, max(target) AS child FROM edges WHERE relation_type = 'contains' GROUP BY ALL"),
    ("single", """SELECT k.industry_id, k.source AS parent_id, k.child AS child_id FROM kids k JOIN nodes p ON p.industry_id = k.industry_id AND p.id = k.source
JOIN nodes c ON c.industry_id = k.industry_id AND c.id = k.child LEFT JOIN kids x ON x.industry_id = k.industry_id AND x.source = k.child WHERE k.n = 1 AND p.level <> 0 AND c.level >= 2 AND x.n IS NULL"""),
    ("moved", """SELECT a.industry_id, a.company_id, coalesce(s.parent_id, a.node_id) AS node_id, a.reason, a.confidence FROM attachments a
LEFT JOIN single s ON s.industry_id = a.industry_id AND s.child_id = a.node_id
QUALIFY row_number() OVER (PARTITION BY a.industry_id, a.company_id, coalesce(s.parent_id, a.node_id) ORDER BY s.child_id IS NOT NULL, CASE WHEN s.child_id IS NULL THEN -a.pos ELSE a.pos END) = 1"""),
)


@query("m06_singleton_move_attachments", "SELECT * FROM moved", TF, SINGLE)
def _(g):
    return C.collapse_attached_singletons(g("nodes"), g("edges"), g("attachments"))[2].select(KEY, "company_id", "node_id", "reason", "confidence")


@query("m06_singleton_move_nodes", "SELECT n.industry_id, n.id FROM nodes n ANTI JOIN single s ON s.industry_id = n.industry_id AND s.child_id = n.id", TF, SINGLE)
def _(g):
    return C.collapse_attached_singletons(g("nodes"), g("edges"), g("attachments"))[0].select(KEY, "id")


@query("j25_missing_exact_matches", """SELECT e.industry_id, e.company_id, e.node_id FROM exact e WHERE NOT EXISTS (SELECT 1 FROM attachments a JOIN h ON h.industry_id = a.industry_id AND h.id = a.node_id
WHERE a.industry_id = e.industry_id AND a.company_id = e.company_id AND h.ancestor = e.node_id)""", ("nodes", "edges", "companies", "scope_rules", "attachments"), BASE + EXACT + H)
def _(g):
    return C.missing_exact_matches(matches(g), g("attachments"), HI.closure(g("agg_paths"), g("nodes")))


# --- remap to survivors ---------------------------------------------------------------------
LEGACY = (
    ("alive", "SELECT * FROM nodes WHERE NOT (level = 3 AND confidence < 0.6) AND NOT (level = 2 AND confidence < 0.5)"),
    ("old_att", "SELECT a.industry_id, a.company_id, l.id AS node_id, a.reason, a.confidence FROM attachments a JOIN legacy_nodes l ON l.industry_id = a.industry_id AND l.parent_id = a.node_id"),
    ("chain(industry_id, start, cur, dist)", """SELECT DISTINCT industry_id, node_id, node_id, 0 FROM old_att UNION ALL
SELECT c.industry_id, c.start, coalesce(l.parent_id, nullif(n.parent_id, '')), c.dist + 1 FROM chain c LEFT JOIN legacy_nodes l ON l.industry_id = c.industry_id AND l.id = c.cur
LEFT JOIN nodes n ON n.industry_id = c.industry_id AND n.id = c.cur WHERE coalesce(l.parent_id, nullif(n.parent_id, '')) IS NOT NULL AND c.dist < 20"""),
    ("nearest", """SELECT c.industry_id, c.start, arg_min(c.cur, c.dist) AS node_id FROM chain c JOIN alive a ON a.industry_id = c.industry_id AND a.id = c.cur GROUP BY ALL"""),
)


@query("j19_survivor_remap", """SELECT o.industry_id, o.company_id, o.node_id AS old_node_id, n.node_id, CASE WHEN n.node_id IS NULL THEN 'dropped' ELSE 'remapped' END AS outcome,
CASE WHEN n.node_id IS NULL THEN o.reason ELSE o.reason || '（原节点 ' || o.node_id || ' 已合并至现有父节点）' END AS reason
FROM old_att o LEFT JOIN nearest n ON n.industry_id = o.industry_id AND n.start = o.node_id""", ("nodes", "attachments", "legacy_nodes"), LEGACY)
def _(g):
    members = legacy_members(g).withColumn("old_node_id", F.col("old_id"))
    return C.remap_to_survivors(g("attachments"), alive_nodes(g), legacy_paths(g), members).select(KEY, "company_id", "old_node_id", "node_id", "outcome", "reason")


def alive_nodes(g):
    return g("nodes").filter("NOT (level = 3 AND confidence < 0.6) AND NOT (level = 2 AND confidence < 0.5)")


def legacy_members(g):
    return g("legacy_nodes").select(KEY, F.col("parent_id").alias("node_id"), F.col("id").alias("old_id"))


def legacy_paths(g):
    def build():
        links = g("legacy_nodes").select(KEY, "id", "parent_id").unionByName(g("nodes").filter("parent_id <> ''").select(KEY, "id", "parent_id"))
        return HI.ancestor_paths(links)

    return g.remember("legacy_paths", build)


# --- the whole attachment job ------------------------------------------------------------------
def attached(g):
    names = ("job_nodes", "job_edges", "job_attachments", "job_removed", "job_issues")
    if names[0] not in g._known:
        r = attach_companies(g("nodes"), g("edges"), g("companies"), rules(g), g("web_matches"), threshold=1)
        for name, df in zip(names, (r.nodes, r.edges, r.attachments, r.removed, r.issues)):
            g.remember(name, lambda df=df: df)
    return {n: g(n) for n in names}


_LISTED_ONLY = {"companies": "lc", "vals": "lvals", "cat": "lcat", "rules": "full_rules"}


def _renamed(part, *names):
    name, sql = part
    for n in names:
        sql = re.sub(rf"\b{n}\b", _LISTED_ONLY[n], sql)
        name = re.sub(rf"^{n}$", _LISTED_ONLY[n], name)
    return name, sql


_JOB = BASE[:3] + (
    ("lc", "SELECT * FROM companies WHERE is_listed"),
    _renamed(VALUES, "companies", "vals"), _renamed(CATALOG, "vals", "cat"), _renamed(FULL, "cat"), _renamed(CHOSEN, "vals", "rules"), EXACT[0], EXACT[1], _renamed(EXACT[2], "vals"),
) + H + _M3 + (("p0", "SELECT industry_id, company_id, node_id, pos FROM built"), _FOLD[4]) + tuple(
    (n, q.replace("<= 30", "<= 1")) for n, q in FOLD[5:]
) + (
    ("seen", "SELECT DISTINCT h.industry_id, h.ancestor AS id FROM p4 a JOIN h ON h.industry_id = a.industry_id AND h.id = a.node_id"),
    ("stay", """SELECT t.* FROM t4 t WHERE t.level = 0 OR EXISTS (SELECT 1 FROM seen k WHERE k.industry_id = t.industry_id AND k.id = t.id)
OR NOT EXISTS (SELECT 1 FROM seen k WHERE k.industry_id = t.industry_id)"""),
    ("skids", """SELECT e.industry_id, e.source, count(*) AS n, max(e.target) AS child FROM edges e JOIN stay a ON a.industry_id = e.industry_id AND a.id = e.source
JOIN stay b ON b.industry_id = e.industry_id AND b.id = e.target WHERE e.relation_type = 'contains' GROUP BY ALL"""),
    ("slone", """SELECT k.industry_id, k.source AS parent_id, k.child FROM skids k JOIN stay p ON p.industry_id = k.industry_id AND p.id = k.source JOIN stay c ON c.industry_id = k.industry_id AND c.id = k.child
WHERE k.n = 1 AND p.level <> 0 AND c.level >= 2 AND NOT EXISTS (SELECT 1 FROM skids x WHERE x.industry_id = k.industry_id AND x.source = k.child)"""),
    ("last_pairs", "SELECT DISTINCT p.industry_id, p.company_id, coalesce(s.parent_id, p.node_id) AS node_id FROM p4 p LEFT JOIN slone s ON s.industry_id = p.industry_id AND s.child = p.node_id"),
)


@query("m18_attach_companies", """SELECT m.industry_id, (SELECT count(*) FROM stay s WHERE s.industry_id = m.industry_id) - (SELECT count(*) FROM slone s WHERE s.industry_id = m.industry_id) AS node_count,
(SELECT nullif(count(*), 0) FROM last_pairs p WHERE p.industry_id = m.industry_id) AS attachment_count, (SELECT nullif(count(DISTINCT company_id), 0) FROM last_pairs p WHERE p.industry_id = m.industry_id) AS company_count FROM manifest m""",
       TM + ("manifest",), _JOB)
def _(g):
    r = attached(g)
    counts = r["job_nodes"].groupBy(KEY).agg(F.count("*").alias("node_count"))
    pairs = r["job_attachments"].groupBy(KEY).agg(F.count("*").alias("attachment_count"), F.countDistinct("company_id").alias("company_count"))
    return counts.join(pairs, KEY, "left")


@query("m18_attach_removals", """SELECT industry_id, 'low_coverage' AS step, count(*) AS removed FROM gone GROUP BY ALL UNION ALL
SELECT t.industry_id, 'no_coverage', count(*) FROM t4 t ANTI JOIN stay s ON s.industry_id = t.industry_id AND s.id = t.id GROUP BY ALL UNION ALL SELECT industry_id, 'singleton', count(*) FROM slone GROUP BY ALL""", TM, _JOB)
def _(g):
    return attached(g)["job_removed"].groupBy(KEY, "step").agg(F.count("*").alias("removed"))


# --- the whole job with gates and publication ---------------------------------------------------------
# One group of graphs each ends at: a stale overlay (med), company rules (sma), graph rules (pro), flow rules (eco); the reasons lie in the data.
def formal(g):
    def overlay():
        pairs = O.build_overlay(g("pair_rows"), g("decisions"), g("formal_nodes"), AS_OF)[0]
        settled = (F.col("verdict") == "INVALID") & ~F.col(KEY).like("eco%")
        return pairs.withColumn("verdict", F.when(settled, "NO").otherwise(F.col("verdict")))

    decisions = g.remember("formal_decisions", overlay)
    l2 = g.remember("formal_l2", lambda: FL.materialize_edges(decisions, g("formal_nodes"), AS_OF))
    projected = g.remember("formal_projected", lambda: FL.project_flows(l2, g("formal_nodes"), AS_OF))
    summary = FL.decision_summary(decisions).select(KEY, "cache_hit_count")
    return Formal(g("formal_nodes"), g("formal_edges"), g("attachments"), decisions, l2, projected, summary)


def attachment_run(g):
    """The results of the job, as the job wrote them: each query reads the table it names."""
    names = ("run_outcome", "run_issues", "run_stats", "run_manifest", "run_nodes", "run_edges", "run_attachments", "run_l2", "run_projected")

    def job():
        c = F.col
        blank = c(KEY).rlike("^(lar|sma)") & (c("pos") % 11 == 0)
        web = g("web_matches").withColumn("reason", F.when(blank, " \u2003").otherwise(c("reason")))
        overlay = g("manifest").select(KEY, F.when(c(KEY).like("med%"), "stale").otherwise("ready").alias("overlay_status"))
        proposals = attachment_pairs(g, c(KEY).like("lar%")).select("*", F.lit("checked").alias("reason"), F.lit("high").alias("confidence"))
        reports = g("manifest").select(KEY, F.lit("needs_review").alias("validation_status"))
        before = formal(g)
        run = run_attachment(g("manifest"), before, overlay, g("companies"), rules(g), web, proposals, reports, AS_OF, threshold=1)
        root = g.fresh_path("published")
        publish_version(g.spark, root, before.tables(), g("manifest"))
        publish_version(g.spark, root, run.state.tables(), run.outcome.filter("can_apply"))
        kept = {t: read_published(g.spark, root, t) for t in ("nodes", "edges", "attachments", "l2_edges", "projected")}
        return dict(zip(names, (run.outcome, run.issues, run.listed_stats, run.manifest, *kept.values())))

    return g.once("attachment_run", job)


def attachment_pairs(g, only=None):
    """Pairs of the candidate set of listed companies, of all industries or of some ``only``: every step keeps industries apart, so the others are left out first."""
    wanted = F.lit(True) if only is None else only

    def build():
        listed, nodes = C.listed_companies(g("companies")), g("nodes").filter(wanted)
        chosen = stored(C.select_by_scope(listed, C.complete_scope(rules(g).filter(wanted), nodes, C.taxonomy_catalog(listed))))
        exact = stored(C.taxonomy_matches(nodes, listed, chosen)).withColumn("pos", F.lit(-1).cast("bigint")).withColumn("confidence", F.col("confidence").cast("string"))
        web = g("web_matches").filter(wanted).select(*COLS)
        return C.build_attachments(exact.select(*COLS).unionByName(web), chosen, nodes, HI.closure(g("agg_paths").filter(wanted))).select(KEY, "company_id", "node_id")

    return g.remember("candidate_attachments" if only is None else "some_candidate_attachments", build)


_RUN = _JOB + (
    ("fin", "SELECT s.industry_id, s.id FROM stay s ANTI JOIN slone l ON l.industry_id = s.industry_id AND l.child = s.id"),
    ("fine", """SELECT e.* FROM formal_edges e JOIN fin a ON a.industry_id = e.industry_id AND a.id = e.source JOIN fin b ON b.industry_id = e.industry_id AND b.id = e.target"""),
    ("blank", "SELECT DISTINCT industry_id, company_id || '->' || node_id AS item_id FROM built WHERE regexp_matches(industry_id, '^(lar|sma)') AND pos % 11 = 0"),
    ("norm", """SELECT d.*, CASE WHEN d.verdict IN ('A_TO_B', 'B_TO_A') AND d.verdict <> p.allowed_verdicts THEN 'NO' WHEN d.verdict = 'INVALID' AND d.industry_id NOT LIKE 'eco%' THEN 'NO' ELSE d.verdict END AS final
FROM decisions d JOIN pair_rows p ON p.industry_id = d.industry_id AND p.pair_id = d.pair_id"""),
    ("left_dec", "SELECT d.* FROM norm d JOIN fin a ON a.industry_id = d.industry_id AND a.id = d.node_a_id JOIN fin b ON b.industry_id = d.industry_id AND b.id = d.node_b_id"),
    ("flabels", "SELECT l.* FROM labels l JOIN fin f ON f.industry_id = l.industry_id AND f.id = l.id"),
    ("fdeep", "SELECT * FROM flabels QUALIFY level = max(level) OVER (PARTITION BY industry_id, label)"),
    (lambda part: ("fexact", part[1].replace("JOIN deep d", "JOIN fdeep d")))(_renamed(EXACT[2], "vals")),
    ("lp", "SELECT p.* FROM last_pairs p JOIN fin f ON f.industry_id = p.industry_id AND f.id = p.node_id"),
    ("final_issues", """SELECT DISTINCT a.industry_id, 'ancestor_descendant_attachment' AS code, a.company_id AS item_id FROM lp a JOIN h ON h.industry_id = a.industry_id AND h.id = a.node_id AND h.dist > 0
JOIN lp b ON b.industry_id = a.industry_id AND b.company_id = a.company_id AND b.node_id = h.ancestor
UNION ALL SELECT e.industry_id, 'obvious_taxonomy_match_missing', e.company_id || '->' || e.node_id FROM fexact e WHERE NOT EXISTS (SELECT 1 FROM lp a JOIN h ON h.industry_id = a.industry_id AND h.id = a.node_id
WHERE a.industry_id = e.industry_id AND a.company_id = e.company_id AND h.ancestor = e.node_id)"""),
    ("graph_found", """SELECT n.industry_id, 'node_missing_source' AS code, n.id AS item_id FROM formal_nodes n JOIN fin f ON f.industry_id = n.industry_id AND f.id = n.id WHERE n.source_urls = ''
UNION ALL SELECT industry_id, 'edge_missing_source', id FROM fine WHERE source_urls = ''"""),
    ("flow_found", "SELECT industry_id, 'invalid_pair_verdict' AS code, pair_id AS item_id FROM left_dec WHERE final = 'INVALID'"),
    ("outcomes", """SELECT m.industry_id, CASE WHEN m.industry_id LIKE 'med%' THEN 'overlay_stale' WHEN m.industry_id NOT IN (SELECT industry_id FROM chosen) THEN 'no_company_selected'
WHEN m.industry_id LIKE 'sma%' AND m.industry_id IN (SELECT industry_id FROM blank) THEN 'attachment_rules_failed' WHEN m.industry_id NOT IN (SELECT industry_id FROM seen) THEN 'no_coverage'
WHEN m.industry_id IN (SELECT industry_id FROM graph_found) THEN 'graph_rules_failed' WHEN m.industry_id IN (SELECT industry_id FROM flow_found) THEN 'flow_rules_failed'
WHEN m.industry_id IN (SELECT industry_id FROM final_issues) THEN 'attachment_rules_failed_after_pruning' ELSE 'published' END AS outcome FROM manifest m"""),
    ("ran", "SELECT industry_id FROM outcomes WHERE outcome NOT IN ('overlay_stale', 'no_company_selected', 'attachment_rules_failed', 'no_coverage')"),
)
TR = TM + ("manifest", "formal_nodes", "formal_edges", "decisions", "pair_rows", "attachments")


@query("m18_outcome", """SELECT o.industry_id, o.outcome, o.outcome = 'published' AS can_apply, CASE WHEN o.outcome NOT IN ('overlay_stale', 'no_company_selected', 'attachment_rules_failed') THEN (SELECT count(*) FROM nodes n WHERE n.industry_id = o.industry_id) END AS nodes_before,
CASE WHEN r.industry_id IS NOT NULL THEN (SELECT count(*) FROM fin f WHERE f.industry_id = o.industry_id) END AS nodes_after, CASE WHEN r.industry_id IS NOT NULL THEN (SELECT count(*) FROM lp p WHERE p.industry_id = o.industry_id) END AS attachment_count,
CASE WHEN r.industry_id IS NOT NULL THEN (SELECT count(DISTINCT company_id) FROM lp p WHERE p.industry_id = o.industry_id) END AS company_count FROM outcomes o LEFT JOIN ran r ON r.industry_id = o.industry_id""", TR, _RUN)
def _(g):
    return attachment_run(g)["run_outcome"]


@query("m18_issues", """SELECT b.industry_id, 'candidate' AS stage, 'attachment_reason_missing' AS code, b.item_id FROM blank b JOIN outcomes o ON o.industry_id = b.industry_id AND o.outcome NOT IN ('overlay_stale', 'no_company_selected')
UNION ALL SELECT e.industry_id, 'repaired', 'obvious_taxonomy_match_missing', e.company_id || '->' || e.node_id FROM exact e JOIN outcomes o ON o.industry_id = e.industry_id AND o.outcome = 'attachment_rules_failed'
UNION ALL SELECT f.industry_id, 'graph', f.code, f.item_id FROM graph_found f JOIN ran USING (industry_id)
UNION ALL SELECT f.industry_id, 'flow', f.code, f.item_id FROM flow_found f JOIN outcomes o ON o.industry_id = f.industry_id AND o.outcome = 'flow_rules_failed'
UNION ALL SELECT f.industry_id, 'final', f.code, f.item_id FROM final_issues f JOIN outcomes o ON o.industry_id = f.industry_id AND o.outcome = 'attachment_rules_failed_after_pruning'""", TR, _RUN)
def _(g):
    return attachment_run(g)["run_issues"].filter("severity = 'error'").select(KEY, "stage", "code", "item_id")


@query("m18_listed_stats", """SELECT b.industry_id, count(*) AS company_count_before, count(*) AS company_count_after, any_value(n) AS attachment_count_before, any_value(n) AS attachment_count_after
FROM (SELECT DISTINCT industry_id, company_id FROM built) b JOIN (SELECT industry_id, count(*) AS n FROM built GROUP BY ALL) x ON x.industry_id = b.industry_id WHERE b.industry_id NOT LIKE 'med%' GROUP BY b.industry_id""", TR, _RUN)
def _(g):
    return attachment_run(g)["run_stats"].select(KEY, "company_count_before", "company_count_after", "attachment_count_before", "attachment_count_after")


@query("m18_published_nodes", """SELECT n.industry_id, n.id, n.source_urls, CASE WHEN o.outcome = 'published' THEN 2 ELSE 1 END AS version FROM formal_nodes n JOIN outcomes o ON o.industry_id = n.industry_id
WHERE o.outcome <> 'published' OR EXISTS (SELECT 1 FROM fin f WHERE f.industry_id = n.industry_id AND f.id = n.id)""", TR, _RUN)
def _(g):
    return joined(attachment_run(g)["run_nodes"].select(KEY, "id", "source_urls", "version"), "source_urls")


@query("m18_published_edges", """SELECT e.industry_id, e.id, CASE WHEN o.outcome = 'published' THEN 2 ELSE 1 END AS version FROM formal_edges e JOIN outcomes o ON o.industry_id = e.industry_id
WHERE o.outcome <> 'published' OR EXISTS (SELECT 1 FROM fine f WHERE f.industry_id = e.industry_id AND f.id = e.id)""", TR, _RUN)
def _(g):
    return attachment_run(g)["run_edges"].select(KEY, "id", "version")


@query("m18_published_attachments", """SELECT a.industry_id, a.company_id, a.node_id, 1 AS version FROM attachments a JOIN outcomes o ON o.industry_id = a.industry_id AND o.outcome <> 'published'
UNION ALL SELECT p.industry_id, p.company_id, p.node_id, 2 FROM lp p JOIN outcomes o ON o.industry_id = p.industry_id AND o.outcome = 'published'""", TR, _RUN)
def _(g):
    return attachment_run(g)["run_attachments"].select(KEY, "company_id", "node_id", "version")


@query("m18_published_flows", """SELECT d.industry_id, CASE WHEN final = 'A_TO_B' THEN node_a_id ELSE node_b_id END AS source, CASE WHEN final = 'A_TO_B' THEN node_b_id ELSE node_a_id END AS target, CASE WHEN o.outcome = 'published' THEN 2 ELSE 1 END AS version
FROM norm d JOIN outcomes o ON o.industry_id = d.industry_id WHERE final IN ('A_TO_B', 'B_TO_A') AND (o.outcome <> 'published' OR d.pair_id IN (SELECT pair_id FROM left_dec))""", TR, _RUN)
def _(g):
    return attachment_run(g)["run_l2"].select(KEY, "source", "target", "version")


@query("m18_manifest", """SELECT m.industry_id, m.name, m.status, CASE WHEN o.outcome = 'published' THEN (SELECT count(*) FROM fin f WHERE f.industry_id = m.industry_id) ELSE m.node_count END AS node_count,
CASE WHEN o.outcome = 'published' THEN (SELECT count(*) FROM fine f WHERE f.industry_id = m.industry_id) ELSE m.edge_count END AS edge_count FROM manifest m JOIN outcomes o ON o.industry_id = m.industry_id""", TR, _RUN)
def _(g):
    return attachment_run(g)["run_manifest"]


# --- rules ---------------------------------------------------------------------------------------
_RULES_PARTS = BASE + EXACT + H + (
    ("pcs", "SELECT DISTINCT a.industry_id, c.* FROM loose_attachments a JOIN companies c ON c.company_id = a.company_id"),
    ("loose", """SELECT a.*, n.level AS lvl, (SELECT count(*) FROM pcs p WHERE p.industry_id = a.industry_id AND p.company_id = a.company_id) AS known FROM loose_attachments a
LEFT JOIN nodes n ON n.industry_id = a.industry_id AND n.id = a.node_id"""),
    ("found", """SELECT industry_id, 'attachment_unknown_company' AS code, company_id AS item_id FROM loose WHERE known = 0
UNION ALL SELECT industry_id, 'attachment_unknown_node', node_id FROM loose WHERE lvl IS NULL
UNION ALL SELECT industry_id, 'root_direct_attachment', node_id FROM loose WHERE lvl = 0
UNION ALL SELECT industry_id, 'attachment_reason_missing', company_id || '->' || node_id FROM loose WHERE trim(reason) = ''
UNION ALL SELECT industry_id, 'attachment_confidence_invalid', company_id || '->' || node_id FROM loose WHERE confidence IS NULL OR confidence > 1 OR confidence < 0
UNION ALL SELECT industry_id, 'duplicate_attachment', company_id || '->' || node_id FROM loose GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT DISTINCT a.industry_id, 'ancestor_descendant_attachment', a.company_id FROM loose a JOIN h ON h.industry_id = a.industry_id AND h.id = a.node_id AND h.dist > 0
  JOIN loose b ON b.industry_id = a.industry_id AND b.company_id = a.company_id AND b.node_id = h.ancestor
UNION ALL SELECT e.industry_id, 'obvious_taxonomy_match_missing', e.company_id || '->' || e.node_id FROM exact e WHERE NOT EXISTS (SELECT 1 FROM loose a JOIN h ON h.industry_id = a.industry_id AND h.id = a.node_id
  WHERE a.industry_id = e.industry_id AND a.company_id = e.company_id AND h.ancestor = e.node_id)
UNION ALL SELECT p.industry_id, 'unknown_company', p.company_id FROM pcs p WHERE p.name LIKE '%7'
UNION ALL SELECT p.industry_id, 'company_identity_mismatch', p.company_id FROM pcs p WHERE p.name LIKE '%3'
UNION ALL SELECT p.industry_id, 'duplicate_company_id', p.company_id FROM pcs p WHERE p.name LIKE '%9'"""),
)


@query("v_company_attachment_rules", "SELECT industry_id, 'error' AS severity, code, item_id FROM found", ("nodes", "edges", "companies", "scope_rules", "loose_attachments"), _RULES_PARTS)
def _(g):
    people = C.payload_companies(g("loose_attachments"), g("companies"))
    twice = people.filter("name LIKE '%9'")
    changed = people.withColumn("short_name", F.when(F.col("name").like("%3"), F.lit("other")).otherwise(F.col("short_name"))).unionByName(twice)
    master = g("companies").filter("name NOT LIKE '%7'")
    issues = V.attachment_issues(g("loose_attachments"), changed, master, g("nodes"), HI.closure(g("agg_paths")), matches(g))
    return issues.select(KEY, "severity", "code", "item_id")


@query("v_company_header_rules", """SELECT industry_id, 'invalid_schema_version' AS code FROM manifest WHERE industry_id LIKE 'lar%' UNION ALL
SELECT industry_id, 'industry_mismatch' FROM manifest WHERE industry_id LIKE 'med%' UNION ALL SELECT industry_id, 'graph_fingerprint_mismatch' FROM manifest WHERE industry_id LIKE 'eco%'
UNION ALL SELECT industry_id, 'candidate_source_mismatch' FROM manifest WHERE industry_id LIKE 'sma%' UNION ALL SELECT industry_id, 'scope_missing' FROM manifest WHERE industry_id LIKE 'pro%'
UNION ALL SELECT DISTINCT industry_id, 'invalid_scope_rule' FROM scope_rules WHERE column_name = 'sector' AND industry_id NOT LIKE 'pro%'""", ("manifest", "scope_rules"))
def _(g):
    c = F.col
    kind = F.substring(c(KEY), 1, 3)
    state = current_state(g)
    meta = state.select(
        KEY, F.when(kind == "med", "other").otherwise(c(KEY)).alias("payload_industry_id"), F.when(kind == "lar", "v0").otherwise(K.ATTACHMENT_SCHEMA_VERSION).alias("schema_version"),
        F.when(kind == "eco", "old").otherwise(c("graph_fingerprint")).alias("graph_fingerprint"), F.when(kind == "sma", "old").otherwise(c("source_hash")).alias("source_hash"),
    )
    scope = g("scope_rules").filter(kind != "pro").withColumn("column", X.strip("column"))
    return V.attachment_meta_issues(meta, state, scope).select(KEY, "code")
