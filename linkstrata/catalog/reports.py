"""Queries of the written reports: lines of the graph, company and flow reports."""

import re

from pyspark.sql import functions as F

from linkstrata.catalog.company import _RULES_PARTS, matches
from linkstrata.catalog.curate import _GR
from linkstrata.catalog.flow import _FR
from linkstrata.catalog.registry import AS_OF, KEY, query
from linkstrata.operators import companies as C
from linkstrata.operators import export as E
from linkstrata.operators import flow as FL
from linkstrata.operators import hierarchy as HI
from linkstrata.operators import validate as V

# what the rule sets say about each code
GRAPH_TEXTS = {
    "node_missing_source": "node has no source url", "node_low_confidence": "node confidence is below the threshold", "invalid_level": "level is negative", "process_step_node_name": "name looks like a process step",
    "duplicate_node_id": "node id is not unique", "duplicate_node_name": "normalized name is not unique", "node_count_below_target": "fewer nodes than the quality target", "level_one_breadth_low": "few level-one links",
    "edge_missing_source_node": "source node does not exist", "edge_missing_target_node": "target node does not exist", "invalid_relation_type": "relation type is not allowed", "edge_missing_source": "edge has no source url",
    "edge_low_confidence": "edge confidence is below the threshold", "relation_conflict": "node pair has several relation types", "isolated_node": "node has no edge", "contains_depth_below_target": "tree is shallower than the target",
}
COMPANY_TEXTS = {
    "duplicate_company_id": "company id is blank or repeated", "unknown_company": "company is not in the candidate source", "company_identity_mismatch": "company differs from the candidate source",
    "attachment_unknown_company": "attachment names an unknown company", "attachment_unknown_node": "attachment names an unknown node", "root_direct_attachment": "companies may not attach to the root",
    "attachment_reason_missing": "attachment has no reason", "attachment_confidence_invalid": "confidence is not within 0 and 1", "duplicate_attachment": "pair is repeated",
    "ancestor_descendant_attachment": "company sits on a node and on one of its ancestors", "obvious_taxonomy_match_missing": "exact label match is not attached",
}
FLOW_TEXTS = {
    "duplicate_evaluated_node": "node is listed twice", "evaluated_node_not_l2": "listed node is not L2", "l2_node_not_cataloged": "L2 node is not listed", "pair_id_missing": "decision has no pair id",
    "duplicate_pair_decision": "pair is decided twice", "invalid_pair_verdict": "verdict is not allowed", "invalid_pair_endpoints": "pair needs two different nodes", "pair_endpoint_not_l2": "pair end is not L2",
    "same_branch_pair": "pair lies in one branch", "branch_role_policy_violation": "direction is against the branch roles", "decision_pair_id_missing": "edge names no decision",
    "edge_without_positive_decision": "edge has no positive decision", "edge_direction_mismatch": "edge runs against its decision", "invalid_relation_type": "relation type is not allowed", "invalid_relation_layer": "layer mark is wrong",
    "self_loop": "edge is a loop", "unknown_endpoint": "edge end does not exist", "endpoint_not_l2": "edge end is not L2", "main_relation_conflict": "pair is already joined in the main graph", "description_missing": "edge has no description",
    "source_url_missing": "edge has no source url", "source_url_invalid": "source url is not http", "evidence_id_missing": "edge has no evidence id", "confidence_invalid": "confidence is not within 0 and 1",
    "confidence_below_minimum": "confidence is below the minimum", "duplicate_edge_for_pair": "decision has several edges", "positive_decision_not_materialized": "positive decision has no edge", "duplicate_relation": "edge is repeated",
    "reverse_relation_conflict": "edge exists in both directions", "projected_attribute_mismatch": "confidence differs from the L2 edges", "projected_relation_without_l2_basis": "projection has no L2 edge below it",
    "l1_l2_projection_missing": "projection is missing", "candidate_recall_audit_positive": "audit sample holds positive pairs",
}
FLOW_WARNINGS = ("evidence_id_missing", "candidate_recall_audit_positive")


def _texts(texts):
    return ("texts", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in texts.items()) + ") v(code, message)")


def _lines(kind, facts):
    """Lines over ``summ`` (industry_id and facts) and ``iss`` (industry_id, severity, code, item_id, message)."""
    bullets = "".join(f"'- {f}：' || coalesce(cast({f} AS varchar), ''), " for f in facts)
    n = len(facts) + 5
    return f"""SELECT industry_id, unnest(range(1, {n + 1})) AS line_no, unnest(['# ' || industry_id || ' {E.REPORT_TITLES[kind]}', '', {bullets}'', '## 问题列表', '']) AS line FROM summ
UNION ALL SELECT industry_id, {n} + row_number() OVER (PARTITION BY industry_id ORDER BY severity, code, item_id, message), '- [' || severity || '] ' || code || ' ' || coalesce(item_id, '') || '：' || message FROM iss
UNION ALL SELECT industry_id, {n + 1}, '未发现阻断性问题。' FROM summ WHERE industry_id NOT IN (SELECT industry_id FROM iss)"""


_COUNTED = """count(i.code) FILTER (WHERE severity = 'error') AS error_count, count(i.code) FILTER (WHERE severity = 'warning') AS warning_count, CASE WHEN count(i.code) FILTER (WHERE severity = 'error') = 0 THEN 'pass' ELSE 'fail' END AS status"""
_CLEAN = tuple((n, re.sub(r"\braw_nodes\b", "nodes", re.sub(r"\braw_edges\b", "edges", q)).replace("UNION ALL SELECT industry_id, 'error', 'company_field_present', id FROM nn WHERE has_company_field\n", "")) for n, q in _GR)
_GRAPH = tuple((n, q.replace("source || '->' || target AS k", "id AS k") if n == "ek" else q) for n, q in _CLEAN) + (
    _texts(GRAPH_TEXTS), ("iss", "SELECT f.*, t.message FROM found f JOIN texts t ON t.code = f.code"),
    ("summ", f"""SELECT d.industry_id, (SELECT count(*) FROM nodes n WHERE n.industry_id = d.industry_id) AS node_count, (SELECT count(*) FROM edges e WHERE e.industry_id = d.industry_id) AS edge_count, max_contains_depth, {_COUNTED}
FROM depth d LEFT JOIN iss i ON i.industry_id = d.industry_id GROUP BY d.industry_id, max_contains_depth"""),
)


@query("s19_report_lines", _lines("graph", ("node_count", "edge_count", "max_contains_depth", "error_count", "warning_count", "status")), ("nodes", "edges"), _GRAPH)
def _(g):
    depth = g.remember("depth", lambda: V.contains_depth(g("nodes"), g("edges")))
    issues = g.remember("clean_graph_issues", lambda: V.graph_issues(g("nodes"), g("edges"), depth))
    return E.report_lines("graph", V.graph_report(g("nodes"), g("edges"), issues, depth), issues)


_COMPANY = _RULES_PARTS + (
    _texts(COMPANY_TEXTS), ("iss", "SELECT f.industry_id, 'error' AS severity, f.code, f.item_id, t.message FROM found f JOIN texts t ON t.code = f.code"),
    ("summ", f"SELECT m.industry_id, (SELECT count(*) FROM loose_attachments a WHERE a.industry_id = m.industry_id) AS attachment_count, {_COUNTED} FROM manifest m LEFT JOIN iss i ON i.industry_id = m.industry_id GROUP BY m.industry_id"),
)


@query("s19_company_report_lines", _lines("company_attachments", ("attachment_count", "error_count", "warning_count", "status")), ("nodes", "edges", "companies", "scope_rules", "loose_attachments", "manifest"), _COMPANY)
def _(g):
    people = C.payload_companies(g("loose_attachments"), g("companies"))
    twice = people.filter("name LIKE '%9'")
    changed = people.withColumn("short_name", F.when(F.col("name").like("%3"), F.lit("other")).otherwise(F.col("short_name"))).unionByName(twice)
    master = g("companies").filter("name NOT LIKE '%7'")
    issues = g.remember("loose_company_issues", lambda: V.attachment_issues(g("loose_attachments"), changed, master, g("nodes"), HI.closure(g("agg_paths")), matches(g)))
    counts = g("loose_attachments").groupBy(KEY).agg(F.count(F.lit(1)).alias("attachment_count"))
    return E.report_lines("company_attachments", counts.join(V.issue_rollup(issues, g("manifest")), KEY), issues)


_FLOW = _FR + (
    _texts(FLOW_TEXTS), ("iss", f"SELECT f.industry_id, CASE WHEN f.code IN {FLOW_WARNINGS} THEN 'warning' ELSE 'error' END AS severity, f.code, f.item_id, t.message FROM found f JOIN texts t ON t.code = f.code"),
    ("summ", f"SELECT m.industry_id, (SELECT count(*) FROM loose_l2_edges a WHERE a.industry_id = m.industry_id) AS edge_count, {_COUNTED} FROM manifest m LEFT JOIN iss i ON i.industry_id = m.industry_id GROUP BY m.industry_id"),
)


@query("s19_flow_report_lines", _lines("l2_flow", ("edge_count", "error_count", "warning_count", "status")), ("nodes", "edges", "l2_edges", "loose_decisions", "loose_l2_edges", "evaluated", "manifest"), _FLOW)
def _(g):
    expected = g.remember("projected_edges", lambda: FL.project_flows(g("l2_edges"), g("nodes"), AS_OF))
    stored = expected.withColumn("id", F.when(F.col("confidence") < 0.65, F.concat("id", F.lit("_extra"))).otherwise(F.col("id"))).withColumn(
        "confidence", F.when(F.col("confidence") >= 0.8, F.lit(0.1)).otherwise(F.col("confidence"))).withColumn("pos", F.lit(0))
    issues = g.remember("loose_flow_issues", lambda: V.flow_issues(g("evaluated"), g("loose_decisions"), g("loose_l2_edges"), stored, expected, g("nodes"), g("edges"), g("lines"), g("manifest")))
    counts = g("loose_l2_edges").groupBy(KEY).agg(F.count(F.lit(1)).alias("edge_count"))
    return E.report_lines("l2_flow", counts.join(V.issue_rollup(issues, g("manifest")), KEY), issues)
