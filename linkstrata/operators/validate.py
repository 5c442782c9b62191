"""Rule sets. Every rule set returns issue rows (industry_id, validator, severity, code, message, item_id).

Row-level rules of one table share a single scan: their conditions become one array of findings
per row, exploded afterwards. Rules that need keys or counts are aggregates or semi/anti joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkstrata import constants as K
from linkstrata.functions import text as X
from linkstrata.functions.tables import Slices, checkpointed, first_by, gathered, stored
from linkstrata.operators.hierarchy import ancestor_paths, closure, with_ancestors

KEY = "industry_id"
ERROR, WARNING = "error", "warning"


def _row_rules(df: DataFrame, validator: str, item: Column, rules: list[tuple]) -> DataFrame:
    """Rules are (condition, severity, code, message[, item id of this rule])."""
    found = F.array(*[
        F.when(r[0], F.struct(
            F.lit(r[1]).alias("severity"), F.lit(r[2]).alias("code"), F.lit(r[3]).alias("message"), (r[4] if len(r) > 4 else item).alias("item_id")
        )) for r in rules
    ])
    return df.select(KEY, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select(
        KEY, F.lit(validator).alias("validator"), "f.severity", "f.code", "f.message", "f.item_id"
    )


def _issues(df: DataFrame, validator: str, severity: str, code: str, message: str, item: Column | None = None) -> DataFrame:
    return df.select(
        KEY, F.lit(validator).alias("validator"), F.lit(severity).alias("severity"), F.lit(code).alias("code"),
        F.lit(message).alias("message"), (item if item is not None else F.lit("")).alias("item_id"),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _empty(arr: str) -> Column:
    return F.coalesce(F.size(arr), F.lit(0)) <= 0


def _bad_confidence(c: Column) -> tuple[Column, Column]:
    value = c.cast("string").try_cast("double")
    return value, ~F.coalesce((value >= 0.0) & (value <= 1.0), F.lit(False))


# --- graph ---------------------------------------------------------------------------
def _walked(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(industry_id, depth) reached by a breadth-first walk from every root: each frontier is appended to the table of visited nodes, which no round writes again."""
    visited = Slices(links.sparkSession, "walk")
    front = visited.add(roots.select(KEY, F.col("id").alias("root"), "id", F.lit(0).alias("depth")))
    depth = 0
    while not front.isEmpty():
        depth += 1
        reached = front.join(links.withColumnRenamed("source", "id"), [KEY, "id"]).select(KEY, "root", F.col("target").alias("id")).distinct()
        front = visited.add(reached.join(visited.rows().select(KEY, "root", "id"), [KEY, "root", "id"], "left_anti").withColumn("depth", F.lit(depth)))
    return visited.rows().groupBy(KEY).agg(F.max("depth").alias("walked"))


def contains_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest breadth-first distance from a root over contains edges, at least the deepest level.

    Where every node has one contains parent, distances are places on its path of ancestors, found in log2(depth) joins; other graphs are walked.
    """
    ids = nodes.select(KEY, "id").distinct()
    links = checkpointed(
        edges.filter(F.col("relation_type") == K.CONTAINS).select(KEY, "source", "target").distinct()
        .join(ids.withColumnRenamed("id", "source"), [KEY, "source"], "left_semi")
        .join(ids.withColumnRenamed("id", "target"), [KEY, "target"], "left_semi")
    )
    roots = checkpointed(nodes.filter(X.is_root(F.col("level"), F.col("chain_position"))).select(KEY, "id").distinct())
    several = checkpointed(links.groupBy(KEY, "target").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(KEY).distinct())
    paths = ancestor_paths(links.join(several, KEY, "left_anti").select(KEY, F.col("target").alias("id"), F.col("source").alias("parent_id")))
    on_path = closure(paths).join(roots.withColumnRenamed("id", "ancestor"), [KEY, "ancestor"], "left_semi").groupBy(KEY).agg(F.max("dist").alias("walked"))
    deepest = on_path.unionByName(_walked(roots.join(several, KEY, "left_semi"), links.join(several, KEY, "left_semi")))
    level = nodes.groupBy(KEY).agg(F.max(F.coalesce("level", F.lit(0))).alias("level"))
    return level.join(deepest, KEY, "left").select(
        KEY, F.greatest(F.lit(0), F.coalesce("walked", F.lit(0)), F.col("level")).alias("max_contains_depth")
    )


def graph_issues(nodes: DataFrame, edges: DataFrame, depth: DataFrame | None = None) -> DataFrame:
    """Rules over raw or standardized tables. ``has_company_field`` marks raw nodes with company data."""
    v, c = "graph", F.col
    company = F.coalesce("has_company_field", F.lit(False)) if "has_company_field" in nodes.columns else F.lit(False)
    level = F.coalesce("level", F.lit(0))
    node_rows = _row_rules(nodes, v, c("id"), [
        (_empty("source_urls"), ERROR, "node_missing_source", "node has no source url"),
        (F.coalesce("confidence", F.lit(0.0)) < K.MIN_CONFIDENCE, WARNING, "node_low_confidence", "node confidence is below the threshold"),
        (company, ERROR, "company_field_present", "node carries company data"),
        (level < 0, ERROR, "invalid_level", "level is negative"),
        ((level >= 2) & X.looks_like_process_step(c("name")), WARNING, "process_step_node_name", "name looks like a process step"),
    ])
    parts = [
        node_rows,
        _issues(nodes.groupBy(KEY, "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), v, ERROR, "duplicate_node_id", "node id is not unique", c("id")),
        _issues(duplicate_names(nodes), v, WARNING, "duplicate_node_name", "normalized name is not unique", c("first_id")),
    ]
    counts = nodes.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.count_if(c("level") == 1).alias("l1"))
    parts.append(_row_rules(counts, v, F.lit(""), [
        (c("n") < K.MIN_TARGET_NODES, WARNING, "node_count_below_target", "fewer nodes than the quality target"),
        (c("l1") < K.MIN_LEVEL_ONE_NODES, WARNING, "level_one_breadth_low", "few level-one links"),
    ]))
    ids = nodes.select(KEY, "id").distinct()
    ends = (
        edges.join(ids.select(KEY, c("id").alias("source"), F.lit(True).alias("_s")), [KEY, "source"], "left")
        .join(ids.select(KEY, c("id").alias("target"), F.lit(True).alias("_t")), [KEY, "target"], "left")
    )
    edge_key = X.or_default(c("id"), F.concat("source", F.lit("->"), "target"))
    parts.append(_row_rules(ends, v, edge_key, [
        (c("_s").isNull(), ERROR, "edge_missing_source_node", "source node does not exist"),
        (c("_t").isNull(), ERROR, "edge_missing_target_node", "target node does not exist"),
        (~F.coalesce(c("relation_type").isin(K.CONTAINS, K.FLOW), F.lit(False)), ERROR, "invalid_relation_type", "relation type is not allowed"),
        (_empty("source_urls"), ERROR, "edge_missing_source", "edge has no source url"),
        (F.coalesce("confidence", F.lit(0.0)) < K.MIN_CONFIDENCE, WARNING, "edge_low_confidence", "edge confidence is below the threshold"),
    ]))
    types = edges.groupBy(KEY, "source", "target").agg(F.min("relation_type").alias("a"), F.max("relation_type").alias("b")).filter("a <> b")
    parts.append(_issues(types, v, ERROR, "relation_conflict", "node pair has several relation types", F.concat("source", F.lit("->"), "target")))
    incident = edges.select(KEY, F.explode(F.array("source", "target")).alias("id")).distinct()
    alone = nodes.filter(F.coalesce("chain_position", F.lit("")) != "root").join(incident, [KEY, "id"], "left_anti")
    parts.append(_issues(alone, v, WARNING, "isolated_node", "node has no edge", c("id")))
    depth = contains_depth(nodes, edges) if depth is None else depth
    parts.append(_issues(depth.filter(c("max_contains_depth") < K.MIN_TARGET_DEPTH), v, WARNING, "contains_depth_below_target", "tree is shallower than the target"))
    return _union(parts)


def duplicate_names(nodes: DataFrame) -> DataFrame:
    norm = X.normalized_name(F.col("name"))
    return nodes.select(KEY, "pos", "id", norm.alias("norm")).filter(F.col("norm") != "").groupBy(KEY, "norm").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("id", F.struct("pos", "id")).alias("first_id")
    ).filter("n > 1")


def issue_rollup(issues: DataFrame, industries: DataFrame) -> DataFrame:
    counts = issues.groupBy(KEY).agg(
        F.count_if(F.col("severity") == ERROR).alias("error_count"), F.count_if(F.col("severity") == WARNING).alias("warning_count")
    )
    return industries.select(KEY).join(counts, KEY, "left").select(
        KEY, F.coalesce("error_count", F.lit(0)).alias("error_count"), F.coalesce("warning_count", F.lit(0)).alias("warning_count"),
        F.when(F.coalesce("error_count", F.lit(0)) == 0, "pass").otherwise("fail").alias("status"),
    )


def graph_report(nodes: DataFrame, edges: DataFrame, issues: DataFrame, depth: DataFrame) -> DataFrame:
    """One report row per graph."""
    n = nodes.groupBy(KEY).agg(F.count(F.lit(1)).alias("node_count"))
    e = edges.groupBy(KEY).agg(F.count(F.lit(1)).alias("edge_count"))
    return n.join(e, KEY, "left").join(depth, KEY, "left").join(issue_rollup(issues, n), KEY).select(
        KEY, "node_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"), "max_contains_depth", "error_count", "warning_count", "status"
    )


def split_repairable(issues: DataFrame) -> DataFrame:
    return issues.filter(F.col("severity") == ERROR).withColumn("repairable", F.col("code").isin(*K.REPAIRABLE_CODES))


def graph_profile(nodes: DataFrame, edges: DataFrame, lines: DataFrame) -> DataFrame:
    """Long profile rows (industry_id, metric, key, n): levels, branch sizes, duplicate names, company data, low flow edges."""
    c = F.col
    level = nodes.select(KEY, "id", F.coalesce("level", F.lit(0)).alias("level"))
    levels = level.groupBy(KEY, F.concat(F.lit("L"), c("level").cast("string")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    branch = nodes.filter(c("level") >= 2).join(lines.select(KEY, "id", "branch_id"), [KEY, "id"]).groupBy(KEY, c("branch_id").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    names = nodes.groupBy(KEY, X.strip("name").alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND key <> ''")
    flows = (
        edges.filter(c("relation_type") == K.FLOW)
        .join(level.select(KEY, c("id").alias("source"), c("level").alias("_s")), [KEY, "source"])
        .join(level.select(KEY, c("id").alias("target"), c("level").alias("_t")), [KEY, "target"])
        .groupBy(KEY).agg(F.count_if((c("_s") > 1) | (c("_t") > 1)).alias("n"))
    )
    parts = [
        levels.select(KEY, F.lit("level").alias("metric"), "key", "n"),
        branch.select(KEY, F.lit("branch_size").alias("metric"), "key", "n"),
        names.select(KEY, F.lit("duplicate_name").alias("metric"), "key", "n"),
        flows.select(KEY, F.lit("flow_below_level_one").alias("metric"), F.lit("").alias("key"), "n"),
    ]
    if "has_company_field" in nodes.columns:
        marked = nodes.groupBy(KEY).agg(F.count_if(F.coalesce("has_company_field", F.lit(False))).alias("n"))
        parts.append(marked.select(KEY, F.lit("company_field").alias("metric"), F.lit("").alias("key"), "n"))
    return _union(parts)


def minimal_change(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Guard against regenerated graphs: size changes beyond max(5 or 10, 15 %), or company data."""
    def n(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(KEY).agg(F.count(F.lit(1)).alias(name))

    c = F.col
    joined = n(nodes, "n0").join(n(new_nodes, "n1"), KEY, "full_outer").join(n(edges, "e0"), KEY, "full_outer").join(n(new_edges, "e1"), KEY, "full_outer").na.fill(0)
    limit = lambda x, floor: F.greatest(F.lit(floor), F.floor(c(x) * 0.15))
    sizes = _row_rules(joined, "minimal_change", F.lit("nodes"), [
        (F.abs(c("n1") - c("n0")) > limit("n0", 5), ERROR, "node_change_too_large", "too many nodes changed"),
    ]).unionByName(_row_rules(joined, "minimal_change", F.lit("edges"), [
        (F.abs(c("e1") - c("e0")) > limit("e0", 10), ERROR, "edge_change_too_large", "too many edges changed"),
    ]))
    if "has_company_field" not in new_nodes.columns:
        return sizes
    return sizes.unionByName(_issues(new_nodes.filter(F.coalesce("has_company_field", F.lit(False))), "minimal_change", ERROR, "company_field_introduced", "node carries company data", c("id")))


# --- company attachments ---------------------------------------------------------------
def attachment_meta_issues(meta: DataFrame, current: DataFrame, rules: DataFrame) -> DataFrame:
    """``meta``: stored header (industry_id = file's owner, payload_industry_id, schema_version,
    graph_fingerprint, source_hash). ``current``: industry_id, graph_fingerprint, source_hash. ``rules``: exploded scope
    rules where an empty value list is one row with a null value."""
    v, c = "company_attachments", F.col
    cur = current.select(KEY, c("graph_fingerprint").alias("_fp"), c("source_hash").alias("_src"))
    counts = rules.groupBy(KEY).agg(F.count(F.lit(1)).alias("_rules"))
    joined = meta.join(cur, KEY, "left").join(counts, KEY, "left")
    head = _row_rules(joined, v, F.lit(""), [
        (~c("schema_version").eqNullSafe(F.lit(K.ATTACHMENT_SCHEMA_VERSION)), ERROR, "invalid_schema_version", "schema version is not supported"),
        (~c("payload_industry_id").eqNullSafe(c(KEY)), ERROR, "industry_mismatch", "file belongs to another industry"),
        (~c("graph_fingerprint").eqNullSafe(c("_fp")), ERROR, "graph_fingerprint_mismatch", "graph has changed since"),
        (~c("source_hash").eqNullSafe(c("_src")), ERROR, "candidate_source_mismatch", "company source has changed since"),
        (c("_rules").isNull(), ERROR, "scope_missing", "no scope rule"),
    ])
    bad = rules.groupBy(KEY, "rule_pos", "column").agg(F.count("value").alias("n")).filter(~c("column").isin(*K.TAXONOMY_COLUMNS) | (c("n") == 0))
    return head.unionByName(_issues(bad, v, ERROR, "invalid_scope_rule", "scope rule needs a known column and values"))


def attachment_issues(
    attachments: DataFrame, companies: DataFrame, master: DataFrame, nodes: DataFrame, closure_above: DataFrame, required: DataFrame
) -> DataFrame:
    """``companies`` per industry; ``master`` the candidate source; ``required`` exact matches that must be covered.

    ``attachments`` may carry ``copies``: a row then stands for so many equal ones.
    """
    v, c = "company_attachments", F.col
    factored = "copies" in attachments.columns
    copies = c("copies") if factored else F.lit(1).cast("bigint")
    fields = ["comcode", "name", "short_name", "is_listed", "is_abroad_listed", *K.TAXONOMY_COLUMNS]
    repeated = companies.groupBy(KEY, F.coalesce("company_id", F.lit("")).alias("company_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR company_id = ''")
    source = master.select("company_id", F.struct(*fields).alias("_src"))
    compared = companies.join(source, "company_id", "left")
    parts = [
        _issues(repeated, v, ERROR, "duplicate_company_id", "company id is blank or repeated", c("company_id")),
        _row_rules(compared, v, c("company_id"), [
            (c("_src").isNull(), ERROR, "unknown_company", "company is not in the candidate source"),
            (c("_src").isNotNull() & ~F.struct(*fields).eqNullSafe(c("_src")), ERROR, "company_identity_mismatch", "company differs from the candidate source"),
        ]),
    ]
    known = companies.select(KEY, "company_id", F.lit(True).alias("_company")).distinct()
    level = nodes.select(KEY, c("id").alias("node_id"), F.coalesce("level", F.lit(0)).alias("_level"))
    joined = attachments.join(known, [KEY, "company_id"], "left").join(level, [KEY, "node_id"], "left")
    _, bad = _bad_confidence(c("confidence"))
    pair = F.concat("company_id", F.lit("->"), "node_id")
    rules = [
        (c("_company").isNull(), ERROR, "attachment_unknown_company", "attachment names an unknown company", c("company_id")),
        (c("_level").isNull(), ERROR, "attachment_unknown_node", "attachment names an unknown node", c("node_id")),
        (c("_level") == 0, ERROR, "root_direct_attachment", "companies may not attach to the root", c("node_id")),
        (X.strip(F.coalesce("reason", F.lit(""))) == "", ERROR, "attachment_reason_missing", "attachment has no reason"),
        (bad, ERROR, "attachment_confidence_invalid", "confidence is not within 0 and 1"),
    ]
    if factored:  # only rows that break a rule are repeated
        joined = joined.filter(reduce(lambda a, b: a | b, [F.coalesce(r[0], F.lit(False)) for r in rules])).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies)))
    parts.append(_row_rules(joined, v, pair, rules))
    # attached, lying above an attached node, required: all that is known of a pair meets in one aggregate; an ancestor matters if a row names it
    key = [KEY, "company_id", "node_id"]
    named = attachments.select(KEY, c("node_id").alias("ancestor")).unionByName(required.select(KEY, c("node_id").alias("ancestor"))).distinct()
    placed = attachments.select(*key, copies.alias("_own"), F.lit(0).cast("bigint").alias("_wanted"))
    wanted = required.select(*key, F.lit(None).cast("bigint").alias("_own"), F.lit(1).cast("bigint").alias("_wanted"))
    above = stored(closure_above.join(named, [KEY, "ancestor"], "left_semi"))
    marked = with_ancestors(gathered(placed.unionByName(wanted), KEY, "company_id"), above, "node_id", "_above").filter(~c("_above") | (c("_wanted") == 0)).select(
        *key, F.when(~c("_above"), c("_own")).alias("_own"), "_above", "_wanted")
    known_pairs = marked.groupBy(*key).agg(F.coalesce(F.sum("_own"), F.lit(0)).alias("_own"), F.max("_above").alias("_above"), F.sum("_wanted").alias("_wanted"))
    whole = c("company_id").isNotNull() & c("node_id").isNotNull() & c(KEY).isNotNull()  # others equal nothing
    nested, missing = whole & (c("_own") > 0) & c("_above"), (c("_wanted") > 0) & ~(whole & ((c("_own") > 0) | c("_above")))
    found = stored(known_pairs.filter((c("_own") > 1) | nested | missing))
    parts.append(_issues(found.filter("_own > 1"), v, ERROR, "duplicate_attachment", "pair is repeated", pair))
    parts.append(_issues(found.filter(nested).select(KEY, "company_id").distinct(), v, ERROR, "ancestor_descendant_attachment", "company sits on a node and on one of its ancestors", c("company_id")))
    uncovered = found.filter(missing).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), c("_wanted"))))
    parts.append(_issues(uncovered, v, ERROR, "obvious_taxonomy_match_missing", "exact label match is not attached", pair))
    return _union(parts)


# --- L2 flow relations --------------------------------------------------------------------
def flow_meta_issues(meta: DataFrame, current: DataFrame) -> DataFrame:
    """``meta``: schema_version, payload_industry_id, graph_fingerprint, decision_mode, web_search, thinking,
    tool_count, temperature (text), candidate_pair_count (text), pair_decision_count, decisions_is_array, projected_is_array,
    decision_rows."""
    v, c = "l2_flow", F.col
    joined = meta.join(current.select(KEY, c("graph_fingerprint").alias("_fp")), KEY, "left")
    temperature = c("temperature").try_cast("double")
    declared = c("candidate_pair_count").try_cast("int")
    return _row_rules(joined, v, F.lit(""), [
        (~c("schema_version").eqNullSafe(F.lit(K.FLOW_SCHEMA_VERSION)), ERROR, "invalid_schema_version", "schema version is not supported"),
        (~c("payload_industry_id").eqNullSafe(c(KEY)), ERROR, "industry_mismatch", "file belongs to another industry"),
        (~c("graph_fingerprint").eqNullSafe(c("_fp")), ERROR, "graph_fingerprint_mismatch", "graph has changed since"),
        (~c("decision_mode").eqNullSafe(F.lit("independent_pair_tri_state")), ERROR, "invalid_decision_mode", "pairs must be decided one by one"),
        (~(c("web_search").eqNullSafe(F.lit(False)) & c("thinking").eqNullSafe(F.lit(False))), ERROR, "invalid_generation_mode", "search and thinking must be off"),
        (F.coalesce("tool_count", F.lit(0)) > 0, ERROR, "tools_enabled", "tools must be off"),
        (temperature.isNull(), ERROR, "temperature_invalid", "temperature is not a number"),
        ((temperature < 0.0) | (temperature > K.MAX_TEMPERATURE), ERROR, "temperature_too_high", "temperature is out of range"),
        (~F.coalesce("decisions_is_array", F.lit(True)), ERROR, "pair_decisions_invalid", "pair decisions are not a list"),
        (~F.coalesce("projected_is_array", F.lit(True)), ERROR, "projected_edges_invalid", "projected edges are not a list"),
        (declared.isNull(), ERROR, "candidate_pair_count_invalid", "candidate pair count is not a number"),
        (F.coalesce(declared, F.lit(-1)) != c("decision_rows"), ERROR, "pair_decision_incomplete", "not every pair has a decision"),
        (~c("pair_decision_count").eqNullSafe(c("decision_rows")), ERROR, "pair_decision_summary_mismatch", "summary and detail differ"),
    ])


PROJECTED_FIELDS = (
    "source", "target", "relation_type", "relation_layer", "relation_weight", "source_urls", "evidence_ids", "confidence",
    "evidence_basis", "projection_roles", "projected_from_count", "projected_from_edge_ids",
)


def flow_issues(
    evaluated: DataFrame, decisions: DataFrame, l2_edges: DataFrame, projected: DataFrame, expected: DataFrame, nodes: DataFrame,
    edges: DataFrame, lines: DataFrame, industries: DataFrame,
) -> DataFrame:
    """Rules over a stored flow overlay. ``decisions``, ``l2_edges`` and ``projected`` carry ``pos``; ``expected`` is the
    projection recomputed from ``l2_edges``; ``lines`` gives the branch role of every node."""
    v, c = "l2_flow", F.col
    level = nodes.select(KEY, "id", F.coalesce("level", F.lit(-1)).alias("level"), F.coalesce("parent_id", F.lit("")).alias("p")).join(
        lines.select(KEY, "id", "branch_role"), [KEY, "id"], "left"
    )
    l2 = level.filter(c("level") == 2)

    def ends(df: DataFrame, a: str, b: str) -> DataFrame:
        for column, s in ((a, "a"), (b, "b")):
            info = level.select(KEY, c("id").alias(column), c("level").alias(f"_l{s}"), c("p").alias(f"_p{s}"), c("branch_role").alias(f"_r{s}"))
            df = df.join(info, [KEY, column], "left")
        return df

    def allowed(src: str, dst: str) -> Column:
        ok = ((c(src) == "upstream") & (c(dst) == K.CONTAINS)) | ((c(src) == K.CONTAINS) & (c(dst) == "downstream"))
        return F.coalesce(ok & (c("_la") == 2) & (c("_lb") == 2), F.lit(False))

    catalogued = evaluated.select(KEY, "node_id")
    parts = [
        _issues(catalogued.groupBy(KEY, "node_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), v, ERROR, "duplicate_evaluated_node", "node is listed twice", c("node_id")),
        _issues(catalogued.distinct().join(l2.select(KEY, c("id").alias("node_id")), [KEY, "node_id"], "left_anti"), v, ERROR, "evaluated_node_not_l2", "listed node is not L2", c("node_id")),
        _issues(l2.join(catalogued.select(KEY, c("node_id").alias("id")), [KEY, "id"], "left_anti"), v, ERROR, "l2_node_not_cataloged", "L2 node is not listed", c("id")),
    ]
    # decisions: the first row of a pair counts, the others are reported and skipped
    named = decisions.filter(F.coalesce("pair_id", F.lit("")) != "")
    parts.append(_issues(decisions.filter(F.coalesce("pair_id", F.lit("")) == ""), v, ERROR, "pair_id_missing", "decision has no pair id"))
    repeats = named.groupBy(KEY, "pair_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts.append(_issues(repeats.withColumn("_x", F.explode(F.sequence(F.lit(2).cast("bigint"), c("n")))), v, ERROR, "duplicate_pair_decision", "pair is decided twice", c("pair_id")))
    single = first_by(named.select(KEY, "pair_id", "pos", "node_a_id", "node_b_id", F.upper(F.coalesce("verdict", F.lit(""))).alias("verdict"), "selection_reasons"), [KEY, "pair_id"], ["pos"])
    d = ends(single, "node_a_id", "node_b_id")
    a_to_b, b_to_a = c("verdict") == "A_TO_B", c("verdict") == "B_TO_A"
    same_or_blank = (F.coalesce("node_a_id", F.lit("")) == "") | (F.coalesce("node_b_id", F.lit("")) == "") | (c("node_a_id") == c("node_b_id"))
    both_l2 = F.coalesce((c("_la") == 2) & (c("_lb") == 2), F.lit(False))
    policy = (a_to_b & ~allowed("_ra", "_rb")) | (b_to_a & ~allowed("_rb", "_ra"))
    parts.append(_row_rules(d, v, c("pair_id"), [
        (~c("verdict").isin(*K.VERDICTS), ERROR, "invalid_pair_verdict", "verdict is not allowed"),
        (same_or_blank, ERROR, "invalid_pair_endpoints", "pair needs two different nodes"),
        (~same_or_blank & ~both_l2, ERROR, "pair_endpoint_not_l2", "pair end is not L2"),
        (~same_or_blank & both_l2 & ((c("_pa") == "") | (c("_pa") == c("_pb"))), ERROR, "same_branch_pair", "pair lies in one branch"),
        (policy, ERROR, "branch_role_policy_violation", "direction is against the branch roles"),
    ]))
    expected_direction = single.filter(c("verdict").isin("A_TO_B", "B_TO_A")).select(
        KEY, c("pair_id").alias("decision_pair_id"), F.when(a_to_b, c("node_a_id")).otherwise(c("node_b_id")).alias("_es"),
        F.when(a_to_b, c("node_b_id")).otherwise(c("node_a_id")).alias("_et"),
    )
    main = edges.filter((c("source") != "") & (c("target") != "")).select(
        KEY, F.least("source", "target").alias("_a"), F.greatest("source", "target").alias("_b"), F.lit(True).alias("_main")
    ).distinct()
    e = (
        ends(l2_edges.withColumn("decision_pair_id", F.coalesce("decision_pair_id", F.lit(""))), "source", "target")
        .join(expected_direction, [KEY, "decision_pair_id"], "left")
        .withColumn("_a", F.least("source", "target")).withColumn("_b", F.greatest("source", "target")).join(main, [KEY, "_a", "_b"], "left")
    )
    value, bad = _bad_confidence(c("confidence"))
    edge_key = X.or_default(c("id"), F.concat("source", F.lit("->"), "target"))
    both_known = c("_la").isNotNull() & c("_lb").isNotNull()
    parts.append(_row_rules(e, v, edge_key, [
        (c("decision_pair_id") == "", ERROR, "decision_pair_id_missing", "edge names no decision"),
        (c("_es").isNull(), ERROR, "edge_without_positive_decision", "edge has no positive decision"),
        (c("_es").isNotNull() & ((c("source") != c("_es")) | (c("target") != c("_et"))), ERROR, "edge_direction_mismatch", "edge runs against its decision"),
        (~c("relation_type").eqNullSafe(F.lit(K.FLOW)), ERROR, "invalid_relation_type", "relation type is not allowed"),
        (~c("relation_layer").eqNullSafe(F.lit(K.L2_FLOW_LAYER)), ERROR, "invalid_relation_layer", "layer mark is wrong"),
        (c("source") == c("target"), ERROR, "self_loop", "edge is a loop"),
        (~both_known, ERROR, "unknown_endpoint", "edge end does not exist"),
        (both_known & ~both_l2, ERROR, "endpoint_not_l2", "edge end is not L2"),
        (both_known & both_l2 & ~allowed("_ra", "_rb"), ERROR, "branch_role_policy_violation", "direction is against the branch roles"),
        (c("_main").isNotNull(), ERROR, "main_relation_conflict", "pair is already joined in the main graph"),
        (X.strip(F.coalesce("description", F.lit(""))) == "", ERROR, "description_missing", "edge has no description"),
        (_empty("source_urls"), ERROR, "source_url_missing", "edge has no source url"),
        (~_empty("source_urls") & F.exists("source_urls", lambda u: ~X.has_http_scheme(u)), ERROR, "source_url_invalid", "source url is not http"),
        (_empty("evidence_ids"), WARNING, "evidence_id_missing", "edge has no evidence id"),
        (bad, ERROR, "confidence_invalid", "confidence is not within 0 and 1"),
        (~bad & (value < K.MIN_CONFIDENCE), ERROR, "confidence_below_minimum", "confidence is below the minimum"),
    ]))
    per_pair = l2_edges.filter(F.coalesce("decision_pair_id", F.lit("")) != "").groupBy(KEY, "decision_pair_id").agg(F.count(F.lit(1)).alias("n"))
    parts.append(_issues(per_pair.filter("n > 1").withColumn("_x", F.explode(F.sequence(F.lit(2).cast("bigint"), c("n")))), v, ERROR, "duplicate_edge_for_pair", "decision has several edges", c("decision_pair_id")))
    parts.append(_issues(expected_direction.join(per_pair.select(KEY, "decision_pair_id"), [KEY, "decision_pair_id"], "left_anti"), v, ERROR, "positive_decision_not_materialized", "positive decision has no edge", c("decision_pair_id")))
    directed = l2_edges.groupBy(KEY, "source", "target").agg(F.count(F.lit(1)).alias("n"))
    parts.append(_issues(directed.filter("n > 1"), v, ERROR, "duplicate_relation", "edge is repeated", F.concat("source", F.lit("->"), "target")))
    back = directed.select(KEY, c("source").alias("target"), c("target").alias("source"))
    both_ways = directed.filter(c("source") != c("target")).join(back, [KEY, "source", "target"], "left_semi")
    parts.append(_issues(both_ways, v, ERROR, "reverse_relation_conflict", "edge exists in both directions", F.concat("source", F.lit("<->"), "target")))
    parts.append(projection_issues(projected, expected, level))
    audit = single.filter(F.array_contains("selection_reasons", K.AUDIT_REASON) & c("verdict").isin("A_TO_B", "B_TO_A")).select(KEY).distinct()
    parts.append(_issues(audit, v, WARNING, "candidate_recall_audit_positive", "audit sample holds positive pairs"))
    parts.append(_issues(industries.select(KEY).join(l2_edges.select(KEY).distinct(), KEY, "left_anti"), v, WARNING, "no_l2_flow_relations", "no flow relation was found"))
    return _union(parts)


def projection_issues(projected: DataFrame, expected: DataFrame, level: DataFrame) -> DataFrame:
    """Stored against recomputed projection, by id; the first row of an id counts."""
    v, c = "l2_flow", F.col
    named = projected.filter(F.coalesce("id", F.lit("")) != "")
    repeats = named.groupBy(KEY, "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    exp = expected.select(KEY, "id", F.struct(*PROJECTED_FIELDS).alias("_x"))
    stored = first_by(named, [KEY, "id"], ["pos"])
    for column, s in (("source", "a"), ("target", "b")):
        stored = stored.join(level.select(KEY, c("id").alias(column), c("level").alias(f"_l{s}")), [KEY, column], "left")
    joined = stored.join(exp, [KEY, "id"], "left")
    known, basis = c("_la").isNotNull() & c("_lb").isNotNull(), c("_x").isNotNull()
    one_two = ((c("_la") == 1) & (c("_lb") == 2)) | ((c("_la") == 2) & (c("_lb") == 1))
    rules = [
        (~c("relation_layer").eqNullSafe(F.lit(K.PROJECTION_LAYER)), ERROR, "invalid_projected_relation_layer", "layer mark is wrong"),
        (~known, ERROR, "projected_unknown_endpoint", "projected end does not exist"),
        (known & ~one_two, ERROR, "projected_endpoint_levels_invalid", "projection must join L1 and L2"),
        (~basis, ERROR, "projected_relation_without_l2_basis", "projection has no L2 edge below it"),
        (basis & (X.strip(F.coalesce("description", F.lit(""))) == ""), ERROR, "projected_description_missing", "projection has no description"),
    ]
    rules += [
        (basis & ~c(f).eqNullSafe(c("_x")[f]), ERROR, "projected_attribute_mismatch", f"{f} differs from the L2 edges") for f in PROJECTED_FIELDS
    ]
    return _union([
        _issues(projected.filter(F.coalesce("id", F.lit("")) == ""), v, ERROR, "projected_edge_id_missing", "projection has no id"),
        _issues(repeats.withColumn("_x", F.explode(F.sequence(F.lit(2).cast("bigint"), c("n")))), v, ERROR, "duplicate_projected_relation", "projection is repeated", c("id")),
        _row_rules(joined, v, c("id"), rules),
        _issues(expected.join(named.select(KEY, "id"), [KEY, "id"], "left_anti"), v, ERROR, "l1_l2_projection_missing", "projection is missing", c("id")),
    ])


def projection_diff(projected: DataFrame, expected: DataFrame) -> DataFrame:
    """missing / extra / changed projected edges by id."""
    c = F.col
    a = projected.select(KEY, "id", F.struct(*PROJECTED_FIELDS).alias("_s"))
    b = expected.select(KEY, "id", F.struct(*PROJECTED_FIELDS).alias("_e"))
    state = F.when(c("_s").isNull(), "missing").when(c("_e").isNull(), "extra").when(~c("_s").eqNullSafe(c("_e")), "changed")
    return a.join(b, [KEY, "id"], "full_outer").select(KEY, "id", state.alias("state")).filter(c("state").isNotNull())
