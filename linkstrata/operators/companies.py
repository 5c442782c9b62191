"""Companies: taxonomy catalogs, scope rules, matching to nodes, attachment set and coverage curation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkstrata import constants as K
from linkstrata.functions import text as X
from linkstrata.functions.tables import Slices, checkpointed, first_by, gathered, join_path, last_by, lookup, stored, work_dir
from linkstrata.operators.hierarchy import aggregation_parents, ancestor_paths, with_ancestors
from linkstrata.operators.standardize import drop_nodes, singleton_leaves

KEY = "industry_id"
ATTACHMENT_COLUMNS = (
    KEY, "pos", "company_id", "node_id", "reason", "confidence", "match_method", "taxonomy_column", "taxonomy_value",
)


# --- company master and taxonomy --------------------------------------------------
def company_master(raw: DataFrame) -> DataFrame:
    """Loose company rows (``pos`` = file order) to the master: first row per code, trimmed, 3-valued flags."""
    have = set(raw.columns)

    def pick(*names: str):
        present = [X.blank_to_null(F.col(f"`{n}`")) for n in names if n in have]
        return X.strip(F.coalesce(*present, F.lit("")))

    def flag(name: str):
        return X.three_valued_flag(F.col(name)) if name in have else F.lit(None).cast("boolean")

    rows = raw.select(
        "pos", pick("comcode", "COMCODE").alias("comcode"), pick("chiname", "NAME", "公司名称").alias("name"),
        pick("chinameabbr").alias("short_name"), flag("islisted").alias("is_listed"),
        flag("isabroadlisted").alias("is_abroad_listed"), *[pick(c).alias(c) for c in K.TAXONOMY_COLUMNS],
    ).filter((F.col("comcode") != "") & (F.col("name") != ""))
    return first_by(rows, ["comcode"], ["pos"]).withColumn("company_id", X.company_id(F.col("comcode")))


def taxonomy_values(companies: DataFrame, *keep: str) -> DataFrame:
    """Unpivot the four taxonomy columns: (company_id, col_no, column, value), blanks dropped."""
    entries = F.array(*[
        F.struct(F.lit(i).alias("col_no"), F.lit(c).alias("column"), X.strip(F.coalesce(c, F.lit(""))).alias("value"))
        for i, c in enumerate(K.TAXONOMY_COLUMNS)
    ])
    return companies.select("company_id", *keep, F.explode(entries).alias("t")).select(
        "company_id", *keep, "t.col_no", "t.column", "t.value"
    ).filter(F.col("value") != "")


def taxonomy_catalog(companies: DataFrame) -> DataFrame:
    return taxonomy_values(companies).groupBy("column", "value").agg(F.count(F.lit(1)).alias("company_count"))


def with_tree_path(companies: DataFrame, *keep: str) -> DataFrame:
    """Kept columns and ``path``: the folded taxonomy path as an array.

    All labels of a row go through one Arrow batch.
    """
    labels = {c: "_label_" + c for c in K.TAXONOMY_COLUMNS}
    named = companies.select(*keep, *[X.tree_label(F.col(c)).alias(n) for c, n in labels.items()])
    levels = [F.col(labels[c]) for c in K.TAXONOMY_LEVEL_COLUMNS]
    return named.select(*keep, X.tree_path(levels, F.col(labels["indunamesw"])).alias("path"))


def taxonomy_paths(companies: DataFrame) -> DataFrame:
    """One row per folded taxonomy path with counts, raw leaf names and raw paths."""
    raw_levels = F.array(*[X.strip(F.coalesce(c, F.lit(""))) for c in K.TAXONOMY_LEVEL_COLUMNS])
    labelled = with_tree_path(companies, *K.TAXONOMY_COLUMNS).select(
        "path",
        F.array_join(F.filter(raw_levels, lambda x: x != ""), " > ").alias("raw_path"),
        F.filter(F.array(X.strip(F.coalesce("indunamesw3", F.lit(""))), X.strip(F.coalesce("indunamesw", F.lit("")))), lambda x: x != "").alias("leaves"),
    ).filter(F.size("path") > 0)
    # few distinct raw spellings per path: reduce to distinct spellings before collecting them
    spelled = labelled.groupBy("path", "raw_path", "leaves").agg(F.count(F.lit(1)).alias("n"))
    grouped = spelled.groupBy("path").agg(
        F.sum("n").alias("occurrence_count"), F.array_sort(F.collect_set("raw_path")).alias("_raw"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("leaves")))).alias("_leaves"),
    )
    level = lambda i: F.coalesce(F.get("path", F.lit(i)), F.lit(""))
    return grouped.select(
        F.element_at("path", -1).alias("indunamesw"), F.size("path").alias("level"),
        level(0).alias("indunamesw1"), level(1).alias("indunamesw2"), level(2).alias("indunamesw3"),
        F.array_join("path", " > ").alias("indunamesw_path"), F.array_join("_leaves", "|").alias("raw_leaf_names"),
        F.array_join("_raw", "|").alias("raw_paths"), "occurrence_count",
    )


def compact_tree(paths: DataFrame) -> DataFrame:
    return paths.filter(F.col("indunamesw_path") != "").select(
        F.col("indunamesw_path").alias("path"), F.col("indunamesw").alias("leaf_name"), "level"
    )


def selected_taxonomy(selection: DataFrame, paths: DataFrame) -> DataFrame:
    """Selected paths that exist in the tree, first per path; unknown roles become core."""
    role = F.lower(X.strip(F.coalesce("suggested_role", F.lit(""))))
    rows = selection.select(
        KEY, "pos", X.strip("path").alias("path"), X.strip(F.coalesce("reason", F.lit(""))).alias("reason"),
        F.when(role.isin(*K.SELECTION_ROLES), role).otherwise("core").alias("suggested_role"),
    )
    tree = paths.select(F.col("indunamesw_path").alias("path"), F.col("indunamesw").alias("name"), "level")
    return first_by(rows, [KEY, "path"], ["pos"]).join(tree, "path").select(
        KEY, "pos", "path", "name", "level", "reason", "suggested_role"
    )


def taxonomy_role_coverage(valid: DataFrame, required: tuple[str, ...] = K.REQUIRED_SELECTION_ROLES) -> DataFrame:
    counts = valid.groupBy(KEY).agg(*[
        F.count_if(F.col("suggested_role") == r).alias(r) for r in K.SELECTION_ROLES
    ])
    missing = F.array_join(F.filter(F.array(*[F.when(F.col(r) == 0, r) for r in sorted(required)]), lambda x: x.isNotNull()), ", ")
    return counts.select(KEY, *K.SELECTION_ROLES, missing.alias("missing_roles"))


# --- scope ------------------------------------------------------------------------
def normalize_scope(rules: DataFrame, catalog: DataFrame) -> DataFrame:
    """Exploded scope rules (industry_id, rule_pos, value_pos, column, value, reason): known values, first rule wins."""
    rows = rules.select(
        KEY, "rule_pos", "value_pos", X.strip("column").alias("column"), X.strip("value").alias("value"), X.strip("reason").alias("reason")
    ).join(catalog.select("column", "value"), ["column", "value"], "left_semi")
    return first_by(rows, [KEY, "column", "value"], ["rule_pos", "value_pos"])


def _node_labels(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.coalesce("level", F.lit(0)) != 0).select(
        KEY, "id", "name", "level", X.match_label(F.col("name")).alias("label")
    ).filter(F.col("label") != "")


def complete_scope(rules: DataFrame, nodes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add leaf taxonomy values that equal a node label and that no rule has yet, as one rule after the last of the industry."""
    labels = _node_labels(nodes).select(KEY, "label").distinct()
    values = catalog.filter(F.col("column") == "indunamesw").select("value", X.match_label(F.col("value")).alias("label"))
    present = rules.filter(F.col("column") == "indunamesw").select(KEY, "value").distinct()
    added = labels.join(values, "label").select(KEY, "value").join(present, [KEY, "value"], "left_anti")
    after = rules.groupBy(KEY).agg((F.max("rule_pos") + 1).alias("_after"))
    return rules.unionByName(
        added.join(after, KEY, "left").select(
            KEY, F.coalesce("_after", F.lit(0)).cast(rules.schema["rule_pos"].dataType).alias("rule_pos"),
            F.lit(0).cast(rules.schema["value_pos"].dataType).alias("value_pos"), F.lit("indunamesw").alias("column"), "value",
            F.lit(K.REASON_SCOPE_COMPLETION).alias("reason"),
        )
    )


def select_by_scope(companies: DataFrame, rules: DataFrame) -> DataFrame:
    """(industry_id, company_id): companies with any taxonomy value named by a rule."""
    wanted = rules.select(KEY, "column", "value").distinct()
    return taxonomy_values(companies).join(wanted, ["column", "value"]).select(KEY, "company_id").distinct()


def scope_report(companies: DataFrame, rules: DataFrame, selected: DataFrame) -> DataFrame:
    """Per industry: rules, values, all companies, listed (eligible) and selected companies."""
    total = companies.agg(F.count(F.lit(1))).scalar()
    eligible = companies.agg(F.count_if(F.col("is_listed"))).scalar()
    text = rules.groupBy(KEY).agg(
        F.countDistinct("rule_pos").alias("rule_count"), F.count(F.lit(1)).alias("value_count")
    )
    chosen = selected.groupBy(KEY).agg(F.count(F.lit(1)).alias("selected_company_count"))
    return text.join(chosen, KEY, "left").select(
        KEY, "rule_count", "value_count", total.alias("total_company_count"), eligible.alias("eligible_company_count"),
        F.coalesce("selected_company_count", F.lit(0)).alias("selected_company_count"),
    )


# --- matching ----------------------------------------------------------------------
def taxonomy_matches(nodes: DataFrame, companies: DataFrame, selected: DataFrame) -> DataFrame:
    """Exact label matches of selected companies; per column only the deepest nodes of a label.

    Several columns hitting one node: the last column wins.
    """
    labels = _node_labels(nodes)
    deepest = labels.groupBy(KEY, "label").agg(F.max("level").alias("level"))
    targets = labels.join(deepest, [KEY, "label", "level"], "left_semi").select(KEY, F.col("id").alias("node_id"), F.col("name").alias("node_name"), "label")
    # the few companies have many pairs: those are spread by company and graph before they meet values and nodes
    values = taxonomy_values(companies).withColumn("label", X.match_label(F.col("value")))
    chosen = lookup(gathered(selected, KEY, "company_id"), values, ["company_id"], "inner")
    hits = chosen.join(targets, [KEY, "label"]).select(
        KEY, "company_id", "node_id", "col_no",
        F.format_string(K.REASON_TAXONOMY_MATCH, "value", "node_name").alias("reason"), F.lit(0.9).alias("confidence"),
        F.lit("deterministic_taxonomy_exact").alias("match_method"), F.col("column").alias("taxonomy_column"),
        F.col("value").alias("taxonomy_value"),
    )
    return last_by(hits, ["company_id", "node_id", KEY], ["col_no"]).drop("col_no")


def build_attachments(matches: DataFrame, selected: DataFrame, nodes: DataFrame, closure_above: DataFrame) -> DataFrame:
    """Attachment set: valid non-root targets, last match per pair, deepest node on every ancestor line."""
    targets = nodes.filter(F.coalesce("level", F.lit(0)) != 0).select(KEY, F.col("id").alias("node_id"))
    rows = (
        matches.withColumn("node_id", X.strip("node_id"))
        .join(selected.select(KEY, "company_id").distinct(), [KEY, "company_id"], "left_semi")
        .join(targets.distinct(), [KEY, "node_id"], "left_semi")
        .select(
            KEY, "pos", "company_id", "node_id", X.strip(F.coalesce("reason", F.lit(""))).alias("reason"),
            X.clamp_confidence(F.col("confidence")).alias("confidence"),
            X.or_default(F.col("match_method"), F.lit("agent_web_search")).alias("match_method"),
            X.blank_to_null(F.col("taxonomy_column")).alias("taxonomy_column"),
            X.blank_to_null(F.col("taxonomy_value")).alias("taxonomy_value"),
        )
    )
    # a pair and what lies above it meet in one aggregate: the last row of the pair, unless it lies above another
    # in the task that holds the company; an ancestor matters if a match names it
    key = ["company_id", "node_id", KEY]  # the key that tells most rows apart first: the aggregate sorts by it
    rest = [c for c in rows.columns if c not in key]
    named = matches.select(KEY, X.strip("node_id").alias("node_id")).distinct().join(targets, [KEY, "node_id"], "left_semi").withColumnRenamed("node_id", "ancestor")
    above = stored(closure_above.join(named, [KEY, "ancestor"], "left_semi"))
    marked = with_ancestors(gathered(rows, KEY, "company_id"), above, "node_id", "_higher")
    own = ~F.col("_higher")
    last = marked.groupBy(*key).agg(F.max_by(F.when(own, F.struct(*rest)), F.when(own, F.struct("pos"))).alias("_row"), F.max("_higher").alias("_higher"))
    return last.filter(own).select(*key, *[F.col("_row")[c].alias(c) for c in rest]).select(*rows.columns)


def attachment_summary(attachments: DataFrame, nodes: DataFrame, selected: DataFrame) -> DataFrame:
    level = nodes.select(KEY, F.col("id").alias("node_id"), "level")
    stats = attachments.join(level, [KEY, "node_id"], "left").groupBy(KEY).agg(
        F.count(F.lit(1)).alias("attachment_count"),
        F.countDistinct("company_id").alias("attached_company_count"),
        F.count_if(F.col("match_method") == "deterministic_taxonomy_exact").alias("exact_count"),
        F.count_if(F.col("match_method") == "agent_web_search").alias("web_search_count"),
        F.count_if(F.col("level") == 1).alias("direct_l1_attachment_count"),
    )
    chosen = selected.groupBy(KEY).agg(F.countDistinct("company_id").alias("_selected"))
    return stats.join(chosen, KEY, "left").select(
        *stats.columns,
        F.greatest(F.lit(0), F.coalesce("_selected", F.lit(0)) - F.col("attached_company_count")).cast("bigint").alias("unmatched_company_count"),
    )


def method_counts(attachments: DataFrame) -> DataFrame:
    return attachments.groupBy(KEY, F.coalesce("match_method", F.lit("unknown")).alias("match_method")).agg(F.count(F.lit(1)).alias("n"))


def direct_level_one(attachments: DataFrame, nodes: DataFrame) -> DataFrame:
    level = nodes.filter(F.col("level") == 1).select(KEY, F.col("id").alias("node_id"), F.col("name").alias("node_name"))
    return attachments.join(level, [KEY, "node_id"]).select(KEY, "company_id", "node_id", "node_name", "reason")


# --- listed filter -----------------------------------------------------------------
def listed_companies(companies: DataFrame, include_abroad: bool = False) -> DataFrame:
    keep = F.col("is_listed") == True  # noqa: E712
    if include_abroad:
        keep = keep | (F.col("is_abroad_listed") == True)  # noqa: E712
    return companies.filter(keep)


def payload_companies(attachments: DataFrame, companies: DataFrame) -> DataFrame:
    """Companies per industry as an attachment payload carries them."""
    return attachments.select(KEY, "company_id").distinct().join(companies, "company_id")


def filter_listed(attachments: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attachments of domestic listed companies, and those companies per industry.

    ``companies`` is per industry (:func:`payload_companies`).
    """
    listed = companies.filter(F.col("is_listed") == True)  # noqa: E712
    kept = attachments.join(listed.select(KEY, "company_id"), [KEY, "company_id"], "left_semi").select(*attachments.columns)
    retained = listed.join(kept.select(KEY, "company_id").distinct(), [KEY, "company_id"], "left_semi").select(*companies.columns)
    return kept, retained


def listed_filter_stats(attachments: DataFrame, companies: DataFrame) -> DataFrame:
    # attachments are counted by company once; everything else is read off these counts
    pairs = attachments.groupBy(KEY, "company_id").agg(F.count(F.lit(1)).alias("_n"))
    kept, retained = filter_listed(pairs, companies)
    c, listed = F.col, F.coalesce("is_listed", F.lit(False))
    before = companies.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("company_count_before"),
        F.count_if(~listed & F.coalesce("is_abroad_listed", F.lit(False))).alias("listed_abroad_only_count"),
        F.count_if(c("is_listed") == False).alias("removed_false"),  # noqa: E712
        F.count_if(c("is_listed").isNull()).alias("removed_null"),
    )
    after = retained.groupBy(KEY).agg(F.count(F.lit(1)).alias("company_count_after"))
    a_before = pairs.groupBy(KEY).agg(F.sum("_n").alias("attachment_count_before"))
    a_after = kept.groupBy(KEY).agg(F.sum("_n").alias("attachment_count_after"))
    n = lambda x: F.coalesce(x, F.lit(0))
    joined = before.join(after, KEY, "left").join(a_before, KEY, "left").join(a_after, KEY, "left")
    return joined.select(
        KEY, "company_count_before", n("company_count_after").alias("company_count_after"),
        (c("company_count_before") - n("company_count_after")).alias("company_removed"),
        n("attachment_count_before").alias("attachment_count_before"), n("attachment_count_after").alias("attachment_count_after"),
        (n("attachment_count_before") - n("attachment_count_after")).alias("attachment_removed"),
        n("company_count_after").alias("listed_domestic_count"), "listed_abroad_only_count", "removed_false", "removed_null",
    )


# --- coverage curation ---------------------------------------------------------------
def _contraction_tree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with their roll-up parent (if it exists) and depth; ``bound`` marks members of a cycle, which never become leaves."""
    parents = aggregation_parents(nodes, edges).join(nodes.select(KEY, F.col("id").alias("parent_id")).distinct(), [KEY, "parent_id"], "left_semi")
    depth = ancestor_paths(parents.select(KEY, "id", "parent_id")).select(KEY, "id", F.size("path").alias("depth"))
    rows = nodes.select(KEY, "id", "name", "level").join(parents, [KEY, "id"], "left").join(depth, [KEY, "id"], "left")
    above = depth.select(KEY, F.col("id").alias("parent_id"), F.col("depth").alias("_above"))
    return stored(rows.join(above, [KEY, "parent_id"], "left").select(
        KEY, "id", "name", "level", "parent_id", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce(F.col("_above") >= F.col("depth"), F.lit(False)).alias("bound")
    ))


def collapse_low_coverage(
    nodes: DataFrame, edges: DataFrame, attachments: DataFrame, companies: DataFrame, threshold: int = K.LOW_COVERAGE_THRESHOLD
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Fold thin leaves into their parents until none is left: (nodes, edges, attachments, removals).

    A non-root leaf with at most ``threshold`` distinct direct companies is removed, its pairs go to its parent, and the parent may then be such a leaf. Whether
    a node goes depends on what lies below it only, so the tree is contracted level by level, deepest first: pairs are stored by level once, and those that
    are moved up are written once for each move; what stays is not touched again. ``round`` counts from the removal of the node's lowest descendants. Pairs that
    meet on a node become one row (see :func:`merge_moved`), those of children that were removed earlier first.
    """
    extra = attachments
    for column in ("aggregation_source_node_id", "aggregation_reason"):
        if column not in extra.columns:
            extra = extra.withColumn(column, F.lit(None).cast("string"))
    tree = _contraction_tree(nodes, edges)
    known = companies.select("company_id").distinct()
    depths = tree.select(KEY, F.col("id").alias("node_id"), "depth").distinct()
    path = join_path(work_dir(nodes.sparkSession), f"pairs-{uuid.uuid4().hex}")
    extra.join(depths, [KEY, "node_id"], "left").write.partitionBy("depth").parquet(path)
    placed = nodes.sparkSession.read.schema(T.StructType([*extra.schema.fields, T.StructField("depth", T.IntegerType())])).parquet(path)
    merged, gone = Slices(nodes.sparkSession, "merged-pairs"), Slices(nodes.sparkSession, "removals")
    merged.add(extra.limit(0))
    moved = held_up = last = None
    for depth in range(int(tree.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("d")).first()["d"]), -1, -1):
        here, level = placed.filter(F.col("depth") == depth).select(*extra.columns), tree.filter(F.col("depth") == depth)
        if moved is not None:
            receiving = last.select(KEY, F.col("parent_id").alias("node_id"), F.lit(True).alias("_receives")).distinct()
            own_rows = here.join(receiving, [KEY, "node_id"], "left")
            mixed = own_rows.filter("_receives").drop("_receives").withColumn("_moved", F.lit(0)).unionByName(moved)
            here = own_rows.filter("_receives IS NULL").drop("_receives").unionByName(merged.add(merge_moved(mixed).select(*extra.columns)))
        counts = (
            here.join(known, "company_id", "left_semi").select(KEY, F.col("node_id").alias("id"), "company_id").distinct()
            .groupBy(KEY, "id").agg(F.count(F.lit(1)).alias("direct_company_count"))
        )
        leaves = level.filter((F.col("level") > 0) & F.col("parent_id").isNotNull() & ~F.col("bound"))
        if held_up is not None:
            leaves = leaves.join(held_up, [KEY, "id"], "left_anti")
        below = last.groupBy(KEY, F.col("parent_id").alias("id")).agg(F.max("round").alias("_below")) if last is not None else None
        leaves = leaves.join(below, [KEY, "id"], "left") if below is not None else leaves.withColumn("_below", F.lit(0))
        last = gone.add(
            leaves.join(counts, [KEY, "id"], "left").withColumn("direct_company_count", F.coalesce("direct_company_count", F.lit(0)).cast("bigint"))
            .filter(F.col("direct_company_count") <= threshold)
            .select(KEY, "id", "name", "level", "parent_id", "direct_company_count", (F.coalesce("_below", F.lit(0)) + 1).alias("round"))
        )
        held_up = level.join(last, [KEY, "id"], "left_anti").select(KEY, F.col("parent_id").alias("id")).filter("id IS NOT NULL").distinct()
        step = last.select(KEY, F.col("id").alias("node_id"), F.col("parent_id").alias("_to"), F.col("round").alias("_moved"))
        moved = here.join(step, [KEY, "node_id"]).select(
            *[c for c in extra.columns if c not in ("node_id", "aggregation_source_node_id", "aggregation_reason")],
            F.col("node_id").alias("aggregation_source_node_id"), F.lit(K.REASON_COLLAPSE % threshold).alias("aggregation_reason"), F.col("_to").alias("node_id"), "_moved",
        )
    removed = gone.rows()
    if removed.isEmpty():
        return nodes, edges, extra, removed
    untouched = placed.select(*extra.columns).join(removed.select(KEY, F.col("parent_id").alias("node_id")).distinct(), [KEY, "node_id"], "left_anti")
    pairs = untouched.unionByName(merged.rows()).join(removed.select(KEY, F.col("id").alias("node_id")), [KEY, "node_id"], "left_anti")
    # a graph that lost a node has each pair once: the last of repeated rows on nodes that nothing was moved to
    touched = removed.select(KEY).distinct()
    pairs = last_by(pairs.join(touched, KEY, "left_semi"), [KEY, "company_id", "node_id"], ["pos"]).unionByName(pairs.join(touched, KEY, "left_anti"))
    kept, left = drop_nodes(nodes, edges, removed)
    return kept.select(*nodes.columns), left.select(*edges.columns), pairs.select(*extra.columns), removed


def merge_moved(moved: DataFrame) -> DataFrame:
    """One row per (company, node): an unmoved row (``_moved`` 0) wins, the last of several; else the first of those with the smallest ``_moved``.

    The row keeps the first position of its group. One aggregate with map-side combine.
    """
    key = [KEY, "company_id", "node_id"]
    rest = [c for c in moved.columns if c not in (*key, "pos", "_moved")]
    order = F.struct("_moved", F.when(F.col("_moved") == 0, -F.col("pos")).otherwise(F.col("pos")))
    best = moved.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_row"), F.min("pos").alias("pos"))
    return best.select(*key, "pos", *[F.col("_row")[c].alias(c) for c in rest])


def prune_to_coverage(
    nodes: DataFrame, edges: DataFrame, attachments: DataFrame, companies: DataFrame, closure_above: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Keep directly attached nodes, their roll-up ancestors and roots: (nodes, edges, attachments, removed)."""
    known = companies.select("company_id").distinct()
    valid = attachments.join(known, "company_id", "left_semi").join(
        nodes.select(KEY, F.col("id").alias("node_id")), [KEY, "node_id"], "left_semi"
    )
    direct = valid.select(KEY, F.col("node_id").alias("id")).distinct()
    above = closure_above.join(direct, [KEY, "id"], "left_semi").select(KEY, F.col("ancestor").alias("id"))
    roots = nodes.filter(X.is_root(F.col("level"), F.col("chain_position"))).select(KEY, "id")
    keep = direct.unionByName(above).unionByName(roots).distinct()
    kept = nodes.join(keep, [KEY, "id"], "left_semi").select(*nodes.columns)
    removed = nodes.join(keep, [KEY, "id"], "left_anti").select(KEY, "id", "name", "level")
    left = edges.join(keep.withColumnRenamed("id", "source"), [KEY, "source"], "left_semi").join(
        keep.withColumnRenamed("id", "target"), [KEY, "target"], "left_semi"
    ).select(*edges.columns)
    return kept, left, valid.select(*attachments.columns), removed


def uncovered_industries(nodes: DataFrame, attachments: DataFrame) -> DataFrame:
    """Graphs that no attachment reaches; pruning them is an error for the caller."""
    hit = attachments.join(nodes.select(KEY, F.col("id").alias("node_id")), [KEY, "node_id"], "left_semi").select(KEY).distinct()
    return nodes.select(KEY).distinct().join(hit, KEY, "left_anti")


def collapse_attached_singletons(
    nodes: DataFrame, edges: DataFrame, attachments: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Singleton-leaf removal that first moves the leaf's companies to its parent."""
    report = singleton_leaves(nodes, edges)
    moves = report.select(KEY, F.col("child_id").alias("node_id"), F.col("parent_id").alias("_to"))
    moved = attachments.join(moves, [KEY, "node_id"], "left").select(
        *[c for c in attachments.columns if c != "node_id"], F.coalesce("_to", "node_id").alias("node_id"),
        F.col("_to").isNotNull().cast("int").alias("_moved"),
    )
    kept, left = drop_nodes(nodes, edges, report.select(KEY, F.col("child_id").alias("id")))
    return kept.select(*nodes.columns), left.select(*edges.columns), merge_moved(moved).select(*attachments.columns), report


def _fates(rows: DataFrame, nodes: DataFrame, legacy_paths: DataFrame) -> DataFrame:
    """Rows with ``outcome`` of their node_id, kept, remapped or dropped, and ``_to``, the nearest surviving ancestor in the legacy tree."""
    alive = nodes.select(KEY, F.col("id").alias("ancestor")).distinct()
    chain = legacy_paths.select(KEY, "id", F.posexplode("path").alias("_i", "ancestor"))
    nearest = chain.join(alive, [KEY, "ancestor"], "left_semi").groupBy(KEY, F.col("id").alias("node_id")).agg(
        F.min_by("ancestor", "_i").alias("_to")
    )
    own = alive.select(KEY, F.col("ancestor").alias("node_id"), F.lit(True).alias("_alive"))
    joined = rows.join(own, [KEY, "node_id"], "left").join(nearest, [KEY, "node_id"], "left")
    outcome = F.when(F.col("_alive"), "kept").when(F.col("_to").isNotNull(), "remapped").otherwise("dropped")
    return joined.withColumn("outcome", outcome).drop("_alive")


def _moved(fates: DataFrame, columns: list[str]) -> DataFrame:
    note = F.format_string(K.REASON_REMAP, X.strip(F.coalesce("reason", F.lit(""))), F.col("node_id"))
    return fates.select(
        *[c for c in columns if c not in ("node_id", "reason")],
        F.when(F.col("outcome") == "kept", F.col("node_id")).otherwise(F.col("_to")).alias("node_id"),
        F.when(F.col("outcome") == "remapped", note).otherwise(F.col("reason")).alias("reason"), "outcome",
    )


def remap_to_survivors(attachments: DataFrame, nodes: DataFrame, legacy_paths: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Move attachments of vanished nodes to the nearest surviving ancestor of the legacy tree.

    Adds ``outcome``: kept, remapped or dropped (dropped rows have no node). With ``members`` the rows are those of :func:`old_attachments`; the fate is then
    found once for an old node, before rows are multiplied, so that the multiplied rows are neither moved nor sorted. Further columns of ``members`` are kept.
    """
    if members is None:
        return _moved(_fates(attachments, nodes, legacy_paths), attachments.columns)
    fates = _fates(members.withColumnRenamed("node_id", "_group").withColumnRenamed("old_id", "node_id"), nodes, legacy_paths)
    fated = fates.withColumnRenamed("node_id", "old_id").withColumnRenamed("_group", "node_id")
    more = [x for x in members.columns if x not in (KEY, "node_id", "old_id")]
    return _moved(old_attachments(attachments, fated, "outcome", "_to", *more), [*attachments.columns, *more])


def old_attachments(attachments: DataFrame, members: DataFrame, *more: str) -> DataFrame:
    """Attachments at the old nodes of their node: a row for each of ``members`` (industry_id, node_id, old_id), with ``more`` columns of these."""
    return attachments.join(members, [KEY, "node_id"]).withColumn("node_id", F.col("old_id")).select(*attachments.columns, *more)


def remap_groups(attachments: DataFrame, members: DataFrame, nodes: DataFrame, legacy_paths: DataFrame) -> DataFrame:
    """:func:`remap_to_survivors` of :func:`old_attachments`, factored: the fate is found once for an old node, and the rows of an attachment that go
    to one node are one row with their number (``copies``); its reason names the first of the old nodes.
    """
    fates = _fates(members.select(KEY, F.col("node_id").alias("_group"), F.col("old_id").alias("node_id")), nodes, legacy_paths)
    ends = F.when(F.col("outcome") == "kept", F.col("node_id")).otherwise(F.col("_to")).alias("_to")
    groups = fates.groupBy(KEY, F.col("_group").alias("node_id"), "outcome", ends).agg(F.min("node_id").alias("_first"), F.count(F.lit(1)).alias("copies"))
    rows = attachments.join(groups, [KEY, "node_id"]).withColumn("node_id", F.col("_first"))
    return _moved(rows, [*attachments.columns, "copies"])


def missing_exact_matches(matches: DataFrame, attachments: DataFrame, closure_all: DataFrame) -> DataFrame:
    """Exact matches whose company sits neither on the node nor below it."""
    covered = (
        attachments.select(KEY, "company_id", F.col("node_id").alias("id")).distinct()
        .join(closure_all, [KEY, "id"]).select(KEY, "company_id", F.col("ancestor").alias("node_id")).distinct()
    )
    return matches.select(KEY, "company_id", "node_id").join(covered, [KEY, "company_id", "node_id"], "left_anti")
