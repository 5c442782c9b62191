"""Merging graphs, evidence and opinions; update proposals, repairs and tree surgery."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkstrata import constants as K
from linkstrata.functions import text as X
from linkstrata.functions.tables import checkpointed, first_by, last_by, lookup, numbered, running, top_rows
from linkstrata.operators.hierarchy import closure, subtree, tree_listing
from linkstrata.operators.standardize import drop_nodes

KEY = "industry_id"


def _sorted_values(rows: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """Sorted distinct array per key; values are made distinct before they are collected."""
    values = rows.select(*key, F.explode(column).alias("v")).distinct()
    return values.groupBy(*key).agg(F.array_sort(F.collect_list("v")).alias(column))


# --- staged branch graphs -----------------------------------------------------------
def _merge_copies(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """First copy wins; urls and evidence become sorted unions when there is more than one copy;
    confidence is the maximum."""
    first = first_by(rows, key, ["graph_no", "pos"])
    stats = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_copies"), F.max("confidence").alias("_max"))
    out = first.join(stats, list(key))
    many = F.col("_copies") > 1
    for column in ("source_urls", "evidence_ids"):
        merged = _sorted_values(rows, key, column).withColumnRenamed(column, "_merged")
        out = out.join(merged, list(key), "left").withColumn(
            column, F.when(many, F.coalesce("_merged", F.array().cast("array<string>"))).otherwise(F.col(column))
        ).drop("_merged")
    return out.withColumn("confidence", F.col("_max")).drop("_max", "_copies")


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """Union of staged graphs' nodes by id; ``graph_no`` 0 is the seed. Order: (graph_no, pos)."""
    return _merge_copies(nodes.filter(F.coalesce("id", F.lit("")) != ""), [KEY, "id"])


def merge_edges(edges: DataFrame) -> DataFrame:
    ok = (F.coalesce("source", F.lit("")) != "") & (F.coalesce("target", F.lit("")) != "") & (F.coalesce("relation_type", F.lit("")) != "")
    return _merge_copies(edges.filter(ok), [KEY, "source", "relation_type", "target"])


def node_conflicts(nodes: DataFrame) -> DataFrame:
    """Ids whose copies disagree on name, level or parent."""
    ident = F.struct("name", "level", "parent_id")
    return nodes.groupBy(KEY, "id").agg(
        F.min(ident).alias("lo"), F.max(ident).alias("hi"), F.count(F.lit(1)).alias("copies")
    ).filter(F.col("lo") != F.col("hi")).select(KEY, "id", F.col("lo.name").alias("name"), F.col("hi.name").alias("other_name"), "copies")


def merge_source_basis(basis: DataFrame) -> DataFrame:
    """First entry per url (name when there is no url) in (graph_no, pos) order."""
    key = X.or_default(X.strip(F.coalesce("url", F.lit(""))), X.strip(F.coalesce("name", F.lit(""))))
    rows = basis.withColumn("basis_key", key).filter(F.col("basis_key") != "")
    return first_by(rows, [KEY, "basis_key"], ["graph_no", "pos"])


def namespace_branches(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Give level >= 2 nodes of each branch the ids ``<branch>_001…`` in input order.

    Tables carry ``branch_id``. Returns (nodes, edges without ids, errors): blank or repeated old ids
    are errors and such branches should not be used.
    """
    key = [KEY, "branch_id"]
    trimmed = nodes.withColumn("id", X.strip("id")).withColumn("parent_id", X.strip(F.coalesce("parent_id", F.lit(""))))
    children = trimmed.filter(F.col("level") >= 2)
    counts = children.groupBy(*key, "id").agg(F.count(F.lit(1)).alias("n"))
    errors = counts.filter((F.col("id") == "") | (F.col("n") > 1)).select(*key, F.col("id").alias("old_id"), "n")
    ranked = numbered(children.select(*key, "id", "pos"), key, ["pos", "id"], "rn")
    number = F.col("rn").cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    mapping = ranked.select(*key, F.col("id").alias("_old"), F.concat("branch_id", F.lit("_"), padded).alias("_new"))

    def remap(df: DataFrame, column: str) -> DataFrame:
        m = mapping.select(*key, F.col("_old").alias(column), F.col("_new"))
        return df.join(m, [*key, column], "left").withColumn(column, F.coalesce("_new", column)).drop("_new")

    out = remap(remap(trimmed, "id"), "parent_id")
    links = edges.withColumn("source", X.strip("source")).withColumn("target", X.strip("target"))
    links = remap(remap(links, "source"), "target")
    return out.select(*nodes.columns), links.drop("id"), errors


def branch_membership(nodes: DataFrame, paths: DataFrame, min_new: int = K.MIN_BRANCH_NEW_NODES) -> DataFrame:
    """Errors per branch: fewer than ``min_new`` nodes below L1, or a node that does not reach its L1.

    ``nodes`` has ``branch_id``; ``paths`` are its raw-parent ancestor paths.
    """
    below = nodes.filter(F.col("level") >= 2)
    reached = closure(paths).select(KEY, "id", F.col("ancestor").alias("branch_id")).withColumn("_ok", F.lit(True))
    outside = below.join(reached, [KEY, "id", "branch_id"], "left").filter(F.col("_ok").isNull())
    counts = nodes.groupBy(KEY, "branch_id").agg(F.count_if(F.col("level") >= 2).alias("n"))
    small = counts.filter(F.col("n") < min_new).select(KEY, "branch_id", F.lit("too_few_nodes").alias("error"), F.col("n").cast("string").alias("item_id"))
    return small.unionByName(outside.select(KEY, "branch_id", F.lit("node_outside_branch").alias("error"), F.col("id").alias("item_id")))


def position_coverage(level_one: DataFrame) -> DataFrame:
    """L1 count per position and the missing required positions; works on graphs and blueprints."""
    position = F.lower(X.strip(F.coalesce("chain_position", F.lit(""))))
    counts = level_one.groupBy(KEY).agg(*[F.count_if(position == p).alias(p) for p in K.COVERED_POSITIONS])
    missing = F.filter(F.array(*[F.when(F.col(p) == 0, p) for p in K.REQUIRED_SKELETON_POSITIONS]), lambda x: x.isNotNull())
    return counts.withColumn("missing_positions", F.array_join(missing, ", "))


def failed_branches(records: DataFrame, level_one: DataFrame) -> DataFrame:
    """Work list of branches whose status is not ok or that have no graph; unknown branches are errors."""
    failed = records.filter((F.coalesce("status", F.lit("")) != "ok") | ~F.coalesce("has_graph", F.lit(False)))
    known = level_one.filter(F.col("level") == 1).select(KEY, F.col("id").alias("branch_id"), F.lit(True).alias("_known"))
    return failed.join(known, [KEY, "branch_id"], "left").select(
        *records.columns, F.when(F.col("_known"), "retry").otherwise("unknown_branch").alias("action")
    )


def branch_assembly(records: DataFrame, skeleton_passed: DataFrame, level_one: DataFrame) -> DataFrame:
    """Per graph: branches, failures, lost branches, and whether a candidate may be built (skeleton passed, none failed or lost).

    A lost branch has a record, but no longer an L1 node in the skeleton; whatever its record says, it cannot be assembled.
    """
    known = level_one.filter(F.col("level") == 1).select(KEY, F.col("id").alias("branch_id"), F.lit(True).alias("_known")).distinct()
    lost = F.col("_known").isNull()
    bad = (F.coalesce("status", F.lit("")) != "ok") | ~F.coalesce("has_graph", F.lit(False)) | lost
    stats = records.join(known, [KEY, "branch_id"], "left").groupBy(KEY).agg(
        F.count(F.lit(1)).alias("branch_count"), F.count_if(bad).alias("failed_count"), F.count_if(lost).alias("lost_count")
    )
    return skeleton_passed.join(stats, KEY, "left").select(
        KEY, "skeleton_passed", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("branch_count", "failed_count", "lost_count")],
        (F.col("skeleton_passed") & (F.coalesce("failed_count", F.lit(0)) == 0)).alias("candidate_allowed"),
    )


# --- evidence -----------------------------------------------------------------------
def evidence_table(basis: DataFrame, nodes: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    """Distinct urls in first-seen order (source basis, nodes, edges) with sequential ids.

    The last source-basis entry of a url gives title and snippet; else the first item's description.
    """
    from_basis = basis.filter(F.coalesce("url", F.lit("")) != "").select(
        KEY, "url", F.lit(0).alias("kind"), "pos", F.lit("").alias("item"), F.lit(0).alias("upos"),
        F.coalesce("name", F.lit("")).alias("title"), F.coalesce("note", F.lit("")).alias("snippet"),
    )

    def items(df: DataFrame, kind: int) -> DataFrame:
        return df.select(KEY, F.lit(kind).alias("kind"), "pos", F.col("id").alias("item"), F.coalesce("description", F.lit("")).alias("snippet"),
                         F.posexplode("source_urls").alias("upos", "url")).select(
            KEY, "url", "kind", "pos", "item", "upos", F.lit("").alias("title"), "snippet")

    rows = from_basis.unionByName(items(nodes, 1)).unionByName(items(edges, 2))
    order = F.struct("kind", "pos", "item", "upos")
    # within the source basis the last row of a url gives the texts, elsewhere the first
    pick = F.struct("kind", F.when(F.col("kind") == 0, -F.col("pos")).otherwise(F.col("pos")).alias("p"), "item", "upos")
    seen = rows.groupBy(KEY, "url").agg(F.min(order).alias("_first"), F.min_by(F.struct("title", "snippet"), pick).alias("_t"))
    flat = seen.select(
        KEY, "url", F.col("_first.kind").alias("kind"), F.col("_first.pos").alias("pos"), F.col("_first.item").alias("item"),
        F.col("_first.upos").alias("upos"), F.col("_t.title").alias("title"), F.col("_t.snippet").alias("snippet"),
    )
    ranked = numbered(flat, [KEY], ["kind", "pos", "item", "upos", "url"], "rn")
    number = F.col("rn").cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return ranked.select(
        KEY, F.concat(KEY, F.lit("_ev_"), padded).alias("evidence_id"), "url", "title", F.lit("").alias("published_at"),
        F.lit(as_of).alias("retrieved_at"), F.lit("web_search_result").alias("content_type"),
        F.sha2(F.concat("url", "snippet"), 256).alias("content_hash"), "snippet", F.lit("ok").alias("status"),
    )


_EVIDENCE_LISTS = (("source_urls", "url", "own_urls", "url_count"), ("evidence_ids", "evidence_id", "own_ids", "id_count"))


def _shared(evidence: DataFrame) -> DataFrame:
    """(industry_id, kind, value): what every item of a graph takes over. A graph without any url in its evidence takes over nothing."""
    rows = evidence.select(KEY, F.coalesce("url", F.lit("")).alias("url"), F.coalesce("evidence_id", F.lit("")).alias("evidence_id"))
    active = rows.filter("url <> ''").select(KEY).distinct()
    each = rows.join(active, KEY, "left_semi").select(KEY, F.explode(F.map_from_arrays(F.array(F.lit("url"), F.lit("evidence_id")), F.array("url", "evidence_id"))).alias("kind", "value"))
    return each.filter("value <> ''").distinct()


def item_evidence(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """Factored form of "every item carries every evidence url and id of its graph", for nodes or edges.

    An item keeps only what it has beyond the shared part (``own_urls``, ``own_ids``: sorted) and the sizes of the full unions (``url_count``,
    ``id_count``); the shared part is the evidence table itself, so nothing is copied to every item. :func:`expand_evidence` gives the full lists of chosen items.
    """
    shared = checkpointed(_shared(evidence))
    out = items.select(KEY, "id", *[name for name, *_ in _EVIDENCE_LISTS])
    for column, kind, own_name, count_name in _EVIDENCE_LISTS:
        values = shared.filter(F.col("kind") == kind).select(KEY, F.col("value").alias("v"))
        size = values.groupBy(KEY).agg(F.count(F.lit(1)).alias("_shared"))
        own = items.select(KEY, "id", F.explode(column).alias("v")).distinct().join(values, [KEY, "v"], "left_anti")
        extra = own.groupBy(KEY, "id").agg(F.array_sort(F.collect_list("v")).alias(own_name))  # an item's own list
        out = lookup(out, size, [KEY]).join(extra, [KEY, "id"], "left").withColumn(own_name, F.coalesce(own_name, F.array().cast("array<string>"))).withColumn(
            count_name, (F.coalesce("_shared", F.lit(0)) + F.size(own_name)).cast("bigint")
        ).drop("_shared")
    return out.select(KEY, "id", *[c for _, _, *pair in _EVIDENCE_LISTS for c in pair])


def expand_evidence(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """(industry_id, id, kind, value) of the given items, with all that they share: as many rows as items times evidence, so ask for few items."""
    shared = _shared(evidence)
    parts = [items.select(KEY, "id", F.lit(kind).alias("kind"), F.explode(column).alias("value")) for column, kind, *_ in _EVIDENCE_LISTS]
    given = items.select(KEY, "id").join(shared, KEY).select(KEY, "id", "kind", "value")
    return parts[0].unionByName(parts[1]).unionByName(given).distinct()


def item_evidence_urls(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """The urls of :func:`item_evidence` alone; ``evidence`` needs no ids."""
    rows = evidence if "evidence_id" in evidence.columns else evidence.withColumn("evidence_id", F.lit(""))
    have = items if "evidence_ids" in items.columns else items.withColumn("evidence_ids", F.array().cast("array<string>"))
    return item_evidence(have, rows).select(KEY, "id", "own_urls", "url_count")


def duplicate_name_report(nodes: DataFrame) -> DataFrame:
    """(keep, drop) per repeated normalized name; the first node of a name is kept."""
    named = nodes.select(KEY, "pos", "id", "name", X.normalized_name(F.col("name")).alias("norm"))
    first = named.groupBy(KEY, "norm").agg(F.min_by(F.struct("pos", "id"), F.struct("pos", "id")).alias("_k"))
    return named.join(first, [KEY, "norm"]).filter((F.col("_k.pos") != F.col("pos")) | (F.col("_k.id") != F.col("id"))).select(
        KEY, F.col("_k.id").alias("keep"), F.col("id").alias("drop"), "name"
    )


def relation_conflicts(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First relation type per (source, target) wins: (kept edges with ids, conflict report)."""
    first = edges.groupBy(KEY, "source", "target").agg(F.min_by("relation_type", F.struct("pos", "id")).alias("_type"))
    joined = edges.join(first, [KEY, "source", "target"])
    c = F.col
    kept = joined.filter(c("relation_type") == c("_type")).withColumn(
        "id", X.or_default(c("id"), X.edge_id(c("source"), c("relation_type"), c("target")))
    ).select(*edges.columns)
    return kept, joined.filter(c("relation_type") != c("_type")).select(KEY, "source", "target", c("_type").alias("kept_type"), c("relation_type").alias("dropped_type"))


def merge_checked_sources(existing: DataFrame, checked: DataFrame) -> DataFrame:
    """Existing sources, then checked ones with a new (content_hash, url); first of several wins."""
    key = [KEY, "content_hash", "url"]
    new = first_by(checked, key, ["pos"])
    joined = new.alias("n").join(
        existing.select(*key).distinct().alias("o"),
        (F.col("n." + KEY) == F.col("o." + KEY)) & F.col("n.content_hash").eqNullSafe(F.col("o.content_hash")) & F.col("n.url").eqNullSafe(F.col("o.url")),
        "left_anti",
    )
    return existing.withColumn("origin", F.lit("existing")).unionByName(joined.withColumn("origin", F.lit("checked")), allowMissingColumns=True)


def recent_sources(sources: DataFrame, n: int = 20) -> DataFrame:
    """Last n sources per graph, oldest of them first."""
    return top_rows(sources, [KEY], [F.desc("pos"), F.col("url")], n)


# --- opinions and review queue --------------------------------------------------------
def quality_opinions(records: DataFrame) -> DataFrame:
    """Flatten evaluation records; ``post_*`` columns hold the re-evaluation when there was one."""
    c = F.col
    revised = F.coalesce("revised", F.lit(False))
    rechecked = revised & c("post_status").isNotNull()
    passed = X.quality_passed(c("post_status"), c("post_score"), c("post_blocking"), c("post_focus"))
    initial = X.or_default(c("status"), F.lit("unknown"))
    revision = (
        F.when(~revised, "not_revised").when(~rechecked, "auto_revised_not_rechecked")
        .when(passed, "rechecked_pass").otherwise("rechecked_needs_review")
    )
    return records.select(
        KEY, "stage", "branch_id", "branch_name", F.when(revised, "auto_revised").otherwise(initial).alias("status"),
        initial.alias("initial_status"), revision.alias("revision_status"), c("score").alias("score"), c("score").alias("initial_score"),
        F.when(rechecked, c("post_score")).alias("final_score"), revised.alias("revised"),
    )


def review_queue(issues: DataFrame, duplicates: DataFrame, conflicts: DataFrame, repairs: DataFrame, opinions: DataFrame) -> DataFrame:
    """One wide table of everything a person must look at."""
    blank = {"severity": None, "code": None, "item_id": None, "detail": None}

    def shape(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
        cols = {**blank, **columns}
        return df.select(KEY, F.lit(kind).alias("type"), *[
            (v if v is not None else F.lit(None)).cast("string").alias(k) for k, v in cols.items()
        ])

    c = F.col
    hard = issues.filter((c("severity") == "error") | c("code").isin(*K.REVIEW_WARNING_CODES))
    weak = opinions.filter((F.coalesce("initial_status", "status") != "pass") | c("revised"))
    return (
        shape(hard, "validation_issue", severity=c("severity"), code=c("code"), item_id=c("item_id"), detail=c("message"))
        .unionByName(shape(duplicates, "duplicate_node_candidate", item_id=c("drop"), detail=c("keep")))
        .unionByName(shape(conflicts, "relation_conflict_candidate", item_id=F.concat("source", F.lit("->"), "target"),
                           detail=F.concat("kept_type", F.lit("|"), "dropped_type")))
        .unionByName(shape(repairs, "format_repair_issue", severity=c("severity"), item_id=c("item_id"), detail=c("reason")))
        .unionByName(shape(weak, "quality_evaluation_opinion", item_id=F.coalesce("branch_id", "stage"), detail=c("revision_status")))
    )


def review_status(queue: DataFrame, industries: DataFrame) -> DataFrame:
    counts = queue.groupBy(KEY).agg(F.count(F.lit(1)).alias("item_count"))
    return industries.select(KEY).join(counts, KEY, "left").select(
        KEY, F.when(F.col("item_count").isNotNull(), "pending_review").otherwise("clean").alias("status"),
        F.coalesce("item_count", F.lit(0)).alias("item_count"),
    )


# --- update proposals -------------------------------------------------------------------
def _patched(df: DataFrame, fields: Sequence[str]) -> list[Column]:
    """Columns of ``df`` with values of the string map ``_patch`` put over the given fields."""
    out = []
    for name in df.columns:
        if name in ("_patch", "_drop"):
            continue
        value = F.col(name)
        if name in fields:
            raw = F.try_element_at("_patch", F.lit(name))
            target = df.schema[name].dataType
            new = F.split(raw, ";") if target.typeName() == "array" else raw.try_cast(target)
            value = F.when(F.coalesce(F.map_contains_key("_patch", F.lit(name)), F.lit(False)), new).otherwise(value)
        out.append(value.alias(name))
    return out


def merge_patches(patches: DataFrame, key: Sequence[str]) -> DataFrame:
    """Several patches of one target: the later value of a field wins. Input: key, pos, patch map."""
    fields = patches.select(*key, "pos", F.explode("patch").alias("field", "value"))
    last = last_by(fields, [*key, "field"], ["pos"])
    return last.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_patch"))


def apply_update(
    nodes: DataFrame, edges: DataFrame, add_nodes: DataFrame, add_edges: DataFrame, node_patches: DataFrame,
    edge_patches: DataFrame, deprecations: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Insert unknown nodes and edges, patch by id, mark deprecated rows. Standardize afterwards.

    Patches are string maps (lists joined by ``;``).
    """
    c = F.col

    def grow(old: DataFrame, new: DataFrame) -> DataFrame:
        fresh = first_by(new.filter(F.coalesce("id", F.lit("")) != ""), [KEY, "id"], ["pos"]).join(old.select(KEY, "id"), [KEY, "id"], "left_anti")
        shift = old.groupBy(KEY).agg(F.max("pos").alias("_max"))
        fresh = lookup(fresh, shift, [KEY]).withColumn("pos", c("pos") + F.coalesce("_max", F.lit(0)) + 1).drop("_max")
        return old.unionByName(fresh, allowMissingColumns=True)

    def patch(df: DataFrame, patches: DataFrame, kind: str) -> DataFrame:
        fields = [x for x in df.columns if x not in (KEY, "pos")]
        marks = deprecations.filter(c("item_type") == kind).select(KEY, "id", F.lit(True).alias("_drop")).distinct()
        joined = df.join(merge_patches(patches, [KEY, "id"]), [KEY, "id"], "left").join(marks, [KEY, "id"], "left")
        return joined.select(*_patched(joined, fields), F.coalesce("_drop", F.lit(False)).alias("deprecated"))

    links = add_edges.withColumn("id", X.or_default(c("id"), X.edge_id(c("source"), c("relation_type"), c("target"))))
    by_key = edge_patches.withColumn(
        "id", X.or_default(c("id"), X.edge_id(F.coalesce("source", F.lit("")), F.coalesce("relation_type", F.lit(K.FLOW)), F.coalesce("target", F.lit(""))))
    ).select(KEY, "id", "pos", "patch")
    return patch(grow(nodes, add_nodes), node_patches, "node"), patch(grow(edges, links), by_key, "edge")


def proposal_counts(proposals: DataFrame) -> DataFrame:
    """Counts per list of a proposal table (industry_id, action, …)."""
    names = ("add_node", "add_edge", "modify_node", "modify_edge", "remove_or_deprecate", "review_item")
    return proposals.groupBy(KEY).agg(*[F.count_if(F.col("action") == n).alias(n + "_count") for n in names])


# --- format repairs ------------------------------------------------------------------------
def ordered_repairs(repairs: DataFrame) -> DataFrame:
    """Repairs with trimmed action (or ``type``, read where it is blank) and target, numbered per industry (``seq`` from 1) in input order."""
    c = F.col
    alias = F.coalesce("type", F.lit("")) if "type" in repairs.columns else F.lit("")
    fix = repairs.withColumn("action", X.strip(X.or_default(c("action"), alias))).withColumn("target_id", X.strip(F.coalesce("target_id", F.lit(""))))
    return numbered(fix, [KEY], ["pos", "action", "target_id"], "seq")


def _patch_map(allowed: Sequence[str]) -> Column:
    return F.map_filter(F.coalesce("changes", F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*allowed))


def _guard(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("reason").isNotNull()).select(
        KEY, F.when(F.col("reason") == "edge_to_delete_not_found", "warning").otherwise("error").alias("severity"), F.col("target_id").alias("item_id"), "reason"
    )


def repair_nodes(nodes: DataFrame, fix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node patches of ordered repairs: (nodes, guardrail rows). No patch changes an id, so a target is found or not whatever the order."""
    c = F.col
    hits = nodes.groupBy(KEY, F.coalesce("id", F.lit("")).alias("target_id")).agg(F.count(F.lit(1)).alias("_nodes"))
    judged = fix.filter(c("action") == "update_node").join(hits, [KEY, "target_id"], "left").withColumn(
        "reason", F.when(F.coalesce("_nodes", F.lit(0)) != 1, "node_target_not_unique")
    )
    good = judged.filter(c("reason").isNull())
    node_fix = merge_patches(good.select(KEY, c("target_id").alias("id"), c("seq").alias("pos"), _patch_map(K.NODE_PATCH_FIELDS).alias("patch")), [KEY, "id"])
    stripped = good.filter(
        F.exists(F.coalesce("remove_fields", F.array().cast("array<string>")), lambda f: f.isin(*K.REMOVABLE_COMPANY_FIELDS))
    ).select(KEY, c("target_id").alias("id"), F.lit(True).alias("_strip")).distinct()
    n = nodes.join(node_fix, [KEY, "id"], "left")
    n = n.select(*_patched(n, K.NODE_PATCH_FIELDS))
    if "has_company_field" in nodes.columns:
        n = n.join(stripped, [KEY, "id"], "left").withColumn(
            "has_company_field", F.when(F.coalesce("_strip", F.lit(False)), False).otherwise(c("has_company_field"))
        ).drop("_strip")
    return n.select(*nodes.columns), _guard(judged)


def _ends(source: str = "source", target: str = "target") -> Column:
    return F.concat(F.coalesce(source, F.lit("")), F.lit("->"), F.coalesce(target, F.lit("")))


def _edge_spans(touched: DataFrame, renames: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """When an edge answers to which name: (spans: industry, name, no, start, stop; deaths: industry, no, death).

    ``touched``: no, id_name, source, target. ``renames``: no, seq, new_source, new_target. ``deletes``: name, seq. An edge answers to its id all its life
    and to ``source->target`` until the next rename. It dies by the first deletion of a name that it answers to at that time. ``stop`` is null for
    what holds to the end.
    """
    c = F.col
    states = touched.select(KEY, "no", F.lit(0).cast("bigint").alias("seq"), c("source").alias("new_source"), c("target").alias("new_target")).unionByName(renames)
    known = lambda x: F.when(c(x).isNotNull(), F.struct("seq", c(x).alias("value")))
    states = running(states, [KEY, "no"], ["seq"], s=("max", known("new_source")), t=("max", known("new_target")))
    states = running(states, [KEY, "no"], [-c("seq")], stop=("min", c("seq")))
    named = states.select(KEY, "no", c("seq").alias("start"), "stop", F.coalesce("new_source", "s.value").alias("source"), F.coalesce("new_target", "t.value").alias("target"))
    ids = touched.select(KEY, "no", "id_name")
    spans = named.select(KEY, "no", "start", "stop", _ends().alias("name")).join(ids, [KEY, "no"]).filter("name <> id_name").drop("id_name").unionByName(
        ids.select(KEY, "no", F.lit(0).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("stop"), c("id_name").alias("name"))
    )
    none = F.lit(None).cast("bigint")
    both = spans.withColumn("deleted", none).unionByName(deletes.select(KEY, none.alias("no"), c("seq").alias("start"), none.alias("stop"), "name", c("seq").alias("deleted")))
    met = running(both, [KEY, "name"], [-c("start"), "no"], next=("min", c("deleted"))).filter("deleted IS NULL AND next < coalesce(stop, next + 1)")
    deaths = checkpointed(met.groupBy(KEY, "no").agg(F.min("next").alias("death")))
    lived = spans.join(deaths, [KEY, "no"], "left").filter("start < coalesce(death, start + 1)")
    return lived.select(KEY, "name", "no", "start", F.least("stop", "death").alias("stop")), deaths


def _edge_hits(spans: DataFrame, asked: DataFrame) -> DataFrame:
    """``seq``, ``hits``, ``no``: the edges that answer to a repair's target at its turn, and the edge if it is the only one.

    Every span adds one to its name's count, and its number to the name's sum, when it starts, and takes both back when it stops. While the count is one, the sum is the
    edge's number. So no repair is paired with the spans of its name.
    """
    c = F.col
    number = c("no").cast("decimal(38,0)")
    blank = F.lit(None).cast("decimal(38,0)")
    events = (
        spans.select(KEY, "name", c("start").alias("seq"), F.lit(1).alias("late"), "no", F.lit(1).alias("one"), number.alias("sum"))
        .unionByName(spans.filter("stop IS NOT NULL").select(KEY, "name", c("stop").alias("seq"), F.lit(1).alias("late"), "no", F.lit(-1).alias("one"), (-number).alias("sum")))
        .unionByName(asked.select(KEY, c("target_id").alias("name"), "seq", F.lit(0).alias("late"), F.lit(None).cast("bigint").alias("no"), F.lit(None).cast("int").alias("one"), blank.alias("sum")))
    )
    found = running(events, [KEY, "name"], ["seq", "late", "no", "one"], hits=("sum", c("one")), whole=("sum", c("sum"))).filter("late = 0")
    hits = F.coalesce("hits", F.lit(0))
    return found.select(KEY, "seq", hits.alias("hits"), F.when(hits == 1, c("whole").cast("bigint")).alias("no"))


def repair_edges(edges: DataFrame, fix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edge patches and deletions of ordered repairs, each judged against what the earlier ones left: (edges, guardrail rows).

    A repair finds edges by id or by ``source->target`` as they are at its turn: an edge that was deleted is not found again, and one whose ends were
    changed is found by the new ends. Outcomes are computed for all repairs at once, first against the input, then against the spans of
    names that follow from the last outcomes, until nothing changes. An outcome only depends on earlier repairs, so that the rounds are as many as the longest chain
    of repairs that find an edge by what an earlier one did, plus two.
    """
    c = F.col
    asked = checkpointed(fix.filter(c("action").isin("update_edge", "delete_edge")).select(
        KEY, "seq", "action", "target_id", F.try_element_at("changes", F.lit("source")).alias("new_source"), F.try_element_at("changes", F.lit("target")).alias("new_target")
    ))
    rows = checkpointed(edges.withColumn("_no", F.monotonically_increasing_id()))
    named = rows.select(KEY, c("_no").alias("no"), F.coalesce("id", F.lit("")).alias("id_name"), "source", "target")
    names = named.select(KEY, "no", F.explode(F.array_distinct(F.array("id_name", _ends()))).alias("target_id"))
    near = names.join(asked.select(KEY, "target_id").distinct(), [KEY, "target_id"], "left_semi")
    touched = checkpointed(named.join(near.select(KEY, "no").distinct(), [KEY, "no"], "left_semi"))
    first = near.groupBy(KEY, "target_id").agg(F.count(F.lit(1)).alias("hits"), F.max("no").alias("no"))
    hits = F.coalesce("hits", F.lit(0))
    outcome = checkpointed(asked.join(first, [KEY, "target_id"], "left").select(*asked.columns, hits.alias("hits"), F.when(hits == 1, c("no")).alias("no")))
    deaths = None
    while True:
        renames = outcome.filter("action = 'update_edge' AND no IS NOT NULL AND (new_source IS NOT NULL OR new_target IS NOT NULL)").select(KEY, "no", "seq", "new_source", "new_target")
        deletes = outcome.filter("action = 'delete_edge' AND hits > 0").select(KEY, c("target_id").alias("name"), "seq")
        if deaths is None and renames.isEmpty() and deletes.isEmpty():
            break
        spans, deaths = _edge_spans(touched, renames, deletes)
        found = checkpointed(asked.join(_edge_hits(spans, asked), [KEY, "seq"]).select(*outcome.columns))
        changed = found.join(outcome.select(KEY, "seq", c("no").alias("_no"), c("hits").alias("_hits")), [KEY, "seq"]).filter(
            F.when(c("action") == "delete_edge", (c("hits") > 0) != (c("_hits") > 0)).otherwise(~c("no").eqNullSafe(c("_no")))
        )
        done = changed.isEmpty()
        outcome = found
        if done:
            break
    judged = outcome.withColumn("reason", F.when((c("action") == "update_edge") & c("no").isNull(), "edge_target_not_unique")
                                .when((c("action") == "delete_edge") & (c("hits") == 0), "edge_to_delete_not_found"))
    patches = fix.join(outcome.filter("action = 'update_edge' AND no IS NOT NULL").select(KEY, "seq", c("no").alias("_no")), [KEY, "seq"]).select(
        KEY, "_no", c("seq").alias("pos"), _patch_map(K.EDGE_PATCH_FIELDS).alias("patch")
    )
    e = rows.join(merge_patches(patches, [KEY, "_no"]), [KEY, "_no"], "left")
    if deaths is not None:
        e = e.join(deaths.select(KEY, c("no").alias("_no")), [KEY, "_no"], "left_anti")
    return e.select(*_patched(e, K.EDGE_PATCH_FIELDS)).select(*edges.columns), _guard(judged)


def apply_repairs(nodes: DataFrame, edges: DataFrame, repairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Whitelisted patches in order, on uniquely found targets: (nodes, edges, guardrail rows).

    ``repairs``: industry_id, pos, action (or ``type``, read where it is blank), target_id, changes (map), remove_fields (array). An
    edge target is an edge id or ``source->target``.
    """
    fix = ordered_repairs(repairs)
    n, node_guard = repair_nodes(nodes, fix)
    e, edge_guard = repair_edges(edges, fix)
    other = ~F.coalesce(F.col("action").isin("update_node", "update_edge", "delete_edge"), F.lit(False))
    odd = _guard(fix.filter(other).withColumn("reason", F.lit("action_not_allowed")))
    return n, e, node_guard.unionByName(edge_guard).unionByName(odd)


def repair_attachments(attachments: DataFrame, proposed: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda met: met) -> tuple[DataFrame, DataFrame]:
    """Repairs may only keep a subset of the pairs and adjust reason and confidence.

    Proposals meet the attachments once; ``keep`` may write what they met, where both tables of the result are read.
    """
    c = F.col
    key = [KEY, "company_id", "node_id"]
    new = proposed.select(*key, X.strip(F.coalesce("reason", F.lit(""))).alias("_reason"), c("confidence").cast("string").alias("_conf"))
    original = last_by(attachments, key, ["pos"])
    met = keep(new.join(original.withColumn("_found", F.lit(True)), key, "left"))
    kept = met.filter("_found")
    value = c("_conf").try_cast("double")
    repaired = kept.select(
        *[x for x in attachments.columns if x not in ("reason", "confidence")],
        F.when(c("_reason") != "", c("_reason")).otherwise(c("reason")).alias("reason"),
        F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).otherwise(c("confidence")).alias("confidence"),
    ).select(*attachments.columns)
    guard = met.filter("_found IS NULL").select(
        KEY, F.lit("error").alias("severity"), F.concat("company_id", F.lit("->"), "node_id").alias("item_id"), F.lit("new_attachment_not_allowed").alias("reason")
    )
    return repaired, guard


# --- tree surgery ---------------------------------------------------------------------------
def correct_taxonomy(
    nodes: DataFrame, edges: DataFrame, moves: DataFrame, renames: DataFrame, drops: DataFrame, paths: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reposition L1 branches, rename L1 branches, drop named subtrees: (nodes, edges, report).

    ``moves``: industry_id, name, chain_position. ``renames``: industry_id, name, new_name, description.
    ``drops``: industry_id, name. Standardize afterwards.
    """
    c = F.col

    def first_named(rules: DataFrame, level: int | None) -> DataFrame:
        pool = nodes if level is None else nodes.filter(c("level") == level)
        hits = pool.select(KEY, "name", "pos", "id").join(rules.select(KEY, "name").distinct(), [KEY, "name"], "left_semi")
        return first_by(hits, [KEY, "name"], ["pos", "id"]).drop("pos")

    move = first_named(moves, 1).join(moves, [KEY, "name"]).select(KEY, "id", c("chain_position").alias("_position"))
    rename = first_named(renames, 1).join(renames, [KEY, "name"]).select(KEY, "id", c("new_name").alias("_name"), c("description").alias("_text"))
    tops = first_named(drops, None).select(KEY, "id")
    gone = subtree(paths, tops).select(KEY, "id").distinct()
    moved, named = c("_position").isNotNull(), c("_name").isNotNull()
    changes: Mapping[str, Column] = {
        "chain_position": F.coalesce("_position", "chain_position"),
        "chain_segment": F.when(moved, X.segment_label(c("_position"))).otherwise(c("chain_segment")),
        "parent_id": F.when(moved & c("_position").isin("upstream", "downstream"), "").otherwise(c("parent_id")),
        "tags": F.when(moved, F.array(F.lit("level_1"), c("_position"))).otherwise(c("tags")),
        "name": F.coalesce("_name", "name"),
        "description": F.when(named, c("_text")).otherwise(c("description")),
        "business_description": F.when(named, c("_text")).otherwise(c("business_description")),
    }
    joined = nodes.join(move, [KEY, "id"], "left").join(rename, [KEY, "id"], "left")
    changed = joined.select(*[changes.get(x, c(x)).alias(x) for x in nodes.columns])
    kept, left = drop_nodes(changed, edges, gone)
    report = (
        move.select(KEY, F.lit("repositioned").alias("change"), "id", c("_position").alias("detail"))
        .unionByName(rename.select(KEY, F.lit("renamed").alias("change"), "id", c("_name").alias("detail")))
        .unionByName(gone.select(KEY, F.lit("removed").alias("change"), "id", F.lit("").alias("detail")))
    )
    return kept.select(*nodes.columns), left.select(*edges.columns), report


def _inherited(items: DataFrame, home: DataFrame) -> DataFrame:
    """Evidence of manual items: that of their template, which may be manual itself, or of the branch.

    ``items``: key, template_key, rn, manual, source_urls, evidence_ids. A template counts only if it comes earlier. Pointers are doubled: an item that points
    to a manual one points to what that one points to, until each points to a copy or to nothing.
    """
    keys = [KEY, "branch_id"]
    at = items.select(*keys, F.col("key").alias("template_key"), F.col("rn").alias("_rn"), F.col("manual").alias("_open"))
    step = items.filter("manual").join(at, [*keys, "template_key"], "left").select(
        *keys, "key", F.when(F.col("_rn") < F.col("rn"), F.col("template_key")).alias("to"), F.coalesce(F.col("_open") & (F.col("_rn") < F.col("rn")), F.lit(False)).alias("open")
    )
    step = checkpointed(step)
    while not step.filter("open").isEmpty():
        onward = step.select(*keys, F.col("key").alias("to"), F.col("to").alias("_to"), F.col("open").alias("_open"))
        moved = step.filter("open").join(onward, [*keys, "to"]).select(*keys, "key", F.col("_to").alias("to"), F.col("_open").alias("open"))
        step = checkpointed(moved.unionByName(step.filter("NOT open")))
    copies = items.filter("NOT manual").select(*keys, F.col("key").alias("to"), F.col("source_urls").alias("_u"), F.col("evidence_ids").alias("_e"))
    branch = home.select(*keys, F.col("source_urls").alias("_bu"), F.col("evidence_ids").alias("_be"))
    found = step.join(copies, [*keys, "to"], "left").join(branch, keys, "left")
    return found.select(*keys, "key", F.coalesce("_u", "_bu").alias("_urls"), F.coalesce("_e", "_be").alias("_evidence"))


def transplant(
    nodes: DataFrame, paths: DataFrame, plan: DataFrame, branches: DataFrame, manual: DataFrame, drops: DataFrame, as_of: str
) -> tuple[DataFrame, DataFrame]:
    """Copy old subtrees under new L1 branches and add manual nodes: (nodes, contains edges).

    ``plan``: industry_id, branch_id, step, old_id, start_level, whole (subtree with its top, or only the children's subtrees), and parent_key if tops do not all
    hang under the branch. ``branches``: industry_id, branch_id, chain_position, chain_segment, source_urls, evidence_ids. ``manual``: industry_id,
    branch_id, step, key, name, level, description, parent_key, template_key. Keys of items are ``old:<old id>`` and ``manual:<key>``; a blank parent key
    is the branch. Any item may hang under any other, manual or copied. A manual item has the evidence of its template, by default its parent, if
    that comes earlier; else the branch's. Dropped ids cut their whole subtree. Ids are numbered per branch in (step, walk) order. An item
    that is planned twice, or whose parent is not planned, is an error.
    """
    c = F.col
    if "parent_key" not in plan.columns:
        plan = plan.withColumn("parent_key", F.lit(""))
    tops = plan.select(KEY, c("old_id").alias("id")).distinct()
    walk = subtree(paths, tops).withColumnRenamed("top", "old_id")
    depth = closure(paths, nodes).select(KEY, "id", c("ancestor").alias("old_id"), "dist")
    cut = subtree(paths, drops.select(KEY, "id")).select(KEY, "id").distinct()
    listed = tree_listing(nodes, paths).select(KEY, "id", "sort_key")
    old = nodes.select(KEY, "id", "name", "parent_id", "description", "source_urls", "evidence_ids", "confidence")
    first = F.when(c("whole"), 0).otherwise(1)
    copies = (
        walk.join(cut, [KEY, "id"], "left_anti").join(plan, [KEY, "old_id"]).join(depth, [KEY, "id", "old_id"])
        .filter(c("whole") | (c("dist") > 0))
        .join(listed, [KEY, "id"]).join(old, [KEY, "id"])
        .select(
            KEY, "branch_id", "step", F.array_join("sort_key", "/").alias("walk"), F.concat(F.lit("old:"), "id").alias("key"),
            F.when(c("dist") == first, F.coalesce("parent_key", F.lit(""))).otherwise(F.concat(F.lit("old:"), "parent_id")).alias("parent_key"),
            (c("start_level") + c("dist") - first).cast("int").alias("level"), "name", "description", "source_urls", "evidence_ids", "confidence",
            F.lit(False).alias("manual"), F.lit("").alias("template_key"),
        )
    )
    none = F.lit(None).cast("array<string>")
    home = branches.select(KEY, "branch_id", "chain_position", "chain_segment", "source_urls", "evidence_ids")
    extra = manual.join(home.select(KEY, "branch_id"), [KEY, "branch_id"], "left_semi").select(
        KEY, "branch_id", "step", F.lit("").alias("walk"), F.concat(F.lit("manual:"), "key").alias("key"), F.coalesce("parent_key", F.lit("")).alias("parent_key"), "level", "name", "description",
        none.alias("source_urls"), none.alias("evidence_ids"), F.lit(0.86).alias("confidence"), F.lit(True).alias("manual"), X.or_default(c("template_key"), c("parent_key"), F.lit("")).alias("template_key"),
    )
    ranked = checkpointed(numbered(copies.unionByName(extra), [KEY, "branch_id"], ["step", "walk", "key"], "rn"))
    again = ranked.groupBy(KEY, "branch_id", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").first()
    if again is not None:
        raise ValueError(f"{again['key']} of {again[KEY]} is planned twice for branch {again['branch_id']}")
    number = c("rn").cast("string")
    new_id = F.concat("branch_id", F.lit("_"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number))
    ids = ranked.select(KEY, "branch_id", c("key").alias("parent_key"), new_id.alias("_pid"))
    given = _inherited(ranked, home)
    placed = checkpointed(
        ranked.withColumn("id", new_id).join(ids, [KEY, "branch_id", "parent_key"], "left").join(given, [KEY, "branch_id", "key"], "left")
        .join(home.select(KEY, "branch_id", "chain_position", "chain_segment"), [KEY, "branch_id"])
        .withColumn("parent_id", F.when(c("parent_key") == "", c("branch_id")).otherwise(c("_pid")))
        .withColumn("source_urls", F.when(c("manual"), c("_urls")).otherwise(c("source_urls"))).withColumn("evidence_ids", F.when(c("manual"), c("_evidence")).otherwise(c("evidence_ids")))
    )
    lost = placed.filter("parent_id IS NULL").select(KEY, "branch_id", "key", "parent_key").first()
    if lost is not None:
        raise ValueError(f"{lost['key']} of {lost[KEY]} hangs under {lost['parent_key']}, which is not planned for branch {lost['branch_id']}")
    out = placed.select(
        KEY, c("rn").alias("pos"), "branch_id", "id", "name", F.lit(K.NODE_TYPE_DETAIL).alias("node_type"),
        F.array(F.concat(F.lit("level_"), c("level").cast("string")), c("chain_position")).alias("tags"), "level", "chain_position",
        "chain_segment", "parent_id", "description", c("description").alias("business_description"), F.lit(False).alias("is_key_node"),
        "source_urls", "evidence_ids", "confidence", F.lit(as_of).alias("updated_at"),
    )
    links = out.select(
        KEY, "pos", X.edge_id(c("parent_id"), F.lit(K.CONTAINS), c("id")).alias("id"), c("parent_id").alias("source"), c("id").alias("target"),
        F.lit(K.CONTAINS).alias("relation_type"), F.lit(1.0).alias("relation_weight"), F.format_string(K.TEXT_TRANSPLANT_EDGE, "name").alias("description"),
        "source_urls", "evidence_ids", "confidence", "updated_at",
    )
    return out, links
