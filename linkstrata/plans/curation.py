"""Multi-step jobs: candidate build, final validation, update, publication."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstrata.functions import text as X
from linkstrata.functions.tables import checkpointed, first_by
from linkstrata.operators import merge, publish, validate
from linkstrata.operators.hierarchy import ancestor_paths, tree_parents
from linkstrata.operators.standardize import standardize_graph

KEY = "industry_id"


@dataclass
class Validated:
    nodes: DataFrame
    edges: DataFrame
    issues: DataFrame
    report: DataFrame
    evidence: DataFrame
    guardrails: DataFrame
    review: DataFrame
    status: DataFrame


def final_validation(
    graphs: DataFrame, nodes: DataFrame, edges: DataFrame, repairs: DataFrame, opinions: DataFrame, as_of: str
) -> Validated:
    """Standardize, check, repair what is repairable, standardize again, check again, and queue the rest.

    Repairs only apply to industries with a repairable error, as they answer exactly those findings.
    """
    n0, e0 = (checkpointed(t) for t in standardize_graph(graphs, nodes, edges, as_of))
    first = checkpointed(validate.split_repairable(validate.graph_issues(n0, e0)))
    wanted = first.filter("repairable").select(KEY).distinct()
    fixes = repairs.join(wanted, KEY, "left_semi")
    fixed_n, fixed_e, guard = merge.apply_repairs(n0, e0, fixes)
    n1, e1 = standardize_graph(graphs, checkpointed(fixed_n), checkpointed(fixed_e), as_of)
    changed = validate.minimal_change(n0, e0, n1, e1).select(KEY, "severity", "item_id", F.col("message").alias("reason"))
    hard = first.filter("NOT repairable").select(KEY, "severity", "item_id", F.col("message").alias("reason"))
    guardrails = checkpointed(guard.unionByName(changed).unionByName(hard))
    n2, e2 = (checkpointed(t) for t in standardize_graph(graphs, n1, e1, as_of))
    depth = validate.contains_depth(n2, e2)
    issues = checkpointed(validate.graph_issues(n2, e2, depth))
    report = validate.graph_report(n2, e2, issues, depth)
    failed = guardrails.filter(F.col("severity") == "error").select(KEY, F.lit(True).alias("_failed")).distinct()
    report = report.join(failed, KEY, "left").withColumn(
        "status", F.when(F.coalesce("_failed", F.lit(False)), "fail").otherwise(F.col("status"))
    ).drop("_failed")
    basis = graphs.select(KEY, F.posexplode("source_basis").alias("pos", "b")).select(KEY, "pos", "b.*")
    evidence = merge.evidence_table(basis, n2, e2, as_of)
    empty = lambda *cols: n2.limit(0).select(KEY, *[F.lit("").alias(c) for c in cols])
    review = merge.review_queue(
        issues, empty("keep", "drop", "name"), empty("source", "target", "kept_type", "dropped_type"), guardrails, opinions
    )
    return Validated(n2, e2, issues, report, evidence, guardrails, review, merge.review_status(review, graphs))


@dataclass
class Candidate:
    nodes: DataFrame
    edges: DataFrame
    node_evidence: DataFrame  # factored lists, see merge.item_evidence
    edge_evidence: DataFrame
    duplicates: DataFrame
    conflicts: DataFrame


def merge_candidate(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, evidence: DataFrame, as_of: str) -> Candidate:
    """Standardized graphs whose nodes and edges share all evidence of their graph, with duplicate names and relation conflicts.

    Of several relation types between two nodes the first stays. Evidence lists are factored; ``merge.expand_evidence`` gives the full lists of chosen items.
    """
    n, e = (checkpointed(t) for t in standardize_graph(graphs, nodes, edges, as_of))
    kept, conflicts = merge.relation_conflicts(e)
    kept = checkpointed(kept)
    return Candidate(n, kept, merge.item_evidence(n, evidence), merge.item_evidence(kept, evidence), merge.duplicate_name_report(n), conflicts)


def standardize_staged(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Standard form of many graphs per industry in one job; every table carries ``graph_no``, and each graph falls back to its own defaults.

    Standardization knows graphs by one key, so industry and number are put into it for the time being.
    """
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn(KEY, F.concat(KEY, F.lit("\x01"), F.col("graph_no").cast("string"))).drop("graph_no")

    def parted(df: DataFrame) -> DataFrame:
        parts = F.split(KEY, "\x01")
        return df.select(parts[0].alias(KEY), parts[1].cast("int").alias("graph_no"), *[c for c in df.columns if c != KEY])

    named = graphs.withColumn("industry", X.or_default(F.col("industry"), F.col(KEY)))
    n, e = standardize_graph(keyed(named), keyed(nodes), keyed(edges), as_of)
    return parted(n), parted(e)


@dataclass
class Merged:
    graphs: DataFrame
    nodes: DataFrame
    edges: DataFrame
    conflicts: DataFrame


def merge_staged(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, as_of: str) -> Merged:
    """Standardize every staged graph (``graph_no``; 0 is the seed), merge them per industry, standardize the whole.

    Copies of a node must agree on name, level and parent once standardized; an industry where some do not is left out and its nodes are named in ``conflicts``. The
    merged header is the seed's, with the first source of each url (name, if it has no url) over all graphs in order.
    """
    n, e = (checkpointed(t) for t in standardize_staged(graphs, nodes, edges, as_of))
    conflicts = checkpointed(merge.node_conflicts(n))
    good = graphs.filter("graph_no = 0").join(conflicts.select(KEY).distinct(), KEY, "left_anti").drop("graph_no")
    keep = good.select(KEY)
    entries = graphs.join(keep, KEY, "left_semi").select(KEY, "graph_no", F.posexplode("source_basis").alias("pos", "b")).select(KEY, "graph_no", "pos", "b.*")
    first = merge.merge_source_basis(entries)
    basis = first.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("graph_no", "pos", "name", "url", "note"))).alias("_b"))  # sources of one graph: a short list
    merged = good.join(basis, KEY, "left").withColumn(
        "source_basis", F.transform(F.coalesce("_b", F.array().cast(basis.schema["_b"].dataType)), lambda s: F.struct(s["name"].alias("name"), s["url"].alias("url"), s["note"].alias("note")))
    ).drop("_b")
    merged = checkpointed(merged)
    together_n = checkpointed(merge.merge_nodes(n.join(keep, KEY, "left_semi")))
    together_e = checkpointed(merge.merge_edges(e.join(keep, KEY, "left_semi")))
    out_n, out_e = standardize_graph(merged, together_n, together_e, as_of)
    return Merged(merged, out_n, out_e, conflicts)


def rebuild_from_branches(
    graphs: DataFrame, seed_nodes: DataFrame, seed_edges: DataFrame, branch_nodes: DataFrame, branch_edges: DataFrame, as_of: str, branch_graphs: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Namespace every branch, check membership, standardize and merge the good graphs: (nodes, edges, failures).

    Branch tables carry ``branch_id`` and ``graph_no`` (> 0). ``branch_graphs`` are the branches' headers (industry_id, graph_no and the columns of
    ``graphs``); without them a branch has the seed's. A graph with any failure keeps only its failure rows. Merging needs agreeing copies, so
    identity conflicts are failures too.
    """
    n, e, bad_ids = merge.namespace_branches(branch_nodes, branch_edges)
    n, e = checkpointed(n), checkpointed(e)
    members = merge.branch_membership(n, ancestor_paths(tree_parents(first_by(n, [KEY, "id"], ["graph_no", "pos", "branch_id"]))))
    headers = graphs.withColumn("graph_no", F.lit(0))
    if branch_graphs is None:
        branch_graphs = n.select(KEY, "graph_no").distinct().join(graphs, KEY)
    wrong = checkpointed(bad_ids.select(KEY, "branch_id", F.lit("bad_node_id").alias("error"), F.col("old_id").alias("item_id")).unionByName(members))
    good = graphs.select(KEY).join(wrong.select(KEY).distinct(), KEY, "left_anti")
    keep = lambda df: df.join(good, KEY, "left_semi")
    nodes = seed_nodes.withColumn("graph_no", F.lit(0)).unionByName(n.drop("branch_id"), allowMissingColumns=True)
    links = seed_edges.withColumn("graph_no", F.lit(0)).unionByName(e.drop("branch_id"), allowMissingColumns=True)
    merged = merge_staged(keep(headers.unionByName(branch_graphs.select(*headers.columns))), keep(nodes), keep(links), as_of)
    failures = wrong.unionByName(merged.conflicts.select(KEY, F.lit("").alias("branch_id"), F.lit("node_conflict").alias("error"), F.col("id").alias("item_id")))
    return merged.nodes, merged.edges, failures


def propose_update(
    graphs: DataFrame, nodes: DataFrame, edges: DataFrame, add_nodes: DataFrame, add_edges: DataFrame, node_patches: DataFrame,
    edge_patches: DataFrame, deprecations: DataFrame, as_of: str,
) -> tuple[DataFrame, DataFrame]:
    """Update candidate: standardize, apply, standardize (``deprecated`` marks are kept)."""
    n, e = (checkpointed(t) for t in standardize_graph(graphs, nodes, edges, as_of))
    n, e = merge.apply_update(n, e, add_nodes, add_edges, node_patches, edge_patches, deprecations)
    return standardize_graph(graphs, checkpointed(n), checkpointed(e), as_of)


def publish_candidates(
    manifest: DataFrame, graphs: DataFrame, nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, as_of: str
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Publish error-free candidates: (nodes, edges, manifest, gate)."""
    n, e = (checkpointed(t) for t in standardize_graph(graphs, new_nodes, new_edges, as_of))
    gate = checkpointed(publish.candidate_gate(validate.issue_rollup(validate.graph_issues(n, e), graphs)))
    out_n, out_e = publish.publish(nodes, n, gate), publish.publish(edges, e, gate)
    applied = gate.filter("can_apply")
    entries = publish.manifest_counts(manifest, n.join(applied, KEY, "left_semi"), e.join(applied, KEY, "left_semi"), applied)
    return out_n, out_e, entries, gate
