"""Overlay status, fingerprints, publication gates and manifest updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkstrata import constants as K
from linkstrata.functions import text as X

KEY = "industry_id"


def digest(rows: DataFrame, columns: list[str], key: str = KEY) -> DataFrame:
    """Order-free multiset digest per graph (or other key): row count and sums over four 32-bit words of each row's sha256.

    Sums combine on the map side, so a huge graph never has its row hashes gathered in one place.
    """
    h = X.row_hash(*[F.col(c) for c in columns])
    words = [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(4)]
    return rows.select(key, *[w.alias(f"w{i}") for i, w in enumerate(words)]).groupBy(key).agg(
        F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[F.sum(f"w{i}").cast("string") for i in range(4)]).alias("digest")
    )


def graph_fingerprint(graphs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(industry_id, graph_fingerprint) over schema version and the contents of all nodes and edges.

    A canonical form of its own; ``pos`` takes part, so reordering changes the fingerprint.
    """
    n = digest(nodes, sorted(c for c in nodes.columns if c != KEY)).withColumnRenamed("digest", "_n")
    e = digest(edges, sorted(c for c in edges.columns if c != KEY)).withColumnRenamed("digest", "_e")
    return graphs.select(KEY, "schema_version").join(n, KEY, "left").join(e, KEY, "left").select(
        KEY, F.sha2(F.to_json(F.struct("schema_version", F.coalesce("_n", F.lit("")).alias("n"), F.coalesce("_e", F.lit("")).alias("e"))), 256).alias("graph_fingerprint")
    )


def overlay_fingerprint(meta: DataFrame, l2_edges: DataFrame, projected: DataFrame) -> DataFrame:
    """(industry_id, overlay_fingerprint) of flow overlays: schema version, industry, graph fingerprint, and all of both edge lists, nested values included.

    When the payload was generated does not count; where the edge tables have ``pos``, order does.
    """
    cols = lambda df: sorted(c for c in df.columns if c != KEY)
    a = digest(l2_edges, cols(l2_edges)).withColumnRenamed("digest", "_a")
    b = digest(projected, cols(projected)).withColumnRenamed("digest", "_b")
    return meta.select(KEY, "schema_version", "graph_fingerprint").join(a, KEY, "left").join(b, KEY, "left").select(
        KEY, F.sha2(F.to_json(F.struct("schema_version", KEY, "graph_fingerprint", F.coalesce("_a", F.lit("")).alias("a"), F.coalesce("_b", F.lit("")).alias("b"))), 256).alias("overlay_fingerprint")
    )


def table_hash(df: DataFrame) -> DataFrame:
    """One row: content hash of a whole table (the source-file hash of a CSV that is a table here)."""
    whole = digest(df.select(F.lit("all").alias(KEY), *df.columns), sorted(df.columns))
    return whole.select(F.sha2("digest", 256).alias("source_hash"))


def overlay_status(
    industries: DataFrame, meta: DataFrame, current: DataFrame, schema_version: str = K.ATTACHMENT_SCHEMA_VERSION, check_source: bool = True
) -> DataFrame:
    """missing / invalid / stale / ready per industry.

    ``meta``: industry_id, payload_industry_id, schema_version, shape_ok, graph_fingerprint, source_hash.
    ``current``: industry_id, graph_fingerprint, source_hash.
    """
    c = F.col
    m = meta.select(KEY, F.lit(True).alias("_have"), "payload_industry_id", "schema_version", "shape_ok", c("graph_fingerprint").alias("_mf"), c("source_hash").alias("_ms"))
    cur = current.select(KEY, c("graph_fingerprint").alias("_cf"), c("source_hash").alias("_cs"))
    moved: Column = ~c("payload_industry_id").eqNullSafe(c(KEY)) | ~c("_mf").eqNullSafe(c("_cf"))
    if check_source:
        moved = moved | c("_cs").isNull() | ~c("_ms").eqNullSafe(c("_cs"))
    status = (
        F.when(c("_have").isNull(), "missing")
        .when(~c("schema_version").eqNullSafe(F.lit(schema_version)) | ~F.coalesce("shape_ok", F.lit(False)), "invalid")
        .when(moved, "stale").otherwise("ready")
    )
    return industries.select(KEY).join(m, KEY, "left").join(cur, KEY, "left").select(KEY, status.alias("overlay_status"))


def update_gate(proposals: DataFrame, rollup: DataFrame, review: DataFrame, mode: str) -> DataFrame:
    """Apply only in apply mode, for a proposed/apply_ready proposal without errors in rules or review items."""
    errors = review.groupBy(KEY).agg(F.count_if(F.col("severity") == "error").alias("_review_errors"))
    ok = (
        F.lit(mode == "apply") & F.coalesce(F.col("proposal_status").isin("proposed", "apply_ready"), F.lit(False))
        & (F.coalesce("error_count", F.lit(1)) == 0) & (F.coalesce("_review_errors", F.lit(0)) == 0)
    )
    return proposals.join(rollup.select(KEY, "error_count"), KEY, "left").join(errors, KEY, "left").select(KEY, "proposal_status", ok.alias("can_apply"))


def candidate_gate(rollup: DataFrame) -> DataFrame:
    return rollup.select(KEY, (F.col("error_count") == 0).alias("can_apply"))


def publish(current: DataFrame, candidate: DataFrame, gate: DataFrame) -> DataFrame:
    """Rows of the candidate for industries that may apply, of the current table for all others."""
    go = F.broadcast(gate.filter("can_apply").select(KEY))  # one row an industry: the tables are not moved
    return current.join(go, KEY, "left_anti").unionByName(candidate.join(go, KEY, "left_semi"), allowMissingColumns=True)


def manifest_counts(manifest: DataFrame, nodes: DataFrame, edges: DataFrame, ready: DataFrame | None = None) -> DataFrame:
    """Write node and edge counts back; industries in ``ready`` also become ready."""
    n = nodes.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    e = edges.groupBy(KEY).agg(F.count(F.lit(1)).alias("_e"))
    out = manifest.join(n, KEY, "left").join(e, KEY, "left")
    have = F.col("_n").isNotNull()
    status = F.col("status")
    if ready is not None:
        out = out.join(ready.select(KEY, F.lit(True).alias("_go")).distinct(), KEY, "left")
        status = F.when(F.col("_go"), "ready").otherwise(status)
    return out.select(
        KEY, "name", status.alias("status"), F.when(have, F.col("_n")).otherwise(F.col("node_count")).cast("bigint").alias("node_count"),
        F.when(have, F.coalesce("_e", F.lit(0))).otherwise(F.col("edge_count")).cast("bigint").alias("edge_count"),
    )


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Key-based merge: new values win where they are not null, unknown keys are inserted."""
    rest = [c for c in existing.columns if c not in keys]
    have = set(new.columns)
    renamed = new.select(*keys, *[F.col(c).alias("_new_" + c) for c in rest if c in have])
    return existing.join(renamed, keys, "full_outer").select(
        *keys, *[F.coalesce("_new_" + c, c).alias(c) if c in have else F.col(c) for c in rest]
    )


def upsert_graph(old_nodes: DataFrame, old_edges: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge graphs into a stored graph table: (nodes, edges, counts). Edges need both ends in the result."""
    merged = upsert(old_nodes, nodes, [KEY, "id"])
    ids = merged.select(KEY, "id")
    links = edges.join(ids.withColumnRenamed("id", "source"), [KEY, "source"], "left_semi").join(ids.withColumnRenamed("id", "target"), [KEY, "target"], "left_semi")
    all_edges = upsert(old_edges, links, [KEY, "source", "relation_type", "target"])
    counts = merged.groupBy(KEY).agg(F.count(F.lit(1)).alias("node_count")).join(
        all_edges.groupBy(KEY).agg(F.count(F.lit(1)).alias("edge_count")), KEY, "left"
    ).select(KEY, "node_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"))
    return merged, all_edges, counts


def industry_rows(industries: DataFrame, nodes: DataFrame, edges: DataFrame, status: str = "demo") -> DataFrame:
    """Industry rows of an import (industry_id, name, node_count, edge_count, status): counts are those of the imported tables, dangling edges included."""
    n = nodes.groupBy(KEY).agg(F.count(F.lit(1)).alias("node_count"))
    e = edges.groupBy(KEY).agg(F.count(F.lit(1)).alias("edge_count"))
    return industries.select(KEY, "name").join(n, KEY, "left").join(e, KEY, "left").select(
        KEY, "name", F.coalesce("node_count", F.lit(0)).alias("node_count"), F.coalesce("edge_count", F.lit(0)).alias("edge_count"), F.lit(status).alias("status")
    )
