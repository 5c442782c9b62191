"""Flow relations between L2 links: catalog, pair shortlist, verdicts, edges and L1-L2 projection."""

from __future__ import annotations

import hashlib


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkstrata import constants as K
from linkstrata.functions import text as X
from linkstrata.functions.tables import checkpointed, last_by, top_rows
from linkstrata.operators.hierarchy import lineage

KEY = "industry_id"
BLOCK_ROWS = 512
PARTNER_ROLES = ("upstream", "downstream")


# --- catalog ----------------------------------------------------------------------
def l2_catalog(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per L2 node: path, branch, role, first 12 child names, first 24 descendants in
    breadth-first order (children by id) with their texts, and a content hash without those texts."""
    info = lineage(nodes, paths)
    own = X.or_default(F.col("business_description"), F.col("description"), F.lit(""))
    l2 = nodes.filter(F.col("level") == 2).select(KEY, "id", "name", "chain_position", own.alias("description"))
    children = top_rows(
        nodes.filter(F.col("parent_id") != "").select(KEY, F.col("parent_id").alias("top"), "pos", "id", "name")
        .join(l2.select(KEY, F.col("id").alias("top")), [KEY, "top"], "left_semi"),
        [KEY, "top"], [F.col("pos"), F.col("id")], 12,
    )
    names = children.groupBy(KEY, F.col("top").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("rn", X.or_default(F.col("name"), F.col("id")).alias("name")))).alias("_c")
    ).select(KEY, "id", F.transform("_c", lambda x: x["name"]).alias("direct_child_names"))
    # breadth-first order below a top node = (distance, id path from the top)
    below = paths.select(KEY, "id", "path", F.posexplode("path").alias("_i", "top")).join(
        l2.select(KEY, F.col("id").alias("top")), [KEY, "top"], "left_semi"
    ).select(
        KEY, "top", "id", (F.col("_i") + 1).alias("dist"),
        F.concat(F.reverse(F.slice("path", F.lit(1), F.col("_i"))), F.array("id")).alias("walk"),
    )
    first = top_rows(below, [KEY, "top"], [F.col("dist"), F.col("walk")], 24)
    summary = F.concat(
        X.or_default(F.col("name"), F.col("id")),
        F.when(X.strip(own) != "", F.concat(F.lit("："), F.substring(X.strip(own), 1, 240))).otherwise(""),
    )
    texts = nodes.select(KEY, "id", summary.alias("summary"))
    contexts = first.join(texts, [KEY, "id"]).groupBy(KEY, F.col("top").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("rn", "summary"))).alias("_d")
    ).select(KEY, "id", F.transform("_d", lambda x: x["summary"]).alias("descendant_contexts"))
    nothing = F.array().cast("array<string>")
    content = ["id", "name", "path", "branch_id", "branch_name", "branch_role", "chain_position", "description", "direct_child_names"]
    return (
        l2.join(info, [KEY, "id"]).join(names, [KEY, "id"], "left").join(contexts, [KEY, "id"], "left")
        .withColumn("direct_child_names", F.coalesce("direct_child_names", nothing))
        .withColumn("node_content_hash", X.row_hash(*[F.col(c) for c in sorted(content)]))
        .select(KEY, *content, "node_content_hash", F.coalesce("descendant_contexts", nothing).alias("descendant_contexts"))
    )


def catalog_text(catalog: DataFrame) -> Column:
    return X.plain_text(
        F.col("name"), F.col("path"), F.col("description"), F.array_join("direct_child_names", " "), F.array_join("descendant_contexts", " ")
    )


def allowed_direction(source_role: Column, target_role: Column) -> Column:
    return ((source_role == "upstream") & (target_role == K.CONTAINS)) | ((source_role == K.CONTAINS) & (target_role == "downstream"))


def direction_check(pairs: DataFrame, nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds ``allowed``: both ends L2 and the branch roles permit source -> target."""
    role = nodes.filter(F.col("level") == 2).select(KEY, "id").join(lines.select(KEY, "id", "branch_role"), [KEY, "id"])
    return (
        pairs.join(role.select(KEY, F.col("id").alias("source"), F.col("branch_role").alias("_rs")), [KEY, "source"], "left")
        .join(role.select(KEY, F.col("id").alias("target"), F.col("branch_role").alias("_rt")), [KEY, "target"], "left")
        .withColumn("allowed", F.coalesce(allowed_direction(F.col("_rs"), F.col("_rt")), F.lit(False)))
        .drop("_rs", "_rt")
    )


# --- pair space, by arithmetic ------------------------------------------------------
def _main_pairs(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """Unordered L2 pairs already joined in the main graph whose roles could form a pair."""
    side = catalog.select(KEY, "id", "branch_role")
    return (
        edges.filter((F.col("source") != "") & (F.col("target") != ""))
        .select(KEY, F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
        .join(side.select(KEY, F.col("id").alias("a"), F.col("branch_role").alias("ra")), [KEY, "a"])
        .join(side.select(KEY, F.col("id").alias("b"), F.col("branch_role").alias("rb")), [KEY, "b"])
        .filter((F.col("ra") == K.CONTAINS) != (F.col("rb") == K.CONTAINS))
    )


def pair_space(catalog: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of admissible pairs per L2 node and partner role, without forming a pair.

    A ``contains`` node pairs with every upstream and every downstream node of its graph and the
    reverse; different roles imply different branches. Pairs with a main-graph edge are taken off.
    """
    usable = catalog.filter(F.col("branch_id") != "")
    sizes = usable.groupBy(KEY, F.col("branch_role").alias("partner_role")).agg(F.count(F.lit(1)).alias("n"))
    wanted = F.when(F.col("branch_role") == K.CONTAINS, F.array(*[F.lit(r) for r in PARTNER_ROLES])).otherwise(F.array(F.lit(K.CONTAINS)))
    joined = _main_pairs(edges, usable)
    taken = joined.select(KEY, F.col("a").alias("id"), F.col("rb").alias("partner_role")).unionByName(
        joined.select(KEY, F.col("b").alias("id"), F.col("ra").alias("partner_role"))
    ).groupBy(KEY, "id", "partner_role").agg(F.count(F.lit(1)).alias("taken"))
    return (
        usable.select(KEY, "id", "branch_role", F.explode(wanted).alias("partner_role"))
        .join(sizes, [KEY, "partner_role"]).join(taken, [KEY, "id", "partner_role"], "left")
        .select(KEY, "id", "branch_role", "partner_role", (F.col("n") - F.coalesce("taken", F.lit(0))).alias("partner_count"))
        .filter(F.col("partner_count") > 0)
    )


def cross_branch_pairs(catalog: DataFrame) -> DataFrame:
    """Unordered pairs of different branches per graph, by branch sizes alone."""
    sizes = catalog.groupBy(KEY, "branch_id").agg(F.count(F.lit(1)).alias("c"))
    return sizes.groupBy(KEY).agg((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("_twice")).select(
        KEY, F.floor(F.col("_twice") / 2).cast("bigint").alias("cross_branch_pair_count")
    )


def admissible_pair_total(catalog: DataFrame, edges: DataFrame) -> DataFrame:
    return pair_space(catalog, edges).filter(F.col("branch_role") == K.CONTAINS).groupBy(KEY).agg(
        F.sum("partner_count").cast("bigint").alias("cross_branch_pair_count")
    )


# --- shortlist: exact scores on bounded blocks ---------------------------------------
_SCORED = (
    f"{KEY} string, node_a_id string, node_b_id string, pair_id string, score double, near boolean, audit boolean"
)


def _gram_sets(texts: pd.Series) -> list[set[str]]:
    """Character 2- and 3-grams of each text, as ``text.grams`` builds them."""
    return [{t[i:i + n] for n in (2, 3) for i in range(len(t) - n + 1)} for t in texts]


def _postings(sets: list[set[str]]) -> dict[str, np.ndarray]:
    rows: dict[str, list[int]] = {}
    for i, grams in enumerate(sets):
        for g in grams:
            rows.setdefault(g, []).append(i)
    return {g: np.array(r) for g, r in rows.items()}


def _overlap(left: dict[str, np.ndarray], right: dict[str, np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """|A and B| for all cells of one block pair: products of 0/1 matrices over the shared grams."""
    common = [(left[g], right[g]) for g in left.keys() & right.keys()]
    result = np.zeros(shape, dtype=np.float32)
    for start in range(0, len(common), 4096):
        part = common[start:start + 4096]
        pair = []
        for side in (0, 1):
            matrix = np.zeros((shape[side], len(part)), dtype=np.float32)
            rows = np.concatenate([p[side] for p in part])
            matrix[rows, np.repeat(np.arange(len(part)), [len(p[side]) for p in part])] = 1.0
            pair.append(matrix)
        result += pair[0] @ pair[1].T
    return result


def _mentions(names: pd.Series, texts: list[str], postings: dict[str, np.ndarray]) -> np.ndarray:
    """1 where a name occurs in a text. A text that holds a name holds its grams: only texts with the name's rarest gram are searched."""
    found = np.zeros((len(names), len(texts)), dtype=np.float64)
    for name, rows in names.groupby(names).indices.items():
        grams = [name[i:i + n] for n in (2, 3) for i in range(len(name) - n + 1)]
        near = min((postings.get(g, ()) for g in grams), key=len) if grams else range(len(texts))
        hits = [j for j in near if name in texts[j]] if name else []
        found[np.ix_(rows, hits)] = 1.0
    return found


def _best_cells(value: np.ndarray, groups: np.ndarray, k: int) -> np.ndarray:
    """Mask of the cells among the k best of their row within a group of columns; cells that rounding might tie are kept too."""
    kept = np.zeros(value.shape, dtype=bool)
    for g in np.unique(groups):
        columns = np.flatnonzero(groups == g)
        part = value[:, columns]
        least = np.partition(part, -k, axis=1)[:, -k:-k + 1 or None] if len(columns) > k else np.full((len(value), 1), -np.inf)
        kept[:, columns] = part >= least - 2e-6
    return kept


def _keep_near(order: list[tuple], own: int, partner_branch: list[list[str]], k: int, near: set) -> None:
    taken: dict[tuple, int] = {}
    for _, _, i, j in order:
        mine, other = ((i, j) if own == 0 else (j, i))
        slot = (mine, partner_branch[own][other])
        if taken.get(slot, 0) < k:
            taken[slot] = taken.get(slot, 0) + 1
            near.add((i, j))


def _block_scorer(k: int):
    def score(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = [KEY, "node_a_id", "node_b_id", "pair_id", "score", "near", "audit"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        shape = (len(left), len(right))
        l_grams, r_grams = _gram_sets(left["text"]), _gram_sets(right["text"])
        l_post, r_post = _postings(l_grams), _postings(r_grams)
        sizes = np.sqrt(np.outer([float(len(g)) for g in l_grams], [float(len(g)) for g in r_grams]))
        l_texts, r_texts = left["text"].tolist(), right["text"].tolist()
        refs = _mentions(left["name"].fillna("").reset_index(drop=True), r_texts, r_post) + _mentions(right["name"].fillna("").reset_index(drop=True), l_texts, l_post).T
        apart = left["chain_position"].to_numpy()[:, None] != right["chain_position"].to_numpy()[None, :]
        value = _overlap(l_post, r_post, shape) / np.maximum(1.0, sizes) + 2.0 * refs + 0.05 * apart
        l_ids, r_ids = left["id"].tolist(), right["id"].tolist()
        place = {r: j for j, r in enumerate(r_ids)}

        def cells_of(lists: pd.Series) -> tuple[list[int], list[int]]:
            cells = [(i, place[r]) for i, partners in enumerate(lists) for r in partners if r in place]
            return [c[0] for c in cells], [c[1] for c in cells]

        value[cells_of(left["joined_to"])] = -np.inf
        audit = np.zeros(shape, dtype=bool)
        audit[cells_of(left["audit_with"])] = True
        branches = [right["branch_id"].tolist(), left["branch_id"].tolist()]
        wanted = _best_cells(value, right["branch_id"].to_numpy(), k) | _best_cells(value.T, left["branch_id"].to_numpy(), k).T
        cells = []
        for i, j in np.argwhere((wanted | audit) & (value > -np.inf)).tolist():
            a, b = sorted((l_ids[i], r_ids[j]))
            cells.append((-round(float(value[i, j]), 6), "p_" + hashlib.sha256(f"{a}\0{b}".encode()).hexdigest()[:16], i, j))
        cells.sort()
        near: set = set()
        _keep_near(cells, 0, branches, k, near)
        _keep_near(cells, 1, branches, k, near)
        out = [
            (key[0], *sorted((l_ids[i], r_ids[j])), pid, -negative, (i, j) in near, bool(audit[i, j]))
            for negative, pid, i, j in cells if (i, j) in near or audit[i, j]
        ]
        return pd.DataFrame(out, columns=columns)

    return score


def scored_pairs(
    catalog: DataFrame, edges: DataFrame, per_node: int = K.CANDIDATES_PER_NODE, audit_rate: float = K.NEGATIVE_AUDIT_RATE
) -> DataFrame:
    """Exact pair scores, emitted only where they can matter.

    The score of a pair depends on both texts, so each ``contains`` node meets each upstream and
    downstream node once. The graph is cut into blocks of about ``BLOCK_ROWS`` nodes per side and a
    task sees one block pair, however large the graph is, and scores it as matrices. From a block pair only
    the best ``per_node`` pairs of a node per partner branch leave the task (``near``), which is a superset of
    every quota below, plus the pairs of the audit sample. Nothing is cut without being outranked. The audit sample
    is drawn beforehand from the hashes of the ids alone.
    """
    usable = catalog.filter(F.col("branch_id") != "")
    text = catalog_text(usable)
    profile = usable.select(
        KEY, "id", "name", "chain_position", "branch_id", (F.col("branch_role") == K.CONTAINS).alias("is_left"), text.alias("text")
    )
    sizes = profile.groupBy(KEY).agg(
        F.greatest(F.lit(1), F.ceil(F.count_if("is_left") / BLOCK_ROWS)).cast("int").alias("nl"),
        F.greatest(F.lit(1), F.ceil(F.count_if(~F.col("is_left")) / BLOCK_ROWS)).cast("int").alias("nr"),
    )
    joined = _main_pairs(edges, usable)
    left_end = F.when(F.col("ra") == K.CONTAINS, F.col("a")).otherwise(F.col("b"))
    right_end = F.when(F.col("ra") == K.CONTAINS, F.col("b")).otherwise(F.col("a"))
    adjacent = joined.groupBy(KEY, left_end.alias("id")).agg(F.collect_set(right_end).alias("joined_to"))
    # both sides of the block join read the profiles
    placed = checkpointed(profile.join(sizes, KEY).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.when(F.col("is_left"), F.col("nl")).otherwise(F.col("nr")).cast("bigint")).cast("int")
    ))
    none = F.array().cast("array<string>")
    left = placed.filter("is_left").join(adjacent, [KEY, "id"], "left").select(
        KEY, F.col("block").alias("bl"), F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("br"), "id", "name", "chain_position",
        "branch_id", "text", F.coalesce("joined_to", none).alias("joined_to"),
    )
    right = placed.filter("NOT is_left").select(
        KEY, F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("bl"), F.col("block").alias("br"), "id", "name", "chain_position",
        "branch_id", "text",
    )
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # own column ids on this side
    if audit_rate > 0:
        met = left.select(KEY, "bl", "br", "id").join(right.select(KEY, "bl", "br", F.col("id").alias("other")), [KEY, "bl", "br"])
        drawn = met.filter(X.audit_selected(X.pair_id(F.col("id"), F.col("other")), audit_rate)).groupBy(KEY, "bl", "br", "id").agg(F.collect_set("other").alias("audit_with"))
        left = left.join(drawn, [KEY, "bl", "br", "id"], "left").withColumn("audit_with", F.coalesce("audit_with", none))
    else:
        left = left.withColumn("audit_with", none)
    return left.groupBy(KEY, "bl", "br").cogroup(right.groupBy(KEY, "bl", "br")).applyInPandas(
        _block_scorer(max(per_node, 1)), _SCORED
    )


def shortlist(scored: DataFrame, catalog: DataFrame, per_node: int = K.CANDIDATES_PER_NODE) -> DataFrame:
    """Selection reasons (industry_id, pair_id, node_id, reason) of the per-node shortlist.

    Stage 0: role quotas in their order. Stage 1: best pair of every partner branch. Stage 2: the
    rest by score. The first ``per_node`` pairs of a node in stage order are selected.
    """
    role = catalog.select(KEY, "id", "branch_id", "branch_role")
    pairs = scored.filter("near")
    ends = pairs.select(KEY, "pair_id", "score", F.col("node_a_id").alias("id"), F.col("node_b_id").alias("other")).unionByName(
        pairs.select(KEY, "pair_id", "score", F.col("node_b_id").alias("id"), F.col("node_a_id").alias("other"))
    )
    seen = (
        ends.join(role.select(KEY, "id", F.col("branch_role").alias("own_role")), [KEY, "id"])
        .join(role.select(KEY, F.col("id").alias("other"), F.col("branch_id").alias("other_branch"), F.col("branch_role").alias("other_role")), [KEY, "other"])
    )
    best = (F.desc("score"), F.asc("pair_id"))
    quota = F.lit(0)
    quota_order = F.lit(9)
    for own, other, order, n in K.ROLE_QUOTAS:
        hit = (F.col("own_role") == own) & (F.col("other_role") == other)
        quota, quota_order = F.when(hit, n).otherwise(quota), F.when(hit, order).otherwise(quota_order)
    ranked = (
        seen.withColumn("by_role", F.row_number().over(Window.partitionBy(KEY, "id", "other_role").orderBy(*best)))
        .withColumn("by_branch", F.row_number().over(Window.partitionBy(KEY, "id", "other_branch").orderBy(*best)))
        .withColumn("stage", F.when(F.col("by_role") <= quota, 0).when(F.col("by_branch") == 1, 1).otherwise(2))
        .withColumn("stage_order", F.when(F.col("stage") == 0, quota_order).otherwise(0))
    )
    chosen = top_rows(
        ranked, [KEY, "id"], [F.col("stage"), F.col("stage_order"), F.desc("score"), F.col("pair_id")], per_node, "place"
    )
    label = (
        F.when(F.col("stage") == 0, F.concat(F.lit("role_"), F.col("other_role")))
        .when(F.col("stage") == 1, "branch_diversity").otherwise("global_similarity")
    )
    return chosen.select(KEY, "pair_id", F.col("id").alias("node_id"), F.concat(F.col("id"), F.lit(":"), label).alias("reason"))


def candidate_pairs(scored: DataFrame, reasons: DataFrame, catalog: DataFrame) -> DataFrame:
    """Selected and audit pairs with names, branches, allowed verdicts, evidence and reasons."""
    why = reasons.groupBy(KEY, "pair_id").agg(F.array_sort(F.collect_set("reason")).alias("_why"))
    picked = scored.join(why, [KEY, "pair_id"], "left").filter(F.col("_why").isNotNull() | F.col("audit")).select(
        KEY, "pair_id", "node_a_id", "node_b_id", "score",
        F.coalesce("_why", F.array(F.lit(K.AUDIT_REASON))).alias("selection_reasons"),
    )
    return with_ends(picked, catalog)


def with_ends(pairs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Attach end columns, allowed verdicts and recall evidence to pairs."""
    cols = ("name", "branch_name", "branch_role", "path", "descendant_contexts", "node_content_hash")

    def side(s: str) -> DataFrame:
        return catalog.select(KEY, F.col("id").alias(f"node_{s}_id"), *[F.col(c).alias(f"_{s}_{c}") for c in cols])

    c = F.col
    joined = pairs.join(side("a"), [KEY, "node_a_id"]).join(side("b"), [KEY, "node_b_id"])
    a_to_b = allowed_direction(c("_a_branch_role"), c("_b_branch_role"))
    b_to_a = allowed_direction(c("_b_branch_role"), c("_a_branch_role"))
    verdicts = F.filter(F.array(F.when(a_to_b, "A_TO_B"), F.when(b_to_a, "B_TO_A")), lambda v: v.isNotNull())
    # evidence is listed from the end that comes first in catalog order (path, id)
    a_first = F.struct(c("_a_path"), c("node_a_id")) <= F.struct(c("_b_path"), c("node_b_id"))

    def mentions(s: str, o: str) -> Column:
        name = X.strip(c(f"_{o}_name"))
        texts = F.filter(c(f"_{s}_descendant_contexts"), lambda t: (name != "") & F.contains(t, name))
        return F.transform(texts, lambda t: F.struct(
            c(f"node_{s}_id").alias("source_node_id"), c(f"_{s}_name").alias("source_node_name"), t.alias("matched_descendant_context")
        ))

    evidence = F.slice(
        F.when(a_first, F.concat(mentions("a", "b"), mentions("b", "a"))).otherwise(F.concat(mentions("b", "a"), mentions("a", "b"))), 1, 4
    )
    own = [x for x in pairs.columns if x not in (KEY, "node_a_id", "node_b_id")]
    return joined.select(
        KEY, *own[:1], "node_a_id", "node_b_id", c("_a_name").alias("node_a_name"), c("_b_name").alias("node_b_name"),
        c("_a_branch_name").alias("node_a_branch"), c("_b_branch_name").alias("node_b_branch"),
        c("_a_branch_role").alias("node_a_branch_role"), c("_b_branch_role").alias("node_b_branch_role"),
        verdicts.alias("allowed_verdicts"), evidence.alias("recall_evidence"),
        c("_a_node_content_hash").alias("node_a_hash"), c("_b_node_content_hash").alias("node_b_hash"), *own[1:],
    )


def candidate_summary(pairs: DataFrame, totals: DataFrame, per_node: int = K.CANDIDATES_PER_NODE, rate: float = K.NEGATIVE_AUDIT_RATE) -> DataFrame:
    audit = F.array_contains("selection_reasons", K.AUDIT_REASON)
    counts = pairs.groupBy(KEY).agg(
        F.count_if(~audit).alias("shortlisted_pair_count"), F.count_if(audit).alias("negative_audit_pair_count"),
        F.count(F.lit(1)).alias("candidate_pair_count"),
    )
    return totals.join(counts, KEY, "left").select(
        KEY, "cross_branch_pair_count",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("shortlisted_pair_count", "negative_audit_pair_count", "candidate_pair_count")],
        F.lit(per_node).alias("candidates_per_node"), F.lit(rate).alias("negative_audit_rate"),
    )


# --- verdicts and cache ----------------------------------------------------------------
def with_cache_key(pairs: DataFrame, model: str = K.DEFAULT_MODEL, temperature: float = K.DEFAULT_TEMPERATURE) -> DataFrame:
    """Key over prompt version, model, temperature, ends, content hashes, allowed verdicts and evidence."""
    return pairs.withColumn(
        "cache_key",
        X.row_hash(
            F.lit(K.PAIR_PROMPT_VERSION).alias("prompt_version"), F.lit(model).alias("model"), F.lit(temperature).alias("temperature"),
            F.col("node_a_id"), F.col("node_b_id"), F.col("node_a_hash"), F.col("node_b_hash"), F.col("allowed_verdicts"), F.col("recall_evidence"),
        ),
    )


def usable_cache(cache: DataFrame) -> DataFrame:
    """Last valid row per cache key."""
    valid = cache.filter((F.coalesce("cache_key", F.lit("")) != "") & F.col("verdict").isin(*K.VERDICTS))
    return last_by(valid, ["cache_key"], ["pos"])


def split_by_cache(pairs: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions answered by the cache, pending pairs)."""
    known = usable_cache(cache).select("cache_key", "pair_id", F.col("verdict").alias("_cached"))
    joined = pairs.join(known, ["cache_key", "pair_id"], "left")
    hits = joined.filter(F.col("_cached").isNotNull()).select(
        KEY, "pair_id", F.col("_cached").alias("verdict"), F.lit("cache").alias("decision_source"), "cache_key"
    )
    return hits, joined.filter(F.col("_cached").isNull()).select(*pairs.columns)


def final_verdicts(pending: DataFrame, batch: DataFrame, retry: DataFrame) -> DataFrame:
    """Batch verdict, else retry verdict, else INVALID. ``batch``/``retry``: (pair_id, verdict)."""
    b = batch.select("pair_id", F.col("verdict").alias("_b"))
    r = retry.select("pair_id", F.col("verdict").alias("_r"))
    source = F.when(F.col("_b").isNotNull(), "model_batch").when(F.col("_r").isNotNull(), "model_single_retry").otherwise("invalid_after_retry")
    return pending.join(b, "pair_id", "left").join(r, "pair_id", "left").select(
        KEY, "pair_id", F.coalesce("_b", "_r", F.lit("INVALID")).alias("verdict"), source.alias("decision_source"), "cache_key"
    )


def retry_list(pending: DataFrame, batch: DataFrame) -> DataFrame:
    return pending.join(batch.select("pair_id"), "pair_id", "left_anti").select(*pending.columns)


def upsert_cache(cache: DataFrame, decisions: DataFrame, pairs: DataFrame, as_of: str, model: str = K.DEFAULT_MODEL, temperature: float = K.DEFAULT_TEMPERATURE) -> DataFrame:
    """Old usable rows and new valid verdicts, the newest per key."""
    ends = pairs.select(KEY, "pair_id", "node_a_id", "node_b_id")
    new = decisions.filter(F.col("verdict").isin(*K.VERDICTS)).join(ends, [KEY, "pair_id"]).select(
        "cache_key", "pair_id", "node_a_id", "node_b_id", "verdict", F.lit(model).alias("model"),
        F.lit(temperature).alias("temperature"), F.lit(as_of).alias("updated_at"),
    )
    old = usable_cache(cache).select(*new.columns)
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return last_by(both, ["cache_key"], ["_new", "pair_id"]).drop("_new")


def prune_by_l2(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Keep rows whose node_a_id and node_b_id are still L2 nodes."""
    l2 = nodes.filter(F.col("level") == 2)
    keys = [KEY] if KEY in rows.columns else []
    for column in ("node_a_id", "node_b_id"):
        rows = rows.join(l2.select(*keys, F.col("id").alias(column)).distinct(), [*keys, column], "left_semi")
    return rows


# --- edges ---------------------------------------------------------------------------------
def normalized_decisions(decisions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Decisions of known pairs; a verdict outside the allowed directions becomes NO with a rejection mark."""
    info = pairs.select(KEY, "pair_id", "node_a_id", "node_b_id", "allowed_verdicts", "selection_reasons")
    verdict = F.upper(F.coalesce("verdict", F.lit("INVALID")))
    rejected = verdict.isin("A_TO_B", "B_TO_A") & ~F.array_contains("allowed_verdicts", verdict)
    given = decisions.select(KEY, "pair_id", "verdict", "decision_source", "cache_key")
    return given.join(info, [KEY, "pair_id"]).select(
        KEY, "pair_id", "node_a_id", "node_b_id", F.when(rejected, "NO").otherwise(verdict).alias("verdict"),
        F.coalesce("decision_source", F.lit("model")).alias("decision_source"), F.coalesce("cache_key", F.lit("")).alias("cache_key"),
        "selection_reasons", F.when(rejected, "l1_branch_role_policy").alias("rule_rejection"),
    )


def materialize_edges(decisions: DataFrame, nodes: DataFrame, as_of: str) -> DataFrame:
    """Directed L2 edges of positive (normalized) decisions."""
    c = F.col
    forward = c("verdict") == "A_TO_B"
    positive = decisions.filter(c("verdict").isin("A_TO_B", "B_TO_A")).select(
        KEY, "pair_id", F.when(forward, c("node_a_id")).otherwise(c("node_b_id")).alias("source"),
        F.when(forward, c("node_b_id")).otherwise(c("node_a_id")).alias("target"),
    )
    info = nodes.select(KEY, "id", "name", "source_urls", "evidence_ids")

    def end(column: str, p: str) -> DataFrame:
        return info.select(KEY, c("id").alias(column), c("name").alias(p + "n"), c("source_urls").alias(p + "u"), c("evidence_ids").alias(p + "e"))

    joined = positive.join(end("source", "_s"), [KEY, "source"]).join(end("target", "_t"), [KEY, "target"])
    none = F.array().cast("array<string>")
    union = lambda a, b: F.array_sort(F.array_union(F.coalesce(a, none), F.coalesce(b, none)))
    return joined.select(
        KEY, X.edge_id(c("source"), F.lit(K.FLOW), c("target")).alias("id"), "source", "target", F.lit(K.FLOW).alias("relation_type"),
        F.lit(K.L2_FLOW_LAYER).alias("relation_layer"), F.lit(1.0).alias("relation_weight"),
        F.format_string(K.TEXT_FLOW_EDGE, F.coalesce("_sn", "source"), F.coalesce("_tn", "target")).alias("description"),
        union("_su", "_tu").alias("source_urls"), union("_se", "_te").alias("evidence_ids"),
        F.lit(K.ACCEPTED_RELATION_CONFIDENCE).alias("confidence"),
        F.lit("endpoint_graph_sources_and_pairwise_model_decision").alias("evidence_basis"),
        c("pair_id").alias("decision_pair_id"), F.lit(as_of).alias("updated_at"),
    )


def decision_summary(decisions: DataFrame) -> DataFrame:
    audit = F.array_contains("selection_reasons", K.AUDIT_REASON)
    positive = F.col("verdict").isin("A_TO_B", "B_TO_A")
    cached = F.col("decision_source") == "cache"
    return decisions.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("pair_decision_count"), F.count_if(cached).alias("cache_hit_count"),
        F.count_if(~cached).alias("model_decision_count"), F.count_if(audit & positive).alias("negative_audit_positive_count"),
        *[F.count_if(F.col("verdict") == v).alias("verdict_" + v.lower()) for v in (*K.VERDICTS, "INVALID")],
    )


def projection_members(l2_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every L2 edge seen from both L1 parents: two rows (source, target, role) per usable edge."""
    info = nodes.select(KEY, "id", "level", F.coalesce("parent_id", F.lit("")).alias("p"))
    level_one = nodes.filter(F.col("level") == 1).select(KEY, F.col("id").alias("p"))
    l2 = info.filter(F.col("level") == 2).join(level_one, [KEY, "p"], "left_semi")
    c = F.col
    usable = (
        l2_edges.withColumn("l2_source", c("source")).withColumn("l2_target", c("target")).join(l2.select(KEY, c("id").alias("source"), c("p").alias("_sp")), [KEY, "source"])
        .join(l2.select(KEY, c("id").alias("target"), c("p").alias("_tp")), [KEY, "target"])
        .filter(c("_sp") != c("_tp"))
    )
    views = F.array(
        F.struct(c("_sp").alias("s"), c("target").alias("t"), F.lit("source_parent_to_target").alias("role")),
        F.struct(c("source").alias("s"), c("_tp").alias("t"), F.lit("source_to_target_parent").alias("role")),
    )
    return usable.withColumn("_v", F.explode(views)).select(
        KEY, c("_v.s").alias("source"), c("_v.t").alias("target"), c("_v.role").alias("role"), c("id").alias("edge_id"),
        c("relation_weight"), c("confidence"), "source_urls", "evidence_ids", "l2_source", "l2_target",
    )


def project_flows(l2_edges: DataFrame, nodes: DataFrame, as_of: str) -> DataFrame:
    """L1-L2 projected edges. Member edges, urls and evidence are sorted distinct lists.

    Members are made distinct before they are collected, so a list holds the values of the result
    and nothing else.
    """
    members = projection_members(l2_edges, nodes)
    key = [KEY, "source", "target"]
    # input order of the edges is (source, target): the first member gives the weight
    base = members.groupBy(*key).agg(
        F.min_by("relation_weight", F.struct("l2_source", "l2_target")).alias("relation_weight"), F.min(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
        F.array_sort(F.collect_set("role")).alias("projection_roles"), F.countDistinct("edge_id").alias("projected_from_count"),
        F.array_sort(F.collect_set("edge_id")).alias("projected_from_edge_ids"),
    )

    def listed(column: str) -> DataFrame:
        values = members.select(*key, F.explode(column).alias("v")).filter(F.col("v") != "").distinct()
        return values.groupBy(*key).agg(F.array_sort(F.collect_list("v")).alias(column))

    none = F.array().cast("array<string>")
    name = nodes.select(KEY, "id", "name")
    c = F.col
    joined = (
        base.join(listed("source_urls"), key, "left").join(listed("evidence_ids"), key, "left")
        .join(name.select(KEY, c("id").alias("source"), c("name").alias("_sn")), [KEY, "source"])
        .join(name.select(KEY, c("id").alias("target"), c("name").alias("_tn")), [KEY, "target"])
    )
    return joined.select(
        KEY, X.edge_id(c("source"), F.lit(K.FLOW), c("target")).alias("id"), "source", "target", F.lit(K.FLOW).alias("relation_type"),
        F.lit(K.PROJECTION_LAYER).alias("relation_layer"), F.coalesce("relation_weight", F.lit(1.0)).alias("relation_weight"),
        F.format_string(K.TEXT_PROJECTION, "_sn", "_tn", c("projected_from_count").cast("string")).alias("description"),
        F.coalesce("source_urls", none).alias("source_urls"), F.coalesce("evidence_ids", none).alias("evidence_ids"), "confidence",
        F.lit("l2_flow_cross_level_projection").alias("evidence_basis"), "projection_roles", "projected_from_count",
        "projected_from_edge_ids", F.lit(as_of).alias("updated_at"),
    )


def retained_pairs(pairs: DataFrame, decisions: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs that have a decision and both ends still in the catalog (names refreshed), and their decisions."""
    ids = catalog.select(KEY, "id")
    alive = decisions.filter(F.col("pair_id") != "")
    for column in ("node_a_id", "node_b_id"):
        alive = alive.join(ids.withColumnRenamed("id", column), [KEY, column], "left_semi")
    alive = alive.select(*decisions.columns)
    info = catalog.select(KEY, "id", "name", "branch_name")
    kept = pairs.join(alive.select(KEY, "pair_id").distinct(), [KEY, "pair_id"], "left_semi")
    old = ("node_a_name", "node_b_name", "node_a_branch", "node_b_branch")
    kept = kept.drop(*old)
    for s in ("a", "b"):
        kept = kept.join(
            info.select(KEY, F.col("id").alias(f"node_{s}_id"), F.col("name").alias(f"node_{s}_name"), F.col("branch_name").alias(f"node_{s}_branch")),
            [KEY, f"node_{s}_id"],
        )
    decided = last_by(alive, [KEY, "pair_id"], ["cache_key"]).join(kept.select(KEY, "pair_id"), [KEY, "pair_id"], "left_semi")
    return kept, decided.select(*decisions.columns)


def retained_summary(kept: DataFrame, catalog: DataFrame) -> DataFrame:
    audit = F.array_contains("selection_reasons", K.AUDIT_REASON)
    counts = kept.groupBy(KEY).agg(F.count_if(~audit).alias("s"), F.count_if(audit).alias("a"), F.count(F.lit(1)).alias("n"))
    return cross_branch_pairs(catalog).join(counts, KEY, "left").select(
        KEY, "cross_branch_pair_count", F.coalesce("s", F.lit(0)).alias("shortlisted_pair_count"),
        F.coalesce("a", F.lit(0)).alias("negative_audit_pair_count"), F.coalesce("n", F.lit(0)).alias("candidate_pair_count"),
    )


def rebase_after_prune(decisions: DataFrame, l2_edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop decisions and edges whose ends left L2, and edges whose decision went away."""
    kept = prune_by_l2(decisions, nodes).select(*decisions.columns)
    l2 = nodes.filter(F.col("level") == 2).select(KEY, "id")
    edges = l2_edges
    for column in ("source", "target"):
        edges = edges.join(l2.withColumnRenamed("id", column), [KEY, column], "left_semi")
    edges = edges.join(kept.select(KEY, F.col("pair_id").alias("decision_pair_id")).distinct(), [KEY, "decision_pair_id"], "left_semi")
    return kept, edges.select(*l2_edges.columns)


def rebased_summary(decisions: DataFrame, summary: DataFrame) -> DataFrame:
    """Recount after a prune; the cache-hit number can only shrink. ``summary`` has the old cache_hit_count."""
    new = decision_summary(decisions).drop("cache_hit_count", "model_decision_count")
    old = summary.select(KEY, F.coalesce("cache_hit_count", F.lit(0)).alias("_hits"))
    hits = F.least(F.coalesce("_hits", F.lit(0)), F.col("pair_decision_count"))
    return new.join(old, KEY, "left").select(
        KEY, "pair_decision_count", hits.cast("bigint").alias("cache_hit_count"),
        (F.col("pair_decision_count") - hits).cast("bigint").alias("model_decision_count"), "negative_audit_positive_count",
        *[c for c in new.columns if c.startswith("verdict_")],
    )
