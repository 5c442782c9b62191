import random

import pytest
from pyspark.sql import functions as F

import samples as S
from linkstrata.operators import companies as C
from linkstrata.operators import export as E
from linkstrata.operators import hierarchy as HI
from linkstrata.operators import merge as M
from linkstrata.operators import query as Q
from linkstrata.operators import validate as V

PEOPLE = [("sw_listed", True, None), ("sw_abroad", None, True), ("sw_abroad_no", False, True), ("sw_no", False, None), ("sw_blank", None, None)]
PAIRS = [("sw_listed", "a_001"), ("sw_abroad", "a_001"), ("sw_abroad_no", "a_002"), ("sw_no", "a_001"), ("sw_blank", "a_002")]


def test_listed_filter(spark):
    a, people = S.attachments(spark, PAIRS), S.companies(spark, PEOPLE)
    assert S.rows(C.listed_companies(people), "company_id") == [("sw_listed",)]
    assert len(S.rows(C.listed_companies(people, include_abroad=True), "company_id")) == 3
    payload = C.payload_companies(a, people)
    kept, retained = C.filter_listed(a, payload)
    assert S.rows(kept, "company_id") == [("sw_listed",)] and S.rows(retained, "company_id") == [("sw_listed",)]
    stats = C.listed_filter_stats(a, payload).collect()[0]
    assert (stats["company_count_before"], stats["company_count_after"], stats["attachment_removed"]) == (5, 1, 4)
    assert (stats["listed_abroad_only_count"], stats["removed_false"], stats["removed_null"]) == (2, 2, 2)
    again, same = C.filter_listed(kept, retained)
    assert S.rows(again, "company_id", "node_id") == S.rows(kept, "company_id", "node_id") and same.count() == 1


def graph(spark):
    return S.nodes(spark, S.ROLL_NODES), S.edges(spark, S.ROLL_EDGES)


def test_rollup_and_company_edges(spark):
    n, e = graph(spark)
    paths = HI.ancestor_paths(HI.aggregation_parents(n, e))
    people = S.companies(spark, [("sw_listed", True, None)])
    a = S.attachments(spark, [("sw_listed", "food_beverage_001")])
    seen = Q.company_rollup(a, people, HI.closure(paths, n))
    assert S.rows(seen, "node_id", "company_id", "is_direct") == [("food_beverage_001", "sw_listed", True)]
    meta = spark.createDataFrame([("t", "FOOD", "食品饮料", "041800")], "industry_id string, code string, delivery_name string, ind_id string")
    rows = E.node_rows(n.withColumn("id", F.replace("id", F.lit("food_beverage"), F.lit("t"))), S.graphs(spark), meta, "2024-06-01")
    table = {r["节点id"]: r for r in rows.collect()}
    assert table["FOOD000000"]["节点标签"] == "level_0" and table["FOOD000000"]["公司列表"] == ""
    assert table["FOOD000001"]["产业链环节"] == "上游" and table["FOOD000002"]["产业链环节"] == ""
    assert table["FOOD000001"]["生效时间"] == "2024-05-01"


def test_fixed_delivery_mapping(spark):
    meta = E.delivery_metadata(spark)
    assert meta.count() == 27 and meta.filter("industry_id = 'food_beverage'").collect()[0]["code"] == "FOOD"


def test_prune_and_singleton_move(spark):
    n, e = graph(spark)
    people = S.companies(spark, [("sw_listed", True, None)])
    a = S.attachments(spark, [("sw_listed", "food_beverage_002")])
    above = HI.closure(HI.ancestor_paths(HI.aggregation_parents(n, e)))
    kept, _, _, removed = C.prune_to_coverage(n, e, a, people, above)
    assert {r[0] for r in S.rows(kept, "id")} == {"food_beverage_000", "food_beverage_001", "food_beverage_002"}
    assert S.rows(removed, "id", "level") == [("food_beverage_003", 2)]
    n2, _, moved, report = C.collapse_attached_singletons(n, e, a)
    assert S.rows(report, "child_id") == [("food_beverage_002",)]
    assert S.rows(moved, "node_id") == [("food_beverage_001",)] and ("food_beverage_002",) not in S.rows(n2, "id")


def test_deepest_match_wins(spark):
    n, e = graph(spark)
    above = HI.closure(HI.ancestor_paths(HI.aggregation_parents(n, e)))
    matches = S.attachments(spark, [("sw_a", "food_beverage_001"), ("sw_a", "food_beverage_002"), ("sw_a", "food_beverage_000"), ("sw_b", "food_beverage_001"), ("sw_c", "food_beverage_001")])
    selected = spark.createDataFrame([("t", "sw_a"), ("t", "sw_b")], "industry_id string, company_id string")
    built = C.build_attachments(matches.withColumn("confidence", F.lit("bad")), selected, n, above)
    assert S.rows(built, "company_id", "node_id", "confidence") == [("sw_a", "food_beverage_002", 0.75), ("sw_b", "food_beverage_001", 0.75)]


def brute_collapse(parents, levels, pairs, threshold):
    """Round by round on dictionaries: (surviving nodes, {(company, node): (reason, last source)})."""
    alive, table = set(levels), [(c, n, r, None) for c, n, r in pairs]
    while True:
        inner = {parents[i] for i in alive if parents.get(i) in alive}
        direct = {}
        for c, n, _, _ in table:
            direct.setdefault(n, set()).add(c)
        thin = {i for i in alive if levels[i] > 0 and parents.get(i) in alive and i not in inner and len(direct.get(i, ())) <= threshold}
        if not thin:
            return alive, {(c, n): (r, s) for c, n, r, s in table}
        merged = {}
        for c, n, r, s in table:
            to = parents[n] if n in thin else n
            row = (c, to, r, n if to != n else s)
            if (c, to) not in merged or to == n:
                merged[(c, to)] = row
        table, alive = list(merged.values()), alive - thin


def test_low_coverage_collapse_against_rounds(spark):
    rng = random.Random(11)
    node_rows, edge_rows, pair_rows, want = [], [], [], []
    people = [f"sw_{i}" for i in range(6)]
    for t in range(12):
        ind, size = f"g{t}", rng.randrange(3, 14)
        ids = [f"n{i:02d}" for i in range(size)]
        parents = {ids[i]: ids[rng.randrange(i)] for i in range(1, size)}
        levels = {ids[0]: 0}
        for i in ids[1:]:
            levels[i] = levels[parents[i]] + 1
        pairs = [(c, n, f"r{k}") for k, (c, n) in enumerate(sorted({(rng.choice(people), rng.choice(ids[1:])) for _ in range(size * 2)}, key=lambda _: rng.random()))]
        node_rows += [(ind, k, i, i, levels[i], "support", parents.get(i, "")) for k, i in enumerate(ids)]
        pair_rows += [(ind, k, c, n, r) for k, (c, n, r) in enumerate(pairs)]
        want.append((ind, *brute_collapse(parents, levels, pairs, 2)))
    n = spark.createDataFrame(node_rows, "industry_id string, pos bigint, id string, name string, level int, chain_position string, parent_id string")
    e = spark.createDataFrame(edge_rows, "industry_id string, pos bigint, source string, target string, relation_type string")
    a = spark.createDataFrame(pair_rows, "industry_id string, pos bigint, company_id string, node_id string, reason string")
    kept, _, moved, _ = C.collapse_low_coverage(n, e, a, S.companies(spark, [(p, True, None) for p in people]), 2)
    kept_rows = S.rows(kept, "industry_id", "id")
    moved_rows = {(i, c, x): (r, s) for i, c, x, r, s in (tuple(r) for r in moved.select("industry_id", "company_id", "node_id", "reason", "aggregation_source_node_id").collect())}
    assert kept_rows == sorted((ind, i) for ind, alive, _ in want for i in alive)
    assert moved_rows == {(ind, c, x): v for ind, _, table in want for (c, x), v in table.items()}


def test_attachment_rules_on_clean_and_bad_rows(spark):
    n, e = graph(spark)
    above = HI.closure(HI.ancestor_paths(HI.aggregation_parents(n, e)))
    people = S.companies(spark, [("sw_listed", True, None)])
    none = spark.createDataFrame([], "industry_id string, company_id string, node_id string")
    good = S.attachments(spark, [("sw_listed", "food_beverage_002")])
    assert V.attachment_issues(good, C.payload_companies(good, people), people, n, above, none).isEmpty()
    bad = S.attachments(spark, [("sw_listed", "food_beverage_002"), ("sw_listed", "food_beverage_001"), ("sw_x", "food_beverage_000")])
    codes = {r[0] for r in S.rows(V.attachment_issues(bad, C.payload_companies(bad, people), people, n, above, none), "code")}
    assert codes == {"ancestor_descendant_attachment", "attachment_unknown_company", "root_direct_attachment"}


def test_collapse_merges_repeated_pairs_everywhere(spark):
    n = S.nodes(spark, [("r", "r", 0, "root", ""), ("a", "a", 1, "support", "r"), ("b", "b", 1, "support", "r")])
    e = S.edges(spark, [("r", "a", "contains"), ("r", "b", "contains")])
    people = S.companies(spark, [(f"c{i}", True, None) for i in range(4)])
    a = S.attachments(spark, [("c0", "a"), ("c1", "a"), ("c2", "a"), ("c0", "a"), ("c3", "b")])
    a = a.withColumn("reason", F.col("pos").cast("string"))
    kept, _, moved, _ = C.collapse_low_coverage(n, e, a, people, 2)
    assert S.rows(kept, "id") == [("a",), ("r",)]
    assert S.rows(moved, "company_id", "node_id", "reason") == [("c0", "a", "3"), ("c1", "a", "1"), ("c2", "a", "2"), ("c3", "r", "4")]


def test_transplant_refuses_a_subtree_planned_twice(spark):
    n = S.nodes(spark, [("r", "r", 0, "root", ""), ("a", "a", 1, "support", "r"), ("b", "b", 2, "support", "a")])
    paths = HI.ancestor_paths(HI.tree_parents(n))
    plan = "industry_id string, branch_id string, step int, old_id string, start_level int, whole boolean"
    branches = spark.createDataFrame([("t", "x", "support", "s", [], [])], "industry_id string, branch_id string, chain_position string, chain_segment string, source_urls array<string>, evidence_ids array<string>")
    manual = spark.createDataFrame([], "industry_id string, branch_id string, step int, key string, name string, level int, description string, parent_key string, template_key string")
    drops = spark.createDataFrame([], "industry_id string, id string")
    once = M.transplant(n, paths, spark.createDataFrame([("t", "x", 1, "a", 2, True)], plan), branches, manual, drops, "2024-06-01")[0]
    assert S.rows(once, "id", "parent_id", "name") == [("x_001", "x", "a"), ("x_002", "x_001", "b")]
    with pytest.raises(ValueError, match="planned twice"):
        M.transplant(n, paths, spark.createDataFrame([("t", "x", 1, "a", 2, True), ("t", "x", 2, "a", 2, True)], plan), branches, manual, drops, "2024-06-01")


def test_grouped_remap_against_single_rows(spark):
    """Old nodes of one node are counted and checked as a group, with the findings of the single rows."""
    n = S.nodes(spark, [("r", "root", 0, "root", None), ("a", "A", 1, "midstream", "r"), ("b", "B", 2, "midstream", "a"), ("c", "C", 2, "midstream", "a")])
    e = S.edges(spark, [("r", "a", "contains"), ("a", "b", "contains"), ("a", "c", "contains")])
    old = [("x", "x1"), ("x", "x2"), ("x", "x3"), ("b", "b"), ("b", "b1"), ("gone", "g1"), ("gone", "g2"), ("c", "c1"), ("up", "u1")]
    members = spark.createDataFrame([("t", g, o) for g, o in old], "industry_id string, node_id string, old_id string")
    parents = {"x": "b", "x1": "x", "x2": "x", "x3": "x", "b1": "b", "c1": "c", "u1": "a", "b": "a", "c": "a", "g1": "gone", "g2": "gone"}
    paths = HI.ancestor_paths(spark.createDataFrame([("t", k, v) for k, v in parents.items()], "industry_id string, id string, parent_id string"))
    a = S.attachments(spark, [("sw_1", "x"), ("sw_1", "up"), ("sw_2", "b"), ("sw_3", "gone"), ("sw_4", "c"), ("sw_5", "x"), (None, "x"), ("sw_6", "c")])
    a = a.withColumn("confidence", F.when(F.col("company_id") == "sw_5", 1.5).otherwise(F.col("confidence")))
    single = C.remap_to_survivors(C.old_attachments(a, members), n, paths)
    grouped = C.remap_groups(a, members, n, paths)
    assert single.count() == 16 and grouped.count() == 9
    want = S.rows(single.groupBy("company_id", "node_id", "outcome").count(), F.coalesce("company_id", F.lit("")), F.coalesce("node_id", F.lit("")), "outcome", "count")
    assert S.rows(grouped.groupBy("company_id", "node_id", "outcome").agg(F.sum("copies").alias("n")), F.coalesce("company_id", F.lit("")), F.coalesce("node_id", F.lit("")), "outcome", "n") == want
    people = S.companies(spark, [(f"sw_{i}", True, None) for i in range(1, 6)])
    required = spark.createDataFrame([("t", "sw_4", "a"), ("t", "sw_4", "b"), ("t", "sw_2", "b"), ("t", "sw_2", "c")], "industry_id string, company_id string, node_id string")
    above = HI.closure(HI.ancestor_paths(HI.aggregation_parents(n, e)))
    text = [F.coalesce(c, F.lit("")) for c in ("severity", "code", "item_id")]
    found = [S.rows(V.attachment_issues(k, C.payload_companies(k, people), people, n, above, required), *text) for k in (
        t.filter("outcome <> 'dropped'").drop("outcome") for t in (single, grouped))]
    assert found[0] == found[1]
    assert {f[1] for f in found[0]} == {"duplicate_attachment", "ancestor_descendant_attachment", "attachment_unknown_company", "attachment_confidence_invalid", "obvious_taxonomy_match_missing"}
    assert [f[2] for f in found[0] if f[1] == "obvious_taxonomy_match_missing"] == ["sw_2->c", "sw_4->b"]


def test_last_row_of_a_pair_and_pairs_above_others(spark):
    n = S.nodes(spark, [("r", "root", 0, "root", None), ("a", "A", 1, "midstream", "r"), ("b", "B", 2, "midstream", "a")])
    above = HI.closure(HI.ancestor_paths(HI.aggregation_parents(n, S.edges(spark, []))))
    m = S.attachments(spark, [("sw_1", "b"), ("sw_1", "b"), ("sw_1", "a"), ("sw_2", "a"), ("sw_2", "a"), ("sw_3", "r")]).withColumn("confidence", F.lit("0.5"))
    chosen = m.select("industry_id", "company_id").distinct()
    assert S.rows(C.build_attachments(m, chosen, n, above), "company_id", "node_id", "reason") == [("sw_1", "b", "reason 1"), ("sw_2", "a", "reason 4")]
    assert S.rows(C.build_attachments(m.withColumn("pos", F.lit(None).cast("bigint")), chosen, n, above), "company_id", "node_id") == [("sw_1", "b"), ("sw_2", "a")]
