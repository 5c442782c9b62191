import random

from pyspark.sql import functions as F

import samples as S
from linkstrata.functions import tables as TB
from linkstrata.operators import hierarchy as HI
from linkstrata.operators import validate as V
from linkstrata.operators.standardize import remove_singleton_leaves, standardize_graph

AS_OF = "2024-06-01"


def test_singleton_leaf_is_removed(spark):
    n = S.nodes(spark, [("root", "测试行业", 0, "root", None), ("category", "饮料", 2, None, "root"), ("nfc", "NFC果汁", 3, None, "category")])
    e = S.edges(spark, [("root", "category", "contains"), ("category", "nfc", "contains")])
    out_n, out_e = standardize_graph(S.graphs(spark), n, e, AS_OF)
    assert {r[0] for r in S.rows(out_n, "id")} == {"root", "category"}
    assert S.rows(out_e, "source", "target") == [("root", "category")]


def test_only_child_of_root_and_inner_nodes_stay(spark):
    n = S.nodes(spark, [("root", "r", 0, "root", None), ("branch", "b", 1, None, "root"), ("category", "c", 2, None, "branch"), ("p1", "p", 3, None, "category"), ("p2", "q", 3, None, "category")])
    e = S.edges(spark, [("root", "branch", "contains"), ("branch", "category", "contains"), ("category", "p1", "contains"), ("category", "p2", "contains")])
    out_n, _ = standardize_graph(S.graphs(spark), n, e, AS_OF)
    assert len(S.rows(out_n, "id")) == 5


def test_level_one_flow_and_second_run(spark):
    n, e = standardize_graph(S.graphs(spark), S.nodes(spark, S.FLOW_NODES), S.edges(spark, S.FLOW_EDGES), AS_OF, collapse=False)
    parents = dict(S.rows(n, "id", "parent_id"))
    assert parents["l1_raw"] == "" and parents["l1_product"] == "" and parents["l1_process"] == "root"
    flows = [(s, t) for s, t, r in S.rows(e, "source", "target", "relation_type") if r == "upstream_downstream"]
    assert flows == [("l1_raw", "root"), ("root", "l1_product")]
    n2, e2 = standardize_graph(S.graphs(spark), n, e, AS_OF, collapse=False)
    assert n.exceptAll(n2.select(*n.columns)).isEmpty() and e.drop("pos").exceptAll(e2.drop("pos")).isEmpty()
    _, _, report = remove_singleton_leaves(n, e)
    assert S.rows(report, "child_id") == [("milling",)]


def test_flow_edges_do_not_extend_the_rollup(spark):
    n, e = S.nodes(spark, S.ROLL_NODES), S.edges(spark, S.ROLL_EDGES)
    h = HI.closure(HI.ancestor_paths(HI.aggregation_parents(n, e)), n)
    below = {}
    for node, ancestor, _ in S.rows(h, "id", "ancestor", "dist"):
        below.setdefault(ancestor, set()).add(node)
    assert below["food_beverage_000"] == {"food_beverage_000"}
    assert below["food_beverage_001"] == {"food_beverage_001", "food_beverage_002"}
    assert below["food_beverage_003"] == {"food_beverage_003"}


def test_ancestor_paths_against_a_walk_with_cycles(spark):
    rng = random.Random(3)
    parents = {f"n{i}": f"n{rng.randrange(40)}" for i in range(40)}
    parents.update({f"c{i}": f"c{i + 1}" for i in range(12)})
    df = spark.createDataFrame([("t", k, v) for k, v in parents.items()], "industry_id string, id string, parent_id string")

    def walk(start):
        path, seen, cur = [], {start}, parents.get(start)
        while cur and cur not in seen:
            path.append(cur)
            seen.add(cur)
            cur = parents.get(cur)
        return path

    got = {r["id"]: list(r["path"]) for r in HI.ancestor_paths(df).collect()}
    assert got == {k: walk(k) for k in parents}


def test_numbered_matches_a_window_with_a_hot_key(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.hash("id").alias("v"), "id")
    got = {(r["k"], r["id"]): r["rn"] for r in TB.numbered(df, ["k"], ["v", "id"]).collect()}
    want = {}
    for k in {key for key, _ in got}:
        ordered = sorted((r["v"], r["id"]) for r in df.filter(F.col("k") == k).collect())
        want.update({(k, i): n for n, (_, i) in enumerate(ordered, 1)})
        if len(want) > 700:
            break
    assert all(got[key] == n for key, n in want.items())


def test_lookup_spreads_large_dimensions(spark, monkeypatch):
    dim = spark.createDataFrame([("a", 1), ("b", 2)], "industry_id string, x int")
    rows = spark.createDataFrame([("a", str(i)) for i in range(50)] + [("c", "z")], "industry_id string, id string")
    small = S.rows(TB.lookup(rows, dim, ["industry_id"]), "industry_id", "id")
    monkeypatch.setattr(TB, "BROADCAST_LIMIT_BYTES", -1)
    salted = TB.lookup(rows, dim, ["industry_id"])
    assert S.rows(salted, "industry_id", "id") == small and salted.filter("x = 1").count() == 50


def test_first_and_last_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 5, None)], "k string, pos int, v string")
    assert S.rows(TB.first_by(df, ["k"], ["pos"]), "k", "v") == [("a", "x"), ("b", None)]
    assert S.rows(TB.last_by(df, ["k"], ["pos"]), "k", "v") == [("a", "y"), ("b", None)]


def test_contains_depth_is_longest_breadth_first_distance(spark):
    n = S.nodes(spark, [("r", "r", 0, "root", None), ("a", "a", 1, "support", "r"), ("b", "b", 1, "support", "a"), ("c", "c", 1, "support", "b")])
    e = S.edges(spark, [("r", "a", "contains"), ("a", "b", "contains"), ("b", "c", "contains"), ("c", "a", "contains")])
    assert S.rows(V.contains_depth(n, e), "max_contains_depth") == [(3,)]


def test_tree_listing_order(spark):
    n = S.nodes(spark, S.FLOW_NODES)
    n = n.withColumn("parent_id", F.when(F.col("id").isin("l1_raw", "l1_product"), "").otherwise(F.col("parent_id")))
    listed = HI.tree_listing(n, HI.ancestor_paths(HI.tree_parents(n))).orderBy("sort_key").collect()
    assert [r["id"] for r in listed] == ["root", "l1_process", "milling", "l1_product", "candy", "liquor", "l1_raw", "grain", "sugar"]
    assert listed[2]["line"] == "    - L2 粮食加工 (`milling`)"
