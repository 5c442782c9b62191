"""Steps that grow with the input: rows spread over tasks sized by it, and tables that nobody asked for are not written."""

from pyspark.sql import functions as F

import samples as S
from linkstrata.catalog import company as CC
from linkstrata.catalog import curate
from linkstrata.functions.tables import gathered
from linkstrata.operators import companies as C
from linkstrata.operators import export as E
from linkstrata.operators import query as Q
from linkstrata.sources.derived import GraphTables

KEY = "industry_id"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_stay_spread_after_an_aggregate_by_the_same_keys(spark):
    pairs = spark.range(200).selectExpr("cast(id % 5 AS string) AS industry_id", "cast(id % 40 AS string) AS company_id").distinct()
    spread = gathered(pairs, KEY, "company_id")
    kept = spread.groupBy(KEY, "company_id").agg(F.count("*").alias("n"))
    assert "REPARTITION_BY_NUM" in plan(kept)
    assert sorted(map(tuple, spread.collect())) == sorted(map(tuple, pairs.collect()))


def test_page_orders_by_the_number_of_a_company(spark):
    people = spark.createDataFrame([(f"c{i}", f"{i:03}", name) for i, name in enumerate(["b", "a", None, "a", "B", "c"])] + [("c1", "000", "z")], "company_id string, comcode string, name string")
    rollup = spark.createDataFrame([("g", n, f"c{i}", 1, True) for n in ("x", "y") for i in range(6)], "industry_id string, node_id string, company_id string, direct_node_count long, is_direct boolean")
    page = Q.company_page(rollup, people, limit=4, offset=1)
    want = [(1 + i, c, name) for i, (c, name) in enumerate([("c4", "B"), ("c1", "a"), ("c3", "a"), ("c0", "b")], 1)]
    for node in ("x", "y"):
        assert [tuple(r) for r in page.filter(F.col("node_id") == node).orderBy("rank").select("rank", "company_id", "company_name").collect()] == want
    assert {r["total"] for r in page.collect()} == {6}
    assert "collate(" not in plan(Q.company_page(rollup, people, limit=4, locale="zh"))


def test_company_edges_are_spread_by_company(spark):
    n = S.nodes(spark, S.ROLL_NODES).withColumn("id", F.replace("id", F.lit("food_beverage"), F.lit("t")))
    paths = spark.createDataFrame([("t", "t_001", ["t_000"])], f"{KEY} string, id string, path array<string>")
    people, a = S.companies(spark, [("sw_listed", True, None)]), S.attachments(spark, [("sw_listed", "t_001")])
    metadata = spark.createDataFrame([("t", "FOOD", "Food", "01")], f"{KEY} string, code string, delivery_name string, ind_id string")
    heads = spark.createDataFrame([("t", "2024-01-01")], f"{KEY} string, generated_at string")
    out = E.company_edge_rows(a, C.payload_companies(a, people), n, paths, heads, metadata, "2024-06-01")
    assert "REPARTITION_BY_NUM" in plan(out)
    assert S.rows(out, "终点节点id") == [("FOOD000000",), ("FOOD000001",)]


def test_removals_alone_are_written(spark):
    n, e = S.nodes(spark, S.ROLL_NODES), S.edges(spark, S.ROLL_EDGES)
    g = GraphTables(spark, "none")
    g._known.update(nodes=n, edges=e, attachments=S.attachments(spark, [("sw_listed", "food_beverage_001")]), companies=S.companies(spark, [("sw_listed", True, None)]))
    removed = CC.collapsed(g, "removed")
    assert removed.count() > 0 and {x for x in g._known if x.startswith("fold_")} == {"fold_removed"}
    want = C.collapse_low_coverage(n, e, g("attachments"), g("companies"), 30)
    assert S.rows(removed, "id") == S.rows(want[3], "id") and S.rows(CC.collapsed(g, "pairs"), "node_id") == S.rows(want[2], "node_id")


def test_merge_writes_only_the_table_that_is_asked_for(spark):
    staged = S.nodes(spark, [("t_000", "测试行业", 0, "root", ""), ("t_001", "a", 1, "upstream", "t_000"), ("t_002", "b", 1, "midstream", "t_000")]).select(
        KEY, F.when(F.col("level") == 1, F.col("pos").cast("int")).otherwise(0).alias("graph_no"), "pos", "id", "name", "level", "chain_position", "parent_id", "description", "source_urls", "evidence_ids", "confidence")
    heads = S.graphs(spark).withColumn("source_basis", F.expr("array(named_struct('name', 'Report A', 'url', 'https://basis.example.org/t/a', 'note', 'first'))"))
    g = GraphTables(spark, "none")
    g._known.update(staged_nodes=staged, graphs=heads)
    basis = curate._merged(g, "graphs").first()["source_basis"]
    assert [b["url"] for b in basis] == [f"https://basis.example.org/t/{x}" for x in ("a", "branch1", "branch2")]
    assert {x for x in g._known if x.startswith("staged_")} == {"staged_nodes", "staged_graphs_out"}
