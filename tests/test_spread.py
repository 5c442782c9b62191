"""Steps over pairs of companies and nodes: rows move once, in as many tasks as their size asks for."""

import re

from linkstrata.functions import tables as TB
from linkstrata.operators import companies as C
from linkstrata.operators import query as Q
from linkstrata.sources.derived import _REF, GraphTables
from linkstrata.sources.derived_sql import DEFINITIONS

PART = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int"
LINE = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_discount double"


def moves(df):
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_supply_groups_numbers_and_keeps_its_rows(spark, tmp_path):
    parts = [(1, "a", "B1", "X", 4), (2, "a", "B1", "X", 4), (2, "a", "B1", "X", 4), (3, "b", "B1", "X", 40), (4, "a", "B2", "Y", None), (5, None, "B1", "X", 4), (None, "c", "B1", "X", 4), (6, "d", "B1", None, 4)]
    lines = [(o, p, s, n, d) for o, (p, s, n, d) in enumerate(
        [(1, 7, 1, 0.1), (1, 7, 2, 0.3), (2, 7, 1, 0.2), (3, 7, 1, None), (4, 8, 1, 0.0), (5, 7, 1, 0.1), (None, 7, 1, 0.1), (1, None, 1, 0.1), (6, 7, 1, 0.1), (9, 7, 1, 0.1)])]
    spark.createDataFrame(parts, PART).write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame(lines, LINE).write.parquet(str(tmp_path / "lineitem.parquet"))
    g = GraphTables(spark, str(tmp_path))
    sql = DEFINITIONS["supply"]
    want = spark.sql(sql, **{ref: g(ref) for ref in set(_REF.findall(sql))})
    assert g("supply").columns == want.columns and g("supply").dtypes == want.dtypes
    assert sorted(map(repr, g("supply").collect())) == sorted(map(repr, want.collect())) and want.count() == 4
    plan = g._supply()._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[leaf_no#\d+L?, l_suppkey#\d+L?\]", plan)  # no text in the keys of the large aggregate


def test_tasks_follow_the_size_of_the_input(spark, tmp_path, monkeypatch):
    spark.range(5000).selectExpr("id", "id % 7 AS k").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    assert TB.gathered(rows, "k").rdd.getNumPartitions() == 4
    monkeypatch.setattr(TB, "BYTES_PER_TASK", 1000)
    assert TB.gathered(rows, "k").rdd.getNumPartitions() == -(-TB.input_bytes(rows) // 1000) > 4
    crossed = rows.crossJoin(rows.withColumnRenamed("k", "j").select("j"))
    assert TB.input_bytes(crossed) == 2 * TB.input_bytes(rows)


def _stored(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def test_rollup_moves_pairs_once(spark, tmp_path):
    pairs = _stored(spark, tmp_path, "a", [("i", "n1", "c1"), ("i", "n2", "c1"), ("i", "n2", "c1"), ("i", "n0", "c2"), (None, "n1", "c1")], "industry_id string, node_id string, company_id string")
    above = _stored(spark, tmp_path, "h", [("i", n, n, 0) for n in ("n0", "n1", "n2")] + [("i", "n1", "n0", 1), ("i", "n2", "n0", 1)], "industry_id string, id string, ancestor string, dist int")
    firms = _stored(spark, tmp_path, "c", [("c1",), ("c2",)], "company_id string")
    out = Q.company_rollup(pairs, firms, above)
    moved = moves(out)  # before it runs: the plan is printed twice afterwards
    assert sorted(map(tuple, out.collect())) == [("i", "n0", "c1", 2, False), ("i", "n0", "c2", 1, True), ("i", "n1", "c1", 1, True), ("i", "n2", "c1", 1, True)]
    assert moved - moves(firms.select("company_id").distinct()) == 1


def test_matches_are_spread_before_they_meet_the_nodes(spark, tmp_path):
    columns = ("indunamesw", "indunamesw1", "indunamesw2", "indunamesw3")
    firms = _stored(spark, tmp_path, "c", [("c1", "Steel", "", "", "steel Ⅱ"), ("c2", "Wood", None, "", "")], "company_id string, " + ", ".join(f"{c} string" for c in columns))
    nodes = _stored(spark, tmp_path, "n", [("i", "n1", "steel", 1), ("i", "n2", "Steel", 2), ("i", "n3", "wood", 0)], "industry_id string, id string, name string, level int")
    chosen = _stored(spark, tmp_path, "s", [("i", "c1"), ("i", "c2")], "industry_id string, company_id string")
    out = C.taxonomy_matches(nodes, firms, chosen)
    assert [(r.company_id, r.node_id, r.taxonomy_column) for r in out.collect()] == [("c1", "n2", "indunamesw3")]
    assert re.search(r"RepartitionByExpression \[industry_id#\d+, company_id#\d+\]", out._jdf.queryExecution().optimizedPlan().toString())
