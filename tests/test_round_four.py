"""The attachment job, the remap and the company rules on large tables: what is one row an industry is sent to the tasks, and rows are moved and written once."""

import pytest
from pyspark.sql import functions as F

import samples as S
from linkstrata.catalog import company as CC
from linkstrata.functions.tables import stored
from linkstrata.operators import companies as C
from linkstrata.operators import hierarchy as HI
from linkstrata.operators import merge as M
from linkstrata.operators import publish as P
from linkstrata.operators import validate as V
from linkstrata.plans import attachment as A

KEY = "industry_id"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """No table is taken for small by its size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_gates_and_publication_move_no_rows(spark, no_broadcast):
    a = S.attachments(spark, [("sw_1", "a"), ("sw_2", "b")]).unionByName(S.attachments(spark, [("sw_1", "c")], "u")).unionByName(S.attachments(spark, [("sw_1", "d")], None))
    gate = A._Gate(spark.createDataFrame([("t",), ("u",)], "industry_id string"))
    gate.drop(spark.createDataFrame([("u",)], "industry_id string"), "late")
    kept = gate.keep(a)
    assert S.rows(kept, KEY, "node_id") == [("t", "a"), ("t", "b")] and S.rows(gate.failed, KEY, "outcome") == [("u", "late")]
    go = spark.createDataFrame([("t", True), ("u", False)], "industry_id string, can_apply boolean")
    out = P.publish(a, a.withColumn("node_id", F.lit("new")), go)
    assert S.rows(out.fillna("none"), KEY, "node_id") == [("none", "d"), ("t", "new"), ("t", "new"), ("u", "c")]
    for df in (kept, out):
        assert "SortMergeJoin" not in plan(df) and "Exchange hashpartitioning" not in plan(df)


def test_proposals_meet_attachments_once(spark):
    a = S.attachments(spark, [("sw_1", "a"), ("sw_2", "b"), ("sw_3", "c")])
    asked = [("t", "sw_1", "a", "checked", "0.5"), ("t", "sw_1", "a", "", None), ("t", "sw_2", "a", "new", "1"), ("t", None, "a", "x", "1")]
    proposed = spark.createDataFrame(asked, "industry_id string, company_id string, node_id string, reason string, confidence string")
    written = []
    repaired, guard = M.repair_attachments(a, proposed, lambda met: written.append(stored(met)) or written[0])
    assert len(written) == 1 and S.rows(repaired, "company_id", "reason", "confidence") == [("sw_1", "checked", 0.5), ("sw_1", "reason 0", 0.9)]
    assert S.rows(guard.fillna("none"), "item_id", "severity") == [("none", "error"), ("sw_2->a", "error")]
    plain = M.repair_attachments(a, proposed)
    assert [sorted(map(tuple, x.collect()), key=str) for x in plain] == [sorted(map(tuple, x.collect()), key=str) for x in (repaired, guard)]
    assert "Join" not in plan(repaired) and "Join" not in plan(guard)


def test_listed_counts_come_from_one_count_by_company(spark):
    people = S.companies(spark, [("sw_1", True, None), ("sw_2", False, True), ("sw_3", None, None)])
    a = S.attachments(spark, [("sw_1", "a"), ("sw_1", "b"), ("sw_2", "a"), ("sw_3", "a"), ("sw_4", "a"), (None, "a")])
    path = stored(a)
    stats = C.listed_filter_stats(path, C.payload_companies(path, people))
    row = stats.first().asDict()
    assert {k: row[k] for k in ("company_count_before", "company_count_after", "attachment_count_before", "attachment_count_after", "attachment_removed")} == {
        "company_count_before": 3, "company_count_after": 1, "attachment_count_before": 6, "attachment_count_after": 2, "attachment_removed": 4}
    optimized = stats._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("count(1) AS _n") >= 1 and "count(1) AS attachment_count_before" not in optimized


def test_a_query_reads_the_table_that_the_job_wrote():
    class Session:
        def once(self, name, build):
            return {"run_outcome": name}

    assert CC.attachment_run(Session())["run_outcome"] == "attachment_run"


def test_fate_of_old_nodes_is_found_before_rows_are_multiplied(spark, no_broadcast):
    n = S.nodes(spark, [("r", "root", 0, "root", None), ("a", "A", 1, "midstream", "r"), ("b", "B", 2, "midstream", "a")])
    old = [("x", "x1"), ("x", "x2"), ("b", "b"), ("b", "b1"), ("gone", "g1"), (None, "n1"), ("x", "x1")]
    members = spark.createDataFrame([("t", g, o) for g, o in old], "industry_id string, node_id string, old_id string")
    links = {"x": "b", "x1": "x", "x2": "x", "b1": "b", "b": "a", "g1": "gone"}
    paths = HI.ancestor_paths(spark.createDataFrame([("t", k, v) for k, v in links.items()], "industry_id string, id string, parent_id string"))
    a = S.attachments(spark, [("sw_1", "x"), ("sw_2", "b"), ("sw_3", "gone"), (None, "x"), ("sw_5", None), ("sw_6", "none")])
    before = C.old_attachments(a, members).withColumn("old_node_id", F.col("node_id"))
    columns = ["company_id", "old_node_id", "node_id", "outcome", "reason"]
    after = C.remap_to_survivors(a, n, paths, members.withColumn("old_node_id", F.col("old_id")))
    want = S.rows(C.remap_to_survivors(before, n, paths).select(*columns).fillna("none"), *columns)
    assert S.rows(after.select(*columns).fillna("none"), *columns) == want and len(want) == 9
    # the attachments meet one table, and nothing moves above that join
    tree = after._jdf.queryExecution().sparkPlan().toString().splitlines()
    first = next(i for i, line in enumerate(tree) if "Join" in line)
    assert "old_id" in "".join(tree[:first + 40]) and not any("Exchange" in line for line in tree[:first])
    outer = tree[first]
    assert "Inner" in outer and "node_id" in outer


def test_findings_of_the_company_rules_are_stored_compressed(spark):
    n = S.nodes(spark, [("r", "root", 0, "root", None), ("a", "A", 1, "midstream", "r"), ("b", "B", 2, "midstream", "a")])
    above = HI.closure(HI.ancestor_paths(HI.aggregation_parents(n, S.edges(spark, []))))
    tables = [stored(x) for x in (S.attachments(spark, [("sw_1", "a"), ("sw_1", "b"), ("sw_1", "b")]), S.companies(spark, [("sw_1", True, None)]), n, above)]
    a, people, nodes, higher = tables
    required = stored(a.select(KEY, "company_id", "node_id").limit(0))
    found = V.attachment_issues(a, stored(C.payload_companies(a, people)), people, nodes, higher, required)
    assert S.rows(found, "code", "item_id") == [("ancestor_descendant_attachment", "sw_1"), ("duplicate_attachment", "sw_1->b")]
    assert "ExistingRDD" not in plan(found)
