import hashlib

from pyspark.sql import functions as F

import samples as S
from linkstrata.operators import flow as FL
from linkstrata.operators import hierarchy as HI
from linkstrata.plans import overlays as O
from linkstrata.sources.responses import parse_company_matches, parse_verdicts

AS_OF = "2024-06-01"


def pid(a, b):
    a, b = sorted((a, b))
    return "p_" + hashlib.sha256(f"{a}\0{b}".encode()).hexdigest()[:16]


def graph(spark, extra=()):
    rows = [*S.FLOW_NODES, *extra]
    return S.nodes(spark, rows), S.edges(spark, [(p, i, "contains") for i, _, _, _, p, *_ in rows if p])


def test_shortlist_is_cross_branch(spark):
    n, e = graph(spark)
    short = O.shortlist_pairs(n, e, per_node=1, audit_rate=0.0)
    assert short.summary.collect()[0]["cross_branch_pair_count"] == 4
    got = {r["pair_id"]: r for r in short.pairs.collect()}
    assert pid("grain", "milling") in got
    assert all(r["node_a_branch"] != r["node_b_branch"] for r in got.values())


def test_direction_policy(spark):
    n, _ = graph(spark)
    lines = HI.lineage(n, HI.ancestor_paths(HI.tree_parents(n)))
    asked = spark.createDataFrame([("t", "grain", "milling"), ("t", "grain", "liquor"), ("t", "liquor", "milling"), ("t", "grain", "sugar"), ("t", "milling", "candy")], "industry_id string, source string, target string")
    got = {(s, t): ok for s, t, ok in S.rows(FL.direction_check(asked, n, lines), "source", "target", "allowed")}
    assert got == {("grain", "milling"): True, ("grain", "liquor"): False, ("liquor", "milling"): False, ("grain", "sugar"): False, ("milling", "candy"): True}


def test_descendant_text_is_evidence(spark):
    n, e = graph(spark, [("grain_detail", "cereal", 3, "upstream", "grain", "raw input for 粮食加工 and more")])
    short = O.shortlist_pairs(n, e, audit_rate=0.0)
    row = next(r for r in short.pairs.collect() if r["pair_id"] == pid("grain", "milling"))
    assert [x["matched_descendant_context"] for x in row["recall_evidence"]] == ["cereal：raw input for 粮食加工 and more"]


def test_blocks_do_not_change_the_scores(spark, monkeypatch):
    n, e = graph(spark)
    catalog = FL.l2_catalog(n, HI.ancestor_paths(HI.tree_parents(n)))
    whole = S.rows(FL.scored_pairs(catalog, e, 8, 0.5), "pair_id", "score", "near")
    monkeypatch.setattr(FL, "BLOCK_ROWS", 1)
    split = S.rows(FL.scored_pairs(catalog, e, 8, 0.5), "pair_id", "score", "near")
    assert whole == split and len(whole) == 4


def test_verdict_lines(spark):
    a, b = pid("grain", "liquor"), pid("sugar", "candy")
    texts = [("one", f"{a}:A_TO_B\n{b}:NO\nnote: skip this"), ("two", f"{a}:NO\n{a}:A_TO_B"), ("three", f"```\n {b.upper()} : b_to_a \r\n```")]
    raw = spark.createDataFrame(texts, "batch_id string, raw_response string")
    expected = spark.createDataFrame([(t, p) for t, _ in texts for p in (a, b)], "batch_id string, pair_id string")
    assert S.rows(parse_verdicts(raw, expected), "batch_id", "pair_id", "verdict") == sorted([("one", a, "A_TO_B"), ("one", b, "NO"), ("three", b, "B_TO_A")])


def test_company_matches(spark):
    raw = spark.createDataFrame([("t", 1, 'x {"results":[{"company_id":"sw_1","matched_nodes":[{"node_id":"a","confidence":0.5}]},{"company_id":"sw_1","matched_nodes":[{"node_id":"b"}]},{"company_id":"sw_9","matched_nodes":[]}]} y')], "industry_id string, batch_id int, raw_response string")
    asked = spark.createDataFrame([("t", 1, "sw_1"), ("t", 1, "sw_2")], "industry_id string, batch_id int, company_id string")
    got = sorted((r["company_id"], r["result_status"], r["node_id"]) for r in parse_company_matches(raw, asked).collect())
    assert got == [("sw_1", "returned", "b"), ("sw_2", "agent_omitted_filled_empty", None)]


def test_cache_key_follows_content(spark):
    n, e = graph(spark)
    pairs = O.shortlist_pairs(n, e, audit_rate=0.0).pairs
    before = dict(S.rows(FL.with_cache_key(pairs), "pair_id", "cache_key"))
    after = dict(S.rows(FL.with_cache_key(pairs.withColumn("node_a_hash", F.when(F.col("node_a_id") == "grain", "changed").otherwise(F.col("node_a_hash")))), "pair_id", "cache_key"))
    changed = {p for p in before if before[p] != after[p]}
    assert changed == {r["pair_id"] for r in pairs.collect() if r["node_a_id"] == "grain"}


def test_overlay_from_verdicts_and_cache_reuse(spark):
    n, e = graph(spark)
    short = O.shortlist_pairs(n, e, audit_rate=0.0)
    empty = spark.createDataFrame([], "pos bigint, cache_key string, pair_id string, verdict string, node_a_id string, node_b_id string, model string, temperature double, updated_at string")
    batch = short.pairs.select("pair_id", F.when(F.col("pair_id") == pid("grain", "milling"), "A_TO_B").otherwise("NO").alias("verdict"))
    decisions, pending = O.decide_pairs(short.pairs, empty, batch, batch.limit(0))
    assert pending.count() == 4
    normalized, l2, projected = O.build_overlay(short.pairs, decisions, n, AS_OF)
    assert S.rows(l2, "source", "target") == [("grain", "milling")]
    assert S.rows(projected, "source", "target") == [("grain", "l1_process"), ("l1_raw", "milling")]
    issues = O.overlay_issues(normalized, l2, projected, n, e, S.graphs(spark), AS_OF)
    assert [r for r in issues.collect() if r["severity"] == "error"] == []
    cache = FL.upsert_cache(empty, decisions, short.pairs, AS_OF).withColumn("pos", F.lit(0).cast("bigint"))
    _, still_pending = O.decide_pairs(short.pairs, cache, batch, batch.limit(0))
    assert still_pending.count() == 0


def test_projection_collapses_to_the_parents(spark):
    n, _ = graph(spark)
    l2 = spark.createDataFrame(
        [("t", f"{s}__upstream_downstream__milling", s, "milling", 1.0, [f"https://example.com/{s}"], [f"ev_{s}"], 0.8) for s in ("grain", "sugar")],
        "industry_id string, id string, source string, target string, relation_weight double, source_urls array<string>, evidence_ids array<string>, confidence double")
    got = {(r["source"], r["target"]): r for r in FL.project_flows(l2, n, AS_OF).collect()}
    assert set(got) == {("l1_raw", "milling"), ("grain", "l1_process"), ("sugar", "l1_process")}
    both = got[("l1_raw", "milling")]
    assert (both["projected_from_count"], both["relation_weight"], both["confidence"]) == (2, 1.0, 0.8)
    assert both["evidence_ids"] == ["ev_grain", "ev_sugar"]


def test_verdict_against_the_policy_becomes_no(spark):
    pairs = spark.createDataFrame([("t", "p", "grain", "milling", ["A_TO_B"], ["x"])], "industry_id string, pair_id string, node_a_id string, node_b_id string, allowed_verdicts array<string>, selection_reasons array<string>")
    given = spark.createDataFrame([("t", "p", "b_to_a", "model_batch", "k")], "industry_id string, pair_id string, verdict string, decision_source string, cache_key string")
    assert S.rows(FL.normalized_decisions(given, pairs), "verdict", "rule_rejection") == [("NO", "l1_branch_role_policy")]
