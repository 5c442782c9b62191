"""Ordered repairs and running aggregates against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from linkstrata.functions.tables import running
from linkstrata.operators.merge import apply_repairs

NODES = "industry_id string, pos bigint, id string, name string, level int, parent_id string, source_urls array<string>, confidence double, has_company_field boolean"
EDGES = "industry_id string, pos bigint, id string, source string, target string, relation_type string, relation_weight double, source_urls array<string>, confidence double"
REPAIRS = "industry_id string, pos bigint, action string, target_id string, changes map<string,string>, remove_fields array<string>, type string"


def in_order(nodes, edges, repairs):
    """The rules one by one."""
    nodes, edges, guard = [dict(n) for n in nodes], [dict(e) for e in edges], []
    for r in sorted(repairs, key=lambda r: (r["industry_id"], r["pos"], r["action"] or "", r["target_id"])):
        action, target, changes = (r["action"] or r["type"] or "").strip(), (r["target_id"] or "").strip(), r["changes"] or {}

        def say(severity, reason):
            guard.append((r["industry_id"], severity, target, reason))

        def put(row, fields):
            for k, v in changes.items():
                if k in fields:
                    row[k] = v.split(";") if k == "source_urls" else float(v) if k in ("confidence", "relation_weight") else v

        if action == "update_node":
            found = [n for n in nodes if n["industry_id"] == r["industry_id"] and (n["id"] or "") == target]
            if len(found) != 1:
                say("error", "node_target_not_unique")
                continue
            put(found[0], ("parent_id", "confidence", "source_urls"))
            if any(f == "company_list" for f in r["remove_fields"] or []):
                found[0]["has_company_field"] = False
            continue
        found = [e for e in edges if e["industry_id"] == r["industry_id"] and target in (e["id"] or "", f"{e['source']}->{e['target']}")]
        if action == "update_edge":
            if len(found) != 1:
                say("error", "edge_target_not_unique")
            else:
                put(found[0], ("source", "target", "relation_type", "relation_weight", "confidence", "source_urls"))
        elif action == "delete_edge":
            if not found:
                say("warning", "edge_to_delete_not_found")
            edges = [e for e in edges if not any(e is f for f in found)]
        else:
            say("error", "action_not_allowed")
    return nodes, edges, guard


def run(spark, nodes, edges, repairs):
    got = apply_repairs(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES).repartition(3), spark.createDataFrame(repairs, REPAIRS).repartition(3))
    want = in_order(nodes, edges, repairs)
    for df, rows in zip(got[:2], want[:2]):
        assert sorted(repr([r[c] for c in df.columns]) for r in df.collect()) == sorted(repr([r[c] for c in df.columns]) for r in rows)
    assert sorted(map(tuple, got[2].collect())) == sorted(want[2])
    return want


def edge(i, pos, id_, s, t):
    return {"industry_id": i, "pos": pos, "id": id_, "source": s, "target": t, "relation_type": "contains", "relation_weight": 1.0, "source_urls": ["u"], "confidence": 0.5}


def fix(i, pos, action, name, /, **changes):
    return {"industry_id": i, "pos": pos, "action": action, "target_id": name, "changes": changes, "remove_fields": None, "type": None}


def node(i, id_):
    return {"industry_id": i, "pos": 0, "id": id_, "name": id_, "level": 1, "parent_id": "", "source_urls": [], "confidence": 0.5, "has_company_field": True}


def test_chains(spark):
    edges = [edge("i", k, f"e{k}", s, t) for k, (s, t) in enumerate(["ab", "bc", "ab", "cd", "de"])] + [edge("i", 9, None, "x", "y"), edge("j", 0, "e0", "a", "b")]
    repairs = [
        fix("i", 1, "update_edge", "a->b", confidence="0.9"), fix("i", 2, "delete_edge", "e2"), fix("i", 3, "update_edge", "a->b", target="z"),
        fix("i", 4, "update_edge", "a->b", confidence="0.8"), fix("i", 5, "update_edge", " a->z ", source="c", target="d"), fix("i", 6, "update_edge", "c->d", confidence="0.7"),
        fix("i", 7, "update_edge", "e3", source="q"), fix("i", 8, "update_edge", "c->d", relation_weight="3", source_urls="p;q"), fix("i", 9, "delete_edge", "c->d"),
        fix("i", 10, "delete_edge", "c->d"), fix("i", 11, "update_edge", "e0", confidence="0.1"), fix("i", 12, "update_edge", "", confidence="0.2"), fix("i", 13, "delete_edge", "q->d"),
        fix("j", 1, "update_edge", "a->b", confidence="0.9"), fix("j", 2, "drop", "a->b"), {**fix("j", 3, None, "n1", parent_id="p"), "type": "update_node", "remove_fields": ["company_list"]},
        fix("j", 4, "update_node", "n2", parent_id="p"), fix("j", 5, "update_node", "n1", parent_id="r", name="no", confidence="0.25"),
    ]
    _, left, guard = run(spark, [node("j", "n1"), node("j", "n2"), node("j", "n2"), node("i", "n1")], edges, repairs)
    assert len(left) == 4 and len(guard) == 7


@pytest.mark.parametrize("seed", (0, 3))
def test_random_repairs(spark, seed):
    rng = random.Random(seed)
    names = "abc" if seed < 3 else "ab"
    ends = lambda: (rng.choice(names), rng.choice(names))
    edges = [edge(rng.choice("ij"), k, rng.choice([f"e{k}", f"e{rng.randint(0, 8)}", "a->b", None]), *ends()) for k in range(14)]
    repairs = []
    for pos in range(60):
        target = rng.choice(["->".join(ends()), "->".join(ends()), f"e{rng.randint(0, 14)}"])
        changes = {k: v for k, v in (("source", rng.choice(names)), ("target", rng.choice(names)), ("confidence", str(rng.random()))) if rng.random() < 0.4}
        repairs.append(fix(rng.choice("ij"), pos, "delete_edge" if rng.random() < 0.1 else "update_edge", target, **changes))
    run(spark, [node("i", "n")], edges, repairs)


def test_running(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("ab"), k, rng.randint(-5, 5) if rng.random() < 0.8 else None) for k in range(200)]
    got = running(spark.createDataFrame(rows, "g string, k int, v int").repartition(5), ["g"], ["k"], total=("sum", F.col("v")), low=("min", F.col("v")), last=("max", F.when(F.col("v").isNotNull(), F.struct("k", "v"))))
    for r in got.collect():
        before = [(k, v) for g, k, v in rows if g == r["g"] and k < r["k"] and v is not None]
        want = (sum(v for _, v in before), min(v for _, v in before), max(before)) if before else (None, None, None)
        assert (r["total"], r["low"], r["last"] and tuple(r["last"])) == want
    assert got.count() == 200
