"""Registered queries over a small data folder of their own."""

import pytest

import samples as S
import __spark_entry__ as contract
from linkstrata.catalog import company, flow
from linkstrata.sources.derived import graph_tables

TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    tables = {
        "part": ([(i, f"name {i % 7}", f"Brand#{i % 5 + 1}", TYPES[i % 6], i % 50 + 1) for i in range(240)], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int"),
        "supplier": ([(i, f"Supplier {i}", i * 700.0) for i in range(12)], "s_suppkey bigint, s_name string, s_acctbal double"),
        "lineitem": ([(i, i * 7 % 240, i % 12, 1, i % 10 / 100) for i in range(600)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_discount double"),
        "events": ([(i, ("view", "purchase", "click", "signup", "error")[i % 5], float(i % 40)) for i in range(1200)], "event_id bigint, event_type string, value double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(root / f"{name}.parquet"))
    return str(root)


def run(spark, folder, name):
    return contract.queries()[name](spark, folder)


def test_failed_branches_of_every_industry(spark, folder):
    found = S.rows(run(spark, folder, "f11_failed_branches").filter("action = 'unknown_branch'"), "industry_id", "branch_id")
    assert found == [(t.lower(), f"{t.lower()}_099") for t in TYPES]


def test_stored_intermediates_of_different_queries_have_names_of_their_own(spark, folder):
    g = graph_tables(spark, folder)
    assert company.attachment_pairs(g).columns == ["industry_id", "company_id", "node_id"]
    assert "pair_id" in flow.pairs(g).columns
    for name in ("w04_audit_sample", "j08_candidate_pairs", "a07_candidate_summary", "p23_cache_key"):
        assert "industry_id" in run(spark, folder, name).columns


def test_stored_tables_have_their_true_size(spark):
    from linkstrata.functions.tables import estimated_bytes, stored

    rows = spark.range(1000).selectExpr("'t' AS industry_id", "id % 3 AS n", "array(cast(id AS string)) AS ids")
    kept = stored(rows.join(rows.select("industry_id").distinct(), "industry_id"))
    assert kept.dtypes == rows.dtypes and S.rows(kept, "n", "ids") == S.rows(rows, "n", "ids")
    assert estimated_bytes(kept) < 100_000
