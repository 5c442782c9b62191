import csv
import io
import json
import random

import pytest

import samples as S
from pyspark.sql import functions as F

from linkstrata.operators import export as E
from linkstrata.operators import publish as P
from linkstrata.plans.delivery import HEADERS, delivery_tables, write_bundle
from linkstrata.operators import hierarchy as HI
from linkstrata.sources import files as FI
from linkstrata.sources import schemas as SC
from linkstrata.sources.delimited import file_fingerprints, read_delimited, write_delimited


def test_graph_documents(spark, tmp_path):
    folder = tmp_path / "food"
    folder.mkdir()
    doc = {"industry": "食品", "source_basis": [{"name": "n", "url": "u", "note": "x"}], "nodes": [{"id": "a", "name": "A", "level": 0, "tags": ["x"]}, {"id": "b", "name": "B", "level": 1, "company_list": "c"}],
           "edges": [{"source": "a", "target": "b", "relation_type": "contains", "confidence": 0.5}]}
    (folder / "graph.json").write_text(json.dumps(doc, ensure_ascii=False, indent=2), encoding="utf-8")
    graphs, nodes, edges = FI.read_graphs(spark, str(tmp_path / "*" / "graph.json"))
    assert S.rows(graphs, "industry_id", "industry") == [("food", "食品")]
    assert S.rows(nodes, "pos", "id", "has_company_field") == [(0, "a", False), (1, "b", True)]
    assert S.rows(edges, "source", "target", "confidence") == [("a", "b", 0.5)]


def test_manifest_array(spark, tmp_path):
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps([{"id": "a", "name": "A", "status": "pending"}, {"id": "b", "name": "B", "node_count": 3}], indent=1))
    assert S.rows(FI.read_manifest(spark, str(path)), "industry_id", "name") == [("a", "A"), ("b", "B")]


def test_json_lines_skip_blanks_and_missing_files(spark, tmp_path):
    path = tmp_path / "sources.jsonl"
    path.write_text('{"evidence_id": "e1", "url": "u"}\n\n   \n{"evidence_id": "e2"}\n')
    assert S.rows(FI.read_json_lines(spark, str(path), SC.EVIDENCE), "evidence_id") == [("e1",), ("e2",)]
    assert FI.read_json_lines(spark, str(tmp_path / "none.jsonl"), SC.EVIDENCE).isEmpty()


def test_company_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("COMCODE,公司名称,islisted,indunamesw\n 1 ,甲,1,白酒\n2,,1,x\n1,乙,0,x\n3,丙, ,\n", encoding="utf-8-sig")
    got = {r["company_id"]: r for r in FI.read_companies(spark, str(path)).collect()}
    assert set(got) == {"sw_1", "sw_3"}
    assert (got["sw_1"]["name"], got["sw_1"]["is_listed"], got["sw_3"]["is_listed"], got["sw_3"]["indunamesw"]) == ("甲", True, None, "")


def test_taxonomy_header_is_checked(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("indunamesw,indunamesw1\nx,y\n")
    with pytest.raises(ValueError, match="indunamesw2"):
        FI.read_taxonomy_rows(spark, str(path))


def test_csv_is_rewritten_only_when_it_changes(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.createDataFrame([("a", 1), ("", 2)], "k string, n int")
    assert FI.write_csv_if_changed(df, path) and not FI.write_csv_if_changed(df, path)
    assert FI.write_csv_if_changed(df.unionByName(spark.createDataFrame([("b", 3)], "k string, n int")), path)


def test_delivery_bundle(spark, tmp_path):
    n = S.nodes(spark, [("t_000", "r", 0, "root", ""), ("t_001", "a", 1, "midstream", "t_000"), ("t_001_001", "b", 2, "midstream", "t_001")])
    e = S.edges(spark, [("t_000", "t_001", "contains"), ("t_001", "t_001_001", "contains"), ("t_001", "gone", "contains")])
    people = S.companies(spark, [("sw_1", True, None), ("sw_2", None, None)])
    a = S.attachments(spark, [("sw_1", "t_001_001"), ("sw_2", "t_001")])
    meta = spark.createDataFrame([("t", "T", "测试", "01")], "industry_id string, code string, delivery_name string, ind_id string")
    ready = spark.createDataFrame([("t", "ready")], "industry_id string, overlay_status string")
    none = spark.createDataFrame([], S.EDGE_SCHEMA)
    paths = HI.ancestor_paths(HI.aggregation_parents(n, e))
    payloads = spark.createDataFrame([("t", "2024-05-20T09:00:00+00:00")], "industry_id string, generated_at string")
    tables = delivery_tables(S.graphs(spark), n, e, none, none, a, people, paths, meta, ready, ready, payloads, "2024-06-01")
    out = write_bundle(tables, str(tmp_path / "out"))
    read = {k: FI.read_delivery(spark, p) for k, p in out.items()}
    assert {k: v.count() for k, v in read.items()} == {
        "industry_node": 1, "industrynode_node": 3, "industrynode_edge": 2, "industrynode_industry_edge": 3, "company_node": 1,
        "company_industrynode_edge_node": 3, "company_industrynode_edge_node_不聚合": 1}
    for name, df in read.items():
        assert [c for c in df.columns if c not in ("industry_id", "file_prefix")] == list(HEADERS[name])
        assert {r[0] for r in df.select("file_prefix").collect()} == {"测试"}
    assert S.rows(read["company_node"], "生效时间") == [("2024-05-20",)] and S.rows(read["industrynode_node"].limit(1), "生效时间") == [("2024-05-01",)]
    files = list((tmp_path / "out" / "industry_node").rglob("*.csv"))
    assert files and all(f.read_bytes().startswith(b"\xef\xbb\xbf") for f in files)
    assert S.rows(read["industrynode_edge"], "起点节点id", "终点节点id") == [("T000001", "T000000"), ("T001001", "T000001")]


def test_delivery_needs_a_mapping_and_distinct_ids(spark):
    n = S.nodes(spark, [("t_000", "r", 0, "root", ""), ("t_001", "a", 1, "midstream", "t_000"), ("t_1", "b", 1, "midstream", "t_000")])
    meta = spark.createDataFrame([("t", "T", "测试", "01")], "industry_id string, code string, delivery_name string, ind_id string")
    other = meta.withColumn("industry_id", F.lit("other"))
    assert E.node_rows(n, S.graphs(spark), meta, "2024-06-01").count() == 3
    for rows in (E.node_rows(n, S.graphs(spark), other, "2024-06-01"), E.industry_rows(other, S.graphs(spark)), E.node_industry_rows(n, S.graphs(spark), other, "2024-06-01")):
        with pytest.raises(Exception, match="no delivery mapping for industry t"):
            rows.collect()
    assert S.rows(E.delivery_id_collisions(E.node_rows(n, S.graphs(spark), meta, "2024-06-01")), "delivery_id") == [("T000001",)]


def test_overlay_status_and_fingerprint(spark):
    n, e, g = S.nodes(spark, S.FLOW_NODES), S.edges(spark, S.FLOW_EDGES), S.graphs(spark)
    first = P.graph_fingerprint(g, n, e).collect()[0]["graph_fingerprint"]
    assert first == P.graph_fingerprint(g, n.repartition(3), e).collect()[0]["graph_fingerprint"]
    assert first != P.graph_fingerprint(g, n.filter("id <> 'candy'"), e).collect()[0]["graph_fingerprint"]
    current = spark.createDataFrame([("t", first, "s")], "industry_id string, graph_fingerprint string, source_hash string")

    def status(schema, fp, source, shape=True):
        meta = spark.createDataFrame([("t", "t", schema, shape, fp, source)], "industry_id string, payload_industry_id string, schema_version string, shape_ok boolean, graph_fingerprint string, source_hash string")
        return P.overlay_status(g, meta, current).collect()[0]["overlay_status"]

    ok = "industry_company_attachments_v0.2"
    assert [status(ok, first, "s"), status(ok, "x", "s"), status(ok, first, "y"), status("v0", first, "s"), status(ok, first, "s", False)] == ["ready", "stale", "stale", "invalid", "invalid"]
    none = spark.createDataFrame([], "industry_id string, payload_industry_id string, schema_version string, shape_ok boolean, graph_fingerprint string, source_hash string")
    assert P.overlay_status(g, none, current).collect()[0]["overlay_status"] == "missing"


def test_upsert_keeps_old_values_where_new_are_null(spark):
    old = spark.createDataFrame([("t", "a", "A", 1), ("t", "b", "B", 2)], "industry_id string, id string, name string, level int")
    new = spark.createDataFrame([("t", "a", "A2", None), ("t", "c", "C", 3)], "industry_id string, id string, name string, level int")
    assert S.rows(P.upsert(old, new, ["industry_id", "id"]), "id", "name", "level") == [("a", "A2", 1), ("b", "B", 2), ("c", "C", 3)]


CSV_FILES = {
    "a_sig.csv": ("utf-8-sig", "comcode,chiname,islisted\n1,\"甲 \"\"一\"\"\n公司\",1\n\n2,乙,\n"), "b_plain.csv": ("utf-8", "chiname,comcode\r\n丙,3\r\n\"丁\r\n,\",4\r\n"),
    "c_gb.csv": ("gb18030", "comcode,chiname,islisted\n5,戊㐀,0\n1,again,1\n6,\"己\n\n\n\",y"), "d_gbk.csv": ("gbk", "comcode,chiname,indunamesw\n7,庚\n8,\"辛\",白酒,more\n"), "e_empty.csv": ("utf-8", ""), "f_head.csv": ("utf-8", "comcode,chiname\n"),
}


def test_csv_of_all_charsets_at_once(spark, tmp_path):
    import csv as plain_csv

    for name, (charset, text) in CSV_FILES.items():
        (tmp_path / name).write_bytes(text.encode(charset))
    got = read_delimited(spark, str(tmp_path)).orderBy("pos").collect()
    want = []
    for name in sorted(CSV_FILES):
        want += [r for r in plain_csv.DictReader(io.StringIO(CSV_FILES[name][1], newline=""))]
    assert [(r["comcode"], r["chiname"], r["islisted"] or "", r["indunamesw"] or "") for r in got] == [(w["comcode"], w["chiname"], w.get("islisted") or "", w.get("indunamesw") or "") for w in want]
    assert {r["comcode"]: r["name"] for r in FI.read_companies(spark, str(tmp_path)).collect()}["1"] == '甲 "一"\n公司'
    (tmp_path / "g_torn.csv").write_bytes(b"comcode,chiname\n1,\xff\xff\n")
    with pytest.raises(Exception, match="neither UTF-8 nor GB18030"):
        read_delimited(spark, str(tmp_path)).collect()


def test_records_over_many_splits(spark, tmp_path):
    rng = random.Random(5)
    rows = [[str(i), "".join(rng.choice(["a", "\n", '"', ",", "\r\n", "公"]) for _ in range(rng.randint(0, 12)))] for i in range(3000)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["comcode", "chiname"], *rows])
    (tmp_path / "big.csv").write_bytes(out.getvalue().encode("gb18030"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = read_delimited(spark, str(tmp_path)).orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [[r["comcode"], r["chiname"] or ""] for r in got] == rows
    df = spark.createDataFrame([tuple(r) for r in rows], "comcode string, chiname string").repartition(3)
    write_delimited(df, str(tmp_path / "written"), "utf-8-sig")
    back = read_delimited(spark, str(tmp_path / "written"))
    assert sorted((r["comcode"], r["chiname"] or "") for r in back.collect()) == sorted(map(tuple, rows))


def test_file_fingerprints(spark, tmp_path):
    texts = {"a": b"x\ny\nz\xff", "same": b"x\ny\nz\xff", "order": b"y\nx\nz\xff", "end": b"x\ny\nz\xff\n", "carriage": b"x\r\ny\nz\xff", "twice": b"x\ny\ny\nz\xff"}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "long").write_bytes(b"line\n" * 5000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        cut = {r["file"].rsplit("/", 1)[1]: r["fingerprint"] for r in file_fingerprints(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {r["file"].rsplit("/", 1)[1]: r["fingerprint"] for r in file_fingerprints(spark, str(tmp_path)).collect()}
    assert got == cut and got["a"] == got["same"] and len(set(got.values())) == len(texts)
