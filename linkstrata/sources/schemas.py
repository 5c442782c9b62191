"""Explicit schemas of the documents and files that are read."""

from pyspark.sql import types as T

_strings = T.ArrayType(T.StringType())

NODE = T.StructType([
    T.StructField(n, t) for n, t in (
        ("id", T.StringType()), ("name", T.StringType()), ("node_type", T.StringType()), ("tags", _strings), ("industry", T.StringType()),
        ("level", T.IntegerType()), ("chain_position", T.StringType()), ("parent_id", T.StringType()), ("description", T.StringType()),
        ("business_description", T.StringType()), ("is_key_node", T.BooleanType()), ("chain_segment", T.StringType()),
        ("source_urls", _strings), ("evidence_ids", _strings), ("confidence", T.DoubleType()), ("updated_at", T.StringType()),
        ("deprecated", T.BooleanType()), ("company_list", T.StringType()), ("公司列表", T.StringType()),
    )
])
EDGE = T.StructType([
    T.StructField(n, t) for n, t in (
        ("id", T.StringType()), ("source", T.StringType()), ("target", T.StringType()), ("relation_type", T.StringType()),
        ("relation_weight", T.DoubleType()), ("description", T.StringType()), ("source_urls", _strings), ("evidence_ids", _strings),
        ("confidence", T.DoubleType()), ("updated_at", T.StringType()), ("deprecated", T.BooleanType()),
    )
])
SOURCE_BASIS = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "url", "note")])
GRAPH = T.StructType([
    T.StructField("industry", T.StringType()), T.StructField("version", T.StringType()), T.StructField("schema_version", T.StringType()),
    T.StructField("generated_at", T.StringType()), T.StructField("scope", T.StringType()),
    T.StructField("source_basis", T.ArrayType(SOURCE_BASIS)), T.StructField("nodes", T.ArrayType(NODE)), T.StructField("edges", T.ArrayType(EDGE)),
])
MANIFEST = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("sector", T.StringType()),
    T.StructField("source_order", T.IntegerType()), T.StructField("data_path", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("node_count", T.LongType()), T.StructField("edge_count", T.LongType()),
])
EVIDENCE = T.StructType([
    T.StructField(n, T.StringType()) for n in (
        "evidence_id", "url", "title", "published_at", "retrieved_at", "content_type", "content_hash", "snippet", "status",
    )
])
MATCH_RESPONSE = T.StructType([
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("company_id", T.StringType()),
        T.StructField("matched_nodes", T.ArrayType(T.StructType([
            T.StructField("node_id", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("confidence", T.StringType()),
            T.StructField("match_method", T.StringType()),
        ]))),
    ]))),
])
