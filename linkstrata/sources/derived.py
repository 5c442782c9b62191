"""Builds the derived graph tables once per session and keeps them as Parquet in the shared folder.

They play the part of an engine's stored graphs: queries read them with pushdown, pruning and
real size estimates instead of deriving them again. Files survive the loss of executors.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstrata.functions.tables import gathered, join_path, lookup, work_dir
from linkstrata.operators.hierarchy import aggregation_parents, ancestor_paths, lineage, tree_parents
from linkstrata.sources.derived_sql import BASE_TABLES, DEFINITIONS, LISTS

_REF = re.compile(r"\{(\w+)\}")
_OPEN: dict[tuple[str, str], "GraphTables"] = {}


def _to_list(column: str):
    return F.when(F.coalesce(F.col(column), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(column, ";")).alias(column)


class GraphTables:
    """Named tables of one data folder; ``tables("nodes")`` builds, stores and returns a table."""

    def __init__(self, spark: SparkSession, data_dir: str):
        self.spark = spark
        self.data_dir = data_dir
        self.root = join_path(work_dir(spark), f"tables-{uuid.uuid4().hex}")
        self._known: dict[str, DataFrame] = {}
        self._jobs: dict[str, object] = {}
        self._computed = {
            "agg_paths": lambda: ancestor_paths(aggregation_parents(self("nodes"), self("edges"))),
            "tree_paths": lambda: ancestor_paths(tree_parents(self("nodes"))),
            "supply": self._supply,
            "lines": lambda: lineage(self("nodes"), self("tree_paths")),
        }

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(join_path(self.data_dir, f"{name}.parquet"))

    def __call__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.source(name)
        if name not in self._known:
            self._known[name] = self.store(name, self._build(name))
        return self._known[name]

    def store(self, name: str, df: DataFrame) -> DataFrame:
        """Write a table to the shared folder and read it back."""
        path = join_path(self.root, name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remember(self, name: str, build) -> DataFrame:
        """A stored intermediate result that several queries of a session share."""
        if name not in self._known:
            self._known[name] = self.store(name, build())
        return self._known[name]

    def once(self, name: str, build):
        """The unwritten results of a job that several queries of a session share."""
        if name not in self._jobs:
            self._jobs[name] = build()
        return self._jobs[name]

    def fresh_path(self, name: str) -> str:
        return join_path(self.root, f"{name}-{uuid.uuid4().hex}")

    def _supply(self) -> DataFrame:
        """The rows of the SQL of ``supply``; line items are joined and grouped by numbers, and leaves get their names afterwards."""
        leaf = ["industry_id", "id", "parent_id"]
        nodes = self("node_base").filter("level = 3").select(*leaf, "partkey")
        keyed = gathered(self("parts"), "p_partkey").join(self("leaf_keys").select("industry_id", "k1", "p_brand", "p_name", "partkey"), ["industry_id", "k1", "p_brand", "p_name"])
        places = self.remember("supply_places", lambda: keyed.join(nodes, ["industry_id", "partkey"]).select(F.col("p_partkey").alias("l_partkey"), *leaf).distinct())
        leaves = self.remember("supply_leaves", lambda: places.select(*leaf).distinct().withColumn("leaf_no", F.monotonically_increasing_id()))
        lines = self("lineitem").join(places.join(leaves, leaf).select("l_partkey", "leaf_no"), "l_partkey").selectExpr(
            "leaf_no", "l_suppkey", "l_orderkey * 10 + l_linenumber AS pos", "l_orderkey AS o", "l_discount"
        )
        pairs = gathered(lines, "leaf_no", "l_suppkey").groupBy("leaf_no", "l_suppkey").agg(
            F.min("pos").alias("pos"), F.min("o").alias("o"), F.expr("round(1 - max(l_discount), 4)").alias("confidence")
        )
        return lookup(pairs, leaves, ["leaf_no"], "inner").selectExpr(
            "industry_id", "'sw_' || cast(l_suppkey AS string) AS company_id", "id AS leaf_id", "parent_id AS branch_id", "pos", "o", "confidence"
        )

    def _build(self, name: str) -> DataFrame:
        if name in self._computed:
            return self._computed[name]()
        sql = DEFINITIONS[name]
        inputs = {ref: self(ref) for ref in set(_REF.findall(sql))}
        df = self.spark.sql(sql, **inputs)
        if name == "graphs":
            entries = F.transform(F.split("source_basis", ";"), lambda e: F.struct(
                F.split(e, "[|]")[0].alias("name"), F.split(e, "[|]")[1].alias("url"), F.split(e, "[|]")[2].alias("note")
            ))
            return df.withColumn("source_basis", entries)
        if name == "scope_rules":
            return df.withColumnRenamed("column_name", "column")
        lists = LISTS.get(name, ())
        text = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
        return df.select(*[_to_list(c) if c in lists and c in text else F.col(c) for c in df.columns])


def graph_tables(spark: SparkSession, data_dir: str) -> GraphTables:
    key = (spark.sparkContext.applicationId, data_dir)
    if key not in _OPEN:
        _OPEN[key] = GraphTables(spark, data_dir)
    return _OPEN[key]


def duckdb_tables(*names: str) -> list[tuple[str, str]]:
    """(name, SQL) of the definitions needed for ``names``, dependencies first, in DuckDB's dialect.

    List columns stay ``;``-joined text there.
    """
    done: dict[str, str] = {}

    def visit(name: str) -> None:
        if name in done or name in BASE_TABLES:
            return
        sql = DEFINITIONS[name]
        for ref in _REF.findall(sql):
            visit(ref)
        text = _REF.sub(r"\1", sql)
        done[name] = re.sub(r"sha2\(((?:[^()]|\([^()]*\))*), 256\)", r"sha256(\1)", text).strip()

    for n in names:
        visit(n)
    return list(done.items())
