"""Readers and writers of graph documents, manifests, JSON lines and CSV tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstrata import constants as K
from linkstrata.functions import text as X
from linkstrata.functions.tables import checkpointed, empty_like, path_exists
from linkstrata.operators.companies import company_master, taxonomy_paths
from linkstrata.sources import schemas as S
from linkstrata.sources.delimited import read_delimited

KEY = "industry_id"


# --- graph documents -------------------------------------------------------------------
def read_graphs(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graph documents ``<industry_id>/<file>.json``: (graphs, nodes, edges), order kept in ``pos``."""
    docs = spark.read.schema(S.GRAPH).option("multiLine", True).json(pattern).withColumn(
        KEY, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    )
    graphs = docs.select(KEY, "industry", "version", "schema_version", "generated_at", "scope", F.coalesce("source_basis", F.array().cast(S.GRAPH["source_basis"].dataType)).alias("source_basis"))
    nodes = docs.select(KEY, F.posexplode("nodes").alias("pos", "n")).select(
        KEY, F.col("pos").cast("bigint").alias("pos"), *[F.col("n")[f.name].alias(f.name) for f in S.NODE if f.name not in ("company_list", "公司列表")],
        (F.col("n")["company_list"].isNotNull() | F.col("n")["公司列表"].isNotNull()).alias("has_company_field"),
    )
    edges = docs.select(KEY, F.posexplode("edges").alias("pos", "e")).select(
        KEY, F.col("pos").cast("bigint").alias("pos"), *[F.col("e")[f.name].alias(f.name) for f in S.EDGE]
    )
    return graphs, nodes, edges


def write_graph_parts(df: DataFrame, path: str) -> None:
    """One section of the graphs (nodes, edges or headers) as JSON lines, a folder per industry.

    Rows instead of one nested document: a graph of any size is written by many tasks.
    """
    df.write.mode("overwrite").partitionBy(KEY).json(path)


def read_graph_parts(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_store(df: DataFrame, path: str) -> None:
    """Own tables: Parquet, partitioned by industry so that single-graph queries prune folders."""
    df.write.mode("overwrite").partitionBy(KEY).parquet(path)


# --- manifest ---------------------------------------------------------------------------
def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON array of entries, or JSON lines; ``id`` becomes the industry id."""
    raw = spark.read.schema(S.MANIFEST).option("multiLine", not lines).json(path)
    return raw.withColumnRenamed("id", KEY)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.withColumnRenamed(KEY, "id").write.mode("overwrite").json(path)


# --- JSON lines ---------------------------------------------------------------------------
def read_json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """Blank lines are skipped; a missing file is an empty table."""
    if not path_exists(spark, path):
        return empty_like(spark, schema)
    lines = spark.read.text(path).filter(X.strip("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


# --- CSV -------------------------------------------------------------------------------------
def read_company_rows(spark: SparkSession, path: str) -> DataFrame:
    """Raw candidate rows with ``pos``, from CSV files in UTF-8, GB18030 or GBK (see :func:`read_delimited`)."""
    return read_delimited(spark, path)


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    return company_master(read_company_rows(spark, path))


def check_taxonomy_columns(columns: Sequence[str]) -> None:
    missing = [c for c in K.TAXONOMY_COLUMNS if c not in columns]
    if missing:
        raise ValueError("taxonomy CSV lacks columns: " + ", ".join(missing))


def read_taxonomy_rows(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    df = spark.read.option("header", True).option("encoding", encoding).option("escape", '"').csv(path)
    check_taxonomy_columns(df.columns)
    return df


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets of rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def write_csv_if_changed(df: DataFrame, path: str) -> bool:
    """Rewrite a CSV table only when its rows differ; True when written."""
    if path_exists(df.sparkSession, path):
        old = df.sparkSession.read.option("header", True).option("escape", '"').schema(df.schema).csv(path)
        blank_as_null = lambda x: x.select(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
        if same_rows(blank_as_null(old), blank_as_null(df)):
            return False
        df = checkpointed(df)  # the old files may feed the new rows
    df.write.mode("overwrite").option("header", True).csv(path)
    return True


def refresh_taxonomy_table(rows: DataFrame, path: str) -> DataFrame:
    check_taxonomy_columns(rows.columns)
    table = taxonomy_paths(rows)
    write_csv_if_changed(table, path)
    return table


def write_delivery(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str] = ()) -> None:
    """Delivery CSV, a folder per industry and ``file_prefix``, UTF-8 with byte-order mark, given header order.

    The mark is written as part of each file's header line. With ``order`` the rows of an industry are in order over its part files.
    """
    out = df.select(KEY, "file_prefix", *columns)
    if order:
        out = out.repartitionByRange(KEY, *order).sortWithinPartitions(KEY, *order)
    marked = out.withColumnRenamed(columns[0], K.BYTE_ORDER_MARK + columns[0])
    marked.write.mode("overwrite").partitionBy(KEY, "file_prefix").option("header", True).csv(path)


def read_delivery(spark: SparkSession, path: str) -> DataFrame:
    """Delivery CSV as written by ``write_delivery``."""
    df = spark.read.option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "\0").csv(path)
    return df.select(*[F.col(f"`{c}`").alias(c.lstrip(K.BYTE_ORDER_MARK)) for c in df.columns])


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines as text, a folder per industry, in line order."""
    ordered = lines.repartitionByRange(KEY, "line_no").sortWithinPartitions(KEY, "line_no")
    ordered.select(KEY, F.col("line").alias("value")).write.mode("overwrite").partitionBy(KEY).text(path)
