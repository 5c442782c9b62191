"""CSV files of unknown charset, with quoted line breaks, many at once and of any size.

Line ends, quotes and commas are single bytes in UTF-8, GB18030 and GBK alike, never part of a longer character. So files are read as physical lines of bytes,
in splits; the charset is found per file from all its lines; and whether a line goes on a quoted field is the parity of the quotes before it.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkstrata import constants as K
from linkstrata.functions.tables import checkpointed, lookup, running
from linkstrata.operators.publish import digest


@F.pandas_udf(T.StringType())
def _chinese(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def read(line: bytes) -> str | None:
        for charset in ("gb18030", "gbk"):
            try:
                return line.decode(charset)
            except UnicodeDecodeError:
                pass
        return None

    for batch in batches:
        yield batch.map(read)


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``place`` (orders the lines of a file) and decoded ``text``. A file is UTF-8, with or without byte-order mark, if all its lines are; else GB18030 or GBK.

    A line that no charset fits is an error.
    """
    raw = checkpointed(spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("place"),
        F.col("value").cast("binary").alias("bytes"), F.is_valid_utf8("value").alias("valid"),
    ))
    charset = raw.groupBy("file").agg(F.min("valid").alias("utf8"), F.min("place").alias("first"))
    placed = lookup(raw.drop("valid"), charset, ["file"])
    utf8 = placed.filter("utf8").withColumn("text", F.col("bytes").cast("string")).withColumn(
        "text", F.when(F.col("place") == F.col("first"), F.ltrim(F.col("text"), F.lit(K.BYTE_ORDER_MARK))).otherwise(F.col("text")))
    other = placed.filter("NOT utf8").withColumn("text", _chinese("bytes")).withColumn(
        "text", F.coalesce("text", F.raise_error(F.concat(F.lit("neither UTF-8 nor GB18030 nor GBK: "), "file")).cast("string")))
    return utf8.unionByName(other).select("file", "place", "text")


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and ``fingerprint`` of files of any size: over all bytes in their order, hashed line by line with the line's number and the size of the file."""
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("bytes"),
    )
    lines = running(raw, ["file"], ["block", "row"], line=("sum", F.lit(1))).withColumn("line", F.coalesce("line", F.lit(0))).withColumn("bytes", F.hex("bytes"))
    return digest(lines, ["size", "line", "bytes"], "file").select("file", F.sha2("digest", 256).alias("fingerprint"))


def records(lines: DataFrame) -> DataFrame:
    """``file``, ``place`` and ``text`` of whole records: a line break within quotes does not end one.

    Only files that hold a line with an odd number of quotes are looked at twice. In these, running counts of quotes and of record starts number the records
    without putting a file into one task. A record's own lines are gathered.
    """
    quotes = F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))
    counted = checkpointed(lines.withColumn("quotes", quotes))
    broken = counted.groupBy("file").agg(F.max(F.col("quotes") % 2).alias("odd")).filter("odd = 1").select("file")
    plain = counted.join(broken, "file", "left_anti").select("file", "place", "text")
    open_ = running(counted.join(broken, "file", "left_semi"), ["file"], ["place"], before=("sum", F.col("quotes")))
    starts = open_.withColumn("start", (F.coalesce("before", F.lit(0)) % 2 == 0).cast("int"))
    numbered = running(starts, ["file"], ["place"], earlier=("sum", F.col("start"))).withColumn("number", F.coalesce("earlier", F.lit(0)) + F.col("start"))
    parts = numbered.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("parts"))
    joined = parts.select("file", F.col("parts")[0]["place"].alias("place"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    return plain.unionByName(joined)


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files under ``path``, each with a header line of its own; columns of any header, null where a file lacks them.

    Adds ``pos`` unless there is such a column: rows of a file in order, files by path. Blank records are skipped; short records end in nulls.
    """
    rows = records(physical_lines(spark, path)).withColumn("text", F.rtrim(F.col("text"), F.lit("\r")))
    heads = rows.groupBy("file").agg(F.min_by("text", "place").alias("header"), F.min("place").alias("first"))
    body = checkpointed(lookup(rows, heads, ["file"]).filter((F.col("place") > F.col("first")) & (F.col("text") != "")))
    kinds = [r["header"] for r in heads.select("header").distinct().orderBy("header").collect()]  # as many as there are different headers
    out = None
    for header in kinds:
        names = next(csv.reader(io.StringIO(header)), [])
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        fields = F.from_csv("text", schema.simpleString()[7:-1].replace(":", " "), {"escape": '"'})
        part = body.filter(F.col("header") == header).select(F.struct("file", "place").alias("_place"), fields.alias("_r")).select("_place", *[F.col("_r")[f"c{i}"].alias(n) for i, n in enumerate(names)])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(path)
    if "pos" in out.columns:
        return out.drop("_place").withColumn("pos", F.col("pos").cast("bigint"))
    return out.withColumnRenamed("_place", "pos")


def write_delimited(df: DataFrame, path: str, charset: str) -> None:
    """CSV part files with a header each, in any charset that Python knows; all columns are strings."""
    names = df.columns

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for batch in batches:
            out = io.StringIO()
            writer = csv.writer(out, lineterminator="\n")
            if first:
                writer.writerow(names)
            writer.writerows(batch.where(batch.notna(), "").itertuples(index=False))
            yield pd.DataFrame({"value": [out.getvalue()[:-1].encode("utf-8" if charset == "utf-8-sig" and not first else charset)]})
            first = False

    lines = df.select(*[F.col(n).cast("string").alias(n) for n in names]).mapInPandas(encode, "value binary")
    lines.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").text(path)
