"""Queries ``opN_<name>`` of the text operators and their SQL twins.

Each query maps a given table to the operator's interface and its result back to the columns that are asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkstrata.functions.tables import join_path
from linkstrata.llm.articles import extract_articles
from linkstrata.llm.common import fresh_path, stage
from linkstrata.llm.exact import exact_duplicates
from linkstrata.llm.language import predict_language
from linkstrata.llm.leaks import leaked_items
from linkstrata.llm.lines import duplicate_lines
from linkstrata.llm.packing import pack_snippets
from linkstrata.llm.quality import score_quality
from linkstrata.llm.ranking import rank_snippets
from linkstrata.llm.records import read_token_records, write_token_records
from linkstrata.llm.scoring import score_snippets
from linkstrata.llm.simhash import near_duplicate_snippets
from linkstrata.llm.warc import read_warc, write_warc
from linkstrata.llm.whitening import whiten_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(join_path(sf_dir, f"{name}.parquet"))


def tokenizer_path(name: str) -> str:
    """A public vocabulary file; the same path on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def as_evidence(documents: DataFrame) -> DataFrame:
    """Documents as evidence rows: the id and the whole text."""
    return documents.select(F.col("doc_id").alias("evidence_id"), F.col("text").alias("snippet"))


@query("op6_exact_dedup", """SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(as_evidence(table(spark, sf_dir, "documents")))
    return found.select(F.col("evidence_id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("content_hash").alias("text_sha256"))


@query("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_snippets(as_evidence(table(spark, sf_dir, "documents")))
    return found.select(F.col("evidence_id").alias("doc_id"), "fingerprint", "component_id")


@query("op5_token_records")
def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-records")
    write_token_records(as_evidence(table(spark, sf_dir, "documents")), path, tokenizer_path("word_bpe_49k.json"))
    read = read_token_records(spark, path)
    rows = stage(read.select(
        F.col("evidence_id").cast("bigint").alias("doc_id"), "shard", "first_token",
        (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
    ), "token-rows")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("held")).withColumn("earlier", F.coalesce(F.sum("held").over(before), F.lit(0)))
    return rows.join(shards, "shard").select("doc_id", (F.col("earlier") + F.col("first_token")).alias("start"), "n_tokens", "ids_crc32")


@query("op7_warc", """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM m""")
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("evidence_id"), "url", F.col("html").alias("snippet"))
    path = fresh_path(spark, "warc")
    write_warc(pages, path)
    return read_warc(spark, path).filter("status = 'record'").select(
        F.col("evidence_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"),
    )


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_snippets(as_evidence(table(spark, sf_dir, "documents")), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select(
        F.col("evidence_id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "context", "step_group",
    )


@query("op1_line_dedup", r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS number FROM documents),
u AS MATERIALIZED (SELECT line, min({'d': doc_id, 'n': number}) AS first, length(line) AS len FROM l WHERE regexp_matches(line, '\S') GROUP BY line),
h AS (SELECT line, first, b AS base, unnest(['h' || left(line, (b // 2)::BIGINT), 't' || right(line, (b - b // 2)::BIGINT)]) AS half FROM (SELECT *, unnest([len, len - 1]) AS b FROM u WHERE len >= 16)),
near AS (SELECT DISTINCT a.line FROM h a JOIN h b ON a.base = b.base AND a.half = b.half AND b.first < a.first AND levenshtein(a.line, b.line) = 1),
m AS (SELECT l.doc_id, l.number, u.first IS NOT NULL AND {'d': l.doc_id, 'n': l.number} > u.first AS copy, near.line IS NOT NULL AS near
FROM l LEFT JOIN u ON u.line = l.line LEFT JOIN near ON near.line = l.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (copy) AS n_copies, count(*) FILTER (near AND NOT copy) AS n_near,
coalesce(string_agg(number::VARCHAR, ',' ORDER BY number) FILTER (copy OR near), '') AS dropped FROM m GROUP BY doc_id""")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicate_lines(as_evidence(table(spark, sf_dir, "documents")))
    return found.select(F.col("evidence_id").alias("doc_id"), "n_lines", "n_copies", "n_near", F.array_join("dropped", ",").alias("dropped"))


@query("op3_benchmark_decontamination", r"""WITH i AS (SELECT item_id, [x FOR x IN string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM benchmark),
s AS (SELECT item_id, least(len(w), 5) AS size, list_distinct([array_to_string(w[p:p + least(len(w), 5) - 1], ' ') FOR p IN range(1, len(w) - least(len(w), 5) + 2)]) AS sh FROM i WHERE len(w) > 0),
q AS (SELECT item_id, size, len(sh) AS n_shingles, unnest(sh) AS shingle FROM s),
d AS (SELECT doc_id, [x FOR x IN string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[p:p + size - 1], ' ') FOR p IN range(1, len(w) - size + 2)]) AS shingle FROM d, (SELECT DISTINCT size FROM s))
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_shingles) AS n_shingles, count(*) / any_value(n_shingles) AS containment
FROM g JOIN q USING (shingle) GROUP BY doc_id, item_id HAVING count(*) / any_value(n_shingles) >= 0.8::DOUBLE""")
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("message"))
    return leaked_items(as_evidence(table(spark, sf_dir, "documents")), items).withColumnRenamed("evidence_id", "doc_id")


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    opinions = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("evidence_id"), F.col("quality").alias("status"))
    return score_quality(as_evidence(table(spark, sf_dir, "documents")), opinions).withColumnRenamed("evidence_id", "doc_id")


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), F.col("text").alias("snippet"), "lang")
    return predict_language(documents).withColumnRenamed("evidence_id", "doc_id")


@query("op2_lm_scoring")
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_snippets(as_evidence(table(spark, sf_dir, "documents"))).withColumnRenamed("evidence_id", "doc_id")


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_vectors(table(spark, sf_dir, "embeddings"))


@query("op12_ranked_search", r"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, w, len(w) AS n FROM t WHERE len(w) > 0),
size AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, size GROUP BY term, docs),
s AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
FROM q JOIN p USING (term) JOIN f USING (term), size GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50""")
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("message"))
    return rank_snippets(as_evidence(table(spark, sf_dir, "documents")), items).withColumnRenamed("evidence_id", "doc_id")


@query("op13_html_extraction")
def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("evidence_id"), "url", F.col("html").alias("snippet"))
    return extract_articles(pages).select(F.col("evidence_id").alias("page_id"), "url", F.col("snippet").alias("text"), "n_chars")
