"""Model responses that arrive as text columns, parsed into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstrata import constants as K
from linkstrata.sources.schemas import MATCH_RESPONSE

KEY = "industry_id"
# fixed line grammar of a pair verdict, upper or lower case
_ANY = f"[{K.WHITE_SPACE}]*"
VERDICT_LINE = f"(?i)^{_ANY}(p_[0-9a-f]{{16}}){_ANY}:{_ANY}(A_TO_B|B_TO_A|NO){_ANY}$"
FENCE = "```"


def parse_verdicts(responses: DataFrame, expected: DataFrame) -> DataFrame:
    """Verdicts of the expected ids; an id that occurs twice in a response is discarded.

    ``responses``: batch_id, raw_response. ``expected``: batch_id, pair_id.
    """
    text = F.replace("raw_response", F.lit(FENCE), F.lit(""))
    lines = responses.select("batch_id", F.explode(F.split(text, K.LINE_END)).alias("line"))
    rows = lines.filter(F.col("line").rlike(VERDICT_LINE)).select(
        "batch_id", F.lower(F.regexp_extract("line", VERDICT_LINE, 1)).alias("pair_id"), F.upper(F.regexp_extract("line", VERDICT_LINE, 2)).alias("verdict")
    )
    known = rows.join(expected.select("batch_id", "pair_id").distinct(), ["batch_id", "pair_id"], "left_semi")
    return known.groupBy("batch_id", "pair_id").agg(F.count(F.lit(1)).alias("n"), F.max("verdict").alias("verdict")).filter("n = 1").drop("n")


def parse_company_matches(responses: DataFrame, requested: DataFrame) -> DataFrame:
    """One row per (requested company, matched node); companies without a result keep one empty row.

    ``responses``: industry_id, batch_id, raw_response holding one JSON object with ``results``.
    ``requested``: industry_id, batch_id, company_id. The last result of a company wins.
    """
    raw = F.col("raw_response")
    start, back = F.locate("{", raw), F.locate("}", F.reverse(raw))
    body = F.when((start > 0) & (back > 0), F.substring(raw, start, F.length(raw) - back - start + 2))
    # the outer form keeps the optimizer from parsing the text once more for a size filter
    results = responses.select(KEY, "batch_id", F.from_json(body, MATCH_RESPONSE)["results"].alias("r")).select(
        KEY, "batch_id", F.posexplode_outer("r").alias("i", "item")
    ).select(KEY, "batch_id", "i", F.coalesce("item.company_id", F.lit("")).alias("company_id"), "item.matched_nodes").filter(F.col("company_id") != "")
    last = results.groupBy(KEY, "batch_id", "company_id").agg(F.max_by(F.struct("matched_nodes"), "i").alias("m"))
    kept = requested.join(last, [KEY, "batch_id", "company_id"], "left")
    status = F.when(F.col("m").isNotNull(), "returned").otherwise("agent_omitted_filled_empty")
    return kept.select(
        KEY, "batch_id", "company_id", status.alias("result_status"), F.posexplode_outer("m.matched_nodes").alias("match_no", "node")
    ).select(
        KEY, "batch_id", "company_id", "result_status", F.col("match_no"), "node.node_id", "node.reason", "node.confidence", "node.match_method"
    )


def unreadable_responses(responses: DataFrame) -> DataFrame:
    """Responses without a JSON object; they are errors for the caller."""
    raw = F.col("raw_response")
    start, back = F.locate("{", raw), F.locate("}", F.reverse(raw))
    body = F.when((start > 0) & (back > 0), F.substring(raw, start, F.length(raw) - back - start + 2))
    return responses.filter(F.try_parse_json(body).isNull()).select(KEY, "batch_id")
