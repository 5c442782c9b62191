"""Scalar business rules as Column expressions. Everything stays in the JVM except NFKC."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkstrata import constants as K


def strip(c: Column | str) -> Column:
    """Text without white space of any kind at its ends."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(K.WHITE_SPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def or_default(c: Column, *others: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(blank_to_null(c), *[blank_to_null(o) for o in others[:-1]], others[-1])


def edge_id(source: Column, relation: Column, target: Column) -> Column:
    return F.concat(source, F.lit("__"), relation, F.lit("__"), target)


def node_type(level: Column, position: Column) -> Column:
    return (
        F.when((level == 0) | (position == "root"), F.lit(K.NODE_TYPE_ROOT))
        .when(F.coalesce(level, F.lit(0)) <= 1, F.lit(K.NODE_TYPE_LEVEL_ONE))
        .otherwise(F.lit(K.NODE_TYPE_DETAIL))
    )


def is_root(level: Column, position: Column) -> Column:
    return F.coalesce((level == 0) | (position == "root"), F.lit(False))


def is_level_one_flow(level: Column, position: Column) -> Column:
    return F.coalesce((level == 1) & position.isin("upstream", "downstream"), F.lit(False))


def segment_label(position: Column) -> Column:
    expr = None
    for key, label in K.SEGMENT_LABELS.items():
        expr = F.when(position == key, label) if expr is None else expr.when(position == key, label)
    return expr.otherwise(position)


def delivery_segment(level: Column, position: Column, segment: Column) -> Column:
    """Only L1 rows carry a segment label; a root position maps to blank."""
    return (
        F.when(level != 1, F.lit(""))
        .when(position == "root", F.lit(""))
        .when(position.isin(*K.COVERED_POSITIONS), segment_label(position))
        .otherwise(F.coalesce(segment, F.lit("")))
    )


def _pad(c: Column, width: int) -> Column:
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def delivery_id(node_id: Column, industry_id: Column, code: Column, strict: bool = True) -> Column:
    """Recode ``<industry>_001_002`` to ``<code>001002``; other shapes raise (or give null)."""
    prefix = F.concat(industry_id, F.lit("_"))
    suffix = F.when(F.startswith(node_id, prefix), F.substring(node_id, F.length(prefix) + 1, F.length(node_id))).otherwise(node_id)
    tokens = F.split(suffix, "_")
    digits = F.transform(tokens, lambda t: _pad(F.coalesce(blank_to_null(F.regexp_replace(t, "^0+", "")), F.lit("0")), 3))
    bad = F.raise_error(F.concat(F.lit("node id does not fit the delivery code: "), node_id)) if strict else F.lit(None)
    valid = F.forall(tokens, lambda t: t.rlike("^[0-9]+$"))
    return F.when(valid, F.concat(code, _pad(F.array_join(digits, ""), 6))).otherwise(bad.cast("string"))


def safe_file_name(c: Column) -> Column:
    return or_default(strip(F.regexp_replace(c, r'[<>:"/\\|?*]', "")), F.lit("industry"))


def three_valued_flag(c: Column) -> Column:
    text = strip(c.cast("string"))
    return F.when(text.isNotNull() & (text != ""), F.lower(text).isin("1", "true", "yes", "y"))


def company_id(code: Column) -> Column:
    return F.concat(F.lit("sw_"), strip(code))


def normalized_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), K.SPACES, "")


def looks_like_process_step(name: Column) -> Column:
    has_term = name.rlike("|".join(K.PROCESS_STEP_TERMS))
    excepted = name.rlike("|".join(K.PROCESS_STEP_EXCEPTIONS))
    return F.when(has_term, ~excepted).otherwise(name.rlike("(" + "|".join(K.PROCESS_STEP_SUFFIXES) + ")$"))


def case_folded(c: Column) -> Column:
    """Lower case, with the letters that case folding writes differently: sharp s, final sigma, long s."""
    return F.replace(F.translate(F.lower(c), "ςſ", "σs"), F.lit("ß"), F.lit("ss"))


def match_label(c: Column) -> Column:
    """Taxonomy label for exact matching: no whitespace, no trailing Roman numeral, case folded."""
    squeezed = F.regexp_replace(F.coalesce(c, F.lit("")), K.SPACES, "")
    return case_folded(F.regexp_replace(squeezed, "[ⅠⅡⅢⅣⅤⅥ]+$", ""))


@F.pandas_udf(T.StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.str.normalize("NFKC")


def nfkc(c: Column) -> Column:
    return _nfkc(c)


def tree_label(c: Column) -> Column:
    """Taxonomy label for the tree: NFKC, single spaces, no level suffix.

    Project it before using it inside a higher-order function (it holds an Arrow UDF).
    """
    no_suffix = F.regexp_replace(F.coalesce(c, F.lit("")), f"{K.SPACES[:-1]}*[Ⅰ-Ⅹ]+{K.SPACES[:-1]}*$", "")
    cleaned = F.regexp_replace(strip(nfkc(no_suffix)), K.SPACES, " ")
    return strip(F.regexp_replace(cleaned, f"(?<=[㐀-鿿]){K.SPACES[:-1]}*[IVX]{{1,4}}{K.SPACES[:-1]}*$", ""))


def tree_path(levels: list[Column], leaf: Column) -> Column:
    """Fold equal neighbours of the three level labels, then add the leaf while shorter than three."""
    seen = F.filter(F.array(*levels), lambda x: x != "")
    folded = F.filter(
        F.transform(seen, lambda x, i: F.when((i == 0) | (x != F.get(seen, i - 1)), x)), lambda x: x.isNotNull()
    )
    last = F.get(folded, F.size(folded) - 1)
    add = (leaf != "") & (F.size(folded) < 3) & (F.coalesce(last, F.lit("")) != leaf)
    return F.when(add, F.concat(folded, F.array(leaf))).otherwise(folded)


def clamp_confidence(c: Column) -> Column:
    value = c.cast("string").try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(K.DEFAULT_CONFIDENCE))))


def ordered_distinct(urls: Column) -> Column:
    return F.array_distinct(F.filter(F.coalesce(urls, F.array().cast("array<string>")), lambda u: u.isNotNull() & (u != "")))


def default_evidence_ids(urls: Column) -> Column:
    return F.transform(urls, lambda _, i: F.format_string("source_%03d", i + 1))


def plain_text(*parts: Column) -> Column:
    """Lower-case text reduced to digits, a-z and Han characters."""
    joined = F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))
    return F.regexp_replace(joined, r"[^0-9a-z一-鿿]+", "")


def grams(text: Column) -> Column:
    """Set of character 2- and 3-grams, linear in the text (characters are split once)."""
    chars = F.filter(F.split(text, ""), lambda ch: ch != "")
    pairs = F.zip_with(chars, F.slice(chars, F.lit(2), F.greatest(F.size(chars), F.lit(0))), lambda a, b: F.concat(a, b))
    triples = F.zip_with(pairs, F.slice(chars, F.lit(3), F.greatest(F.size(chars), F.lit(0))), lambda p, c: F.concat(p, c))
    return F.array_distinct(F.filter(F.concat(pairs, triples), lambda g: g.isNotNull()))


def pair_id(a: Column, b: Column) -> Column:
    key = F.concat(F.least(a, b), F.char(F.lit(0)), F.greatest(a, b))
    return F.concat(F.lit("p_"), F.substring(F.sha2(key, 256), 1, 16))


def audit_selected(pair: Column, rate: float) -> Column:
    value = F.conv(F.substring(F.sha2(pair, 256), 1, 8), 16, 10).cast("bigint")
    return (value / F.lit(float(0xFFFFFFFF))) < F.lit(rate)


def row_hash(*cols: Column) -> Column:
    """sha256 of the JSON of the given columns; nulls are kept so shapes cannot collide."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def quality_passed(status: Column, score: Column, blocking: Column, focus: Column) -> Column:
    points = score.cast("string").try_cast("int")
    return F.coalesce(
        (F.lower(status) == "pass")
        & (points >= K.QUALITY_PASS_SCORE)
        & (F.coalesce(F.size(blocking), F.lit(0)) <= 0)
        & (F.coalesce(F.size(focus), F.lit(0)) <= 0),
        F.lit(False),
    )


def relation_sentence(relation: Column, source_name: Column, target_name: Column) -> Column:
    return F.when(relation == K.CONTAINS, F.concat(target_name, F.lit(" 隶属于 "), source_name)).otherwise(
        F.concat(target_name, F.lit(" 是 "), source_name, F.lit(" 的下游"))
    )


def has_http_scheme(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)).isin("http", "https"), F.lit(False))
