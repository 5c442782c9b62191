"""Registry of the named queries and of their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstrata import constants as K
from linkstrata.sources.derived import GraphTables, duckdb_tables, graph_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEY = "industry_id"
AS_OF = "2024-06-01"


_TRIM = re.compile(r"(?<![a-z_])trim\(")


def _stripping(sql: str) -> str:
    """The SQL with white space meaning white space of any kind, in ``trim`` and in patterns."""
    sql = sql.replace("\\s", f"[{K.WHITE_SPACE}]")
    out, at = [], 0
    for start in [m.end() for m in _TRIM.finditer(sql)]:
        depth, end, quoted = 1, start, False
        while depth:
            ch = sql[end]
            quoted ^= ch == "'"
            depth += 0 if quoted else (ch == "(") - (ch == ")")
            end += 1
        out.append((start, end - 1))
    pieces = []
    for position in sorted(end for _, end in out):
        pieces += [sql[at:position], f", '{K.WHITE_SPACE}'"]
        at = position
    return "".join([*pieces, sql[at:]])


def twin(select: str, tables: tuple[str, ...] = (), parts: tuple[tuple[str, str], ...] = ()) -> str:
    """SQL over the base tables: derived tables, then helper parts, then the final select."""
    ctes = [*duckdb_tables(*tables), *((name, _stripping(sql)) for name, sql in parts)]
    select = _stripping(select)
    if not ctes:
        return select
    body = ",\n".join(f"{name} AS {'' if '(' in name else 'MATERIALIZED '}(\n{sql}\n)" for name, sql in ctes)
    return f"WITH RECURSIVE {body}\n{select}"


def query(name: str, select: str | None = None, tables: tuple[str, ...] = (), parts: tuple = ()):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with an optional SQL twin."""

    def register(fn: Callable[[GraphTables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(graph_tables(spark, sf_dir))
        if select is not None:
            ORACLES[name] = twin(select, tables, parts)
        return fn

    return register


def joined(df: DataFrame, *columns: str, sep: str = ";") -> DataFrame:
    """Array columns as text, so both engines give comparable values."""
    return df.select(*[F.array_join(c, sep).alias(c) if c in columns else F.col(c) for c in df.columns])


# --- shared SQL parts -------------------------------------------------------------------
AGG_PARENT = (
    ("boundary", """SELECT DISTINCT e.industry_id, CASE WHEN t.level = 1 THEN t.id ELSE s.id END AS id FROM edges e
JOIN nodes s ON s.industry_id = e.industry_id AND s.id = e.source JOIN nodes t ON t.industry_id = e.industry_id AND t.id = e.target
WHERE e.relation_type = 'upstream_downstream' AND s.level + t.level = 1 AND s.level >= 0 AND t.level >= 0"""),
    ("first_contains", "SELECT industry_id, target AS id, arg_min(source, pos) AS src FROM edges WHERE relation_type = 'contains' GROUP BY ALL"),
    ("agg_parent", """SELECT n.industry_id, n.id, coalesce(CASE WHEN b.id IS NOT NULL AND p.level = 0 THEN NULL ELSE nullif(n.parent_id, '') END, f.src) AS parent
FROM nodes n LEFT JOIN boundary b ON b.industry_id = n.industry_id AND b.id = n.id
LEFT JOIN nodes p ON p.industry_id = n.industry_id AND p.id = n.parent_id
LEFT JOIN first_contains f ON f.industry_id = n.industry_id AND f.id = n.id"""),
)
H = AGG_PARENT + (
    ("h(industry_id, id, ancestor, dist)", """SELECT industry_id, id, id, 0 FROM nodes UNION ALL
SELECT h.industry_id, h.id, a.parent, h.dist + 1 FROM h JOIN agg_parent a ON a.industry_id = h.industry_id AND a.id = h.ancestor
WHERE a.parent IS NOT NULL AND h.dist < 40"""),
)
TREE = (
    ("th(industry_id, id, ancestor, dist)", """SELECT industry_id, id, id, 0 FROM nodes UNION ALL
SELECT th.industry_id, th.id, p.id, th.dist + 1 FROM th JOIN nodes n ON n.industry_id = th.industry_id AND n.id = th.ancestor
JOIN nodes p ON p.industry_id = n.industry_id AND p.id = n.parent_id WHERE th.dist < 40"""),
)
LINE = TREE + (
    ("line", """SELECT t.industry_id, t.id, string_agg(n.name, ' / ' ORDER BY t.dist DESC) AS path,
coalesce(max(CASE WHEN n.level = 1 THEN n.id END), '') AS branch_id, coalesce(max(CASE WHEN n.level = 1 THEN n.name END), '') AS branch_name,
coalesce(max(CASE WHEN n.level = 1 AND n.chain_position IN ('upstream', 'downstream') THEN n.chain_position END), 'contains') AS branch_role
FROM th t JOIN nodes n ON n.industry_id = t.industry_id AND n.id = t.ancestor GROUP BY ALL"""),
)
