"""Graph tables derived from the star-schema tables, as portable SQL.

``{name}`` refers to a base table or to another definition. Columns listed in ``LISTS`` are
written as ``;``-joined text here and become arrays when the table is built.

Shape: one graph per part type, so a graph grows with the data; L1 = size class, L2 = brand, L3 = part name; companies are suppliers; attachments come
from line items; proposals and repairs come from events. Copies with defects, chosen by key
arithmetic over all rows, give every rule something to find.
"""

SOURCE = "https://src.example.org/"

DEFINITIONS: dict[str, str] = {}

DEFINITIONS["parts"] = """
SELECT p_partkey, p_name, p_brand, p_type, p_size,
       least(6, 1 + cast(floor((p_size - 1) / 8) AS int)) AS k1,
       lower(p_type) AS industry_id, p_type AS industry_name
FROM {part}
"""

DEFINITIONS["branch_keys"] = """
SELECT industry_id, industry_name, k1, p_brand, lo, hi,
       row_number() OVER (PARTITION BY industry_id, k1 ORDER BY p_brand) AS k2
FROM (SELECT industry_id, industry_name, k1, p_brand, min(p_name) AS lo, max(p_name) AS hi FROM {parts}
      GROUP BY industry_id, industry_name, k1, p_brand) x
"""

DEFINITIONS["leaf_keys"] = """
SELECT x.industry_id, x.industry_name, x.k1, x.p_brand, x.p_name, b.k2, x.partkey,
       row_number() OVER (PARTITION BY x.industry_id, x.k1, x.p_brand ORDER BY x.p_name) AS k3
FROM (SELECT industry_id, industry_name, k1, p_brand, p_name, min(p_partkey) AS partkey FROM {parts}
      GROUP BY industry_id, industry_name, k1, p_brand, p_name) x
JOIN {branch_keys} b ON b.industry_id = x.industry_id AND b.k1 = x.k1 AND b.p_brand = x.p_brand
"""

_POSITION = """CASE WHEN k1 = 0 THEN 'root' WHEN k1 <= 2 THEN 'upstream' WHEN k1 = 3 THEN 'midstream'
     WHEN k1 = 4 THEN 'support' ELSE 'downstream' END"""

DEFINITIONS["node_base"] = f"""
SELECT industry_id, (cast(k1 AS bigint) * 1000000 + k2) * 1000000 + k3 AS pos, id, name, level, k1, k2, k3, partkey, industry_name,
       {_POSITION} AS chain_position, parent_id, description,
       CASE WHEN level >= 2 AND (k1 * 5 + k2 * 3 + k3) % 7 = 0 THEN ''
            ELSE '{SOURCE}' || id || ';{SOURCE}name/' || lower(name) END AS source_urls,
       CASE WHEN level >= 2 AND (k1 * 5 + k2 * 3 + k3) % 7 = 0 THEN '' ELSE 'ev_' || id END AS evidence_ids,
       round(cast(40 + (k1 * 13 + k2 * 7 + k3 * 3) % 60 AS double) / 100, 2) AS confidence
FROM (
  SELECT industry_id, industry_name, 0 AS k1, 0 AS k2, 0 AS k3, industry_id || '_000' AS id, industry_name AS name, 0 AS level,
         cast(0 AS bigint) AS partkey, '' AS parent_id, 'all links of ' || industry_name AS description
  FROM {{parts}} GROUP BY industry_id, industry_name
  UNION ALL
  SELECT industry_id, industry_name, k1, 0, 0, industry_id || '_' || lpad(cast(k1 AS string), cast(greatest(3, length(cast(k1 AS string))) AS int), '0'), 'size class ' || cast(k1 AS string), 1,
         cast(0 AS bigint), CASE WHEN k1 IN (3, 4) THEN industry_id || '_000' ELSE '' END, ''
  FROM {{parts}} GROUP BY industry_id, industry_name, k1
  UNION ALL
  SELECT industry_id, industry_name, k1, k2, 0,
         industry_id || '_' || lpad(cast(k1 AS string), cast(greatest(3, length(cast(k1 AS string))) AS int), '0') || '_' || lpad(cast(k2 AS string), cast(greatest(3, length(cast(k2 AS string))) AS int), '0'), p_brand, 2,
         cast(0 AS bigint), industry_id || '_' || lpad(cast(k1 AS string), cast(greatest(3, length(cast(k1 AS string))) AS int), '0'), p_brand || ' covers ' || lo || ' to ' || hi
  FROM {{branch_keys}}
  UNION ALL
  SELECT industry_id, industry_name, k1, k2, k3,
         industry_id || '_' || lpad(cast(k1 AS string), cast(greatest(3, length(cast(k1 AS string))) AS int), '0') || '_' || lpad(cast(k2 AS string), cast(greatest(3, length(cast(k2 AS string))) AS int), '0') || '_' || lpad(cast(k3 AS string), cast(greatest(3, length(cast(k3 AS string))) AS int), '0'), p_name, 3,
         partkey, industry_id || '_' || lpad(cast(k1 AS string), cast(greatest(3, length(cast(k1 AS string))) AS int), '0') || '_' || lpad(cast(k2 AS string), cast(greatest(3, length(cast(k2 AS string))) AS int), '0'),
         p_name || ' of ' || p_brand || ' goes with Brand#' || cast((partkey * 7 + k1) % 25 + 1 AS string)
  FROM {{leaf_keys}}
) t
"""

DEFINITIONS["graphs"] = """
SELECT industry_id, industry_name AS industry, cast(NULL AS string) AS version, 'standard_industry_graph_v0.2_agent' AS schema_version,
       '2024-05-01T08:00:00+00:00' AS generated_at, cast(NULL AS string) AS scope,
       'Report A|https://basis.example.org/' || industry_id || '/a|first;Report B|https://basis.example.org/' || industry_id ||
       '/b|second;Report A2|https://basis.example.org/' || industry_id || '/a|again;No link||none' AS source_basis
FROM {node_base} WHERE level = 0
"""

DEFINITIONS["manifest"] = """
SELECT industry_id, industry_name AS name, CASE WHEN industry_id LIKE 'small%' THEN 'pending' ELSE 'published' END AS status,
       cast(NULL AS bigint) AS node_count, cast(7 AS bigint) AS edge_count
FROM {node_base} WHERE level = 0
"""

DEFINITIONS["delivery_codes"] = """
SELECT industry_id, upper(substr(industry_id, 1, 4)) || '_' AS code, industry_name AS delivery_name, '04' || lpad(cast(pos AS string), 4, '0') AS ind_id
FROM {node_base} WHERE level = 0
"""

# headers of the attachment payloads; their dates differ from those of the graphs
DEFINITIONS["payloads"] = """
SELECT industry_id, CASE WHEN industry_id LIKE 'med%' THEN '' ELSE '2024-05-20T09:00:00+00:00' END AS generated_at FROM {node_base} WHERE level = 0
"""

DEFINITIONS["nodes"] = """
SELECT industry_id, pos, id, name, CASE WHEN level = 0 THEN '产业链' WHEN level = 1 THEN '产业链环节' ELSE '细分环节' END AS node_type,
       'level_' || cast(level AS string) || ';' || chain_position AS tags, industry_name AS industry, level, chain_position, parent_id,
       description, description AS business_description, level <= 1 AS is_key_node,
       CASE chain_position WHEN 'root' THEN 'root' WHEN 'upstream' THEN '上游' WHEN 'midstream' THEN '中游'
            WHEN 'downstream' THEN '下游' ELSE '支持' END AS chain_segment,
       source_urls, evidence_ids, confidence, '2024-05-01' AS updated_at
FROM {node_base}
"""

DEFINITIONS["edges"] = """
SELECT industry_id, pos, source || '__' || relation_type || '__' || target AS id, source, target, relation_type,
       cast(1 AS double) AS relation_weight, '' AS description, source_urls, evidence_ids, confidence, '2024-05-01' AS updated_at
FROM (
  SELECT industry_id, pos, parent_id AS source, id AS target, 'contains' AS relation_type, source_urls, evidence_ids, confidence
  FROM {node_base} WHERE parent_id <> ''
  UNION ALL
  SELECT industry_id, pos, CASE WHEN chain_position = 'upstream' THEN id ELSE industry_id || '_000' END,
         CASE WHEN chain_position = 'upstream' THEN industry_id || '_000' ELSE id END, 'upstream_downstream', source_urls, evidence_ids, confidence
  FROM {node_base} WHERE level = 1 AND chain_position IN ('upstream', 'downstream')
) t
"""

# graphs with planned branches and leaves that no line item supplies
DEFINITIONS["wide_nodes"] = """
SELECT industry_id, pos, id, name, node_type, tags, industry, level, chain_position, parent_id, description, business_description, is_key_node,
       chain_segment, source_urls, evidence_ids, confidence, updated_at FROM {nodes}
UNION ALL
SELECT industry_id, pos + 900, id || '_900', 'planned ' || name, node_type, tags, industry, level + 1, chain_position, id, '', '', false,
       chain_segment, source_urls, evidence_ids, confidence, updated_at FROM {nodes} WHERE level IN (1, 2)
UNION ALL
SELECT industry_id, pos + 901, id || '_900_001', 'planned part of ' || name, node_type, tags, industry, level + 2, chain_position, id || '_900', '', '', false,
       chain_segment, source_urls, evidence_ids, confidence, updated_at FROM {nodes} WHERE level = 1
"""

DEFINITIONS["wide_edges"] = """
SELECT industry_id, pos, id, source, target, relation_type, relation_weight, description, source_urls, evidence_ids, confidence, updated_at FROM {edges}
UNION ALL
SELECT industry_id, pos, parent_id || '__contains__' || id, parent_id, id, 'contains', cast(1 AS double), '', source_urls, evidence_ids, confidence, updated_at
FROM {wide_nodes} WHERE name LIKE 'planned %'
"""

# formal graphs: every item has a source url, except in some industries
_FORMAL_URLS = "CASE WHEN source_urls = '' AND industry_id NOT LIKE 'pro%' THEN 'https://basis.example.org/' || industry_id ELSE source_urls END AS source_urls, evidence_ids, confidence, '2024"
DEFINITIONS["formal_nodes"] = DEFINITIONS["nodes"].replace("source_urls, evidence_ids, confidence, '2024", _FORMAL_URLS)
DEFINITIONS["formal_edges"] = DEFINITIONS["edges"].replace("source_urls, evidence_ids, confidence, '2024", _FORMAL_URLS)

# loose model output: blanks, missing parents, repeated rows, company data, odd levels and names
DEFINITIONS["raw_nodes"] = """
SELECT industry_id, pos * 10 + copy AS pos, id,
       CASE WHEN level = 3 AND v % 17 = 0 THEN name || '清洗' WHEN level = 3 AND v % 19 = 0 THEN name || '发酵设备'
            WHEN level = 3 AND v % 23 = 0 THEN name || '加工步骤' WHEN level = 3 AND v % 29 = 1 THEN replace(name, ' ', '\u2003') ELSE name END AS name,
       cast(NULL AS string) AS node_type, '' AS tags, CASE WHEN v % 4 = 0 THEN '' ELSE cast(NULL AS string) END AS industry,
       CASE WHEN level = 3 AND v % 53 = 5 THEN -1 ELSE level END AS level, chain_position,
       CASE WHEN level >= 2 AND v % 11 = 3 THEN '' WHEN level = 1 THEN industry_id || '_000' ELSE parent_id END AS parent_id,
       CASE WHEN v % 3 = 0 THEN '' ELSE description END AS description,
       CASE WHEN v % 3 = 0 THEN description ELSE '' END AS business_description,
       cast(NULL AS boolean) AS is_key_node, '' AS chain_segment, CASE WHEN v % 6 = 0 THEN '' ELSE source_urls END AS source_urls,
       evidence_ids, CASE WHEN v % 5 = 0 THEN cast(NULL AS double) ELSE confidence END AS confidence, '' AS updated_at,
       v % 43 = 4 AS has_company_field
FROM (
  SELECT b.*, k1 * 31 + k2 * 7 + k3 AS v, 0 AS copy FROM {node_base} b
  UNION ALL
  SELECT b.*, k1 * 31 + k2 * 7 + k3 AS v, 1 AS copy FROM {node_base} b WHERE level = 3 AND (k1 * 31 + k2 * 7 + k3) % 37 = 7
) t
"""

DEFINITIONS["raw_edges"] = """
SELECT industry_id, pos * 10 + kind AS pos, cast(NULL AS string) AS id, source, target, relation_type,
       CASE WHEN v % 4 = 1 THEN cast(2 AS double) ELSE cast(NULL AS double) END AS relation_weight,
       CASE WHEN v % 4 = 2 THEN 'seen ' || target ELSE cast(NULL AS string) END AS description,
       CASE WHEN v % 3 = 0 THEN source_urls ELSE '' END AS source_urls, '' AS evidence_ids,
       CASE WHEN v % 6 = 0 THEN cast(0.3 AS double) ELSE cast(NULL AS double) END AS confidence, '' AS updated_at
FROM (
  SELECT industry_id, pos, 0 AS kind, k1 * 31 + k2 * 7 + k3 AS v, parent_id AS source, id AS target, 'contains' AS relation_type, source_urls
  FROM {node_base} WHERE parent_id <> ''
  UNION ALL
  SELECT industry_id, pos, 1, k1 * 31 + k2 * 7 + k3, parent_id, id || '_x', 'contains', source_urls
  FROM {node_base} WHERE parent_id <> '' AND (k1 * 31 + k2 * 7 + k3) % 29 = 2
  UNION ALL
  SELECT industry_id, pos, 2, k1 * 31 + k2 * 7 + k3, parent_id, id, 'upstream_downstream', source_urls
  FROM {node_base} WHERE parent_id <> '' AND (k1 * 31 + k2 * 7 + k3) % 41 = 1
  UNION ALL
  SELECT industry_id, pos, 3, k1 * 31 + k2 * 7 + k3, parent_id, id, 'related', source_urls
  FROM {node_base} WHERE parent_id <> '' AND (k1 * 31 + k2 * 7 + k3) % 47 = 3
  UNION ALL
  SELECT industry_id, pos, 4, k1 * 31, id, industry_id || '_000', 'upstream_downstream', source_urls FROM {node_base} WHERE level = 1
) t
"""

DEFINITIONS["company_base"] = """
SELECT s_suppkey, 'sw_' || cast(s_suppkey AS string) AS company_id, cast(s_suppkey AS string) AS comcode, s_name AS name,
       'S' || cast(s_suppkey AS string) AS short_name,
       CASE WHEN s_suppkey % 5 = 0 THEN cast(NULL AS boolean) ELSE s_acctbal > 2000 END AS is_listed,
       CASE WHEN s_suppkey % 9 = 0 THEN cast(NULL AS boolean) ELSE s_suppkey % 7 = 0 END AS is_abroad_listed,
       CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 4 <> 0 THEN p_name || 'Ⅲ' ELSE 'Brand#' || cast(s_suppkey % 25 + 1 AS string) || 'Ⅱ' END AS indunamesw,
       (CASE s_suppkey % 6 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'LARGE' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'PROMO' WHEN 4 THEN 'SMALL' ELSE 'STANDARD' END) AS indunamesw1,
       'Brand#' || cast(s_suppkey % 25 + 1 AS string) || 'Ⅱ' AS indunamesw2,
       CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE p_name || 'Ⅲ' END AS indunamesw3
FROM {supplier} JOIN {part} ON p_partkey = s_suppkey * 20
"""

DEFINITIONS["companies"] = """
SELECT company_id, comcode, name, short_name, is_listed, is_abroad_listed, indunamesw, indunamesw1, indunamesw2, indunamesw3
FROM {company_base}
"""

# rows of the candidate file: padded codes, blank names, repeated codes, flag spellings
DEFINITIONS["company_file"] = """
SELECT s_suppkey * 10 + copy AS pos,
       CASE s_suppkey % 3 WHEN 0 THEN ' ' || comcode || ' ' WHEN 1 THEN '\t' || comcode || '\u3000' ELSE '\u2003' || comcode END AS comcode,
       CASE WHEN copy = 0 AND s_suppkey % 8 = 1 THEN '' ELSE name || CASE WHEN copy = 1 THEN ' copy' ELSE '' END END AS chiname, short_name AS chinameabbr,
       CASE WHEN is_listed IS NULL THEN '\u2003' WHEN is_listed THEN (CASE WHEN s_suppkey % 2 = 0 THEN 'TRUE\t' ELSE '\u30001' END) ELSE 'no' END AS islisted,
       CASE WHEN is_abroad_listed IS NULL THEN '' WHEN is_abroad_listed THEN 'Y' ELSE '0' END AS isabroadlisted,
       indunamesw, indunamesw1, indunamesw2, indunamesw3
FROM (SELECT c.*, 0 AS copy FROM {company_base} c UNION ALL SELECT c.*, 1 AS copy FROM {company_base} c WHERE s_suppkey % 4 = 1) t
"""

DEFINITIONS["supply"] = """
SELECT n.industry_id, 'sw_' || cast(l.l_suppkey AS string) AS company_id, n.id AS leaf_id, n.parent_id AS branch_id,
       min(l.l_orderkey * 10 + l.l_linenumber) AS pos, min(l.l_orderkey) AS o, round(1 - max(l.l_discount), 4) AS confidence
FROM {lineitem} l JOIN {parts} p ON l.l_partkey = p.p_partkey
JOIN {leaf_keys} k ON k.industry_id = p.industry_id AND k.k1 = p.k1 AND k.p_brand = p.p_brand AND k.p_name = p.p_name
JOIN {node_base} n ON n.industry_id = k.industry_id AND n.partkey = k.partkey AND n.level = 3
GROUP BY n.industry_id, l.l_suppkey, n.id, n.parent_id
"""

DEFINITIONS["attachments"] = """
SELECT industry_id, pos, company_id, leaf_id AS node_id, 'order ' || cast(o AS string) AS reason, confidence,
       CASE WHEN o % 3 = 0 THEN 'deterministic_taxonomy_exact' ELSE 'agent_web_search' END AS match_method,
       cast(NULL AS string) AS taxonomy_column, cast(NULL AS string) AS taxonomy_value
FROM {supply}
"""

# attachments with defects for the rule set
DEFINITIONS["loose_attachments"] = """
SELECT industry_id, pos, CASE WHEN o % 101 = 0 THEN company_id || '_x' ELSE company_id END AS company_id,
       CASE WHEN o % 29 = 1 THEN industry_id || '_000' WHEN o % 31 = 2 THEN leaf_id || '_x' WHEN o % 7 = 3 THEN branch_id ELSE leaf_id END AS node_id,
       CASE WHEN o % 46 = 4 THEN '\t\u3000' WHEN o % 23 = 4 THEN ' ' ELSE 'order ' || cast(o AS string) END AS reason,
       CASE WHEN o % 37 = 5 THEN cast(1.5 AS double) WHEN o % 41 = 6 THEN cast(NULL AS double) ELSE confidence END AS confidence,
       'agent_web_search' AS match_method, cast(NULL AS string) AS taxonomy_column, cast(NULL AS string) AS taxonomy_value
FROM {supply}
"""

DEFINITIONS["web_matches"] = """
SELECT industry_id, pos, company_id,
       CASE WHEN o % 11 = 0 THEN industry_id || '_000' WHEN o % 5 = 0 THEN branch_id WHEN o % 17 = 0 THEN leaf_id || '_gone' ELSE leaf_id END AS node_id,
       CASE WHEN o % 2 = 0 THEN '\u3000order ' ELSE ' order ' END || cast(o AS string) AS reason,
       CASE WHEN o % 7 = 0 THEN 'n/a' WHEN o % 13 = 0 THEN '1.7' ELSE cast(confidence AS string) END AS confidence,
       CASE WHEN o % 3 = 0 THEN '' ELSE 'agent_web_search' END AS match_method, cast(NULL AS string) AS taxonomy_column, cast(NULL AS string) AS taxonomy_value
FROM {supply}
"""

DEFINITIONS["scope_rules"] = """
SELECT industry_id, 0 AS rule_pos, 0 AS value_pos, 'indunamesw1' AS column_name, industry_name AS value, 'own sector' AS reason FROM {node_base} WHERE level = 0
UNION ALL
SELECT industry_id, 1, k2, ' indunamesw2', name || 'Ⅱ ', 'brand of the graph' FROM {node_base} WHERE level = 2 AND k1 = 1
UNION ALL
SELECT industry_id, 2, k2, 'indunamesw2', name || 'Ⅱ', 'brand again' FROM {node_base} WHERE level = 2 AND k1 = 2
UNION ALL
SELECT industry_id, 3, k2, 'sector', name, 'unknown column' FROM {node_base} WHERE level = 2 AND k1 = 3
"""

DEFINITIONS["taxonomy_selection"] = """
SELECT industry_id, cast(pos AS bigint) AS pos, industry_name || ' > ' || name || CASE WHEN k2 % 5 = 0 THEN ' ' ELSE '' END AS path, ' brand of the graph' AS reason,
       CASE WHEN k2 % 4 = 0 THEN 'Core ' WHEN k2 % 4 = 1 THEN 'upstream' WHEN k2 % 4 = 2 THEN 'channel' ELSE 'DOWNSTREAM' END AS suggested_role
FROM {node_base} WHERE level = 2
"""

# --- flow overlay ------------------------------------------------------------------------
DEFINITIONS["pair_base"] = """
SELECT industry_id, node_a_id, node_b_id, 'p_' || substr(sha2(node_a_id || chr(0) || node_b_id, 256), 1, 16) AS pair_id, k1_a, k1_b
FROM (
  SELECT DISTINCT a.industry_id, least(a.id, b.id) AS node_a_id, greatest(a.id, b.id) AS node_b_id,
         CASE WHEN a.id < b.id THEN a.k1 ELSE b.k1 END AS k1_a, CASE WHEN a.id < b.id THEN b.k1 ELSE a.k1 END AS k1_b
  FROM {node_base} x JOIN {node_base} a ON a.industry_id = x.industry_id AND a.id = x.parent_id
  JOIN {node_base} b ON b.industry_id = x.industry_id AND b.level = 2 AND b.name = 'Brand#' || cast((x.partkey * 7 + x.k1) % 25 + 1 AS string)
  WHERE x.level = 3 AND (a.k1 IN (3, 4)) <> (b.k1 IN (3, 4))
) t
"""

DEFINITIONS["decisions"] = """
SELECT industry_id, row_pos AS pos, pair_id, node_a_id, node_b_id,
       CASE WHEN h <= '5' THEN 'A_TO_B' WHEN h <= 'a' THEN 'B_TO_A' WHEN h <= 'e' THEN 'NO' ELSE 'INVALID' END AS verdict,
       CASE WHEN g <= '7' THEN 'cache' WHEN h = 'f' THEN 'invalid_after_retry' ELSE 'model_batch' END AS decision_source,
       sha2('key ' || pair_id, 256) AS cache_key,
       CASE WHEN g = 'c' THEN 'deterministic_negative_audit' ELSE node_a_id || ':branch_diversity;' || node_b_id || ':global_similarity' END AS selection_reasons
FROM (SELECT p.*, substr(sha2(pair_id, 256), 1, 1) AS h, substr(sha2(pair_id, 256), 2, 1) AS g, cast(ascii(substr(pair_id, 3, 1)) AS bigint) AS row_pos FROM {pair_base} p) t
"""

DEFINITIONS["pair_rows"] = """
SELECT industry_id, pair_id, node_a_id, node_b_id,
       CASE WHEN k1_a <= 2 OR k1_b >= 5 THEN 'A_TO_B' ELSE 'B_TO_A' END AS allowed_verdicts,
       CASE WHEN substr(sha2(pair_id, 256), 2, 1) = 'c' THEN 'deterministic_negative_audit'
            ELSE node_a_id || ':branch_diversity;' || node_b_id || ':global_similarity' END AS selection_reasons
FROM {pair_base}
"""

DEFINITIONS["l2_base"] = """
SELECT d.industry_id, d.pair_id, d.node_a_id AS source, d.node_b_id AS target, a.source_urls, a.evidence_ids, a.name AS source_name, b.name AS target_name,
       round(cast(60 + ascii(substr(d.pair_id, 4, 1)) % 40 AS double) / 100, 2) AS confidence,
       cast(1 + ascii(substr(d.pair_id, 5, 1)) % 3 AS double) AS relation_weight, ascii(substr(d.pair_id, 6, 1)) * 16 + ascii(substr(d.pair_id, 7, 1)) AS v
FROM {decisions} d JOIN {pair_base} p ON p.industry_id = d.industry_id AND p.pair_id = d.pair_id
JOIN {node_base} a ON a.industry_id = d.industry_id AND a.id = d.node_a_id
JOIN {node_base} b ON b.industry_id = d.industry_id AND b.id = d.node_b_id
WHERE d.verdict = 'A_TO_B' AND (p.k1_a <= 2 OR p.k1_b >= 5)
"""

DEFINITIONS["l2_edges"] = """
SELECT industry_id, cast(v AS bigint) AS pos, source || '__upstream_downstream__' || target AS id, source, target, 'upstream_downstream' AS relation_type,
       'l2_flow' AS relation_layer, relation_weight, source_name || ' feeds ' || target_name AS description, source_urls, evidence_ids, confidence,
       'endpoint_graph_sources_and_pairwise_model_decision' AS evidence_basis, pair_id AS decision_pair_id, '2024-05-01' AS updated_at
FROM {l2_base}
"""

DEFINITIONS["loose_l2_edges"] = """
SELECT industry_id, cast(v AS bigint) * 10 + copy AS pos, CASE WHEN v % 19 = 1 THEN '' ELSE source || '__upstream_downstream__' || target END AS id,
       CASE WHEN v % 23 = 1 THEN target WHEN copy = 2 THEN target ELSE source END AS source,
       CASE WHEN v % 29 = 1 THEN target || '_x' WHEN copy = 2 THEN source WHEN v % 31 = 1 THEN industry_id || '_003' ELSE target END AS target,
       CASE WHEN v % 37 = 1 THEN 'contains' ELSE 'upstream_downstream' END AS relation_type, CASE WHEN v % 13 = 1 THEN 'main' ELSE 'l2_flow' END AS relation_layer,
       relation_weight, CASE WHEN v % 22 = 1 THEN '\u2003' WHEN v % 11 = 1 THEN ' ' ELSE source_name || ' feeds ' || target_name END AS description,
       CASE WHEN v % 7 = 1 THEN '' WHEN v % 17 = 1 THEN 'ftp://src.example.org/x' ELSE source_urls END AS source_urls, evidence_ids,
       CASE WHEN v % 5 = 1 THEN cast(0.4 AS double) WHEN v % 9 = 1 THEN cast(1.2 AS double) ELSE confidence END AS confidence,
       'endpoint_graph_sources_and_pairwise_model_decision' AS evidence_basis,
       CASE WHEN v % 15 = 1 THEN '' WHEN v % 21 = 1 THEN 'p_none' ELSE pair_id END AS decision_pair_id, '2024-05-01' AS updated_at
FROM (SELECT b.*, 0 AS copy FROM {l2_base} b UNION ALL SELECT b.*, 1 AS copy FROM {l2_base} b WHERE v % 10 = 3 UNION ALL SELECT b.*, 2 AS copy FROM {l2_base} b WHERE v % 10 = 4) t
"""

DEFINITIONS["loose_decisions"] = """
SELECT industry_id, pos * 10 + copy AS pos, CASE WHEN v % 25 = 2 THEN '' ELSE pair_id END AS pair_id,
       CASE WHEN v % 27 = 2 THEN node_b_id ELSE node_a_id END AS node_a_id,
       CASE WHEN v % 33 = 2 THEN node_b_id || '_001' WHEN v % 35 = 2 THEN substr(node_a_id, 1, length(node_a_id) - 3) || '001' ELSE node_b_id END AS node_b_id,
       CASE WHEN copy = 1 THEN 'NO' ELSE lower(verdict) END AS verdict, selection_reasons
FROM (SELECT d.*, ascii(substr(pair_id, 8, 1)) * 16 + ascii(substr(pair_id, 9, 1)) AS v, 0 AS copy FROM {decisions} d
      UNION ALL
      SELECT d.*, ascii(substr(pair_id, 8, 1)) * 16 + ascii(substr(pair_id, 9, 1)) AS v, 1 AS copy FROM {decisions} d
      WHERE (ascii(substr(pair_id, 8, 1)) * 16 + ascii(substr(pair_id, 9, 1))) % 10 = 6) t
"""

DEFINITIONS["evaluated"] = """
SELECT industry_id, CASE WHEN k2 % 9 = 1 THEN parent_id ELSE id END AS node_id FROM {node_base} WHERE level = 2
"""

DEFINITIONS["decision_cache"] = """
SELECT pos + copy AS pos, CASE WHEN g = '3' THEN '' ELSE cache_key END AS cache_key, pair_id, node_a_id, node_b_id,
       CASE WHEN copy = 0 THEN 'NO' WHEN g = '5' THEN 'MAYBE' WHEN verdict = 'INVALID' THEN 'NO' ELSE verdict END AS verdict, 'older-model' AS model,
       cast(0.1 AS double) AS temperature, '2024-01-01' AS updated_at
FROM (SELECT d.*, substr(sha2(pair_id, 256), 2, 1) AS g, 0 AS copy FROM {decisions} d UNION ALL SELECT d.*, substr(sha2(pair_id, 256), 2, 1) AS g, 1 AS copy FROM {decisions} d) t
WHERE g <= '7'
"""

DEFINITIONS["verdict_lines"] = """
SELECT industry_id, node_a_id AS batch_id, pair_id,
       CASE WHEN h = '0' THEN '- ' || pair_id || ' maybe'
            WHEN h = '1' THEN pair_id || ':' || verdict || chr(10) || upper(pair_id) || ' : no'
            WHEN h = '2' THEN '``' || '`' || chr(10) || '  ' || pair_id || ' : ' || lower(verdict) || '  '
            WHEN h = '3' THEN pair_id || ':YES'
            WHEN h = '4' THEN '\u3000' || pair_id || ':\u2003' || verdict WHEN h = '5' THEN 'none\u2028' || pair_id || ':' || verdict
            WHEN h = '6' THEN pair_id || ':' || verdict || '\x0b' || 'p_0123456789abcdef:NO'
            ELSE pair_id || ':' || verdict END AS line
FROM (SELECT d.*, substr(pair_id, 10, 1) AS h FROM {decisions} d) t
"""

# --- events as proposals and repairs ---------------------------------------------------------
DEFINITIONS["event_targets"] = """
SELECT e.event_id, e.event_type, e.value, n.industry_id, n.id AS node_id, n.parent_id, n.k1, n.k2, n.k3
FROM {events} e JOIN {parts} p ON p.p_partkey = cast(floor(e.event_id / 5) AS bigint)
JOIN {leaf_keys} k ON k.industry_id = p.industry_id AND k.k1 = p.k1 AND k.p_brand = p.p_brand AND k.p_name = p.p_name
JOIN {node_base} n ON n.industry_id = k.industry_id AND n.partkey = k.partkey AND n.level = 3
"""

DEFINITIONS["branch_records"] = """
SELECT industry_id, id AS branch_id, name AS branch_name, pos, CASE WHEN k1 = 2 AND industry_id LIKE 'pro%' THEN 'error' ELSE 'ok' END AS status,
       NOT (k1 = 5 AND industry_id LIKE 'med%') AS has_graph
FROM {node_base} WHERE level = 1
UNION ALL
SELECT industry_id, industry_id || '_099', 'gone branch', cast(99000000000000 AS bigint), 'error', false FROM {node_base} WHERE level = 0 AND industry_id LIKE 'lar%'
"""

# records of the work list: every industry has a branch that the graph does not know
DEFINITIONS["work_records"] = DEFINITIONS["branch_records"].replace(" AND industry_id LIKE 'lar%'", "")

DEFINITIONS["opinion_records"] = """
SELECT industry_id, CASE WHEN level = 0 THEN 'level1_skeleton' ELSE 'branch' END AS stage, CASE WHEN level = 0 THEN cast(NULL AS string) ELSE id END AS branch_id,
       CASE WHEN level = 0 THEN cast(NULL AS string) ELSE name END AS branch_name,
       CASE WHEN k1 = 1 THEN '' WHEN k1 % 2 = 0 THEN 'pass' ELSE 'needs_revision' END AS status, cast(60 + k1 * 6 AS string) AS score,
       '' AS blocking, CASE WHEN k1 = 4 THEN 'width' ELSE '' END AS focus, k1 % 2 = 1 AS revised,
       CASE WHEN k1 IN (1, 3) THEN 'Pass' ELSE cast(NULL AS string) END AS post_status, CASE WHEN k1 = 1 THEN '92' WHEN k1 = 3 THEN 'high' ELSE cast(NULL AS string) END AS post_score,
       '' AS post_blocking, '' AS post_focus
FROM {node_base} WHERE level <= 1
"""

# staged graphs: the seed (0) holds L0 and L1, graph k1 holds one branch with its L1 row again
DEFINITIONS["staged_nodes"] = """
SELECT industry_id, graph_no, pos, id, CASE WHEN graph_no > 0 AND level = 1 AND k1 = 6 THEN name || ' (renamed)' ELSE name END AS name, level, chain_position, parent_id,
       description, CASE WHEN graph_no > 0 AND level = 1 THEN source_urls || ';https://branch.example.org/' || id ELSE source_urls END AS source_urls, evidence_ids,
       CASE WHEN graph_no > 0 THEN confidence ELSE round(confidence / 2, 3) END AS confidence
FROM (SELECT b.*, 0 AS graph_no FROM {node_base} b WHERE level <= 1 UNION ALL SELECT b.*, k1 AS graph_no FROM {node_base} b WHERE level >= 1) t
"""

DEFINITIONS["legacy_nodes"] = """
SELECT n.industry_id, n.id || '_' || cast(p.p_partkey AS string) AS id, n.id AS parent_id, p.p_partkey
FROM {parts} p JOIN {leaf_keys} k ON k.industry_id = p.industry_id AND k.k1 = p.k1 AND k.p_brand = p.p_brand AND k.p_name = p.p_name
JOIN {node_base} n ON n.industry_id = k.industry_id AND n.partkey = k.partkey AND n.level = 3
"""

LISTS: dict[str, tuple[str, ...]] = {
    "nodes": ("tags", "source_urls", "evidence_ids"),
    "edges": ("source_urls", "evidence_ids"),
    "formal_nodes": ("tags", "source_urls", "evidence_ids"),
    "formal_edges": ("source_urls", "evidence_ids"),
    "raw_nodes": ("tags", "source_urls", "evidence_ids"),
    "raw_edges": ("source_urls", "evidence_ids"),
    "decisions": ("selection_reasons",),
    "loose_decisions": ("selection_reasons",),
    "pair_rows": ("allowed_verdicts", "selection_reasons"),
    "l2_edges": ("source_urls", "evidence_ids"),
    "loose_l2_edges": ("source_urls", "evidence_ids"),
    "opinion_records": ("blocking", "focus", "post_blocking", "post_focus"),
    "staged_nodes": ("source_urls", "evidence_ids"),
}

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)
