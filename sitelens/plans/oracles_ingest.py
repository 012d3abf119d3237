"""DuckDB twins of the ingest fixtures and operators."""

from __future__ import annotations

from sitelens.plans import fixtures as FX
from sitelens.plans.oracles import AS_OF_SQL, lit, strip_ws


def arr(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def import_batch_cte() -> str:
    plat = f"{arr(FX.IMPORT_PLATFORMS)}[page_id % 5 + 1]"
    ind = f"{arr(FX.IMPORT_INDUSTRIES)}[page_id % 3 + 1]"
    return f"""ib0 AS (
  SELECT CAST(page_id + 2 AS BIGINT) AS row_no, page_id,
    CASE WHEN page_id % 11 = 0 THEN '  '
         WHEN page_id % 13 = 0 THEN regexp_replace(url, '^https?://', '')
         ELSE url END AS website_url,
    {plat} AS platform, {ind} AS industry, 'alpha, beta' AS tags,
    CASE WHEN page_id % 17 = 0 THEN '["broken' ELSE '["' || {plat} || '"]' END AS platforms,
    CASE WHEN page_id % 4 = 0 THEN '[]' ELSE '["' || {ind} || '"]' END AS industries,
    '{{"primary": "#aabbcc", "secondary": null}}' AS colors,
    '{{"alpha": 0.9, "beta": 0.4}}' AS tag_confidence,
    '{{"platform_scores": {{"' || {plat} || '": 1.0}}, "industry_scores": {{}}, "colors": {{"primary": "#aabbcc", "secondary": null}}}}' AS enrichment_signals,
    CASE WHEN page_id % 19 = 0 THEN 'not-a-time'
         ELSE '2001-12-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || 'T10:00:00Z' END
      AS last_enriched_at
  FROM pages),
import_batch AS (
  SELECT * FROM ib0 UNION ALL
  SELECT * REPLACE (row_no + {FX.REPEAT_ROW_OFFSET} AS row_no, '["' || platform || '"]' AS platforms)
  FROM ib0 WHERE page_id % 7 = 0)"""


def import_target_cte() -> str:
    return f"""import_target AS (
  SELECT page_id AS id, url AS website_url, 'Legacy' AS platform, 'Legacy' AS industry, 'old' AS tags,
    ['Legacy'] AS platforms, ['Legacy'] AS industries, CAST(page_id AS DOUBLE) / 10.0 AS heat_score,
    MAP {{'owner': 'import-test'}} AS site_metadata, {AS_OF_SQL} - INTERVAL 100 DAY AS created_at,
    {AS_OF_SQL} - to_days(CAST(page_id % 50 AS INTEGER)) AS last_used_at
  FROM pages WHERE page_id % 3 = 0)"""


def feedback_cte() -> str:
    return f"""feedback AS (
  SELECT page_id AS feedback_id,
    CASE WHEN page_id % 20 = 0 THEN url || '/unknown' ELSE ' ' || url END AS website_url,
    CASE WHEN page_id % 35 = 0 THEN '   ' ELSE 'tag' || CAST(page_id AS VARCHAR) || ', extra ' END
      AS suggested_tags,
    {AS_OF_SQL} + to_seconds(page_id) AS created_at
  FROM pages)"""


def url_requests_cte() -> str:
    bare = "regexp_replace(url, '^https?://', '')"
    return f"""url_requests AS (
  SELECT CAST(page_id + 2 AS BIGINT) AS row_no, page_id,
    CASE page_id % 6 WHEN 1 THEN '  ' || url || ' ' WHEN 2 THEN {bare}
      WHEN 3 THEN 'HTTP://' || {bare} WHEN 4 THEN 'ftp://' || {bare}
      WHEN 5 THEN url || '/' || repeat('a', 2048) ELSE url END AS url
  FROM pages)"""


def decode_array(x: str) -> str:
    parsed = f"CASE WHEN json_valid({x}) THEN TRY_CAST(json({x}) AS VARCHAR[]) END"
    return (f"CASE WHEN {x} IS NULL OR length({strip_ws(x)}) = 0 THEN NULL "
            f"WHEN len({parsed}) > 0 THEN {parsed} END")


def decode_map(x: str) -> str:
    parsed = f"CASE WHEN json_valid({x}) THEN TRY_CAST(json({x}) AS MAP(VARCHAR, DOUBLE)) END"
    return (f"CASE WHEN {x} IS NULL OR length({strip_ws(x)}) = 0 THEN NULL "
            f"WHEN cardinality({parsed}) > 0 THEN {parsed} END")


def parse_ts(x: str) -> str:
    return f"(TRY_CAST({strip_ws(x)} AS TIMESTAMPTZ) AT TIME ZONE 'UTC')"
