"""Registered queries beyond search (enrichment, heat, ingest, streams)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.operators import enrich as E
from sitelens.plans import fixtures as FX
from sitelens.plans import oracles_enrich as OE
from sitelens.plans.registry import register


def labels_str(arr):
    """'label:micro-units|...' -- confidences as exact integers, '' for none."""
    return F.coalesce(F.array_join(F.transform(arr, lambda x: F.concat(
        x["label"], F.lit(":"),
        F.floor(x["confidence"] * F.lit(1e6) + F.lit(0.5)).cast("long").cast("string"))), "|"),
        F.lit(""))


def display_sql(arr: str) -> str:
    return (f"CASE WHEN len({arr}) > 0 THEN array_to_string(list_transform(({arr})[1:3], "
            f"lambda x: x.label), ', ') ELSE 'Unknown' END")


# ---------------------------------------------------------------------------
# enrichment
# ---------------------------------------------------------------------------

@register("detect_platforms", f"""WITH {OE.pages_seeded_cte()},
a AS (SELECT page_id, html, {OE.platform_items('html')} AS _pi FROM pages_seeded),
b AS (SELECT page_id, {OE.platforms_from_items('html', '_pi')} AS _p FROM a)
SELECT page_id, {OE.labels_str('_p')} AS platforms, coalesce(len(_p), 0) AS n_platforms FROM b""")
def q_detect_platforms(spark, sf_dir):
    p = FX.pages_seeded(spark, sf_dir)
    d = E.detect_platforms(p, "html", "_p")
    return d.select("page_id", labels_str(F.col("_p")).alias("platforms"),
                    F.size("_p").alias("n_platforms"))


@register("detect_industries", f"""WITH {OE.documents_seeded_cte()},
a AS (SELECT doc_id, {OE.industry_items(OE.clean_text('text'))} AS _ii FROM documents_seeded),
b AS (SELECT doc_id, {OE.industries_from_items('_ii')} AS _i FROM a)
SELECT doc_id, {OE.labels_str('_i')} AS industries, coalesce(len(_i), 0) AS n_industries FROM b""")
def q_detect_industries(spark, sf_dir):
    d = FX.documents_seeded(spark, sf_dir)
    out = E.detect_industries(d.select("doc_id", "text"), "text", out="_i")
    return out.select("doc_id", labels_str(F.col("_i")).alias("industries"),
                      F.size("_i").alias("n_industries"))


@register("extract_tags", f"""WITH {OE.documents_seeded_cte()},
{OE.tags_sql('documents_seeded', 'doc_id', 'text')}
SELECT doc_id, rank, tag, freq, confidence FROM tag_rows""")
def q_extract_tags(spark, sf_dir):
    d = FX.documents_seeded(spark, sf_dir)
    return E.extract_tags(d, "doc_id", "text")


@register("extract_colors", f"""WITH {OE.pages_seeded_cte()},
a AS (SELECT page_id, list_transform({OE.colors_sql('html')}, lambda v: {OE.normalize_hex("'#' || v")})
        AS _raw FROM pages_seeded),
b AS (SELECT page_id, {OE.distinct_keep_order('_raw')} AS _c FROM a)
SELECT page_id, _c[1] AS primary_color, _c[2] AS secondary_color FROM b""")
def q_extract_colors(spark, sf_dir):
    p = FX.pages_seeded(spark, sf_dir)
    c = E.with_colors(p, "html", "c")
    return c.select("page_id", F.col("c.primary").alias("primary_color"),
                    F.col("c.secondary").alias("secondary_color"))


@register("page_text", f"""WITH {OE.pages_seeded_cte()}
SELECT page_id, {OE.page_text('html')} AS text FROM pages_seeded""")
def q_page_text(spark, sf_dir):
    p = FX.pages_seeded(spark, sf_dir)
    return E.with_page_text(p, "html", "text").select("page_id", "text")


def enrich_ctes(src: str, key: str, url: str = "url", html: str = "html") -> str:
    """CTE chain ending in ``enriched`` (flat enrichment record per row of ``src``)."""
    return f"""ebase AS (SELECT {key}, {url} AS website_url, {html} AS _h, {OE.page_text(html)} AS _text
         FROM {src}),
elab AS (SELECT {key}, website_url, _h, {OE.platform_items('_h')} AS _pi,
               {OE.industry_items(OE.clean_text('_text'))} AS _ii,
               list_transform({OE.colors_sql('_h')}, lambda v: {OE.normalize_hex("'#' || v")}) AS _raw
        FROM ebase),
elab2 AS (SELECT {key}, website_url, {OE.platforms_from_items('_h', '_pi')} AS _p,
                {OE.industries_from_items('_ii')} AS _i, {OE.distinct_keep_order('_raw')} AS _c
         FROM elab),
{OE.tags_sql('ebase', key, '_text')},
packed AS (
  SELECT {key}, string_agg(tag, ', ' ORDER BY rank) AS tags,
         string_agg(tag || ':' || CAST(CAST(floor(confidence * 1e6 + 0.5) AS BIGINT) AS VARCHAR), '|'
                    ORDER BY rank) AS tag_conf
  FROM tag_rows GROUP BY {key}),
enriched AS (
  SELECT elab2.{key}, website_url, {display_sql('_p')} AS platform, {display_sql('_i')} AS industry,
    coalesce(tags, '') AS tags, {OE.labels_str('_p')} AS platform_scores,
    {OE.labels_str('_i')} AS industry_scores, _c[1] AS primary_color, _c[2] AS secondary_color,
    coalesce(tag_conf, '') AS tag_conf
  FROM elab2 LEFT JOIN packed ON packed.{key} = elab2.{key})"""


ENRICH_SQL = f"""WITH {OE.pages_seeded_cte()}, {enrich_ctes('pages_seeded', 'page_id')}
SELECT * FROM enriched"""


def flat_enrichment(rec):
    """Flat, hashable view of an ``enrich_pages`` record."""
    def entries(m):
        return F.map_entries(m)
    tag_conf = F.coalesce(F.array_join(F.transform(entries(F.col("tag_confidence")), lambda e: F.concat(
        e["key"], F.lit(":"),
        F.floor(e["value"] * F.lit(1e6) + F.lit(0.5)).cast("long").cast("string"))), "|"), F.lit(""))
    ps = F.transform(entries(F.col("enrichment_signals.platform_scores")),
                     lambda e: F.struct(e["key"].alias("label"), e["value"].alias("confidence")))
    inds = F.transform(entries(F.col("enrichment_signals.industry_scores")),
                       lambda e: F.struct(e["key"].alias("label"), e["value"].alias("confidence")))
    return rec.select("page_id", "website_url", "platform", "industry", "tags",
                      labels_str(ps).alias("platform_scores"), labels_str(inds).alias("industry_scores"),
                      F.col("colors.primary").alias("primary_color"),
                      F.col("colors.secondary").alias("secondary_color"),
                      tag_conf.alias("tag_conf"))


@register("enrich_pages", ENRICH_SQL)
def q_enrich_pages(spark, sf_dir):
    p = FX.pages_seeded(spark, sf_dir)
    return flat_enrichment(E.enrich_pages(p, as_of=FX.AS_OF))


# ---------------------------------------------------------------------------
# heat and usage
# ---------------------------------------------------------------------------

from sitelens.functions.numeric import py_round_sql  # noqa: E402
from sitelens.operators import heat as H  # noqa: E402
from sitelens.operators import suggest as SG  # noqa: E402
from sitelens.plans import oracles as O  # noqa: E402
from sitelens.plans.registry import _r6  # noqa: E402


def _pct_sql(num: str, den: str) -> str:
    ratio = f"(CAST({num} AS DOUBLE) / CAST(nullif({den}, 0) AS DOUBLE))"
    return py_round_sql(f"{ratio} * 100.0", 1)


@register("heat_report", f"""WITH {O.sites_cte()},
a AS (SELECT count(*) AS total,
        count(*) FILTER (WHERE heat_score > 0 OR heat_score < 0) AS seeded,
        count(*) FILTER (WHERE heat_score >= 70) AS hot,
        count(*) FILTER (WHERE heat_score >= 30 AND heat_score < 70) AS warm,
        count(*) FILTER (WHERE heat_score >= 0 AND heat_score < 30) AS cold FROM sites)
SELECT *, {_pct_sql('seeded', 'total')} AS seeded_pct, {_pct_sql('hot', 'seeded')} AS hot_pct,
  {_pct_sql('warm', 'seeded')} AS warm_pct, {_pct_sql('cold', 'seeded')} AS cold_pct FROM a""")
def q_heat_report(spark, sf_dir):
    return H.heat_report(FX.sites(spark, sf_dir))


@register("heat_top", f"""WITH {O.sites_cte()}
SELECT CAST(row_number() OVER (ORDER BY heat_score DESC, id) AS BIGINT) AS rank, id, website_url,
  heat_score, {O.days_between(O.AS_OF_SQL, 'last_used_at')} AS days_since_use
FROM sites WHERE heat_score > 0 ORDER BY heat_score DESC, id LIMIT 5""")
def q_heat_top(spark, sf_dir):
    return H.heat_top(FX.sites(spark, sf_dir), 5, as_of=FX.AS_OF)


@register("usage_rollup", f"""WITH {O.sites_cte(with_usage=False)},
u AS (SELECT l_partkey AS sid, max(l_shipdate) AS ts, sum(l_quantity) AS amt, count(*) AS n
      FROM lineitem GROUP BY l_partkey)
SELECT id, greatest(last_used_at, u.ts) AS last_used_at,
  {O.r6('CASE WHEN u.n IS NOT NULL THEN coalesce(heat_score, 0.0) + u.amt ELSE heat_score END')}
    AS heat_score
FROM sites LEFT JOIN u ON u.sid = sites.id""")
def q_usage_rollup(spark, sf_dir):
    sites = FX.sites(spark, sf_dir, with_usage=False)
    usage = FX.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("site_id"), F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("amount"))
    out = H.apply_usage(sites, usage)
    return out.select("id", "last_used_at", _r6(F.col("heat_score")).alias("heat_score"))


@register("quota_buckets", f"""WITH {O.sites_cte(with_usage=False)},
c AS (SELECT id FROM sites WHERE heat_score IS NULL OR heat_score = 0),
n AS (SELECT count(*) AS total FROM c),
p AS (SELECT id, CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS pos FROM c)
SELECT id, pos, CASE WHEN pos <= greatest(1, floor(total * 0.2)) THEN 'hot'
  WHEN pos <= greatest(1, floor(total * 0.2)) + greatest(1, floor(total * 0.5)) THEN 'warm'
  ELSE 'cold' END AS bucket FROM p, n""")
def q_quota_buckets(spark, sf_dir):
    return H.quota_buckets(FX.sites(spark, sf_dir, with_usage=False))


@register("rollback_marked", f"""WITH {O.sites_cte()},
r AS (SELECT id,
  CASE WHEN site_metadata['seeded_at'] IS NOT NULL THEN 0.0 ELSE heat_score END AS heat_score,
  CASE WHEN site_metadata['seeded_at'] IS NOT NULL THEN NULL ELSE last_used_at END AS last_used_at,
  CASE WHEN site_metadata['seeded_at'] IS NOT NULL
       THEN list_filter(map_keys(site_metadata), lambda k: k <> 'seeded_at')
       ELSE map_keys(site_metadata) END AS _keys FROM sites)
SELECT id, heat_score, last_used_at, array_to_string(list_sort(_keys), ',') AS meta_keys FROM r""")
def q_rollback_marked(spark, sf_dir):
    out = H.rollback_marked(FX.sites(spark, sf_dir))
    return out.select("id", "heat_score", "last_used_at",
                      F.array_join(F.array_sort(F.map_keys("site_metadata")), ",").alias("meta_keys"))


@register("stale_sites", f"""WITH {O.sites_cte(with_usage=False)}
SELECT id, last_enriched_at, {O.days_between(O.AS_OF_SQL, 'last_enriched_at')} AS days_since
FROM sites WHERE last_enriched_at IS NULL
  OR {O.days_between(O.AS_OF_SQL, 'last_enriched_at')} >= 30""")
def q_stale_sites(spark, sf_dir):
    out = H.stale_sites(FX.sites(spark, sf_dir, with_usage=False), as_of=FX.AS_OF)
    from sitelens.functions import days_between
    return out.select("id", "last_enriched_at",
                      days_between(FX.as_of_col(), F.col("last_enriched_at")).alias("days_since"))


# ---------------------------------------------------------------------------
# suggestions
# ---------------------------------------------------------------------------

VALUES_SQL = f"""vals AS (
  SELECT unnest(list_concat(list_concat(coalesce(platforms, []::VARCHAR[]), coalesce(industries, []::VARCHAR[])),
    list_filter(list_transform(string_split(coalesce(tags, ''), ','), lambda t: {O.strip_ws('t')}),
                lambda t: length(t) > 0))) AS value FROM sites)"""
SUGGEST_PARTIAL = "re"
SUGGEST_PREFIXES = ["re", "wi", "eco", "x", "Brand#1", "sm", "al", "g"]


@register("suggest", f"""WITH {O.sites_cte(with_usage=False)}, {VALUES_SQL},
c AS (SELECT value, count(*) AS n FROM vals WHERE contains({O.norm('value')}, '{SUGGEST_PARTIAL}')
      GROUP BY value)
SELECT CAST(row_number() OVER (ORDER BY n DESC, value) AS BIGINT) AS rank, value, n FROM c
ORDER BY n DESC, value LIMIT 5""")
def q_suggest(spark, sf_dir):
    return SG.suggest(FX.sites(spark, sf_dir, with_usage=False), SUGGEST_PARTIAL)


def _prefixes_sql() -> str:
    rows = ", ".join(f"({O.lit(p)})" for p in SUGGEST_PREFIXES)
    return f"prefixes AS (SELECT * FROM (VALUES {rows}) AS t(prefix))"


@register("suggest_batch", f"""WITH {O.sites_cte(with_usage=False)}, {VALUES_SQL}, {_prefixes_sql()},
c AS (SELECT value, count(*) AS n, {O.norm('value')} AS vn FROM vals GROUP BY value),
m AS (SELECT prefix, value, n, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, value) AS rank
      FROM c, prefixes WHERE length({O.norm('prefix')}) >= 2 AND contains(vn, {O.norm('prefix')}))
SELECT prefix, CAST(rank AS BIGINT) AS rank, value, n FROM m WHERE rank <= 5""")
def q_suggest_batch(spark, sf_dir):
    prefixes = spark.createDataFrame([(p,) for p in SUGGEST_PREFIXES], "prefix string")
    return SG.suggest_batch(FX.sites(spark, sf_dir, with_usage=False), prefixes)


@register("seed_rollback", f"""WITH {O.sites_cte()},
r AS (SELECT id,
  CASE WHEN heat_score IS NULL OR heat_score = 0 OR site_metadata['seeded_at'] IS NOT NULL
       THEN 0.0 ELSE heat_score END AS heat_score,
  CASE WHEN heat_score IS NULL OR heat_score = 0 OR site_metadata['seeded_at'] IS NOT NULL
       THEN NULL ELSE last_used_at END AS last_used_at,
  list_filter(map_keys(site_metadata), lambda k: k <> 'seeded_at') AS _keys FROM sites)
SELECT id, heat_score, last_used_at, array_to_string(list_sort(_keys), ',') AS meta_keys FROM r""")
def q_seed_rollback(spark, sf_dir):
    sites = FX.sites(spark, sf_dir)
    out = H.rollback_marked(H.mark_buckets(sites, H.quota_buckets(sites, seed=7), as_of=FX.AS_OF))
    return out.select("id", "heat_score", "last_used_at",
                      F.array_join(F.array_sort(F.map_keys("site_metadata")), ",").alias("meta_keys"))
