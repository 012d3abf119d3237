"""Registered queries of the ingest operators and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens import functions as SF
from sitelens.operators import ingest as I
from sitelens.plans import fixtures as FX
from sitelens.plans import oracles as O
from sitelens.plans import oracles_enrich as OE
from sitelens.plans import oracles_ingest as OI
from sitelens.plans.registry import register
from sitelens.plans.registry_more import enrich_ctes, flat_enrichment


def micro(c):
    return F.floor(c * F.lit(1e6) + F.lit(0.5)).cast("long").cast("string")


def map_str(m):
    """'key:micro|...' sorted by key; NULL map -> ''."""
    return F.coalesce(F.array_join(F.array_sort(F.transform(
        F.map_entries(m), lambda e: F.concat(e["key"], F.lit(":"), micro(e["value"])))), "|"), F.lit(""))


def arr_str(a):
    return F.coalesce(F.array_join(a, "|"), F.lit(""))


MAP_STR_SQL = ("coalesce(array_to_string(list_sort(list_transform(map_entries({m}), lambda e: e.key || ':' "
               "|| CAST(CAST(floor(e.value * 1e6 + 0.5) AS BIGINT) AS VARCHAR))), '|'), '')")


def map_str_sql(m: str) -> str:
    return MAP_STR_SQL.format(m=m)


def arr_str_sql(a: str) -> str:
    return f"coalesce(array_to_string({a}, '|'), '')"


JSON_COLS = ["platforms", "industries", "colors", "tag_confidence", "enrichment_signals"]


def _json_error_sql() -> str:
    parts = " ".join(
        f"WHEN NOT ({c} IS NULL OR length({O.strip_ws(c)}) = 0 OR json_valid({c})) "
        f"THEN 'Invalid JSON in {c}'" for c in JSON_COLS)
    return f"CASE {parts} END"


def _classify_sql(mode: str, batch: str = "import_batch") -> str:
    jerr = _json_error_sql() if mode == "upload" else "NULL"
    return f"""b AS (SELECT *, {O.strip_ws("coalesce(website_url, '')")} AS _url, {jerr} AS _jerr FROM {batch}),
chosen AS (SELECT _url, min(row_no) FILTER (WHERE _jerr IS NULL) AS _chosen FROM b WHERE length(_url) > 0 GROUP BY _url),
ex AS (SELECT DISTINCT website_url AS _url, true AS _exists FROM import_target
       WHERE website_url IS NOT NULL),
j AS (SELECT b.*, chosen._chosen, coalesce(ex._exists, false) AS _ex
      FROM b LEFT JOIN chosen USING (_url) LEFT JOIN ex USING (_url))"""


def _report_sql(mode: str) -> str:
    skip = "'error'" if mode == "upload" else "'skipped'"
    dup_msg = "'Site already exists'" if mode == "upload" else "'Duplicate in batch'"
    return f"""report AS (SELECT row_no, _url AS website_url,
  CASE WHEN length(_url) = 0 THEN 'error' WHEN _ex THEN {skip} WHEN row_no > _chosen THEN {skip}
       WHEN _jerr IS NOT NULL THEN 'error' ELSE 'inserted' END AS outcome,
  CASE WHEN length(_url) = 0 THEN 'Empty URL' WHEN _ex THEN 'Site already exists'
       WHEN row_no > _chosen THEN {dup_msg} ELSE _jerr END AS error
  FROM j)"""


def _head(mode: str = "bulk", batch: str = "import_batch", more: str = "") -> str:
    return f"WITH {OI.import_batch_cte()}, {OI.import_target_cte()}, {more}{_classify_sql(mode, batch)}"


HEAD = _head()


def _batch_and_target(spark, sf_dir):
    return FX.import_target(spark, sf_dir), FX.import_batch(spark, sf_dir)


@register("import_report", f"""{HEAD}, {_report_sql('bulk')}
SELECT row_no, website_url, outcome, error FROM report""")
def q_import_report(spark, sf_dir):
    t, b = _batch_and_target(spark, sf_dir)
    return I.import_enriched(t, b, mode="bulk", as_of=FX.AS_OF)[1]


@register("import_upload_report", f"""{_head('upload')}, {_report_sql('upload')}
SELECT row_no, website_url, outcome, error FROM report""")
def q_import_upload_report(spark, sf_dir):
    t, b = _batch_and_target(spark, sf_dir)
    return I.import_enriched(t, b, mode="upload", as_of=FX.AS_OF)[1]


@register("import_stats", f"""{HEAD}, {_report_sql('bulk')}
SELECT count(*) FILTER (WHERE outcome = 'inserted') AS imported,
  count(*) FILTER (WHERE outcome = 'skipped') AS skipped,
  count(*) FILTER (WHERE outcome = 'error') AS errors, count(*) AS total FROM report""")
def q_import_stats(spark, sf_dir):
    t, b = _batch_and_target(spark, sf_dir)
    return I.import_stats(I.import_enriched(t, b, mode="bulk", as_of=FX.AS_OF)[1])


@register("import_errors", f"""{_head('upload')}, {_report_sql('upload')}
SELECT row_no AS row, website_url AS url, error FROM report WHERE outcome = 'error'""")
def q_import_errors(spark, sf_dir):
    t, b = _batch_and_target(spark, sf_dir)
    return I.import_errors(I.import_enriched(t, b, mode="upload", as_of=FX.AS_OF)[1])


@register("import_enriched", f"""{HEAD}, {_report_sql('bulk')},
ins AS (SELECT j.* FROM j JOIN report USING (row_no) WHERE report.outcome = 'inserted')
SELECT _url AS website_url, platform, industry,
  {arr_str_sql(OI.decode_array('platforms'))} AS platforms_s,
  {arr_str_sql(OI.decode_array('industries'))} AS industries_s,
  {map_str_sql(OI.decode_map('tag_confidence'))} AS tag_conf_s,
  {OI.parse_ts('last_enriched_at')} AS last_enriched_at
FROM ins""")
def q_import_enriched(spark, sf_dir):
    t, b = _batch_and_target(spark, sf_dir)
    new_target, report = I.import_enriched(t, b, mode="bulk", as_of=FX.AS_OF)
    new = new_target.join(report.filter(F.col("outcome") == "inserted").select("website_url"),
                          "website_url", "left_semi")
    return new.select("website_url", "platform", "industry",
                      arr_str(F.col("platforms")).alias("platforms_s"),
                      arr_str(F.col("industries")).alias("industries_s"),
                      map_str(F.col("tag_confidence")).alias("tag_conf_s"), "last_enriched_at")


@register("insert_ignore", f"""{HEAD}, {_report_sql('bulk')},
ins AS (SELECT j.* FROM j JOIN report USING (row_no) WHERE report.outcome = 'inserted')
SELECT website_url, platform, heat_score FROM import_target
UNION ALL SELECT _url, platform, NULL FROM ins""")
def q_insert_ignore(spark, sf_dir):
    t, b = _batch_and_target(spark, sf_dir)
    batch = b.select("row_no", "website_url", "platform")
    new_target, _ = I.insert_ignore(t, batch, as_of=FX.AS_OF)
    return new_target.select("website_url", "platform", "heat_score")


@register("upsert_sites", f"""WITH {OI.import_batch_cte()}, {OI.import_target_cte()},
b AS (SELECT *, {O.strip_ws("coalesce(website_url, '')")} AS _url FROM import_batch),
last AS (SELECT _url AS website_url, arg_max(b, row_no) AS r FROM b WHERE length(_url) > 0 GROUP BY _url),
u AS (SELECT coalesce(t.website_url, last.website_url) AS website_url, last.r AS r, t.* EXCLUDE (website_url)
      FROM import_target t FULL OUTER JOIN last ON t.website_url = last.website_url)
SELECT website_url,
  CASE WHEN r IS NOT NULL THEN r.platform ELSE platform END AS platform,
  CASE WHEN r IS NOT NULL THEN r.industry ELSE industry END AS industry,
  heat_score, site_metadata['owner'] AS owner,
  CASE WHEN r IS NOT NULL THEN {arr_str_sql(OI.decode_array('r.platforms'))}
       ELSE {arr_str_sql('platforms')} END AS platforms_s,
  CASE WHEN r IS NOT NULL THEN {O.AS_OF_SQL} END AS last_enriched_at,
  coalesce(created_at, {O.AS_OF_SQL}) AS created_at,
  CASE WHEN r IS NULL THEN NULL WHEN id IS NULL THEN 'inserted' ELSE 'updated' END AS outcome
FROM u""")
def q_upsert_sites(spark, sf_dir):
    t, b = _batch_and_target(spark, sf_dir)
    recs = b.withColumn("platforms", SF.decode_json_array(F.col("platforms"))) \
        .withColumn("industries", SF.decode_json_array(F.col("industries"))) \
        .drop("colors", "tag_confidence", "enrichment_signals", "last_enriched_at")
    new_target, report = I.upsert_sites(t, recs, as_of=FX.AS_OF)
    rep = report.filter("outcome in ('inserted', 'updated')").select("website_url", "outcome")
    out = new_target.join(rep, "website_url", "left")
    return out.select("website_url", "platform", "industry", "heat_score",
                      F.try_element_at("site_metadata", F.lit("owner")).alias("owner"),
                      arr_str(F.col("platforms")).alias("platforms_s"),
                      "last_enriched_at", "created_at", "outcome")


@register("upsert_report", f"""WITH {OI.import_batch_cte()}, {OI.import_target_cte()},
b AS (SELECT row_no, {O.strip_ws("coalesce(website_url, '')")} AS _url FROM import_batch),
n AS (SELECT _url, max(row_no) AS newest FROM b WHERE length(_url) > 0 GROUP BY _url)
SELECT row_no, b._url AS website_url,
  CASE WHEN length(b._url) = 0 THEN 'error' WHEN row_no < newest THEN 'skipped'
       WHEN b._url IN (SELECT website_url FROM import_target) THEN 'updated' ELSE 'inserted' END AS outcome,
  CASE WHEN length(b._url) = 0 THEN 'Empty URL' WHEN row_no < newest THEN 'Duplicate in batch' END AS error
FROM b LEFT JOIN n ON n._url = b._url""")
def q_upsert_report(spark, sf_dir):
    t, b = _batch_and_target(spark, sf_dir)
    return I.upsert_sites(t, b.select("row_no", "website_url", "platform"), as_of=FX.AS_OF)[1]


LIMIT_ROWS = 50


@register("import_limits", f"""{_head(batch='limited', more=f'limited AS (SELECT * FROM import_batch WHERE row_no < {LIMIT_ROWS + 2}), ')},
{_report_sql('bulk')}
SELECT row_no, website_url, outcome, error FROM report
UNION ALL SELECT DISTINCT {LIMIT_ROWS + 2}, '', 'error', 'CSV exceeds 500-row limit' FROM import_batch
WHERE row_no >= {LIMIT_ROWS + 2}""")
def q_import_limits(spark, sf_dir):
    t, b = _batch_and_target(spark, sf_dir)
    return I.import_enriched(t, b, mode="bulk", as_of=FX.AS_OF, max_rows=LIMIT_ROWS)[1]


@register("resolve_feedback", f"""WITH {OI.feedback_cte()}, {OI.import_target_cte()},
f AS (SELECT *, {O.strip_ws("coalesce(website_url, '')")} AS _url,
             {O.strip_ws("coalesce(suggested_tags, '')")} AS _tags FROM feedback)
SELECT CASE WHEN length(_url) > 0 AND length(_tags) > 0 THEN t.id END AS site_id,
  _url AS website_url, _tags AS suggested_tags, f.created_at,
  CASE WHEN length(_url) > 0 AND length(_tags) > 0 THEN 'ok' ELSE 'ignored' END AS status
FROM f LEFT JOIN import_target t ON t.website_url = f._url""")
def q_resolve_feedback(spark, sf_dir):
    return I.resolve_feedback(FX.feedback(spark, sf_dir), FX.import_target(spark, sf_dir))


@register("ensure_columns", """SELECT url AS website_url, CAST(NULL AS VARCHAR) AS platform,
  CAST(NULL AS DOUBLE) AS heat_score, CAST(NULL AS TIMESTAMP) AS last_used_at, 16 AS n_columns
FROM pages""")
def q_ensure_columns(spark, sf_dir):
    narrow = FX.table(spark, sf_dir, "pages").select(F.col("url").alias("website_url"))
    full = I.ensure_columns(I.ensure_columns(narrow))  # idempotent
    return full.select("website_url", "platform", "heat_score", "last_used_at",
                       F.lit(len(full.columns)).alias("n_columns"))


@register("migrate_sites", f"""WITH {OI.import_batch_cte()}
SELECT {O.strip_ws("coalesce(website_url, '')")} AS website_url,
  {arr_str_sql(OI.decode_array('platforms'))} AS platforms_s,
  {arr_str_sql(OI.decode_array('industries'))} AS industries_s,
  {map_str_sql(OI.decode_map('tag_confidence'))} AS tag_conf_s,
  {OI.parse_ts('last_enriched_at')} AS last_enriched_at,
  '2002-01-01T00:00:00Z' AS migrated_at
FROM import_batch WHERE length({O.strip_ws("coalesce(website_url, '')")}) > 0""")
def q_migrate_sites(spark, sf_dir):
    migrated, _ = I.migrate_sites(FX.import_batch(spark, sf_dir), as_of=FX.AS_OF)
    return migrated.select("website_url", arr_str(F.col("platforms")).alias("platforms_s"),
                           arr_str(F.col("industries")).alias("industries_s"),
                           map_str(F.col("tag_confidence")).alias("tag_conf_s"), "last_enriched_at",
                           F.col("site_metadata")["migrated_at"].alias("migrated_at"))


@register("migrate_report", f"""WITH {OI.import_batch_cte()}
SELECT count(*) AS source_rows,
  count(*) FILTER (WHERE length({O.strip_ws("coalesce(website_url, '')")}) > 0) AS migrated_rows,
  count(*) FILTER (WHERE length({O.strip_ws("coalesce(website_url, '')")}) = 0) AS failed_rows,
  false AS dry_run FROM import_batch""")
def q_migrate_report(spark, sf_dir):
    return I.migrate_sites(FX.import_batch(spark, sf_dir), as_of=FX.AS_OF, dry_run=False)[1]


# ---------------------------------------------------------------------------
# enrichment with outcome
# ---------------------------------------------------------------------------

def _validate_sql(u: str) -> str:
    s = O.strip_ws(f"coalesce({u}, '')")
    return (f"CASE WHEN length({s}) = 0 THEN 'URL is empty' "
            f"WHEN NOT (starts_with({s}, 'http://') OR starts_with({s}, 'https://')) "
            f"THEN 'URL must start with http:// or https://' "
            f"WHEN length({s}) > 2048 THEN 'URL is too long (max 2048 chars)' END")


def _normalize_sql(u: str) -> str:
    s = O.strip_ws(f"coalesce({u}, '')")
    return (f"CASE WHEN starts_with({s}, 'http://') OR starts_with({s}, 'https://') THEN {s} "
            f"ELSE 'https://' || {s} END")


EB_HEAD = f"""WITH {OE.pages_seeded_cte()}, {OI.url_requests_cte()},
r AS (SELECT row_no, url AS _in, {_validate_sql('url')} AS _verr, {_normalize_sql('url')} AS _norm
      FROM url_requests),
j AS (SELECT r.*, p.html AS _html FROM r LEFT JOIN pages_seeded p ON p.url = r._norm),
k AS (SELECT *, CASE WHEN _verr IS NOT NULL THEN _verr
                     WHEN _html IS NULL OR length(_html) = 0 THEN 'Failed to fetch ' || _norm END AS _err
      FROM j)"""


@register("enrich_batch_errors", f"""{EB_HEAD}
SELECT row_no, _in AS url, _err AS error FROM k WHERE _err IS NOT NULL""")
def q_enrich_batch_errors(spark, sf_dir):
    _, errors = I.enrich_batch(FX.url_requests(spark, sf_dir), FX.pages_seeded(spark, sf_dir),
                               as_of=FX.AS_OF)
    return errors


@register("enrich_batch", f"""{EB_HEAD},
ok AS (SELECT row_no, _norm AS url, coalesce(_html, '') AS html FROM k WHERE _err IS NULL),
{enrich_ctes('ok', 'row_no')}
SELECT * FROM enriched""")
def q_enrich_batch(spark, sf_dir):
    good, _ = I.enrich_batch(FX.url_requests(spark, sf_dir), FX.pages_seeded(spark, sf_dir),
                             as_of=FX.AS_OF)
    return flat_enrichment(good.withColumnRenamed("row_no", "page_id")).withColumnRenamed(
        "page_id", "row_no")


IMPORT_URLS_SQL = f"""{EB_HEAD}, {OI.import_target_cte()},
ok AS (SELECT row_no, {O.strip_ws('_norm')} AS _url FROM k WHERE _err IS NULL),
n AS (SELECT _url, max(row_no) AS newest FROM ok GROUP BY _url),
t AS (SELECT DISTINCT website_url FROM import_target)"""


@register("import_urls_report", f"""{IMPORT_URLS_SQL}
SELECT row_no, _in AS website_url, 'error' AS outcome, _err AS error FROM k WHERE _err IS NOT NULL
UNION ALL
SELECT row_no, ok._url, CASE WHEN row_no < newest THEN 'skipped' WHEN t.website_url IS NOT NULL THEN 'updated'
  ELSE 'inserted' END, CASE WHEN row_no < newest THEN 'Duplicate in batch' END
FROM ok JOIN n ON n._url = ok._url LEFT JOIN t ON t.website_url = ok._url""")
def q_import_urls_report(spark, sf_dir):
    return I.import_urls(FX.import_target(spark, sf_dir), FX.url_requests(spark, sf_dir),
                         FX.pages_seeded(spark, sf_dir), as_of=FX.AS_OF)[1]


@register("import_urls", f"""{IMPORT_URLS_SQL}
SELECT coalesce(it.website_url, n._url) AS website_url, it.heat_score,
  CASE WHEN n._url IS NOT NULL THEN {O.AS_OF_SQL} END AS last_enriched_at,
  coalesce(it.created_at, {O.AS_OF_SQL}) AS created_at
FROM import_target it FULL OUTER JOIN n ON n._url = it.website_url""")
def q_import_urls(spark, sf_dir):
    new_target, _ = I.import_urls(FX.import_target(spark, sf_dir), FX.url_requests(spark, sf_dir),
                                  FX.pages_seeded(spark, sf_dir), as_of=FX.AS_OF)
    return new_target.select("website_url", "heat_score", "last_enriched_at", "created_at")


# ---------------------------------------------------------------------------
# scalar functions
# ---------------------------------------------------------------------------

@register("url_checks", f"""WITH {OI.url_requests_cte()},
a AS (SELECT page_id, url, {_validate_sql('url')} AS error, {_normalize_sql('url')} AS normalized
      FROM url_requests)
SELECT page_id, error, normalized, {O.url_host(O.norm('normalized'))} AS host,
  {O.url_path(O.norm('normalized'))} AS path, replace(url_encode(url), '%2F', '/') AS quoted FROM a""")
def q_url_checks(spark, sf_dir):
    r = FX.url_requests(spark, sf_dir)
    a = r.select("page_id", "url", SF.validate_url(F.col("url")).alias("error"),
                 SF.normalize_url(F.col("url")).alias("normalized"))
    n = SF.norm(F.col("normalized"))
    return a.select("page_id", "error", "normalized", SF.url_host(n).alias("host"),
                    SF.url_path(n).alias("path"), SF.quote(F.col("url")).alias("quoted"))


def _icon_sql(p: str) -> str:
    from sitelens.dictionaries import DEFAULT, DEFAULT_ICON
    pairs = ", ".join(f"{O.lit(k)}: {O.lit(v)}" for k, v in DEFAULT.icons)
    key = f"lower({O.strip_ws(f'coalesce({p}, {chr(39)}{chr(39)})')})"
    key = f"CASE WHEN length({key}) = 0 THEN 'unknown' ELSE {key} END"
    return f"coalesce(MAP {{{pairs}}}[{key}], {O.lit(DEFAULT_ICON)})"


ICON_INPUT_SQL = """SELECT page_id, CASE WHEN page_id % 10 = 0 THEN NULL
    WHEN page_id % 3 = 0 THEN upper(platform) WHEN page_id % 3 = 1 THEN '  ' || lower(platform) || ' '
    ELSE platform END AS platform_in FROM import_batch"""


@register("icon_key", f"""WITH {OI.import_batch_cte()}, a AS ({ICON_INPUT_SQL})
SELECT page_id, platform_in, {_icon_sql('platform_in')} AS icon FROM a""")
def q_icon_key(spark, sf_dir):
    b = FX.import_batch(spark, sf_dir)
    pid = F.col("page_id")
    p_in = (F.when(F.pmod(pid, F.lit(10)) == 0, F.lit(None).cast("string"))
            .when(F.pmod(pid, F.lit(3)) == 0, F.upper("platform"))
            .when(F.pmod(pid, F.lit(3)) == 1, F.concat(F.lit("  "), F.lower("platform"), F.lit(" ")))
            .otherwise(F.col("platform")))
    a = b.select("page_id", p_in.alias("platform_in"))
    return a.select("page_id", "platform_in", SF.icon_key(F.col("platform_in")).alias("icon"))


@register("client_key", f"""WITH a AS (
  SELECT event_id,
    CASE user_id % 4 WHEN 0 THEN ' 10.0.0.' || CAST(user_id AS VARCHAR) || ', 172.16.0.1'
      WHEN 1 THEN NULL WHEN 2 THEN '' ELSE '10.1.' || CAST(user_id AS VARCHAR) || '.9' END AS fwd,
    CASE WHEN user_id % 5 = 0 THEN NULL ELSE '192.168.0.' || CAST(user_id AS VARCHAR) END AS peer
  FROM events)
SELECT event_id, CASE WHEN fwd IS NOT NULL AND length(fwd) > 0
  THEN {O.strip_ws("split_part(fwd, ',', 1)")} WHEN peer IS NOT NULL THEN peer ELSE 'unknown' END
  AS client FROM a""")
def q_client_key(spark, sf_dir):
    e = FX.table(spark, sf_dir, "events")
    uid = F.col("user_id")
    fwd = (F.when(F.pmod(uid, F.lit(4)) == 0,
                  F.concat(F.lit(" 10.0.0."), uid.cast("string"), F.lit(", 172.16.0.1")))
           .when(F.pmod(uid, F.lit(4)) == 1, F.lit(None).cast("string"))
           .when(F.pmod(uid, F.lit(4)) == 2, F.lit(""))
           .otherwise(F.concat(F.lit("10.1."), uid.cast("string"), F.lit(".9"))))
    peer = F.when(F.pmod(uid, F.lit(5)) == 0, F.lit(None).cast("string")) \
        .otherwise(F.concat(F.lit("192.168.0."), uid.cast("string")))
    return e.select("event_id", SF.client_key(fwd, peer).alias("client"))


@register("json_decode", f"""WITH a AS (
  SELECT event_id,
    CASE WHEN event_id % 17 = 0 THEN '{{"k": ' WHEN event_id % 19 = 0 THEN '' ELSE props END AS props_in,
    CASE event_id % 5
      WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
      WHEN 1 THEN strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') || '+02:00'
      WHEN 2 THEN 'not-a-time' WHEN 3 THEN strftime(ts, '%Y-%m-%d')
      ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts_in
  FROM events)
SELECT event_id, ({OI.decode_map('props_in')})['k'] AS k, {OI.decode_map('props_in')} IS NOT NULL AS props_ok,
  {OI.parse_ts('ts_in')} AS ts_parsed FROM a""")
def q_json_decode(spark, sf_dir):
    e = FX.table(spark, sf_dir, "events")
    eid = F.col("event_id")
    props = (F.when(F.pmod(eid, F.lit(17)) == 0, F.lit('{"k": '))
             .when(F.pmod(eid, F.lit(19)) == 0, F.lit("")).otherwise(F.col("props")))
    m = F.pmod(eid, F.lit(5))
    ts = F.col("ts")
    ts_in = (F.when(m == 0, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
             .when(m == 1, F.concat(F.date_format(ts + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"),
                                    F.lit("+02:00")))
             .when(m == 2, F.lit("not-a-time"))
             .when(m == 3, F.date_format(ts, "yyyy-MM-dd"))
             .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss")))
    a = e.select("event_id", props.alias("props_in"), ts_in.alias("ts_in"))
    dm = SF.decode_json_map(F.col("props_in"))
    return a.select("event_id", F.try_element_at(dm, F.lit("k")).alias("k"),
                    dm.isNotNull().alias("props_ok"), SF.parse_ts(F.col("ts_in")).alias("ts_parsed"))

