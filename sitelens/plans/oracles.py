"""DuckDB twins of the registered queries (the driver's correctness oracle).

Each SQL string reads only the driver's tables (views ``part``, ``lineitem``,
``pages``, ``documents``, ``events`` ...) and rebuilds the same fixtures with
CTEs.  Expression generators below mirror the Spark column builders term by
term, in the same order of floating-point operations, so doubles agree bit for
bit before the final ``round(x, 6)``.
"""

from __future__ import annotations

from sitelens.dictionaries import DEFAULT, Dictionaries
from sitelens.functions.text import WS
from sitelens.functions.urls import HOST_RE, PARAMS_RE, PATH_RE
from sitelens.plans import fixtures as FX

AS_OF_SQL = f"TIMESTAMP '{FX.AS_OF.strftime('%Y-%m-%d %H:%M:%S')}'"
STRIP_RE = f"^[{WS}]+|[{WS}]+$"
CLEAN_RE = f"[^a-z0-9{WS}]"
SPLIT_RE = f"[{WS}]+"


def r6(x: str) -> str:
    return f"(floor(({x}) * 1e6 + 0.5) / 1e6)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(x: str) -> str:
    return f"lower(regexp_replace(coalesce({x}, ''), {lit(STRIP_RE)}, '', 'g'))"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, {lit(STRIP_RE)}, '', 'g')"


def tag_tokens(x: str) -> str:
    return (f"list_filter(list_transform(string_split(coalesce({x}, ''), ','), "
            f"lambda t: lower({strip_ws('t')})), lambda t: length(t) > 0)")


def url_host(u: str) -> str:
    clean = f"regexp_replace({u}, '[\\t\\r\\n]', '', 'g')"
    return f"CASE WHEN contains({u}, '://') THEN regexp_extract({clean}, {lit(HOST_RE)}, 1) ELSE {u} END"


def url_path(u: str) -> str:
    clean = f"regexp_replace({u}, '[\\t\\r\\n]', '', 'g')"
    path = f"regexp_replace(regexp_extract({clean}, {lit(PATH_RE)}, 1), {lit(PARAMS_RE)}, '')"
    return f"CASE WHEN contains({u}, '://') THEN {path} ELSE '' END"


def fuzzy_host(url: str) -> str:
    u = norm(url)
    clean = f"regexp_replace({u}, '[\\t\\r\\n]', '', 'g')"
    return f"CASE WHEN contains({u}, '//') THEN regexp_extract({clean}, {lit(HOST_RE)}, 1) ELSE {u} END"


def floor_div(x: str, d: int) -> str:
    return f"(({x}) - ((({x}) % {d}) + {d}) % {d}) // {d}"


def days_between(later: str, earlier: str) -> str:
    return floor_div(f"date_diff('microsecond', {earlier}, {later})", 86_400_000_000)


# ---------------------------------------------------------------------------
# fixtures
# ---------------------------------------------------------------------------

def sites_cte(with_usage: bool = True) -> str:
    w1 = "string_split(p_name, ' ')[1]"
    w2 = "string_split(p_name, ' ')[-1]"
    lu = (f"CASE WHEN p_partkey % 50 = 7 THEN {AS_OF_SQL} + INTERVAL {FX.FUTURE_USE_DAYS} DAY "
          f"ELSE u._lu END" if with_usage else "CAST(NULL AS TIMESTAMP)")
    join = ("LEFT JOIN (SELECT l_partkey, max(l_shipdate) AS _lu FROM lineitem GROUP BY l_partkey) u "
            "ON u.l_partkey = p.p_partkey" if with_usage else "")
    return f"""sites AS (
  SELECT p_partkey AS id,
    'https://' || replace(lower(p_brand), '#', '') || '.example.com/' || replace(p_name, ' ', '-')
      || '/' || CAST(p_partkey AS VARCHAR) AS website_url,
    p_brand AS platform, p_type AS industry, replace(p_name, ' ', ', ') AS tags,
    [p_brand] AS platforms, [p_type] AS industries,
    CASE WHEN {w1} = {w2} THEN MAP {{{w1}: 0.4::DOUBLE}}
         ELSE MAP {{{w1}: 0.9::DOUBLE, {w2}: 0.4::DOUBLE}} END AS tag_confidence,
    {AS_OF_SQL} - to_days(CAST(p_partkey % 45 AS INTEGER)) - to_hours(CAST(p_partkey % 3 AS INTEGER))
      AS last_enriched_at,
    CASE WHEN p_partkey % 10 = 3 THEN NULL
         ELSE CAST((p_partkey * 37) % 1001 AS DOUBLE) / 10 END AS heat_score,
    CASE WHEN p_partkey % 4 = 0 THEN MAP {{'seeded_at': '{FX.SEEDED_AT}', 'source': 'part'}}
         ELSE MAP {{'source': 'part'}} END AS site_metadata,
    {lu} AS last_used_at
  FROM part p {join})"""


# ---------------------------------------------------------------------------
# search
# ---------------------------------------------------------------------------

def _add(acc: str, cond: str, v: float) -> str:
    return f"({acc} + CASE WHEN {cond} THEN {v} ELSE 0.0 END)"


def _term_step(acc: str, t: str) -> str:
    acc = _add(acc, f"contains(_host, {t})", 5.0)
    acc = _add(acc, f"contains(_path, {t})", 4.0)
    acc = _add(acc, f"contains(_plat_n, {t})", 4.5)
    acc = _add(acc, f"contains(_ind_n, {t})", 4.0)
    matched = (f"(contains(tag, {t}) OR contains({t}, tag) OR "
               f"(abs(length({t}) - length(tag)) <= 2 AND levenshtein({t}, tag) <= 1))")
    conf = "coalesce(tag_confidence[tag], 0.0::DOUBLE)"
    acc = (f"list_reduce(_tags, lambda a, tag: a + CASE WHEN {matched} "
           f"THEN 2.5 * (1.0 + least({conf}, 1.0)) ELSE 0.0 END, {acc})")
    for field in ("_plat_n", "_ind_n"):
        near = (f"(length({field}) > 0 AND length({t}) <= 12 AND "
                f"abs(length({t}) - length({field})) <= 6 AND levenshtein({t}, {field}) = 1)")
        acc = _add(acc, near, 1.0)
    return acc


def _multipliers(score: str, as_of: str = AS_OF_SQL) -> str:
    days = f"CAST({days_between(as_of, 'last_used_at')} AS DOUBLE)"
    s = (f"CASE WHEN last_used_at IS NOT NULL THEN {score} * (1.0 + greatest(0.0, -0.0001 * {days})) "
         f"ELSE {score} END")
    boost = "least(0.05, 0.01 * (heat_score / 10.0))"
    return (f"CASE WHEN heat_score IS NOT NULL AND heat_score <> 0 THEN ({s}) * (1.0 + {boost}) "
            f"ELSE {s} END")


def score_sql(terms: list[str]) -> str:
    acc = "0.0::DOUBLE"
    for t in terms:
        acc = _term_step(acc, lit(t))
    return _multipliers(acc)


def prepared_cte(src: str = "sites") -> str:
    return f"""prep AS (
  SELECT *, {norm('platform')} AS _plat_n, {norm('industry')} AS _ind_n,
    {url_host(norm('website_url'))} AS _host, {url_path(norm('website_url'))} AS _path,
    {tag_tokens('tags')} AS _tags, lower(tags) AS _tags_l, lower(website_url) AS _url_l,
    {fuzzy_host('website_url')} AS _fhost
  FROM {src})"""


def direct_sql(terms: list[str]) -> str:
    parts = []
    for t in terms:
        lt = lit(t)
        parts.append(f"coalesce(contains(_url_l, {lt}) OR contains(lower(platform), {lt}) OR "
                     f"contains(lower(industry), {lt}) OR contains(_tags_l, {lt}), false)")
    return "(" + " OR ".join(parts) + ")" if parts else "false"


def fuzzy_sql(main: str) -> str:
    parts = []
    for field in ("_fhost", "_plat_n", "_ind_n"):
        parts.append(f"(length({field}) > 0 AND abs(length({main}) - length({field})) <= 6 "
                     f"AND levenshtein({main}, {field}) <= 2)")
    return "(" + " OR ".join(parts) + ")"


def scored_cte(q: str, dicts: Dictionaries = DEFAULT, name: str = "scored") -> str:
    from sitelens.operators.search import expand_terms
    terms = expand_terms(q, dicts)
    direct = direct_sql(terms)
    main = lit((q or "").strip().lower())
    return f"""{name} AS (
  SELECT *, {score_sql(terms)} AS score FROM prep
  WHERE {direct} OR (NOT EXISTS (SELECT 1 FROM prep WHERE {direct}) AND {fuzzy_sql(main)}))"""


def search_rows_sql(q: str, page: int = 1, page_size: int = 10, dicts: Dictionaries = DEFAULT,
                    extra_cols: str = "") -> str:
    """rank, id, website_url, platform, industry, score + page info, for one query."""
    raw = page if page > 0 else 1
    return f"""WITH {sites_cte()}, {prepared_cte()}, {scored_cte(q, dicts)},
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored WHERE score > 0),
info AS (
  SELECT count(*) AS total_results,
    CASE WHEN count(*) > 0 THEN greatest(1, CAST(ceil(count(*) / {page_size}) AS BIGINT)) ELSE 1 END
      AS total_pages FROM ranked),
info2 AS (
  SELECT *, CAST(CASE WHEN {raw} > total_pages AND total_results > 0 THEN 1 ELSE {raw} END AS BIGINT)
    AS page FROM info)
SELECT {extra_cols} CAST(rank AS BIGINT) AS rank, id, website_url, platform, industry,
  {r6('score')} AS score, page, total_pages, total_results,
  page > 1 AS has_previous, page < total_pages AND total_results > {page_size} AS has_next
FROM ranked, info2
WHERE rank > (page - 1) * {page_size} AND rank <= page * {page_size}"""
