"""Registered queries: name -> (Spark builder, DuckDB oracle SQL).

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
driver tables (or fixtures Spark derives from them).  Computed columns carry the
same names as in the oracle SQL; doubles are rounded to 6 decimals and nested
values are flattened to strings so both engines hash the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.dictionaries import DEFAULT, Dictionaries
from sitelens.operators import heat as H
from sitelens.operators import search as S
from sitelens.plans import fixtures as FX
from sitelens.plans import oracles as O
from sitelens.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _r6(c):
    """Round to 6 decimals with plain IEEE steps (the same result in every engine)."""
    return F.floor(c * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


# ---------------------------------------------------------------------------
# search
# ---------------------------------------------------------------------------

SEARCH_Q = "red widget"
CUSTOM_SYNONYMS = Dictionaries(synonyms=[("ring", ["bolt"]), ("small", ["tiny", "mini"])])


def _page_rows(spark, sf_dir, q, page, dicts=DEFAULT):
    sites = FX.sites(spark, sf_dir)
    rows, info = S.search(sites, q, page=page, dicts=dicts, as_of=FX.AS_OF)
    out = S.with_page_info(rows, info)
    return out.select("rank", "id", "website_url", "platform", "industry",
                      _r6(F.col("score")).alias("score"), "page", "total_pages", "total_results",
                      "has_previous", "has_next")


@register("search_rank", O.search_rows_sql(SEARCH_Q, 1))
def q_search_rank(spark, sf_dir):
    return _page_rows(spark, sf_dir, SEARCH_Q, 1)


SEARCH_PAGES = [2, 99]


@register("search_page", " UNION ALL ".join(
    f"SELECT * FROM ({O.search_rows_sql(SEARCH_Q, p, extra_cols=f'{p} AS requested_page,')})"
    for p in SEARCH_PAGES))
def q_search_page(spark, sf_dir):
    out = None
    for p in SEARCH_PAGES:
        df = _page_rows(spark, sf_dir, SEARCH_Q, p).withColumn("requested_page", F.lit(p))
        out = df if out is None else out.unionByName(df)
    return out.select("requested_page", *[c for c in out.columns if c != "requested_page"])


@register("search_synonyms", O.search_rows_sql("small ring", 1, dicts=CUSTOM_SYNONYMS))
def q_search_synonyms(spark, sf_dir):
    return _page_rows(spark, sf_dir, "small ring", 1, dicts=CUSTOM_SYNONYMS)


FUZZY_QUERIES = ["econmy", "smoll", "zzzz", "brand17"]


@register("search_fuzzy", " UNION ALL ".join(
    f"SELECT * FROM ({O.search_rows_sql(q, 1, extra_cols=f'{O.lit(q)} AS q,')})"
    for q in FUZZY_QUERIES))
def q_search_fuzzy(spark, sf_dir):
    out = None
    for q in FUZZY_QUERIES:
        df = _page_rows(spark, sf_dir, q, 1).withColumn("q", F.lit(q))
        out = df if out is None else out.unionByName(df)
    return out


@register("search_heat_recency", f"""WITH {O.sites_cte()}, {O.prepared_cte()}, {O.scored_cte('gear')}
SELECT id, {O.r6('score')} AS score, heat_score, last_used_at FROM scored WHERE score > 0""")
def q_search_heat_recency(spark, sf_dir):
    sites = FX.sites(spark, sf_dir)
    r = S.ranked(sites, "gear", as_of=FX.AS_OF)
    return r.select("id", _r6(F.col("score")).alias("score"), "heat_score", "last_used_at")


def _batch_queries_spark(spark, sf_dir):
    p = FX.table(spark, sf_dir, "part")
    qs = (p.select(F.col("p_name").alias("q"))
          .unionByName(p.select(F.col("p_brand").alias("q")))
          .unionByName(p.select(F.col("p_type").alias("q")))
          .distinct())
    return qs.select(F.col("q").alias("query_id"), "q")


BATCH_QUERIES_SQL = """queries AS (
  SELECT DISTINCT q FROM (SELECT p_name AS q FROM part UNION ALL SELECT p_brand FROM part
                          UNION ALL SELECT p_type FROM part))"""


def _batch_sql(k: int = 10) -> str:
    syn = ", ".join(f"{O.lit(a)}: [{', '.join(O.lit(x) for x in b)}]" for a, b in DEFAULT.synonyms)
    toks = f"list_filter(regexp_split_to_array({O.norm('q')}, '[^a-z0-9]+'), lambda t: length(t) > 0)"
    terms = (f"list_sort(list_distinct(list_concat({toks}, flatten(list_transform({toks}, "
             f"lambda t: coalesce(MAP {{{syn}}}[t], []::VARCHAR[]))))))")
    step = O._term_step("a", "t")
    direct_one = ("coalesce(contains(_url_l, t) OR contains(lower(platform), t) OR "
                  "contains(lower(industry), t) OR contains(_tags_l, t), false)")
    return f"""WITH {O.sites_cte()}, {O.prepared_cte()}, {BATCH_QUERIES_SQL},
qt AS (SELECT q, {terms} AS _terms, {O.norm('q')} AS _main FROM queries),
pairs AS (
  SELECT qt.q, prep.*, list_bool_or(list_transform(_terms, lambda t: {direct_one})) AS _is_direct,
    {O._multipliers(f"list_reduce(_terms, lambda a, t: {step}, 0.0::DOUBLE)")} AS score
  FROM qt, prep
  WHERE len(_terms) > 0 AND (list_bool_or(list_transform(_terms, lambda t: {direct_one}))
        OR {O.fuzzy_sql('_main')})),
agg AS (SELECT q, bool_or(_is_direct) AS _any FROM pairs GROUP BY q),
kept AS (SELECT pairs.* FROM pairs JOIN agg USING (q) WHERE score > 0 AND (_is_direct OR NOT _any)),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank,
             count(*) OVER (PARTITION BY q) AS total_results FROM kept)
SELECT q AS query_id, CAST(rank AS BIGINT) AS rank, id, website_url, {O.r6('score')} AS score,
  total_results FROM r WHERE rank <= {k}"""


@register("search_batch", _batch_sql())
def q_search_batch(spark, sf_dir):
    sites = FX.sites(spark, sf_dir)
    out = S.search_batch(sites, _batch_queries_spark(spark, sf_dir), k=10, as_of=FX.AS_OF)
    return out.select("query_id", "rank", "id", "website_url", _r6(F.col("score")).alias("score"),
                      "total_results")


@register("search_batch_index", _batch_sql())
def q_search_batch_index(spark, sf_dir):
    """The same batch search with a stored index."""
    sites = FX.sites(spark, sf_dir)
    path = scratch_path(spark, "search-index")
    S.search_index(sites).write.parquet(path)
    out = S.search_batch(sites, _batch_queries_spark(spark, sf_dir), k=10, as_of=FX.AS_OF,
                         index=spark.read.parquet(path))
    return out.select("query_id", "rank", "id", "website_url", _r6(F.col("score")).alias("score"),
                      "total_results")


@register("search_touch", f"""WITH {O.sites_cte()}, found AS ({_batch_sql()}),
touched AS (SELECT DISTINCT id FROM found)
SELECT sites.id, CASE WHEN touched.id IS NOT NULL THEN greatest(last_used_at, {O.AS_OF_SQL}) ELSE last_used_at END
  AS last_used_at, heat_score FROM sites LEFT JOIN touched ON touched.id = sites.id""")
def q_search_touch(spark, sf_dir):
    sites = FX.sites(spark, sf_dir)
    found = S.search_batch(sites, _batch_queries_spark(spark, sf_dir), k=10, as_of=FX.AS_OF)
    out = H.apply_usage(sites, H.usage_from_results(found, as_of=FX.AS_OF))
    return out.select("id", "last_used_at", "heat_score")


DEEP_PAGE = 7


@register("search_deep_page", O.search_rows_sql("small", DEEP_PAGE))
def q_search_deep_page(spark, sf_dir):
    return _page_rows(spark, sf_dir, "small", DEEP_PAGE)


@register("search_all", f"""WITH {O.sites_cte()}, {O.prepared_cte()}, {O.scored_cte("small", DEFAULT)}
SELECT id, website_url, {O.r6('score')} AS score FROM scored WHERE score > 0""")
def q_search_all(spark, sf_dir):
    out = S.search_all(FX.sites(spark, sf_dir), "small", as_of=FX.AS_OF)
    return out.select("id", "website_url", _r6(F.col("score")).alias("score"))


@register("heat_deep_page", f"""WITH {O.sites_cte()},
t AS (SELECT count(*) FILTER (WHERE heat_score > 0 OR heat_score IS NULL) AS total_positive_or_null
      FROM sites),
r AS (SELECT id, website_url, heat_score,
             row_number() OVER (ORDER BY heat_score DESC NULLS FIRST, id) AS rank FROM sites)
SELECT CAST(rank AS BIGINT) AS rank, id, website_url, heat_score, total_positive_or_null
FROM r, t WHERE rank > 90 AND rank <= 140""")
def q_heat_deep_page(spark, sf_dir):
    out = S.heat_leaderboard(FX.sites(spark, sf_dir), limit=50, offset=90)
    return out.select("rank", "id", "website_url", "heat_score", "total_positive_or_null")


@register("heat_leaderboard", f"""WITH {O.sites_cte()},
t AS (SELECT count(*) FILTER (WHERE heat_score > 0 OR heat_score IS NULL) AS total_positive_or_null
      FROM sites),
r AS (SELECT id, website_url, heat_score,
             row_number() OVER (ORDER BY heat_score DESC NULLS FIRST, id) AS rank FROM sites)
SELECT CAST(rank AS BIGINT) AS rank, id, website_url, heat_score, total_positive_or_null
FROM r, t WHERE rank > 5 AND rank <= 25""")
def q_heat_leaderboard(spark, sf_dir):
    sites = FX.sites(spark, sf_dir)
    out = S.heat_leaderboard(sites, limit=20, offset=5)
    return out.select("rank", "id", "website_url", "heat_score", "total_positive_or_null")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLES)


def _load_all():
    # Importing a module registers its queries.
    from sitelens.plans import registry_ingest, registry_more, registry_streams  # noqa: F401
