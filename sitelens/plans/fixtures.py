"""Catalog inputs derived from the driver's tables (see FIXTURES.md).

The driver's tables carry no site catalog, so the registered queries derive one
with DataFrame operations: ``sites`` from ``part`` (names, brands, types) and
``lineitem`` (last use), seeded pages from ``pages`` and seeded documents from
``documents``.  Each derivation has a DuckDB twin in ``plans/oracles.py``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions.parse import ntz_lit

# FIXED VALUES of the fixtures (also written in the oracle SQL).
AS_OF = dt.datetime(2002, 1, 1, 0, 0, 0)
FUTURE_USE_DAYS = 10          # ids with id % 50 = 7 were "used" 10 days after AS_OF
SEEDED_AT = "2001-12-01T00:00:00Z"


def table(spark: SparkSession, sf_dir: str, name: str, wide: bool = False) -> DataFrame:
    """A driver table.  ``wide``: the caller does much work per row, so a plain scan with
    fewer splits than the cluster has cores is dealt out (no job runs to find out)."""
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if wide and rows.rdd.getNumPartitions() < cores else rows


def as_of_col():
    return ntz_lit(AS_OF)


def sites(spark: SparkSession, sf_dir: str, with_usage: bool = True) -> DataFrame:
    """The ``sites`` catalog: one row per part."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    words = F.split(F.col("p_name"), " ")
    w1 = F.element_at(words, 1)
    w2 = F.element_at(words, -1)
    conf = F.when(w1 == w2, F.create_map(w1, F.lit(0.4))) \
        .otherwise(F.create_map(w1, F.lit(0.9), w2, F.lit(0.4)))
    key = F.col("p_partkey")
    df = p.select(
        key.alias("id"),
        F.concat(F.lit("https://"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")),
                 F.lit(".example.com/"), F.replace("p_name", F.lit(" "), F.lit("-")),
                 F.lit("/"), key.cast("string")).alias("website_url"),
        F.col("p_brand").alias("platform"),
        F.col("p_type").alias("industry"),
        F.replace("p_name", F.lit(" "), F.lit(", ")).alias("tags"),
        F.array("p_brand").alias("platforms"),
        F.array("p_type").alias("industries"),
        F.lit(None).cast("struct<primary:string,secondary:string>").alias("colors"),
        conf.alias("tag_confidence"),
        (as_of_col() - F.make_dt_interval(F.pmod(key, F.lit(45)), F.pmod(key, F.lit(3))))
        .alias("last_enriched_at"),
        F.when(F.pmod(key, F.lit(10)) == 3, F.lit(None).cast("double"))
        .otherwise((F.pmod(key * 37, F.lit(1001)) / F.lit(10)).cast("double")).alias("heat_score"),
        F.when(F.pmod(key, F.lit(4)) == 0, F.create_map(F.lit("seeded_at"), F.lit(SEEDED_AT),
                                                         F.lit("source"), F.lit("part")))
        .otherwise(F.create_map(F.lit("source"), F.lit("part"))).alias("site_metadata"),
    )
    if with_usage:
        used = (table(spark, sf_dir, "lineitem")
                .groupBy(F.col("l_partkey").alias("id"))
                .agg(F.max("l_shipdate").alias("_lu")))
        df = df.join(used, "id", "left")
        lu = F.when(F.pmod(F.col("id"), F.lit(50)) == 7,
                    as_of_col() + F.make_dt_interval(F.lit(FUTURE_USE_DAYS))).otherwise(F.col("_lu"))
        df = df.withColumn("last_used_at", lu.cast("timestamp_ntz")).drop("_lu")
    else:
        df = df.withColumn("last_used_at", F.lit(None).cast("timestamp_ntz"))
    return df


# FIXED VALUES: markup put right after the charset tag, by page_id mod 8
# (index 6 empties the page: a failed fetch).
CHARSET_TAG = '<meta charset="utf-8">'
PAGE_SEEDS = [
    "",
    '<link rel="stylesheet" href="https://cdn.shopify.com/s/files/theme.css">'
    '<script src="/_next/static/a.js"></script>',
    '<meta name="theme-color" content="#FFF"><link rel="stylesheet" href="/wp-content/x.css">'
    '<meta name="generator" content="WordPress">',
    '<meta name="description" content="Cloud software platform with an api dashboard and '
    'subscription billing">',
    "<style>.hero{color:#0070f3;border-color:#7928caff;background:#abcd}</style>",
    '<meta name="msapplication-TileColor" content="#00aabb"><style>a{color:#0AB}b{color:#123456}'
    '</style><script src="https://assets.example.net/webflow.js"></script>',
    "",
    '<div data-reactroot style="color:#123">hero</div>'
    '<script src="https://framerusercontent.com/m.js"></script>',
]
FAILED_FETCH_MOD = 6

# FIXED VALUES: phrase appended to documents by doc_id mod 6.
DOC_SEEDS = [
    "",
    "cloud software platform api dashboard",
    "shop store cart checkout product",
    "health clinic doctor training fitness gym",
    "real estate property listing rent",
    "",
]


def pages_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages", wide=True)
    m = F.pmod(F.col("page_id"), F.lit(8))
    ins = F.element_at(F.array(*[F.lit(s) for s in PAGE_SEEDS]), (m + 1).cast("int"))
    html = F.when(m == FAILED_FETCH_MOD, F.lit("")).otherwise(
        F.replace(F.col("html"), F.lit(CHARSET_TAG), F.concat(F.lit(CHARSET_TAG), ins)))
    return p.select("page_id", "url", html.alias("html"))


def documents_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", wide=True)
    m = F.pmod(F.col("doc_id"), F.lit(6))
    phrase = F.element_at(F.array(*[F.lit(s) for s in DOC_SEEDS]), (m + 1).cast("int"))
    text = F.when(F.length(phrase) > 0, F.concat(F.col("text"), F.lit(" "), phrase)) \
        .otherwise(F.col("text"))
    return d.select("doc_id", text.alias("text"), "lang", "source")


# FIXED VALUES of the import fixtures (FIXTURES.md 3.4).
IMPORT_PLATFORMS = ["WordPress", "Webflow", "Shopify", "Custom", "Wix"]
IMPORT_INDUSTRIES = ["SaaS", "Blog", "Agency"]
REPEAT_ROW_OFFSET = 1_000_000


def import_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-enriched upload rows (all text), one per page, with seeded faults:
    every 7th row repeated later, every 11th URL blank, every 13th without
    scheme, every 17th bad JSON, every 19th bad timestamp, every 4th empty list."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    pid = F.col("page_id")
    plat = F.element_at(F.array(*[F.lit(x) for x in IMPORT_PLATFORMS]),
                        (F.pmod(pid, F.lit(5)) + 1).cast("int"))
    ind = F.element_at(F.array(*[F.lit(x) for x in IMPORT_INDUSTRIES]),
                       (F.pmod(pid, F.lit(3)) + 1).cast("int"))
    url = (F.when(F.pmod(pid, F.lit(11)) == 0, F.lit("  "))
           .when(F.pmod(pid, F.lit(13)) == 0, F.regexp_replace("url", "^https?://", ""))
           .otherwise(F.col("url")))
    day = F.lpad((F.pmod(pid, F.lit(28)) + 1).cast("string"), 2, "0")
    rows = p.select(
        (pid + 2).cast("long").alias("row_no"), pid.alias("page_id"),
        url.alias("website_url"), plat.alias("platform"), ind.alias("industry"),
        F.lit("alpha, beta").alias("tags"),
        F.when(F.pmod(pid, F.lit(17)) == 0, F.lit('["broken'))
        .otherwise(F.concat(F.lit('["'), plat, F.lit('"]'))).alias("platforms"),
        F.when(F.pmod(pid, F.lit(4)) == 0, F.lit("[]"))
        .otherwise(F.concat(F.lit('["'), ind, F.lit('"]'))).alias("industries"),
        F.lit('{"primary": "#aabbcc", "secondary": null}').alias("colors"),
        F.lit('{"alpha": 0.9, "beta": 0.4}').alias("tag_confidence"),
        F.concat(F.lit('{"platform_scores": {"'), plat,
                 F.lit('": 1.0}, "industry_scores": {}, "colors": {"primary": "#aabbcc", '
                       '"secondary": null}}')).alias("enrichment_signals"),
        F.when(F.pmod(pid, F.lit(19)) == 0, F.lit("not-a-time"))
        .otherwise(F.concat(F.lit("2001-12-"), day, F.lit("T10:00:00Z"))).alias("last_enriched_at"))
    repeats = rows.filter(F.pmod(F.col("page_id"), F.lit(7)) == 0) \
        .withColumn("row_no", F.col("row_no") + REPEAT_ROW_OFFSET) \
        .withColumn("platforms", F.concat(F.lit('["'), F.col("platform"), F.lit('"]')))  # a bad copy is followed by a good one
    return rows.unionByName(repeats)


def import_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existing catalog rows for pages with page_id mod 3 = 0 (other labels, heat
    and metadata filled: an upsert must keep them)."""
    p = table(spark, sf_dir, "pages").filter(F.pmod(F.col("page_id"), F.lit(3)) == 0)
    pid = F.col("page_id")
    return p.select(
        pid.alias("id"), F.col("url").alias("website_url"),
        F.lit("Legacy").alias("platform"), F.lit("Legacy").alias("industry"),
        F.lit("old").alias("tags"),
        F.array(F.lit("Legacy")).alias("platforms"), F.array(F.lit("Legacy")).alias("industries"),
        (pid.cast("double") / F.lit(10.0)).alias("heat_score"),
        F.create_map(F.lit("owner"), F.lit("import-test")).alias("site_metadata"),
        (as_of_col() - F.make_dt_interval(F.lit(100))).alias("created_at"),
        (as_of_col() - F.make_dt_interval(F.pmod(pid, F.lit(50)))).alias("last_used_at"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag feedback for every page; every 20th has an unknown URL, every 35th blank tags."""
    p = table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    url = F.when(F.pmod(pid, F.lit(20)) == 0, F.concat(F.col("url"), F.lit("/unknown"))) \
        .otherwise(F.concat(F.lit(" "), F.col("url")))
    tags = F.when(F.pmod(pid, F.lit(35)) == 0, F.lit("   ")) \
        .otherwise(F.concat(F.lit("tag"), pid.cast("string"), F.lit(", extra ")))
    return p.select(pid.alias("feedback_id"), url.alias("website_url"), tags.alias("suggested_tags"),
                    (as_of_col() + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), pid)).alias("created_at"))


def url_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs to add, with seeded bad forms by page_id mod 6: padded, no scheme,
    upper-case scheme, ftp, 2,049+ characters."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    m = F.pmod(F.col("page_id"), F.lit(6))
    bare = F.regexp_replace("url", "^https?://", "")
    u = (F.when(m == 1, F.concat(F.lit("  "), F.col("url"), F.lit(" ")))
         .when(m == 2, bare)
         .when(m == 3, F.concat(F.lit("HTTP://"), bare))
         .when(m == 4, F.concat(F.lit("ftp://"), bare))
         .when(m == 5, F.concat(F.col("url"), F.lit("/"), F.repeat(F.lit("a"), 2048)))
         .otherwise(F.col("url")))
    return p.select((F.col("page_id") + 2).cast("long").alias("row_no"), "page_id", u.alias("url"))
