"""Catalog maintenance as DataFrame -> DataFrame functions.

Plain Parquet has no MERGE, so every write is a pure function
``(target, batch) -> (new_target, report)``; the caller saves ``new_target`` to
a new path (or a table format with MERGE).  Reports carry one row per batch row:
``row_no, website_url, outcome, error`` with outcome in inserted / updated /
skipped / error.

Batch duplicates are resolved with a minimum or maximum per URL
(partial aggregation), never with a window over the URL, so a URL repeated in a
third of the batch does not land in one task.  Target lookups are equi-joins on
the URL; adaptive execution splits skewed join partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.parse import as_of_col
from pyspark.sql import types as T

from sitelens.functions import (
    decode_json_array,
    decode_json_map,
    decode_json_struct,
    normalize_url,
    parse_ts,
    strip_ws,
    validate_url,
)
from sitelens.functions.parse import COLORS_TYPE, SIGNALS_TYPE

# FIXED VALUES: outcome messages.
MSG_EMPTY_URL = "Empty URL"
MSG_EXISTS = "Site already exists"
MSG_DUPLICATE = "Duplicate in batch"
MSG_ROW_LIMIT = "CSV exceeds 500-row limit"
MSG_TOO_LARGE = "File too large (max 5 MB)"
MSG_FETCH_FAILED = "Failed to fetch {url}"
MSG_BAD_JSON = "Invalid JSON in {col}"
MAX_UPLOAD_ROWS = 500
MAX_UPLOAD_BYTES = 5 * 1024 * 1024

ENRICHED_COLUMNS = ["platforms", "industries", "colors", "tag_confidence",
                    "enrichment_signals", "last_enriched_at"]

SITES_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("website_url", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("industry", T.StringType()),
    T.StructField("tags", T.StringType()),
    T.StructField("industries", T.ArrayType(T.StringType())),
    T.StructField("platforms", T.ArrayType(T.StringType())),
    T.StructField("colors", T.StructType([T.StructField("primary", T.StringType()),
                                          T.StructField("secondary", T.StringType())])),
    T.StructField("tag_confidence", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("last_enriched_at", T.TimestampNTZType()),
    T.StructField("enrichment_signals", T.StructType([
        T.StructField("platform_scores", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("industry_scores", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("colors", T.StructType([T.StructField("primary", T.StringType()),
                                              T.StructField("secondary", T.StringType())]))])),
    T.StructField("last_used_at", T.TimestampNTZType()),
    T.StructField("heat_score", T.DoubleType()),
    T.StructField("site_metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

REPORT_COLUMNS = ["row_no", "website_url", "outcome", "error"]


def _as_of(as_of) -> Column:
    return as_of_col(as_of)


def site_id(url: Column) -> Column:
    """Stable surrogate key of a site: a 64-bit hash of its URL."""
    return F.xxhash64(url)


# ---------------------------------------------------------------------------
# schema
# ---------------------------------------------------------------------------

def ensure_columns(df: DataFrame, schema: T.StructType = SITES_SCHEMA) -> DataFrame:
    """Add every column of ``schema`` that ``df`` lacks, as a typed NULL (idempotent)."""
    have = set(df.columns)
    out = df
    for f in schema.fields:
        if f.name not in have:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    return out


def conform(df: DataFrame, schema: T.StructType = SITES_SCHEMA) -> DataFrame:
    """Columns of ``schema`` in order, cast; missing ones NULL."""
    full = ensure_columns(df, schema)
    return full.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def detect_import_mode(columns: list[str]) -> str:
    """'missing_url' when there is no website_url column; 'pre_enriched' when all
    six enriched columns are present; else 'enrich'."""
    cols = set(columns)
    if "website_url" not in cols:
        return "missing_url"
    if set(ENRICHED_COLUMNS) <= cols:
        return "pre_enriched"
    return "enrich"


# ---------------------------------------------------------------------------
# row checks
# ---------------------------------------------------------------------------

def apply_batch_limit(batch: DataFrame, max_rows: int | None = None,
                      max_bytes: int | None = None) -> DataFrame:
    """Upload limits, both off by default (an upload form passes MAX_UPLOAD_ROWS and MAX_UPLOAD_BYTES).

    Rows: keep data rows with row_no - 2 < max_rows; the rows after the limit
    are replaced by one error row (row number max_rows + 2).  Size: when the
    batch carries ``source_file``/``source_bytes`` (``read_csv_rows`` adds them),
    every row of a file larger than ``max_bytes`` is replaced by one error row
    for that file.  ``None`` turns a limit off.  Per file when ``source_file``
    is present, else for the whole batch.
    """
    out = batch.withColumn("_limit_error", F.lit(None).cast("string"))
    per_file = "source_file" in batch.columns
    keys = ["source_file"] if per_file else []
    if max_bytes is not None and "source_bytes" in batch.columns:
        big = F.col("source_bytes") > max_bytes
        rejected = (out.filter(big).groupBy(*keys).agg(F.min("row_no").alias("row_no"))
                    .select(*keys, "row_no", F.lit("").alias("website_url"),
                            F.lit(MSG_TOO_LARGE).alias("_limit_error")))
        out = out.filter(~big).unionByName(rejected, allowMissingColumns=True)
    if max_rows is not None:
        limit_row = max_rows + 2
        over = F.col("row_no") >= limit_row
        extra = (out.filter(over & F.col("_limit_error").isNull()).groupBy(*keys)
                 .agg(F.count(F.lit(1)).alias("_n"))
                 .select(*keys, F.lit(limit_row).cast("long").alias("row_no"),
                         F.lit("").alias("website_url"), F.lit(MSG_ROW_LIMIT).alias("_limit_error")))
        out = out.filter(~over | F.col("_limit_error").isNotNull()) \
            .unionByName(extra, allowMissingColumns=True)
    return out


def _decode(batch: DataFrame, strict: bool) -> DataFrame:
    """Decode the enriched text columns; in strict mode a bad JSON value is an error."""
    def txt(c):
        return F.col(c) if c in batch.columns else F.lit(None).cast("string")
    dec = {
        "platforms": decode_json_array(txt("platforms")),
        "industries": decode_json_array(txt("industries")),
        "colors": decode_json_struct(txt("colors"), COLORS_TYPE),
        "tag_confidence": decode_json_map(txt("tag_confidence")),
        "enrichment_signals": decode_json_struct(txt("enrichment_signals"), SIGNALS_TYPE),
    }
    out = batch
    for c, e in dec.items():
        out = out.withColumn("_d_" + c, e)
    out = out.withColumn("_d_last_enriched_at", parse_ts(txt("last_enriched_at")))
    err = F.lit(None).cast("string")
    if strict:
        for c in dec:
            raw = txt(c)
            valid = F.when(raw.isNull() | (F.length(strip_ws(raw)) == 0), F.lit(True)) \
                .otherwise(F.try_parse_json(raw).isNotNull())
            err = F.when(err.isNull() & ~valid, F.lit(MSG_BAD_JSON.format(col=c))).otherwise(err)
    return out.withColumn("_json_error", err)


def _site_rows(dec: DataFrame, as_of: Column) -> DataFrame:
    """Catalog rows built from a decoded batch."""
    def txt(c):
        return F.coalesce(F.col(c), F.lit("")) if c in dec.columns else F.lit("")
    return dec.select(
        site_id(F.col("_url")).alias("id"),
        F.col("_url").alias("website_url"),
        txt("platform").alias("platform"), txt("industry").alias("industry"),
        txt("tags").alias("tags"),
        F.col("_d_industries").alias("industries"), F.col("_d_platforms").alias("platforms"),
        F.col("_d_colors").alias("colors"), F.col("_d_tag_confidence").alias("tag_confidence"),
        F.col("_d_last_enriched_at").alias("last_enriched_at"),
        F.col("_d_enrichment_signals").alias("enrichment_signals"),
        F.lit(None).cast("timestamp_ntz").alias("last_used_at"),
        F.lit(None).cast("double").alias("heat_score"),
        F.lit(None).cast("map<string,string>").alias("site_metadata"),
        as_of.alias("created_at"), as_of.alias("updated_at"))


# ---------------------------------------------------------------------------
# D1 / D2 insert if absent
# ---------------------------------------------------------------------------

def _classify(batch: DataFrame, target: DataFrame, mode: str) -> DataFrame:
    """Add _url and outcome/error for insert-if-absent semantics.

    The first copy of a URL without a JSON error (``_json_error``, if the batch
    has that column) is inserted.  Batch order is (source_file, row_no) when the
    batch comes from several files (row numbers restart per file), else row_no.
    Rows without a URL don't take part in the joins, and of the target only the
    batch's URLs.
    """
    b = batch.withColumn("_url", strip_ws(F.coalesce(F.col("website_url"), F.lit(""))))
    order = (F.struct(F.col("source_file"), F.col("row_no")) if "source_file" in batch.columns
             else F.col("row_no"))
    json_err = F.col("_json_error") if "_json_error" in b.columns else F.lit(None).cast("string")
    limit_err = F.col("_limit_error") if "_limit_error" in b.columns else F.lit(None).cast("string")
    b = b.withColumn("_order", order)
    named, blank = b.filter(F.length("_url") > 0), b.filter(F.length("_url") == 0)
    urls = named.groupBy("_url").agg(F.min(F.when(json_err.isNull(), F.col("_order"))).alias("_chosen"))
    existing = (target.select(F.col("website_url").alias("_url")).join(urls.select("_url"), "_url", "left_semi")
                .distinct().withColumn("_exists", F.lit(True)))
    j = named.join(urls.join(existing, "_url", "left"), "_url", "left").unionByName(blank, allowMissingColumns=True)
    exists = F.coalesce(F.col("_exists"), F.lit(False))
    dup = F.coalesce(F.col("_order") > F.col("_chosen"), F.lit(False))
    skip_kind = "error" if mode == "upload" else "skipped"
    outcome = (F.when(limit_err.isNotNull(), "error")
               .when(F.length("_url") == 0, "error")
               .when(exists, skip_kind)
               .when(dup, skip_kind)
               .when(json_err.isNotNull(), "error")
               .otherwise("inserted"))
    error = (F.when(limit_err.isNotNull(), limit_err)
             .when(F.length("_url") == 0, F.lit(MSG_EMPTY_URL))
             .when(exists, F.lit(MSG_EXISTS))
             .when(dup, F.lit(MSG_EXISTS if mode == "upload" else MSG_DUPLICATE))
             .otherwise(json_err))
    return j.withColumn("outcome", outcome).withColumn("error", error)


def _report(c: DataFrame) -> DataFrame:
    """row_no, website_url, outcome, error (+ source_file when the batch has it)."""
    cols = (["source_file"] if "source_file" in c.columns else []) + ["row_no"]
    return c.select(*cols, F.col("_url").alias("website_url"), "outcome", "error")


def insert_ignore(target: DataFrame, batch: DataFrame, as_of=None):
    """Insert batch rows whose URL is new; the first copy in the batch wins.

    ``batch``: row_no, website_url (+ any catalog columns).  Returns
    ``(new_target, report)``.
    """
    c = _classify(batch, target, "bulk")
    ins = c.filter(F.col("outcome") == "inserted")
    new_rows = conform(ins.drop("website_url").withColumnRenamed("_url", "website_url")
                       .withColumn("id", site_id(F.col("website_url")))
                       .withColumn("created_at", _as_of(as_of)).withColumn("updated_at", _as_of(as_of)))
    new_target = conform(target).unionByName(new_rows)
    return new_target, _report(c)


def import_new_rows(target: DataFrame, batch: DataFrame, mode: str = "bulk", as_of=None,
                    max_rows: int | None = None, max_bytes: int | None = None):
    """The rows an import would add, and its report: ``(new_rows, report)``.

    ``target`` only needs a ``website_url`` column (the existence check).
    """
    b = apply_batch_limit(batch, max_rows, max_bytes)
    c = _classify(_decode(b, strict=(mode == "upload")), target, mode)
    new_rows = _site_rows(c.filter(F.col("outcome") == "inserted"), _as_of(as_of))
    return new_rows, _report(c)


def import_enriched(target: DataFrame, batch: DataFrame, mode: str = "bulk", as_of=None,
                    max_rows: int | None = None, max_bytes: int | None = None):
    """Import pre-enriched rows (text columns, JSON as text) if their URL is new.

    mode 'bulk': bad JSON -> empty value, bad timestamp -> NULL, existing or
    repeated URL -> skipped.  mode 'upload': bad JSON fails the row, existing or
    repeated URL is an error ("Site already exists").  ``max_rows`` applies the
    upload row limit and ``max_bytes`` the file size limit.  Returns
    ``(new_target, report)``.
    """
    new_rows, report = import_new_rows(target, batch, mode, as_of, max_rows, max_bytes)
    return conform(target).unionByName(new_rows), report


def import_stats(report: DataFrame) -> DataFrame:
    """One row: imported, skipped, errors, total (A5)."""
    o = F.col("outcome")
    return report.agg(F.count_if(o == "inserted").alias("imported"),
                      F.count_if(o == "skipped").alias("skipped"),
                      F.count_if(o == "error").alias("errors"),
                      F.count(F.lit(1)).alias("total"))


def import_errors(report: DataFrame) -> DataFrame:
    """Per-row error list: row, url, error (A6)."""
    return report.filter(F.col("outcome") == "error").select(
        F.col("row_no").alias("row"), F.col("website_url").alias("url"), "error")


# ---------------------------------------------------------------------------
# D3 upsert
# ---------------------------------------------------------------------------

UPSERT_COLUMNS = ["platform", "industry", "tags", "platforms", "industries", "colors",
                  "tag_confidence", "enrichment_signals", "last_enriched_at"]


def upsert_sites(target: DataFrame, records: DataFrame, as_of=None):
    """Upsert enrichment records by URL: the 9 enrichment columns are replaced, all
    other catalog columns kept; new URLs are inserted.  When a URL repeats in
    ``records`` the one with the largest ``row_no`` (unique, required) wins, as the
    last write does.  Returns ``(new_target, report)``; the report has a row for
    every record: inserted, updated, skipped (an older copy) or error (no URL).
    """
    if "row_no" not in records.columns:
        raise ValueError("upsert_sites needs a row_no column: it decides which copy of a URL wins")
    ts = _as_of(as_of)
    recs = records.withColumn("_url", strip_ws(F.coalesce(F.col("website_url"), F.lit(""))))
    named = recs.filter(F.length("_url") > 0)
    newest = named.groupBy("_url").agg(F.max("row_no").alias("row_no"))
    payload = F.struct(*[F.col(c).alias(c) for c in UPSERT_COLUMNS if c in recs.columns], F.col("row_no"))
    last = named.join(newest, ["_url", "row_no"]).select(F.col("_url").alias("website_url"), payload.alias("_r"))
    tgt = conform(target)
    j = tgt.join(last, "website_url", "full_outer")
    has_rec = F.col("_r").isNotNull()
    cols = []
    for f in SITES_SCHEMA.fields:
        c = f.name
        if c == "website_url":
            cols.append(F.col(c))
        elif c in UPSERT_COLUMNS and c in recs.columns:
            cols.append(F.when(has_rec, F.col("_r." + c).cast(f.dataType))
                        .otherwise(F.col(c)).alias(c))
        elif c == "last_enriched_at":
            cols.append(F.when(has_rec, ts).otherwise(F.col(c)).alias(c))
        elif c == "id":
            cols.append(F.coalesce(F.col("id"), site_id(F.col("website_url"))).alias(c))
        elif c == "created_at":
            cols.append(F.coalesce(F.col(c), ts).alias(c))
        elif c == "updated_at":
            cols.append(F.when(has_rec, ts).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    new_target = j.select(*cols)
    known = (target.select(F.col("website_url").alias("_url")).join(newest.select("_url"), "_url", "left_semi")
             .distinct().withColumn("_known", F.lit(True)))
    state = newest.select("_url", F.col("row_no").alias("_newest")).join(known, "_url", "left")
    rows = named.select("row_no", "_url").join(state, "_url", "left")
    older = F.col("row_no") < F.col("_newest")
    report = rows.select(
        "row_no", F.col("_url").alias("website_url"),
        F.when(older, "skipped").when(F.col("_known"), "updated").otherwise("inserted").alias("outcome"),
        F.when(older, MSG_DUPLICATE).alias("error"))
    blank = recs.filter(F.length("_url") == 0).select("row_no", F.col("_url").alias("website_url"),
                                                      F.lit("error").alias("outcome"), F.lit(MSG_EMPTY_URL).alias("error"))
    return new_target, report.unionByName(blank)


# ---------------------------------------------------------------------------
# S10 feedback
# ---------------------------------------------------------------------------

def resolve_feedback(feedback: DataFrame, sites: DataFrame, as_of=None) -> DataFrame:
    """Feedback rows with the site resolved by URL.

    Blank URL or blank tags -> status 'ignored' (not stored); else 'ok' with
    site_id NULL when the URL is not in the catalog.  Output: site_id,
    website_url, suggested_tags, created_at, status.
    """
    f = feedback.select(
        "*", strip_ws(F.coalesce(F.col("website_url"), F.lit(""))).alias("_url"),
        strip_ws(F.coalesce(F.col("suggested_tags"), F.lit(""))).alias("_tags"))
    ok = (F.length("_url") > 0) & (F.length("_tags") > 0)
    s = sites.select(F.col("website_url").alias("_url"), F.col("id").alias("site_id"))
    j = f.join(s, "_url", "left")
    created = F.col("created_at") if "created_at" in feedback.columns else _as_of(as_of)
    return j.select(F.when(ok, F.col("site_id")).alias("site_id"),
                    F.col("_url").alias("website_url"),
                    F.col("_tags").alias("suggested_tags"),
                    created.alias("created_at"),
                    F.when(ok, F.lit("ok")).otherwise(F.lit("ignored")).alias("status"))


# ---------------------------------------------------------------------------
# D8 migration
# ---------------------------------------------------------------------------

def migrate_sites(raw: DataFrame, as_of=None, dry_run: bool = False):
    """JSON-text catalog -> typed catalog, stamped with ``migrated_at``.

    Rows with a blank URL fail.  Returns ``(migrated, reconcile)`` where
    reconcile is one row: source_rows, migrated_rows, failed_rows, dry_run.
    With ``dry_run`` the migrated frame is empty but the counts are computed.
    """
    ts = _as_of(as_of)
    b = raw.withColumn("_url", strip_ws(F.coalesce(F.col("website_url"), F.lit(""))))
    dec = _decode(b, strict=False)
    good = dec.filter(F.length("_url") > 0)
    rows = _site_rows(good, ts)
    stamp = F.create_map(F.lit("migrated_at"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    migrated = rows.withColumn("site_metadata", stamp)
    if dry_run:
        migrated = migrated.filter(F.lit(False))
    recon = dec.agg(F.count(F.lit(1)).alias("source_rows"),
                    F.count_if(F.length("_url") > 0).alias("migrated_rows"),
                    F.count_if(F.length("_url") == 0).alias("failed_rows")) \
        .withColumn("dry_run", F.lit(dry_run))
    return migrated, recon


# ---------------------------------------------------------------------------
# H7 enrichment with outcome
# ---------------------------------------------------------------------------

def enrich_batch(requests: DataFrame, pages: DataFrame, dicts=None, as_of=None,
                 on_missing: str = "error"):
    """Validate -> normalise -> look up the crawled page -> enrich.

    ``requests``: row_no (unique), url.  ``pages``: url, html (the crawl; NULL or
    empty html = failed fetch).  Of several crawls of one URL the latest counts:
    the largest ``crawled_at``, else the largest ``page_id``, else the largest html.  Returns ``(good, errors)``: good = enrichment records
    (+ row_no); errors = row_no, url, error.  With ``on_missing='empty'`` a
    failed fetch still yields an (Unknown) record, as the offline tool does.
    """
    from sitelens.dictionaries import DEFAULT
    from sitelens.operators.enrich import enrich_pages

    dicts = dicts or DEFAULT
    r = requests.select("row_no", F.col("url").alias("_in"),
                        validate_url(F.col("url")).alias("_verr"),
                        normalize_url(F.col("url")).alias("_norm"))
    valid, invalid = r.filter(F.col("_verr").isNull()), r.filter(F.col("_verr").isNotNull())
    when = next((c for c in ("crawled_at", "page_id") if c in pages.columns), "html")
    p = pages.select(F.col("url").alias("_norm"), F.col("html").alias("_html"), F.col(when).alias("_when"))
    p = (p.join(valid.select("_norm").distinct(), "_norm", "left_semi").groupBy("_norm")
         .agg(F.max_by("_html", F.struct("_when", "_html")).alias("_html")))
    j = valid.join(p, "_norm", "left").unionByName(invalid, allowMissingColumns=True)
    fetched = F.col("_html").isNotNull() & (F.length("_html") > 0)
    err = (F.when(F.col("_verr").isNotNull(), F.col("_verr"))
           .when(~fetched & F.lit(on_missing == "error"),
                 F.concat(F.lit("Failed to fetch "), F.col("_norm"))))
    j = j.withColumn("_err", err)
    errors = j.filter(F.col("_err").isNotNull()).select(
        "row_no", F.col("_in").alias("url"), F.col("_err").alias("error"))
    ok = j.filter(F.col("_err").isNull()).select(
        "row_no", F.col("_norm").alias("url"), F.coalesce(F.col("_html"), F.lit("")).alias("html"))
    good = enrich_pages(ok, dicts=dicts, as_of=as_of, key="row_no")
    return good, errors


def import_urls(target: DataFrame, requests: DataFrame, pages: DataFrame, dicts=None, as_of=None):
    """A raw list of URLs into the catalog: validate, look up the crawl, enrich, upsert.

    Returns ``(new_target, report)`` with one report row per request.
    """
    good, errors = enrich_batch(requests, pages, dicts=dicts, as_of=as_of)
    new_target, done = upsert_sites(target, good, as_of=as_of)
    failed = errors.select("row_no", F.col("url").alias("website_url"), F.lit("error").alias("outcome"), "error")
    return new_target, done.unionByName(failed)
