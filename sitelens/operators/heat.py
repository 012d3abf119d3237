"""Popularity (heat) and usage: reports, usage roll-up, quotas, roll-back, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions.parse import as_of_col

from sitelens.functions import days_between, py_round
from sitelens.operators.layout import global_positions

HOT_MIN = 70.0
WARM_MIN = 30.0
STALE_DAYS = 30
SEEDED_KEY = "seeded_at"
# FIXED VALUE: the literal placeholder the roll-back compares a marker-only map to.
ROLLBACK_PLACEHOLDER = "..."


def _as_of(as_of) -> Column:
    return as_of_col(as_of)


def heat_report(sites: DataFrame) -> DataFrame:
    """One row: total, seeded (heat not 0 / NULL), hot >= 70, warm [30, 70), cold [0, 30)
    and their percentages (seeded of total; bands of seeded), 1 decimal, Python rounding.
    A zero denominator gives NULL."""
    h = F.col("heat_score")
    agg = sites.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if((h > 0) | (h < 0)).alias("seeded"),
        F.count_if(h >= HOT_MIN).alias("hot"),
        F.count_if((h >= WARM_MIN) & (h < HOT_MIN)).alias("warm"),
        F.count_if((h >= 0) & (h < WARM_MIN)).alias("cold"))

    def pct(num, den):
        ratio = F.try_divide(F.col(num).cast("double"), F.col(den).cast("double"))
        return py_round(ratio * F.lit(100.0), 1)

    return agg.select("*", pct("seeded", "total").alias("seeded_pct"),
                      pct("hot", "seeded").alias("hot_pct"),
                      pct("warm", "seeded").alias("warm_pct"),
                      pct("cold", "seeded").alias("cold_pct"))


def heat_top(sites: DataFrame, n: int = 5, as_of=None) -> DataFrame:
    """Top ``n`` sites with heat > 0 (heat desc, id), with whole days since last use."""
    top = (sites.filter(F.col("heat_score") > 0)
           .orderBy(F.col("heat_score").desc(), F.col("id").asc()).limit(n))
    w = Window.orderBy(F.col("heat_score").desc(), F.col("id").asc())
    return top.select(F.row_number().over(w).cast("long").alias("rank"), "id", "website_url",
                      "heat_score",
                      days_between(_as_of(as_of), F.col("last_used_at")).alias("days_since_use"))


def apply_usage(sites: DataFrame, usage: DataFrame, site_col: str = "site_id", ts_col: str = "ts",
                amount_col: str = "amount") -> DataFrame:
    """Fold a usage log into the catalog.

    last_used_at = latest of the stored value and the newest event; heat_score =
    coalesce(stored, 0) + sum(amount); heat stays where all amounts are NULL.  Sites
    without events are unchanged.  The
    log is pre-aggregated per site (partial aggregation before the shuffle, so a
    site holding a large share of events costs one row per map task).
    """
    agg = (usage.groupBy(F.col(site_col).alias("_sid"))
           .agg(F.max(ts_col).alias("_ts"), F.sum(amount_col).alias("_amt")))
    j = sites.join(agg, sites["id"] == agg["_sid"], "left")
    lu = F.greatest(F.col("last_used_at"), F.col("_ts"))
    heat = F.when(F.col("_amt").isNotNull(),
                  F.coalesce(F.col("heat_score"), F.lit(0.0)) + F.col("_amt")).otherwise(F.col("heat_score"))
    cols = [lu.alias(c) if c == "last_used_at" else heat.alias(c) if c == "heat_score" else F.col(c)
            for c in sites.columns]
    return j.select(*cols)


def usage_from_results(results: DataFrame, as_of=None, id_col: str = "id") -> DataFrame:
    """Usage rows for the sites that a search returned: site_id, ts, amount.

    Each returned site is touched once: its last use becomes ``as_of``, its
    heat doesn't change (amount NULL).  Feed the rows to ``apply_usage``.
    """
    return (results.select(F.col(id_col).alias("site_id")).filter(F.col("site_id").isNotNull()).distinct()
            .select("site_id", _as_of(as_of).alias("ts"), F.lit(None).cast("double").alias("amount")))


def quota_buckets(sites: DataFrame, hot: float = 0.2, warm: float = 0.5, n: int | None = None,
                  seed: int | None = None) -> DataFrame:
    """Assign unseeded sites (heat NULL or 0) to hot / warm / cold by position.

    The first max(1, floor(hot*n)) positions are hot, the next max(1, floor(warm*n))
    warm, the rest cold; n = requested count, default all unseeded sites.  Order:
    by ``xxhash64(id, seed)`` (a reproducible shuffle) or by id when seed is None.
    Output: id, pos, bucket.
    """
    cand = sites.filter(F.col("heat_score").isNull() | (F.col("heat_score") == 0)).select("id")
    order = [F.col("id")] if seed is None else [F.xxhash64(F.col("id"), F.lit(seed)), F.col("id")]
    pos = global_positions(cand, order)
    total = cand.agg(F.count(F.lit(1)).alias("c")).select("c").scalar()
    req = F.lit(n).cast("long") if n is not None else total
    hot_n = F.greatest(F.lit(1), F.floor(req * F.lit(hot)))
    warm_n = F.greatest(F.lit(1), F.floor(req * F.lit(warm)))
    bucket = (F.when(F.col("pos") <= hot_n, "hot")
              .when(F.col("pos") <= hot_n + warm_n, "warm").otherwise("cold"))
    out = pos.withColumn("bucket", bucket)
    if n is not None:
        out = out.filter(F.col("pos") <= n)
    return out.select("id", "pos", "bucket")


def mark_buckets(sites: DataFrame, buckets: DataFrame, as_of=None, key: str = SEEDED_KEY) -> DataFrame:
    """Give the sites of ``quota_buckets`` the lowest heat of their band and mark them with ``site_metadata[key]``
    (the time), so that ``rollback_marked`` can undo it; other sites are unchanged."""
    ts = _as_of(as_of)
    b = buckets.select(F.col("id").alias("_bid"), F.col("bucket").alias("_bucket"))
    own = F.col("_bucket")
    heat = F.when(own == "hot", HOT_MIN).when(own == "warm", WARM_MIN).otherwise(0.0)
    rest = F.map_filter(F.coalesce(F.col("site_metadata"), F.create_map().cast("map<string,string>")), lambda k, v: k != key)
    marker = F.create_map(F.lit(key), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    new = {"heat_score": heat, "last_used_at": ts, "site_metadata": F.map_concat(rest, marker)}
    return sites.join(b, sites["id"] == b["_bid"], "left").select(
        *[F.when(own.isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in sites.columns])


def rollback_marked(sites: DataFrame, key: str = SEEDED_KEY) -> DataFrame:
    """Undo seeded heat: where ``site_metadata[key]`` is set, heat = 0, last_used_at =
    NULL and the key is removed (a map holding only the placeholder marker -> NULL)."""
    meta = F.col("site_metadata")
    marked = F.try_element_at(meta, F.lit(key)).isNotNull()
    only_marker = (F.size(meta) == 1) & (F.try_element_at(meta, F.lit(key)) == ROLLBACK_PLACEHOLDER)
    new_meta = F.when(only_marker, F.lit(None)).otherwise(F.map_filter(meta, lambda k, v: k != key))
    repl = {
        "heat_score": F.when(marked, F.lit(0.0)).otherwise(F.col("heat_score")),
        "last_used_at": F.when(marked, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("last_used_at")),
        "site_metadata": F.when(marked, new_meta).otherwise(meta),
    }
    return sites.select(*[repl[c].alias(c) if c in repl else F.col(c) for c in sites.columns])


def needs_reenrichment(ts: Column, as_of=None, days: int = STALE_DAYS) -> Column:
    """Never enriched, or at least ``days`` whole days ago."""
    return ts.isNull() | (days_between(_as_of(as_of), ts) >= days)


def stale_sites(sites: DataFrame, days: int = STALE_DAYS, as_of=None) -> DataFrame:
    return sites.filter(needs_reenrichment(F.col("last_enriched_at"), as_of, days))
