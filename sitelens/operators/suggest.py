"""Autocomplete suggestions over platforms, industries and tags.

A value is suggested when the normalised partial (at least 2 characters) occurs
in its normalised form; values are counted per distinct raw value (so 'SaaS'
and 'saas' are two values) and ranked by count desc, then value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import norm, strip_ws

MIN_PARTIAL = 2
DEFAULT_K = 5


def label_values(sites: DataFrame) -> DataFrame:
    """One row per label occurrence: platforms, industries and stripped tags."""
    empty = F.array().cast("array<string>")
    tags = F.filter(F.transform(F.split(F.coalesce(F.col("tags"), F.lit("")), ","), strip_ws),
                    lambda t: F.length(t) > 0)
    vals = F.concat(F.coalesce(F.col("platforms"), empty), F.coalesce(F.col("industries"), empty), tags)
    return sites.select(F.explode(vals).alias("value")).filter(F.col("value").isNotNull())


def value_counts(sites: DataFrame) -> DataFrame:
    """(value, value_norm, n): occurrences per distinct raw value (partial aggregation)."""
    return (label_values(sites).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("value_norm", norm(F.col("value"))))


def suggest(sites: DataFrame, partial: str, k: int = DEFAULT_K) -> DataFrame:
    """Top ``k`` suggestions for one partial: rank, value, n."""
    p = (partial or "").strip().lower()
    vals = label_values(sites)
    if len(p) < MIN_PARTIAL:
        return vals.select(F.lit(0).cast("long").alias("rank"), "value",
                           F.lit(0).cast("long").alias("n")).filter(F.lit(False))
    hits = (vals.filter(norm(F.col("value")).contains(p))
            .groupBy("value").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col("value").asc()).limit(k))
    w = Window.orderBy(F.col("n").desc(), F.col("value").asc())
    return hits.select(F.row_number().over(w).cast("long").alias("rank"), "value", "n")


def suggest_batch(sites: DataFrame, prefixes: DataFrame, k: int = DEFAULT_K,
                  col: str = "prefix") -> DataFrame:
    """Top ``k`` suggestions for every row of ``prefixes``: prefix, rank, value, n.

    Values are counted once over the catalog.  A prefix can only occur in a value
    that holds its first two characters: an equi-join on those, then the exact
    ``contains`` check.  The top-k per prefix uses a window limit.
    """
    counts = value_counts(sites)
    n = F.length("value_norm")
    pairs_of = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr("value_norm", i, F.lit(2)))
    counts = counts.select("*", F.explode(F.array_distinct(pairs_of)).alias("_gram"))
    ps = prefixes.select(F.col(col).alias("prefix"), norm(F.col(col)).alias("_p")).filter(F.length("_p") >= MIN_PARTIAL)
    ps = ps.withColumn("_gram", F.substr("_p", F.lit(1), F.lit(2)))
    pairs = counts.join(ps, "_gram").filter(F.col("value_norm").contains(F.col("_p")))
    w = Window.partitionBy("prefix").orderBy(F.col("n").desc(), F.col("value").asc())
    return (pairs.withColumn("rank", F.row_number().over(w).cast("long"))
            .filter(F.col("rank") <= k).select("prefix", "rank", "value", "n"))
