"""Language identification by Bayesian evidence fusion.

A page's language is judged from four independent pieces of evidence, whose log
likelihoods add up:

* *text*: hashed byte-trigram models of each language, counted over all
  labelled documents; the length-normalised likelihood is tempered, because
  trigrams of one text aren't independent;
* *declared*: the ``lang`` attribute of the markup;
* *suffix*: a language code in the address (first path segment, or the host's last label);
* *host prior*: how the other pages of the host, of its site and of the
  whole table look by their text, each level smoothed with the next wider one.

How far a declared or address code can be trusted is learned: soft counts of
(code, language by text) are grouped over the table and smoothed.  All tables
of counts come from grouped aggregations with partial sums, so a host with a
third of all pages is one row per task.  A page's own text is taken
out of its host's counts.

Edge cases: NULL html or url is empty; a page without text, code and host gets the
global prior; with no labelled documents no language is known and ``lang`` is NULL;
repeated rows are judged alike; equal posteriors go to the alphabetically first
language; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import lower_ascii, mix, staged, text_chunks

BUCKETS = 1 << 14
TEMPER = 40.0  # a text counts as at most this many independent trigrams
SMOOTH = 5.0


def trigrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the byte trigrams of each text, letters lower-cased and white space as one blank class."""
    b = lower_ascii(buf)
    b = np.where((b == 32) | ((b >= 9) & (b <= 13)), 32, b).astype(np.uint64)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = (mix(b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]) & np.uint64(BUCKETS - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    ok = row[2:] == row[:-2]
    return row[2:][ok], h[ok]


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all documents with a language."""
    docs = docs.filter("lang is not null").select(F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        total = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lo, hi, buf, off in text_chunks(batch):
                row, bucket = trigrams(buf, off)
                names, code = np.unique(langs[lo:hi].astype(str), return_inverse=True)
                counts = np.bincount(code[row] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for name, c in zip(names.tolist(), counts):
                    total[name] = total.get(name, 0) + c
        for name, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(c[at])], names=["lang", "bucket", "n"])

    return docs.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log P(bucket | language); the table has BUCKETS numbers for each language, whatever the corpus."""
    counts = {}
    for r in count_trigrams(docs).toLocalIterator():
        counts.setdefault(r["lang"], np.zeros(BUCKETS))[r["bucket"]] = r["n"]
    langs = sorted(counts)
    table = np.array([np.log((counts[x] + 0.5) / (counts[x].sum() + 0.5 * BUCKETS)) for x in langs]).reshape(len(langs), BUCKETS)
    return langs, table


def text_likelihood(texts: DataFrame, table: np.ndarray, key: str) -> DataFrame:
    """(key, text_ll): tempered log likelihood of the text under each language, best 0."""

    def run(batches):
        for batch in batches:
            ids = batch.column(key)
            for lo, hi, buf, off in text_chunks(batch):
                row, bucket = trigrams(buf, off)
                n = np.bincount(row, minlength=hi - lo)
                ll = np.array([np.bincount(row, t[bucket], minlength=hi - lo) for t in table]).reshape(len(table), hi - lo).T
                ll *= (np.minimum(n, TEMPER) / np.maximum(n, 1))[:, None]
                ll -= ll.max(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(list(ll), pa.list_(pa.float64()))], names=[key, "text_ll"])

    return texts.mapInArrow(run, f"{key} long, text_ll array<double>")


def parse(pages: DataFrame) -> DataFrame:
    """(page_id, text, host, site, declared, suffix) from page_id, url and html."""
    html, url = F.coalesce("html", F.lit("")), F.lower(F.coalesce("url", F.lit("")))
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    code = lambda c: F.nullif(F.lower(c), F.lit(""))
    path = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]*/([a-z]{2})(?:[-_][a-z]{2})?(?:[/?#]|$)", 1)
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(text, r"(?s)<[^>]*>", " ").alias("text"), F.nullif(host, F.lit("")).alias("host"),
        F.nullif(F.substring_index(host, ".", -2), F.lit("")).alias("site"), code(F.regexp_extract(html, r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)).alias("declared"),
        F.coalesce(code(path), code(F.regexp_extract(host, r"\.([a-z]{2})$", 1))).alias("suffix"))


def _normalised(col):
    """Log weights to chances."""
    e = F.transform(col, lambda x: F.exp(x - F.array_max(col)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _sums(n: int, value: str = "soft"):
    """Element-wise sums of an array column of n numbers."""
    return F.array(*(F.sum(F.coalesce(F.col(value)[i], F.lit(0.0))) for i in range(n)))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, host, declared, suffix, text_lang, lang, posterior) for every page."""
    langs, table = train(docs)
    parsed = parse(pages)
    if not langs:
        null = F.lit(None).cast("string")
        return parsed.select("page_id", "host", "declared", "suffix", null.alias("text_lang"), null.alias("lang"), F.lit(None).cast("double").alias("posterior"))
    n = len(langs)
    keyed = staged(parsed.withColumn("row", F.monotonically_increasing_id()), "pages-parsed")
    text = text_likelihood(keyed.select("row", "text"), table, "row")
    rows = staged(keyed.drop("text").join(text, "row").withColumn("soft", _normalised(F.col("text_ll"))), "pages-text")

    total = rows.agg(_sums(n).alias("total")).select(F.transform("total", lambda x: (x + 1.0)).alias("total"))
    total = np.array(total.first()[0], float)
    base = total / total.sum()

    def trust(column: str) -> DataFrame:
        """log P(code | language) for every code seen, from soft counts."""
        seen = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(_sums(n).alias("by"))
        return seen.select(column, F.array(*(F.log((F.col("by")[i] + SMOOTH * 0.02) / (float(total[i]) + SMOOTH)) for i in range(n))).alias(f"{column}_ll"))

    def widen(own, parent):
        return F.array(*((own[i] + SMOOTH * parent[i]) for i in range(n)))

    def share(col):
        return F.transform(col, lambda x: x / F.aggregate(col, F.lit(0.0), lambda a, b: a + b))

    base_col = F.array(*(F.lit(float(x)) for x in base))
    site = rows.filter("site is not null").groupBy("site").agg(_sums(n).alias("site_n"))
    host = rows.filter("host is not null").groupBy("host").agg(_sums(n).alias("host_n"))
    zero = F.array(*([F.lit(0.0)] * n))
    less = lambda c: F.zip_with(F.coalesce(F.col(c), zero), F.coalesce("soft", zero), lambda x, y: F.greatest(x - y, F.lit(0.0)))
    joined = rows.join(site, "site", "left").join(host, "host", "left").join(trust("declared"), "declared", "left").join(trust("suffix"), "suffix", "left")
    joined = joined.withColumn("site_p", share(widen(F.when(F.col("site").isNotNull(), less("site_n")).otherwise(zero), base_col)))
    joined = joined.withColumn("prior", share(widen(F.when(F.col("host").isNotNull(), less("host_n")).otherwise(zero), F.col("site_p"))))
    none = F.coalesce
    logs = F.array(*(F.log(F.col("prior")[i]) + F.col("text_ll")[i] + none(F.col("declared_ll")[i], F.lit(0.0)) + none(F.col("suffix_ll")[i], F.lit(0.0)) for i in range(n)))
    names = F.array(*(F.lit(x) for x in langs))
    best = joined.withColumn("p", _normalised(logs))
    pick = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return best.select("page_id", "host", "declared", "suffix", pick(F.col("text_ll")).alias("text_lang"), pick(F.col("p")).alias("lang"), F.array_max("p").alias("posterior"))
