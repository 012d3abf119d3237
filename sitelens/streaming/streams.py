"""Structured Streaming versions of the catalog's per-event updates.

* ``usage_stream`` (T-2): usage events -> watermark -> drop repeated event ids
  -> per-site running max(ts) / sum(amount) in the state store (update mode) ->
  ``foreachBatch`` logs each batch's changed aggregates and merges the logs into a base now and then
  (``UsageSink``); ``usage_totals`` reads the newest aggregate per site.
* ``import_stream`` (T-3): CSV batches -> ``foreachBatch``: each batch checks its
  URLs against a key index of the catalog (``url_index``) and writes only its
  inserted rows (a delta) and its report; the catalog is never rewritten.
* ``feedback_stream`` (T-4): stream-static left join with the catalog, append.
* ``rate_limit_stream`` (T-1) lives in ``operators/ratelimit.py``.

Sinks are written under the shared folder (``spark.checkpoint.dir``); each
``foreachBatch`` write goes to a path named by the batch id with overwrite, so a
batch replayed after a failure is idempotent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions import strip_ws
from sitelens.operators import ingest as I
from sitelens.operators.heat import apply_usage
from sitelens.session import discard, entries
from sitelens.streaming.url_index import BUCKET_ROWS, RECENT_ROWS, UrlIndex


def read_if_written(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None where nothing has been written yet; any other failure is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


COMPACT_EVERY = 16  # batches


class UsageSink:
    """Running aggregates per site, written batch by batch and merged now and then.

    ``log/batch_id=b`` holds the sites that batch b changed.  Every ``every`` batches the newest row of each
    site, from the last base and the logs since, becomes a new base.  Two generations of the base take turns;
    ``pointer/generation=g`` tells up to which batch base g goes and is written after it, so a reader never follows
    an unfinished one.  A replayed batch starts from the newest base that ends before it, and merged logs go only when the next
    base but one is there.  A reader thus meets one row for each site and at most 2 * ``every`` logs.
    """

    def __init__(self, path: str, every: int = COMPACT_EVERY):
        self.path, self.every = path, every

    def _base(self, spark: SparkSession, before: int | None = None) -> tuple[int, int]:
        """(generation, last batch) of the newest base, if any that ends before a batch; (1, -1) for none."""
        told = read_if_written(spark, f"{self.path}/pointer") if entries(spark, f"{self.path}/pointer") else None
        found = [] if told is None else [(r["upto"], r["generation"]) for r in told.collect() if before is None or r["upto"] < before]
        upto, generation = max(found, default=(-1, 1))
        return generation, upto

    def _newest(self, spark: SparkSession, generation: int, upto: int, last: int | None = None) -> DataFrame:
        """The newest row of each site from a base and the logs after it."""
        logs = [n for n in entries(spark, f"{self.path}/log") if int(n.split("=")[1]) > upto and (last is None or int(n.split("=")[1]) <= last)]
        parts = [spark.read.parquet(f"{self.path}/log/{n}") for n in logs]
        if upto >= 0:
            parts.append(spark.read.parquet(f"{self.path}/base/generation={generation}"))
        raw = reduce(DataFrame.unionByName, parts)
        newest = raw.groupBy("site_id").agg(F.max_by(F.struct("ts", "amount", "n", "batch_id"), F.col("batch_id")).alias("a"))
        return newest.select("site_id", "a.ts", "a.amount", "a.n", "a.batch_id")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.path}/log/batch_id={batch_id}")
        generation, upto = self._base(spark, batch_id)
        if batch_id - upto < self.every:
            return
        new = 1 - generation
        self._newest(spark, generation, upto, batch_id).write.mode("overwrite").parquet(f"{self.path}/base/generation={new}")
        spark.createDataFrame([(batch_id,)], "upto long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/pointer/generation={new}")
        for name in entries(spark, f"{self.path}/log"):
            if int(name.split("=")[1]) <= upto:
                discard(spark, f"{self.path}/log/{name}")

    def totals(self, spark: SparkSession) -> DataFrame:
        return self._newest(spark, *self._base(spark)).drop("batch_id")


def usage_stream(events: DataFrame, sink: str, checkpoint: str, ts: str = "ts",
                 site_col: str = "site_id", amount_col: str = "amount", event_id: str = "event_id",
                 *, delay: str, trigger: dict | None = None, compact_every: int = COMPACT_EVERY):
    """Start the usage roll-up stream; returns the StreamingQuery.

    ``delay`` is how late a repeated event may come: event ids are remembered that long.
    """
    agg = (events.withWatermark(ts, delay)
           .dropDuplicatesWithinWatermark([event_id])
           .groupBy(F.col(site_col).alias("site_id"))
           .agg(F.max(ts).alias("ts"), F.sum(amount_col).alias("amount"),
                F.count(F.lit(1)).alias("n")))
    return (agg.writeStream.outputMode("update").foreachBatch(UsageSink(sink, compact_every).write)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def usage_totals(spark: SparkSession, sink: str) -> DataFrame:
    """Newest running aggregate per site from the usage sink: site_id, ts, amount, n."""
    return UsageSink(sink).totals(spark)


def apply_usage_totals(sites: DataFrame, totals: DataFrame) -> DataFrame:
    """Fold usage totals (one row per site) into the catalog."""
    return apply_usage(sites, totals, site_col="site_id", ts_col="ts", amount_col="amount")


def current_catalog(spark: SparkSession, base: str, deltas: str) -> DataFrame:
    """The catalog as the base table plus every imported delta."""
    cat = I.conform(spark.read.parquet(base))
    d = read_if_written(spark, deltas)
    return cat if d is None else cat.unionByName(I.conform(d.drop("batch_id")))


def import_stream(batches: DataFrame, base: str, deltas: str, report_root: str, checkpoint: str,
                  mode: str = "bulk", as_of=None, trigger: dict | None = None, index: str | None = None,
                  bucket_rows: int = BUCKET_ROWS, recent_rows: int = RECENT_ROWS):
    """Start the import stream.

    Batch ``b`` checks its rows against a key index of the base catalog and the earlier deltas, of
    which it reads only what its own URLs can meet (``url_index``), then writes its inserted rows
    to ``deltas/batch_id=b`` and its report to ``report_root/batch_id=b``, both
    with overwrite: a replayed batch rewrites the same paths.  The catalog is
    never rewritten nor read per batch; ``current_catalog`` assembles it.  The index is kept at ``index``
    (default: beside the deltas); it is built from the base when the stream starts, so the base must not change while it runs.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        keys = UrlIndex(batch.sparkSession, index or f"{deltas.rstrip('/')}-keys", base, deltas, bucket_rows, recent_rows)
        state = keys.state(batch_id)
        urls = batch.select(strip_ws(F.coalesce(F.col("website_url"), F.lit(""))).alias("website_url"))
        new_rows, report = I.import_new_rows(keys.candidates(urls, state, batch_id), batch, mode=mode, as_of=as_of)
        report.write.mode("overwrite").parquet(f"{report_root}/batch_id={batch_id}")
        new_rows.write.mode("overwrite").parquet(f"{deltas}/batch_id={batch_id}")
        keys.advance(state, batch_id)

    return (batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def feedback_stream(feedback: DataFrame, sites: DataFrame, sink: str, checkpoint: str,
                    trigger: dict | None = None):
    """Start the feedback stream: resolve each row against the (static) catalog and append."""
    out = I.resolve_feedback(feedback, sites)
    return (out.writeStream.outputMode("append").format("parquet")
            .option("path", sink).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
