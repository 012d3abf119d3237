"""Registered stream and stateful queries (each compared with its batch twin's SQL).

Stream inputs are files derived from the driver tables, in a few time-ordered
groups, with every 10th event repeated in the next group to exercise
de-duplication.  Each group is written by as many tasks as it has, then the stream
runs over it with ``availableNow`` from its checkpoint; the registered DataFrame
reads what the sink holds afterwards.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators import ingest as I
from sitelens.operators import ratelimit as RL
from sitelens.plans import fixtures as FX
from sitelens.plans.registry import ORACLES, _r6, register
from sitelens.plans.registry_ingest import _report_sql, HEAD
from sitelens.plans.registry_more import ENRICH_SQL
from sitelens.session import scratch_path
from sitelens.sources import csv_io
from sitelens.streaming import streams as ST

N_GROUPS = 3
REPEAT_EVERY = 10


# The replayed tables span years, and a group may repeat any event of the one before.
REPLAY_DELAY = "3650 days"


def _replay(df: DataFrame, path: str, group: F.Column, start, repeat_key: str | None = None, fmt: str = "parquet") -> None:
    """Write groups 0..N_GROUPS-1 one after the other and run the stream (``start()``) after each; rows
    with repeat_key % 10 == 0 are written again with the next group (repeats)."""
    g = df.withColumn("_g", group)
    if repeat_key is not None:
        rep = g.filter((F.pmod(F.col(repeat_key), F.lit(REPEAT_EVERY)) == 0) & (F.col("_g") < N_GROUPS - 1)) \
            .withColumn("_g", F.col("_g") + 1)
        g = g.unionByName(rep)
    for i in range(N_GROUPS):
        w = g.filter(F.col("_g") == i).drop("_g").write
        if fmt == "csv":
            w = w.option("header", True).option("quote", '"').option("escape", '"')
        w.format(fmt).save(f"{path}/g{i}")
        _run(start())


def _run(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


@contextmanager
def _state_partitions(spark: SparkSession):
    """Size a stream's state partitions to the cluster for this run (the number is
    fixed in the checkpoint at the first batch), then restore the session."""
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, old)


# ---------------------------------------------------------------------------
# T-1 limiter: batch and stream, with a recursive-SQL oracle (2 per hour)
# ---------------------------------------------------------------------------

LIMIT_N, LIMIT_WINDOW_S = 2, 3600
W_US = LIMIT_WINDOW_S * 1_000_000

RATE_LIMIT_SQL = f"""WITH RECURSIVE e AS (
  SELECT user_id, event_id, epoch_us(ts) AS t,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (
  SELECT user_id, rn, event_id, true AS allowed, CAST(NULL AS BIGINT) AS p1, t AS p2 FROM e WHERE rn = 1
  UNION ALL
  SELECT n.user_id, n.rn, n.event_id,
    (CASE WHEN r.p1 IS NOT NULL AND n.t - r.p1 < {W_US} THEN 1 ELSE 0 END
     + CASE WHEN r.p2 IS NOT NULL AND n.t - r.p2 < {W_US} THEN 1 ELSE 0 END) < {LIMIT_N} AS allowed,
    CASE WHEN (CASE WHEN r.p1 IS NOT NULL AND n.t - r.p1 < {W_US} THEN 1 ELSE 0 END
               + CASE WHEN r.p2 IS NOT NULL AND n.t - r.p2 < {W_US} THEN 1 ELSE 0 END) < {LIMIT_N}
         THEN coalesce(CASE WHEN r.p2 IS NOT NULL AND n.t - r.p2 < {W_US} THEN r.p2 END,
                       CASE WHEN r.p1 IS NOT NULL AND n.t - r.p1 < {W_US} THEN r.p1 END)
         ELSE r.p1 END,
    CASE WHEN (CASE WHEN r.p1 IS NOT NULL AND n.t - r.p1 < {W_US} THEN 1 ELSE 0 END
               + CASE WHEN r.p2 IS NOT NULL AND n.t - r.p2 < {W_US} THEN 1 ELSE 0 END) < {LIMIT_N}
         THEN n.t ELSE r.p2 END
  FROM r JOIN e n ON n.user_id = r.user_id AND n.rn = r.rn + 1)
SELECT event_id, user_id, allowed FROM r"""


@register("rate_limit", RATE_LIMIT_SQL)
def q_rate_limit(spark, sf_dir):
    e = FX.table(spark, sf_dir, "events")
    out = RL.rate_limit(e, key="user_id", ts="ts", event_id="event_id", max_n=LIMIT_N,
                        window_s=LIMIT_WINDOW_S)
    return out.select("event_id", "user_id", "allowed")


@register("rate_limit_stream", RATE_LIMIT_SQL)
def q_rate_limit_stream(spark, sf_dir):
    _ = spark.streams
    e = FX.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    day = F.dayofmonth("ts")
    grp = F.when(day <= 10, 0).when(day <= 20, 1).otherwise(2)
    path, sink, ckpt = (scratch_path(spark, f"limit-{x}") for x in ("in", "sink", "ckpt"))

    def start():
        stream = spark.readStream.schema("event_id long, user_id long, ts timestamp_ntz").parquet(f"{path}/*")
        s = (stream.withColumn("ts", F.col("ts").cast("timestamp"))
             .withWatermark("ts", REPLAY_DELAY).dropDuplicatesWithinWatermark(["event_id"]))
        verdicts = RL.rate_limit_stream(s, key="user_id", ts="ts", event_id="event_id",
                                        max_n=LIMIT_N, window_s=LIMIT_WINDOW_S)
        return (verdicts.writeStream.outputMode("append").format("parquet").option("path", sink)
                .option("checkpointLocation", ckpt).trigger(availableNow=True).start())

    with _state_partitions(spark):
        _replay(e, path, grp, start, "event_id")
    out = spark.read.parquet(sink)
    return out.select("event_id", F.col("key").cast("long").alias("user_id"), "allowed")


# ---------------------------------------------------------------------------
# T-2 usage stream (oracle: the batch usage roll-up)
# ---------------------------------------------------------------------------

@register("usage_stream", ORACLES["usage_rollup"])
def q_usage_stream(spark, sf_dir):
    li = FX.table(spark, sf_dir, "lineitem")
    # lineitem has no unique row key: stamp each usage event with an id once and
    # pin it by writing the stamped log, so the repeats below are exact copies.
    stamped = scratch_path(spark, "usage-log")
    li.select(F.monotonically_increasing_id().alias("event_id"),
              F.col("l_partkey").alias("site_id"), F.col("l_shipdate").alias("ts"),
              F.col("l_quantity").alias("amount")).write.parquet(stamped)
    ev = spark.read.parquet(stamped)
    year = F.year("ts")
    grp = F.when(year <= 1996, 0).when(year <= 1998, 1).otherwise(2)
    path, sink, ckpt = (scratch_path(spark, f"usage-{x}") for x in ("in", "sink", "ckpt"))

    def start():
        stream = spark.readStream.schema("event_id long, site_id long, ts timestamp_ntz, amount double").parquet(f"{path}/*")
        return ST.usage_stream(stream.withColumn("ts", F.col("ts").cast("timestamp")), sink, ckpt, delay=REPLAY_DELAY)

    with _state_partitions(spark):
        _replay(ev, path, grp, start, "event_id")
    totals = ST.usage_totals(spark, sink).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    sites = FX.sites(spark, sf_dir, with_usage=False)
    out = ST.apply_usage_totals(sites, totals)
    return out.select("id", "last_used_at", _r6(F.col("heat_score")).alias("heat_score"))


# ---------------------------------------------------------------------------
# T-3 import stream (oracle: the batch import report, outcome level)
# ---------------------------------------------------------------------------

@register("import_stream", f"""{HEAD}, {_report_sql('bulk')}
SELECT row_no, website_url, outcome FROM report""")
def q_import_stream(spark, sf_dir):
    batch = FX.import_batch(spark, sf_dir).drop("page_id")
    n_pages = FX.table(spark, sf_dir, "pages").agg(F.max("page_id").alias("m")).select("m").scalar()
    grp = (F.when(F.col("row_no") >= FX.REPEAT_ROW_OFFSET, N_GROUPS - 1)
           .otherwise(F.least(F.lit(N_GROUPS - 1),
                              F.floor((F.col("row_no") - 2) * N_GROUPS / (n_pages + 1)))).cast("int"))
    path, base, deltas, report_root, ckpt = (scratch_path(spark, f"import-{x}") for x in ("in", "base", "deltas", "report", "ckpt"))
    I.conform(FX.import_target(spark, sf_dir)).write.parquet(base)
    schema = ", ".join(f"{c} string" for c in batch.columns if c != "row_no")

    def start():
        stream = (spark.readStream.schema(f"row_no long, {schema}").option("header", True)
                  .option("quote", '"').option("escape", '"').csv(f"{path}/*"))
        return ST.import_stream(stream, base, deltas, report_root, ckpt, as_of=FX.AS_OF)

    _replay(batch, path, grp, start, fmt="csv")
    return spark.read.parquet(report_root).select("row_no", "website_url", "outcome")


# ---------------------------------------------------------------------------
# T-4 feedback stream (oracle: batch resolve_feedback)
# ---------------------------------------------------------------------------

@register("feedback_stream", ORACLES["resolve_feedback"])
def q_feedback_stream(spark, sf_dir):
    fb = FX.feedback(spark, sf_dir)
    path, sink, ckpt = (scratch_path(spark, f"feedback-{x}") for x in ("in", "sink", "ckpt"))

    def start():
        stream = spark.readStream.schema(
            "feedback_id long, website_url string, suggested_tags string, created_at timestamp_ntz").parquet(f"{path}/*")
        return ST.feedback_stream(stream, FX.import_target(spark, sf_dir), sink, ckpt)

    _replay(fb, path, F.pmod(F.col("feedback_id"), F.lit(N_GROUPS)), start)
    return spark.read.parquet(sink).select("site_id", "website_url", "suggested_tags", "created_at", "status")


@register("raw_sites_scan", "SELECT url AS website_url FROM pages")
def q_raw_sites_scan(spark, sf_dir):
    path = scratch_path(spark, "raw-csv")
    FX.table(spark, sf_dir, "pages").select(F.col("url").alias("website_url")).write.option("header", True).csv(path)
    return csv_io.read_raw_sites(spark, path).select("website_url")


# ---------------------------------------------------------------------------
# S1-S3 CSV round trip (oracle: the enrichment records)
# ---------------------------------------------------------------------------

@register("csv_roundtrip", f"""{ENRICH_SQL.replace('SELECT * FROM enriched', '')}
SELECT website_url, platform, industry, tags, primary_color, secondary_color,
  regexp_replace(platform_scores, ':[0-9]+', '', 'g') AS platforms_s FROM enriched""")
def q_csv_roundtrip(spark, sf_dir):
    from sitelens.operators.enrich import enrich_pages
    recs = enrich_pages(FX.pages_seeded(spark, sf_dir), as_of=FX.AS_OF)
    path = scratch_path(spark, "enriched-csv")
    csv_io.write_enriched_csv(recs, path)
    back = csv_io.read_enriched_csv(spark, path)
    new_target, _ = I.import_enriched(spark.createDataFrame([], I.SITES_SCHEMA), back, as_of=FX.AS_OF)
    return new_target.select("website_url", "platform", "industry",
                             F.coalesce(F.col("tags"), F.lit("")).alias("tags"),
                             F.col("colors.primary").alias("primary_color"),
                             F.col("colors.secondary").alias("secondary_color"),
                             F.coalesce(F.array_join("platforms", "|"), F.lit("")).alias("platforms_s"))
