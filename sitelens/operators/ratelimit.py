"""Sliding-window write limiter per client (T-1).

Rule: for each key, in time order, an event is allowed when fewer than
``max_n`` *allowed* events of that key lie within the last ``window`` (strictly:
``t - allowed_t < window``).  Refused events are not remembered, so the verdict
depends on earlier verdicts: it is a sequential state machine per key, not a
window count.

Batch plan: a gap of at least one window between two events of a key resets the
machine, so a key's events fall into independent runs.  Runs are found by grouped
minima and maxima, dealt over the cluster by (key, run), sorted and decided one
after the other in Arrow batches; at most ``max_n`` times are held.

Stream plan: ``groupBy(key).transformWithStateInPandas``, with the allowed times of a key as one value in
the state store; a stream also keeps the allowed times of the watermark's delay.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sitelens.functions.parse import epoch_micros

# FIXED VALUES: the catalog's write limits (events per window, window seconds).
ADD_SITE_LIMIT = (10, 60)
UPLOAD_LIMIT = (2, 60)

OUT_SCHEMA = "key string, event_id long, ts_us long, allowed boolean, verdict string"


def decide(times_us, kept: list[int], max_n: int, window_us: int, watermark_us: int | None = None):
    """Run the limiter over time-ordered events; returns (verdicts, kept).

    ``kept`` may hold later times than an event (in a stream): only those in the window that ends with the
    event count.  No event older than ``watermark_us`` follows; without one, none older than those seen.
    """
    out = []
    if watermark_us is not None:
        kept = [x for x in kept if watermark_us - x < window_us]
    for t in times_us:
        if watermark_us is None:
            kept = [x for x in kept if t - x < window_us]
        if sum(0 <= t - x < window_us for x in kept) < max_n:
            kept.append(t)
            out.append(True)
        else:
            out.append(False)
    return out, kept


class _LimiterProcessor(StatefulProcessor):
    """One key of a stream, in event time: events older than the watermark are late.

    The allowed times that can still matter are one array value, rewritten only when it changes.  One timer a key stands for its
    expiry: it is moved on, when it fires, to one window after the last allowed time, and drops the state once that has passed.
    """

    def __init__(self, max_n: int, window_us: int):
        self.max_n = max_n
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.allowed = handle.getValueState("allowed", "times array<long>")

    def _held(self) -> list[int]:
        got = self.allowed.get()  # None where there is no value: one call to the store, not two
        return list(got[0]) if got else []

    def _due(self, kept: list[int]) -> int:
        return (max(kept) + self.window_us) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept = self._held()
        if kept and self._due(kept) > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(self._due(kept))
        else:
            self.allowed.clear()
        return iter(())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self._held()
        watermark = max(timerValues.getCurrentWatermarkInMs(), 0) * 1000
        parts = list(rows)  # one key's rows of one micro-batch (bounded by the trigger)
        ids, times = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("event_id", "ts_us"))
        order = np.lexsort((ids, times))
        ids, times = ids[order], times[order].tolist()
        late = [t < watermark for t in times]
        decided, kept = decide([t for t, x in zip(times, late) if not x], before, self.max_n, self.window_us, watermark)
        decided = iter(decided)
        verdicts = [False if x else next(decided) for x in late]
        if kept != before:
            if kept:
                self.allowed.update((kept,))
                if not before:
                    self.handle.registerTimer(self._due(kept))
            else:
                self.allowed.clear()
        yield pd.DataFrame({"key": str(key[0]), "event_id": ids, "ts_us": times, "allowed": verdicts,
                            "verdict": ["late" if x else "allowed" if ok else "refused" for x, ok in zip(late, verdicts)]})

    def close(self) -> None:
        pass


def _prepared(requests: DataFrame, key: str, ts: str, event_id: str, more: list = ()) -> DataFrame:
    is_ntz = isinstance(requests.schema[ts].dataType, T.TimestampNTZType)
    return requests.select(F.col(key).cast("string").alias("key"),
                           F.col(event_id).cast("long").alias("event_id"),
                           epoch_micros(F.col(ts), is_ntz).alias("ts_us"), *more)


def with_runs(prep: DataFrame, window_us: int) -> DataFrame:
    """Add ``run`` to (key, ts_us, ...) rows: the runs of a key are a gap of at least one window apart, so none affects another.

    No window runs over a key's events.  They are first counted down, partially before the shuffle, to the least
    and greatest time in each window-long slot of the clock (a gap can't hide inside one); a slot starts a
    run where the gap to the slot before is long enough, and the run is named by that slot.  Rows without a time get no run.
    """
    rows = prep.withColumn("slot", F.expr(f"ts_us div {window_us} - if(pmod(ts_us, {window_us}) <> 0 and ts_us < 0, 1, 0)"))  # floored
    rows = rows.withColumn("who", F.coalesce(F.concat(F.lit("k"), F.col("key")), F.lit("")))  # a NULL key is a client too
    slots = rows.filter("slot is not null").groupBy("who", "slot").agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
    by_key = Window.partitionBy("who").orderBy("slot")
    starts = F.coalesce(F.col("lo") - F.lag("hi").over(by_key) >= window_us, F.lit(True))
    runs = slots.withColumn("start", F.when(starts, F.col("slot"))).withColumn("run", F.last("start", ignorenulls=True).over(by_key))
    return rows.join(runs.select("who", "slot", "run"), ["who", "slot"], "left").drop("slot")


def _decided(rows: DataFrame, own: list[str], schema: T.StructType, max_n: int, window_us: int) -> DataFrame:
    """The ``own`` columns and ``allowed`` of rows sorted by (who, run, time, event): runs stream through, and only the allowed times in the window are held."""

    def run(batches):
        now, kept = None, []
        for batch in batches:
            verdicts = []
            for who, number, t in zip(*(batch.column(c).to_pylist() for c in ("who", "run", "ts_us"))):
                if number is None:
                    verdicts.append(None)
                    continue
                if (who, number) != now:
                    now, kept = (who, number), []
                ok, kept = decide([t], kept, max_n, window_us)
                verdicts += ok
            columns = [batch.column(c) for c in own] + [pa.array(verdicts, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*own, "allowed"])

    return rows.mapInArrow(run, schema)


def rate_limit(requests: DataFrame, key: str = "client", ts: str = "ts", event_id: str = "event_id",
               max_n: int = UPLOAD_LIMIT[0], window_s: float = UPLOAD_LIMIT[1]) -> DataFrame:
    """Batch limiter: requests + ``allowed``.

    The unit of work is a run of a key (``with_runs``), so a hot key spreads over as many tasks as it has runs.  What
    remains sequential is one run: a client that never pauses for a window.  All columns travel through, so every
    row gets exactly one verdict, also rows with a NULL or repeated event id; a row without a time gets NULL and doesn't count.
    """
    window_us = int(window_s * 1_000_000)
    own = [f"own{i}" for i in range(len(requests.columns))]
    prep = _prepared(requests, key, ts, event_id, [F.col(c).alias(o) for c, o in zip(requests.columns, own)])
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.coalesce("run", "event_id")  # rows without a run are dealt by their id
    rows = with_runs(prep, window_us).repartition(parts, F.col("who"), spread).sortWithinPartitions("who", "run", "ts_us", "event_id")
    schema = T.StructType([T.StructField(o, f.dataType) for o, f in zip(own, requests.schema)] + [T.StructField("allowed", T.BooleanType())])
    return _decided(rows, own, schema, max_n, window_us).toDF(*requests.columns, "allowed")


def rate_limit_stream(requests: DataFrame, key: str = "client", ts: str = "ts",
                      event_id: str = "event_id", max_n: int = UPLOAD_LIMIT[0],
                      window_s: float = UPLOAD_LIMIT[1]) -> DataFrame:
    """Streaming limiter: a streaming DataFrame of (key, event_id, ts_us, allowed, verdict).

    ``requests`` has a watermark on ``ts``.  Each micro-batch is decided in time order per key, carrying the
    allowed times in the state store between batches.  ``verdict`` is allowed, refused, or late (older than the
    watermark; not allowed); an event counts the allowed times in the window that ends with it.  A key's state
    goes when the watermark is one window past its last allowed time.
    """
    conf = requests.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass",
             "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # many small stores: without this each of them reserves 4 MB of disk for its log of files
    conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    prep = _prepared(requests, key, ts, event_id)
    return prep.groupBy("key").transformWithStateInPandas(
        _LimiterProcessor(max_n, int(window_s * 1_000_000)), OUT_SCHEMA, "Append", "EventTime")


# The processor runs in Python workers: ship this module by value so workers need
# no installed copy of the package.
cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["_"]))
