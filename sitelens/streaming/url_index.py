"""Key index of a growing catalog: which URLs of a batch are known, without reading the catalog.

The index holds URLs in hash buckets (one folder each) of a generation.  A batch reads only
the buckets its own URLs fall in.  Buckets are split by writing a new generation with twice as many when they have
doubled in size, so a bucket keeps about ``bucket_rows`` URLs and a batch of m URLs reads at most about
2 * m * ``bucket_rows`` of them however large the catalog is; what all rewritings cost together is a constant for each URL.

What recent batches added isn't in buckets yet: it is read from their deltas, and goes into the buckets as a further run
once it has ``recent_rows`` rows or comes from ``RECENT_BATCHES`` batches.

Every batch writes its state (generation, buckets, what is in them) under its own id and starts from the state of the
batch before, and runs and generations are named by the batch that writes them: a batch that is replayed
after a failure overwrites its own files and nothing else.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.session import entries

BUCKET_ROWS = 100_000
RECENT_ROWS = 1_000_000
RECENT_BATCHES = 64
MOST_BUCKETS = 1 << 16


class State(NamedTuple):
    generation: int  # the batch that wrote it; -1: the base catalog
    buckets: int
    rows: int  # URLs in the buckets
    flushed: int  # deltas up to this batch are in the buckets
    recent: int  # URLs in later deltas


class UrlIndex:
    """The index of a base catalog and its deltas (``deltas/batch_id=b``) at ``path``."""

    def __init__(self, spark: SparkSession, path: str, base: str, deltas: str, bucket_rows: int = BUCKET_ROWS, recent_rows: int = RECENT_ROWS):
        self.spark, self.path, self.base, self.deltas = spark, path, base, deltas
        self.bucket_rows, self.recent_rows = bucket_rows, recent_rows

    @staticmethod
    def _bucket(url: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")

    def _generation(self, state: State) -> str:
        return f"{self.path}/generation={state.generation}"

    def _write_run(self, urls: DataFrame, state: State, batch_id: int) -> None:
        rows = urls.select("website_url", self._bucket(F.col("website_url"), state.buckets).alias("bucket")).repartition("bucket")
        rows.write.partitionBy("bucket").mode("overwrite").parquet(f"{self._generation(state)}/run={batch_id}")

    def _in_buckets(self, state: State) -> DataFrame:
        # partition columns come from folder names; without any row there is no folder
        if not any(n.startswith("run=") and any(b.startswith("bucket=") for b in entries(self.spark, f"{self._generation(state)}/{n}")) for n in entries(self.spark, self._generation(state))):
            return self.spark.createDataFrame([], "website_url string, run int, bucket int")
        return self.spark.read.schema("website_url string, run int, bucket int").parquet(self._generation(state))

    def _delta(self, first: int, last: int) -> DataFrame | None:
        there = set(entries(self.spark, self.deltas))
        paths = [f"{self.deltas}/batch_id={b}" for b in range(first, last + 1) if f"batch_id={b}" in there]
        return self.spark.read.schema("website_url string").parquet(*paths) if paths else None

    def _built(self, urls: DataFrame, generation: int, flushed: int) -> State:
        """A new generation from all URLs."""
        rows = urls.count()
        buckets = 1
        while buckets < MOST_BUCKETS and buckets * self.bucket_rows < rows:
            buckets *= 2
        state = State(generation, buckets, rows, flushed, 0)
        self._write_run(urls, state, generation)
        return state

    def state(self, batch_id: int) -> State:
        """The state that batch ``batch_id`` starts from; built from the catalog if the batch before left none."""
        if f"batch_id={batch_id - 1}" in entries(self.spark, f"{self.path}/state"):
            return State(*self.spark.read.parquet(f"{self.path}/state/batch_id={batch_id - 1}").select(*State._fields).first())
        urls = self.spark.read.parquet(self.base).select("website_url")
        earlier = self._delta(0, batch_id - 1)
        return self._built(urls if earlier is None else urls.unionByName(earlier), batch_id - 1, batch_id - 1)

    def candidates(self, batch: DataFrame, state: State, batch_id: int, url: str = "website_url") -> DataFrame:
        """(website_url): the known URLs that a URL of the batch can equal: its buckets and the recent deltas."""
        touched = [r["b"] for r in batch.select(self._bucket(F.col(url), state.buckets).alias("b")).distinct().collect()]  # at most a number for each bucket
        # runs of a failed attempt at this batch don't count
        known = self._in_buckets(state).filter(F.col("bucket").isin(touched) & (F.col("run") <= state.flushed)).select("website_url")
        recent = self._delta(state.flushed + 1, batch_id - 1)
        return known if recent is None else known.unionByName(recent)

    def advance(self, state: State, batch_id: int) -> None:
        """Take in the delta that batch ``batch_id`` has written, and leave the state for the next batch."""
        own = self._delta(batch_id, batch_id)
        state = state._replace(recent=state.recent + (own.count() if own is not None else 0))
        if state.recent >= self.recent_rows or batch_id - state.flushed >= RECENT_BATCHES:
            fresh = self._delta(state.flushed + 1, batch_id)
            total = state.rows + state.recent
            if fresh is not None and total > 2 * state.buckets * self.bucket_rows and state.buckets < MOST_BUCKETS:
                state = self._built(self._in_buckets(state).filter(F.col("run") <= state.flushed).select("website_url").unionByName(fresh), batch_id, batch_id)
            else:
                if fresh is not None:
                    self._write_run(fresh, state, batch_id)
                state = state._replace(rows=total, flushed=batch_id, recent=0)
        self.spark.createDataFrame([tuple(state)], ", ".join(f"{f} long" for f in State._fields)).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state/batch_id={batch_id}")
