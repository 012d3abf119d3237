"""Substring deduplication with fixed-block anchors.

A word is covered when it lies in a window of ``window`` consecutive words that
also starts in a document with a smaller ``doc_id``.  Windows are judged on the input.

1. *Where a repeat is possible.*  N rolling probes of the whole corpus would be a
   shuffle of several times its size, so text that can't share a window is set
   aside first: each window chooses one ``gram``-word gram by content
   (winnowing), and only windows whose gram occurs again go on.  Windows that
   chose the same place form one context; equal contexts are one class, and
   every copy outside the class's smallest document is covered whole.
2. *Fixed blocks.*  In what is left (the smallest document of each class, for grams with
   several classes) the words are cut into non-overlapping blocks of ``window // 2`` words,
   counted from the document's start.  A window holds at least one whole block.
   The blocks are indexed by hash with the smallest document that has one.
3. *Rolling probes.*  Every rolling window of a block's length is looked up in the
   index by an equi-join on the hash.
4. *Extension.*  A hit grows to the windows around it.  Each such window is keyed by
   the 128-bit hash of its words, and the smallest document per key decides.
   Covered windows that touch are merged, which gives the maximal exact repeats.

Groups are never gathered: blocks and windows meet in grouped minima with
partial aggregation, and joins on their keys are splittable.

Edge cases: NULL text has no words; texts shorter than the window lose nothing;
of repeated rows the smaller ``doc_id`` stays whole, of rows with one ``doc_id`` the first, and rows with
a NULL ``doc_id`` come last; an empty table gives an
empty result; extra columns are ignored.  ``covered_spans`` needs a unique ``doc_id``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import Rolling, anchors, narrow, on_rows, signed, staged, text_chunks, word_hashes, words

WINDOW = 50
GRAM = 12


def _digests(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = memoryview(np.ascontiguousarray(hashes).tobytes())
    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[8 * x : 8 * y]) for x, y in zip(start.tolist(), end.tolist())]), np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _chosen(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """One row per chosen gram: windows [lo, hi] (in words) that chose it, its hash and the context's."""

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"), np.int64)
            for r0, r1, buf, off in text_chunks(batch):
                s, e, row = words(buf, off)
                h = word_hashes(buf, s, e)
                woff = np.searchsorted(row, np.arange(r1 - r0 + 1))
                row, a, lo, hi, g = anchors(h, woff, gram, window)
                if len(row):
                    c1, c2 = _digests(h, lo, hi + window)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[r0:r1][row]), pa.array(lo - woff[row]), pa.array(hi - woff[row]), pa.array(signed(g)), pa.array(c1), pa.array(c2)], names=["doc_id", "lo", "hi", "gram", "c1", "c2"])

    return docs.mapInArrow(run, "doc_id long, lo long, hi long, gram long, c1 long, c2 long")


def _probes(docs: DataFrame, zones: DataFrame, window: int) -> DataFrame:
    """Rolling blocks and windows of the zones: doc_id, p, h (block at p), aligned, w1 and w2 (window at p or NULL)."""
    block = window // 2
    lists = zones.groupBy("doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("at"))

    def run(batches):
        for batch in batches:
            for doc, text, at in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("at")):
                buf = np.frombuffer(text.as_buffer(), np.uint8)
                s, e, _ = words(buf, np.array([0, len(buf)]))
                h = word_hashes(buf, s, e)
                at = np.array([(z["lo"], z["hi"]) for z in at.as_py()]).reshape(-1, 2)
                inside = np.zeros(len(h) + 1, np.int64)  # starts of blocks that lie in a zone
                np.add.at(inside, at[:, 0], 1)
                np.add.at(inside, at[:, 1] + window - block + 1, -1)
                p = np.flatnonzero(np.cumsum(inside)[: len(h) - block + 1] > 0)
                full = np.zeros(len(h) + 1, np.int64)  # starts of windows of a zone
                np.add.at(full, at[:, 0], 1)
                np.add.at(full, at[:, 1] + 1, -1)
                is_full = (np.cumsum(full) > 0)[p]
                w1, w2 = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
                w1[is_full], w2[is_full] = _digests(h, p[is_full], p[is_full] + window)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), doc, np.int64)), pa.array(p), pa.array(signed(Rolling(h).grams(block)[p])), pa.array(p % block == 0), pa.array(w1, mask=~is_full), pa.array(w2, mask=~is_full)], names=["doc_id", "p", "h", "aligned", "w1", "w2"])

    return docs.join(lists, "doc_id").mapInArrow(run, "doc_id long, p long, h long, aligned boolean, w1 long, w2 long")


def covered_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, start, end) in words: spans covered by windows of smaller documents (they may overlap)."""
    docs = narrow(docs)
    chosen = _chosen(docs, window, gram)
    again = chosen.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
    again = staged(again, "grams")  # read back, so that both sides of the joins are plain exchanges that can be split
    at = staged(chosen.join(again, "gram"), "block-grams")
    key = ["gram", "c1", "c2"]
    classes = staged(at.groupBy(*key).agg(F.min("doc_id").alias("first")), "block-contexts")
    several = classes.groupBy("gram").agg(F.count("*").alias("m")).filter("m > 1").select("gram")
    several = staged(several, "several")
    whole = at.join(classes, key).filter("doc_id > first").select("doc_id", F.col("lo").alias("start"), (F.col("hi") + window).alias("end"))
    zones = at.join(classes.join(several, "gram"), key).filter("doc_id = first").select("doc_id", "lo", "hi")
    rows = staged(_probes(docs, zones, window), "block-probes")
    index = (rows.groupBy("h").agg(F.min(F.when(F.col("aligned"), F.col("doc_id"))).alias("first"), F.max("doc_id").alias("last"))
             .filter("first < last"))
    index = staged(index, "block-index")
    hit = (F.col("first") < F.col("doc_id")) | (F.col("aligned") & (F.col("doc_id") < F.col("last")))
    near = Window.partitionBy("doc_id").orderBy("p").rangeBetween(0, window - window // 2)
    grown = (rows.join(index, "h", "left").withColumn("hit", F.coalesce(hit, F.lit(False)))
             .withColumn("grown", F.max("hit").over(near)).filter("grown and w1 is not null").select("doc_id", "p", "w1", "w2"))
    grown = staged(grown, "block-windows")
    smallest = grown.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    smallest = staged(smallest, "block-first")
    part = grown.join(smallest, ["w1", "w2"]).filter("doc_id > first").select("doc_id", F.col("p").alias("start"), (F.col("p") + window).alias("end"))
    return whole.unionByName(part)


def remove_words(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Cut word spans out of the texts: doc_id, n_words, n_removed, kept (words joined by one space)."""
    lists = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("cut"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for doc, text, cut in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("cut")):
                found = text.as_buffer().to_pybytes().split()  # splits at exactly 0x20 and 0x09-0x0D
                kept = found
                if cut.is_valid:
                    kept, at = [], 0
                    for s, e in sorted((c["start"], c["end"]) for c in cut.as_py()):
                        kept += found[at:s] if s > at else []
                        at = max(at, e)
                    kept += found[at:]
                out.append({"doc_id": doc, "n_words": len(found), "n_removed": len(found) - len(kept), "kept": b" ".join(kept).decode()})
                size += len(text.as_buffer())
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return narrow(docs).join(lists, "doc_id", "left").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def block_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Every document without the words that smaller documents already hold (see the module text)."""
    return on_rows(docs, lambda rows: remove_words(rows, covered_spans(rows, window, gram)))
