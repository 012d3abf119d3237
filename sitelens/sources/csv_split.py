"""CSV files with quoted line breaks, read by many tasks, with exact record numbers.

A line break inside quotes doesn't end a record, so where a split may begin depends on all text before it.  Each
split is therefore walked once under both starting states, outside and inside quotes, in its own task; a row
for each split keeps the state it ends in and the records it begins under either.  Going through the splits of a file in
order picks the true one.  A second scan gives each line its record number, and records on one line, nearly
all, are parsed where they are; only records of several lines are put together by a grouped join.

Both scans must be cut into the same splits; if a change of the session's settings between them prevents
that, the second one stops with an error.  Lines end in LF or CRLF; where the first line of a file ends
in CRLF, a CRLF inside quotes reads as LF, as in Spark's own reader.  A quoted value that is never closed takes the rest of its file.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FIELDS = "value string, file string, bytes long, block long, line long, in0 boolean, in1 boolean, out0 boolean, out1 boolean, rec0 long, rec1 long"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted value is open at the end of a line.  A quote opens at the start of a value only, and a doubled one inside stays inside."""
    if '"' not in line:
        return inside
    state, before = (1 if inside else 0), 0  # 0: outside, 1: inside, 2: just closed
    at = line.find('"')
    while at >= 0:
        if state == 1:
            state = 2
        elif at == 0 or line[at - 1] == "," or (state == 2 and at == before):
            state = 1
        else:
            state = 0
        before = at + 1
        at = line.find('"', before)
    return state == 1


def _walked(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its number in the split, and under either starting state: inside quotes before and after it, and the records begun up to it."""
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_block_start").alias("block"))

    def run(batches):
        now, line, state, begun = None, 0, [False, True], [0, 0]
        for batch in batches:
            n = len(batch)
            before, after, records, lines = np.zeros((2, n), bool), np.zeros((2, n), bool), np.zeros((2, n), np.int64), np.zeros(n, np.int64)
            for i, (text, *here) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block")))):
                if here != now:  # a task reads its splits one after the other
                    now, line, state, begun = here, 0, [False, True], [0, 0]
                lines[i], line = line, line + 1
                for h in (0, 1):
                    before[h, i] = state[h]
                    begun[h] += not state[h] and text not in ("", "\r")
                    state[h] = ends_inside(text, state[h])
                    after[h, i], records[h, i] = state[h], begun[h]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lines), *map(pa.array, (*before, *after, *records))],
                                             names=[*batch.schema.names, "line", "in0", "in1", "out0", "out1", "rec0", "rec1"])

    return raw.mapInArrow(run, _FIELDS)


def _true_starts(splits: pd.DataFrame) -> pd.DataFrame:
    """For the splits of one file: whether each begins inside quotes, how many records begin before it, and whether it has lines that aren't whole records."""
    splits = splits.sort_values("block")
    inside, ahead, crlf, out = False, 0, bool(splits["crlf"].iloc[0]), []
    for r in splits.itertuples():
        out.append((r.file, r.block, inside, ahead, r.open1 if inside else r.open0, crlf))
        inside, ahead = bool(r.out1 if inside else r.out0), ahead + (r.rec1 if inside else r.rec0)
    return pd.DataFrame(out, columns=["file", "block", "inside", "ahead", "open", "crlf"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, record, text): the records of all files under ``path``, numbered from 1 in each; the header is one of them."""
    from sitelens.session import scratch_path

    lines = _walked(spark, path)
    last = [F.max_by(c, "line").alias(c) for c in ("out0", "out1", "rec0", "rec1")]
    crlf = F.max((F.col("line") == 0) & F.col("value").endswith("\r")).alias("crlf")
    ends = lines.groupBy("file", "block").agg(*last, crlf, F.max(F.col("in0") | F.col("out0")).alias("open0"), F.max(F.col("in1") | F.col("out1")).alias("open1"))
    at = scratch_path(spark, "csv-splits")
    schema = "file string, block long, inside boolean, ahead long, open boolean, crlf boolean"
    ends.groupBy("file").applyInPandas(_true_starts, schema).write.parquet(at)  # rows of splits only
    splits = spark.read.schema(schema).parquet(at)
    real = lines.join(F.broadcast(splits), ["file", "block"], "left")
    known = F.coalesce("inside", F.raise_error(F.lit("the file's splits changed between two scans; read it again")).cast("boolean"))
    real = real.withColumn("inside", known)
    pick = lambda c: F.when(F.col("inside"), F.col(c + "1")).otherwise(F.col(c + "0"))
    real = real.select("file", "bytes", "crlf", "block", "line", "value", pick("in").alias("before"), pick("out").alias("after"), (F.col("ahead") + pick("rec")).alias("record"))
    whole = real.filter("not before and not after and value not in ('', '\r')").select("file", "bytes", "crlf", "record", F.col("value").alias("text"))
    if not splits.filter("open").isEmpty():
        parts = real.filter("before or after").groupBy("file", "bytes", "crlf", "record").agg(F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("parts"))
        whole = whole.unionByName(parts.select("file", "bytes", "crlf", "record", F.array_join("parts.value", "\n").alias("text")))
    text = F.regexp_replace("text", "\r\\z", "")
    return whole.select("file", "bytes", "record", F.when(F.col("crlf"), F.replace(text, F.lit("\r\n"), F.lit("\n"))).otherwise(text).alias("text"))


# The walk runs in Python workers: ship this module by value so workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["_"]))
