"""WARC archives written and read by Spark, with boundary-chain verification.

Writing: each page is one text row "header CRLF CRLF payload", and Spark's text writer ends
every row with CRLF CRLF, so each part file is a plain WARC/1.1 file.  Of pages with
equal payloads of at least ``min_revisit`` bytes the one with the largest id is a
response; the others are revisits without payload that refer to it.

Reading: files are split at the magic "WARC/1.1 CRLF" by Spark's splittable text reader, so one
file is read by many tasks.  A magic may also stand inside a payload, even
followed by a whole false record.  Therefore each piece is only a *candidate*.  A first scan emits
narrow rows: a piece's offset in its split, its size and the length its header claims.  Offsets of splits in
their file are running sums over splits, so each candidate gets its own and its successor's offset.  Pointer jumping
goes in two levels: inside a split, in its task, every candidate learns where the chain from it leaves the split; between
splits, from offset 0 of each file (reached splits double each round), it finds where the true chain enters each.  The chain
from there marks the true records of the split; all others are rejected.

A second scan returns the payloads.  Pieces of records that hold a rejected magic are put together
again by a grouped join; all others, nearly everything, go straight through, so texts are
neither shuffled nor written a second time.  Both scans must be cut into the same splits; if a change of the session's
settings between them prevents that, the second one stops with an error and loses nothing.

Deciding revisits moves digests only, too: groups of equal payloads are found on (digest, id) rows and written, and
the pages are joined to that table, which Spark broadcasts while its size is below the session's limit and shuffles
beyond; pages too short to be compared have a key of their own then, not a common NULL.

Edge cases: NULL html is an empty payload; empty payloads and payloads of any length or
holding CRLF, headers or whole records come back unchanged; an empty table
writes a file without records and reads as an empty result; extra columns are ignored.  A row with a NULL ``page_id`` is
a response without a record id, and nothing refers to it; rows that share the largest ``page_id`` of their group are
all responses.  A chain that breaks (damaged file) ends there, and what follows isn't returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm.common import staged
from sitelens.session import scratch_path

MIN_REVISIT = 1000
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"


def with_revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, n_bytes, digest, refers_to): refers_to is NULL for responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    rows = rows.withColumn("same", F.when(F.col("n_bytes") >= min_revisit, F.sha2(F.encode("payload", "UTF-8"), 256)))
    groups = rows.filter("same is not null").groupBy("same").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").select("same", "last")
    groups = staged(groups, "warc-groups")
    alone = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))  # meets no digest
    rows = rows.withColumn("same", F.coalesce("same", alone))
    return rows.join(groups, "same", "left").withColumn("refers_to", F.when(F.col("page_id") < F.col("last"), F.col("last"))).drop("same", "last")


def records(rows: DataFrame) -> DataFrame:
    """One column ``value``: each row as a WARC record without its closing CRLF CRLF."""
    revisit = F.col("refers_to").isNotNull()
    uri = F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20")
    payload = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    lines = [
        F.concat(F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.col("page_id"), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("n_bytes")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to"), F.lit(">"))),
        F.concat(F.lit("Content-Length: "), F.octet_length(payload)),
    ]
    return rows.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(END), payload).alias("value"))


def write_warc(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files under ``path``."""
    records(with_revisits(pages, min_revisit)).write.option("lineSep", END).option("compression", "none").text(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _placed(pieces: DataFrame) -> DataFrame:
    """Add ``inside``: the bytes of the pieces (with their magics) that come before a piece in its split."""

    def run(batches):
        now, at = None, 0
        for batch in batches:
            size = np.asarray(batch.column("size"), np.int64) + len(MAGIC)
            inside = np.cumsum(size) - size
            files, blocks = batch.column("file"), np.asarray(batch.column("block"), np.int64)
            if len(size):
                code = np.asarray(files.dictionary_encode().indices)
                turn = np.flatnonzero((np.diff(code) != 0) | (np.diff(blocks) != 0)) + 1
                for lo, hi in zip([0, *turn], [*turn, len(size)]):  # a task reads its splits one after the other
                    here = files[int(lo)].as_py(), int(blocks[lo])
                    at = at if here == now else 0
                    inside[lo:hi] += at - inside[lo]
                    now, at = here, int(inside[hi - 1] + size[hi - 1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inside)], names=[*batch.schema.names, "inside"])

    return pieces.mapInArrow(run, T.StructType([*pieces.schema.fields, T.StructField("inside", T.LongType())]))


def _chained(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the candidates of one split (ascending starts; ends negative where unknown): each one's successor in the split
    (itself if there is none), and where the chain from it leaves the split (-1: it breaks)."""
    at = np.minimum(np.searchsorted(starts, ends), len(starts) - 1)
    own = np.arange(len(starts))
    after = np.where((starts[at] == ends) & (at > own), at, own)
    far = after
    while not np.array_equal(far, onward := far[far]):  # pointer jumping inside the split
        far = onward
    return after, np.where(ends[far] > starts[-1], ends[far], -1)


def _by_split(batches):
    """The rows of Arrow batches split by split: ((file, block), table); a split's rows come one after the other."""
    held, now = [], None
    for batch in batches:
        files, blocks = batch.column("file"), np.asarray(batch.column("block"), np.int64)
        code = np.asarray(files.dictionary_encode().indices)
        turn = np.flatnonzero((np.diff(code) != 0) | (np.diff(blocks) != 0)) + 1
        for lo, hi in zip([0, *turn], [*turn, len(blocks)]):
            if lo == hi:
                continue
            here = files[int(lo)].as_py(), int(blocks[lo])
            if here != now and held:
                yield now, pa.Table.from_batches(held).combine_chunks()
                held = []
            now = here
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks()


def _local(pieces: DataFrame) -> DataFrame:
    """Add ``exit`` to placed pieces, relative to the split as ``inside``; a task holds the numbers of one split at a time."""
    schema = T.StructType([*pieces.schema.fields, T.StructField("exit", T.LongType())])

    def run(batches):
        for _, rows in _by_split(batches):
            starts = np.asarray(rows.column("inside"), np.int64)
            claimed = np.asarray(rows.column("claimed").fill_null(-1), np.int64)
            _, leaves = _chained(starts, np.where(claimed < 0, -1, starts + claimed))
            yield from rows.append_column("exit", pa.array(leaves, mask=leaves < 0)).to_batches()

    return pieces.mapInArrow(run, schema)


def candidates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, block, inside, start, next, exit): every piece between magics with its offset, its claimed successor and where
    the chain from it leaves its split; and (file, block, base) of the splits."""
    cut = F.instr("value", END)
    head = F.when(cut > 0, F.substring_index("value", END, 1))
    length = F.try_to_number(F.regexp_extract("head", r"(?:^|\r\n)Content-Length: (\d{1,18})(?:\r\n|$)", 1), F.lit("9" * 18)).cast("long")
    claimed = len(MAGIC) + F.octet_length("head") + len(END) + length + len(END)
    raw = _read(spark, path).select("file", "block", F.octet_length("value").cast("long").alias("size"), head.alias("head")).select("file", "block", "size", claimed.alias("claimed"))
    pieces = staged(_local(_placed(raw)), "warc-pieces")
    # the last piece of a file has no magic after it; some bytes more there move no offset before it
    blocks = pieces.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = staged(blocks.select("file", "block", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("base")), "warc-splits")
    zero = F.col("base") - len(MAGIC)
    at = pieces.join(blocks, ["file", "block"]).withColumn("start", zero + F.col("inside"))
    return staged(at.select("file", "block", "inside", "start", (F.col("start") + F.col("claimed")).alias("next"), (zero + F.col("exit")).alias("exit")), "warc-candidates"), blocks


def entries(links: DataFrame) -> DataFrame:
    """(file, block, entry): where the chain from offset 0 of each file enters the splits it meets.

    Only candidates that some chain can enter a split at take part in pointer jumping, about one for each
    split, each with the place where its chain leaves the split as successor.
    """
    doors = links.filter("exit is not null").select("file", F.col("exit").alias("start")).distinct()
    doors = links.join(doors, ["file", "start"], "left_semi").unionByName(links.filter("start = 0")).select("file", "block", "start", "exit").distinct()
    doors = staged(doors, "warc-doors")
    chain = reachable(doors.select("file", "start", F.col("exit").alias("next")))
    return doors.join(chain, ["file", "start"], "left_semi").select("file", "block", F.col("start").alias("entry"))


def reachable(links: DataFrame) -> DataFrame:
    """(file, start) of the candidates on the chain from offset 0 of each file, by pointer jumping.

    Round k knows the first 2^k records and every candidate's 2^k-th successor; those of the
    known records are the next 2^k.  Offsets only grow along a chain, so they are new ones.
    """
    most = links.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    real = links.select("file", F.col("start").alias("next"))
    jump = staged(links.filter("next is not null").select("file", "start", "next").join(real, ["file", "next"]).select("file", "start", "next"), "warc-links")
    reached = links.filter("start = 0").select("file", "start")
    span = 1
    while span < most:
        ahead = jump.join(reached, ["file", "start"]).select("file", F.col("next").alias("start"))
        reached = reached.unionByName(ahead).coalesce(parts).checkpoint()
        further = jump.select("file", F.col("start").alias("next"), F.col("next").alias("far"))
        jump = jump.join(further, ["file", "next"]).select("file", "start", F.col("far").alias("next")).checkpoint()
        span *= 2
    return reached


def _apart(links: DataFrame, doors: DataFrame) -> DataFrame:
    """(file, block, inside, start, record) of the pieces that can't go straight through: rejected ones and the records
    that hold them; ``record`` is NULL for what belongs to no record (before the first magic)."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("inside", pa.int64()), ("start", pa.int64()), ("record", pa.int64())])

    def run(batches):  # sorted by (file, block, start): rejected candidates with the record before them, and a row for the split's last record (inside NULL)
        for split, rows in _by_split(batches):
            starts, ends = np.asarray(rows.column("start"), np.int64), np.asarray(rows.column("next").fill_null(-1), np.int64)
            entry, real = rows.column("entry")[0].as_py(), np.zeros(len(starts), bool)
            if entry is not None:
                after, _ = _chained(starts, ends)
                i = int(np.searchsorted(starts, entry))
                while not real[i]:
                    real[i] = True
                    i = int(after[i])
            bad, good = np.flatnonzero(~real), np.flatnonzero(real)
            before = np.searchsorted(good, bad) - 1  # place of the record that a rejected candidate follows
            record = np.where(before < 0, 0, starts[good][before]) if len(good) else np.zeros(len(bad), np.int64)
            own = rows.take(pa.array(bad)).select(["file", "block", "inside", "start"]).append_column("record", pa.array(record, mask=before < 0))
            yield from own.cast(schema).to_batches()
            if len(good):
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*split, None, None, int(starts[good[-1]])), schema)], schema=schema)

    key = ["file", "block"]
    seen = links.join(doors, key, "left").repartition(*key).sortWithinPartitions(*key, "start")
    seen = staged(seen.select(*key, "inside", "start", "next", "entry").mapInArrow(run, "file string, block long, inside long, start long, record long"), "warc-judged")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = links.select(*key).distinct().join(seen.filter("inside is null").select(*key, F.col("record").alias("last")), key, "left")
    splits = splits.select(*key, F.max("last").over(earlier).alias("earlier"))
    rejected = seen.filter("inside is not null").join(splits, key).select(*key, "inside", "start", F.coalesce("record", "earlier").alias("record"))
    rejected = staged(rejected, "warc-rejected")
    holders = rejected.filter("record is not null").select("file", F.col("record").alias("start")).distinct()
    holders = links.join(holders, ["file", "start"]).select(*key, "inside", "start", F.col("start").alias("record"))
    return staged(rejected.unionByName(holders), "warc-apart")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, type, record_id, uri, digest, length, refers_to, payload) of the verified records."""
    links, blocks = candidates(spark, path)
    apart = _apart(links, entries(links))
    key = ["file", "block", "inside"]
    raw = _read(spark, path).select("file", "block", F.octet_length("value").cast("long").alias("size"), "value")
    pieces = _placed(raw).join(F.broadcast(blocks), ["file", "block"], "left")  # a row for each split
    base = F.coalesce("base", F.raise_error(F.lit("the archive's splits changed between two scans; read it again")).cast("long"))
    pieces = pieces.select(*key, (base + F.col("inside") - len(MAGIC)).alias("start"), "value")
    whole = pieces.join(apart.select(*key), key, "left_anti").select("file", "start", F.col("value").alias("text"))
    held = apart.filter("record is not null")
    if not held.isEmpty():
        parts = pieces.drop("start").join(held, key).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("parts"))
        whole = whole.unionByName(parts.select("file", F.col("record").alias("start"), F.array_join(F.col("parts.value"), MAGIC).alias("text")))
    head = F.substring_index("text", END, 1)

    def field(name):
        return F.nullif(F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1), F.lit(""))

    whole = whole.withColumn("head", head).withColumn("length", field("Content-Length").cast("long"))
    rest = F.encode(F.expr("substring(text, char_length(head) + 5)"), "UTF-8")
    return whole.select("file", "start", field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("record_id"), field("WARC-Target-URI").alias("uri"),
                        field("WARC-Payload-Digest").alias("digest"), field("X-Payload-Length").cast("long").alias("payload_length"), field("WARC-Refers-To").alias("refers_to"),
                        F.substring(rest, F.lit(1), F.col("length").cast("int")).alias("payload"))


def round_trip(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write ``pages`` to the shared folder and read the records back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "llm-warc")
    write_warc(pages, path, min_revisit)
    return read_warc(spark, path)
