"""Helpers shared by the operators: tables, the shared folder, and byte/word arrays.

Texts reach Python as Arrow batches.  ``text_chunks`` walks a batch in pieces of
bounded size without copying rows one by one, and ``words`` finds the words of a
piece with numpy.  A word is a maximal run of bytes other than 0x20 and
0x09-0x0D; because all of these are ASCII, UTF-8 text can be cut bytewise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.session import scratch_path

CHUNK_BYTES = 1 << 18
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrow(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with a NULL text read as empty; other columns are left out."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


ROW = "sitelens_row_key"


def stamped(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, bool]:
    """The rows with ``ROW``, a non-null number that no other row has, in the order of ``key`` (NULL last).

    It is ``key`` itself where that is so already; otherwise (second value) the rows are numbered once and written.
    """
    number = F.col(key).cast("long")
    most, null = docs.groupBy(number.alias("k")).agg(F.count("*").alias("n")).agg(F.max("n"), F.max(F.isnull("k"))).first()
    if (most or 0) <= 1 and not null:
        return docs.withColumn(ROW, number), False
    order = number.asc_nulls_last(), F.col(ROW)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.withColumn(ROW, F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return staged(rows.withColumn(ROW, F.monotonically_increasing_id()), "rows"), True


def on_rows(docs: DataFrame, operator, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``operator`` over (doc_id, text) with each row under its own key; ``columns`` of the result turn back into doc_ids."""
    rows, numbered = stamped(narrow(docs))
    out = operator(rows.select(F.col(ROW).alias("doc_id"), "text"))
    if numbered:
        for c in columns:
            names = rows.select(F.col(ROW).alias("key_"), F.col("doc_id").alias("name_"))
            out = out.join(names, out[c] == F.col("key_")).withColumn(c, F.col("name_")).select(*out.columns)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all input bits."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_B = 0x9E3779B97F4A7C15
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POW: list = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POW[0]) < n:
        m = max(n, CHUNK_BYTES + 4096)
        _POW[:] = [powers(_B, m), powers(pow(_B, -1, 1 << 64), m)]
    return _POW[0], _POW[1]


class Rolling:
    """Hashes of any [start, end) span of a symbol array from one prefix sum (arithmetic modulo 2**64)."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        p, self.inv = _pow(self.n + 1)
        self.sum = np.zeros(self.n + 1, np.uint64)
        np.cumsum(values * p[: self.n], out=self.sum[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.inv[start] + (end - start).astype(np.uint64))

    def grams(self, k: int, mixed: bool = True) -> np.ndarray:
        """Hash of every window of k symbols."""
        m = max(0, self.n - k + 1)
        h = (self.sum[k : k + m] - self.sum[:m]) * self.inv[:m]
        return mix(h) if mixed else h


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _TABLE[buf]


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces (first row, end row, bytes, row offsets in the bytes) of about ``limit`` bytes; one row is never cut."""
    col = batch.column(column)
    col = col.cast(pa.large_string()) if col.null_count == 0 else pa.compute.fill_null(col.cast(pa.large_string()), "")
    if len(col) == 0:
        return
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; row offsets cut words too."""
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    before = np.empty(len(buf), bool)
    before[0] = False
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | cut[:-1]))
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Rolling(byte_values(buf)).spans(start, end) if len(start) else np.zeros(0, np.uint64)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf | 32, buf).astype(np.uint8)


def anchors(values: np.ndarray, off: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, ...]:
    """Winnowing: one anchor for each run of windows that choose it.

    Every window of ``window`` symbols inside one row chooses the smallest hash of
    its ``gram``-symbol grams, the last of equals.  The choice depends on the
    window's content alone, so equal windows choose equal grams at equal places.
    Returns (row, anchor, first window, last window, hash of the gram), positions
    counted in ``values``.
    """
    n, span = len(values), window - gram + 1
    if n < window:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    h = Rolling(values).grams(gram, mixed=False)
    low = (np.uint64(1) << np.uint64(int(n).bit_length())) - np.uint64(1)
    key = (h & ~low) | np.arange(n, n - len(h), -1).astype(np.uint64)
    width = 1
    while width < span:  # smallest key of ever wider windows
        step = min(width, span - width)
        key = np.minimum(key[:-step], key[step:])
        width += step
    at = n - (key & low).astype(np.int64)
    new = np.empty(len(at), bool)  # a window that starts a run: another anchor, or another row
    new[0] = True
    np.not_equal(at[1:], at[:-1], out=new[1:])
    new[off[:-1][off[:-1] < len(at)]] = True
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(at)] - 1
    row = np.searchsorted(off, first, "right") - 1
    last = np.minimum(last, off[row + 1] - window)  # windows that cross the row's end don't count
    ok = first <= last
    row, first, last = row[ok], first[ok], last[ok]
    return row, at[first], first, last, mix(h[at[first]])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
