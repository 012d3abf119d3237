"""Distributed positions in a total order, by refinement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.session import scratch_path

ROWS = 1_000_000  # rows that one task sorts
CUTS = 64  # parts of a round
SAMPLE = 2048  # keys that place the cuts of a round
_AT_BITS = 33  # low bits of a generated id: the place in its partition


def _literal(key, types) -> Column:
    return F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(key, types))])


def _within(keyed: DataFrame, low, high, types) -> DataFrame:
    if low is not None:
        keyed = keyed.filter(F.col("_key") >= _literal(low, types))
    return keyed if high is None else keyed.filter(F.col("_key") < _literal(high, types))


def _interval(keyed: DataFrame, total: int, first: int, last: int, rows: int) -> tuple[DataFrame, int, int]:
    """The rows of a key interval that holds positions first..last, how many come before it and how many it has.

    Each round cuts the interval at about ``CUTS`` sampled keys, counts the parts and keeps
    those that hold the positions, until ``rows`` or fewer, or twice what is asked for, are left or no cut helps.
    """
    types = [f.dataType for f in keyed.schema["_key"].dataType.fields]
    low = high = None
    before, inside = 0, total
    while inside > max(rows, 2 * (last - first + 1)):
        here = _within(keyed, low, high, types)
        some = here.filter(F.pmod(F.xxhash64("_key"), F.lit(-(-inside // SAMPLE))) == 0).select("_key")
        got = [r["_key"] for r in some.orderBy("_key").collect()]
        step = max(1, len(got) // CUTS)
        cuts = got[step::step]
        part = reduce(lambda a, b: a + b, [(F.col("_key") >= _literal(c, types)).cast("int") for c in cuts], F.lit(0))
        counts = {r["p"]: r["count"] for r in here.groupBy(part.alias("p")).count().collect()}
        ends, seen = [], before
        for p in range(len(cuts) + 1):
            seen += counts.get(p, 0)
            ends.append(seen)
        i = next(p for p, end in enumerate(ends) if end >= first)
        j = next(p for p, end in enumerate(ends) if end >= min(last, ends[-1]))
        low, high = (cuts[i - 1] if i else low), (cuts[j] if j < len(cuts) else high)
        before = ends[i - 1] if i else before
        if ends[j] - before == inside:
            break
        inside = ends[j] - before
    return _within(keyed, low, high, types), before, inside


def _numbered(keyed: DataFrame, n: int, before: int, rows: int, col: str) -> DataFrame:
    """Positions of ``n`` rows, counted from ``before`` + 1.

    More than ``rows`` of them are dealt by key range to as many sorted partitions as that takes, and written once:
    a row's place in its partition and the counts of the partitions ahead, a few thousand numbers, give its position.
    """
    if n <= rows:
        return keyed.withColumn(col, (F.row_number().over(Window.orderBy("_key")) + before).cast("long"))
    spark = keyed.sparkSession
    placed = keyed.repartitionByRange(-(-n // rows), "_key").sortWithinPartitions("_key").withColumn("_at", F.monotonically_increasing_id())
    path = scratch_path(spark, "positions")
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path).withColumn("_part", F.shiftright("_at", _AT_BITS))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = offsets.select("_part", F.coalesce(F.sum("_cnt").over(ahead), F.lit(0)).alias("_off"))
    pos = F.col("_off") + F.col("_at").bitwiseAND((1 << _AT_BITS) - 1) + (before + 1)
    return placed.join(F.broadcast(offsets), "_part").withColumn(col, pos.cast("long")).drop("_part", "_off", "_at")


def global_positions(df: DataFrame, order: list[Column], col: str = "pos", ranges: list[tuple[int, int]] | None = None,
                     rows: int = ROWS) -> DataFrame:
    """1-based position of every row in the ascending order of the ``order`` expressions.

    The expressions must form a total order (end with a unique key); NULL comes
    first.  With ``ranges`` only rows at those (first, last) positions are returned, and
    only the key interval that holds them is sorted; it is found by counting, not by sorting (``_interval``).
    No task sorts many more than ``rows`` rows: the number of parts follows the row count
    (Spark's range sample keeps parts near that size up to about 10,000 of them).  Jobs run when the plan is
    built: one count, and two small ones for each round.
    """
    keyed = df.withColumn("_key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    total = keyed.count()
    if ranges is None:
        return _numbered(keyed, total, 0, rows, col).drop("_key")
    wanted: list[tuple[int, int]] = []
    for lo, hi in sorted((max(1, lo), hi) for lo, hi in ranges if hi >= max(1, lo)):
        if wanted and lo <= wanted[-1][1] + 1:
            wanted[-1] = (wanted[-1][0], max(hi, wanted[-1][1]))
        else:
            wanted.append((lo, hi))
    found = []
    for lo, hi in wanted:
        if lo <= total:
            part, before, inside = _interval(keyed, total, lo, hi, rows)
            found.append(_numbered(part, inside, before, rows, col).filter(F.col(col).between(lo, hi)))
    if not found:
        return keyed.withColumn(col, F.lit(None).cast("long")).filter(F.lit(False)).drop("_key")
    return reduce(DataFrame.unionByName, found).drop("_key")
