"""Exact top-k inner-product search with multi-resolution segment statistics.

Components are floored to integers, floor(scale * x), so scores are exact.  For
a segment of length L the parts of two vectors split into mean and
deviation, and by Cauchy-Schwarz  q.x <= sum_s L * (mq * mx + sq * sx).  The
squared distance |q|^2 + |x|^2 - 2 q.x is bounded from below by the same sum.
More segments give a tighter bound: candidates are cut by the coarsest level
first, then by finer ones, and exact products are computed for survivors only.
A bound cuts a candidate only when it is below the k-th score already found
(a small slack covers rounding), so the result is exact and ties stay.

Queries and vectors are dealt into shares by a hash of their ids, and every share of queries meets every
share of vectors in a cell of a grid.  Both sides travel to the cells by a shuffle, so nothing goes through
the driver and nothing is broadcast.  A share holds about ``block`` rows, and ``COMPONENTS`` numbers where vectors are
long; that bounds a cell's memory, and only the number of cells grows with the tables.  A cell keeps k rows per query, and the
cells' rows are merged by a window limited to k rows per query before the shuffle.

Edge cases: vectors that are NULL, empty, or hold NULL or non-finite components, and rows with a NULL ``vec_id``, take no
part (neither as query nor as candidate); of rows with one ``vec_id`` the one with the smallest vector stands for it; vectors of another length than a
query's aren't comparable to it; components of any size count, scores stay exact and are cut off at
the limits of a long (a component that overflows a double when scaled counts unscaled); equal scores go to the smaller id;
fewer than k candidates give all of them; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import staged

SCALE = 256
BLOCK, COMPONENTS = 1 << 14, 1 << 20  # rows of a share, and its numbers (8 MB)
SLICE, STEP = 4096, 1024  # queries and vectors bounded at a time inside a cell
SLACK = 1e-3
PAIRS = 1 << 16  # pairs multiplied at a time where numbers are large
WHOLE, LIMIT = 2**53, 2**63  # doubles hold all integers below the first, a long those below the second


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, vec): integer components as doubles; unusable vectors left out, one row for each id."""
    v = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def floored(x):
        y = x.cast("double") * scale
        return F.when(F.abs(y) < WHOLE, F.floor(y).cast("double")).when(F.abs(y) == float("inf"), x.cast("double")).otherwise(y)  # larger doubles are whole numbers

    rows = vectors.filter(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, floored).alias("vec"))
    if rows.groupBy("vec_id").count().filter("count > 1").isEmpty():
        return rows
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows (broadcast against each other) as long, cut off at its limits."""
    high = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[-1]
    if high < WHOLE:
        return (q * x).sum(-1).astype(np.int64)
    if high < LIMIT:
        return (q.astype(np.int64) * x.astype(np.int64)).sum(-1)
    rows = [sum(int(a) * int(b) for a, b in zip(m, n)) for m, n in zip(*np.broadcast_arrays(q, x))]
    return np.array([min(max(r, 1 - LIMIT), LIMIT - 1) for r in rows], np.int64)


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments, each times the square root of its length."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    n = np.diff(edges)
    total = np.add.reduceat(x, edges[:-1], axis=1)
    square = np.add.reduceat(x * x, edges[:-1], axis=1)
    return total / np.sqrt(n), np.sqrt(np.maximum(square - total * total / n, 0))


def levels(dim: int) -> list[int]:
    """Segments per level, coarse to fine: 1, 4, 16, ... up to a quarter of the components."""
    out, n = [], 1
    while n <= max(1, dim // 4):
        out.append(n)
        n *= 4
    return out


def _rows(rows: pa.Table) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Ids, and by vector length the rows and their matrix."""
    ids, col = rows.column("vec_id").to_numpy().astype(np.int64), pa.concat_arrays(rows.column("vec").chunks or [pa.array([], pa.list_(pa.float64()))])
    size = np.diff(np.asarray(col.offsets))
    flat = np.asarray(col.flatten(), np.float64)
    start = np.cumsum(size) - size
    return ids, {int(d): (np.flatnonzero(size == d), flat[(start[size == d][:, None] + np.arange(d))]) for d in np.unique(size) if d}


def _best(scores, ids, owner, k):
    """The k best rows of each owner, ties to the smaller id."""
    order = np.lexsort((ids, -scores, owner))
    scores, ids, owner = scores[order], ids[order], owner[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    keep = rank < k
    return scores[keep], ids[keep], owner[keep]


def _survivors(qid, pid, stats, kth, part):
    """Pairs of a query and another vector that no level's bound cuts."""
    alive = None
    for n, mq, sq in stats:
        mx, sx = statistics(part, n)
        if alive is None:  # the coarsest level looks at every pair
            bound = mq @ mx.T + sq @ sx.T
            qi, xi = np.nonzero((bound + SLACK * (1 + np.abs(bound)) >= kth[:, None]) & (qid[:, None] != pid))
        elif len(qi) > len(qid) * len(pid) // 4:  # too many survivors for gathering: next level as a product
            bound = (mq @ mx.T + sq @ sx.T)[qi, xi]
        else:
            bound = np.einsum("ij,ij->i", mq[qi], mx[xi]) + np.einsum("ij,ij->i", sq[qi], sx[xi])
        if alive is not None:
            keep = bound + SLACK * (1 + np.abs(bound)) >= kth[qi]
            qi, xi = qi[keep], xi[keep]
        alive = True
    return qi, xi


def _search(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best (score, vec_id, place of the query) of each query among the vectors, one slice of them after the other."""
    stats, kth, best = [(n, *statistics(q, n)) for n in levels(q.shape[1])], np.full(len(qid), -np.inf), (np.zeros(0, np.int64),) * 3
    for lo in range(0, len(ids), STEP):
        part, pid = x[lo : lo + STEP], ids[lo : lo + STEP]
        if np.abs(q).max(initial=0) * np.abs(part).max(initial=0) * q.shape[1] >= WHOLE:  # bounds would round too much: every pair, exactly
            qi, xi = np.nonzero(qid[:, None] != pid)
            exact = np.concatenate([products(q[qi[a : a + PAIRS]], part[xi[a : a + PAIRS]]) for a in range(0, max(1, len(qi)), PAIRS)])
        else:
            qi, xi = _survivors(qid, pid, stats, kth, part)
            exact = ((q @ part.T)[qi, xi] if len(qi) > len(qid) * len(pid) // 16 else np.einsum("ij,ij->i", q[qi], part[xi])).astype(np.int64)
        best = _best(np.r_[best[0], exact], np.r_[best[1], pid[xi]], np.r_[best[2], qi], k)
        full = np.flatnonzero(np.bincount(best[2], minlength=len(qid)) >= k)
        if len(full):
            kth[full] = best[0][np.searchsorted(best[2], full, "right") - 1]
    return best


def _cell(k: int):
    """Task of a cell: a share of queries against a share of vectors."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        (qids, queries), (ids, vectors), out = _rows(asked), _rows(held), [schema.empty_table()]
        for dim in queries.keys() & vectors.keys():
            (q_at, q), (at, x) = queries[dim], vectors[dim]
            for lo in range(0, len(q), SLICE):
                own = qids[q_at[lo : lo + SLICE]]
                score, found, place = _search(own, q[lo : lo + SLICE], ids[at], x, k)
                out.append(pa.table([own[place], found, score], schema=schema))
        return pa.concat_tables(out)

    return run


def _share_count(rows: DataFrame, block: int) -> tuple[int, int]:
    """How many shares the rows make, and the rows."""
    n, numbers = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("vec").cast("long")), F.lit(0))).first()
    return max(1, -(-n // block), -(-numbers // COMPONENTS)), n


def _dealt(rows: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
    """The rows under their share ``own``, once for every share of the other side."""
    share = F.pmod(F.xxhash64("vec_id"), F.lit(n_own)).cast("int")
    return rows.select(share.alias(own), F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other), "vec_id", "vec")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query, itself excluded."""
    base = staged(usable(vectors, scale), "vectors")
    asked = staged(usable(queries, scale), "queries")
    (n_asked, _), (n_base, rows) = _share_count(asked, block), _share_count(base, block)
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_base = max(n_base, min(-(-tasks // n_asked), -(-rows // STEP)))  # small tables still make a cell for each task
    cell = ["asked_share", "base_share"]
    left = _dealt(asked, "asked_share", n_asked, "base_share", n_base)
    right = _dealt(base, "base_share", n_base, "asked_share", n_asked)
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_cell(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
