"""Suffix-array deduplication: maximal repeats from a common-prefix interval tree.

Every string of ``min_len`` bytes that starts at two or more places of the corpus is
a repeat.  A full suffix array of the corpus can't be built in one place, so the
array is sparse and sharded, without losing a repeat:

1. *Sample.*  Each ``min_len``-byte string chooses one anchor inside itself by its
   content (winnowing over ``seed``-byte grams).  Equal strings choose the same
   anchor at the same place, so only suffixes that start at anchors are needed:
   about 2 of ``min_len - seed`` positions.  Anchors whose gram is unique drop out.
2. *Collapse.*  Occurrences with the same anchored context (the union of all
   strings that chose the anchor) are one class with its count.  A class of two or more is
   a repeat with all its occurrences.
3. *Enhanced suffix array.*  For each gram with several contexts the suffixes are
   sorted, neighbours' common prefixes computed, and a stack scan builds the
   interval tree.  Within an interval (right extent r) the left contexts are
   sorted too; members that share l bytes to the left with l + r >= min_len form
   a repeat.  It is output when it can't be extended: the left characters
   differ (or stop), and the members don't all lie in one child interval.
4. Spans of one document are merged; overlaps count.

A gram with more than ``max_bucket`` contexts isn't gathered in one task: its strings
are compared one by one through grouped counts of their 128-bit hashes.

Edge cases: NULL text is empty; texts shorter than ``min_len`` bytes hold no
repeat but are returned; repeated rows are repeats of each other; an empty table gives an
empty result; extra columns are ignored.  Rows with a NULL or repeated ``doc_id`` are rows of
their own; the functions that list spans need a unique ``doc_id``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import CHUNK_BYTES, anchors, byte_values, narrow, on_rows, signed, staged, text_chunks

MIN_LEN = 400
SEED = 128
MAX_BUCKET = 5_000
SPAN = "doc_id long, start long, end long"


def _pieces(batch, min_len):
    """(doc_id, offset of the piece, bytes, row offsets): long texts are cut with an overlap of min_len - 1 bytes."""
    ids = batch.column("doc_id").to_pylist()
    for lo, hi, buf, off in text_chunks(batch):
        if len(buf) <= 2 * CHUNK_BYTES:
            yield ids[lo:hi], 0, buf, off
            continue
        for at in range(0, max(1, len(buf) - min_len + 1), CHUNK_BYTES):
            part = buf[at : at + CHUNK_BYTES + min_len - 1]
            yield ids[lo:hi], at, part, np.array([0, len(part)])


def sampled_suffixes(docs: DataFrame, min_len: int = MIN_LEN, seed: int = SEED) -> DataFrame:
    """One row per anchor: where it is, the windows [lo, hi] that chose it, its gram and context hashes."""

    def run(batches):
        for batch in batches:
            for ids, at, buf, off in _pieces(batch, min_len):
                row, a, lo, hi, gram = anchors(byte_values(buf), off, seed, min_len)
                if not len(row):
                    continue
                raw = memoryview(buf.tobytes())
                both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[x : y + min_len]) for x, y in zip(lo.tolist(), hi.tolist())]), np.int64).reshape(-1, 2)
                base = at - off[row]
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(ids, np.int64)[row]), pa.array(a + base), pa.array(lo + base), pa.array(hi + base), pa.array(signed(gram)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["doc_id", "a", "lo", "hi", "gram", "c1", "c2"])

    return docs.mapInArrow(run, "doc_id long, a long, lo long, hi long, gram long, c1 long, c2 long")


def _contexts(rows: DataFrame, docs: DataFrame, min_len: int) -> DataFrame:
    """Add the bytes left of each anchor (reversed) and from it on, read from the texts."""
    lists = rows.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "a", "lo", "hi", "hot")).alias("at"))

    def run(batches):
        for batch in batches:
            for doc, text, at in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("at")):
                raw = text.as_buffer().to_pybytes()
                at = at.as_py()
                yield pa.RecordBatch.from_pylist([{"doc_id": doc, "gram": x["gram"], "a": x["a"], "hot": x["hot"], "left": raw[x["lo"] : x["a"]][::-1], "right": raw[x["a"] : x["hi"] + min_len]} for x in at], schema=pa.schema([("doc_id", pa.int64()), ("gram", pa.int64()), ("a", pa.int64()), ("hot", pa.bool_()), ("left", pa.binary()), ("right", pa.binary())]))

    return docs.join(lists, "doc_id").mapInArrow(run, "doc_id long, gram long, a long, hot boolean, left binary, right binary")


def _common(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if x[:mid] == y[:mid] else (lo, mid)
    return lo


def intervals(lcp: list[int], n: int):
    """Stack scan of an enhanced suffix array: (depth, first, last) of every interval, children before parents.

    ``lcp[i]`` is the common prefix of suffixes i-1 and i (lcp[0] is unused).
    """
    stack = [(0, 0)]
    for i in range(1, n + 1):
        depth, first = (lcp[i] if i < n else -1), i - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i - 1
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def repeats(members: list[tuple], min_len: int) -> list[tuple[int, int, int, int]]:
    """(member, repeat number, left, right) for the repeats among (left reversed, right) contexts of one gram."""
    n = len(members)
    order = sorted(range(n), key=lambda i: members[i][1])
    lcp = [0] + [_common(members[order[i - 1]][1], members[order[i]][1]) for i in range(1, n)]
    left = sorted(range(n), key=lambda i: members[i][0])
    rank = [0] * n
    for r, i in enumerate(left):
        rank[i] = r
    llcp = np.array([0] + [_common(members[left[r - 1]][0], members[left[r]][0]) for r in range(1, n)])
    out, number, done = [], 0, {}
    for depth, first, last in intervals(lcp, n):
        if last == first or depth + max(len(members[i][0]) for i in order[first : last + 1]) < min_len:
            continue
        ranks = sorted(rank[i] for i in order[first : last + 1])
        need, run, shared = min_len - depth, [ranks[0]], []
        for prev, r in zip(ranks, ranks[1:] + [None]):
            common = int(llcp[prev + 1 : r + 1].min()) if r is not None else -1
            if common >= need:
                run.append(r)
                shared.append(common)
                continue
            if len(run) > 1:
                # neighbours' extents give each member its longest; the shortest holds for the whole run
                best = [max(shared[max(0, j - 1) : j + 1]) for j in range(len(run))]
                ids = frozenset(left[r2] for r2 in run)
                if done.get(ids, -1) < min(shared):  # not inside one child interval with the same left extent
                    out += [(left[r2], number, b, depth) for r2, b in zip(run, best)]
                    done[ids] = min(shared)
                    number += 1
            if r is not None:
                run, shared = [r], []
    return out


def _interval_tree(rows: DataFrame, min_len: int) -> DataFrame:
    """Repeats inside each gram; rows come sorted by (gram, right context)."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("gram", pa.int64()), ("number", pa.int64())]

    def run(batches):
        gram, group = None, []

        def close():
            found = repeats([g[2:] for g in group], min_len) if len(group) > 1 else []
            return [{"doc_id": group[i][0], "start": group[i][1] - left, "end": group[i][1] + right, "gram": gram, "number": number} for i, number, left, right in found]

        for batch in batches:
            out = []
            for g, doc, a, left, right in zip(*(batch.column(c).to_pylist() for c in ("gram", "doc_id", "a", "left", "right"))):
                if g != gram:
                    out += close()
                    gram, group = g, []
                group.append((doc, a, left, right))
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))
        yield pa.RecordBatch.from_pylist(close(), schema=pa.schema(fields))

    return rows.repartition("gram").sortWithinPartitions("gram", "right").mapInArrow(run, SPAN + ", gram long, number long")


def _one_by_one(rows: DataFrame, min_len: int) -> DataFrame:
    """Strings of grams with very many contexts, compared through grouped counts of their hashes."""

    def run(batches):
        for batch in batches:
            for doc, a, left, right in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "a", "left", "right"))):
                raw, lo = left[::-1] + right, a - len(left)
                n = len(raw) - min_len + 1
                both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[i : i + min_len]) for i in range(n)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, doc)), pa.array(np.arange(lo, lo + n)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["doc_id", "start", "c1", "c2"])

    strings = rows.mapInArrow(run, "doc_id long, start long, c1 long, c2 long")
    many = strings.groupBy("c1", "c2").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    strings, many = staged(strings, "strings"), staged(many, "many")
    return strings.join(many, ["c1", "c2"]).select("doc_id", "start", (F.col("start") + min_len).alias("end"))


def repeat_spans(docs: DataFrame, min_len: int = MIN_LEN, seed: int = SEED, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(doc_id, start, end): byte spans covered by repeats, as found (they may overlap)."""
    docs = narrow(docs)
    all_at = sampled_suffixes(docs, min_len, seed)
    again = all_at.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
    again = staged(again, "grams")  # read back, so that both sides of the joins are plain exchanges that can be split
    at = staged(all_at.join(again, "gram"), "suffixes")
    key = ["gram", "c1", "c2"]
    classes = staged(at.groupBy(*key).agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("doc_id", "a", "lo", "hi"))), "contexts")
    whole = at.join(classes.filter("n > 1").select(*key), key).select("doc_id", F.col("lo").alias("start"), (F.col("hi") + min_len).alias("end"))
    several = classes.groupBy("gram").agg(F.count("*").alias("m")).filter("m > 1").select("gram", (F.col("m") > max_bucket).alias("hot"))
    several = staged(several, "several")
    rows = staged(_contexts(classes.join(several, "gram"), docs, min_len), "context-bytes")
    tree = _interval_tree(rows.filter("not hot"), min_len).select("doc_id", "start", "end")
    return whole.unionByName(tree).unionByName(_one_by_one(rows.filter("hot"), min_len))


def maximal_repeats(docs: DataFrame, min_len: int = MIN_LEN, seed: int = SEED) -> DataFrame:
    """(repeat, doc_id, start, end): repeat groups of the interval trees with all their occurrences.

    A repeat longer than an anchor's context shows as one group for each anchor
    it holds; ``repeat`` names the gram and the group's number.
    """
    docs = narrow(docs)
    at = sampled_suffixes(docs, min_len, seed)
    again = at.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
    rows = _contexts(at.join(again, "gram").withColumn("hot", F.lit(False)), docs, min_len)
    return _interval_tree(rows, min_len).select(F.concat_ws("-", "gram", "number").alias("repeat"), "doc_id", "start", "end")


def remove_spans(docs: DataFrame, spans: DataFrame, whole_characters: bool = False) -> DataFrame:
    """Cut byte spans out of the texts: doc_id, n_bytes, n_removed, n_spans, kept (binary).

    A span may begin or end inside a character; with ``whole_characters`` such a character stays.
    """
    lists = spans.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("cut"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, cut in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("cut")):
                raw = text.as_buffer().to_pybytes()
                kept, at, n = [], 0, 0
                merged = []
                for s, e in sorted((c["start"], c["end"]) for c in cut.as_py() or []):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                for s, e in merged:
                    while whole_characters and s < e and raw[s] & 0xC0 == 0x80:
                        s += 1
                    while whole_characters and s < e < len(raw) and raw[e] & 0xC0 == 0x80:
                        e -= 1
                    kept.append(raw[at:s])
                    at, n = e, n + 1
                kept.append(raw[at:])
                kept = b"".join(kept)
                out.append({"doc_id": doc, "n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": n, "kept": kept})
                if len(kept) > CHUNK_BYTES or len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return narrow(docs).join(lists, "doc_id", "left").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def suffix_dedup(docs: DataFrame, min_len: int = MIN_LEN, seed: int = SEED, max_bucket: int = MAX_BUCKET, whole_characters: bool = False) -> DataFrame:
    """Every document with its repeats removed (see the module text)."""
    return on_rows(docs, lambda rows: remove_spans(rows, repeat_spans(rows, min_len, seed, max_bucket), whole_characters))

