"""Jaccard self-join of word n-gram sets by chosen paths.

Sets are split recursively on sampled tokens that they share: a set of n tokens
takes the tokens whose hash in this run is below 1 / (similarity * n), about
1.25 of them, so similar sets tend to take the same one.  Sets that took the same token share
a bucket.  A bucket of more than ``bucket`` sets is split again
(the path grows by a token): each set goes on with ``CHILDREN`` tokens of its sketch (below), each the first in an
order of the bins that is drawn anew from the bucket's path, so every bucket of every run splits independently.  Two
sets of any size share such a token with a chance equal to their similarity.  A bucket that doesn't
fall apart, because half of it shares one token again, is a clump of similar sets and is
split no further.  Buckets are compared by brute force.  Runs are repeated until the
target recall: two sets at the similarity share a token's sample with a chance of
at least 1 - 1/e in a run and stay together in ``SPLITS`` splits with a chance of
(1 - (1 - similarity) ** CHILDREN) ** SPLITS, so ``RUNS`` runs miss a pair with a chance below 1e-5.

* Equal sets are collapsed first, by a 128-bit digest: copies aren't compared.
* Inside a bucket, one-permutation sketches (64 bins) rule out pairs that are
  five standard errors below the similarity.  Only a spanning forest of the rest leaves the bucket, never
  its pairs.  A bucket that stays large (a clump, or after the last split) goes in
  tiles, so every comparison is made and no task holds more than two tiles.
* The forests' connected components are the groups in which links are decided
  exactly: each group's sets meet once, intersections are counted through an
  inverted index, and large groups go in tiles.  Out come the links of each set and
  a spanning forest of the true links; its components are the classes.

Result: one row per document with its class (the smallest doc_id in it) and the number of other
documents it is linked with, copies included.  Sets with fewer than n words
are one token of all their words.

Edge cases: NULL or wordless texts are linked with nothing and are their own class; repeated
rows are copies; very long texts are read whole; an empty table gives an empty result; extra
columns are ignored.  Rows with a NULL or repeated ``doc_id`` are documents of their own; a class of
NULLs alone is named NULL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import Rolling, mix, on_rows, signed, staged, text_chunks, word_hashes, words
from sitelens.llm.components import connected

NGRAM, SIMILARITY = 5, 0.8
RUNS, CHILDREN, SPLITS = 12, 4, 4
BUCKET, TILE = 4000, 1000
BINS = 64
EMPTY = 65535
_CHILD_KEYS = mix(np.arange(1, CHILDREN + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
_RUN_KEYS = [int(x) for x in mix(np.arange(1, RUNS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)]


def shingle_sets(buf: np.ndarray, off: np.ndarray, ngram: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): each text's distinct n-grams of words, sorted."""
    s, e, row = words(buf, off)
    h = word_hashes(buf, s, e)
    n = len(off) - 1
    woff = np.searchsorted(row, np.arange(n + 1))
    roll = Rolling(h)
    grams = roll.grams(ngram)
    grow = row[: len(grams)]
    ok = row[ngram - 1 : ngram - 1 + len(grams)] == grow
    count = np.diff(woff)
    short = np.flatnonzero((count > 0) & (count < ngram))
    tokens = np.concatenate([grams[ok], roll.spans(woff[short], woff[short + 1])])
    trow = np.concatenate([grow[ok], short])
    order = np.lexsort((tokens, trow))
    tokens, trow = tokens[order], trow[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (trow[1:] != trow[:-1])
    return np.searchsorted(trow[new], np.arange(n + 1)), tokens[new]


def samples(toff: np.ndarray, tokens: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the tokens that the sets take in the runs; a key names run and token."""
    size = np.diff(toff)
    row = np.repeat(np.arange(len(size)), size)
    limit = np.minimum(2.0**64 / (similarity * np.maximum(size, 1)), 2.0**64 - 2049).astype(np.uint64)[row]
    found = []
    for key in _RUN_KEYS:
        at = np.flatnonzero(tokens * np.uint64(key) < limit)
        found.append((row[at], mix(tokens[at] ^ np.uint64(key))))
    rows, keys = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(rows, kind="stable")
    return rows[order], keys[order]


def sketches(toff: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """One-permutation sketch: the least token of each of 64 bins (16 bits), EMPTY where there is none."""
    out = np.full((len(toff) - 1, BINS), EMPTY, np.uint16)
    row = np.repeat(np.arange(len(toff) - 1), np.diff(toff))
    bins = (tokens >> np.uint64(58)).astype(np.int64)
    first = np.ones(len(tokens), bool)
    first[1:] = (bins[1:] != bins[:-1]) | (row[1:] != row[:-1])  # tokens are sorted
    out[row[first], bins[first]] = np.minimum((tokens[first] >> np.uint64(42)) & np.uint64(0xFFFF), EMPTY - 1)
    return out


def children(parents: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """CHILDREN paths for each (bucket, set): the set's token in the first filled bin of an order drawn from the bucket's path."""
    out = np.empty((len(parents), CHILDREN), np.uint64)
    rows, bins = np.arange(len(parents)), np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    low = np.uint64(BINS - 1)
    for child in range(CHILDREN):
        seed = mix(parents ^ _CHILD_KEYS[child])
        order = mix(seed[:, None] ^ bins) & ~low | np.arange(BINS, dtype=np.uint64)
        at = (np.where(sketch == EMPTY, ~np.uint64(0), order).min(1) & low).astype(np.int64)
        out[:, child] = mix(seed + (at.astype(np.uint64) << np.uint64(16) | sketch[rows, at]) * np.uint64(0xD6E8FEB86659FD93))
    return out


def _sets(docs: DataFrame, ngram: int, similarity: float) -> DataFrame:
    """One row per document: the digest of its set, its size, samples and sketch."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, buf, off in text_chunks(batch):
                toff, tokens = shingle_sets(buf, off, ngram)
                raw = memoryview(np.ascontiguousarray(tokens).tobytes())
                both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[8 * x : 8 * y]) for x, y in zip(toff[:-1].tolist(), toff[1:].tolist())]), np.int64).reshape(-1, 2)
                rows, keys = samples(toff, tokens, similarity)
                poff = pa.array(np.searchsorted(rows, np.arange(hi - lo + 1)), pa.int32())
                sketch = pa.array([x.tobytes() for x in sketches(toff, tokens)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(np.diff(toff)), pa.ListArray.from_arrays(poff, pa.array(signed(keys))), sketch], names=["doc_id", "s1", "s2", "n", "picks", "sketch"])

    return docs.mapInArrow(run, "doc_id long, s1 long, s2 long, n long, picks array<long>, sketch binary")


def _buckets(paths: DataFrame) -> DataFrame:
    """(path, doc_id, m) of the paths that at least two sets took."""
    sizes = staged(paths.groupBy("path").agg(F.count("*").alias("m")).filter("m > 1"), "path-sizes")
    return staged(paths.join(sizes, "path").select("path", "doc_id", "m"), "paths")


def _parts(large: DataFrame) -> DataFrame:
    """(parent, whole, path, doc_id): the sets of large buckets in the buckets they go on to."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                sketch = np.frombuffer(b"".join(piece.column("sketch").to_pylist()), np.uint16).reshape(-1, BINS)
                paths = children(np.asarray(piece.column("parent"), np.int64).view(np.uint64), sketch)
                again = np.repeat(np.arange(len(paths)), CHILDREN)
                yield pa.RecordBatch.from_arrays([piece.column("parent").take(pa.array(again)), piece.column("whole").take(pa.array(again)), pa.array(signed(paths.ravel())), piece.column("doc_id").take(pa.array(again))], names=["parent", "whole", "path", "doc_id"])

    return large.select("parent", "whole", "doc_id", "sketch").mapInArrow(run, "parent long, whole long, path long, doc_id long")


def _leaves(reps: DataFrame, bucket: int) -> DataFrame:
    """(path, doc_id, m): the buckets to compare by brute force."""
    rows = _buckets(reps.select(F.explode("picks").alias("path"), "doc_id"))
    leaves = rows.filter(F.col("m") <= bucket)
    for level in range(SPLITS):
        large = rows.filter(F.col("m") > bucket).select(F.col("path").alias("parent"), F.col("m").alias("whole"), "doc_id")
        if large.isEmpty():
            return leaves
        parts = staged(_parts(large.join(reps.select("doc_id", "sketch"), "doc_id")), "path-parts")
        sizes = staged(parts.groupBy("parent", "whole", "path").agg(F.count("*").alias("m")), "path-sizes")
        clumps = staged(sizes.groupBy("parent", "whole").agg(F.max("m").alias("top")).filter("2 * top >= whole").select("parent"), "path-clumps")
        leaves = leaves.unionByName(large.join(clumps, "parent", "left_semi").select(F.col("parent").alias("path"), "doc_id", F.col("whole").alias("m")))
        small = staged(sizes.join(clumps, "parent", "left_anti").filter("m > 1").select("path", "m"), "path-sizes")
        rows = staged(parts.join(small, "path").select("path", "doc_id", "m"), "paths")
        leaves = leaves.unionByName(rows if level == SPLITS - 1 else rows.filter(F.col("m") <= bucket))
    return leaves


def _tiled(rows: DataFrame, key: str, m: str, size: int) -> DataFrame:
    """Groups of more than ``size`` rows as tiles: every two blocks meet once.  Adds ``group`` and ``block``."""
    n = F.ceil(F.col(m) / size).cast("int")
    rows = rows.withColumn("blocks", n).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))
    return rows.withColumn("tile", F.explode(pairs)).withColumn("group", F.xxhash64(key, "tile.x", "tile.y")).withColumn("block", F.when(F.col("tile.x") == F.col("tile.y"), -1).otherwise(F.col("block"))).drop("tile", "blocks")


def _grouped(rows: DataFrame, columns: list[str], each, schema: str, arrow: pa.Schema) -> DataFrame:
    """Call ``each(lists of the columns)`` for every group; rows of a group are neighbours after the sort."""

    def run(batches):
        key, held = None, [[] for _ in columns]
        for batch in batches:
            out = []
            keys = np.asarray(batch.column("group"))
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else [0]
            data = [batch.column(c).to_pylist() for c in columns]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if keys[lo] != key:
                    if key is not None and len(held[0]) > 1:
                        out += each(*held)
                    key, held = keys[lo], [[] for _ in columns]
                for h, d in zip(held, data):
                    h += d[lo:hi]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if key is not None and len(held[0]) > 1:
            yield pa.RecordBatch.from_pylist(each(*held), schema=arrow)

    return rows.select("group", *columns).repartition("group").sortWithinPartitions("group", "doc_id").mapInArrow(run, schema)


def sketch_forest(ids: list, blocks: list, sketch: list, similarity: float) -> list[tuple]:
    """Spanning forest of the sketches that may be similar: each is compared with all that no tree has reached yet."""
    s = np.frombuffer(b"".join(sketch), np.uint16).reshape(len(ids), BINS)
    full = s != EMPTY
    blocks = np.array(blocks)
    rest, edges = np.arange(len(ids)), []
    # in a tile of two blocks pairs inside a block belong to other tiles, but comparing them does no harm
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            either = (full[rest] | full[x]).sum(1)
            match = ((s[rest] == s[x]) & full[x]).sum(1)
            near = match >= (similarity - 5 * np.sqrt(similarity * (1 - similarity) / np.maximum(either, 1))) * either
            edges += [(ids[x], ids[y]) for y in rest[near]]
            todo += rest[near].tolist()
            rest = rest[~near]
    return edges


def exact_links(ids: list, blocks: list, copies: list, sets: list, similarity: float) -> list[tuple]:
    """(doc_id, linked copies, doc_id of its tree) for the sets of one group that have links."""
    m = len(ids)
    size = np.array([len(x) // 8 for x in sets])
    tokens = np.frombuffer(b"".join(sets), np.uint64)
    row = np.repeat(np.arange(m), size)
    order = np.argsort(tokens, kind="stable")
    t, post = tokens[order], row[order]
    new = np.ones(len(t), bool)
    new[1:] = t[1:] != t[:-1]
    start = np.flatnonzero(new)
    df = np.diff(np.concatenate([start, [len(t)]]))
    term = np.empty(len(t), np.int64)
    term[order] = np.cumsum(new) - 1
    off = np.concatenate([[0], np.cumsum(size)])
    blocks, copies = np.array(blocks), np.array(copies)
    links, linked = np.zeros(m, np.int64), [None] * m
    for i in range(m):
        mine = term[off[i] : off[i + 1]]
        mine = mine[df[mine] > 1]
        n = df[mine]
        at = np.repeat(start[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(mine) else np.zeros(0, np.int64)
        inter = np.bincount(post[at], minlength=m)
        near = inter >= similarity * (size[i] + size - inter) - 1e-9
        near[i] = False
        if blocks[i] >= 0:
            near &= blocks != blocks[i]
        linked[i] = np.flatnonzero(near)
        links[i] = copies[linked[i]].sum()
    tree = np.full(m, -1)
    for i in range(m):
        if tree[i] < 0:
            tree[i], todo = i, [i]
            while todo:
                x = todo.pop()
                fresh = linked[x][tree[linked[x]] < 0]
                tree[fresh] = i
                todo += fresh.tolist()
    return [(ids[i], int(links[i]), ids[tree[i]]) for i in range(m) if len(linked[i])]


def similar_documents(docs: DataFrame, ngram: int = NGRAM, similarity: float = SIMILARITY, bucket: int = BUCKET, tile: int = TILE) -> DataFrame:
    """(doc_id, class_id, n_links) for every document (see the module text)."""
    return on_rows(docs, lambda rows: _similar(rows, ngram, similarity, bucket, tile), ("doc_id", "class_id"))


def _similar(docs: DataFrame, ngram: int, similarity: float, bucket: int, tile: int) -> DataFrame:
    sets = staged(_sets(docs, ngram, similarity), "sets")
    classes = staged(sets.filter("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "set-classes")
    reps = staged(sets.join(classes.select(F.col("rep").alias("doc_id"), "copies"), "doc_id").select("doc_id", "copies", "picks", "sketch").dropDuplicates(["doc_id"]), "set-reps")
    leaves = _leaves(reps, bucket)
    held = _tiled(leaves, "path", "m", bucket).join(reps.select("doc_id", "sketch"), "doc_id")
    pair = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    forest = _grouped(held, ["doc_id", "block", "sketch"], lambda i, b, s: [{"a": x, "b": y} for x, y in sketch_forest(i, b, s, similarity)], "a long, b long", pair)
    groups = staged(connected(forest), "groups")

    sizes = staged(groups.groupBy("component").agg(F.count("*").alias("m")), "group-sizes")
    members = _tiled(groups.join(sizes, "component"), "component", "m", tile).join(reps.select("doc_id", "copies"), "doc_id")
    lists = members.groupBy("doc_id", "copies").agg(F.collect_list(F.struct("group", "block")).alias("at"))
    schema = pa.schema([("group", pa.int64()), ("doc_id", pa.int64()), ("copies", pa.int64()), ("block", pa.int32()), ("tokens", pa.binary())])

    def spread(batches):
        for batch in batches:
            where, copies, ids = batch.column("at").to_pylist(), batch.column("copies").to_pylist(), batch.column("doc_id").to_pylist()
            for lo, hi, buf, off in text_chunks(batch):
                toff, tokens = shingle_sets(buf, off, ngram)
                raw = tokens.tobytes()
                out = [{"group": w["group"], "doc_id": ids[lo + i], "copies": copies[lo + i], "block": w["block"], "tokens": raw[8 * toff[i] : 8 * toff[i + 1]]} for i in range(hi - lo) for w in where[lo + i]]
                for at in range(0, len(out), 2000):
                    yield pa.RecordBatch.from_pylist(out[at : at + 2000], schema=schema)

    placed = docs.join(lists, "doc_id").mapInArrow(spread, "group long, doc_id long, copies long, block int, tokens binary")
    found = pa.schema([("doc_id", pa.int64()), ("links", pa.int64()), ("tree", pa.int64())])
    links = _grouped(placed, ["doc_id", "block", "copies", "tokens"], lambda i, b, c, s: [{"doc_id": x, "links": n, "tree": t} for x, n, t in exact_links(i, b, c, s, similarity)], "doc_id long, links long, tree long", found)
    links = staged(links, "links")
    trees = connected(links.select(F.col("doc_id").alias("a"), F.col("tree").alias("b"))).withColumnRenamed("doc_id", "rep")
    number = links.groupBy(F.col("doc_id").alias("rep")).agg(F.sum("links").alias("links"))
    marked = staged(classes.join(trees, "rep", "left").join(number, "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "set-marks")
    empty = sets.filter("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return sets.filter("n > 0").select("doc_id", "s1", "s2").join(marked, ["s1", "s2"]).select("doc_id", "class_id", "n_links").unionByName(empty)
