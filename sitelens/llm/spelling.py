"""Spelling variant grouping: range searches in k-d trees over letter-count vectors.

*Words* are maximal runs of Latin letters, lower-cased (A-Z only), counted over all texts; a
fixed share of the runs, chosen by a checksum of row and run, loses one letter first (the slips to be found).

*Search.*  One edit (a letter inserted, deleted or replaced) changes a word's letter-count vector by at most one
count up and one down, so two near words are within an L1 distance of two.  For each length
a k-d tree splits the vectors; a word searches the trees of its own length (one up, one down), of the next
(one up) and of the one before (one down).  A branch is pruned when its box can't be reached within
that, crossing a dimension twice counting once.  What is left in a leaf is compared letter by letter.

*Distribution.*  The upper part of each length's tree is built from a bounded hashed sample (it only
balances the work; every word is indexed and every word asks).  Its leaves are cells: a word is dealt to
its home cell and to the cells that its search reaches.  Cells with many words (words of one vector can't be
parted by any plane) are laid out in tiles, and cells with many askers in shares, so a group holds at most
about ``TILE`` words and ``SHARE`` askers and no pair is lost.  In a group the lower tree is built
in numpy over the tile's words, and the askers stream through it.  A group returns one row for each asker with hits, so pairs are never shuffled.

*Forms.*  A word's form is its most frequent near word (ties: the smaller in code-point order) if that occurs at
least ``RATIO`` times as often.  Counts at least double along a chain of forms, so its root is found by a few rounds of pointer doubling.

Edge cases: NULL and empty texts hold no words; a NULL doc_id reads as the empty string in the checksum; repeated rows are
counted each; runs and texts of any length are read whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import narrow, staged

MIN_LETTERS, MIN_COUNT, RATIO = 5, 3, 2
SLIP = 97  # one run in so many loses a letter
CELL, TILE, SHARE, LEAF = 4096, 16_384, 65_536, 16
SAMPLE, PER_CELL = 1 << 20, 64  # words that the upper trees are balanced by: at most, and for each cell
HELD = 300_000  # distinct words a task counts before it hands them on
PAIR_BYTES = 1 << 22

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_DIM = np.array([(c - 97) if 97 <= c < 123 else 26 + (c & 7) for c in range(256)], np.int64)  # letters as they are, others folded: folding never adds distance
DIMS = 34


def word_counts(docs: DataFrame, min_letters: int = MIN_LETTERS, slip: int = SLIP) -> DataFrame:
    """(word, n): partial counts of the words of (doc_id, text), several rows a word."""
    letters = re.compile("[a-zÀ-ÿ]{%d,}" % min_letters)

    def run(batches):
        held = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                base = zlib.crc32(b"%s:" % ("" if doc is None else str(doc)).encode())
                for word, n in Counter(letters.findall(text.as_buffer().to_pybytes().translate(_LOWER).decode())).items():
                    h = zlib.crc32(word.encode(), base)
                    if h % slip == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_letters:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held = Counter()
        yield out()

    return docs.mapInArrow(run, "word string, n long")


def words_of(docs: DataFrame, min_count: int = MIN_COUNT, **how) -> DataFrame:
    """(word, n) of the words with at least ``min_count`` occurrences."""
    return word_counts(narrow(docs), **how).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def matrix(words: list[str], length: int) -> np.ndarray:
    """Letters of words of one length, one byte each (Latin-1)."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def vectors(letters: np.ndarray) -> np.ndarray:
    """Letter-count vectors."""
    n = len(letters)
    out = np.zeros((n, DIMS), np.int32)
    step = max(1, PAIR_BYTES // max(1, letters.shape[1]))
    for lo in range(0, n, step):
        part = letters[lo : lo + step]
        out[lo : lo + step] = np.bincount((_DIM[part] + np.arange(len(part))[:, None] * DIMS).ravel(), minlength=len(part) * DIMS).reshape(-1, DIMS)
    return out


class Tree:
    """A k-d tree over count vectors; a leaf holds at most ``limit`` of them unless they are all equal."""

    def __init__(self, x: np.ndarray, limit: float):
        self.dim, self.cut, self.left, self.right, self.leaf = [], [], [], [], []
        self.members, todo = [], [(np.arange(len(x)), -1, False)]
        while todo:
            own, parent, is_right = todo.pop()
            node = len(self.dim)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            dim, cut = self._plane(x[own]) if len(own) > limit else (-1, 0)
            self.dim.append(dim)
            self.cut.append(cut)
            self.left.append(-1)
            self.right.append(-1)
            self.leaf.append(-1 if dim >= 0 else len(self.members))
            if dim < 0:
                self.members.append(own)
            else:
                low = x[own, dim] <= cut
                todo += [(own[~low], node, True), (own[low], node, False)]
        self.dim, self.cut, self.left, self.right, self.leaf = (np.array(v, np.int32) for v in (self.dim, self.cut, self.left, self.right, self.leaf))

    @staticmethod
    def _plane(x: np.ndarray) -> tuple[int, int]:
        """The dimension and count that part the vectors most evenly; -1 where all are equal."""
        best, plane = 0, (-1, 0)
        low, high = x.min(0), x.max(0)
        for cut in range(int(low.min()), int(high.max())):
            below = (x <= cut).sum(0)
            even = np.minimum(below, len(x) - below)
            d = int(even.argmax())
            if even[d] > best:
                best, plane = int(even[d]), (d, cut)
            if best * 5 >= len(x) * 2:
                break
        return plane

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each vector lies in."""
        node = np.zeros(len(x), np.int64)
        while len(open_ := np.flatnonzero(self.dim[node] >= 0)):
            at = node[open_]
            node[open_] = np.where(x[open_, self.dim[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.leaf[node]

    def reach(self, x: np.ndarray, up: bool, down: bool) -> tuple[np.ndarray, np.ndarray]:
        """(vector, leaf) for the leaves whose box holds a vector with at most one count more and one less."""
        q, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        more, less = np.full(len(x), -1 if up else -2, np.int64), np.full(len(x), -1 if down else -2, np.int64)  # the dimension changed; -1: none yet, -2: may not
        found = []
        while len(q):
            dim = self.dim[node]
            end = dim < 0
            if end.any():
                found.append((q[end], self.leaf[node[end]]))
                q, node, more, less, dim = (v[~end] for v in (q, node, more, less, dim))
            now = x[q, dim] + (more == dim) - (less == dim)
            cut = self.cut[node]
            low = now <= cut
            step_down = ~low & (now == cut + 1) & (less == -1) & (more != dim)
            step_up = low & (now == cut) & (more == -1) & (less != dim)
            go_left, go_right = low | step_down, ~low | step_up
            less_left, more_right = np.where(step_down, dim, less), np.where(step_up, dim, more)
            q, node, more, less = (np.concatenate([a[go_left], b[go_right]]) for a, b in ((q, q), (self.left[node], self.right[node]), (more, more_right), (less_left, less)))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(v) for v in zip(*found)) if found else (none, none)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two letter matrices (lengths equal, or one apart) differ by exactly one edit."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    if a.shape[1] > b.shape[1]:
        a, b = b, a
    n = a.shape[1]
    front = np.hstack([a != b[:, :n], np.ones((len(a), 1), bool)]).argmax(1)  # letters equal from the front
    back = np.hstack([(a != b[:, 1:])[:, ::-1], np.ones((len(a), 1), bool)]).argmax(1)
    return front + back >= n


def upper_trees(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> dict[int, Tree]:
    """By word length, the upper tree; lengths with at most ``cell`` words have none (a single cell)."""
    sizes = {r["length"]: r["count"] for r in words.groupBy("length").count().filter(F.col("count") > cell).collect()}  # only lengths that need planes
    total = sum(sizes.values())
    every = max(1, -(-total // min(sample, PER_CELL * max(1, total // cell))))
    some = words.filter(F.col("length").isin(*sizes) & (F.pmod(F.xxhash64("word"), F.lit(every)) == 0)).select("word", "length").collect() if sizes else []
    by_length = {}
    for r in some:
        by_length.setdefault(r["length"], []).append(r["word"])
    return {n: Tree(vectors(matrix(own, n)), max(1, cell * len(own) / sizes[n])) for n, own in by_length.items()}


def visits(words: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """(cell, asks, word, n): every word in its home cell, and in each cell that its search reaches."""
    shared = words.sparkSession.sparkContext.broadcast({n: (t, t.members.clear())[0] for n, t in trees.items()})
    schema = pa.schema([("cell", pa.int64()), ("asks", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            length = np.asarray(batch.column("length"), np.int64)
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                x = vectors(matrix(batch.column("word").take(pa.array(rows)).to_pylist(), n))
                for there, up, down in ((n - 1, False, True), (n, True, True), (n + 1, True, False), (n, None, None)):
                    tree = shared.value.get(there)
                    if tree is None:
                        at, leaf = np.arange(len(rows)), np.zeros(len(rows), np.int64)
                    else:
                        at, leaf = (np.arange(len(rows)), tree.home(x)) if up is None else tree.reach(x, up, down)
                    own = batch.take(pa.array(rows[at]))
                    yield pa.RecordBatch.from_arrays([pa.array((there << 32) + leaf.astype(np.int64)), pa.array(np.full(len(at), up is not None)), own.column("word"), own.column("n")], schema=schema)

    return words.select("word", "n", "length").mapInArrow(run, "cell long, asks boolean, word string, n long")


def _hits(home: list[tuple[str, int]], tree: Tree, x: np.ndarray, length: int, asked: list[str]):
    """(asker, home word) pairs one edit apart, in chunks."""
    letters = matrix([w for w, _ in home], length)
    size = np.array([len(m) for m in tree.members])
    start, order = np.cumsum(size) - size, np.concatenate(tree.members)
    by_length = {}
    for i, w in enumerate(asked):
        by_length.setdefault(len(w), []).append(i)
    for n, at in by_length.items():
        if abs(n - length) > 1:
            continue
        at = np.array(at)
        own = matrix([asked[i] for i in at], n)
        vec = vectors(own)
        for lo in range(0, len(at), 2048):
            q, leaf = tree.reach(vec[lo : lo + 2048], n <= length, n >= length)
            ends = np.cumsum(size[leaf])
            many = max(1, PAIR_BYTES // length)
            cuts = [0, *np.searchsorted(ends, np.arange(many, int(ends[-1]) if len(ends) else 0, many), "right").tolist(), len(q)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                reps = size[leaf[a:b]]
                place = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(start[leaf[a:b]], reps)
                qi, ci = np.repeat(q[a:b], reps) + lo, order[place]
                ok = one_edit(own[qi], letters[ci])
                yield at[qi[ok]], ci[ok]


def near(words: DataFrame, cell: int = CELL, tile: int = TILE, share: int = SHARE) -> DataFrame:
    """(word, n_near, best): for words (word, n, length) with near words, their number and the best as (-n, word)."""
    seen = staged(visits(words, upper_trees(words, cell)), "visits")
    cells = seen.groupBy("cell").agg(F.count_if(~F.col("asks")).alias("own"), F.count_if("asks").alias("askers")).filter("own > 0 and askers > 0")
    cells = staged(cells.select("cell", F.ceil(F.col("own") / tile).cast("int").alias("tiles"), F.ceil(F.col("askers") / share).cast("int").alias("shares")), "cells")
    h = F.xxhash64("word")
    dealt = seen.join(cells, "cell")
    tiles = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(F.pmod(h, F.col("tiles")).cast("int")))
    shares = F.when(F.col("asks"), F.array(F.pmod(h, F.col("shares")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("shares") - 1))
    dealt = dealt.select("cell", "asks", "word", "n", F.explode(tiles).alias("tile"), shares.alias("shares")).select("cell", "asks", "word", "n", "tile", F.explode("shares").alias("share"))
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def run(batches):
        group, home, tree, x, rank = None, [], None, None, None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c), np.int64) for c in ("cell", "tile", "share")])
            asks = np.asarray(batch.column("asks").cast(pa.int8()), np.int64)
            turn = np.flatnonzero((np.diff(keys) != 0).any(0) | (np.diff(asks) != 0)) + 1
            for lo, hi in zip([0, *turn], [*turn, len(asks)]):
                if lo == hi:
                    continue
                if tuple(keys[:, lo]) != group:
                    group, home, tree = tuple(keys[:, lo]), [], None
                part = batch.slice(lo, hi - lo)
                if not asks[lo]:
                    home += zip(part.column("word").to_pylist(), part.column("n").to_pylist())
                    continue
                length = int(group[0] >> 32)
                if not home:
                    continue
                if tree is None:
                    home.sort(key=lambda r: (-r[1], r[0]))  # a word's place is then its rank as a form
                    x = vectors(matrix([w for w, _ in home], length))
                    tree = Tree(x, LEAF)
                asked = part.column("word").to_pylist()
                number, best = np.zeros(len(asked), np.int64), np.full(len(asked), len(home), np.int64)
                for q, c in _hits(home, tree, x, length, asked):
                    number += np.bincount(q, minlength=len(asked))
                    np.minimum.at(best, q, c)
                hit = np.flatnonzero(number)
                yield pa.RecordBatch.from_arrays([part.column("word").take(pa.array(hit)), pa.array(number[hit]), pa.array([home[i][1] for i in best[hit]], pa.int64()), pa.array([home[i][0] for i in best[hit]], pa.string())], schema=schema)

    place = ["cell", "tile", "share"]
    found = dealt.repartition(*place).sortWithinPartitions(*place, "asks").select(*place, "asks", "word", "n").mapInArrow(run, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("neg"), F.col("best").alias("word"))).alias("best"))


def with_roots(forms: DataFrame) -> DataFrame:
    """Add ``root``, the last of the chain word -> form -> ..., by pointer doubling over the words that have a form."""
    chain = staged(forms.filter("form is not null").select("word", F.col("form").alias("root")), "chains")
    while True:
        ahead = chain.select(F.col("word").alias("at"), F.col("root").alias("far"))
        hop = staged(chain.join(ahead, chain["root"] == ahead["at"], "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "chains")
        chain = hop.select("word", "root")
        if hop.filter("moved").isEmpty():
            break
    return forms.join(chain, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, ratio: int = RATIO, cell: int = CELL, tile: int = TILE, share: int = SHARE, min_count: int = MIN_COUNT, **how) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (doc_id, text)."""
    words = staged(words_of(docs, min_count, **how).withColumn("length", F.char_length("word")), "words")
    joined = words.join(near(words, cell, tile, share), "word", "left")
    enough = -F.col("best.neg") >= ratio * F.col("n")
    forms = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.neg")).alias("form_n"))
    return with_roots(staged(forms, "forms")).select("word", "form", "root", "n", "n_near", "form_n")
