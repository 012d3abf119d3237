"""SentencePiece encoding by sampled segmentations without replacement, and decoding.

A text's lattice has a node for each character boundary and an edge for each
piece of the vocabulary; its segmentations are the paths.  A path's weight is the product of
its pieces' probabilities, 1 / (rank + 2) normalised (Zipf's law over the model's merge ranks).

*Gumbel top-k.*  Each segmentation's log probability is perturbed by Gumbel noise;
the k largest are k distinct samples without replacement.  They are found
without listing all paths, by an A* search over the tree of path prefixes.  The backward
sums of the lattice are an exact heuristic: a prefix's whole subtree has a
known log mass phi, and its largest perturbed value is Gumbel(phi) truncated
at its parent's.  The best subtree on the frontier is followed to its end by
conditional sampling; the branches left on the way join the frontier.

*Inclusion.*  With kappa, the (k+1)-th perturbed value, a sample is included with probability
1 - exp(-exp(log_prob - kappa)), so samples can be weighted without bias.

Noise comes from hashes of the row key and the place in the text, so results don't
depend on partitions, and a retried task gives the same rows.  No piece crosses a
blank from the left or holds a newline or digit beside others, so the lattice falls apart into units
there; equal units of a chunk share one lattice, and all numpy work runs over whole chunks.
Characters without a piece are spelled in byte pieces.  Decoding joins the pieces
and is exact: the text comes back byte by byte, blanks, tabs and newlines included.

Edge cases: NULL text is empty; an empty text is the prefix blank alone, as one
segmentation; a text with fewer than k segmentations gives all of them, each
included with probability 1; very long texts are read whole; repeated rows
(equal key and text) give equal samples; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import CHUNK_BYTES, Rolling, byte_values, mix, narrow, text_chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
K = 2
_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class Pieces:
    """The vocabulary as arrays.  Pieces hold a blank where the model has its blank sign."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.byte_id = np.full(256, -1, np.int64)
        raw = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                raw[i] = bytes([int(sp.id_to_piece(i)[3:-1], 16)])
                self.byte_id[raw[i][0]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                raw[i] = sp.id_to_piece(i).replace("▁", " ").encode()
        own = [i for i in range(n) if raw[i] and not sp.is_byte(i) and b" " not in raw[i].lstrip(b" ")]
        rank = {i: r for r, i in enumerate(sorted(own, key=lambda i: (-sp.get_score(i), i)))}
        total = np.log(sum(1 / (r + 2) for r in range(len(own) + 256)))
        self.byte_weight = -np.log(len(own) + 258) - total
        buf = np.frombuffer(b"".join(raw[i] for i in own), np.uint8)
        end = np.cumsum([len(raw[i]) for i in own])
        start = end - [len(raw[i]) for i in own]
        h = Rolling(byte_values(buf)).spans(start, end)
        order = np.argsort(h)
        self.hash, self.id = h[order], np.array(own)[order]
        self.weight = np.array([-np.log(rank[i] + 2) - total for i in own])[order]
        self.lengths = sorted({len(raw[i]) for i in own})
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hash & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        beside = {b for i in own if len(raw[i]) > 1 for b in raw[i]}
        self.alone = np.array([b < 128 and b != 32 and b not in beside for b in range(256)])  # no longer piece holds these
        self.pool = np.frombuffer(b"".join(raw), np.uint8)
        self.pool_end = np.cumsum([len(x) for x in raw])
        self.pool_start = self.pool_end - [len(x) for x in raw]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a run of ids, and how many each id has."""
        size = (self.pool_end - self.pool_start)[ids]
        at = np.repeat(self.pool_start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.pool[at], size


def _uniform(key: np.ndarray) -> np.ndarray:
    return ((mix(key) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _truncated(phi, bound, u):
    """Gumbel noise around phi, given that it is below the bound."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = phi - np.logaddexp(phi - bound, np.log(-np.log(u)))
    return np.where(np.isneginf(phi), -np.inf, out)


class Lattices:
    """Edges of the lattices of distinct units laid end to end, with conditional probabilities."""

    def __init__(self, p: Pieces, buf: np.ndarray, off: np.ndarray):
        n = len(buf)
        unit_end = np.repeat(off[1:], np.diff(off))
        char = (buf & 0xC0) != 0x80  # a character begins here
        stop = np.append(char, True)
        stop[off] = True
        roll = Rolling(byte_values(buf))
        found = []
        starts = live = np.flatnonzero(stop[:-1])
        for size in p.lengths:  # ascending, so places too near their unit's end drop out for good
            live = live[live + size <= unit_end[live]]
            at = live[stop[live + size]]
            h = roll.spans(at, at + size)
            ok = p.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
            at, h = at[ok], h[ok]
            i = np.minimum(np.searchsorted(p.hash, h), len(p.hash) - 1)
            ok = p.hash[i] == h
            found.append((at[ok].astype(np.int32), np.full(ok.sum(), size, np.int32), p.id[i[ok]].astype(np.int32), p.weight[i[ok]]))
        start, size, ident, weight = (np.concatenate(x) for x in zip(*found))
        found.clear()
        ends = np.append(starts[1:], n)  # a character without a piece of its own is spelled in bytes
        have = np.zeros(n + 1, bool)
        whole = np.searchsorted(starts, start)
        have[start[ends[whole] == start + size]] = True
        bare = ~have[starts]
        start, size = np.concatenate([start, starts[bare].astype(np.int32)]), np.concatenate([size, (ends - starts)[bare].astype(np.int32)])
        ident, weight = np.concatenate([ident, np.full(bare.sum(), -1, np.int32)]), np.concatenate([weight, (ends - starts)[bare] * p.byte_weight])
        order = np.argsort(start, kind="stable")  # by place, then length
        start, to, ident, weight = start[order], (start + size)[order], ident[order], weight[order]
        final = to == unit_end[start]
        self.first = np.searchsorted(start, np.arange(n + 1))
        beta = np.zeros(n + 1)
        left = (unit_end[start] - start).astype(np.int32)
        left = left.astype(np.int16) if len(left) and left.max() < 1 << 15 else left
        nearest = np.argsort(left, kind="stable")  # nearest to its unit's end first
        place, onward, own = start[nearest], np.where(final, n, to)[nearest], weight[nearest]
        node = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
        cut, far = np.append(node, len(place)), left[nearest][node]
        turns = np.flatnonzero(np.concatenate([[True], far[1:] != far[:-1], [True]])) if len(far) else [0]
        for lo, hi in zip(turns[:-1], turns[1:]):
            a, b = cut[lo], cut[hi]
            beta[place[node[lo:hi]]] = np.logaddexp.reduceat(own[a:b] + beta[onward[a:b]], node[lo:hi] - a)
        self.start, self.to, self.ident, self.final = start, to, ident, final
        self.log_q = np.minimum(weight + beta[np.where(final, n, to)] - beta[start], 0)
        self.q = np.exp(self.log_q)
        total = np.concatenate([[0], np.cumsum(self.q)])
        self.chance = total[1:] - total[self.first[self.start]]
        self.chance[self.first[self.start + 1] - 1] = 1.0
        self.rounds = int(np.diff(self.first).max(initial=1)).bit_length()
        self.buf = buf

    def choose(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node, by its conditional probability."""
        lo, hi, want = self.first[node], self.first[node + 1] - 1, u
        for _ in range(self.rounds):  # halve each node's few edges
            mid = (lo + hi) >> 1
            beyond = self.chance[mid] < want
            lo, hi = np.where(beyond, mid + 1, lo), np.where(beyond, hi, mid)
        return lo


class Paths:
    """Paths of several texts as runs of steps, ordered by unit and step."""

    def __init__(self, unit, step, edge, doc_of_unit, lat: Lattices, n_docs: int):
        count = np.bincount(unit, minlength=len(doc_of_unit))
        at = (np.cumsum(count) - count)[unit] + step
        self.unit, self.step, self.edge = (np.empty(len(at), np.int32) for _ in range(3))
        self.unit[at], self.step[at], self.edge[at] = unit, step, edge
        doc = doc_of_unit[self.unit].astype(np.int32)
        self.off = np.searchsorted(doc, np.arange(n_docs + 1))
        self.doc = doc
        log = lat.log_q[self.edge]
        total = np.concatenate([[0], np.cumsum(log)])
        self.before = total[:-1] - total[self.off[doc]]
        self.log_prob = total[self.off[1:]] - total[self.off[:-1]]
        self.front = np.full(len(at), -np.inf)


def _walk(lat: Lattices, unit, node, step, noise):
    """Follow the units from their nodes to the end; ``noise(unit, step)`` gives the uniform numbers."""
    units, steps, edges = [], [], []
    while len(unit):
        e = lat.choose(node, noise(unit, step))
        units.append(unit)
        steps.append(step)
        edges.append(e)
        go = ~lat.final[e]
        unit, node, step = unit[go], lat.to[e[go]], step[go] + 1
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (units, steps, edges))


def sample(p: Pieces, keys: np.ndarray, buf: np.ndarray, off: np.ndarray, k: int):
    """For each rank: (texts with a sample, ids, offsets, log probability, perturbed value, inclusion, decoded back)."""
    n_docs = len(off) - 1
    size = np.diff(off) + 1
    noff = np.concatenate([[0], np.cumsum(size)])
    text = np.full(noff[-1], 32, np.uint8)  # a blank before each text
    text[np.arange(len(buf)) + np.repeat(np.arange(1, n_docs + 1), np.diff(off))] = buf
    begin = np.zeros(len(text), bool)
    begin[noff[:-1]] = True
    begin[1:] |= (text[1:] == 32) & (text[:-1] != 32) | p.alone[text[1:]] | p.alone[text[:-1]]
    ustart = np.flatnonzero(begin)
    uend = np.append(ustart[1:], len(text))
    doc_of_unit = np.searchsorted(noff, ustart, "right") - 1
    uoff = np.searchsorted(doc_of_unit, np.arange(n_docs + 1))
    place = np.arange(len(ustart)) - uoff[doc_of_unit]
    _, rep, kind = np.unique(Rolling(byte_values(text)).spans(ustart, uend), return_index=True, return_inverse=True)
    length = (uend - ustart)[rep]
    doff = np.concatenate([[0], np.cumsum(length)])
    lat = Lattices(p, text[np.repeat(ustart[rep] - doff[:-1], length) + np.arange(doff[-1])], doff)
    origin = doff[kind]
    seed = mix(keys.astype(np.int64).view(np.uint64) * _SALT[0] + _SALT[1])

    def noise(number, salt):
        own = (mix(seed + np.array([number], np.uint64) * _SALT[2] + salt)[doc_of_unit] + place.astype(np.uint64) * _SALT[3])
        return lambda unit, step: _uniform(own[unit] + step.astype(np.uint64))

    docs = np.arange(n_docs)
    by_kind = np.argsort(kind, kind="stable")  # neighbours then look up neighbouring places
    path = Paths(*_walk(lat, by_kind, origin[by_kind], np.zeros(len(ustart), np.int64), noise(0, _SALT[4])), doc_of_unit, lat, n_docs)
    value = -np.log(-np.log(_uniform(seed + _SALT[2])))
    paths, taken = [], {}
    for number in range(k):
        with np.errstate(divide="ignore"):
            left = np.log1p(-np.minimum(lat.q[path.edge], 1))
        many = (lat.first[lat.start[path.edge] + 1] - lat.first[lat.start[path.edge]]) > 1
        phi = np.where(many & (left > -30), path.before + left, -np.inf)
        if number:
            for d in docs:  # the branch point keeps what isn't taken yet; what lies before it stays with the older path
                t = branch[d]
                phi[path.off[d] : t] = -np.inf
                node = lat.start[path.edge[t]]
                lo, hi = lat.first[node], lat.first[node + 1]
                rest = sum(x for e, x in enumerate(lat.q[lo:hi].tolist(), lo) if e not in taken[number, t])
                phi[t] = path.before[t] + np.log(rest) if rest > 1e-13 else -np.inf
        path.front = _truncated(phi, value[path.doc], noise(number, _SALT[0])(path.unit, path.step))
        paths.append((docs, path, value.copy()))

        best, who, where = np.full(n_docs, -np.inf), np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
        for i, (_, old, _) in enumerate(paths):
            have = np.flatnonzero(np.diff(old.off))
            if not len(have):
                continue
            top = np.full(n_docs, -np.inf)
            top[have] = np.maximum.reduceat(old.front, old.off[have])
            hit = np.flatnonzero((old.front == top[old.doc]) & ~np.isneginf(old.front))[::-1]
            first = np.zeros(n_docs, np.int64)
            first[old.doc[hit]] = hit
            better = top > best
            best[better], who[better], where[better] = top[better], i, first[better]
        value = best
        if number == k - 1:
            break
        docs = np.flatnonzero(~np.isneginf(best))
        parts, again, branch = [], [], {}
        pick = _uniform(seed + np.array([number + 1], np.uint64) * _SALT[1])
        for d in docs:
            old, t = paths[who[d]][1], where[d]
            old.front[t] = -np.inf
            node = lat.start[old.edge[t]]
            gone = taken.get((who[d], t), [old.edge[t]])
            q = [(x, e) for e, x in enumerate(lat.q[lat.first[node] : lat.first[node + 1]].tolist(), int(lat.first[node])) if e not in gone and x > 0]
            u = pick[d] * sum(x for x, _ in q)
            for x, e in q:
                u -= x
                if u <= 0:
                    break
            lo = old.off[d]
            parts.append((np.append(old.unit[lo:t], old.unit[t]), np.append(old.step[lo:t], old.step[t]), np.append(old.edge[lo:t], e)))
            branch[d] = t - lo
            taken[who[d], t] = [*gone, e]
            rest = np.arange(old.unit[t] + 1, uoff[d + 1])
            more = [] if lat.final[e] else [old.unit[t]]
            again.append((np.concatenate([more, rest]).astype(np.int64), np.concatenate([[lat.to[e]] * len(more), origin[rest]]).astype(np.int64), np.concatenate([[old.step[t] + 1] * len(more), np.zeros(len(rest))]).astype(np.int64), [*gone, e]))
        none = (np.zeros(0, np.int64),) * 3
        head = tuple(np.concatenate(x) for x in zip(*parts)) if parts else none
        tail = none
        if again:
            units, nodes, steps = (np.concatenate(x) for x in list(zip(*again))[:3])
            order = np.argsort(nodes, kind="stable")
            tail = _walk(lat, units[order], nodes[order], steps[order], noise(number + 1, _SALT[4]))
        path = Paths(*(np.concatenate([a, b]) for a, b in zip(head, tail)), doc_of_unit, lat, n_docs)
        for d, (*_, gone) in zip(docs, again):
            branch[d] += path.off[d]
            taken[number + 1, branch[d]] = gone

    kappa = value
    for docs, path, perturbed in paths:
        edge = path.edge
        spelled = np.where(lat.ident[edge] < 0, lat.to[edge] - lat.start[edge], 1)
        ids = np.repeat(lat.ident[edge], spelled)
        inner = np.arange(len(ids)) - np.repeat(np.cumsum(spelled) - spelled, spelled)
        low = ids < 0
        ids[low] = p.byte_id[lat.buf[(np.repeat(lat.start[edge], spelled) + inner)[low]]]
        count = np.concatenate([[0], np.cumsum(spelled)])
        ioff = np.concatenate([[0], np.cumsum((count[path.off[1:]] - count[path.off[:-1]])[docs])])
        raw, bytes_of = p.decode(ids)
        done = np.concatenate([[0], np.cumsum(bytes_of)])[ioff]
        same = np.array([np.array_equal(raw[a:b], text[c:d]) for a, b, c, d in zip(done[:-1], done[1:], noff[docs], noff[docs + 1])], bool)
        yield docs, ids, ioff, path.log_prob[docs], perturbed[docs], -np.expm1(-np.exp(np.minimum(path.log_prob[docs] - kappa[docs], 700))), same


def encode(docs: DataFrame, k: int = K, model: str = MODEL, chunk_bytes: int = 6 * CHUNK_BYTES) -> DataFrame:
    """(doc_id, rank, ids, log_prob, perturbed, inclusion, round_trip): up to k distinct segmentations of every text.

    Lattices are built for about ``chunk_bytes`` of text at a time: more is faster, less takes less memory.
    """
    pieces = Pieces(model)

    def run(batches):
        for batch in batches:
            keys = np.asarray(batch.column("doc_id").fill_null(0), np.int64)
            for lo, hi, buf, off in text_chunks(batch, limit=chunk_bytes):
                for rank, (at, ids, ioff, log_prob, perturbed, inclusion, same) in enumerate(sample(pieces, keys[lo:hi], buf, off, k), 1):
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at + lo)), pa.array(np.full(len(at), rank, np.int32)), pa.ListArray.from_arrays(pa.array(ioff, pa.int32()), pa.array(ids, pa.int32())), pa.array(log_prob), pa.array(perturbed), pa.array(inclusion), pa.array(same)],
                                                     names=["doc_id", "rank", "ids", "log_prob", "perturbed", "inclusion", "round_trip"])

    return narrow(docs).mapInArrow(run, "doc_id long, rank int, ids array<int>, log_prob double, perturbed double, inclusion double, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, rank, text): the texts of (doc_id, rank, ids); NULL ids give NULL."""
    pieces = Pieces(model)

    def run(batches):
        for batch in batches:
            texts = [None if x is None else pieces.decode(np.array(x, np.int64))[0].tobytes()[1:].decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rank"), pa.array(texts, pa.string())], names=["doc_id", "rank", "text"])

    return encoded.select("doc_id", "rank", "ids").mapInArrow(run, "doc_id long, rank int, text string")


def digest(encoded: DataFrame) -> DataFrame:
    """The encoded rows with a hash of their ids instead of the ids."""
    return encoded.select("doc_id", "rank", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "perturbed", "inclusion", "round_trip")
