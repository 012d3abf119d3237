"""Cross-tokenizer alignment with an inverted index of pair bitmaps.

Every text is encoded by two vocabularies: A, a byte-level BPE, and B, a piece model.  Byte offsets
where tokens of both end cut the text into groups; an A and a B token of one group are linked.

*Index.*  Documents are numbered in the pass that encodes them.  For each id pair the documents that
hold it linked form a bitmap, cut into containers of ``CONTAINER`` documents; a container
is a list of 16-bit places while it is sparse and a bitmap of fixed size beyond.  How often a document holds a pair
beyond once is kept in multiplicity planes: plane j holds the documents whose surplus has bit j set.
A task builds the containers of some documents at a time and hands them on; pieces of one container are
OR-merged per (pair, container, plane), so a pair that every document holds is spread over containers and never gathered.

*Scores.*  Popcounts summed over containers give a pair's document count, the planes (weighted by
2^j) its links.  The highest count of each A id marks the best pairs.  Each posting then returns its pair's count and
mark to its documents: postings are dealt by container, and a container's sums are two small arrays.

A text without tokens (NULL, empty, or not spelled exactly by A's or B's tokens) has zeros and an empty digest.

Encoding by A uses a fast library built from the vocabulary's own merges; texts with characters beyond
U+024F or with very long words or blanks go through the vocabulary's reference library, since Unicode
tables and worst cases differ there.  Vocabularies are read on the driver and broadcast (a few MB, whatever the corpus).

Edge cases: rows with NULL or repeated doc_id are documents of their own; repeated rows count each;
texts of any length are encoded whole; a group of very many tokens is linked by its distinct ids and their counts, in slices; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import narrow, staged, text_chunks

BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# fixed value: the word pattern that belongs to byte-level vocabularies
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTAINER = 4096  # documents
BITMAP = CONTAINER // 8  # bytes of a dense container; a sparse one is shorter
HELD = 2_000_000  # postings a task holds before it hands them on
LINKS = 1 << 22  # links listed at a time
BIG = 1 << 16  # a group with more links is linked by distinct ids
_ODD = re.compile(r"[^\x00-ɏ]|\S{300}|\s{300}")


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Spelling:
    """The bytes of a vocabulary's ids as one pool."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.pool[np.repeat(self.start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class ByteVocabulary:
    """Vocabulary A: ids of blank + text."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_str(source)
        self.exact.encode_special_tokens = True
        model, letters = json.loads(source)["model"], _byte_letters()
        names = {i: t for t, i in model["vocab"].items()}
        spelled = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else b"" for i, t in names.items()}
        self.spelling = Spelling([spelled.get(i, b"") for i in range(self.exact.get_vocab_size())])
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        first = len(names) - len(merged) - sum(t["content"] in model["vocab"] for t in json.loads(source)["added_tokens"])
        self.fast = None
        if all(model["vocab"][t] == first + i for i, t in enumerate(merged)) and not model.get("ignore_merges"):  # ids in the order of merges: ids are ranks
            import tiktoken

            ranks = {spelled[i]: i for i in range(first + len(merged))}
            self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str):
        text = " " + text
        if self.fast is None or _ODD.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class PieceVocabulary:
    """Vocabulary B: ids of the text, to which the model puts a blank."""

    def __init__(self, source: bytes):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_proto=source)
        self.spelling = Spelling([bytes([int(m.id_to_piece(i)[3:-1], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size())])

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in lists], np.int64)
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(size.sum())), size


class Chunk:
    """Groups and links of some texts: ``buf`` holds their bytes, ``off`` where each begins."""

    def __init__(self, a_vocabulary: ByteVocabulary, b_vocabulary: PieceVocabulary, buf: np.ndarray, off: np.ndarray):
        n = len(off) - 1
        texts = [buf[x:y].tobytes().decode() for x, y in zip(off[:-1], off[1:])]
        (a, a_size), (b, b_size) = _flat([a_vocabulary.ids(t) if t else [] for t in texts]), _flat(b_vocabulary.ids(texts))
        long = np.diff(off) + 1
        begin = np.cumsum(long) - long
        want = np.full(long.sum(), 32, np.uint8)  # a blank before each text
        want[np.arange(len(buf)) + np.repeat(np.arange(1, n + 1), np.diff(off))] = buf
        ok = np.diff(off) > 0
        for ids, size, spelling in ((a, a_size, a_vocabulary.spelling), (b, b_size, b_vocabulary.spelling)):
            raw = spelling.spell(ids)
            ends = np.concatenate([[0], np.cumsum(spelling.size[ids])])[np.concatenate([[0], np.cumsum(size)])]
            ok &= np.diff(ends) == long
            for i in np.flatnonzero(ok):
                ok[i] = np.array_equal(raw[ends[i] : ends[i + 1]], want[begin[i] : begin[i] + long[i]])
        a, b = a[np.repeat(ok, a_size)], b[np.repeat(ok, b_size)]
        self.n_a, self.n_b = np.where(ok, a_size, 0), np.where(ok, b_size, 0)
        a_end, b_end = np.cumsum(a_vocabulary.spelling.size[a]), np.cumsum(b_vocabulary.spelling.size[b])
        mark = np.zeros(long[ok].sum() + 1, np.int8)
        mark[a_end] = 1
        mark[b_end] += 2
        a_last, b_last = mark[a_end] == 3, mark[b_end] == 3  # tokens that close a group
        self.a, self.b, self.a_last, self.b_last = a, b, a_last, b_last
        self.a_group, self.b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        groups = int(a_last.sum())
        self.a_many, self.b_many = np.bincount(self.a_group, minlength=groups), np.bincount(self.b_group, minlength=groups)
        self.a_from, self.b_from = np.cumsum(self.a_many) - self.a_many, np.cumsum(self.b_many) - self.b_many
        doc_of_a = np.repeat(np.arange(n), self.n_a)
        self.group_doc = doc_of_a[a_last]
        self.n_groups = np.bincount(self.group_doc, minlength=n)
        self.n_links = np.zeros(n, np.int64)
        np.add.at(self.n_links, self.group_doc, self.a_many * self.b_many)

    def texts(self, digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all documents' groups as ``a1,a2|b1;...`` and where each document's begin; ``digits`` holds the ids' decimals."""
        cell = np.zeros((len(self.a) + len(self.b), digits.shape[1] + 1), np.uint8)
        at_a, at_b = np.arange(len(self.a)) + self.b_from[self.a_group], np.arange(len(self.b)) + (self.a_from + self.a_many)[self.b_group]
        cell[at_a, :-1], cell[at_b, :-1] = digits[self.a], digits[self.b]
        cell[at_a, -1], cell[at_b, -1] = np.where(self.a_last, 124, 44), np.where(self.b_last, 59, 44)
        ends = np.cumsum(self.n_a + self.n_b)
        cell[ends[self.n_a > 0] - 1, -1] = 0
        size = np.concatenate([[0], np.cumsum((cell != 0).sum(1))])
        flat = cell.ravel()
        return flat[flat != 0], size[np.concatenate([[0], ends])]

    def pairs(self, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, a * n_b + b, how often) of the linked id pairs, distinct."""
        per_token = self.b_many[self.a_group]
        big = self.a_many * self.b_many > BIG
        usual = ~big[self.a_group]
        keys, times = [], []

        def close(doc, pair, weight):
            order = np.lexsort((pair, doc))
            doc, pair, weight = doc[order], pair[order], weight[order]
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])])) if len(doc) else np.zeros(0, np.int64)
            return doc[new], pair[new], np.add.reduceat(weight, new) if len(new) else weight

        own = np.flatnonzero(usual)
        ends = np.cumsum(per_token[own])
        cuts = [0, *np.searchsorted(ends, np.arange(LINKS, int(ends[-1]) if len(ends) else 0, LINKS), "right").tolist(), len(own)]
        for lo, hi in zip(cuts, cuts[1:]):
            tok = own[lo:hi]
            if len(tok):
                many, group = per_token[tok], self.a_group[tok]
                other = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.b_from[group], many)
                key = (np.repeat(self.group_doc[group], many) << 47) | (np.repeat(self.a[tok], many) * n_b + self.b[other])
                key, count = np.unique(key, return_counts=True)
                keys.append(key)
                times.append(count)
        for g in np.flatnonzero(big):
            ua, ca = np.unique(self.a[self.a_from[g] : self.a_from[g] + self.a_many[g]], return_counts=True)
            ub, cb = np.unique(self.b[self.b_from[g] : self.b_from[g] + self.b_many[g]], return_counts=True)
            step = max(1, LINKS // len(ub))
            for lo in range(0, len(ua), step):
                keys.append((self.group_doc[g] << 47) | (ua[lo : lo + step, None] * n_b + ub).ravel())
                times.append((ca[lo : lo + step, None] * cb).ravel())
        if not keys:
            return (np.zeros(0, np.int64),) * 3
        key, weight = (keys[0], times[0]) if len(keys) == 1 else (np.concatenate(keys), np.concatenate(times))
        doc, pair = key >> 47, key & ((1 << 47) - 1)
        return (doc, pair, weight) if len(keys) == 1 else close(doc, pair, weight)


def pack(places: np.ndarray, size: np.ndarray) -> pa.Array:
    """Containers as binaries: ``places`` (ascending in each) run by ``size``."""
    dense = size * 2 >= BITMAP
    end = np.cumsum(np.where(dense, BITMAP, size * 2))
    data = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    sparse = np.repeat(~dense, size)
    data[np.repeat(~dense, np.where(dense, BITMAP, size * 2))] = places[sparse].astype("<u2").view(np.uint8)
    start = np.cumsum(size) - size
    for i in np.flatnonzero(dense):
        bits = np.zeros(CONTAINER, bool)
        bits[places[start[i] : start[i] + size[i]]] = True
        data[end[i] - BITMAP : end[i]] = np.packbits(bits)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], end]).astype(np.int32)), pa.py_buffer(data)])


def unpack(raw: bytes) -> np.ndarray:
    """The places of one container."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8))) if len(raw) == BITMAP else np.frombuffer(raw, "<u2").astype(np.int64)


def sizes(column: pa.Array) -> np.ndarray:
    """Popcounts of containers."""
    long = np.asarray(pa.compute.binary_length(column), np.int64)
    out = long // 2
    for i in np.flatnonzero(long == BITMAP):
        out[i] = len(unpack(column[int(i)].as_py()))
    return out


def _containers(number: int, pair: np.ndarray, place: np.ndarray, times: np.ndarray):
    """Index rows of one container from its postings: presence as plane -1, then the bits of times - 1."""
    order = np.lexsort((place, pair))
    pair, place, surplus = pair[order], place[order], times[order] - 1
    for plane in range(-1, int(surplus.max(initial=0)).bit_length()):
        has = slice(None) if plane < 0 else np.flatnonzero(surplus >> plane & 1)
        p, d = pair[has], place[has]
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(p)))
        yield pa.array(p[first]), pa.array(np.full(len(first), number)), pa.array(np.full(len(first), plane, np.int32)), pack(d, size)


_DOC = [("number", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string())]
_POST = [("pair", pa.int64()), ("container", pa.int64()), ("plane", pa.int32()), ("docs", pa.binary())]
_SCHEMA = pa.schema(_DOC + _POST)
_DDL = "number long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pair long, container long, plane int, docs binary"


def encoded(docs: DataFrame, a_path: str = BYTE_VOCABULARY, b_path: str = PIECE_MODEL, keep_groups: bool = False) -> tuple[DataFrame, int]:
    """One pass over the texts, written: rows of documents (``pair`` NULL) and rows of the index; and B's size."""
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        sources = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    n_b = len(PieceVocabulary(sources.value[1]).spelling.size)
    rows = narrow(docs).withColumn("number", F.monotonically_increasing_id())

    def run(batches):
        a_vocabulary, b_vocabulary = ByteVocabulary(sources.value[0]), PieceVocabulary(sources.value[1])
        most = max(len(a_vocabulary.spelling.size), n_b)
        digits = np.zeros((most, len(str(most - 1))), np.uint8)
        for i in range(most):
            digits[i, : len(s)] = np.frombuffer(s := str(i).encode(), np.uint8)
        held, many, open_ = [], 0, None

        def index():
            if held:
                for columns in _containers(open_, *(np.concatenate(v) for v in zip(*held))):
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(columns[0]), t) for _, t in _DOC] + list(columns), schema=_SCHEMA)
                held.clear()

        for batch in batches:
            numbers = np.asarray(batch.column("number"), np.int64)
            for lo, hi, buf, off in text_chunks(batch):
                c = Chunk(a_vocabulary, b_vocabulary, buf, off)
                text, at = c.texts(digits)
                text = text.tobytes()
                some = c.n_a > 0
                digest = [hashlib.sha256(text[x:y]).hexdigest() if z else "" for x, y, z in zip(at[:-1].tolist(), at[1:].tolist(), some.tolist())]
                groups = [text[x:y].decode() for x, y in zip(at[:-1].tolist(), at[1:].tolist())] if keep_groups else pa.nulls(hi - lo, pa.string())
                own = [batch.column("number").slice(lo, hi - lo), batch.column("doc_id").slice(lo, hi - lo), *(pa.array(x, pa.int64()) for x in (c.n_a, c.n_b, c.n_groups, c.n_links)), pa.array(digest, pa.string()), pa.array(groups, pa.string())]
                yield pa.RecordBatch.from_arrays(own + [pa.nulls(hi - lo, t) for _, t in _POST], schema=_SCHEMA)
                doc, pair, times = c.pairs(n_b)
                home = numbers[lo:hi][doc]
                for container in np.unique(home // CONTAINER).tolist():
                    if container != open_ or many >= HELD:
                        yield from index()
                        open_, many = container, 0
                    here = home // CONTAINER == container
                    held.append((pair[here], home[here] % CONTAINER, times[here]))
                    many += int(here.sum())
        yield from index()

    return staged(rows.mapInArrow(run, _DDL), "alignment"), n_b


def merged(posts: DataFrame) -> DataFrame:
    """(pair, container, plane, docs, size): pieces of one container OR-merged, with its popcount."""
    key = ["pair", "container", "plane"]
    schema = pa.schema(_POST + [("size", pa.int64())])

    def run(batches):
        last = None  # the last row waits for further pieces

        def row(r):
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(r, _POST)] + [pa.array([len(unpack(r[3]))], pa.int64())], schema=schema)

        for batch in batches:
            if not len(batch):
                continue
            k = np.stack([np.asarray(batch.column(c), np.int64) for c in key])
            first = np.flatnonzero(np.concatenate([[True], (k[:, 1:] != k[:, :-1]).any(0)]))
            size = np.diff(np.append(first, len(batch)))
            for i, n in zip(first[(size > 1) | (first == 0) | (first + size == len(batch))].tolist(), size[(size > 1) | (first == 0) | (first + size == len(batch))].tolist()):
                places = np.concatenate([unpack(x) for x in batch.column("docs").slice(i, n).to_pylist()])
                if last is not None and last[:3] == tuple(k[:, i]):
                    places = np.concatenate([places, unpack(last[3])])
                elif last is not None:
                    yield row(last)
                places = np.unique(places)
                last = (*k[:, i].tolist(), pack(places, np.array([len(places)]))[0].as_py())
            plain = first[(size == 1) & (first != 0) & (first + 1 != len(batch))]
            if len(plain):
                own = batch.select(key + ["docs"]).take(pa.array(plain))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(sizes(own.column("docs")))], schema=schema)
        if last is not None:
            yield row(last)

    return staged(posts.select(*key, "docs").repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "pair long, container long, plane int, docs binary, size long"), "pair-index")


def pair_counts(index: DataFrame, n_b: int) -> DataFrame:
    """(pair, a, b, n_docs, n_links, best): ``best`` is true where no other pair of the A id has more documents."""
    size = F.col("size")
    counts = index.groupBy("pair").agg(F.sum(F.when(F.col("plane") < 0, size).otherwise(0)).alias("n_docs"), F.sum(F.when(F.col("plane") < 0, size).otherwise(size * F.pow(F.lit(2), F.col("plane")).cast("long"))).alias("n_links"))
    counts = staged(counts.select("pair", F.expr(f"pair div {n_b}").alias("a"), (F.col("pair") % n_b).alias("b"), "n_docs", "n_links"), "pair-counts")
    most = counts.groupBy(F.col("a").alias("of")).agg(F.max("n_docs").alias("most"))
    return counts.join(most, counts["a"] == most["of"]).select(*counts.columns, (F.col("n_docs") == F.col("most")).alias("best"))


def scores(index: DataFrame, counts: DataFrame) -> DataFrame:
    """(number, count_sum, n_best): what its postings return to each document."""
    posts = index.join(counts.select("pair", "n_docs", "best"), "pair").select("container", "plane", "docs", "n_docs", "best")
    schema = pa.schema([("number", pa.int64()), ("count_sum", pa.int64()), ("n_best", pa.int64())])

    def run(batches):
        open_, total = None, np.zeros((2, CONTAINER), np.int64)

        def out():
            hit = np.flatnonzero(total[0])
            return pa.RecordBatch.from_arrays([pa.array(open_ * CONTAINER + hit), pa.array(total[0, hit]), pa.array(total[1, hit])], schema=schema)

        for batch in batches:
            container = np.asarray(batch.column("container"), np.int64)
            turn = np.flatnonzero(np.diff(container)) + 1
            for lo, hi in zip([0, *turn], [*turn, len(container)]):
                if lo == hi:
                    continue
                if container[lo] != open_:
                    if open_ is not None:
                        yield out()
                    open_, total = int(container[lo]), np.zeros((2, CONTAINER), np.int64)
                part = batch.slice(lo, hi - lo)
                weight = np.left_shift(1, np.maximum(np.asarray(part.column("plane"), np.int64), 0))
                gain = np.stack([weight * np.asarray(part.column("n_docs"), np.int64), weight * np.asarray(part.column("best").cast(pa.int8()), np.int64)])
                long = np.asarray(pa.compute.binary_length(part.column("docs")), np.int64)
                for i in np.flatnonzero(long == BITMAP).tolist():
                    total[:, unpack(part.column("docs")[i].as_py())] += gain[:, i : i + 1]
                few = np.flatnonzero(long != BITMAP)
                if len(few):
                    raw = b"".join(part.column("docs").take(pa.array(few)).to_pylist())
                    places, owner = np.frombuffer(raw, "<u2").astype(np.int64), np.repeat(few, long[few] // 2)
                    for t, g in zip(total, gain):
                        np.add.at(t, places, g[owner])
        if open_ is not None:
            yield out()

    return posts.repartition("container").sortWithinPartitions("container").mapInArrow(run, "number long, count_sum long, n_best long")


def align(docs: DataFrame, a_path: str = BYTE_VOCABULARY, b_path: str = PIECE_MODEL, keep_groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]) and pairs (see ``pair_counts``)."""
    both, n_b = encoded(docs, a_path, b_path, keep_groups)
    index = merged(both.filter("pair is not null"))
    counts = staged(pair_counts(index, n_b), "pairs")
    rows = both.filter("pair is null").join(scores(index, counts), "number", "left")
    gained = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *gained, "groups_sha256", *["groups"] * keep_groups), counts.drop("pair")
