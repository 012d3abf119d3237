"""Deduplication operators against brute force, with nulls, ties, copies, long texts, empty tables and clashing columns."""

import collections
import hashlib
import random
import re

import pytest

from sitelens.llm import block_dedup, jaccard_join, suffix_dedup
from sitelens.llm.components import connected

CLASH = "gram long, start long, h long, p long, n long, path long, row long, at string"


def corpus(seed=1, n=60):
    """(doc_id, text): prose with copies, near copies, shared passages, a hot passage, short and empty texts, one long text."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(400)]
    prose = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage, texts = prose(90), []
    for i in range(n):
        w = prose(r.randint(1, 220))
        if i % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = passage[r.randint(0, 20) :]
        if i % 5 == 0 and texts:
            w = list(r.choice(texts))
        if i % 7 == 0 and texts:
            w = list(r.choice(texts))
            w[r.randrange(len(w))] = "edit"
        texts.append(w)
    base = prose(150)
    for i in range(25):  # a clump of near copies
        w = list(base)
        w[r.randrange(150)] = f"x{i}"
        texts.append(w)
    rows = [(i, r.choice([" ", "\n", "\t "]).join(w) if i % 11 == 0 else " ".join(w)) for i, w in enumerate(texts)]
    rows += [(1000, None), (1001, ""), (1002, "   \n"), (1003, "one two"), (1004, "one two"), (1005, " ".join(prose(20_000))), (1006, "ab" * 700), (1007, None)]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    extra = (None,) * 8
    return spark.createDataFrame([(*x, *extra) for x in rows], f"doc_id long, text string, {CLASH}")


@pytest.mark.parametrize("max_bucket", [5000, 2])
def test_suffix_dedup(spark, max_bucket):
    rows, length = corpus(), 100
    seen = collections.Counter()
    raw = {i: (t or "").encode() for i, t in rows}
    for b in raw.values():
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    got = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(frame(spark, rows), length, 40, max_bucket).collect()}
    assert set(got) == set(raw)
    for i, b in raw.items():
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (len(b), sum(gone), spans, kept)


def test_suffix_dedup_whole_characters(spark):
    r = random.Random(0)
    shared = "".join(r.choice("abcdefgh") for _ in range(120))
    rows = [(1, "é" + shared + "à"), (2, "©" + shared + "é")]  # é and © end alike, à and é begin alike
    kept = [bytes(x["kept"]).decode() for x in suffix_dedup.suffix_dedup(frame(spark, rows), 100, 40, whole_characters=True).collect()]
    assert sorted(kept) == ["©é", "éà"]


def test_interval_tree_scan():
    """Intervals of a suffix array's common prefixes: children before parents, every maximal interval once."""
    s = "banana$anan"
    suffixes = sorted(range(len(s)), key=lambda i: s[i:])
    common = lambda x, y: next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
    lcp = [0] + [common(s[a:], s[b:]) for a, b in zip(suffixes, suffixes[1:])]
    found = [x for x in suffix_dedup.intervals(lcp, len(s)) if x[0] > 0]
    exact = {(d, i, j) for i in range(len(s)) for j in range(i + 1, len(s)) for d in [min(lcp[i + 1 : j + 1])]
             if d > 0 and (i == 0 or lcp[i] < d) and (j + 1 == len(s) or lcp[j + 1] < d)}
    assert sorted(found) == sorted(exact) and len(found) == len(exact)


def test_maximal_repeats_lists_all_occurrences(spark):
    r = random.Random(5)
    part = "".join(r.choice("abcdefgh") for _ in range(160))
    rows = [(i, f"<{i}>" + part + f"[{i}]") for i in range(4)] + [(9, "nothing here")]
    got = suffix_dedup.maximal_repeats(frame(spark, rows), 100, 40).collect()
    by = collections.defaultdict(set)
    for x in got:
        by[x["repeat"]].add((x["doc_id"], x["start"], x["end"]))
    texts = dict(rows)
    assert any({d for d, _, _ in g} == {0, 1, 2, 3} for g in by.values())
    for g in by.values():
        assert len({texts[d][s:e] for d, s, e in g}) == 1 and all(e - s >= 100 for _, s, e in g)


def test_block_dedup(spark):
    rows, window = corpus(2), 50
    words = {i: (t or "").encode().split() for i, t in rows}
    first, expected = {}, {}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p : p + window]), i)
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        expected[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in block_dedup.block_dedup(frame(spark, rows)).collect()}
    assert got == expected and sum(e[1] for e in expected.values()) > 500


def jaccard_brute(rows):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    sets = {i: ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}) for i, w in words.items()}
    ids, root, links = sorted(sets), {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                    links[a], links[b] = links[a] + 1, links[b] + 1
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (find(i), links[i]) for i in ids}


@pytest.mark.parametrize("bucket,tile", [(4000, 1000), (4, 5)])
def test_jaccard_join(spark, bucket, tile):
    rows = corpus(3)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.similar_documents(frame(spark, rows), bucket=bucket, tile=tile).collect()}
    expected = jaccard_brute(rows)
    assert got == expected and max(n for _, n in expected.values()) >= 20


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 120), r.randint(0, 120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(500, 500)]
    root = {x: x for e in edges for x in e}
    for _ in range(80):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["doc_id"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in root.items() if x != 500}


def test_empty_tables(spark):
    none = spark.createDataFrame([], f"doc_id long, text string, {CLASH}")
    assert suffix_dedup.suffix_dedup(none).count() == 0
    assert block_dedup.block_dedup(none).count() == 0
    assert jaccard_join.similar_documents(none).count() == 0


def test_sketch_rules_out_only_dissimilar_sets():
    import numpy as np

    from sitelens.llm.common import mix
    rng, missed = np.random.default_rng(0), 0
    for n in (5, 20, 60, 400):
        for _ in range(100):
            tokens = mix(rng.integers(0, 2**62, 2 * n).astype(np.uint64))
            k = int(np.ceil(n * 8 / 9))  # shared by two sets of n: Jaccard of 0.8
            sets = [np.sort(tokens[:n]), np.sort(np.r_[tokens[:k], tokens[n : 2 * n - k]])]
            s = jaccard_join.sketches(np.array([0, n, 2 * n]), np.concatenate(sets))
            missed += not jaccard_join.sketch_forest([1, 2], [-1, -1], [x.tobytes() for x in s], 0.8)
    assert missed == 0


def test_hash_of_kept_matches_query(spark):
    from sitelens.llm.queries import QUERIES
    rows = {r["doc_id"]: r for r in QUERIES["op1_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()}
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert set(rows) == {r["doc_id"] for r in texts}
    for r in texts:
        x = rows[r["doc_id"]]
        assert x["n_bytes"] == len((r["text"] or "").encode())
        if x["n_removed"] == 0:
            assert x["kept_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


@pytest.mark.parametrize("n,k", [(5, 4), (10, 9), (20, 18), (120, 107)])
def test_pairs_whose_tokens_are_all_hot_meet(spark, n, k):
    """Sets of n words from a pool in which every word fills a large bucket: each pair shares a leaf of some run."""
    r = random.Random(n)
    pool, rows = [f"w{i}" for i in range(25 * n)], []
    for i in range(1500):
        w = r.sample(pool, 2 * n - k)
        rows += [(2 * i, " ".join(w[:n])), (2 * i + 1, " ".join(w[:k] if n == 5 else w[:k] + w[n:]))]
    reps = jaccard_join._sets(spark.createDataFrame(rows, "doc_id long, text string"), 1, 0.8)
    leaves = jaccard_join._leaves(reps, 30)
    met = collections.defaultdict(list)
    for x in leaves.distinct().collect():
        met[x["path"]].append(x["doc_id"])
    together = {i // 2 for ids in met.values() for i in set(ids) if i % 2 == 0 and i + 1 in ids}
    assert len(together) == 1500
