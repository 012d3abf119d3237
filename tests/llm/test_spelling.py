"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sitelens.llm import spelling as S


def counted(rows, slip=97):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % slip == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            out[word] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def edits(word, letters):
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    near = {a + b[1:] for a, b in cut if b} | {a + c + b[1:] for a, b in cut if b for c in letters} | {a + c + b for a, b in cut for c in letters}
    return near - {word}


def slowly(a, b):
    a, b = sorted((a, b), key=len)
    at = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a != b and (a[at:] == b[at + 1 :] or (len(a) == len(b) and a[at + 1 :] == b[at + 1 :]))


def brute(rows, slip=97):
    words = counted(rows, slip)
    letters = {c for w in words for c in w}
    form, result = {}, {}
    for w, n in words.items():
        others = edits(w, letters) if len(w) < 50 else [x for x in words if abs(len(x) - len(w)) < 2 and slowly(w, x)]
        found = sorted((-words[x], x) for x in others if x in words)
        form[w] = found[0][1] if found and -found[0][0] >= 2 * n else None
        result[w] = [form[w], n, len(found), words[form[w]] if form[w] else None]
    for w, r in result.items():
        root = w
        while form[root]:
            root = form[root]
        r.insert(1, root)
    return {(w, *r) for w, r in result.items()}


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, n long, word string, cell long").repartition(5)


def corpus(seed=0, vocabulary=400):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeé") for _ in range(r.randint(3, 9))) for _ in range(vocabulary)]
    base += [w[:i] + r.choice("abcdeéÿ") + w[i + r.randint(0, 1) :] for w in base for i in [r.randrange(len(w))]]
    rows = [(i, " ".join(r.choice(base[: r.choice([5, 50, len(base)])]) for _ in range(300)) + ". ABcde×ÀB'x1é") for i in range(60)]
    chain = "qqqqqqqq", "qqqqqqqw", "qqqqqqww", "qqqqqwww"
    rows.append((99, " ".join(" ".join([w] * 3 * 2 ** k) for k, w in enumerate(chain))))
    long = "z" * 70_000
    return rows + [(7, "repeat repeet repeat repeat"), (7, "repeat repeet repeat repeet"), (None, "nullid nullid nulled nulled nulled nullid"), (5, None), (6, ""), (8, f"{long}y {long}y {long}y {long} {long} {long} {long}x" + f" {long}yy" * 3 + " stop " * 9000)]


@pytest.mark.parametrize("how", [{}, {"cell": 20, "tile": 7, "share": 11}, {"cell": 3, "tile": 2, "share": 5}, {"slip": 3}])
def test_variants_equal_brute_force(spark, how):
    rows = corpus()
    found = S.variants(frame(spark, rows), **how).collect()
    assert len(found) == len({r["word"] for r in found})
    want = brute(rows, how.get("slip", 97))
    assert {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found} == want
    assert max(len(w) for w, *_ in want) > 69_999 and any(root not in (form, w) for w, form, root, *_ in want if form)


def test_empty_tables(spark):
    assert S.variants(frame(spark, [(1, "a b")]).limit(0)).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert S.variants(frame(spark, [(1, None), (2, "four only lone words")])).count() == 0


def test_trees_reach_every_near_vector():
    r = np.random.default_rng(0)
    for limit in (1, 5):
        letters = r.choice(np.frombuffer(b"abcd\xe9", np.uint8), (300, 6))
        x = S.vectors(letters)
        tree = S.Tree(x, limit)
        home = tree.home(x)
        assert all((home[m] == i).all() for i, m in enumerate(tree.members))
        seen = set(zip(*(v.tolist() for v in tree.reach(x, True, True))))
        diff = x[:, None] - x[None]
        close = (np.maximum(diff, 0).sum(-1) <= 1) & (np.maximum(-diff, 0).sum(-1) <= 1)
        assert {(a, int(home[b])) for a, b in zip(*np.nonzero(close))} <= seen
        if limit == 1:  # boxes are pruned
            assert len(seen) < 0.5 * 300 * len(tree.members)
