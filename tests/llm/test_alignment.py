"""Cross-tokenizer alignment against a plain Python twin that uses the vocabularies' own libraries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sitelens.llm import alignment as A


@pytest.fixture(scope="module")
def vocabularies():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A.BYTE_VOCABULARY)
    a.encode_special_tokens = True
    letters = A._byte_letters()
    size = {i: len([letters[c] for c in t]) for t, i in a.get_vocab().items() if all(c in letters for c in t)}
    b = sentencepiece.SentencePieceProcessor(model_file=A.PIECE_MODEL)
    return a, size, b


def brute(rows, vocabularies):
    a_model, a_size, b_model = vocabularies
    linked, out = [], []
    for _, text in rows:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        spelled = [bytes([int(b_model.id_to_piece(i)[3:-1], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(spelled) != (" " + text).encode():
            a, b, spelled = [], [], []
        ends_a, ends_b = np.cumsum([a_size[i] for i in a]).tolist(), np.cumsum([len(x) for x in spelled]).tolist()
        groups, x, y = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x2, y2 = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((a[x:x2], b[y:y2]))
            x, y = x2, y2
        assert x == len(a) and y == len(b)
        linked.append(Counter((i, j) for p, q in groups for i in p for j in q))
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append([len(a), len(b), len(groups), linked[-1].total(), text])
    docs = Counter(p for c in linked for p in c)
    best = defaultdict(int)
    for (i, j), n in docs.items():
        best[i] = max(best[i], n)
    for r, c in zip(out, linked):
        r[4:4] = [sum(n for p, n in c.items() if docs[p] == best[p[0]]), sum(n * docs[p] for p, n in c.items())]
    return [(d, *r[:6], hashlib.sha256(r[6].encode()).hexdigest() if r[6] else "", r[6]) for (d, _), r in zip(rows, out)], docs, sum(linked, Counter()), best


def unusual():
    texts = [None, "", " ", "\n", "a", "Hello world!", "<|endoftext|> <s> </s> <unk> [INST]", "▁ underline ▁", "tab\tand\r\nline  two   blanks here　", "emoji 🙂🙂 日本語のテキスト ́ naïve", "\x00\x01 control ﻿ �",
             "ab" * 3000, "x" * 1500 + " " * 700 + "\n" * 400 + "end", "12345678901234567890 3.14 don't we'll I'M", "ﬁ ligature ½ Ａ", " leading and trailing  ", "<0x41> <0x0A>"]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (None, "null id"), (5, "Hello world!"), (5, "Hello world! again Hello world!")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], "doc_id long, text string, pair long, number long, groups string")


def check(docs, rows, vocabularies):
    found, pairs = A.align(docs, keep_groups=True)
    want, n_docs, n_links, best = brute(rows, vocabularies)
    order = lambda rows: sorted(rows, key=repr)
    assert order(tuple(r) for r in found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups").collect()) == order(want)
    got = {(r["a"], r["b"]): (r["n_docs"], r["n_links"], r["best"]) for r in pairs.collect()}
    assert got == {p: (n, n_links[p], n == best[p[0]]) for p, n in n_docs.items()}


def test_documents_and_pairs_equal_the_twin(spark, sf_small, vocabularies):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] + unusual()
    check(frame(spark, rows).repartition(3), rows, vocabularies)


def test_containers_in_pieces_and_dense_ones(spark, vocabularies, monkeypatch):
    for name, value in (("CONTAINER", 64), ("BITMAP", 8), ("HELD", 40), ("LINKS", 50), ("BIG", 30)):
        monkeypatch.setattr(A, name, value)
    rows = [(i, "the cat " * (1 + i % 9) + "abcdefghijkl" * (i % 3) + f" {i}") for i in range(300)] + unusual()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # pieces of one container in several batches
        check(frame(spark, rows).coalesce(1), rows, vocabularies)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_both_libraries_for_the_byte_vocabulary_agree(vocabularies):
    v = A.ByteVocabulary(open(A.BYTE_VOCABULARY, encoding="utf-8").read())
    assert v.fast is not None
    for _, text in unusual():
        if text:
            assert list(v.ids(text)) == vocabularies[0].encode(" " + text, add_special_tokens=False).ids
    every = "".join(map(chr, range(1, 0x250))) + " ".join(map(chr, range(1, 0x250)))
    assert v.fast.encode_ordinary(every) == v.exact.encode(every, add_special_tokens=False).ids


def test_packed_containers():
    r = np.random.default_rng(0)
    for n in (1, 255, 256, 257, 4096):
        places = np.sort(r.choice(A.CONTAINER, n, replace=False))
        column = A.pack(np.concatenate([[7], places, places[:1]]), np.array([1, n, 1]))
        assert A.sizes(column).tolist() == [1, n, 1] and np.array_equal(A.unpack(column[1].as_py()), places)


def test_empty_table(spark):
    docs, pairs = A.align(frame(spark, [(1, "a")]).limit(0))
    assert docs.count() == 0 and pairs.count() == 0
    docs, pairs = A.align(frame(spark, [(1, None)]))
    assert [tuple(r) for r in docs.collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] and pairs.count() == 0
