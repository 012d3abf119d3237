"""Quality, language, language model, decontamination and segmentation operators."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitelens.llm import attention_lm, decontaminate, language, quality, segmentations

SF = "/root/testdata/sf0.01"
EDGE = [(10_001, None), (10_002, ""), (10_003, " \n\t"), (10_004, "x " * 40_000), (10_005, "same"), (10_006, "same"), (10_007, "é␀▁ 😀\x00\r\n")]
CLASH = "score double, row long, word string, n long, h long, m int, p long, key long, x string, rank int, ids string"


def edge_frame(spark, rows=EDGE):
    return spark.createDataFrame([(*x, *(None,) * 11) for x in rows], f"doc_id long, text string, {CLASH}") if rows else spark.createDataFrame([], f"doc_id long, text string, {CLASH}")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_quality_on_held_out_rows(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert got and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got)
    right = sum(r["predicted"] == r["quality"] for r in got)
    assert right >= 0.95 * len(got) and all(0 <= r["score"] <= 1 for r in got)


def test_quality_never_sees_bad_labels_or_held_out_rows(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    other = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.quality(docs, x).orderBy("doc_id").collect() for x in (labels, other.filter("quality = 1 or doc_id % 2 = 0")))
    assert a == b


def test_prior_estimate():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (3000, 4)), rng.normal(3, 1, (3000, 4))
    for share in (0.6, 0.85):
        n = int(2000 * share)
        found = quality.estimate_prior(good[2000:], np.vstack([good[:n], bad[: 2000 - n]]))
        assert abs(found - share) < 0.08


def test_quality_edges(spark):
    labels = spark.createDataFrame([(10_001, 1, 0), (10_001, 0, 0), (10_002, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality(edge_frame(spark), labels).collect()
    assert len(got) == len(EDGE) and {r["score"] for r in got} == {0.5}
    assert quality.quality(edge_frame(spark, []), labels).count() == 0
    x = quality.features(np.zeros(0, np.uint8), np.array([0, 0]))
    assert x.shape[0] == 1 and np.isfinite(x).all()


def test_keep_good_keeps_columns(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = quality.keep_good(docs, labels)
    want = {r["doc_id"] for r in quality.quality(docs, labels).filter("predicted = 1").collect()}
    assert kept.schema == docs.schema and {r["doc_id"] for r in kept.collect()} == want


def page(i, lang, text, path="", host="a.example.com"):
    return (i, f"https://{host}/{path}", None if text is None else f'<html{f" lang={lang!r}" if lang else ""}><body><script>var x="de";</script><p>{text}</p></body></html>')


def test_language(spark, docs):
    texts = {r["lang"]: r["text"] for r in docs.filter("length(text) > 500").orderBy(F.desc("doc_id")).collect()}
    some = {k: " ".join(v.split()[:60]) for k, v in texts.items()}
    rows = [page(1, "fr", some["de"], "de/x"), page(2, None, some["es"]), page(3, None, ""), page(4, "de", ""), page(5, None, None, "fr/")]
    rows += [page(10 + i, "de", some["de"], "de/", "b.example.org") for i in range(8)] + [page(30, None, "", "", "b.example.org"), (31, None, None)]
    pages = spark.createDataFrame([(*r, None, None) for r in rows], "page_id long, url string, html string, host string, row long")
    got = {r["page_id"]: r for r in language.identify(pages, docs).collect()}
    assert len(got) == len(rows)
    assert got[1]["lang"] == "de" and got[2]["lang"] == "es" and got[30]["lang"] == "de"
    assert all(0 < r["posterior"] <= 1 + 1e-9 for r in got.values())
    assert language.identify(pages.limit(0), docs).count() == 0
    assert {r["lang"] for r in language.identify(pages, docs.limit(0)).collect()} == {None}


def test_language_text_model_on_held_out_documents(spark, docs):
    even, odd = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1 and length(text) > 100")
    langs, table = language.train(even)
    got = language.text_likelihood(odd.select("doc_id", "text"), table, "doc_id").join(odd, "doc_id").collect()
    right = sum(langs[int(np.argmax(r["text_ll"]))] == r["lang"] for r in got)
    assert right > 0.97 * len(got)


def test_language_model(spark, docs):
    rows = [tuple(r) for r in docs.filter("doc_id < 120").select("doc_id", "text").collect()] + EDGE
    frame = edge_frame(spark, rows)
    got = {r["doc_id"]: r for r in attention_lm.score_texts(frame, head=50).collect()}
    words = {i: (t or "").encode().lower().split() for i, t in rows}
    counts = Counter()
    for i, w in words.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(w)
            counts["end"] += 1
    total, kinds = sum(counts.values()), len(counts)
    for i, w in words.items():
        w = [*w, "end"]
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    assert got[10_001]["score"] == got[10_002]["score"] == got[10_003]["score"]
    assert attention_lm.score_texts(edge_frame(spark, [])).count() == 0


def test_language_model_sums_to_one_and_learns():
    rng = np.random.default_rng(0)
    size = 6000
    total, beside = np.r_[rng.integers(0, 50, size - 1), 0].astype(float), rng.integers(0, 3, (size, 2 * attention_lm.SIDE)).astype(np.float32)
    model = attention_lm.Model(total, beside, 5)
    prefix = rng.integers(0, size - 1, 20)
    every = [np.r_[prefix, x] for x in range(size)]  # all that may come next
    off = np.arange(size + 1) * 21
    alone = model.score(prefix, np.array([0, 20]))[0]
    assert np.log10(np.sum(10 ** (model.score(np.concatenate(every), off) - alone))) == pytest.approx(0, abs=1e-3)
    text = np.tile(rng.integers(0, size - 1, 12), 30)  # a repeating text is learned
    codes, target, _ = model.blocks(text, np.array([0, len(text)]))
    before, adam = model.score(text, np.array([0, len(text)]))[0], attention_lm.Adam(model.w, 5e-3)
    for seed in range(40):
        for some, wanted in model.batches(codes, target, seed):
            adam.step(model.w, model.gradient(some, wanted))
    assert model.score(text, np.array([0, len(text)]))[0] > before + 50
    split = model.score(np.r_[text, prefix], np.array([0, len(text), len(text) + 20]))  # texts don't see each other
    assert split[1] == pytest.approx(model.score(prefix, np.array([0, 20]))[0], abs=1e-3)


def test_language_model_score_equals_naive_attention():
    """One token at a time, in double precision: attention over the block before and its own, then group, class and id."""
    rng = np.random.default_rng(3)
    size = 3000
    model = attention_lm.Model(np.r_[rng.integers(0, 50, size - 1), 0].astype(float), rng.integers(0, 3, (size, 2 * attention_lm.SIDE)).astype(np.float32), 5)
    model.w = {k: v + rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in model.w.items()}
    w = {k: v.astype(float) for k, v in model.w.items()}
    dim, block, group = attention_lm.DIM, attention_lm.BLOCK, attention_lm.GROUP

    def share(z, i):
        e = np.exp(z - z.max())
        return np.log10(e[i] / e.sum())

    def naive(ids):
        x = w["emb"][np.r_[model.start, model.code[ids[:-1]]]]
        q, k, v = (x @ w["qkv"][:, i * dim : (i + 1) * dim] for i in range(3))
        total = 0.0
        for t, token in enumerate(ids):
            seen = np.arange(max(0, (t // block - 1) * block), t + 1)
            a = np.exp(k[seen] @ q[t] + w["rel"][t - seen])
            h = np.r_[(a / a.sum()) @ v[seen] @ w["o"] + x[t], 1.0]
            c = model.cls[token]
            total += share(h @ w["out"], c // group) + (share(h @ w["inside"][c // group], c % group) if c // group < len(w["inside"]) else 0.0) + model.inner[token]
        return total

    texts = [np.r_[rng.integers(0, size - 1, n), size - 1] for n in (0, 1, 15, 16, 17, 90)]
    off = np.cumsum([0, *map(len, texts)])
    for step in (1, 3, 1024):
        assert model.score(np.concatenate(texts), off, step) == pytest.approx([naive(t) for t in texts], rel=1e-4)


def test_language_model_slopes_equal_differences():
    """Along the slope of each weight the loss changes by the slope's square; chunks of any size give the same slopes."""
    rng = np.random.default_rng(5)
    size = 3000
    model = attention_lm.Model(np.r_[rng.integers(0, 50, size - 1), 0].astype(float), rng.integers(0, 3, (size, 2 * attention_lm.SIDE)).astype(np.float32), 5)
    model.w = {k: v + rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in model.w.items()}
    texts = [np.r_[rng.integers(0, size - 1, n), size - 1] for n in (0, 1, 15, 16, 17, 90, 700)]
    ids, off = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    codes, target, _ = model.blocks(ids, off)
    slopes = model.gradient(codes, target)
    for name, slope in slopes.items():
        weight, far = model.w[name], 0.02 / np.abs(slope).max()
        ends = []
        for sign in (1, -1):
            model.w[name] = weight + np.float32(sign * far) * slope
            ends.append(-np.log(10) * model.score(ids, off).sum() / len(ids))
        model.w[name] = weight
        assert (ends[0] - ends[1]) / (2 * far) == pytest.approx((slope.astype(float) ** 2).sum(), rel=0.03)
    for chunk in (1, 7, 10_000):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(attention_lm, "CHUNK", chunk)
            again = model.gradient(codes, target)
        assert all(again[k] == pytest.approx(slopes[k], abs=1e-6) for k in slopes)


def test_language_model_encodes_new_words_in_one_call():
    """Words joined by blanks have the ids of each alone, whatever (Unicode) blanks or marks they hold; plain words take one call."""
    ranks = attention_lm.load_vocabulary()
    rng = np.random.default_rng(7)
    odd = ["\u00a0", "a\u00a0", "\u00a0b", "\x85", "\x1c", "a\x1db", "'s", "'ll", "x's", "1'2", "\ufffd", "\u65e5\u672c", "!!", "\u200b", "\u3000", "\u2028", "<|endoftext|>"]
    words = ["".join(rng.choice(odd, n)).encode() for n in rng.integers(1, 4, 500)] + [b"\xff\xfe", b"a\xc3"]
    enc = attention_lm.Encoder(ranks)
    one = [enc.encode(" " + w.decode("utf-8", "replace")) for w in words]
    flat, length = enc.ids(enc.numbers(words))
    assert flat.tolist() == [i for ids in one for i in ids] and length.tolist() == list(map(len, one))
    enc = attention_lm.Encoder(ranks, {b"word5": -1.0})
    plain, calls, encode = [f"word{i}".encode() for i in range(1000)], [], enc.encode
    enc.encode = lambda text: calls.append(text) or encode(text)
    numbers = enc.numbers(plain + plain[:10])
    assert len(calls) == 1
    assert [x.tolist() for x in np.split(enc.ids(numbers)[0], np.cumsum(enc.ids(numbers)[1])[:-1])] == [encode(" " + w.decode()) for w in plain + plain[:10]]
    assert enc.log[numbers][5] == -1.0 and np.isnan(enc.log[numbers]).sum() == 1008


def test_language_model_splits_only_texts_whose_turn_it_is():
    frame = pa.RecordBatch.from_pylist([{"text": "A b"}, {"text": "c"}, {"text": "D e f"}])
    assert list(attention_lm._texts(frame, 3, [True, False, True])) == [(0, [[b"a", b"b"], None]), (2, [[b"d", b"e", b"f"]])]
    assert [words for _, texts in attention_lm._texts(frame, 3) for words in texts] == [[b"a", b"b"], [b"c"], [b"d", b"e", b"f"]]


def test_language_model_trains_on_every_token(spark, docs):
    """All tokens of the training texts, each in one round, however the rows are split; copies and NULL ids too."""
    rows = docs.select("doc_id", "text").limit(300).collect()
    rows = [(x["doc_id"], x["text"]) for x in rows] + [(None, "one more text " * 50)] * 3 + [(20_000 + i, "copies of a text " * 700) for i in range(40)]
    ranks = attention_lm.load_vocabulary()
    rng, size = np.random.default_rng(0), len(ranks) + 1
    enc, end = attention_lm.Encoder(ranks), len(ranks)
    ids, *_ = attention_lm._ids(enc, [(t or "").encode().lower().split() for _, t in rows], end)
    for limit in (attention_lm.PIECE_BYTES, 30_000):
        seen = 0
        for number in range(2):
            model = attention_lm.Model(np.bincount(ids, minlength=size).astype(float), rng.integers(0, 3, (size, 2 * attention_lm.SIDE)).astype(np.float32), 5)
            frame = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t or ""} for i, t in rows])
            seen += attention_lm.local_steps([frame], model, enc, end, attention_lm.Adam(model.w, 1e-3), number, 2, limit)
        assert seen == len(ids)


QUESTION = "a train with Maria leaves the old station at 9 hours and travels 120 km before Maria meets Peter near the river bridge"


def test_decontamination(spark):
    other = "a train with Paula leaves the old station at 7 hours and travels 450 km before Paula meets Oscar near the river bridge"
    mixed = "a train with Paula leaves the old station at 7 hours and travels 450 km before Linda meets Oscar near the river bridge"
    r = random.Random(0)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows = [(1, f"{prose(30)} {QUESTION} {prose(30)}"), (2, f"{prose(5)} {other}"), (3, f"{mixed} {prose(9)}"), (4, prose(200)), (5, None), (6, ""), (7, QUESTION.upper()), (8, f"{prose(3)} {prose(20_000)} {QUESTION}"), (9, "short one here too now"), (10, "short one here too now")]
    items = spark.createDataFrame([(1, QUESTION, None), (1, QUESTION, None), (2, None, None), (3, "short one here too now", None), (4, "too short", None), (5, "", None)], "item_id long, text string, doc_id long")
    got = {(x["doc_id"], x["item_id"]): x for x in decontaminate.contaminated(edge_frame(spark, rows), items).collect()}
    assert set(got) == {(1, 1), (2, 1), (8, 1), (9, 3), (10, 3)}
    assert got[2, 1]["reparameterised"] and not got[1, 1]["reparameterised"] and got[1, 1]["at_word"] == 30
    blocks = decontaminate.contaminated(edge_frame(spark, rows), items, block=5).collect()
    assert {(x["doc_id"], x["item_id"]) for x in blocks} == set(got)
    assert {x["doc_id"] for x in decontaminate.clean(edge_frame(spark, rows), items).collect()} == {3, 4, 5, 6, 7}
    assert decontaminate.contaminated(edge_frame(spark, []), items).count() == 0
    assert decontaminate.contaminated(edge_frame(spark, rows), items.limit(0)).count() == 0


def test_decontamination_finds_copies_that_are_mostly_slots(spark):
    """Title case, lists of names, numbers, one-window items after a comma or in another case; other lists stay."""
    items = ["The Quick Brown Fox Jumps Over The Lazy Dog And Runs Away From Home", "Anna Bert Carla Dora Emil Frida Gustav Heidi Ingo Jana Karl Lena",
             "12 7 19 44 3 8 27 91 13 6 55 70 2 31", "What is the capital of France?", "where does Maria live now"]
    held = [f"we saw {items[0]} there", f"guests: {items[1]}, all", f"draw {items[2]} done", f"he asked, {items[3]} and left", f"so {items[4].upper()} he said", "ask, What is the capital of Spain? and go",
            "The Slow Green Cat Walks Under The Busy Bee And Comes Back To Town", "11 8 18 45 4 9 26 92 14 7 54 71 3 30", "Rosa Paul Nina Otto Mia Tom Eva Max Ida Leo Ben Zoe"]
    asked = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in decontaminate.contaminated(edge_frame(spark, list(enumerate(held))), asked).collect()}
    assert set(got) == {*((i, i) for i in range(5)), (5, 3)}
    assert got[5, 3]["reparameterised"] and not any(got[i, i]["reparameterised"] for i in range(5))


def test_decontamination_finds_edited_copies(spark):
    """A word put in or left out in the middle or at the thirds, a word altered in the middle; half an item and far pieces stay."""
    r = random.Random(3)
    prose = lambda n: ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    items, rows, want = [], [], set()
    for i, n in enumerate((17, 20, 22, 30, 41)):
        w = prose(n)
        items.append((i, " ".join(w)))
        edits = [w[: n // 2] + ["more"] + w[n // 2 :], w[: n // 2] + w[n // 2 + 1 :], w[: n // 2] + ["other"] + w[n // 2 + 1 :], w[: n // 3] + ["more"] + w[n // 3 : 2 * n // 3] + ["words"] + w[2 * n // 3 :]]
        for k, e in enumerate(edits):
            rows.append((10 * i + k, " ".join(prose(20) + e + prose(20))))
            want.add((10 * i + k, i))
        rows += [(10 * i + 8, " ".join(prose(20) + w[: n // 2] + prose(20))), (10 * i + 9, " ".join(w[: n // 2] + prose(200) + w[n // 2 :]))]
    got = decontaminate.contaminated(edge_frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == want


def test_decontamination_finds_every_planted_item(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = {x["item_id"]: x["text"].split() for x in items.collect()}
    want = {(d["doc_id"], i) for d in docs.collect() for i, w in texts.items() if " ".join(w) in " ".join((d["text"] or "").split())}
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(docs, items).collect()}
    assert want <= got and len(got) <= 1.1 * len(want)


@pytest.fixture(scope="module")
def pieces():
    return segmentations.Pieces()


def every_segmentation(p, text):
    raw = {int(i): p.pool[p.pool_start[i] : p.pool_end[i]].tobytes() for i in p.id}
    weight = dict(zip((raw[int(i)] for i in p.id), p.weight))
    out = []

    def extend(at, found, w):
        if at == len(text):
            out.append((tuple(found), w))
        for size in p.lengths:
            x = text[at : at + size]
            if len(x) == size and x in weight:
                extend(at + size, [*found, x], w + weight[x])

    extend(0, [], 0.0)
    norm = np.logaddexp.reduce([w for _, w in out])
    return {s: math.exp(w - norm) for s, w in out}, raw


def test_segmentations_follow_the_distribution(pieces):
    n, text = 1500, b"the cat"
    chance, raw = every_segmentation(pieces, b" " + text)
    buf, off = np.frombuffer(text * n, np.uint8), np.arange(n + 1) * len(text)
    seen, weight = [[] for _ in range(n)], 0.0
    for docs, ids, ioff, log_prob, perturbed, inclusion, same in segmentations.sample(pieces, np.arange(n), buf, off, 3):
        assert same.all()
        for d, lo, hi, lp, g, q in zip(docs, ioff[:-1], ioff[1:], log_prob, perturbed, inclusion):
            s = tuple(raw[i] for i in ids[lo:hi].tolist())
            assert lp == pytest.approx(math.log(chance[s]), abs=1e-6)
            seen[d].append((s, g))
            weight += math.exp(lp) / q
    assert all(len({s for s, _ in x}) == 3 and [g for _, g in x] == sorted((g for _, g in x), reverse=True) for x in seen)
    assert weight / n == pytest.approx(1, abs=0.05)
    first, second = Counter(x[0][0] for x in seen), Counter(x[1][0] for x in seen)
    for s, p in chance.items():
        assert first[s] / n == pytest.approx(p, abs=0.05)
        assert second[s] / n == pytest.approx(sum(q * p / (1 - q) for t, q in chance.items() if t != s), abs=0.05)


def test_segmentations_of_all_texts(spark, docs, pieces):
    rows = [tuple(r) for r in docs.filter("doc_id < 60").select("doc_id", "text").collect()] + EDGE
    frame = edge_frame(spark, rows)
    enc = segmentations.encode(frame, k=2)
    got = enc.collect()
    assert all(r["round_trip"] for r in got) and {r["doc_id"] for r in got if r["rank"] == 1} == {i for i, _ in rows}
    texts = {(r["doc_id"], r["rank"]): r["text"] for r in segmentations.decode(enc).collect()}
    assert all(texts[r["doc_id"], r["rank"]] == (dict(rows)[r["doc_id"]] or "") for r in got)
    ids = Counter((r["doc_id"], tuple(r["ids"])) for r in got)
    assert max(ids.values()) == 1
    assert all(0 < r["inclusion"] <= 1 or r["log_prob"] < -30 for r in got)
    again = segmentations.encode(frame.repartition(5), k=2).collect()  # the same rows on other partitions
    key = lambda r: (r["doc_id"], r["rank"], tuple(r["ids"]))
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert segmentations.encode(edge_frame(spark, [])).count() == 0
