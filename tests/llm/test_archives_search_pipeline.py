"""WARC archives, top-k search and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitelens.llm import topk_search, warc
from sitelens.session import scratch_path

CLASH = "file string, start long, next long, value string, same string"
FALSE_RECORD = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def pages():
    r = random.Random(0)
    text = lambda n: "".join(r.choice("abc é\r\nWARC/1.") for _ in range(n))
    rows = [(i, f"http://h/{i}", text(r.randint(0, 4000))) for i in range(40)]
    rows += [(100, "u v\r\nWARC/1.1\r\n", FALSE_RECORD), (101, None, "x" + FALSE_RECORD * 400), (102, "u", None), (103, "u", ""), (104, "u", "WARC/1.1\r\n"), (105, "u", "WARC/1.1\r\n" * 3 + "\r\n\r\n")]
    rows += [(200 + i, "u", "copy" * 250) for i in range(5)] + [(300 + i, "u", "copy" * 249) for i in range(3)] + [(400, "u", "long " * 300_000), (401, "u", "long " * 300_000)]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, *(None,) * 5) for x in rows], f"page_id long, url string, html string, {CLASH}").repartition(3)


@pytest.mark.parametrize("split", ["64k", "128m"])
def test_warc_round_trip(spark, split):
    rows = pages()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = {r["record_id"]: r for r in warc.round_trip(frame(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert set(got) == {f"<urn:page:{i}>" for i, _, _ in rows}
    last = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        last[raw] = max(last.get(raw, i), i)
    for i, _, html in rows:
        raw, r = (html or "").encode(), got[f"<urn:page:{i}>"]
        assert r["digest"] == "sha1:" + hashlib.sha1(raw).hexdigest() and r["payload_length"] == len(raw)
        if len(raw) >= 1000 and last[raw] != i:
            assert (r["type"], r["refers_to"], bytes(r["payload"])) == ("revisit", f"<urn:page:{last[raw]}>", b"")
        else:
            assert (r["type"], r["refers_to"], bytes(r["payload"])) == ("response", None, raw)


def test_warc_of_null_and_repeated_ids(spark):
    long = "same payload " * 100
    rows = [(None, "u", long), (5, "u", long), (5, "v", long), (3, "u", long), (None, "u", "x"), (None, "u", "x"), (7, None, None)]
    got = sorted(((r["record_id"], r["type"], r["refers_to"], len(r["payload"])) for r in warc.round_trip(frame(spark, rows)).collect()), key=repr)
    name = "<urn:page:%d>"
    assert got == sorted([(None, "response", None, len(long)), (name % 5, "response", None, len(long)), (name % 5, "response", None, len(long)), (name % 3, "revisit", name % 5, 0),
                          (None, "response", None, 1), (None, "response", None, 1), (name % 7, "response", None, 0)], key=repr)


def test_warc_texts_are_not_shuffled_when_nothing_is_rejected(spark, sf_small):
    plan = warc.round_trip(spark.read.parquet(f"{sf_small}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_warc_stops_at_a_broken_chain_and_reads_nothing_from_an_empty_table(spark):
    assert warc.round_trip(frame(spark, pages()).limit(0)).count() == 0
    good = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    path = scratch_path(spark, "broken")
    spark.createDataFrame([(good + good.replace("Length: 2", "Length: 9").replace(":1>", ":2>") + good.replace(":1>", ":3>"),)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    assert {r["record_id"] for r in warc.read_warc(spark, path).collect()} == {"<urn:page:1>", "<urn:page:2>"}


def vectors():
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 0.3, 24).astype("float32").tolist()) for i in range(500)]
    rows += [(500 + i, rows[0][1]) for i in range(60)]  # ties
    return rows + [(1000, None), (1050, [None] + [0.5] * 23), (1051, [float("nan")] + [0.5] * 23), (1100, [float("inf")] * 24), (1150, []), (1200, [0.5, -0.5]), (1201, [1.0, 1.0]), (1250, [0.0] * 24)]


@pytest.mark.parametrize("block", [4096, 4])
def test_topk(spark, block):
    rows = vectors()
    df = spark.createDataFrame([(*x, None, None) for x in rows], "vec_id long, embedding array<float>, score long, rank int").repartition(5)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk_search.top_k(df, df.filter("vec_id % 50 = 0"), 5, block).collect()}
    ok = {i: np.floor(256 * np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in ok:
        if q % 50 == 0:
            best = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:5]
            want |= {(q, r): (i, -s) for r, (s, i) in enumerate(best, 1)}
    assert got == want and (1200, 1) in want and (1200, 2) not in want
    assert topk_search.top_k(df.limit(0), df.limit(0)).count() == 0


def test_topk_of_null_repeated_and_huge(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(None, [1.0, 2.0]), (50, [1.0, 0.0]), (50, [2.0, 0.0]), (50, [0.5, 9.0]), (1, [3.0, 0.0]), (1, [3.0, 0.0]), (2, [1.0, 1.0]), (None, None)]
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = [tuple(r) for r in topk_search.top_k(df, df.filter("vec_id % 50 = 0")).orderBy("rank").collect()]
    assert got == [(50, 1, 2, 65536 // 2 + 9 * 65536), (50, 2, 1, 3 * 65536 // 2)]  # the smallest vector stands for id 50
    big = [(0, [3e20, 1.0, 0.0]), (1, [1.0, 1.0, 0.0]), (2, [-3e20, 0.0, 0.0]), (3, [2.0**53 / 256, 1.0, 1.0]), (50, [2.0**30, 1.0, 0.0]), (4, [1e308, 0.0, 0.0]), (5, [0.0, 1.0, 0.0])]
    whole = lambda v: [int(x * 256) if abs(x) < 1e300 else int(x) for x in v]
    limit = 2**63 - 1
    want = []
    for q in (0, 50):
        dot = {i: sum(a * b for a, b in zip(whole(dict(big)[q]), whole(v))) for i, v in big if i != q}
        ranked = sorted(((-max(-limit, min(limit, d)), i) for i, d in dot.items()))[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(ranked, 1)]
    df = spark.createDataFrame(big, schema).repartition(2)
    assert sorted(tuple(r) for r in topk_search.top_k(df, df.filter("vec_id % 50 = 0")).collect()) == want


def test_segment_bounds_hold_and_tighten():
    rng = np.random.default_rng(1)
    q, x = rng.normal(0, 50, (20, 64)), rng.normal(10, 50, (300, 64))
    last = None
    for n in topk_search.levels(64):
        (mq, sq), (mx, sx) = topk_search.statistics(q, n), topk_search.statistics(x, n)
        bound = mq @ mx.T + sq @ sx.T
        assert (bound >= q @ x.T - 1e-6).all()
        assert last is None or (bound <= last + 1e-6).all()
        last = bound


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    from sitelens.llm import decontaminate, quality
    from test_dedup import jaccard_brute
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "SentencePiece encoding"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch_path(spark, "stage-test")
        out = stage(spark, now, sf)
        out.write.parquet(path)
        new = spark.read.parquet(path)
        assert new.columns == docs.columns
        before, after = ({r["doc_id"]: r for r in x.collect()} for x in (now, new))
        if name == "quality classifier":
            good = {r["doc_id"] for r in quality.quality(now, spark.read.parquet(f"{sf}/labels.parquet")).filter("predicted = 1").collect()}
            assert set(after) == good
        elif name == "n-gram Jaccard join":
            brute = jaccard_brute([(i, r["text"]) for i, r in before.items()])
            assert set(after) == {i for i, (c, _) in brute.items() if c == i}
        elif name == "suffix-array dedup":
            assert set(after) == set(before)
            seen = {}
            for i, r in before.items():
                b = r["text"].encode()
                for p in range(len(b) - 399):
                    seen[b[p : p + 400]] = seen.get(b[p : p + 400], 0) + 1
            for i, r in before.items():
                b = r["text"].encode()
                gone = np.zeros(len(b), bool)
                for p in range(len(b) - 399):
                    if seen[b[p : p + 400]] > 1:
                        gone[p : p + 400] = True
                for p in range(len(b)):  # characters cut in part stay
                    if b[p] & 0xC0 != 0x80:
                        e = p + 1
                        while e < len(b) and b[e] & 0xC0 == 0x80:
                            e += 1
                        gone[p:e] = gone[p:e].all()
                assert after[i]["text"] == bytes(np.frombuffer(b, np.uint8)[~gone]).decode() and after[i]["n_chars"] == len(after[i]["text"])
        else:
            bad = {r["doc_id"] for r in decontaminate.contaminated(now, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert set(after) == set(before) - bad
        now = new
    last = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert {r["doc_id"] for r in last.filter("rank = 1 and round_trip").collect()} == {r["doc_id"] for r in now.collect()}
    run = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, run.select("doc_id", "rank", F.xxhash64("ids")).collect())) == sorted(map(str, last.select("doc_id", "rank", F.xxhash64("ids")).collect()))


def test_rows_with_null_or_repeated_ids_are_rows_of_their_own(spark, tmp_path):
    """Operators 1, 4, 7 and 8 and each stage on NULL and repeated doc_ids: no row is lost, multiplied or mixed up."""
    from sitelens.llm import block_dedup, decontaminate, jaccard_join, suffix_dedup
    r = random.Random(7)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    item, shared, copy = prose(30), prose(80), prose(60)
    clean = [prose(20) for _ in range(4)]
    rows = [(None, clean[0]), (None, clean[1]), (1, clean[2]), (1, clean[3]), (1, copy), (1, copy), (2, copy), (None, copy),
            (None, shared + " " + prose(70)), (3, prose(70) + " " + shared), (None, prose(5) + " " + item), (4, item + " " + prose(30)), (4, prose(40)), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    asked = spark.createDataFrame([(9, item)], "item_id long, text string")
    asked.write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = sorted(map(str, (i for i, _ in rows)))
    cut = suffix_dedup.suffix_dedup(docs).collect()
    assert sorted(str(x["doc_id"]) for x in cut) == ids and {t.encode() for t in clean} <= {bytes(x["kept"]) for x in cut}
    assert sorted(len(t or "") for _, t in rows) == sorted(x["n_bytes"] for x in cut)
    words = block_dedup.block_dedup(docs).collect()
    assert sorted(str(x["doc_id"]) for x in words) == ids and sum(x["kept"] == copy for x in words) == 1
    assert [x["doc_id"] for x in words if x["kept"] == copy] == [1] and sum(x["n_removed"] == 80 for x in words) == 1
    assert sorted(str(x["doc_id"]) for x in decontaminate.contaminated(docs, asked).collect()) == ["4", "None"]
    classes = jaccard_join.similar_documents(docs).collect()
    assert sorted(str(x["doc_id"]) for x in classes) == ids and sum(x["n_links"] == 3 and x["class_id"] == 1 for x in classes) == 4
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["n-gram Jaccard join"](spark, docs, str(tmp_path)).collect()
    assert len(kept) == len(rows) - 3 and [x["doc_id"] for x in kept if x["text"] == copy] == [1]
    texts = stages["suffix-array dedup"](spark, docs, str(tmp_path)).collect()
    assert sorted(str(x["doc_id"]) for x in texts) == ids and set(clean) <= {x["text"] for x in texts}
    left = stages["benchmark decontamination"](spark, docs, str(tmp_path)).collect()
    assert sorted((str(x["doc_id"]), x["text"]) for x in left if x["text"]) == sorted((str(i), t) for i, t in rows if t and item not in t)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    good = stages["quality classifier"](spark, docs, str(tmp_path)).collect()
    assert all(sum(x["text"] == t for x in good) <= sum(y == t for _, y in rows) for _, t in rows)
    codes = stages["SentencePiece encoding"](spark, docs, str(tmp_path)).filter("rank = 1").collect()
    assert sorted(str(x["doc_id"]) for x in codes) == ids
