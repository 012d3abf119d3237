"""Search and ranking: hand goldens, fallback, paging, batch = single."""

import datetime as dt

import pytest

from sitelens.operators import search as S

AS_OF = dt.datetime(2002, 1, 1)
SCHEMA = ("id long, website_url string, platform string, industry string, tags string, "
          "tag_confidence map<string,double>, last_used_at timestamp_ntz, heat_score double")


def sites(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def scores(df):
    return {r["id"]: round(r["score"], 9) for r in df.collect()}


def test_golden_score(spark):
    s = sites(spark, [(1, "https://acme-webflow.io/saas/pricing", "Webflow, Next.js", "SaaS",
                       "pricing, saas", {"saas": 0.8}, None, 50.0)])
    assert scores(S.ranked(s, "webflow saas", as_of=AS_OF)) == {1: 23.1}


def test_fuzzy_fallback_and_drop(spark):
    s = sites(spark, [(1, "https://x.test/a", "Other", "ECONOMY", "", None, None, None),
                      (2, "https://abcdxy/", "P", "Q", "", None, None, None)])
    assert scores(S.ranked(s, "econmy", as_of=AS_OF)) == {1: 1.0}
    # host at distance 2: candidate of the fallback, but scores 0 and is dropped
    assert scores(S.ranked(s, "abcdef", as_of=AS_OF)) == {}


def test_fallback_only_without_direct(spark):
    s = sites(spark, [(1, "https://x.test/a", "Other", "ECONOMY", "econmy", None, None, None),
                      (2, "https://y.test/b", "Other", "ECONOMY", "", None, None, None)])
    # site 1 matches directly, so site 2 (a typo match) is not considered
    assert set(scores(S.ranked(s, "econmy", as_of=AS_OF))) == {1}


def test_recency_multiplier(spark):
    past = AS_OF - dt.timedelta(days=40)
    future = AS_OF + dt.timedelta(days=10)
    s = sites(spark, [(1, "https://a.test/", "Gear", "", "", None, past, None),
                      (2, "https://b.test/", "Gear", "", "", None, future, None)])
    got = scores(S.ranked(s, "gear", as_of=AS_OF))
    assert got[1] == 4.5 and got[2] == round(4.5 * 1.001, 9)


def test_synonyms_and_terms():
    assert S.expand_terms("Shop!") == sorted({"shop", "store", "ecommerce", "e-commerce", "cart",
                                              "checkout"})
    assert S.expand_terms("no-code") == ["code", "no"]
    assert "no-code" in S.expand_terms("nocode")
    assert S.expand_terms("   ") == []


def test_paging(spark):
    rows = [(i, f"https://w{i}.test/widget", "", "", "widget", None, None, None) for i in range(25)]
    s = sites(spark, rows)
    r, info = S.search(s, "widget", page=9, as_of=AS_OF)
    i = info.first()
    assert (i["page"], i["total_pages"], i["total_results"], i["has_previous"], i["has_next"]) == \
        (1, 3, 25, False, True)
    assert [x["id"] for x in r.orderBy("rank").collect()] == list(range(10))
    r2, info2 = S.search(s, "widget", page=3, as_of=AS_OF)
    assert [x["id"] for x in r2.orderBy("rank").collect()] == list(range(20, 25))
    assert info2.first()["has_next"] is False
    empty, info3 = S.search(s, "", page=1)
    assert empty.count() == 0 and info3.first()["total_results"] == 0


@pytest.mark.parametrize("q", ["red widget", "econmy", "brand17", "zzzz", "gear"])
def test_batch_equals_single(spark, sf_small, q):
    from sitelens.plans import fixtures as FX
    cat = FX.sites(spark, sf_small)
    single = S.search_all(cat, q, as_of=FX.AS_OF).limit(10)
    batch = S.search_batch(cat, spark.createDataFrame([(1, q)], "query_id long, q string"),
                           k=10, as_of=FX.AS_OF)
    a = [(r["id"], round(r["score"], 9)) for r in single.collect()]
    b = [(r["id"], round(r["score"], 9)) for r in batch.orderBy("rank").collect()]
    assert a == b
    total = S.ranked(cat, q, as_of=FX.AS_OF).count()
    assert all(r["total_results"] == total for r in batch.collect())


def test_page_concat_is_full_ranking(spark, sf_small):
    from sitelens.plans import fixtures as FX
    cat = FX.sites(spark, sf_small)
    full = [r["id"] for r in S.search_all(cat, "small", as_of=FX.AS_OF).collect()]
    pages = []
    for p in range(1, 4):
        rows, _ = S.search(cat, "small", page=p, as_of=FX.AS_OF)
        pages += [r["id"] for r in rows.orderBy("rank").collect()]
    assert pages == full[:len(pages)]


def test_heat_leaderboard(spark):
    s = sites(spark, [(1, "u1", "", "", "", None, None, None), (2, "u2", "", "", "", None, None, 0.0),
                      (3, "u3", "", "", "", None, None, 50.0), (4, "u4", "", "", "", None, None, 70.0)])
    out = S.heat_leaderboard(s, limit=3, offset=0).orderBy("rank").collect()
    assert [r["id"] for r in out] == [1, 4, 3]
    assert out[0]["total_positive_or_null"] == 3


def test_deep_pages(spark, sf_small):
    from sitelens.plans import fixtures as FX
    cat = FX.sites(spark, sf_small)
    full = [r["id"] for r in S.search_all(cat, "small", as_of=FX.AS_OF).collect()]
    for page in (2, 3):
        rows, info = S.search(cat, "small", page=page, as_of=FX.AS_OF)
        got = [(r["rank"], r["id"]) for r in rows.orderBy("rank").collect()]
        first = (page - 1) * 10
        assert got == [(first + i + 1, x) for i, x in enumerate(full[first:first + 10])]
    board = [r["id"] for r in S.heat_leaderboard(cat, limit=60).orderBy("rank").collect()]
    assert [r["id"] for r in S.heat_leaderboard(cat, limit=7, offset=33).orderBy("rank").collect()] == board[33:40]


def test_batch_equals_single_queries(spark, sf_small):
    from sitelens.plans import fixtures as FX
    cat = FX.sites(spark, sf_small)
    words = ["econmy", "smoll", "zzzz", "design", "a red", "https", "ui", "x", "brand17", "promo brushed tin", "", "bran#13", "red " * 40]
    qs = spark.createDataFrame([(w,) for w in words], "q string").selectExpr("q AS query_id", "q")
    out = S.search_batch(cat, qs, k=10, as_of=FX.AS_OF)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], round(r["score"], 9), r["total_results"]))
    for w in words:
        full = S.search_all(cat, w, as_of=FX.AS_OF).collect()
        assert got.get(w, []) == [(i + 1, r["id"], round(r["score"], 9), len(full)) for i, r in enumerate(full[:10])], w
    assert len(got) > 6


def test_stored_index(spark, sf_small, tmp_path):
    from pyspark.sql import functions as F
    from sitelens.plans import fixtures as FX
    cat = FX.sites(spark, sf_small)
    S.search_index(cat).write.parquet(str(tmp_path / "idx"))
    idx = spark.read.parquet(str(tmp_path / "idx"))
    qs = spark.createDataFrame([("red widget",), ("brand17",), ("econmy",), ("ui",)], "q string") \
        .select(F.col("q").alias("query_id"), "q")

    def rows(**kw):
        out = S.search_batch(cat, qs, k=10, as_of=FX.AS_OF, **kw)
        return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in out.collect())
    assert rows(index=idx) == rows()


def test_batch_typos_meet_on_three_keys_a_value(spark):
    """Every pair within two edits meets through a segment, for all short strings and many longer ones."""
    import itertools
    import random
    r = random.Random(0)
    names = ["".join(w) for n in (1, 2, 3, 4) for w in itertools.product("ab", repeat=n)]
    names += ["".join(r.choice("abc") for _ in range(r.randint(5, 14))) for _ in range(60)]
    values = spark.createDataFrame([(v,) for v in names], "value string")
    keys = values.selectExpr("value", f"{S._segments('value')} AS keys")
    assert keys.selectExpr("max(size(keys))").first()[0] == 3
    asked = values.selectExpr("value AS q", f"explode({S._asked_segments('value')}) AS key")
    met = {(x["value"], x["q"]) for x in keys.selectExpr("value", "explode(keys) AS key").join(asked, "key").distinct().collect()}
    near = values.crossJoin(values.withColumnRenamed("value", "q")).filter("levenshtein(value, q) <= 2").collect()
    assert len(near) > 500 and {(x["value"], x["q"]) for x in near} <= met
    assert asked.groupBy("q").count().agg({"count": "max"}).first()[0] <= 75


def test_batch_terms_are_looked_up_by_their_rarest_piece(spark):
    from pyspark.sql import functions as F
    grams = spark.createDataFrame([("htt", i) for i in range(50)] + [("ttp", i) for i in range(50)] + [("tpx", 7), ("ab", 3)], "gram string, id long")
    terms = spark.createDataFrame([(1, "httpx"), (2, "ab"), (3, "htq"), (4, "http"), (5, "httpq"), (6, "httpx")], "query_id long, t string")
    found = {x["t"]: x["gram"] for x in S._rarest_piece(terms, grams).collect()}
    assert found == {"httpx": "tpx", "ab": "ab", "http": "htt"}
    joined = grams.join(terms.join(S._rarest_piece(terms, grams), "t"), "gram")
    assert joined.filter(F.col("t") == "httpx").count() == 2  # one site for each of two queries, not the whole catalog
