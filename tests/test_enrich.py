"""Enrichment detectors: hand goldens."""


from sitelens.operators import enrich as E


def labels(arr):
    return [(x["label"], round(x["confidence"], 6)) for x in arr]


def test_platforms(spark):
    rows = [(1, '<link href="https://cdn.shopify.com/x.css"><script src="/_next/static/a.js">'),
            (2, "<p>x</p>"), (3, ""), (4, None), (5, "Joomla site")]
    df = spark.createDataFrame(rows, "id long, html string")
    got = {r["id"]: labels(r["p"]) for r in E.detect_platforms(df, "html", "p").collect()}
    assert got[1] == [("Shopify", 1.0), ("Next.js", 0.5)]
    assert got[2] == [("Custom", 0.5)]
    assert got[3] == [] and got[4] == []
    assert got[5] == [("Joomla", 1.0)]  # 'Joomla' and 'joomla' are two signals


def test_industries(spark):
    df = spark.createDataFrame([(1, "Cloud software platform shop"), (2, ""), (3, "it works")],
                               "id long, text string")
    got = {r["id"]: labels(r["i"]) for r in E.detect_industries(df, "text", "i").collect()}
    assert got[1] == [("SaaS", 1.0), ("E-commerce", 0.333333), ("Technology", 0.333333)]
    assert got[2] == []
    assert got[3] == [("Portfolio", 1.0), ("Technology", 1.0)]


def test_tags(spark):
    df = spark.createDataFrame([(1, "alpha alpha beta gamma beta alpha The the into")],
                               "id long, text string")
    got = [(r["tag"], r["confidence"], r["rank"]) for r in
           E.extract_tags(df, "id", "text").orderBy("rank").collect()]
    assert got == [("alpha", 1.0, 1), ("beta", 0.73, 2), ("gamma", 0.47, 3)]


def test_tags_ties_by_first_occurrence(spark):
    df = spark.createDataFrame([(1, "zeta beta zeta beta omega")], "id long, text string")
    got = [r["tag"] for r in E.extract_tags(df, "id", "text").orderBy("rank").collect()]
    assert got == ["zeta", "beta", "omega"]


def test_colors(spark):
    html = ('<meta name="theme-color" content="#FFF"><div style="color:#0070f3;background:#fff">'
            '</div><script>var c="#123456"</script>')
    html2 = '<style>.a{color:#abcd;border:#7928caff}</style><!-- #111111 -->'
    df = spark.createDataFrame([(1, html), (2, html2), (3, "")], "id long, html string")
    got = {r["id"]: (r["c"]["primary"], r["c"]["secondary"])
           for r in E.with_colors(df, "html", "c").collect()}
    assert got[1] == ("#ffffff", "#0070f3")
    assert got[2] == ("#7928ca", None)
    assert got[3] == (None, None)


def test_page_text(spark):
    html = ('<html><head><title> My &amp; Title </title><meta name="description" content=" Desc ">'
            '<script>var t="</p>";</script></head><body><p>One <b>bold</b><p>Two</p>'
            '<div>skip</div><p>Three</body></html>')
    df = spark.createDataFrame([(1, html), (2, "<p>no title</p>")], "id long, html string")
    got = {r["id"]: r["t"] for r in E.with_page_text(df, "html", "t").collect()}
    assert got[1] == "My & Title Desc One bold Two Three"
    assert got[2] == "  no title"


def test_enrich_record(spark):
    html = ('<title>Cloud shop</title><meta name="description" content="cloud software platform">'
            '<link href="https://cdn.shopify.com/x.css"><p>shop shop store</p>')
    df = spark.createDataFrame([(1, "https://a.test", html)], "page_id long, url string, html string")
    r = E.enrich_pages(df, as_of="2002-01-01 00:00:00").first()
    assert r["platform"] == "Shopify" and r["platforms"] == ["Shopify"]
    assert r["industry"].startswith("E-commerce") or r["industry"].startswith("SaaS")
    assert r["tags"].split(", ")[0] == "shop"
    assert r["enrichment_signals"]["platform_scores"] == {"Shopify": 1.0}
    assert r["tag_confidence"]["shop"] == 1.0


def test_industry_counts_equal_plain_counting(spark):
    """Keywords inside, before and behind one another are counted as str.count does, for any dictionary."""
    import random

    from sitelens.dictionaries import Dictionaries
    kws = (("A", ("shop", "shopping", "hop", "pin", "c++", "a b")), ("B", ("aa", "aba", "ping", "shop")), ("C", ("x.y", "(z", "é", "shop")), ("D", ()))
    dicts = Dictionaries(industries=kws)
    r = random.Random(0)
    texts = ["".join(r.choice(["shop", "ping", "a", "b", " ", "aa", "aba", "c++", "x.y", "xzy", "(z", "é", "hop"]) for _ in range(r.randrange(60))) for _ in range(80)] + ["", "shopping" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    items, places = E._industry_count_cols("t", "p", dicts)
    got = df.withColumn("p", places).select("t", *[c.alias(label) for _, _, label, c in items]).collect()
    for x in got:
        assert tuple(x)[1:] == tuple(sum(x["t"].count(k) for k in ks) for _, ks in kws)
    plan = E.detect_industries(df, "t", "i")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
