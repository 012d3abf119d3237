"""Scalar functions: hand goldens and properties."""

import datetime as dt
import urllib.parse

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitelens import functions as SF


def one(spark, col, value, ddl="v string"):
    return spark.createDataFrame([(value,)], ddl).select(col.alias("r")).first()["r"]


def test_validate_url(spark):
    long_url = "https://" + "a" * 2041
    cases = [("", "URL is empty"), ("   ", "URL is empty"), (None, "URL is empty"),
             ("ftp://x", "URL must start with http:// or https://"),
             ("HTTP://x", "URL must start with http:// or https://"),
             (long_url, "URL is too long (max 2048 chars)"), ("https://ok.example", None),
             ("  http://ok.example  ", None)]
    df = spark.createDataFrame([(c,) for c, _ in cases], "v string")
    got = [r["e"] for r in df.select(SF.validate_url("v").alias("e")).collect()]
    assert got == [e for _, e in cases]


def test_normalize_url(spark):
    df = spark.createDataFrame([(" example.com ",), ("http://a.b",), ("https://c.d",)], "v string")
    got = [r["u"] for r in df.select(SF.normalize_url("v").alias("u")).collect()]
    assert got == ["https://example.com", "http://a.b", "https://c.d"]


def test_url_parts(spark):
    rows = [("https://user@Host.example:8080/a/b;p?q=1#f",), ("example.com/path",), ("//x.org/p",)]
    df = spark.createDataFrame(rows, "v string").select(SF.norm("v").alias("n"))
    got = df.select(SF.url_host(F.col("n")).alias("h"), SF.url_path(F.col("n")).alias("p")).collect()
    for (url,), r in zip(rows, got):
        u = url.strip().lower()
        if "://" in u:
            parsed = urllib.parse.urlparse(u)
            assert (r["h"], r["p"]) == (parsed.netloc, parsed.path)
        else:
            assert (r["h"], r["p"]) == (u, "")


def test_normalize_hex(spark):
    cases = {"#FFF": "#ffffff", "#0070F3": "#0070f3", "#7928caff": "#7928ca", "#abcd": "#abcd"}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = [r["h"] for r in df.select(SF.normalize_hex("v").alias("h")).collect()]
    assert got == list(cases.values())


def test_quote_matches_python(spark):
    vals = ["red widget", "a/b c", "x*y~z", "é+ü", "100%"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r["q"] for r in df.select(SF.quote("v").alias("q")).collect()]
    assert got == [urllib.parse.quote(v) for v in vals]


def test_client_key(spark):
    rows = [(" 1.2.3.4, 5.6.7.8", "9.9.9.9"), (None, "9.9.9.9"), ("", "9.9.9.9"), (None, None)]
    df = spark.createDataFrame(rows, "f string, p string")
    got = [r["k"] for r in df.select(SF.client_key("f", "p").alias("k")).collect()]
    assert got == ["1.2.3.4", "9.9.9.9", "9.9.9.9", "unknown"]


def test_icon_key(spark):
    rows = [("WordPress",), ("  shopify ",), (None,), ("",), ("Next.js",), ("CUSTOM",)]
    df = spark.createDataFrame(rows, "p string")
    got = [r["i"] for r in df.select(SF.icon_key("p").alias("i")).collect()]
    assert got == ["layout", "shopping-bag", "help-circle", "help-circle", "help-circle", "wrench"]


def test_tag_tokens_and_norm(spark):
    assert one(spark, SF.tag_tokens(F.col("v")), " Pricing , ,SaaS,") == ["pricing", "saas"]
    assert one(spark, SF.norm(F.col("v")), "\t Hello ") == "hello"
    assert one(spark, SF.norm(F.col("v")), None) == ""


def test_count_sub(spark):
    assert one(spark, SF.count_sub(F.col("v"), "aa"), "aaaaa") == 2
    assert one(spark, SF.count_sub(F.col("v"), "it "), "it is it it") == 2
    assert one(spark, SF.count_sub(F.col("v"), "zz"), "abc") == 0


def test_days_between(spark):
    base = dt.datetime(2002, 1, 1)
    rows = [(base, base - dt.timedelta(days=29, hours=23)), (base, base - dt.timedelta(days=30)),
            (base, base + dt.timedelta(days=9, hours=12))]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    got = [r["d"] for r in df.select(SF.days_between(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [(a - b).days for a, b in rows]


@settings(max_examples=1, deadline=None)
@given(st.just(0))
def test_py_round_matches_python(spark, _):
    pairs = [(f, m) for m in range(1, 121) for f in range(1, m + 1)]
    df = spark.createDataFrame(pairs, "f long, m long")
    x = F.least(F.lit(1.0), F.lit(0.2) + F.lit(0.8) * (F.col("f").cast("double") / F.col("m").cast("double")))
    got = df.select("f", "m", SF.py_round(x, 2).alias("r")).collect()
    for r in got:
        assert r["r"] == round(min(1.0, 0.2 + 0.8 * (r["f"] / r["m"])), 2), (r["f"], r["m"])


def test_parse_ts_and_json(spark):
    rows = [("2001-12-01T10:00:00Z", '["a","b"]', '{"k": 1.5}'),
            ("2001-12-01T12:00:00+02:00", "[]", "{"),
            ("not-a-time", "[bad", "")]
    df = spark.createDataFrame(rows, "t string, a string, m string")
    got = df.select(SF.parse_ts("t").alias("t"), SF.decode_json_array("a").alias("a"),
                    SF.decode_json_map("m").alias("m")).collect()
    assert got[0]["t"] == dt.datetime(2001, 12, 1, 10) and got[1]["t"] == dt.datetime(2001, 12, 1, 10)
    assert got[2]["t"] is None
    assert got[0]["a"] == ["a", "b"] and got[1]["a"] is None and got[2]["a"] is None
    assert got[0]["m"] == {"k": 1.5} and got[1]["m"] is None and got[2]["m"] is None


def test_time_handling_ignores_session_zone(spark):
    rows = [("2001-12-01T10:00:00Z",), ("2001-12-01T12:00:00+02:00",), ("2024-01-05",),
            ("2024-01-05 07:08:09",), ("bad",)]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        df = spark.createDataFrame(rows, "t string")
        got = [r["p"] for r in df.select(SF.parse_ts("t").alias("p")).collect()]
        lit = spark.range(1).select(SF.ntz_lit(dt.datetime(2002, 1, 1, 3, 4, 5)).alias("x")).first()["x"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [dt.datetime(2001, 12, 1, 10), dt.datetime(2001, 12, 1, 10), dt.datetime(2024, 1, 5),
                   dt.datetime(2024, 1, 5, 7, 8, 9), None]
    assert lit == dt.datetime(2002, 1, 1, 3, 4, 5)


def test_py_round_of_large_ties(spark):
    ks = list(range(0, 3000)) + [10_000, 99_999, 123_456, 199_999]
    for nd in (1, 2):
        xs = [float(f"{(2 * k + 1) / 2:.1f}e-{nd}") for k in ks] + [k / 7 for k in ks]
        df = spark.createDataFrame([(x,) for x in xs], "x double")
        got = df.select("x", SF.py_round(F.col("x"), nd).alias("r")).collect()
        assert all(r["r"] == round(r["x"], nd) for r in got)


def test_all_character_references(spark):
    import html
    from html.entities import html5

    from sitelens.functions.text import unescape_html
    texts = ["caf&eacute; &#233; &#8212; &#x1F600; &#128; &#0; &#xD800; &#9999999; & && &; a&b &nope; &amp;amp; &ampx &notit; &copy 2 &#65 x", "none", "", "&", "&lt;p&gt;"]
    texts += [f"x&{name} y" for name in html5 if name.endswith(";")] + [f"&#{n};" for n in (*range(9, 11), *range(32, 127), *range(128, 700))]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {r["t"]: r["u"] for r in df.select("t", unescape_html(F.col("t")).alias("u")).collect()}
    assert got.pop(None) is None
    assert {t: u for t, u in got.items() if u != html.unescape(t)} == {}
