"""URL filters: rules, links, and decisions that reach aliases, against a plain Python twin."""

import random
from urllib.parse import urljoin, urlsplit

from sitelens.llm import url_filter as U
from sitelens.llm.queries import RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    stop = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:stop]


def rule_of(host, path):
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.host + r.path), default=None)


def name(url):
    x = urlsplit(url)
    return f"{x.scheme.lower()}://{x.netloc.lower()}{x.path or '/'}" + (f"?{x.query}" if x.query else "")


def twin(pages, targets, redirects=()):
    """Verdicts by union-find over (url, target) edges."""
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in [(u, urljoin(u, t)) for i, u, _ in pages for t in targets.get(i, [])] + list(redirects):
        up[root(name(a))] = root(name(b))
    bad = {root(v) for v in list(up) if (r := rule_of(*parts(v))) and r.verdict == "block"}
    out = []
    for i, url, _ in pages:
        host, path = parts(url)
        r = rule_of(host, path)
        alias = url is not None and "://" in url and name(url) in up and root(name(url)) in bad
        out.append((i, host, path, r and r.host + r.path, r.verdict if r else "block" if alias else "allow"))
    return sorted(out, key=repr)


def frame(spark, pages):
    return spark.createDataFrame([(*p, "x", "x", "x") for p in pages], "page_id long, url string, html string, host string, rule string, key string").repartition(3)


def judged(spark, pages, **more):
    return sorted((tuple(r) for r in U.judge(frame(spark, pages), RULES, **more).collect()), key=repr)


def test_rules_and_unusual_urls(spark):
    urls = ["http://a.com/en/1", "HTTP://EXAMPLE.COM/en/x?y#z", "http://www.example.com/en/", "http://m.www.example.com/en/1", "http://example.com/EN/", "http://b.net/es/1", "http://net/fr/", "http://bnet/fr/",
            "http://b.net/fr", "http://a.com", "http://a.com?x=/en/", "http://a.com#/x", "no scheme", "", None, "://net/es/", "x://y://net/es/", "http://İ.net/es/é", "http://a.org/" + "p" * 100_000, "http://a.com/en/1"]
    pages = [(i, u, None) for i, u in enumerate(urls)] + [(None, "http://b.net/es/2", ""), (3, None, "<p>")]
    assert judged(spark, pages) == twin(pages, {})
    assert judged(spark, []) == []


def test_blocks_reach_aliases_but_not_explicit_allows(spark):
    canon = lambda t: f"<html><head><LINK href='{t}' rel=\"alternate Canonical\"></head>"
    refresh = lambda t: f'<meta content="0; URL={t}" http-equiv=refresh>'
    pages, targets = [], {}

    def page(i, url, *found, html=None):
        pages.append((i, url, html if html is not None else "".join(found)))

    for k in range(12):  # a chain of redirects that ends in a blocked page nobody crawled
        page(k, f"http://a.org/{k}", refresh(f"/{k + 1}" if k < 11 else "https://X.net/es/end#top"))
        targets[k] = [f"/{k + 1}" if k < 11 else "https://X.net/es/end"]
    page(40, "http://c.com/one", canon("http://a.org/7"))  # explicit allow
    targets[40] = ["http://a.org/7"]
    for k in range(50, 90):  # a hub that isn't blocked
        page(k, f"http://d.org/x/{k}?q={k}", canon("../hub/./h?a=1&amp;b=2"))
        targets[k] = ["../hub/./h?a=1&b=2"]
    page(91, "http://e.org/a", canon("//net/fr/1"))
    page(92, "http://e.org/b/c", canon("d"), refresh("?z"))
    page(93, "http://e.org/b/d", canon("mailto:x@net/es/"), canon("#top"), canon(""))
    page(94, "http://e.org/b/c#frag")  # the address of 92
    targets |= {91: ["//net/fr/1"], 92: ["d", "?z"], 93: []}
    page(95, "http://f.org/", html="<!-- " + canon("http://net/es/") + " --><script>" + canon("http://net/es/") + "</script>")
    page(96, None, canon("http://net/es/"))
    page(97, "http://a.org/3", "")  # a repeated URL
    page(50, "http://d.org/x/50?q=50", "")  # a repeated id
    random.Random(0).shuffle(pages)
    assert judged(spark, pages) == twin([p for p in pages if p[0] != 50] + [(50, "http://d.org/x/50?q=50", "")] * 2, targets)
    assert [r[-1] for r in judged(spark, pages) if r[0] in (0, 11, 40, 55, 91, 94, 95, 96)] == ["block", "block", "allow", "allow", "block", "allow", "allow", "allow"]


def test_redirect_table_joins_components(spark):
    pages = [(1, "http://a.org/1", ""), (2, "http://b.org/2", ""), (3, "http://c.org/3", "")]
    moved = [("http://a.org/1", "http://b.org/2"), ("http://b.org/2", "http://net/es/x"), ("http://c.org/3", "http://c.org/3#self"), (None, "http://c.org/3")]
    found = judged(spark, pages, redirects=spark.createDataFrame(moved, "from_url string, to_url string"))
    assert [r[-1] for r in found] == ["block", "block", "allow"] and found == twin(pages, {}, moved[:2])


def test_no_python_in_the_plan(spark, sf_small):
    plan = U.judge(spark.read.parquet(f"{sf_small}/pages.parquet"), RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
