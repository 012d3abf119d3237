"""URL filters with redirect equivalence, in DataFrame operations only.

*Rules.*  A rule is (verdict, host, path).  It fits a URL whose host is the rule's or a
subdomain of it and whose path starts with the rule's; of the rules that fit, the one
with the longest text host + path decides, of equally long ones an allow.  Rules are a list
given by the caller, and the plan holds one condition for each: meant for policies, not for tables of URLs.

*Equivalence.*  A page that no rule fits may be another name of one that is blocked.  Edges join a page's
address to the target of its canonical link and of its refresh redirect, and to the targets of an optional
table of HTTP redirects.  Components of equal addresses are found by distributed connected
components (large-star and small-star steps on written tables).  A component is blocked if a rule blocks
any address in it, crawled or not.  A page that no rule fits gets block from a blocked component, else
allow.  An explicit allow wins: a page that an allow rule fits stays allowed in a blocked component.

An address is a URL without its fragment, with scheme and host in lower case and a path of at least ``/``.
Only addresses with edges travel through the components, as 16-byte hashes; a hub that a third of all pages
point to is met by grouped minima and joins that can be split.  The join that brings the blocked addresses back to
the pages has one row for each address on its right side and leaves out pages that a rule decides, pages without an
address, and hence the rows that could share a hot NULL key.

Edge cases: a NULL URL, or one without ``://``, has an empty host and path, no address, no rule and the verdict allow;
relative links are resolved against the page's URL (``<base>`` isn't read), links of other schemes (``mailto:``) and links to the page itself
are no edges; NULL or empty HTML has no links; repeated pages (equal ids or URLs) are judged each; an empty
table gives an empty result; extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import unescape_html
from sitelens.llm.common import staged
from sitelens.llm.components import connected
from sitelens.operators.enrich import META_RE, attr_value, without_scripts

LINK_RE = r"(?i)<link\b[^>]*>"
REFRESH_RE = r"""(?i)^[\s\d.]*[;,]?\s*url\s*=\s*["']?\s*([^"'\s]+)"""
SCHEME_RE = r"^[a-zA-Z][a-zA-Z0-9+.-]*:"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def lower_ascii(c: Column) -> Column:
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; NULL without one."""
    return F.when(url.contains("://"), F.substr(url, F.locate("://", url) + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``rule`` (host + path of the longest rule that fits ``host`` and ``path``) and its ``rule_verdict``; NULL where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.verdict == "allow")):  # the last one tested first
        fits = ((F.col("host") == r.host.lower()) | F.col("host").endswith("." + r.host.lower())) & F.col("path").startswith(r.path)
        text, verdict = F.when(fits, r.host.lower() + r.path).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return df.withColumn("rule", text).withColumn("rule_verdict", verdict)


def without_dots(path: Column) -> Column:
    """A path whose ``.`` and ``..`` segments are resolved; one that ends in such a segment keeps its last slash."""
    parts = F.split(F.regexp_replace(path, r"(/\.\.?)$", "$1/"), "/")

    def step(done, part):
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))  # the empty first part stays
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    return F.when(path.contains("/."), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")).otherwise(path)


def addresses(df: DataFrame, url: str, out: str) -> DataFrame:
    """Add ``out``: the name of what a URL points at; NULL without ``://``.  Step by step, so that no expression is copied into another."""
    u = F.col(url)
    cut = df.withColumn("_path", path_of(u)).withColumn("_path", without_dots(F.col("_path"))).withColumn("_path", F.when(F.col("_path") == "", "/").otherwise(F.col("_path")))
    query = F.regexp_extract(after_scheme(u), r"^[^?#]*(\?[^#]*)?", 1)
    return cut.withColumn(out, F.concat(lower_ascii(F.trim(F.substring_index(u, "://", 1))), F.lit("://"), host_of(u), F.col("_path"), query)).drop("_path")


def resolved(df: DataFrame, link: str, url: str, out: str) -> DataFrame:
    """Add ``out``: the absolute form of a link found on the page ``url``; NULL for other schemes and for the page itself."""
    t, u = F.col(link), F.col(url)
    cut = df.withColumn("_path", path_of(u)).withColumn("_site", F.concat(F.substring_index(u, "://", 1), F.lit("://"), F.regexp_extract(after_scheme(u), "^[^/?#]*", 0)))
    cut = cut.withColumn("_folder", F.when(F.col("_path") == "", "/").otherwise(F.regexp_extract("_path", "^(.*/)", 1)))
    full = (F.when(~u.contains("://") | (t == "") | t.startswith("#"), None)
            .when(F.regexp_like(t, F.lit(SCHEME_RE + "//")), t)
            .when(F.regexp_like(t, F.lit(SCHEME_RE)), None)
            .when(t.startswith("//"), F.concat(F.substring_index(u, "://", 1), F.lit(":"), t))
            .when(t.startswith("/"), F.concat("_site", t))
            .when(t.startswith("?"), F.concat("_site", "_path", t))
            .otherwise(F.concat("_site", "_folder", t)))
    return cut.withColumn(out, full).drop("_path", "_site", "_folder")


def links(pages: DataFrame) -> DataFrame:
    """(from_url, to_url): canonical links and refresh redirects of the pages."""
    told = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).filter("html ilike '%canonical%' or html ilike '%http-equiv%'")
    told = told.withColumn("html", without_scripts("html"))
    canonical = F.filter(F.regexp_extract_all("html", F.lit(LINK_RE), 0), lambda t: F.array_contains(F.split(F.lower(attr_value(t, "rel")), r"\s+"), "canonical"))
    refresh = F.filter(F.regexp_extract_all("html", F.lit(META_RE), 0), lambda t: F.lower(F.trim(attr_value(t, "http-equiv"))) == "refresh")
    found = F.concat(F.transform(canonical, lambda t: attr_value(t, "href")), F.transform(refresh, lambda t: F.regexp_extract(attr_value(t, "content"), REFRESH_RE, 1)))
    one = told.withColumn("found", found).select("url", F.explode_outer("found").alias("raw"))
    one = staged(one, "url-links").filter("raw <> ''").withColumn("link", F.trim(unescape_html(F.col("raw"))))  # written: no filter goes below the parsing
    return resolved(one, "link", "url", "to_url").select(F.col("url").alias("from_url"), "to_url")


def blocked_addresses(edges: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(key): hashes of the addresses whose component holds an address that a rule blocks.  ``edges``: (from_url, to_url)."""
    named = addresses(addresses(edges, "from_url", "a_text"), "to_url", "b_text").select("a_text", "b_text", key("a_text").alias("a"), key("b_text").alias("b"))
    pairs = staged(named, "url-edges").filter("a <> b")
    part = connected(pairs.select("a", "b")).withColumnRenamed("doc_id", "key")
    ends = pairs.select(F.col("a_text").alias("text"), F.col("a").alias("key")).unionByName(pairs.select(F.col("b_text").alias("text"), F.col("b").alias("key"))).distinct()
    bad = with_rule(ends.select("key", host_of(F.col("text")).alias("host"), path_of(F.col("text")).alias("path")), rules).filter("rule_verdict = 'block'").select("key")
    worst = part.join(bad, "key", "left_semi").select("component").distinct()
    return part.join(worst, "component", "left_semi").select("key")


def key(c: str) -> Column:
    return F.substring(F.unhex(F.sha2(F.col(c), 256)), 1, 16)


def judge(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page (page_id, url, html); ``redirects`` holds more (from_url, to_url) edges."""
    url = F.col("url").cast("string")
    rows = with_rule(pages.select("page_id", url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path")), rules)
    edges = links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("from_url", "to_url"))
    blocked = blocked_addresses(edges, rules).withColumn("bad", F.lit("block"))
    out = ["page_id", "host", "path", "rule", "verdict"]
    open_ = F.col("rule").isNull() & F.col("url").contains("://")
    decided = rows.filter(~F.coalesce(open_, F.lit(False))).withColumn("verdict", F.coalesce("rule_verdict", F.lit("allow")))
    asked = addresses(rows.filter(open_), "url", "address").withColumn("key", key("address"))
    asked = asked.join(blocked, "key", "left").withColumn("verdict", F.coalesce("bad", F.lit("allow")))
    return decided.select(*out).unionByName(asked.select(*out))
