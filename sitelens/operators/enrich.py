"""Page enrichment: HTML / text -> platforms, industries, tags, colours.

All detectors are column expressions over the page row: one narrow stage, no
Python worker and no shuffle.  Tags are counted inside the row too.

Page text (``page_text``) is title + meta description + the first 14
paragraphs.  It is extracted with regular expressions after removing comments,
scripts and style blocks.  A paragraph starts at a ``<p>`` tag and ends at the
next ``<p>`` tag, ``</p>`` or the end of an enclosing block: unclosed
paragraphs are therefore flat (never nested), so no text is repeated.  All named
and numeric character references are decoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.dictionaries import (
    DEFAULT,
    FALLBACK_PLATFORM,
    MAX_INDUSTRIES,
    MAX_PARAGRAPHS,
    MAX_TAGS,
    MIN_CONFIDENCE,
    MIN_TAG_LENGTH,
    STYLE_TEXT_LIMIT,
    Dictionaries,
)
from sitelens.functions import clean_text, normalize_hex, py_round, py_split, strip_ws
from sitelens.functions.parse import as_of_col
from sitelens.functions.text import count_sub_sql, sql_str, unescape_html

# FIXED VALUES: markup patterns (valid in Java regex and RE2 alike).
COMMENT_RE = r"(?s)<!--.*?-->"
SCRIPT_RE = r"(?is)<script\b[^>]*>.*?</script\s*>"
STYLE_BLOCK_RE = r"(?is)<style\b[^>]*>.*?</style\s*>"
TITLE_RE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
META_RE = r"(?i)<meta\b[^>]*>"
P_OPEN_RE = r"(?i)<p(?:\s[^>]*)?/?>"
BLOCK_END_RE = (r"(?i)</(?:p|div|article|section|main|body|html|li|ul|ol|td|tr|table|form|"
                r"header|footer|nav|aside|blockquote|h[1-6])\s*>")
TAG_RE = r"<[^>]*>"
HEX_RE = r"#([0-9a-fA-F]{3}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})\b"
STYLE_ATTR_RE = r"""(?i)<[a-z][^>]*?\sstyle\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
STYLE_BODY_RE = r"(?is)<style\b[^>]*>(.*?)</style\s*>"
COLOR_META_NAME_RE = r"(?i)theme-color|msapplication-tilecolor"
P_START = "\x01"
P_STOP = "\x02"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def attr_value(tag: Column, name: str) -> Column:
    """Value of attribute ``name`` in one start tag ('' when absent), quotes removed."""
    raw = F.regexp_extract(tag, r"""(?i)\s""" + name + r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return unquote(raw)


def unquote(v: Column) -> Column:
    """Drop one pair of surrounding quotes from an attribute value."""
    quoted = v.startswith('"') | v.startswith("'")
    return F.when(quoted, F.regexp_replace(v, r"""^["']|["']$""", "")).otherwise(v)


def without_scripts(html) -> Column:
    """HTML with comments and script bodies removed (what a parser sees as markup)."""
    h = F.coalesce(_c(html), F.lit(""))
    return F.regexp_replace(F.regexp_replace(h, COMMENT_RE, ""), SCRIPT_RE, "")


# ---------------------------------------------------------------------------
# H1 page text
# ---------------------------------------------------------------------------

def with_page_text(df: DataFrame, html_col: str, out: str = "text", max_paragraphs: int = MAX_PARAGRAPHS) -> DataFrame:
    """Add ``out`` = ``page_text`` of ``html_col`` (markup-free HTML projected once)."""
    tmp = df.withColumn("_bare", F.regexp_replace(without_scripts(F.col(html_col)), STYLE_BLOCK_RE, ""))
    return tmp.withColumn(out, page_text(F.col("_bare"), bare=True, max_paragraphs=max_paragraphs)).drop("_bare")


def page_text(html, bare: bool = False, max_paragraphs: int = MAX_PARAGRAPHS) -> Column:
    """title + ' ' + meta description + ' ' + the first paragraphs (14 by the label rules; space-joined)."""
    h = _c(html) if bare else F.regexp_replace(without_scripts(html), STYLE_BLOCK_RE, "")
    title_raw = F.regexp_extract(h, TITLE_RE, 1)
    title = F.when(title_raw.contains("<"), F.lit("")).otherwise(strip_ws(unescape_html(title_raw)))
    metas = F.regexp_extract_all(h, F.lit(META_RE), 0)
    desc_tags = F.filter(metas, lambda m: attr_value(m, "name") == "description")
    desc = strip_ws(unescape_html(F.coalesce(attr_value(F.get(desc_tags, 0), "content"),
                                             F.lit(""))))
    marked = F.regexp_replace(F.regexp_replace(h, P_OPEN_RE, P_START), BLOCK_END_RE, P_STOP)
    paras = F.regexp_extract_all(marked, F.lit(P_START + "([^" + P_START + P_STOP + "]*)"), 1)
    paras = F.transform(F.slice(paras, 1, max_paragraphs), lambda p: F.regexp_replace(p, TAG_RE, ""))
    # a blank can't be part of a reference, so the joined paragraphs are decoded at once
    return F.concat_ws(" ", title, desc, unescape_html(F.array_join(paras, " ")))


# ---------------------------------------------------------------------------
# H2 platforms
# ---------------------------------------------------------------------------

def _platform_count_cols(low_col: str, dicts: Dictionaries) -> list:
    """One integer column per platform: how many of its signals occur.

    Each count is one SQL expression (one call to build, however many signals).
    """
    cols = []
    for o, (label, sigs) in enumerate(dicts.platforms):
        if not sigs:
            continue
        n = " + ".join(f"CAST(contains(`{low_col}`, {sql_str(sig.lower())}) AS INT)" for sig in sigs)
        cols.append((f"_pc{o}", o, label, F.expr(n)))
    return cols


def platforms_from_counts(h: Column, items: list) -> Column:
    """items: (column name, ord, label) of materialized signal counts."""
    arr = F.filter(F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(lab).alias("label"),
                                      F.col(c).alias("n")) for c, o, lab in items]),
                   lambda x: x["n"] > 0)
    total = F.aggregate(arr, F.lit(0), lambda a, x: a + x["n"])
    denom = F.greatest(F.lit(2.0), total.cast("double") * F.lit(0.4))
    scored = F.transform(arr, lambda x: F.struct(
        (-F.least(F.lit(1.0), x["n"].cast("double") / denom)).alias("neg"),
        x["ord"].alias("ord"), x["label"].alias("label")))
    kept = F.filter(F.sort_array(scored), lambda x: -x["neg"] >= MIN_CONFIDENCE)
    out = F.transform(kept, lambda x: F.struct(x["label"].alias("label"),
                                               (-x["neg"]).alias("confidence")))
    fallback = F.array(F.struct(F.lit(FALLBACK_PLATFORM[0]).alias("label"),
                                F.lit(FALLBACK_PLATFORM[1]).alias("confidence")))
    empty = F.array().cast("array<struct<label:string,confidence:double>>")
    any_hit = F.lit(False)
    for c, _, _ in items:
        any_hit = any_hit | (F.col(c) > 0)
    return (F.when(h.isNull() | (F.length(h) == 0), empty)
            .when(~any_hit, fallback)
            .otherwise(out))


def detect_platforms(df: DataFrame, html_col: str, out: str = "platforms_conf",
                     dicts: Dictionaries = DEFAULT) -> DataFrame:
    """Add ``out``: array<struct<label, confidence>>, confidence desc then dictionary order.

    Per platform: number of its signals found in the lower-cased HTML; confidence
    = min(1, n / max(2, 0.4 * total)); kept when >= 0.15.  No signal ->
    [(Custom, 0.5)]; empty or NULL HTML -> [].  The lower-cased page and the
    per-platform counts are projected as plain columns first, so the few
    higher-order steps at the end only read attributes.
    """
    low = df.withColumn("_low", F.lower(F.col(html_col)))
    items = _platform_count_cols("_low", dicts)
    counted = low.select("*", *[n.alias(c) for c, _, _, n in items])
    res = counted.withColumn(out, platforms_from_counts(F.col(html_col),
                                                        [(c, o, lab) for c, o, lab, _ in items]))
    return res.drop("_low", *[c for c, _, _, _ in items])


# ---------------------------------------------------------------------------
# H3 industries
# ---------------------------------------------------------------------------

def _overlaps_itself(word: str) -> bool:
    return any(word.startswith(word[-n:]) for n in range(1, len(word)))


def _one_of(words: set[str]) -> str:
    """Pattern of the longest of the words that begins at a place, as a tree of their letters."""
    ends, rest = "" in words, {}
    for w in words - {""}:
        rest.setdefault(w[0], set()).add(w[1:])
    letter = lambda c: c if c.isalnum() else "\\" + c
    ways = [letter(c) + _one_of(tails) for c, tails in sorted(rest.items())]
    if not ways:
        return ""
    return "(?:" + "|".join(ways) + ")" + ("?" if ends else "")


def _industry_count_cols(clean_col: str, found_col: str, dicts: Dictionaries) -> tuple[list, Column]:
    """One long column per industry with its summed keyword counts, and the keyword places they are counted in.

    One pass over the text notes at every place the longest keyword that begins there; the
    shorter keywords that begin at the same place are its prefixes.  A keyword that can't overlap itself occurs as often
    as it is noted; one that can, or is empty, is counted on its own.
    """
    labels = [(o, label, [k.lower() for k in kws]) for o, (label, kws) in enumerate(dicts.industries)]
    plain = {k for _, _, kws in labels for k in kws if k and not _overlaps_itself(k)}
    cols = []
    for o, label, kws in labels:
        weights: dict[int, list[str]] = {}
        for noted in sorted(plain):
            w = sum(noted.startswith(k) for k in kws if k in plain)
            if w:
                weights.setdefault(w, []).append(sql_str(noted))
        n = [f"{w} * size(filter({found_col}, lv_m -> lv_m IN ({', '.join(own)})))" for w, own in weights.items()]
        n += [f"({count_sub_sql(clean_col, k)})" for k in kws if k not in plain]
        cols.append((f"_ic{o}", o, label, F.expr(" + ".join(["CAST(0 AS BIGINT)", *n]))))
    places = F.regexp_extract_all(clean_col, F.lit(f"(?=({_one_of(plain)}))"), 1) if plain else F.array().cast("array<string>")
    return cols, places


def detect_industries(df: DataFrame, text_col: str, out: str = "industries_conf",
                      dicts: Dictionaries = DEFAULT, clean_col: str | None = None) -> DataFrame:
    """Add ``out``: array<struct<label, confidence>>, confidence = n / max n, >= 0.15, top 5.

    The cleaned text, its keyword places and the per-industry counts are projected as
    plain columns, so the text is searched once; the ranking then only reads the counts.
    """
    src = df if clean_col else df.withColumn("_clean", clean_text(F.col(text_col)))
    items, places = _industry_count_cols(clean_col or "_clean", "_places", dicts)
    counted = src.withColumn("_places", places).select("*", *[n.alias(c) for c, _, _, n in items])
    res = counted.withColumn(out, industries_from_counts(
        F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(lab).alias("label"), F.col(c).alias("n"))
                  for c, o, lab, _ in items])))
    drop = ["_places"] + [c for c, _, _, _ in items] + ([] if clean_col else ["_clean"])
    return res.drop(*drop)


def industries_from_counts(counts: Column) -> Column:
    """Ranked labels from array<struct<ord, label, n>> of materialized counts."""
    arr = F.filter(counts, lambda x: x["n"] > 0)
    mx = F.array_max(F.transform(arr, lambda x: x["n"]))
    scored = F.transform(arr, lambda x: F.struct(
        (-F.least(F.lit(1.0), x["n"].cast("double") / F.greatest(F.lit(1.0), mx.cast("double"))))
        .alias("neg"), x["ord"].alias("ord"), x["label"].alias("label")))
    kept = F.filter(F.sort_array(scored), lambda x: -x["neg"] >= MIN_CONFIDENCE)
    out = F.transform(F.slice(kept, 1, MAX_INDUSTRIES),
                      lambda x: F.struct(x["label"].alias("label"), (-x["neg"]).alias("confidence")))
    return F.when(F.size(arr) == 0,
                  F.array().cast("array<struct<label:string,confidence:double>>")).otherwise(out)


# ---------------------------------------------------------------------------
# H4 tags
# ---------------------------------------------------------------------------

def with_top_words(df: DataFrame, clean_col: str, out: str, k: int, dicts: Dictionaries) -> DataFrame:
    """Add ``out``: the k most frequent words of a cleaned text, array<struct<neg, pos, word>>.

    Words: split on whitespace, length >= 4, not a stopword.  Order: frequency
    desc (``neg`` is its negative), then first occurrence.  A word never leaves
    its row: the words are sorted with their places, equal ones then stand
    together, and the gap between run starts is the frequency.
    """
    stop = ", ".join(sql_str(w) for w in dicts.stopwords)
    kept = f"length(lv_x.w) >= {MIN_TAG_LENGTH}" + (f" AND lv_x.w NOT IN ({stop})" if stop else "")
    tmp = df.withColumn("_words", py_split(F.col(clean_col)))
    tmp = tmp.withColumn("_sorted", F.expr(f"sort_array(filter(transform(_words, (lv_w, lv_i) -> struct(lv_w AS w, lv_i AS i)), lv_x -> {kept}))"))
    tmp = tmp.withColumn("_starts", F.expr("if(size(_sorted) > 0, filter(sequence(0, size(_sorted) - 1), lv_i -> lv_i = 0 OR _sorted[lv_i].w <> _sorted[lv_i - 1].w), array())"))
    runs = ("transform(_starts, (lv_s, lv_j) -> struct(lv_s - coalesce(get(_starts, lv_j + 1), size(_sorted)) AS neg, "
            "_sorted[lv_s].i AS pos, _sorted[lv_s].w AS word))")
    tmp = tmp.withColumn(out, F.expr(f"slice(sort_array({runs}), 1, {k})"))
    return tmp.drop("_words", "_sorted", "_starts")


def tag_confidence(neg: Column, top_neg: Column) -> Column:
    """round(min(1, 0.2 + 0.8 * f / fmax), 2), rounded exactly as Python does."""
    share = neg.cast("double") / top_neg.cast("double")
    return py_round(F.least(F.lit(1.0), F.lit(0.2) + F.lit(0.8) * share), 2)


def extract_tags(df: DataFrame, id_col: str, text_col: str, k: int = MAX_TAGS,
                 dicts: Dictionaries = DEFAULT) -> DataFrame:
    """(id, rank, tag, freq, confidence): top-k words per row, in one narrow stage (``with_top_words``)."""
    rows = df.select(F.col(id_col), clean_text(F.col(text_col)).alias("_clean"))
    rows = with_top_words(rows, "_clean", "_top", k, dicts)
    # the outer form lets no size(_top) > 0 be pushed below the steps of _top, where it would repeat the sort for each word
    top = rows.select(id_col, F.get("_top", F.lit(0))["neg"].alias("_fmax"), F.posexplode_outer("_top").alias("_at", "_t"))
    return top.filter("_at is not null").select(F.col(id_col), (F.col("_at") + 1).cast("long").alias("rank"), F.col("_t.word").alias("tag"),
                      (-F.col("_t.neg")).cast("long").alias("freq"),
                      tag_confidence(F.col("_t.neg"), F.col("_fmax")).alias("confidence"))


def pack_tags(tags: DataFrame, id_col: str) -> DataFrame:
    """(id, tag_confidence map, tags display string) from ``extract_tags`` rows."""
    g = tags.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct("rank", "tag", "confidence"))).alias("_t"))
    return g.select(
        F.col(id_col),
        F.map_from_entries(F.transform("_t", lambda x: F.struct(x["tag"], x["confidence"])))
        .alias("tag_confidence"),
        F.array_join(F.transform("_t", lambda x: x["tag"]), ", ").alias("tags"))


# ---------------------------------------------------------------------------
# H5 colours
# ---------------------------------------------------------------------------

def with_colors(df: DataFrame, html_col: str, out: str = "colors", style_limit: int = STYLE_TEXT_LIMIT) -> DataFrame:
    """Add ``out`` = ``extract_colors`` of ``html_col`` (script-free HTML projected once)."""
    tmp = df.withColumn("_nos", without_scripts(F.col(html_col)))
    return tmp.withColumn(out, extract_colors(F.col("_nos"), bare=True, style_limit=style_limit)).drop("_nos")


def extract_colors(html, bare: bool = False, style_limit: int = STYLE_TEXT_LIMIT) -> Column:
    """struct<primary, secondary>: first two distinct normalised hex colours.

    Order: first hex of each theme-color / msapplication-TileColor meta, then
    style attributes, then style blocks (those two cut at ``style_limit``
    characters, 50,000 by the label rules).
    """
    h = _c(html) if bare else without_scripts(html)
    metas = F.filter(F.regexp_extract_all(h, F.lit(META_RE), 0),
                     lambda m: F.regexp_like(attr_value(m, "name"), F.lit(COLOR_META_NAME_RE)))
    meta_hex = F.filter(F.transform(metas, lambda m: F.regexp_extract(attr_value(m, "content"),
                                                                      HEX_RE, 1)),
                        lambda x: F.length(x) > 0)
    attrs = F.transform(F.regexp_extract_all(h, F.lit(STYLE_ATTR_RE), 1), unquote)
    blocks = F.regexp_extract_all(h, F.lit(STYLE_BODY_RE), 1)
    parts = F.concat(attrs, blocks)
    style_text = F.aggregate(parts, F.lit(""), lambda a, x: F.concat(a, F.lit(" "), x))
    cut = F.substring(style_text, 1, style_limit)
    style_hex = F.regexp_extract_all(cut, F.lit(HEX_RE), 1)
    allhex = F.array_distinct(F.transform(F.concat(meta_hex, style_hex),
                                          lambda x: normalize_hex(F.concat(F.lit("#"), x))))
    return F.struct(F.get(allhex, 0).alias("primary"), F.get(allhex, 1).alias("secondary"))


# ---------------------------------------------------------------------------
# H6 / H7 full records
# ---------------------------------------------------------------------------

def display_labels(arr: Column) -> Column:
    """First three labels joined by ', ', or 'Unknown'."""
    labels = F.transform(arr, lambda x: x["label"])
    return F.when(F.size(labels) > 0, F.array_join(F.slice(labels, 1, 3), ", ")) \
        .otherwise(F.lit("Unknown"))


def enrich_pages(pages: DataFrame, dicts: Dictionaries = DEFAULT, as_of=None,
                 key: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Enrichment record per page, in one pass over the HTML.

    Output: key, website_url, platform, industry, tags, platforms, industries,
    colors, tag_confidence, enrichment_signals, last_enriched_at.

    Plan: one narrow stage, no shuffle: every page is parsed once, and its words
    are counted inside its row (``with_top_words``).
    """
    base = with_page_text(pages.select(F.col(key), F.col(url_col).alias("website_url"), F.col(html_col).alias("_h")), "_h", "_text")
    base = base.withColumn("_clean", clean_text(F.col("_text")))
    lab = detect_platforms(base, "_h", "_p", dicts)
    lab = detect_industries(lab, "_text", "_i", dicts, clean_col="_clean")
    lab = with_colors(lab, "_h", "colors")
    lab = with_top_words(lab, "_clean", "_top", MAX_TAGS, dicts)
    top_neg = F.get("_top", F.lit(0))["neg"]
    packed = lab.withColumn("_t", F.transform("_top", lambda x: F.struct(
        x["word"].alias("tag"), tag_confidence(x["neg"], top_neg).alias("confidence"))))
    to_map = (lambda c: F.map_from_entries(F.transform(c, lambda x: F.struct(x["label"],
                                                                              x["confidence"]))))
    p, i = F.col("_p"), F.col("_i")
    return packed.select(
        F.col(key), "website_url",
        display_labels(p).alias("platform"),
        display_labels(i).alias("industry"),
        F.array_join(F.transform("_t", lambda x: x["tag"]), ", ").alias("tags"),
        F.transform(p, lambda x: x["label"]).alias("platforms"),
        F.transform(i, lambda x: x["label"]).alias("industries"),
        "colors",
        F.map_from_entries(F.transform("_t", lambda x: F.struct(x["tag"], x["confidence"])))
        .alias("tag_confidence"),
        F.struct(to_map(p).alias("platform_scores"), to_map(i).alias("industry_scores"),
                 F.col("colors").alias("colors")).alias("enrichment_signals"),
        as_of_col(as_of).alias("last_enriched_at"))
