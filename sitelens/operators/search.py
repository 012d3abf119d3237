"""Ranked catalog search: one query, or a whole table of queries.

Semantics (per query):

* terms = tokens of the normalised query on ``[^a-z0-9]+``, deduplicated, plus
  the synonyms of each token (one level); terms are sorted so the float sum is
  always taken in the same order.
* direct candidates: a term occurs (case-insensitively) in the URL, platform,
  industry or tag string.  Only when a query has **no** direct candidate, the
  typo fallback keeps sites whose host, platform or industry is within edit
  distance 2 (and 6 characters of length) of the whole normalised query.
* score: per term +5 host, +4 path, +4.5 platform, +4 industry; per matching tag
  +2.5*(1+min(conf,1)); +1 per field at edit distance exactly 1; then the
  recency and heat multipliers.  Rows scoring 0 are dropped; ties go by id.

Plans: a single query is a filter + projection with its terms unrolled as plain
expressions (no join, no Python).  Many queries meet the catalog in equi-joins on
short pieces of text (direct matches) and on segments of values (typos), never with
the catalog in a broadcast: the sizes of its files say little about its rows.  The
top-k per query is taken with ``row_number`` so Spark applies a partial group
limit before the shuffle, which keeps a query that matches everything from
skewing a task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.dictionaries import DEFAULT, Dictionaries
from sitelens.functions import (as_of_col, fuzzy_host, norm, tag_tokens, url_host,
                                url_path)
from sitelens.functions.text import sql_str
from sitelens.operators.layout import global_positions

PAGE_SIZE = 10
TYPOS = 2  # edits that the typo fallback allows
SPREAD = 16  # parts that the sites of one term are dealt into


# ---------------------------------------------------------------------------
# terms
# ---------------------------------------------------------------------------

def expand_terms(q: str | None, dicts: Dictionaries = DEFAULT) -> list[str]:
    """Search terms of one query string (a driver-side parameter)."""
    qn = (q or "").strip().lower()
    if not qn:
        return []
    tokens = [t for t in re.split(r"[^a-z0-9]+", qn) if t]
    syn = dicts.synonym_map()
    terms = set(tokens)
    for t in tokens:
        terms.update(s.lower() for s in syn.get(t, []))
    return sorted(terms)


def expand_terms_col(q: Column, dicts: Dictionaries = DEFAULT) -> Column:
    """Search terms of a query column, as a sorted array."""
    tokens = F.filter(F.split(norm(q), "[^a-z0-9]+"), lambda t: F.length(t) > 0)
    pairs = []
    for k, v in dicts.synonyms:
        pairs += [F.lit(k), F.array(*[F.lit(s.lower()) for s in v])]
    syn_map = F.create_map(*pairs)
    extra = F.flatten(F.transform(
        tokens, lambda t: F.coalesce(F.try_element_at(syn_map, t), F.array().cast("array<string>"))))
    return F.array_sort(F.array_distinct(F.concat(tokens, extra)))


# ---------------------------------------------------------------------------
# score
# ---------------------------------------------------------------------------

def _prepare(sites: DataFrame) -> DataFrame:
    """Add the normalised fields the score reads (computed once per site), in one
    projection."""
    url_n = norm("website_url")
    return sites.select(
        "*",
        norm("platform").alias("_plat_n"), norm("industry").alias("_ind_n"),
        url_host(url_n).alias("_host"), url_path(url_n).alias("_path"),
        tag_tokens("tags").alias("_tags"), F.lower("tags").alias("_tags_l"),
        F.lower("website_url").alias("_url_l"), fuzzy_host("website_url").alias("_fhost"))


# ---------------------------------------------------------------------------
# The score is generated as Spark SQL text: one expression per plan instead of
# hundreds of Column calls.  ``t`` below is a SQL term -- a quoted literal for
# a single query, a lambda variable for a table of queries.  Additions happen in
# the rule's order, so doubles are identical for either form.
# ---------------------------------------------------------------------------

def _add_sql(acc: str, cond: str, value: float) -> str:
    return f"({acc} + CASE WHEN {cond} THEN {value!r}D ELSE 0.0D END)"


def _term_sql(acc: str, t: str, depth: int = 0) -> str:
    """Running score after one term."""
    a, tag = f"lv_a{depth}", f"lv_tag{depth}"
    acc = _add_sql(acc, f"contains(_host, {t})", 5.0)
    acc = _add_sql(acc, f"contains(_path, {t})", 4.0)
    acc = _add_sql(acc, f"contains(_plat_n, {t})", 4.5)
    acc = _add_sql(acc, f"contains(_ind_n, {t})", 4.0)
    matched = (f"(contains({tag}, {t}) OR contains({t}, {tag}) OR "
               f"(abs(length({t}) - length({tag})) <= 2 AND levenshtein({t}, {tag}, 1) >= 0))")
    conf = f"coalesce(try_element_at(tag_confidence, {tag}), 0.0D)"
    acc = (f"aggregate(_tags, {acc}, ({a}, {tag}) -> {a} + CASE WHEN {matched} "
           f"THEN 2.5D * (1.0D + least({conf}, 1.0D)) ELSE 0.0D END)")
    for field in ("_plat_n", "_ind_n"):
        near = (f"(length({field}) > 0 AND length({t}) <= 12 AND "
                f"abs(length({t}) - length({field})) <= 6 AND levenshtein({t}, {field}, 1) = 1)")
        acc = _add_sql(acc, near, 1.0)
    return acc


def _multipliers_sql(score: str) -> str:
    """Recency and heat multipliers; ``_as_of`` is a column of the frame."""
    micros = "timestampdiff(MICROSECOND, last_used_at, _as_of)"
    days = f"CAST((({micros}) - pmod({micros}, 86400000000L)) div 86400000000L AS DOUBLE)"
    recency = f"CASE WHEN last_used_at IS NOT NULL THEN 1.0D + greatest(0.0D, -0.0001D * {days}) ELSE 1.0D END"
    boost = "least(0.05D, 0.01D * (heat_score / 10.0D))"
    heat = f"CASE WHEN heat_score IS NOT NULL AND heat_score <> 0 THEN 1.0D + {boost} ELSE 1.0D END"
    return f"({score}) * ({recency}) * ({heat})"  # times 1 changes no double, and the score stands in the plan once


def score_terms(terms: list[str]) -> Column:
    """Score for a fixed list of terms (unrolled; no loop over terms at run time).

    Reads the prepared columns and ``_as_of``.
    """
    acc = "0.0D"
    for t in terms:
        acc = _term_sql(acc, sql_str(t))
    return F.expr(_multipliers_sql(acc))


def score_terms_col(terms_col: str = "_terms") -> Column:
    """Score for a per-row array of terms (a table of queries)."""
    body = _term_sql("lv_acc", "lv_t", depth=1)
    return F.expr(_multipliers_sql(f"aggregate({terms_col}, 0.0D, (lv_acc, lv_t) -> {body})"))


def _direct_one_sql(t: str) -> str:
    return (f"coalesce(contains(_url_l, {t}) OR contains(lower(platform), {t}) OR "
            f"contains(lower(industry), {t}) OR contains(_tags_l, {t}), false)")


def _direct(terms: list[str]) -> Column:
    """Some term occurs in the URL, platform, industry or tags (case-insensitive)."""
    if not terms:
        return F.lit(False)
    return F.expr(" OR ".join(_direct_one_sql(sql_str(t)) for t in terms))


def _fuzzy(main: str) -> Column:
    """The whole query is within edit distance 2 of the host, platform or industry."""
    parts = [f"(length({f}) > 0 AND abs(length({main}) - length({f})) <= 6 "
             f"AND levenshtein({main}, {f}, 2) >= 0)" for f in ("_fhost", "_plat_n", "_ind_n")]
    return F.expr(" OR ".join(parts))


def _as_of(as_of) -> Column:
    return as_of_col(as_of)


# ---------------------------------------------------------------------------
# one query
# ---------------------------------------------------------------------------

def scored_candidates(sites: DataFrame, q: str, dicts: Dictionaries = DEFAULT,
                      as_of=None) -> DataFrame:
    """Candidates of one query with their score (zeros included), unordered.

    ``score > 0`` is deliberately not applied here: a filter right above the
    scoring projection is pushed below it by the optimizer and the score is then
    computed twice.  Consumers apply it above a limit or inside an aggregate.
    """
    terms = expand_terms(q, dicts)
    cols = sites.columns
    if not terms:
        return sites.withColumn("score", F.lit(0.0)).filter(F.lit(False))
    base = _prepare(sites)
    direct = _direct(terms)
    main = sql_str((q or "").strip().lower())
    # "no direct candidate at all" as an uncorrelated subquery: one cheap
    # filtered scan that stops at the first hit, evaluated once.
    has_direct = (base.filter(direct)
                  .select(F.lit(1).alias("one")).limit(1).exists())
    cand = base.filter(direct | (~has_direct & _fuzzy(main)))
    return (cand.select("*", _as_of(as_of).alias("_as_of"))
            .select(*cols, score_terms(terms).alias("score")))


def ranked(sites: DataFrame, q: str, dicts: Dictionaries = DEFAULT, as_of=None) -> DataFrame:
    """All rows of one query with score > 0 (unordered): site columns + score."""
    return scored_candidates(sites, q, dicts, as_of).filter(F.col("score") > 0)


def search(sites: DataFrame, q: str, page: int = 1, page_size: int = PAGE_SIZE,
           dicts: Dictionaries = DEFAULT, as_of=None):
    """One page of results and its page information.

    Returns ``(rows, info)``.  ``rows``: rank, the site columns and score for the
    effective page; ``info``: one row with page, total_pages, total_results,
    has_previous, has_next.  A page past the end falls back to page 1, a page
    below 1 is page 1.
    """
    raw_page = page if page and page > 0 else 1
    c = scored_candidates(sites, q, dicts, as_of)
    total = c.agg(F.count_if(F.col("score") > 0).alias("total_results"))
    tp = F.when(F.col("total_results") > 0,
                F.greatest(F.lit(1), F.ceil(F.col("total_results") / F.lit(page_size)))).otherwise(1)
    info = (total
            .withColumn("total_pages", tp.cast("long"))
            .withColumn("page", F.when((F.lit(raw_page) > F.col("total_pages"))
                                       & (F.col("total_results") > 0), F.lit(1))
                        .otherwise(F.lit(raw_page)).cast("long"))
            .withColumn("has_previous", F.col("page") > 1)
            .withColumn("has_next", (F.col("page") < F.col("total_pages"))
                        & (F.col("total_results") > page_size))
            .select("page", "total_pages", "total_results", "has_previous", "has_next"))
    if raw_page == 1:
        top = top_ranked(c, page_size)
    else:  # page 1 comes along for a page that turns out to lie past the end
        first = (raw_page - 1) * page_size
        top = global_positions(c, [-F.col("score"), F.col("id")], "rank", [(1, page_size), (first + 1, first + page_size)])
        top = top.filter(F.col("score") > 0)
    rows = (with_page_info(top, info.select("page"))
            .filter(F.floor((F.col("rank") - 1) / F.lit(page_size)) + 1 == F.col("page"))
            .drop("page"))
    return rows, info


def top_ranked(c: DataFrame, n: int) -> DataFrame:
    """Rows ranked 1..n by (score desc, id) among those with score > 0, with ``rank``.

    A distributed top-k, then ranks over those n rows.  Zero scores sort last,
    so dropping them after ranking is exact.  Any page but the first is found
    with ``global_positions``, whatever its depth.
    """
    order = [F.col("score").desc(), F.col("id").asc()]
    top = c.orderBy(*order).limit(n).filter(F.col("score") > 0)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def with_page_info(rows: DataFrame, info: DataFrame) -> DataFrame:
    """Attach the one-row page information to every result row.

    ``info`` is a global aggregate (exactly one row), so it is broadcast and
    joined on a constant key; computed once however many columns are attached.
    """
    one = F.lit(1).alias("_one")
    return (rows.select("*", one).join(F.broadcast(info.select("*", one)), "_one").drop("_one"))


def search_all(sites: DataFrame, q: str, limit: int | None = None,
               dicts: Dictionaries = DEFAULT, as_of=None) -> DataFrame:
    """All matches of one query in rank order (the all-results view); ``limit`` cuts the list where a caller wants that."""
    found = ranked(sites, q, dicts, as_of).orderBy(F.col("score").desc(), "id")
    return found if limit is None else found.limit(max(0, limit))


# ---------------------------------------------------------------------------
# many queries
# ---------------------------------------------------------------------------

def _query_terms(queries: DataFrame, dicts: Dictionaries) -> DataFrame:
    q = queries.select(F.col("query_id"), expand_terms_col(F.col("q"), dicts).alias("_terms"),
                       norm(F.col("q")).alias("_main"))
    return q.filter(F.size("_terms") > 0)


def _pieces(c: Column) -> Column:
    """Every piece of 1 to 3 characters of a string."""
    n = F.length(c)
    none = F.array().cast("array<string>")

    def of(size):
        return F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))),
                                             lambda i: F.substr(c, i, F.lit(size)))).otherwise(none)
    return F.concat(of(1), of(2), of(3))


def site_grams(sites_p: DataFrame) -> DataFrame:
    """(gram, id): the distinct pieces of 1 to 3 characters of a site's lower-cased URL,
    platform, industry and tags -- the index of the direct-match join."""
    fields = [F.col("_url_l"), F.lower("platform"), F.lower("industry"), F.col("_tags_l")]
    grams = F.array_distinct(F.concat(*[_pieces(F.coalesce(f, F.lit(""))) for f in fields]))
    return sites_p.select("id", F.explode(grams).alias("gram"))


def search_index(sites: DataFrame) -> DataFrame:
    """The gram index of a catalog, (gram, id), to store next to it and pass to
    ``search_batch(index=...)`` so batch searches do not rebuild it."""
    return site_grams(_prepare(sites.repartition("id")))


def _segments(c: str) -> str:
    """SQL: the three segments of a string column as array<struct<length, part, piece>>: one key each."""
    cut = "CAST({0} * length({1}) / 3 AS INT)"
    lo, hi = cut.format("lv_i", c), cut.format("(lv_i + 1)", c)
    return f"transform(sequence(0, 2), lv_i -> struct(length({c}) AS length, lv_i AS part, substr({c}, {lo} + 1, {hi} - {lo}) AS piece))"


def _asked_segments(c: str) -> str:
    """SQL: the same keys of every string within two edits of a string column, as far as one segment stays whole: for
    each length up to two off, the pieces that stand where a segment is, moved by at most two."""
    lo, hi = "CAST(lv_p * lv_n / 3 AS INT)", "CAST((lv_p + 1) * lv_n / 3 AS INT)"
    piece = f"struct(lv_n AS length, lv_p AS part, if({lo} + lv_s >= 0 AND {hi} + lv_s <= length({c}), substr({c}, {lo} + lv_s + 1, {hi} - {lo}), NULL) AS piece)"
    every = (f"flatten(transform(sequence(greatest(length({c}) - {TYPOS}, 1), length({c}) + {TYPOS}), lv_n -> "
             f"flatten(transform(sequence(0, 2), lv_p -> transform(sequence(-{TYPOS}, {TYPOS}), lv_s -> {piece})))))")
    return f"array_distinct(filter({every}, lv_x -> lv_x.piece IS NOT NULL))"


def _near_values(sites_p: DataFrame, q: DataFrame) -> DataFrame:
    """(query_id, id): sites with a host, platform or industry within two edits of the whole query.

    Two edits leave at least one of a value's three segments whole, and it then stands in the query
    at most two places off.  The distinct values, with three keys each, and the queries, with a
    constant number of keys, meet in an equi-join on (value length, segment, text); the bounded edit distance then decides.
    """
    fields = F.array("_fhost", "_plat_n", "_ind_n")
    used = sites_p.select("id", F.explode(F.array_distinct(F.filter(fields, lambda v: F.length(v) > 0))).alias("value"))
    values = used.select("value").distinct()
    left = values.select("value", F.explode(F.expr(_segments("value"))).alias("key"))
    right = q.select("query_id", "_main", F.explode(F.expr(_asked_segments("_main"))).alias("key"))
    near = left.hint("merge").join(right, "key").filter(F.expr(f"levenshtein(_main, value, {TYPOS}) >= 0")).select("value", "query_id").distinct()
    return near.join(used.hint("merge"), "value").select("query_id", "id").distinct()


def _rarest_piece(terms: DataFrame, grams: DataFrame) -> DataFrame:
    """(t, gram): for each term the piece of three characters (the whole term, if it is shorter) that the fewest sites
    hold.  A term with a piece that no site holds can't occur and is left out.  Of the letters and digits that queries
    are cut into there are 47,988 pieces at most, besides those of the synonyms: few enough to be broadcast."""
    n = F.length("t")
    own = F.when(n <= 3, F.array("t")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substr("t", i, F.lit(3))))
    pieces = terms.select("t").distinct().select("t", F.explode(F.array_distinct(own)).alias("gram"))
    held = grams.join(F.broadcast(pieces.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("sites"))
    best = pieces.join(held, "gram", "left").groupBy("t").agg(F.min(F.struct(F.coalesce("sites", F.lit(0)).alias("sites"), "gram")).alias("b"))
    return best.filter("b.sites > 0").select("t", "b.gram")


def batch_pairs(sites_p: DataFrame, q: DataFrame, as_of: Column, grams: DataFrame) -> DataFrame:
    """Scored candidate pairs (query_id, id, _is_direct, score), found through the gram index.

    A term can only occur in a field that holds all its pieces of three characters: an
    equi-join on the rarest of them (``_rarest_piece``), then an exact
    ``contains`` check, once for each term and site, gives the sites of every term and with them exactly the
    direct pairs.  Queries without any go to the typo fallback, an equi-join too.  Cost grows with the matches, never
    with queries x sites.  Neither the catalog nor the queries are broadcast, and no shuffle deals out whole sites by query.
    """
    terms = q.select("query_id", F.explode("_terms").alias("t"))
    fields = sites_p.select("id", "_url_l", "platform", "industry", "_tags_l")
    best = _rarest_piece(terms, grams)
    asked = grams.join(F.broadcast(best.select("gram").distinct()), "gram", "left_semi").join(best.hint("merge"), "gram")
    found = asked.select("id", "t").join(fields.hint("merge"), "id").filter(F.expr(_direct_one_sql("t"))).select("t", "id")
    part = F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int")
    found = found.withColumn("_part", part).repartition("t", "_part")  # one exchange, read by both consumers
    spread = terms.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    direct = found.join(spread.hint("merge"), ["t", "_part"]).select("query_id", "id").distinct()
    hits = found.groupBy("t").agg(F.count_if(F.col("id").isNotNull() & (F.col("_part") >= 0)).alias("sites"))  # the columns of the other consumer
    answered = terms.join(hits.filter("sites > 0").hint("merge"), "t", "left_semi").select("query_id").distinct()
    no_direct = q.join(answered.hint("merge"), "query_id", "left_anti")
    cand = (direct.withColumn("_is_direct", F.lit(True))
            .unionByName(_near_values(sites_p, no_direct).withColumn("_is_direct", F.lit(False))))
    cand = cand.join(q.hint("merge"), "query_id")  # while the pairs are narrow
    return (cand.join(sites_p.hint("merge"), "id").select("*", as_of.alias("_as_of"))
            .select("query_id", "id", "_is_direct", score_terms_col().alias("score")))


def search_batch(sites: DataFrame, queries: DataFrame, k: int = PAGE_SIZE,
                 dicts: Dictionaries = DEFAULT, as_of=None, index: DataFrame | None = None) -> DataFrame:
    """Top ``k`` results of every query in ``queries(query_id, q)``.

    Output: query_id, rank, the site columns, score, total_results.  ``index``:
    a stored ``search_index(sites)`` (it must belong to the same catalog); built
    in the same job when absent.  Scored pairs pass one exchange as (query_id, id, score), evenly dealt; from it the
    top-k window cuts every query to k rows before its own shuffle, and the totals are partial counts.
    """
    cols = sites.columns
    sites = sites.repartition("id")  # a small file is one split
    sites_p = _prepare(sites)
    grams = site_grams(sites_p) if index is None else index.select("gram", "id")
    pairs = batch_pairs(sites_p, _query_terms(queries, dicts), _as_of(as_of), grams)
    above = F.explode(F.filter(F.array("score"), lambda s: s > 0))  # a filter would be pushed into the join and score every pair twice
    kept = pairs.select("query_id", "id", above.alias("score")).repartition("query_id", "id")  # one exchange of narrow rows, read by both consumers: pairs are scored once
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc())
    top = kept.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    totals = kept.groupBy("query_id").agg(F.count_if(F.col("id").isNotNull() & (F.col("score") > 0)).alias("total_results"))  # the columns of the other consumer
    out = top.select("query_id", "id", "rank", "score").join(totals, "query_id", "left")  # each has its total; who reads none doesn't count
    return out.join(sites.hint("merge"), "id").select("query_id", "rank", *cols, "score", "total_results")


# ---------------------------------------------------------------------------
# heat leaderboard
# ---------------------------------------------------------------------------

def heat_leaderboard(sites: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    """Sites by heat, highest first with NULL heat ahead of all, ties by id.

    Adds ``total_positive_or_null``: the number of sites with heat > 0 or NULL
    (zeros are listed but not counted, as in the catalog's leaderboard).
    """
    total = sites.agg(F.count_if((F.col("heat_score") > 0) | F.col("heat_score").isNull())
                      .alias("total_positive_or_null"))
    off = max(0, offset)
    end = off + max(0, limit)
    if off == 0:
        order = [F.col("heat_score").desc_nulls_first(), F.col("id").asc()]
        page = sites.orderBy(*order).limit(end)
        page = page.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    else:
        page = global_positions(sites, [-F.col("heat_score"), F.col("id")], "rank", [(off + 1, end)])
    return with_page_info(page, total)
