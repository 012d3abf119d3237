"""Registered queries of the operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm import alignment as OP11
from sitelens.llm import attention_lm as OP6
from sitelens.llm import block_dedup as OP4
from sitelens.llm import decontaminate as OP7
from sitelens.llm import jaccard_join as OP8
from sitelens.llm import language as OP5
from sitelens.llm import quality as OP3
from sitelens.llm import segmentations as OP10
from sitelens.llm import spelling as OP12
from sitelens.llm import suffix_dedup as OP1
from sitelens.llm import topk_search as OP9
from sitelens.llm import url_filter as OP13
from sitelens.llm import warc as OP2
from sitelens.llm.common import table

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@register("op1_suffix_dedup")
def q_op1(spark, sf_dir) -> DataFrame:
    kept = OP1.suffix_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

@register("op2_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, sha1(payload) AS payload_digest, payload FROM p),
w AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload) ELSE page_id END AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last > page_id THEN last END AS refers_to FROM w""")
def q_op2(spark, sf_dir) -> DataFrame:
    found = OP2.round_trip(table(spark, sf_dir, "pages"))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    response = F.col("type") == "response"
    return found.select(
        page("record_id").cast("long").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.regexp_replace("digest", "^sha1:", "")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(F.col("refers_to").isNotNull(), page("refers_to").cast("long")).alias("refers_to"))


@register("op4_block_dedup")
def q_op4(spark, sf_dir) -> DataFrame:
    kept = OP4.block_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@register("op9_topk_search", """
WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM u q JOIN u c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def q_op9(spark, sf_dir) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return OP9.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


@register("op3_quality")
def q_op3(spark, sf_dir) -> DataFrame:
    return OP3.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op5_language")
def q_op5(spark, sf_dir) -> DataFrame:
    return OP5.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@register("op7_decontaminate")
def q_op7(spark, sf_dir) -> DataFrame:
    return OP7.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op8_jaccard_join")
def q_op8(spark, sf_dir) -> DataFrame:
    return OP8.similar_documents(table(spark, sf_dir, "documents"))


@register("op6_attention_lm")
def q_op6(spark, sf_dir) -> DataFrame:
    return OP6.score_texts(table(spark, sf_dir, "documents"))


@register("op10_segmentations")
def q_op10(spark, sf_dir) -> DataFrame:
    return OP10.digest(OP10.encode(table(spark, sf_dir, "documents")))


RULES = [OP13.Rule("allow", "com", "/"), OP13.Rule("block", "example.com", "/en/"), OP13.Rule("allow", "www.example.com", "/en/"), OP13.Rule("block", "net", "/es/"), OP13.Rule("block", "net", "/fr/")]


@register("op13_url_filter", r"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
named AS (SELECT row_number() OVER () AS row_no, page_id, url, html, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
split AS (SELECT row_no, page_id, url, html,
  coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM named),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM named WHERE contains(url, '://') AND (html ILIKE '%canonical%' OR html ILIKE '%http-equiv%')),
links AS (SELECT url AS u, coalesce(nullif(regexp_extract(tag, '(?i)^<link\b.*\shref\s*=\s*["'']?(\w+://[^"''\s>]+)', 1), ''), regexp_extract(tag, '(?i)url\s*=\s*["'']?(\w+://[^"''\s>]+)', 1)) AS v FROM tags
  WHERE regexp_matches(tag, '(?i)^<link\b.*\srel\s*=\s*["'']?canonical') OR regexp_matches(tag, '(?i)^<meta\b.*\shttp-equiv\s*=\s*["'']?refresh')),
ends AS (SELECT DISTINCT regexp_replace(u, '#.*$', '') AS a, regexp_replace(v, '#.*$', '') AS b FROM links WHERE v <> ''),
both_ways AS (SELECT a, b FROM ends UNION SELECT b, a FROM ends),
parts AS (SELECT a, a AS b FROM both_ways UNION SELECT p.a, e.b FROM parts p JOIN both_ways e ON p.b = e.a),
ruled AS (SELECT b, (SELECT arg_max(r.verdict, length(r.host || r.path)) FROM rules r
                     WHERE ('.' || lower(split_part(split_part(b, '://', 2), '/', 1))) LIKE ('%.' || r.host) AND starts_with(regexp_extract(b, '^[^:]*://[^/?#]*([^?#]*)', 1), r.path)) AS verdict
          FROM (SELECT DISTINCT b FROM parts)),
bad AS (SELECT DISTINCT p.a FROM parts p JOIN ruled USING (b) WHERE ruled.verdict = 'block'),
fits AS (SELECT row_no, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
         FROM split s JOIN rules r ON ('.' || s.host) LIKE ('%.' || r.host) AND starts_with(s.path, r.path) GROUP BY row_no)
SELECT page_id, host, path, rule, coalesce(f.verdict, CASE WHEN bad.a IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM split LEFT JOIN fits f USING (row_no) LEFT JOIN bad ON regexp_replace(url, '#.*$', '') = bad.a""")
def q_op13(spark, sf_dir) -> DataFrame:
    return OP13.judge(table(spark, sf_dir, "pages"), RULES)


@register("op12_spelling")
def q_op12(spark, sf_dir) -> DataFrame:
    return OP12.variants(table(spark, sf_dir, "documents"))


@register("op11_alignment")
def q_op11(spark, sf_dir) -> DataFrame:
    documents, _ = OP11.align(table(spark, sf_dir, "documents"))
    return documents
