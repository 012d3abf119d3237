"""Plan shape: pushdown, pruning, no Python in the hot path, expected join strategies."""



from sitelens.operators import enrich as E
from sitelens.operators import search as S
from sitelens.plans import fixtures as FX


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_single_search_is_top_k_without_python(spark, sf_small):
    cat = FX.sites(spark, sf_small)
    rows, _ = S.search(cat, "red widget", as_of=FX.AS_OF)
    p = plan(rows)
    assert "TakeOrderedAndProject" in p
    assert "Python" not in p and "ArrowEval" not in p
    assert "Join" not in p.split("Subquery")[0] or "BroadcastHashJoin" in p  # only the usage join


def test_scan_prunes_columns(spark, sf_small):
    cat = FX.sites(spark, sf_small, with_usage=False)
    p = plan(S.ranked(cat, "gear", as_of=FX.AS_OF))
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_brand:string,p_type:string>" in p


def test_batch_search_has_no_nested_loops(spark, sf_small):
    from sitelens.operators import suggest as SG
    cat = FX.sites(spark, sf_small, with_usage=False)
    q = spark.createDataFrame([(1, "gear"), (2, "red"), (3, "x"), (4, "econmy")], "query_id long, q string")
    for out in (S.search_batch(cat, q, as_of=FX.AS_OF), SG.suggest_batch(cat, spark.createDataFrame([("re",)], "prefix string"))):
        p = plan(out)
        assert "NestedLoopJoin" not in p and "CartesianProduct" not in p and "Python" not in p


def test_batch_search_broadcasts_no_catalog(spark, sf_small):
    """Small files can hold many rows: only the pieces that queries ask for, a bounded set, are broadcast."""
    import re

    from sitelens.operators import heat as H
    cat = FX.sites(spark, sf_small, with_usage=False)
    q = spark.createDataFrame([(1, "gear"), (2, "red"), (3, "x"), (4, "econmy")], "query_id long, q string")
    found = S.search_batch(cat, q, as_of=FX.AS_OF)
    for out in (found, H.apply_usage(cat, H.usage_from_results(found, as_of=FX.AS_OF))):
        joins = re.findall(r"BroadcastHashJoin \[(\w+)", plan(out))
        assert joins and set(joins) == {"gram"}


def test_batch_search_scores_pairs_in_one_place(spark, sf_small):
    import __spark_entry__ as entry

    def scores(name):  # the factor of the recency stands in the plan once for each place where pairs are scored
        return entry.queries()[name](spark, sf_small)._jdf.queryExecution().optimizedPlan().toString().count("-1.0E-4")
    assert scores("search_touch") == 1  # no totals, which it doesn't read
    assert scores("search_batch") == scores("search_batch_index") == 2  # equal exchanges, of which Spark runs one


def test_batch_search_deals_only_narrow_pairs_by_query(spark, sf_small):
    import re
    cat = FX.sites(spark, sf_small, with_usage=False)
    q = spark.createDataFrame([(1, "gear"), (2, "red")], "query_id long, q string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table of queries that is no small one
    try:
        text = S.search_batch(cat, q, as_of=FX.AS_OF)._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    dealt = re.findall(r"Exchange\nInput \[\d+\]: (.*)\nArguments: hashpartitioning\(query_id#\d+L?, \d+\)", text)
    assert dealt and not any("tag_confidence" in x or "_host" in x for x in dealt)


def test_detectors_stay_in_jvm(spark, sf_small):
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    out = E.detect_platforms(pages, "html", "p")
    out = E.with_colors(out, "html", "c")
    p = plan(out)
    assert "Python" not in p and "BatchEvalPython" not in p


def test_tags_and_records_take_one_narrow_stage(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    for out in (E.extract_tags(docs, "doc_id", "text"), E.enrich_pages(pages, as_of=FX.AS_OF)):
        p = plan(out)
        assert "Exchange" not in p and "Aggregate" not in p and "Python" not in p


def test_builders_run_no_jobs(spark, sf_small):
    import datetime as _dt

    from sitelens.operators import heat as H
    from sitelens.operators import ingest as I
    from sitelens.operators import suggest as SG
    cat = FX.sites(spark, sf_small).repartition(3)
    batch, target = FX.import_batch(spark, sf_small), FX.import_target(spark, sf_small)
    pages, requests = FX.pages_seeded(spark, sf_small), FX.url_requests(spark, sf_small)
    q = spark.createDataFrame([(1, "gear")], "query_id long, q string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "no job is expected")
    try:
        S.search(cat, "gear", as_of=FX.AS_OF)
        S.search_all(cat, "gear", as_of=FX.AS_OF)
        S.search_batch(cat, q, as_of=FX.AS_OF)
        SG.suggest(cat, "re")
        SG.suggest_batch(cat, q.selectExpr("q AS prefix"))
        S.heat_leaderboard(cat)
        H.heat_report(cat)
        H.apply_usage(cat, H.usage_from_results(cat, as_of=_dt.datetime(2002, 1, 1)))
        I.import_enriched(target, batch)
        I.upsert_sites(target, batch.select("row_no", "website_url", "platform"))
        I.import_urls(target, requests, pages)
        E.enrich_pages(pages)
        E.extract_tags(pages, "page_id", "html")
        assert list(tracker.getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_search_all_cap(spark, sf_small):
    from sitelens.operators import search as S
    cat = FX.sites(spark, sf_small)
    full = S.ranked(cat, "small", as_of=FX.AS_OF).count()
    assert full > 5
    capped = S.search_all(cat, "small", limit=5, as_of=FX.AS_OF).collect()
    assert len(capped) == 5
    scores = [r["score"] for r in capped]
    assert scores == sorted(scores, reverse=True)


def test_hot_keys_are_pre_aggregated(spark):
    import datetime as _dt

    from sitelens.operators import heat as H
    from sitelens.operators import ingest as I
    t0 = _dt.datetime(2001, 1, 1)
    n = 3000
    # site 1 holds a third of all usage events
    usage = spark.createDataFrame([(1 if i % 3 == 0 else i, t0, 1.0) for i in range(n)],
                                  "site_id long, ts timestamp_ntz, amount double")
    sites = spark.createDataFrame([(i, None, None) for i in range(n)],
                                  "id long, heat_score double, last_used_at timestamp_ntz")
    out = H.apply_usage(sites, usage)
    assert out.filter("id = 1").first()["heat_score"] == 1000.0 + 1.0
    p = plan(out)
    assert "partial_sum" in p and "partial_max" in p
    # one URL makes up a third of an import batch
    batch = spark.createDataFrame([(i + 2, "https://hot.test" if i % 3 == 0 else f"https://s{i}.test")
                                   for i in range(n)], "row_no long, website_url string")
    target = spark.createDataFrame([], I.SITES_SCHEMA)
    _, report = I.import_enriched(target, batch)
    counts = {r["outcome"]: r["count"] for r in report.groupBy("outcome").count().collect()}
    assert counts == {"inserted": 2001, "skipped": 999}
    assert "partial_min" in plan(report)


def test_tags_sort_once_and_take_linear_time(spark):
    import time

    def docs(words):
        return spark.createDataFrame([(i, " ".join(f"word{(i * 7 + j * j) % 997:04d}" for j in range(words))) for i in range(40)], "doc_id long, text string").repartition(8).cache()

    def seconds(frame):
        t0 = time.time()
        E.extract_tags(frame, "doc_id", "text").write.format("noop").mode("overwrite").save()
        return time.time() - t0

    out = E.extract_tags(docs(10), "doc_id", "text")
    for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") + plan(out).split("\n"):
        assert line.count("sort_array") <= 1
    few, many = docs(8_000), docs(32_000)
    few.count(), many.count(), seconds(few)
    assert seconds(many) <= 6 * max(seconds(few), 0.5)


def test_tags_of_empty_and_null_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "and the of"), (4, "solar solar panel")], "doc_id long, text string")
    assert {(r["doc_id"], r["rank"], r["tag"], r["freq"]) for r in E.extract_tags(docs, "doc_id", "text").collect()} == {(4, 1, "solar", 2), (4, 2, "panel", 1)}
