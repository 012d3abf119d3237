"""Imports, inserts, upserts, feedback and schema evolution."""

import datetime as dt


from sitelens.operators import ingest as I

AS_OF = dt.datetime(2002, 1, 1)
BATCH = ("row_no long, website_url string, platform string, industry string, tags string, "
         "platforms string, industries string, colors string, tag_confidence string, "
         "enrichment_signals string, last_enriched_at string")


def target(spark):
    return I.conform(spark.createDataFrame(
        [(1, "https://old.test", "Legacy", 7.0, {"owner": "me"})],
        "id long, website_url string, platform string, heat_score double, site_metadata map<string,string>"))


def batch(spark):
    rows = [
        (2, "https://new.test", "Webflow", "SaaS", "a, b", '["Webflow"]', '["SaaS"]',
         '{"primary": "#aabbcc", "secondary": null}', '{"a": 0.9}', None, "2001-12-01T10:00:00Z"),
        (3, "  ", "x", "x", "", None, None, None, None, None, None),
        (4, "https://old.test", "Wix", "Blog", "", '["Wix"]', None, None, None, None, None),
        (5, "https://new.test", "Other", "Blog", "", '["Other"]', None, None, None, None, None),
        (6, "https://bad.test", "Wix", "Blog", "", '["broken', "[]", None, None, None, "not-a-time"),
    ]
    return spark.createDataFrame(rows, BATCH)


def test_import_bulk(spark):
    new_target, report = I.import_enriched(target(spark), batch(spark), as_of=AS_OF)
    got = {r["row_no"]: (r["outcome"], r["error"]) for r in report.collect()}
    assert got == {2: ("inserted", None), 3: ("error", "Empty URL"),
                   4: ("skipped", "Site already exists"), 5: ("skipped", "Duplicate in batch"),
                   6: ("inserted", None)}
    rows = {r["website_url"]: r for r in new_target.collect()}
    assert set(rows) == {"https://old.test", "https://new.test", "https://bad.test"}
    assert rows["https://new.test"]["platforms"] == ["Webflow"]
    assert rows["https://new.test"]["last_enriched_at"] == dt.datetime(2001, 12, 1, 10)
    assert rows["https://bad.test"]["platforms"] is None and rows["https://bad.test"]["industries"] is None
    assert rows["https://bad.test"]["last_enriched_at"] is None
    stats = I.import_stats(report).first()
    assert (stats["imported"], stats["skipped"], stats["errors"], stats["total"]) == (2, 2, 1, 5)


def test_import_upload_mode(spark):
    _, report = I.import_enriched(target(spark), batch(spark), mode="upload", as_of=AS_OF)
    got = {r["row_no"]: (r["outcome"], r["error"]) for r in report.collect()}
    assert got[4] == ("error", "Site already exists") and got[5] == ("error", "Site already exists")
    assert got[6] == ("error", "Invalid JSON in platforms")
    errs = I.import_errors(report).collect()
    assert len(errs) == 4


def test_batch_limit(spark):
    rows = [(i, f"https://s{i}.test", "p", "i", "", None, None, None, None, None, None)
            for i in range(2, 2 + 510)]
    _, report = I.import_enriched(target(spark), spark.createDataFrame(rows, BATCH), max_rows=500,
                                  as_of=AS_OF)
    got = report.groupBy("outcome").count().collect()
    assert {r["outcome"]: r["count"] for r in got} == {"inserted": 500, "error": 1}
    err = report.filter("outcome = 'error'").first()
    assert (err["row_no"], err["error"]) == (502, "CSV exceeds 500-row limit")


def test_insert_ignore_keeps_urls_unique(spark):
    b = spark.createDataFrame([(2, "https://a.test"), (3, "https://a.test"), (4, "https://old.test")],
                              "row_no long, website_url string")
    new_target, report = I.insert_ignore(target(spark), b, as_of=AS_OF)
    urls = [r["website_url"] for r in new_target.collect()]
    assert sorted(urls) == ["https://a.test", "https://old.test"]
    again, _ = I.insert_ignore(new_target, b, as_of=AS_OF)
    assert again.count() == 2


def test_upsert_twice_is_once(spark):
    recs = spark.createDataFrame(
        [(1, "https://old.test", "Webflow", "SaaS"), (2, "https://n.test", "Wix", "Blog")],
        "row_no long, website_url string, platform string, industry string")
    once, report = I.upsert_sites(target(spark), recs, as_of=AS_OF)
    twice, _ = I.upsert_sites(once, recs, as_of=AS_OF)
    key = lambda df: sorted((r["website_url"], r["platform"], r["industry"], r["heat_score"]) for r in df.collect())
    assert key(once) == key(twice)
    old = [r for r in once.collect() if r["website_url"] == "https://old.test"][0]
    assert (old["platform"], old["heat_score"], old["site_metadata"]) == ("Webflow", 7.0, {"owner": "me"})
    assert {r["website_url"]: r["outcome"] for r in report.collect()} == {
        "https://old.test": "updated", "https://n.test": "inserted"}


def test_ensure_columns_idempotent(spark):
    df = spark.createDataFrame([("https://x.test",)], "website_url string")
    once = I.ensure_columns(df)
    assert once.columns == I.ensure_columns(once).columns
    assert set(f.name for f in I.SITES_SCHEMA.fields) <= set(once.columns)


def test_detect_import_mode():
    assert I.detect_import_mode(["url"]) == "missing_url"
    assert I.detect_import_mode(["website_url", "platform"]) == "enrich"
    assert I.detect_import_mode(["website_url"] + I.ENRICHED_COLUMNS) == "pre_enriched"


def test_resolve_feedback(spark):
    fb = spark.createDataFrame([(" https://old.test ", " a, b "), ("https://nope.test", "c"),
                                ("", "x"), ("https://old.test", "  ")],
                               "website_url string, suggested_tags string")
    got = [(r["site_id"], r["website_url"], r["suggested_tags"], r["status"])
           for r in I.resolve_feedback(fb, target(spark), as_of=AS_OF).collect()]
    assert sorted(got, key=str) == sorted([(1, "https://old.test", "a, b", "ok"),
                                           (None, "https://nope.test", "c", "ok"),
                                           (None, "", "x", "ignored"),
                                           (None, "https://old.test", "", "ignored")], key=str)


def test_enrich_batch(spark):
    pages = spark.createDataFrame([("https://a.test", "<title>T</title><p>shop</p>"),
                                   ("https://b.test", "")], "url string, html string")
    req = spark.createDataFrame([(2, "https://a.test"), (3, "b.test"), (4, "https://b.test"),
                                 (5, "https://c.test")], "row_no long, url string")
    good, errors = I.enrich_batch(req, pages, as_of=AS_OF)
    assert [r["row_no"] for r in good.collect()] == [2]
    got = {r["row_no"]: r["error"] for r in errors.collect()}
    assert got == {3: "URL must start with http:// or https://", 4: "Failed to fetch https://b.test",
                   5: "Failed to fetch https://c.test"}
    good2, errors2 = I.enrich_batch(req, pages, as_of=AS_OF, on_missing="empty")
    assert sorted(r["row_no"] for r in good2.collect()) == [2, 4, 5]
    assert {r["platform"] for r in good2.collect() if r["row_no"] != 2} == {"Unknown"}


def test_migrate(spark):
    migrated, recon = I.migrate_sites(batch(spark), as_of=AS_OF)
    r = recon.first()
    assert (r["source_rows"], r["migrated_rows"], r["failed_rows"]) == (5, 4, 1)
    assert all(m["site_metadata"]["migrated_at"] == "2002-01-01T00:00:00Z" for m in migrated.collect())
    dry, _ = I.migrate_sites(batch(spark), as_of=AS_OF, dry_run=True)
    assert dry.count() == 0


def test_csv_roundtrip(spark, tmp_path):
    from sitelens.operators.enrich import enrich_pages
    from sitelens.sources import csv_io
    pages = spark.createDataFrame([(1, "https://a.test", '<title>A, "quoted"</title><p>shop cart</p>')],
                                  "page_id long, url string, html string")
    recs = enrich_pages(pages, as_of=AS_OF)
    csv_io.write_enriched_csv(recs, str(tmp_path / "out"))
    back = csv_io.read_enriched_csv(spark, str(tmp_path / "out"))
    assert back.first()["row_no"] == 2
    nt, rep = I.import_enriched(spark.createDataFrame([], I.SITES_SCHEMA), back, as_of=AS_OF)
    a, b = recs.first(), nt.first()
    for c in ("website_url", "platform", "industry", "tags", "platforms", "industries", "tag_confidence"):
        assert a[c] == b[c], c
    assert b["last_enriched_at"] == AS_OF
    raw = csv_io.read_raw_sites(spark, str(tmp_path / "out"))
    assert raw.count() == 1


def test_import_stream_deltas_and_replay(spark, tmp_path):
    from sitelens.streaming import streams as ST
    base = str(tmp_path / "base")
    I.conform(target(spark)).write.parquet(base)
    src = tmp_path / "in"
    batch(spark).coalesce(1).write.option("header", True).option("quote", '"') \
        .option("escape", '"').csv(str(src / "g0"))
    schema = ", ".join(f"{c} string" for c in batch(spark).columns if c != "row_no")
    stream = (spark.readStream.schema(f"row_no long, {schema}").option("header", True)
              .option("quote", '"').option("escape", '"').csv(str(src / "*")))
    deltas, reports, ckpt = str(tmp_path / "d"), str(tmp_path / "r"), str(tmp_path / "c")
    ST.import_stream(stream, base, deltas, reports, ckpt, as_of=AS_OF).awaitTermination()
    cat = ST.current_catalog(spark, base, deltas)
    assert sorted(r["website_url"] for r in cat.collect()) == [
        "https://bad.test", "https://new.test", "https://old.test"]
    # restarting from the same checkpoint finds nothing new to do
    ST.import_stream(stream, base, deltas, reports, ckpt, as_of=AS_OF).awaitTermination()
    assert ST.current_catalog(spark, base, deltas).count() == 3
    assert spark.read.parquet(reports).count() == 5


def test_file_size_limit(spark, tmp_path):
    from sitelens.sources import csv_io
    small = spark.createDataFrame([(f"https://s{i}.test",) for i in range(3)], "website_url string")
    small.coalesce(1).write.option("header", True).csv(str(tmp_path / "in" / "a"))
    big = spark.createDataFrame([(f"https://b{i}.test/" + "x" * 200,) for i in range(400)], "website_url string")
    big.coalesce(1).write.option("header", True).csv(str(tmp_path / "in" / "b"))
    rows = csv_io.read_csv_rows(spark, str(tmp_path / "in" / "*"))
    _, report = I.import_enriched(target(spark), rows, mode="upload", max_bytes=50_000, as_of=AS_OF)
    got = report.groupBy("outcome", "error").count().collect()
    assert {(r["outcome"], r["error"]): r["count"] for r in got} == {
        ("inserted", None): 3, ("error", "File too large (max 5 MB)"): 1}


def test_repeated_url_across_files(spark, tmp_path):
    from sitelens.sources import csv_io
    for name in ("a", "b"):
        spark.createDataFrame([("https://same.test",), (f"https://{name}.test",)], "website_url string") \
            .coalesce(1).write.option("header", True).csv(str(tmp_path / "in" / name))
    rows = csv_io.read_csv_rows(spark, str(tmp_path / "in" / "*"))
    new_target, report = I.import_enriched(target(spark), rows, as_of=AS_OF)
    urls = sorted(r["website_url"] for r in new_target.collect())
    assert urls == ["https://a.test", "https://b.test", "https://old.test", "https://same.test"]
    got = sorted((r["outcome"], r["error"]) for r in report.collect())
    assert got == [("inserted", None)] * 3 + [("skipped", "Duplicate in batch")]
    assert "source_file" in report.columns


def test_upload_inserts_the_first_valid_copy(spark):
    rows = [(2, "https://a.test", '["bad'), (3, "https://a.test", '["ok"]'), (4, "https://a.test", '["bad'), (5, "https://b.test", '["bad'), (6, None, None)]
    b = spark.createDataFrame(rows, "row_no long, website_url string, platforms string")
    new_target, report = I.import_enriched(target(spark), b, mode="upload", as_of=AS_OF)
    got = {r["row_no"]: (r["outcome"], r["error"]) for r in report.collect()}
    assert got == {2: ("error", "Invalid JSON in platforms"), 3: ("inserted", None), 4: ("error", "Site already exists"),
                   5: ("error", "Invalid JSON in platforms"), 6: ("error", "Empty URL")}
    assert {r["website_url"] for r in new_target.collect()} == {"https://old.test", "https://a.test"}


def test_upsert_reports_every_row(spark):
    import pytest
    recs = spark.createDataFrame([(1, "https://old.test", "A"), (2, " https://old.test ", "B"), (3, "", "C"), (4, None, "D"), (5, "https://n.test", "E")],
                                 "row_no long, website_url string, platform string")
    new_target, report = I.upsert_sites(target(spark), recs, as_of=AS_OF)
    assert {r["row_no"]: (r["outcome"], r["error"]) for r in report.collect()} == {
        1: ("skipped", "Duplicate in batch"), 2: ("updated", None), 3: ("error", "Empty URL"), 4: ("error", "Empty URL"), 5: ("inserted", None)}
    assert {r["website_url"]: r["platform"] for r in new_target.collect()} == {"https://old.test": "B", "https://n.test": "E"}
    with pytest.raises(ValueError):
        I.upsert_sites(target(spark), recs.drop("row_no"))


def test_latest_crawl_counts_and_import_urls(spark):
    pages = spark.createDataFrame([(1, "https://a.test", "<p>gamma gamma</p>"), (2, "https://a.test", "<p>alpha alpha beta</p>"), (3, "https://old.test", "<p>shop</p>")],
                                  "page_id long, url string, html string")
    req = spark.createDataFrame([(2, "https://a.test"), (3, "ftp://x"), (4, None), (5, "https://old.test"), (6, " https://a.test"), (7, "https://none.test")], "row_no long, url string")
    good, _ = I.enrich_batch(req, pages, as_of=AS_OF)
    assert {r["row_no"]: r["tags"] for r in good.collect()} == {2: "alpha, beta", 5: "shop", 6: "alpha, beta"}
    new_target, report = I.import_urls(target(spark), req, pages, as_of=AS_OF)
    got = {r["row_no"]: r["outcome"] for r in report.collect()}
    assert got == {2: "skipped", 3: "error", 4: "error", 5: "updated", 6: "inserted", 7: "error"}
    assert {r["website_url"]: r["heat_score"] for r in new_target.collect()} == {"https://old.test": 7.0, "https://a.test": None}


def test_a_damaged_delta_folder_is_not_taken_for_an_empty_one(spark, tmp_path):
    import pytest
    from pyspark.errors import AnalysisException
    from sitelens.streaming import streams as ST
    base = str(tmp_path / "base")
    I.conform(target(spark)).write.parquet(base)
    assert ST.current_catalog(spark, base, str(tmp_path / "none")).count() == 1
    (tmp_path / "bad").mkdir()
    with pytest.raises(AnalysisException):
        ST.current_catalog(spark, base, str(tmp_path / "bad"))
