"""Heat, usage, quotas, roll-back and staleness."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sitelens.operators import heat as H
from sitelens.operators import layout

AS_OF = dt.datetime(2002, 1, 1)
SCHEMA = ("id long, website_url string, heat_score double, last_used_at timestamp_ntz, "
          "last_enriched_at timestamp_ntz, site_metadata map<string,string>")


def test_heat_report(spark):
    rows = [(i, f"u{i}", h, None, None, None) for i, h in
            enumerate([None, 0.0, 10.0, 29.9, 30.0, 69.9, 70.0, 100.0, -5.0])]
    r = H.heat_report(spark.createDataFrame(rows, SCHEMA)).first()
    assert (r["total"], r["seeded"], r["hot"], r["warm"], r["cold"]) == (9, 7, 2, 2, 3)
    assert r["seeded_pct"] == round(7 / 9 * 100, 1)
    assert r["hot_pct"] == round(2 / 7 * 100, 1) and r["cold_pct"] == round(3 / 7 * 100, 1)
    empty = H.heat_report(spark.createDataFrame([], SCHEMA)).first()
    assert empty["total"] == 0 and empty["seeded_pct"] is None


def test_apply_usage(spark):
    t0 = dt.datetime(2001, 1, 1)
    sites = spark.createDataFrame([(1, "a", None, None, None, None), (2, "b", 5.0, t0, None, None),
                                   (3, "c", 1.0, t0, None, None)], SCHEMA)
    usage = spark.createDataFrame([(1, t0, 1.0), (1, t0 + dt.timedelta(days=2), 2.0),
                                   (2, t0 - dt.timedelta(days=1), 1.5)],
                                  "site_id long, ts timestamp_ntz, amount double")
    got = {r["id"]: (r["heat_score"], r["last_used_at"]) for r in H.apply_usage(sites, usage).collect()}
    assert got[1] == (3.0, t0 + dt.timedelta(days=2))
    assert got[2] == (6.5, t0)
    assert got[3] == (1.0, t0)


def test_search_results_touch_sites_without_heat(spark):
    t0 = dt.datetime(2001, 1, 1)
    sites = spark.createDataFrame([(1, "a", None, None, None, None), (2, "b", 5.0, t0, None, None), (3, "c", 1.0, t0, None, None)], SCHEMA)
    found = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id long")
    got = {r["id"]: (r["heat_score"], r["last_used_at"]) for r in H.apply_usage(sites, H.usage_from_results(found, as_of=AS_OF)).collect()}
    assert got == {1: (None, AS_OF), 2: (5.0, AS_OF), 3: (1.0, t0)}


def test_more_cold_than_seeded(spark):
    rows = [(i, f"u{i}", 10.0 if i < 16 else 0.0, None, None, None) for i in range(19)]
    assert H.heat_report(spark.createDataFrame(rows, SCHEMA)).first()["cold_pct"] == round(19 / 16 * 100, 1) == 118.8


def test_apply_usage_twice_equals_once_combined(spark):
    t0 = dt.datetime(2001, 1, 1)
    sites = spark.createDataFrame([(1, "a", None, None, None, None)], SCHEMA)
    u1 = spark.createDataFrame([(1, t0, 1.0)], "site_id long, ts timestamp_ntz, amount double")
    u2 = spark.createDataFrame([(1, t0 + dt.timedelta(days=1), 2.0)], "site_id long, ts timestamp_ntz, amount double")
    a = H.apply_usage(H.apply_usage(sites, u1), u2).first()
    b = H.apply_usage(sites, u1.unionByName(u2)).first()
    assert (a["heat_score"], a["last_used_at"]) == (b["heat_score"], b["last_used_at"])


def test_global_positions(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    out = layout.global_positions(df, [F.col("k")]).collect()
    assert sorted((r["k"], r["pos"]) for r in out) == [(k, k + 1) for k in range(1000)]
    part = layout.global_positions(df, [-F.col("k")], ranges=[(1, 3), (500, 502)]).collect()
    assert sorted((r["pos"], r["k"]) for r in part) == [(1, 999), (2, 998), (3, 997), (500, 500), (501, 499), (502, 498)]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_global_positions_of_many_wide_rows(spark, adaptive):
    """Every position of 2 million rows with NULLs and ties equals row_number's, also after a shuffle."""
    n = 2_000_000
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        wide = (spark.range(0, n, 1, 12).select("id", F.when(F.col("id") % 10 > 0, F.pmod(F.xxhash64("id"), F.lit(1000)) / 7.0).alias("heat"),
                                                F.repeat(F.col("id").cast("string"), 8).alias("text"))
                .repartition(9, "id"))
        order = [-F.col("heat"), F.col("id")]
        got = layout.global_positions(wide, order)
        want = wide.select("id", F.row_number().over(Window.orderBy(F.desc_nulls_first("heat"), "id")).alias("want"))
        r = got.join(want, "id").agg(F.count("*"), F.count_if(F.col("pos") != F.col("want")), F.max("pos")).first()
        assert tuple(r) == (n, 0, n)
        page = layout.global_positions(wide, order, ranges=[(1_234_001, 1_234_050)])
        assert page.join(want, "id").filter("pos <> want").count() == 0 and page.count() == 50
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_positions_by_refinement(spark):
    """Pages found by counting equal the full ranking; overlapping ranges give each row once, ranges past the end none."""
    df = spark.range(0, 20_000).select(F.when(F.col("id") % 3 > 0, F.pmod(F.xxhash64("id"), F.lit(50)) / 7.0).alias("heat"), "id").repartition(5)
    order = [-F.col("heat"), F.col("id")]
    want = {r["id"]: r["pos"] for r in layout.global_positions(df, order).collect()}
    assert sorted(want.values()) == list(range(1, 20_001))
    for rows in (700,):
        for ranges in ([(1, 3), (3, 9), (5_000, 5_002), (19_999, 20_500)], [(20_001, 20_010), (7, 4), (-5, 0)], [(100, 900)]):
            part = layout.global_positions(df, order, ranges=ranges, rows=rows).collect()
            assert {r["id"]: r["pos"] for r in part} == {i: p for i, p in want.items() if any(a <= p <= b for a, b in ranges)}
            assert len(part) == len({r["id"] for r in part})
    assert layout.global_positions(df.limit(0), order, ranges=[(1, 5)]).count() == layout.global_positions(df.limit(0), order).count() == 0


def test_largest_sort_stays_the_same_with_more_rows(spark):
    """Twenty times the rows give twenty times the parts, not larger ones; a page sorts no more either way."""
    for n in (10_000, 200_000):
        df = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("k"), "id")
        sorted_in = layout.global_positions(df, [F.col("k"), F.col("id")], rows=2_000).groupBy(F.spark_partition_id()).count()
        assert sorted_in.count() > 0
        keyed = df.withColumn("_key", F.struct(F.col("k").alias("k0"), F.col("id").alias("k1")))
        placed = keyed.repartitionByRange(-(-n // 2_000), "_key").groupBy(F.spark_partition_id().alias("p")).count()
        assert placed.agg(F.max("count")).first()[0] < 2 * 2_000
        _, before, inside = layout._interval(keyed, n, n // 2, n // 2 + 9, 2_000)
        assert inside <= 2_000 and before < n // 2 <= before + inside


def test_quota_buckets(spark):
    rows = [(i, f"u{i}", None if i % 2 else 0.0, None, None, None) for i in range(10)]
    rows.append((99, "hot", 50.0, None, None, None))
    out = H.quota_buckets(spark.createDataFrame(rows, SCHEMA)).orderBy("pos").collect()
    assert [r["bucket"] for r in out] == ["hot"] * 2 + ["warm"] * 5 + ["cold"] * 3
    assert [r["id"] for r in out] == list(range(10))
    few = H.quota_buckets(spark.createDataFrame(rows, SCHEMA), n=3, seed=7).collect()
    assert sorted(r["bucket"] for r in few) == ["cold", "hot", "warm"]


def test_rollback(spark):
    rows = [(1, "a", 50.0, AS_OF, None, {"seeded_at": "x", "k": "v"}),
            (2, "b", 40.0, AS_OF, None, {"k": "v"}),
            (3, "c", 30.0, AS_OF, None, {"seeded_at": "..."}),
            (4, "d", 20.0, AS_OF, None, None)]
    got = {r["id"]: r for r in H.rollback_marked(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1]["heat_score"], got[1]["last_used_at"], got[1]["site_metadata"]) == (0.0, None, {"k": "v"})
    assert got[2]["heat_score"] == 40.0 and got[2]["site_metadata"] == {"k": "v"}
    assert got[3]["site_metadata"] is None and got[3]["heat_score"] == 0.0
    assert got[4]["heat_score"] == 20.0


def test_stale(spark):
    rows = [(1, "a", None, None, AS_OF - dt.timedelta(days=29, hours=23), None),
            (2, "b", None, None, AS_OF - dt.timedelta(days=30), None),
            (3, "c", None, None, None, None)]
    got = sorted(r["id"] for r in H.stale_sites(spark.createDataFrame(rows, SCHEMA), as_of=AS_OF).collect())
    assert got == [2, 3]


def test_mark_then_rollback(spark):
    rows = [(i, f"u{i}", None if i % 2 else 0.0, None, None, {"k": "v"} if i == 3 else None) for i in range(10)]
    rows.append((99, "keep", 50.0, AS_OF, None, None))
    sites = spark.createDataFrame(rows, SCHEMA)
    b = H.quota_buckets(sites, seed=11)
    marked = H.mark_buckets(sites, b, as_of=AS_OF)
    got = {r["id"]: r for r in marked.collect()}
    for r in b.collect():
        assert got[r["id"]]["heat_score"] == {"hot": 70.0, "warm": 30.0, "cold": 0.0}[r["bucket"]]
        assert got[r["id"]]["last_used_at"] == AS_OF and "seeded_at" in got[r["id"]]["site_metadata"]
    assert got[3]["site_metadata"]["k"] == "v"
    assert got[99]["heat_score"] == 50.0 and got[99]["site_metadata"] is None
    back = {r["id"]: r for r in H.rollback_marked(marked).collect()}
    assert all(back[i]["heat_score"] == 0.0 and back[i]["last_used_at"] is None for i in range(10))
    assert back[3]["site_metadata"] == {"k": "v"} and back[99]["heat_score"] == 50.0
