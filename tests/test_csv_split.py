"""Split-parallel CSV reading equals Spark's own one-task reader, row by row."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from sitelens.sources import csv_io, csv_split


def one_task(spark, path):
    df = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    n = len(df.columns)
    return [(i + 2, *r[:n]) for i, r in enumerate(df.collect())]


def text(seed, rows, end="\n"):
    r = random.Random(seed)
    value = lambda: "".join(r.choice(["a", "b", " ", ",", '"', "\n", "\r\n", "é", '""', ""]) for _ in range(r.randrange(8)))
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(["website_url", "x,y", 'with "quotes"'])
    for i in range(rows):
        w.writerow([f"https://s{i}.test", value(), value()])
        if i % 9 == 0:
            out.write(end)
    return out.getvalue()


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "3k", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_tasks_give_the_one_task_rows(spark, tmp_path, small_splits, end):
    path = tmp_path / "in" / "big.csv"
    path.parent.mkdir()
    path.write_text(text(1, 2_000, end), newline="")
    got = csv_io.read_csv_rows(spark, str(path.parent))
    assert spark.read.text(str(path.parent)).rdd.getNumPartitions() > 10
    rows = sorted((r["row_no"], r["website_url"], r["x,y"], r['with "quotes"']) for r in got.collect() if r["x,y"] is not None and r['with "quotes"'] is not None)
    want = sorted(r for r in one_task(spark, str(path)) if None not in r)
    assert len(want) > 1_000 and rows == want
    assert sorted(r["row_no"] for r in got.collect()) == list(range(2, 2_002))


def test_files_restart_their_numbers(spark, tmp_path, small_splits):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.csv").write_text(text(k, 300), newline="")
    got = csv_io.read_csv_rows(spark, str(tmp_path / "in")).groupBy("source_file").agg(F.min("row_no"), F.max("row_no"), F.countDistinct("row_no")).collect()
    assert [tuple(r)[1:] for r in got] == [(2, 301, 300)] * 3


def test_quotes_inside_values_open_nothing(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('website_url,a\n5" pipe,x\n"a""b",""\n"c"\n\nlast,"open, \n end"\n,\n')
    got = {r["row_no"]: (r["website_url"], r["a"]) for r in csv_io.read_csv_rows(spark, str(path)).collect()}
    assert got == {i: (a, b) for i, a, b in one_task(spark, str(path))}
    assert len(got) == 5


def test_states_of_a_line():
    for line, inside, want in [("a,b", False, False), ("a,b", True, True), ('a,"b', False, True), ('b"', True, False), ('"a""', False, True), ('"a"""', False, False), ('a"b', False, False),
                               ('","', True, True), ('",",",', True, False), ('a""b', False, False), ('"",""', False, False), ('""', True, True), ('', True, True)]:
        assert csv_split.ends_inside(line, inside) is want, (line, inside)


def test_no_rows(spark, tmp_path):
    (tmp_path / "e.csv").write_text("website_url,a\n")
    assert csv_io.read_csv_rows(spark, str(tmp_path / "e.csv")).count() == 0
