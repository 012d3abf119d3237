"""Stream sinks whose cost doesn't grow with their age: the key index of imports, merged usage logs."""

import random

import pytest

from sitelens.session import entries
from sitelens.streaming import streams as ST
from sitelens.streaming import url_index as X


def urls(spark, names):
    return spark.createDataFrame([(n,) for n in names], "website_url string")


class Import:
    """Batches as the import stream runs them: candidates, insert what is new, advance."""

    def __init__(self, spark, path, base, **how):
        self.spark, self.deltas = spark, f"{path}/deltas"
        urls(spark, base).write.parquet(f"{path}/base")
        self.index = X.UrlIndex(spark, f"{path}/keys", f"{path}/base", self.deltas, **how)
        self.known, self.read = set(base), []

    def run(self, batch_id, names):
        state = self.index.state(batch_id)
        batch = urls(self.spark, names)
        near = self.index.candidates(batch, state, batch_id)
        found = {r["website_url"] for r in near.collect()}
        self.read.append(near.count())
        assert set(names) & found == set(names) & self.known
        fresh = sorted(set(names) - found)
        urls(self.spark, fresh).coalesce(1).write.mode("overwrite").parquet(f"{self.deltas}/batch_id={batch_id}")
        self.index.advance(state, batch_id)
        self.known |= set(fresh)
        return state


def test_key_index_through_flushes_splits_and_replays(spark, tmp_path):
    r = random.Random(0)
    job = Import(spark, tmp_path, [f"https://s{i}" for i in range(60)], bucket_rows=20, recent_rows=30)
    states = []
    for b in range(8):
        names = [f"https://s{r.randrange(400)}" for _ in range(25)]
        before = set(job.known)
        states.append(job.run(b, names))
        if b in (1, 2, 4, 6):  # the batch failed after its writes and is run again
            job.known = before
            assert job.run(b, names) == states[-1]
    assert states[0].generation == -1 and states[-1].generation > 0 and states[-1].buckets > states[0].buckets
    assert any(s.flushed > 0 for s in states)


def test_rows_read_do_not_grow_with_the_catalog(spark, tmp_path):
    read = []
    for n in (2_000, 40_000):
        job = Import(spark, f"{tmp_path}/{n}", [f"https://s{i}" for i in range(n)], bucket_rows=250, recent_rows=10_000)
        job.run(0, [f"https://s{i * 37}" for i in range(6)] + ["https://new"])
        read.append(job.read[-1])
    assert read[1] <= 2 * 7 * 250 and read[1] < 3 * read[0] < n // 2


def test_an_empty_catalog_and_empty_batches(spark, tmp_path):
    job = Import(spark, tmp_path, [], bucket_rows=4, recent_rows=3)
    job.run(0, [])
    job.run(1, ["a", "b", "c", "d"])
    job.run(2, [])
    job.run(3, ["a", "d", "e"])
    assert job.known == set("abcde")


def test_index_is_rebuilt_where_a_state_is_missing(spark, tmp_path):
    job = Import(spark, tmp_path, ["a", "b"])
    job.run(0, ["c"])
    job.index.path = f"{tmp_path}/other"
    job.run(1, ["c", "d"])
    assert job.known == set("abcd")


@pytest.mark.parametrize("fail", [None, "base", "pointer"])
def test_usage_logs_are_merged(spark, tmp_path, fail, monkeypatch):
    import datetime as dt
    r = random.Random(1)
    sink = ST.UsageSink(str(tmp_path), every=4)
    want, t0 = {}, dt.datetime(2024, 1, 1)
    for b in range(14):
        changed = {s: (t0 + dt.timedelta(days=b), float(b), b + 1) for s in r.sample(range(10), 3)}
        batch = spark.createDataFrame([(s, *v) for s, v in changed.items()], "site_id long, ts timestamp, amount double, n long").coalesce(1)
        if fail and b == 7:  # the second merge breaks off, and the batch comes again
            real = spark.createDataFrame

            def broken(*a, **k):
                raise RuntimeError("lost")

            with monkeypatch.context() as m:
                if fail == "pointer":
                    m.setattr(type(spark), "createDataFrame", broken)
                else:
                    m.setattr(ST.UsageSink, "_newest", broken)
                with pytest.raises(RuntimeError):
                    sink.write(batch, b)
            assert real is not None
        sink.write(batch, b)
        if b % 3 == 0:
            sink.write(batch, b)  # a replay
        want |= changed
        if b in (3, 7, 13):
            got = {x["site_id"]: (x["amount"], x["n"]) for x in sink.totals(spark).collect()}
            assert got == {s: (a, n) for s, (_, a, n) in want.items()}
        assert len(entries(spark, f"{tmp_path}/log")) <= 2 * sink.every
    assert len(entries(spark, f"{tmp_path}/base")) == 2
