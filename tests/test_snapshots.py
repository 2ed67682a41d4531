"""Compacted runs and the progress stream: crashes, restarts, late and repeated events."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import progress
from loomline.sources.snapshots import Conflict, Snapshots
from loomline.streaming import progress as live

SCHEMA = "k string, v int, note string, m map<string,int>"


def rows(rng, n, at):
    return [(rng.choice(["a", "b", "c", "d", "é", None]), rng.choice([None, at * 10 + rng.randint(0, 5)]), rng.choice(["x", "y", None]), {"n": at}) for _ in range(n)]


def model(every):
    """The row of each key with the largest (v, note), nulls first."""
    out = {}
    for k, v, note, _ in every:
        rank = (v is not None, v or 0, note is not None, note or "")
        if k not in out or rank > out[k][0]:
            out[k] = (rank, (k, v, note))
    return sorted(map(str, (r for _, r in out.values())))


def read(s):
    return sorted(str((r["k"], r["v"], r["note"])) for r in s.read().collect())


def test_runs_and_snapshots(spark, tmp_path):
    rng = random.Random(1)
    s = Snapshots(spark, str(tmp_path / "t"), SCHEMA, ["k"], ["v"], parts=3)
    assert s.read().collect() == [] and s.compact()["number"] == 0
    every = []
    for run in range(7):
        new = rows(rng, 12, run)
        every += new
        s.append(spark.createDataFrame(new, SCHEMA), run)
        assert read(s) == model(every)
        if run % 3 == 2:
            s.compact()
            assert read(s) == model(every)
            # One version of each partition, and no run.
            assert len(s.scanned()) == len({p.rsplit("=")[1] for p in s.scanned()}) <= 3
    assert len([p for p in s.scanned() if "/runs/" in p]) == 1
    s.append(spark.createDataFrame([("a", 999, "z", None)], SCHEMA), "last")
    s.append(spark.createDataFrame([("a", 998, "z", None)], SCHEMA), "last")  # a run that is repeated replaces itself
    assert [r["v"] for r in s.read().filter("k = 'a'").collect()] == [998]


def test_only_touched_partitions_are_written_again(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "t"), SCHEMA, ["k"], ["v"], parts=16)
    s.append(spark.createDataFrame([(f"k{i}", i, None, None) for i in range(200)], SCHEMA), 1)
    before = s.compact()["parts"]
    s.append(spark.createDataFrame([("k7", 1000, None, None)], SCHEMA), 2)
    after = s.compact()["parts"]
    assert len(before) == 16 and sum(before[p] != after[p] for p in before) == 1 and s.read().count() == 200
    assert len(list((tmp_path / "t/versions").iterdir())) == 2


def test_a_crash_leaves_the_old_snapshot_valid(spark, tmp_path, monkeypatch):
    s = Snapshots(spark, str(tmp_path / "t"), SCHEMA, ["k"], ["v"], parts=2)
    s.append(spark.createDataFrame([("a", 1, None, None), ("b", 1, None, None)], SCHEMA), 1)
    s.compact()
    s.append(spark.createDataFrame([("a", 2, None, None), ("c", 2, None, None)], SCHEMA), 2)
    want = read(s)
    with monkeypatch.context() as m:  # after the data, before the manifest
        m.setattr(Snapshots, "_commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            s.compact()
    assert s.manifest()["number"] == 1 and read(s) == want and len(list((tmp_path / "t/versions").iterdir())) == 2
    with monkeypatch.context() as m:  # after the manifest, before old files go
        m.setattr(Snapshots, "clean", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            s.compact()
    assert s.manifest()["number"] == 2 and read(s) == want and not any("/runs/" in p for p in s.scanned())
    (tmp_path / "t/runs/3").mkdir()  # a run that was not written to its end
    assert read(s) == want
    s.clean()
    assert read(s) == want and len(list((tmp_path / "t/versions").iterdir())) <= 2


def test_the_slower_of_two_compactions_changes_nothing(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "t"), SCHEMA, ["k"], ["v"])
    s.append(spark.createDataFrame([("a", 1, None, None)], SCHEMA), 1)
    old = s.manifest()
    s.compact()
    with pytest.raises(Conflict):
        s._commit({"number": old["number"] + 1, "parts": {}, "runs": []})
    assert read(s) == ["('a', 1, None)"]


def events(rng, n, first):
    t = lambda x: datetime.datetime.fromtimestamp(x, datetime.timezone.utc)
    out = []
    for i in range(n):
        status = rng.choice(["completed", "failed", "skipped"])
        out.append((f"f{rng.randint(0, 9)}", status, float(i), f"e{first + i}" if status == "failed" else None, t(rng.randint(0, 40))))
    return out


def test_a_stream_that_is_stopped_goes_on(spark, tmp_path):
    """Events late and in ties over many batches and three calls, one of which fails after a batch was stored."""
    rng = random.Random(3)
    raw, out, check = (str(tmp_path / x) for x in ("raw", "out", "check"))
    every = []

    def arrive(k):
        new = events(rng, 30, 100 * k)
        every.extend(new)
        spark.createDataFrame(new, progress.SCHEMA).repartition(4).write.mode("append").parquet(raw)

    def follow():
        stream = spark.readStream.schema(progress.SCHEMA).option("maxFilesPerTrigger", "1").parquet(raw)
        live.follow(stream, out, check, compact_every=3, parts=2).awaitTermination()

    def same():
        batch = live.states(spark.createDataFrame(every, progress.SCHEMA))
        assert sorted(map(str, live.store(spark, out).read().collect())) == sorted(map(str, batch.collect()))

    arrive(0)
    follow()
    same()
    arrive(1)
    append, calls = Snapshots.append, []

    def broken(self, rows, run):
        append(self, rows, run)
        calls.append(run)
        if len(calls) == 2:
            raise RuntimeError("lost")

    Snapshots.append = broken
    try:
        with pytest.raises(Exception, match="lost"):
            follow()
    finally:
        Snapshots.append = append
    follow()
    same()
    follow()  # nothing new
    same()
    latest = {r["file"]: (r["status"], r["ts"]) for r in progress.latest(spark.createDataFrame(every, progress.SCHEMA)).collect()}
    got = {r["file"]: (r["status"], r["ts"]) for r in live.store(spark, out).read().collect()}
    assert got == latest
    assert live.store(spark, out).read().agg(F.sum("n_events")).first()[0] == len(every)


def test_a_snapshot_alone_is_read_as_it_is(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "t"), SCHEMA, ["k"], ["v"], parts=3)
    every = rows(random.Random(2), 40, 0)
    s.append(spark.createDataFrame(every, SCHEMA), 1)
    s.compact()
    plan = lambda: s.read().select("k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan() and "note" not in plan() and read(s) == model(every)
    # Other hash partitions on the same path: all rows are dealt anew.
    t = Snapshots(spark, str(tmp_path / "t"), SCHEMA, ["k"], ["v"], parts=5)
    for run in (2, 3):
        every += rows(random.Random(run), 3, run)
        t.append(spark.createDataFrame(every[-3:], SCHEMA), run)
        t.compact()
        assert read(t) == read(s) == model(every)
