"""Upserts write only what they touch, survive crashes and races, and read as a full rewrite would."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import feeds
from tidemark.sources import sinks
from tidemark.sources.versions import VersionedTable

KIND = "k long, s string, v string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def test_one_row_writes_one_bucket(spark, tmp_path):
    path = str(tmp_path / "t")
    t = VersionedTable(spark, path, ["k"], KIND, 8)
    assert t.upsert(spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("s"), F.lit("1").alias("v"))) == 1
    before = files(path)
    assert t.upsert(spark.createDataFrame([(7, "b", "2")], KIND)) == 2
    new = files(path) - before
    assert len(new) == 1 and len(before) == 8
    got = {r.k: r.s for r in t.read().collect()}
    assert len(got) == 1000 and got[7] == "b" and got[8] == "a"
    assert {r.k: r.s for r in t.read(1).collect()}[7] == "a"  # the version before is still there


def test_same_rows_as_a_full_rewrite(spark, tmp_path):
    rng, path = random.Random(1), str(tmp_path / "t")
    t = VersionedTable(spark, path, ["k", "s"], KIND, 4)
    want = spark.createDataFrame([], KIND)
    for step in range(7):
        batch = [(rng.choice([None, *range(12)]), rng.choice(["x", "y", None]), f"{step}-{i}") for i in range(rng.randint(0, 9))]
        new = spark.createDataFrame(batch, KIND)
        t.upsert(new)
        want = spark.createDataFrame(feeds.upsert(want, new, ["k", "s"]).collect(), KIND)
        if step in (3, 5):
            top = t.version()
            assert t.compact(2) == top + 1 and t.compact(3) is None
        assert rows(VersionedTable(spark, path).read()) == rows(want)
    bases = [p for p in t.parts() if p.base]
    assert bases and len(t.parts()) <= 4 * 3
    before = len(files(path))
    assert t.vacuum(3600) == 0 and t.vacuum(-60) > 0 and len(files(path)) < before
    assert rows(t.read()) == rows(want)


def test_a_crash_before_the_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    t = VersionedTable(spark, path, ["k"], KIND, 4)
    t.upsert(spark.createDataFrame([(1, "a", "1"), (2, "a", "1")], KIND))
    want = rows(t.read())
    with monkeypatch.context() as m:
        m.setattr(t, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            t.upsert(spark.createDataFrame([(1, "lost", "2")], KIND))
    assert t.version() == 1 and rows(VersionedTable(spark, path).read()) == want
    assert t.vacuum(-60) == 1
    t.upsert(spark.createDataFrame([(1, "b", "2")], KIND))
    assert [r[1] for r in rows(t.read())] == ["b", "a"]


def test_writers_that_meet_both_count(spark, tmp_path):
    path = str(tmp_path / "t")
    a = VersionedTable(spark, path, ["k"], KIND, 4)
    b = VersionedTable(spark, path)
    staged = a._stage(spark.createDataFrame([(1, "a", "1", False)], KIND + ", _gone boolean").withColumn("bucket", a._bucket()))
    b.upsert(spark.createDataFrame([(1, "b", "1"), (2, "b", "1")], KIND))
    assert not a._claim(1, [])  # taken
    assert a.commit(*staged) == 2
    assert rows(b.read()) == [(1, "a", "1"), (2, "b", "1")]
    # a compaction that read version 2 while version 3 came does not hide it
    real, held = b._stage, []

    def slow(df):
        out = real(df)
        if not held:
            held.append(a.upsert(spark.createDataFrame([(1, "late", "1")], KIND)))
        return out

    b._stage = slow
    assert b.compact(1) == 4 and held == [3]
    assert rows(a.read()) == [(1, "late", "1"), (2, "b", "1")]


def test_removed_keys_and_refused_schemas(spark, tmp_path):
    path = str(tmp_path / "t")
    t = VersionedTable(spark, path, ["k"], KIND, 2)
    assert rows(t.read()) == []
    t.upsert(spark.createDataFrame([(1, "a", "1"), (2, "a", "1")], KIND))
    t.upsert(spark.createDataFrame([(1, "x", "9"), (2, "a", "2")], KIND), gone=F.col("s") == "x")
    assert rows(t.read()) == [(2, "a", "2")]
    t.upsert(spark.createDataFrame([(2, "x", "9")], KIND), gone=F.col("s") == "x")
    t.compact(1)
    assert rows(t.read()) == []
    t.upsert(spark.createDataFrame([(2, "a", "1"), (2, "b", "0")], KIND), order="v")
    assert rows(t.read()) == [(2, "a", "1")]
    with pytest.raises(ValueError):
        VersionedTable(spark, path, ["s"])
    with pytest.raises(ValueError):
        VersionedTable(spark, str(tmp_path / "u"), ["z"], KIND)


def test_fan_out_of_a_stream_repeats_only_what_failed(spark, tmp_path):
    src, down, written = str(tmp_path / "in"), [True], []
    spark.range(5).selectExpr("id k", "'a' s", "'1' v").write.parquet(src)

    def remote(df, batch):
        if down[0]:
            raise TimeoutError("429")
        written.append((batch, df.count()))

    targets = {
        "local": sinks.Sink("local", lambda: True, sinks.batch_folder_sink(str(tmp_path / "local"))),
        "remote": sinks.Sink("remote", lambda: True, remote),
        "wiki": sinks.Sink("wiki", lambda: True, sinks.upsert_sink(spark, str(tmp_path / "wiki"), ["k"], buckets=2)),
    }

    def run():
        each = sinks.batch_fan_out(spark, targets, ["local", "remote", "wiki"], str(tmp_path / "records"))
        q = spark.readStream.schema(KIND).parquet(src).writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(60)

    with pytest.raises(Exception, match="not complete"):
        run()
    first = files(str(tmp_path / "wiki"))
    stamp = os.path.getmtime(tmp_path / "local" / "batch=0" / "_SUCCESS")
    assert VersionedTable(spark, str(tmp_path / "wiki")).version() == 1 and written == []
    down[0] = False
    run()  # the same batch again: only the sink that failed writes
    assert written == [(0, 5)] and files(str(tmp_path / "wiki")) == first and os.path.getmtime(tmp_path / "local" / "batch=0" / "_SUCCESS") == stamp
    spark.createDataFrame([(1, "b", "2"), (9, "b", "2")], KIND).write.mode("append").parquet(src)
    run()
    assert written == [(0, 5), (1, 2)] and sinks.read_upserted(spark, str(tmp_path / "wiki")).count() == 6
    assert spark.read.parquet(str(tmp_path / "local")).count() == 7
    with pytest.raises(ValueError):
        sinks.batch_fan_out(spark, targets, ["none"], str(tmp_path / "records"))


def test_vault_rows_without_a_folder_go_to_the_inbox(spark):
    got = sinks.vault_rows(spark.createDataFrame([("a/b/c.md",), ("d.md",), ("/e.md",)], "path string")).collect()
    assert [r.folder for r in got] == ["a/b", "inbox", "inbox"]
