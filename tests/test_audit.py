"""Digests find what a full outer join finds, and shuffle less; repair is idempotent and removes nothing."""

import random

from pyspark.sql import functions as F

from tidemark.operators import audit
from tidemark.operators.series import two_sided
from tidemark.sources.versions import VersionedTable

KIND = "k long, s string, v double"


def shuffled(spark):
    it, total = spark.sparkContext._jsc.sc().statusStore().executorList(False).iterator(), 0
    while it.hasNext():
        total += it.next().totalShuffleWrite()
    return total


def test_as_a_full_join(spark):
    rng = random.Random(1)
    for size in (0, 3, 300):
        left = [(rng.choice([None, *range(200)]), rng.choice(["a", None]), float(rng.randint(0, 2))) for _ in range(size)]
        right = [r for r in left if rng.random() < 0.9] + [(rng.choice([None, *range(250)]), "a", 1.0) for _ in range(size // 10)]
        a, b = spark.createDataFrame(left, KIND), spark.createDataFrame(right, KIND)
        for columns in ([], ["s", "v"]):
            want = {}
            for k in {r[0] for r in left + right}:
                x, y = (sorted((str(r) if columns else "" for r in rows if r[0] == k)) for rows in (left, right))
                if x != y:
                    want[k] = "missing" if not y else "orphan" if not x else "changed"
            assert {r.k: r.side for r in audit.reconcile(a, b, ["k"], columns).collect()} == want


def test_little_is_shuffled_when_little_differs(spark):
    rows = spark.range(200_000).select(F.col("id").alias("k"), F.lit("x").alias("s"), (F.col("id") * 0.5).alias("v"))
    other = rows.where("k <> 777").unionByName(spark.createDataFrame([(-5, "x", 0.0)], KIND))
    report, began = {}, shuffled(spark)
    assert sorted(tuple(r) for r in audit.reconcile(rows, other, ["k"], ["s", "v"], report).collect()) == [(-5, "orphan"), (777, "missing")]
    by_digest, began = shuffled(spark) - began, shuffled(spark)
    assert two_sided(rows, other, "k").count() == 2
    whole = shuffled(spark) - began
    assert report["coarse"] <= 2 and report["fine"] <= 2 and report["rows"] <= 20
    assert by_digest < whole, (by_digest, whole)


def test_repair_pushes_once_and_removes_nothing(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], KIND, 4)
    source = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (None, "c", 3.0)], KIND)
    table.upsert(spark.createDataFrame([(2, "old", 2.0), (9, "orphan", 9.0)], KIND))
    assert audit.repair(source, table) == {"missing": 2, "changed": 1, "orphan": 1}
    version = table.version()
    assert audit.repair(source, table) == {"missing": 0, "changed": 0, "orphan": 1} and table.version() == version
    assert sorted(map(tuple, table.read().collect()), key=str) == sorted([(1, "a", 1.0), (2, "b", 2.0), (None, "c", 3.0), (9, "orphan", 9.0)], key=str)
