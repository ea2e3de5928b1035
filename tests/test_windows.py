"""Greedy windows give what a loop over the segments gives, however the segments are dealt."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import segments as S
from tidemark.operators import windows as W

KIND = "media_id long, seq int, start double, duration double, text string"


def plain(rows, window):
    out = []
    for m in sorted({r[0] for r in rows}, key=lambda x: (x is not None, x)):
        group, anchor = [], None
        none = lambda v: (v is not None, v)
        for r in sorted((r for r in rows if r[0] == m), key=lambda r: [none(v) for v in r[1:]]):
            if group and anchor is not None and r[2] is not None and r[2] - anchor > window:
                out.append((m, group))
                group = []
            if not group:
                anchor = r[2]
            group.append(r)
        out.append((m, group))
    number: dict = {}
    got = []
    for m, g in out:
        number[m] = number.get(m, -1) + 1
        last = g[-1]
        end = None if last[2] is None or last[3] is None else last[2] + last[3]
        got.append((m, number[m], g[0][2], end, "\n".join(t for t in ((r[4] or "").strip(" ") for r in g) if t)))
    return got


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("ordered", [True, False])
def test_as_a_loop(spark, parts, ordered):
    rng = random.Random(parts)
    rows = []
    for m in [*range(6), None]:
        t = 0.0
        for k in range(rng.choice([1, 2, 30, 400])):
            t = t + rng.choice([0, 1.5, 3, 40.1]) if ordered else rng.uniform(0, 900)
            rows.append((m, k if rng.random() < 0.97 else k - 1, t if rng.random() < 0.97 else None, rng.choice([0.5, 2.0]), rng.choice(["a ", "", "b", None])))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        for window in (0.0, 10.0, 120.3, 1e9):
            got = sorted((tuple(r) for r in W.greedy_windows(spark.createDataFrame(rows, KIND), window).collect()), key=str)
            assert got == sorted(plain(rows, window), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)


def test_a_million_segments_of_one_medium(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("media_id"), F.col("id").cast("int").alias("seq"), (F.col("id") * 0.7).alias("start"), F.lit(0.5).alias("duration"), F.lit("x").alias("text"))
    got = W.numbered(df, 60.0).groupBy("group").agg(F.count("*").alias("n"), F.min("seq").alias("first")).orderBy("group").collect()
    starts = np.arange(n) * 0.7
    at, firsts = 0, []
    while at < n:
        firsts.append(at)
        at = int(W.next_place(starts, starts[at], 60.0))
    assert [r["first"] for r in got] == firsts and sum(r.n for r in got) == n and [r.group for r in got] == list(range(len(firsts)))


def test_sums_that_round_to_the_wrong_side():
    top = np.array([0.1, 0.2, 0.30000000000000004, 0.4])
    for anchor in top:
        for window in (0.1, 0.2, 0.3, 0.0):
            want = next((k for k, x in enumerate(top) if x - anchor > window), 4)
            assert W.next_place(top, anchor, window) == want


def test_empty_table(spark):
    assert W.greedy_windows(spark.createDataFrame([], KIND)).count() == 0 and S.segment_chunks(spark.createDataFrame([], KIND)).count() == 0
