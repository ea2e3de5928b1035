"""Search of the nearest binary codes: its work, its index and its rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embeddings, hamming
from tidemark.llm.embeddings import sign_code, top_k


def nearest(asker, query, codes, ids, k, reach=10**6):
    """(distance, id) of the k nearest: ids[i] are those of codes[i]."""
    apart = np.bitwise_count(query[None, :] ^ codes).sum(1).tolist()
    return sorted((d, i) for d, of in zip(apart, ids) for i in of if d <= reach and i != asker)[:k]


def table(spark, bits, ids):
    return spark.createDataFrame(list(zip(ids, (bits * 2.0 - 1).tolist())), "id long, v array<double>").select("id", sign_code("v").alias("code"))


def packed(bits):
    return np.packbits(bits.astype(np.uint8), axis=1).view(np.uint64)


def crowd(rng, n, width):
    """n different codes, half of them near others, and their ids: one, two or three each."""
    bits = rng.integers(0, 2, (n, width))
    bits[n // 2 :] = bits[: n - n // 2] ^ (rng.random((n - n // 2, width)) < 0.04)
    bits = np.unique(bits, axis=0)
    count = rng.integers(1, 4, len(bits))
    return bits, np.split(rng.permutation(count.sum()), np.cumsum(count)[:-1])


def test_top_k_sends_no_probes(spark):
    """What is shuffled follows rows and queries: it was a row for every value within the radius of every segment of a query."""
    rng = np.random.default_rng(7)
    bits = rng.integers(0, 2, (3000, 64))
    df = table(spark, bits, range(3000))
    sc = spark.sparkContext
    sc.setJobGroup("top_k_work", "")
    try:
        got = top_k(df, df.where("id % 20 = 0").selectExpr("id as query_id", "code"), 10).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 1500
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("top_k_work") for s in tracker.getJobInfo(j).stageIds}
    assert 3000 < sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) < 100_000


@pytest.mark.parametrize("width, reach", [(64, 13), (64, 21), (128, 30), (128, 60), (768, 60), (768, 340)])
@pytest.mark.parametrize("index", [0, 1 << 60])
def test_part_against_all(monkeypatch, width, reach, index):
    """By the index and by comparing all, with a few pairs held at once; codes with several ids, and queries of their own ids."""
    monkeypatch.setattr(hamming, "INDEX", index)
    monkeypatch.setattr(hamming, "GROUP", 0)
    monkeypatch.setattr(hamming, "HELD", 500)
    monkeypatch.setattr(hamming, "BLOCK", 1 << 12)
    rng = np.random.default_rng(width + reach)
    bits, ids = crowd(rng, 800, width)
    ids = [sorted(x.tolist()) for x in ids]
    part = hamming.Part(packed(bits), np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])]))
    of = rng.integers(0, len(bits), 200)
    asker, queries = np.array([ids[i][0] for i in of]), packed(bits[of] ^ (rng.random((200, width)) < 0.02))
    far = rng.integers(reach - 5, reach + 1, 200).astype(np.int32)
    q, d, i = part.nearest(asker, queries, far, 6)
    assert (part.index is None) == (index > 0)
    for x in range(200):
        assert list(zip(d[q == x].tolist(), i[q == x].tolist())) == nearest(asker[x], queries[x], packed(bits), ids, 6, far[x])


def test_masks_cover_radii():
    for r, ball in enumerate(hamming.masks()):
        assert ball.tolist() == [v for v in range(1 << hamming.BITS) if v.bit_count() <= r]


def test_top_k_by_rounds(spark, monkeypatch):
    """Distances that begin short: those that are left go on until all rows are compared, and parts add up. Ids with several codes too."""
    monkeypatch.setattr(embeddings, "FEW", 0)
    monkeypatch.setattr(embeddings, "LEAST", 100)
    monkeypatch.setattr(embeddings, "_reaches", lambda kths, n, *_: [0, 4, n // 3, n])
    rng = np.random.default_rng(8)
    bits, ids = crowd(rng, 600, 64)
    rows = [(b, int(i)) for b, of in zip(bits, ids) for i in of]
    rows += [(bits[3] ^ (np.arange(64) < 2), int(ids[40][0]))]  # an id with two codes
    short = rng.integers(0, 2, (30, 20))
    df = table(spark, np.stack([b for b, _ in rows]), [i for _, i in rows]).union(table(spark, short, range(5000, 5030)))
    df = df.union(table(spark, bits[:1], [None])).withColumn("rank", F.lit("x"))
    asked = df.where("id % 9 = 0 or id >= 5000").selectExpr("id as query_id", "code")
    got = {}
    for r in sorted(top_k(df, asked, 5).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.distance, r.id))
    codes, names = packed(np.stack([b for b, _ in rows])), [[i] for _, i in rows]
    for x in {i for _, i in rows if i % 9 == 0}:
        own = [codes[j] for j, (_, i) in enumerate(rows) if i == x]
        assert got[x] == sorted(p for c in own for p in nearest(x, c, codes, names, 5))[:5]
    wide = packed(np.pad(short, ((0, 0), (0, 44))))
    for x in range(5000, 5030):
        assert got[x] == nearest(x, wide[x - 5000], wide, [[i] for i in range(5000, 5030)], 5)


def test_reaches():
    """Distances grow, the last is that of all rows, and none is searched twice."""
    few = embeddings._reaches([13] * 80 + [14] * 20, 64, 15_000_000, 750_000, 10, 18)
    assert few[-1] == 64 and few == sorted(set(few)) and 13 <= few[0] <= 14
    assert embeddings._reaches([64] * 5, 64, 4, 4, 10, 1) == [64]
    assert embeddings._reaches([300] * 9, 768, 10**7, 10**6, 10, 18)[0] == 300
