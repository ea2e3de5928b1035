"""Similarity joins give what comparing all pairs gives."""

import random
import re
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import similarity as S
from tidemark.plans import registry

from .conftest import SF


def plain(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=30), st.text("abcd", max_size=30))
def test_ratio_is_that_of_matching_blocks(a, b):
    assert S.ratio(a, b) == pytest.approx(plain(a, b))


def test_first_of_equal_blocks(spark):
    for a, b in (("abxab", "ab"), ("ab", "abxab"), ("qabcd abcz", "abcd"), ("", "a"), ("", "")):
        assert S.ratio(a, b) == plain(a, b)
    rows = spark.createDataFrame([("ab", "abc"), (None, "x"), ("", "")], "a string, b string").select(S.block_ratio("a", "b").alias("r")).collect()
    assert [r.r for r in rows] == [0.8, None, 1.0]


def bent(rng, s, k):
    for _ in range(k):
        i = rng.randrange(len(s) + 1)
        s = rng.choice([s[:i] + rng.choice("abcx") + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice("abcx") + s[i + 1 :], s[: max(0, i - 2)] + s[i:]])
    return s


@pytest.mark.parametrize("t", [0.6, 0.75, 0.9, 1.0])
def test_no_pair_is_lost(t):
    rng, seen = random.Random(t), 0
    for _ in range(25):
        base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(1, rng.choice([6, 30, 90])))) for _ in range(8)]
        items = sorted({bent(rng, rng.choice(base), rng.randint(0, 6)) for _ in range(20)} - {""})
        texts = sorted({bent(rng, rng.choice(base), rng.randint(0, 9)) for _ in range(60)} - {""})
        left, item = S.Index(items, t).pairs(texts)
        want = {(i, j) for i, x in enumerate(texts) for j, y in enumerate(items) if plain(x, y) >= t}
        assert want <= set(zip(left.tolist(), item.tolist()))
        seen += len(want)
    assert seen > 40


def test_join_with_many_blocks_and_odd_rows(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(40)) for _ in range(6)]
    texts = [bent(rng, rng.choice(base), rng.randint(0, 4)) for _ in range(80)] + ["", None, "q" * 4_000, "q" * 3_990, base[0], base[0]]
    items = [bent(rng, rng.choice(base), rng.randint(0, 3)) for _ in range(30)] + ["", None, "q" * 4_000, base[0]]
    a, b = spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(t,) for t in items], "other string")
    got = {(r.text, r.other): r.ratio for r in S.near_pairs(a, b, 0.9, most=1000).collect()}
    short = [t for t in texts if t and len(t) < 100]
    want = {(x, y): plain(x, y) for x in short for y in items if y and len(y) < 100 and plain(x, y) >= 0.9}
    assert {k: pytest.approx(v) for k, v in want.items()} == {k: v for k, v in got.items() if len(k[0]) < 100}
    assert got["q" * 4_000, "q" * 4_000] == 1.0 and got["q" * 3_990, "q" * 4_000] > 0.99
    assert S.near_pairs(a.limit(0), b).count() == 0 and S.near_pairs(a, b.limit(0)).count() == 0


def pieces(text, least=20):
    return {s.strip(" ") for s in re.split(r"(?<=[.!?])[ \t]+|\n", text or "") if len(s.strip(" ")) >= least}


def test_documents_by_benchmark(spark):
    """The query against all pairs of sentences; what a near copy of an item holds is found, too."""
    docs, items = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id): (r.equal, r.near, round(r.best, 6)) for r in registry.QUERIES["similarity_benchmark"](spark, SF).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    bench = [(r.item_id, pieces(r.text)) for r in items.collect()]
    texts, wanted = {s for _, t in rows for s in pieces(t)}, {s for _, p in bench for s in p}
    near: dict = {}
    for x in texts:
        for y in wanted:
            if 2 * min(len(x), len(y)) >= 0.9 * (len(x) + len(y)):
                m = SequenceMatcher(None, x, y, autojunk=False)
                if m.quick_ratio() >= 0.9 and m.ratio() >= 0.9:
                    near.setdefault(x, {})[y] = m.ratio()
    want = {}
    for i, t in rows:
        for j, p in bench:
            r = [max(near[x][y] for y in p if y in near[x]) for x in pieces(t) if any(y in p for y in near.get(x, ()))]
            if r:
                want[i, j] = (sum(v == 1 for v in r), sum(v < 1 for v in r), round(max([v for v in r if v < 1], default=0.0), 6))
    assert got == want and want
    item = items.first()
    copy = spark.createDataFrame([(1, "Start of it.\n" + item.text.replace("the", "teh", 1) + " An end.")], "doc_id long, text string")
    near = S.shared_sentences(copy, items, "doc_id", "item_id").where(F.col("item_id") == item.item_id).first()
    assert near.equal + near.near > 0


def test_candidates_are_few(spark):
    """The bounds leave hardly more pairs than there are results."""
    docs, items = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    left, right = S.sentences(docs, "doc_id", "text", 20), S.sentences(items, "item_id", "text", 20).withColumnRenamed("text", "other")
    pairs = left.select("text").distinct().count() * right.select("other").distinct().count()
    assert S.candidates(left, right).count() < pairs / 1000
