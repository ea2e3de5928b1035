"""One automaton for all lexicons: every occurrence, counted as separate searches would."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions.automaton import Automaton, leftmost, lexicon_hits
from tidemark.operators import classify, filters


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=5), min_size=1, max_size=10, unique=True), st.lists(st.text("abcé", max_size=600), min_size=1, max_size=5))
def test_every_occurrence_is_found(terms, texts):
    raw, keys = [t.encode() for t in texts], [t.encode() for t in terms]
    a = Automaton(keys)
    offsets = np.cumsum([0, *map(len, raw)])
    text, term, start = a.search(offsets, np.frombuffer(b"".join(raw), np.uint8))
    want = {(i, j, p) for i, x in enumerate(raw) for j, k in enumerate(keys) for p in range(len(x)) if x.startswith(k, p)}
    assert sorted(zip(text.tolist(), term.tolist(), (start - offsets[text]).tolist())) == sorted(want)
    taken = leftmost(text, term, start, a.lengths, a.borders)
    count = np.zeros((len(raw), len(keys)), int)
    np.add.at(count, (text[taken], term[taken]), 1)
    assert count.tolist() == [[x.count(k) for k in keys] for x in raw]


def test_long_terms_reach_over_lanes():
    a = Automaton([b"x" * 700, b"ab"])
    term, end = a.hits(np.frombuffer(b"ab" + b"x" * 1500 + b"ab", np.uint8))
    assert (term == 0).sum() == 801 and end[term == 1].tolist() == [2, 1504]


def test_empty_terms_are_refused():
    with pytest.raises(ValueError):
        Automaton([b""])


def test_hits_totals_and_first_places(spark):
    rows = [(0, "é the the the end"), (1, None), (2, ""), (3, "of the"), (4, "THE")]
    groups = {"a": ("the the", "end", "end"), "b": ("the",), "none": ()}
    got = {r.i: r.f for r in spark.createDataFrame(rows, "i int, t string").select("i", lexicon_hits("t", groups).alias("f")).collect()}
    assert got[1] is None
    assert tuple(got[0].a) == (2, 3, 2) and tuple(got[0].b) == (1, 3, 2) and tuple(got[0].none) == (0, 0, -1)
    assert tuple(got[3].b) == (1, 1, 3) and tuple(got[4].b) == tuple(got[2].a) == (0, 0, -1)


def test_arrays_of_texts(spark):
    df = spark.createDataFrame([(["a b", None, "b b"],), ([],), (None,)], "t array<string>")
    got = [r.f for r in df.select(lexicon_hits("t", {"x": ["b"]}, each=True).alias("f")).collect()]
    assert [None if x is None else x.x.total for x in got[0]] == [1, None, 2] and got[1] == [] and got[2] is None


def test_a_lexicon_of_fifty_thousand_terms(spark):
    rng = random.Random(5)
    terms = tuple({f"{rng.randrange(10**10):010d}" for _ in range(50_000)})
    texts = [" ".join(rng.choice(terms) for _ in range(k)) for k in range(40)] + ["nothing"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    got = {r.i: r.n for r in df.select("i", lexicon_hits("t", {"all": terms})["all"]["hits"].alias("n")).collect()}
    known = set(terms)
    assert all(got[i] == len({t[k : k + 10] for k in range(len(t) - 9)} & known) for i, t in enumerate(texts))


@pytest.mark.parametrize(
    "title, content, want",
    [
        ("How to bake", "flour", "structured"), ("An interview", "x", "interview"), ("Talk", "x" * 900 + "tutorial", "key_points"), ("The keynote", "x", "key_points"), ("Weekly digest", "", "roundup"),
        ("《Title》", "", "reading"), ("x", "a chapter", "reading"), ("Why I stay", "", "opinion"), ("A post-mortem", "", "case"), ("plain", "plain", "structured"),
        ("x", "Tell us more? tell us. could you, tell us", "interview"), ("x", "tell us, could you; a question from, asks, asks, asks", "structured"),
    ],
)
def test_note_types_by_real_words(spark, title, content, want):
    df = spark.createDataFrame([(title, content)], "t string, c string")
    assert df.select(classify.note_type("t", "c").alias("k")).first().k == want


def test_advertising_by_real_words(spark):
    rows = [("Advertisement: buy", "x", True), ("plain", "use code X1, limited offer", True), ("plain", "use code, use code", False), ("plain", "use code, limited offer" + "x" * 1500, False), ("plain", "", False)]
    df = spark.createDataFrame(rows, "t string, c string, want boolean")
    assert all(r.got == r.want for r in df.select("want", filters.ad_document("t", "c").alias("got")).collect())
    text = "good\n\nsponsored by us\n\n" + "long " * 40 + "sponsored by us\n\nsign up now, limited offer " + "y " * 90 + "\n\n"
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(filters.purify("t").alias("p")).collect()
    assert [r.p for r in got] == ["good\n\n" + "long " * 40 + "sponsored by us", None, ""]


def test_memory_of_a_search_does_not_follow_the_batch():
    import tracemalloc

    import pyarrow as pa

    from tidemark.functions import automaton as A

    a, most = A.automaton(("the", "ing of")), []
    for n in (2000, 8000):
        texts = pa.array(["nothing of the kind is the thing of the day " * 50] * n)
        tracemalloc.start()
        found = 0
        for _, offsets, data in A.slices(texts):
            found += len(a.search(offsets, data)[0]) + int(A.code_points(data)[-1] > 0)
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert found > 5 * 50 * n
    assert most[1] < 1.2 * most[0] and most[1] < 40 << 20
