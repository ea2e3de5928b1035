"""Chunks, cues and cleaned segments against plain versions; table functions in SQL."""

import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import segments as S
from tidemark.plans import registry
from tidemark.plans.segments import timed

from .conftest import SF


def test_chunks_in_sql_are_those_of_the_operator(spark):
    S.register(spark)
    spark.read.parquet(f"{SF}/documents.parquet").createOrReplaceTempView("docs")
    got = spark.sql("select doc_id, c.chunk, c.text from docs, lateral chunks(text, 1000, 50) c")
    want = S.chunk_text(spark.table("docs").select("doc_id", "text"), most=1000, overlap=50)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 200
    assert spark.sql("select * from chunks(cast(null as string), 10, 1)").count() == 0
    assert [r.text for r in spark.sql("select * from chunks('  a b  ', 10, 1)").collect()] == ["a b"]


def test_short_and_blank_texts_go_past_python(spark):
    df = spark.createDataFrame([(1, "　 a b\n"), (2, " \n\t "), (3, None), (4, "x" * 10), (5, "é" * 11)], "i int, text string")
    got = [(r.i, r.chunk, r.text) for r in S.chunk_text(df, most=10, overlap=1).orderBy("i", "chunk").collect()]
    assert got[:2] == [(1, 0, "a b"), (4, 0, "x" * 10)] and [r[0] for r in got[2:]] == [5] * (len(got) - 2) and got[2][2] == "é" * 10
    with pytest.raises(ValueError):
        S.chunk_text(df, most=500, overlap=100)


def test_cues_in_sql_are_those_of_the_columns(spark):
    S.register(spark)
    vtt = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:03.500\na\r\nb\n\nnote\n\n00:00:05.000 --> 00:00:04.000\nc\n\n00:00:06.000 --> 00:00:07.000\n \n"
    df = spark.createDataFrame([(vtt,), ("",), (None,)], "vtt string")
    df.createOrReplaceTempView("subtitles")
    got = [tuple(r) for r in spark.sql("select c.* from subtitles, lateral cues(vtt) c").collect()]
    want = [(k, *c) for r in df.select(T.parse_vtt("vtt").alias("c")).collect() if r.c for k, c in enumerate(map(tuple, r.c))]
    assert got == want == [(0, 1.0, 2.5, "a b"), (1, 5.0, 0.0, "c")]


def cleaned(rows, fillers):
    """The cleaning fold of one medium, said plainly."""
    words = "|".join(sorted(map(re.escape, fillers), key=len, reverse=True))
    bare = lambda t: re.sub(r"[ \t\r\n,.!?;:'()\[\]　-。，！？；：…—“”]", "", t)
    out, seen, last = [], set(), ""
    for seq, start, duration, text in sorted(rows, key=lambda r: r[0]):
        text = (text or "").strip()
        text = "" if re.fullmatch(words, text) else re.sub(f"^((?:{words})[,.!?][,.!? ]*)+", "", text)
        if not text or (bare(text) and last and SequenceMatcher(None, bare(text), last).ratio() >= 0.9):
            continue
        if out and len(text) <= 8:
            s, b, d, t = out[-1]
            out[-1] = (s, b, max(d, start + duration - b), f"{t} {text}")
            last = bare(out[-1][3])
            continue
        kept = ""
        for sentence in re.findall("[^。！？!?;；]+[。！？!?;；]?|[。！？!?;；]", text):
            if len(bare(sentence)) < 8 or bare(sentence) not in seen:
                kept += sentence
            if len(bare(sentence)) >= 8:
                seen.add(bare(sentence))
        if kept.strip():
            out.append((seq, start, duration, kept.strip()))
            last = bare(kept.strip())
    return out


def test_cleaned_segments_of_a_table(spark):
    rows: dict = {}
    for r in timed(spark, SF).collect():
        rows.setdefault(r.media_id, []).append((r.seq, r.start, r.duration, r.text))
    rows[-1] = [(0, 0.0, 1.0, "well, um, a long first sentence! and"), (1, 1.0, 1.0, "um"), (2, 2.0, 5.0, "yes"), (3, 3.0, 1.0, "a long first sentence! then more of it"), (4, 4.0, 1.0, "then more of it."), (5, 5.0, 1.0, None), (6, 6.0, 1.0, "a new one")]
    kind = "media_id long, seq int, start double, duration double, text string"
    df = spark.createDataFrame([(m, *r) for m, own in rows.items() for r in own], kind)
    got = sorted(tuple(r) for r in S.clean_segments(df).collect())
    assert got == sorted((m, *r) for m, own in rows.items() for r in cleaned(own, ("you know", "well", "um", "uh", "so")))
    want = sorted(tuple(r) for r in S.clean_segments(timed(spark, SF)).select("media_id", "seq", "start", "duration", F.md5("text")).collect())
    assert sorted(tuple(r) for r in registry.QUERIES["segments_clean"](spark, SF).collect()) == want


def test_similar_titles_of_a_table(spark):
    titles = {r.doc_id: r.text.split("\n")[0] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registry.QUERIES["similarity_titles"](spark, SF).collect()
    ids = sorted(titles)
    assert {(a, b) for a, b in zip(ids, ids[1:])} <= {(r.doc_id, r.other_id) for r in got}
    for r in got:
        a, b = titles[r.doc_id], titles[r.other_id]
        assert r.ratio == round(SequenceMatcher(None, a, b).ratio() if a and b else 0.0, 9)


def test_chunks_are_cut_once_and_in_parts_of_bounded_size(spark):
    import pyarrow as pa

    from tidemark.functions.automaton import parts

    texts = pa.array(["ab" * 40, None, "é" * 30, "", "x" * 500, "y"])
    got = [p.to_pylist() for p in parts(texts.slice(1), 90)]
    assert [t for p in got for t in p] == texts.to_pylist()[1:] and [len(p) for p in got] == [3, 1, 1]
    rows = [(0, "a word " * 400), (1, None), (2, "  "), (3, "short"), (4, "other words " * 300)]
    df = S.chunk_text(spark.createDataFrame(rows, "k int, text string"), most=1000, overlap=50)
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r.k, r.chunk, r.text) for r in df.orderBy("k", "chunk").collect()] == [(k, i, c) for k, t in rows for i, c in enumerate(S.chunk_one(t or "", 1000, 50))]


def test_settled_pairs_are_not_compared(monkeypatch):
    alphabet = "abcdef ghi"
    for n in (1, 3, 150, 250, 900):
        for seed in range(20):
            t = "".join(alphabet[(k * k * (seed + 3) + k // 7 + seed) % (seed % 9 + 1)] for k in range(n))
            assert SequenceMatcher(None, t, t).ratio() == 1.0 == S.ratio(t, t)
    monkeypatch.setattr(S, "SequenceMatcher", None)
    assert S.ratio("x" * 5000, "x" * 5000) == 1.0 and S.ratio("", "") == 0.0
    assert not S.near("abc" * 50, "xyz" * 50) and not S.near("ab", "ab" * 9)


def test_near_is_what_the_ratio_says():
    for n in range(1, 400):  # bounds and ratio are rounded alike
        for cut in {n // 10, n // 5, n // 10 + 1}:
            a, b = "a" * n, "a" * (n - cut) + "b" * cut
            assert S.near(a, b) == (S.ratio(a, b) >= S.config.NEAR_RATIO)
            assert S.near(a, a[cut:]) == (S.ratio(a, a[cut:]) >= S.config.NEAR_RATIO)
