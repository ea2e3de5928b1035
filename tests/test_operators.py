"""Small cases of the operators: edges that the tables do not have."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import html
from tidemark.functions import text as T
from tidemark.operators import classify, feeds, filters, queues, segments, series, summarize
from tidemark.sources import files, sinks


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize("raw, want", [("HTTP://H/x///", "http://h/x"), ("http://h/x#frag", "http://h/x"), ("http://h/x?utm=f", "http://h/x?utm=f"), ("https://E.com/p?b=2&a=1", "https://e.com/p?a=1&b=2"), ("http://h/X", "http://h/X")])
def test_normalize_url(spark, raw, want):
    assert one(spark, T.normalize_url("u"), u=raw) == want


def test_dedup_key(spark):
    assert one(spark, T.dedup_key("u", "c"), u=" ", c=" ") is None
    assert one(spark, T.dedup_key("u", "c"), u="", c="a ") == one(spark, T.hash16("c"), c="a")


@pytest.mark.parametrize("raw, want", [("well, um, go", "go"), ("well go", "well go"), ("um", ""), ("", "")])
def test_fillers(spark, raw, want):
    assert one(spark, T.strip_fillers("t"), t=raw) == want


def test_gate(spark):
    g = one(spark, T.gate("t"), t='ok {"score": 150, "pass": false, "issues": ["a", ""]} end')
    assert (g.score, g.passed, g.issues) == (100.0, False, ["a"])
    g = one(spark, T.gate("t"), t="score: 90")
    assert (g.score, g.passed) == (90.0, True)
    g = one(spark, T.gate("t"), t="")
    assert (g.score, g.passed, len(g.issues)) == (0.0, False, 1)


def test_vtt_and_timed_text(spark):
    cues = one(spark, T.parse_vtt("t"), t="WEBVTT\n\n1\n00:00:01.000 --> 00:00:03.500\na\nb\n\nnote\n\n00:00:05.000 --> 00:00:04.000\nc")
    assert [(c.start, c.duration, c.text) for c in cues] == [(1.0, 2.5, "a b"), (5.0, 0.0, "c")]
    assert one(spark, T.timed_text("t"), t="<text>a &amp; b</text>") == "a & b"


def test_html_cascade(spark):
    assert one(spark, html.page_title("h"), h='<meta property="og:title" content="A long title"><h1>Other heading here</h1>') == "A long title"
    assert one(spark, html.page_title("h"), h='<meta property="og:title" content="Short"><h1>Heading of eleven</h1>') == "Heading of eleven"
    assert one(spark, html.page_title("h"), h="<title>Ti - Site</title>") == "Ti"
    assert one(spark, html.page_title("h"), h="") == "untitled"
    assert one(spark, html.page_text("h"), h="<article>" + "a" * 99 + "</article>") is None
    assert one(spark, html.page_text("h"), h="<article>" + "a" * 100 + "<script></p></script></article>") == "a" * 100


def test_ad_filters(spark):
    assert not one(spark, filters.ad_document("a", "b"), a="", b="CC BY " * 3)  # one phrase, however often
    assert one(spark, filters.ad_document("a", "b"), a="", b="CC BY token = ")
    text = "good\n\nLicensed under x\n\nalso good\n\n![QR code](x)"
    assert one(spark, filters.purify("t"), t=text) == "good\n\nalso good"


@pytest.mark.parametrize("n, band", [(19, "drop"), (20, "light"), (80, "light"), (81, "full")])
def test_bands(spark, n, band):
    assert one(spark, filters.length_band("t"), t="a" * n) == band


def test_substantive(spark):
    assert not one(spark, filters.substantive("t"), t="short http://example.com/long")
    assert one(spark, filters.substantive("t"), t="a text of enough length")


def test_classify(spark):
    ask = lambda a, b: one(spark, classify.note_type("a", "b"), a=a, b=b)
    assert ask("how to talk", "") == "structured"
    assert ask("a talk", "interview") == "interview"
    assert ask("《x》", "") == "reading"
    assert ask("", "a" * 801 + "keynote") == "structured"
    assert ask("started", "") == "key_points"


def test_chunks_keep_the_limit_and_the_order_of_marks():
    assert segments.chunk_one("  ab ", 10, 2) == ["ab"]
    assert segments.chunk_one("", 10, 2) == []
    got = segments.chunk_one("abcd." * 5000, 1000, 50)
    assert len(got) > 1 and all(len(c) <= 1000 for c in got)
    assert segments.chunk_one("a" * 500 + "。" + "b" * 100 + "." + "c" * 500, 700, 10)[0] == "a" * 500 + "。"


def test_windows_anchor_and_order(spark):
    rows = [(1, i, i * 60.0, 60.0, f"t{i}") for i in range(30)]
    df = spark.createDataFrame(rows[::-1], "media_id long, seq long, start double, duration double, text string")
    got = [(r.start, r.end) for r in segments.greedy_windows(df).orderBy("group").collect()]
    assert got == [(0.0, 660.0), (660.0, 1320.0), (1320.0, 1800.0)]


def test_clean_segments(spark):
    rows = [(1, 0, 0.0, 5.0, "well, the first thing to say."), (1, 1, 5.0, 5.0, "the first thing to say."), (1, 2, 10.0, 5.0, "yes"), (1, 3, 15.0, 5.0, "um"), (1, 4, 20.0, 5.0, "something else entirely here")]
    df = spark.createDataFrame(rows, "media_id long, seq long, start double, duration double, text string")
    got = [(r.seq, r.duration, r.text) for r in segments.clean_segments(df).orderBy("seq").collect()]
    assert got == [(0, 15.0, "the first thing to say. yes"), (4, 5.0, "something else entirely here")]


def test_two_stage(spark):
    df = spark.createDataFrame([(1, 0, 0, "A b. C"), (1, 0, 1, "D."), (2, 0, 0, "x"), (3, 0, 0, " "), (3, 0, 1, "y")], "media_id long, `group` int, chunk int, text string")
    got = {r.media_id: r.summary for r in summarize.two_stage(df, summarize.extractive()).collect()}
    assert got == {1: "A b.\n\n---\n\nD.", 2: "x", 3: None}


def test_hosted_provider_retries(spark):
    def flaky(text):
        if text == "bad":
            raise RuntimeError("no such model")
        return text.upper()

    df = spark.createDataFrame([("a",), ("bad",), (None,)], "text string")
    assert [r.x for r in df.select(summarize.hosted(flaky)(F.col("text")).alias("x")).collect()] == ["A", None, None]


def test_remember_keeps_the_last(spark):
    seen = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (1, 12, 2)], "source_key long, id long, seq long")
    new = spark.createDataFrame([(1, 13, 0), (1, 11, 1)], "source_key long, id long, feed_pos long")
    assert [r.id for r in feeds.remember(seen, new, 3).orderBy("seq").collect()] == [11, 12, 13]


def test_backfill_is_never_done_without_items(spark):
    items = spark.createDataFrame([(1, 1, "2020-01-01 00:00:00")], "source_key long, id long, t string").selectExpr("source_key", "id", "cast(t as timestamp) publish_time")
    seen = spark.createDataFrame([], "source_key long, id long")
    assert not feeds.backfill_progress(items, seen, "2024-01-01 00:00:00").first().done


def test_scope_refuses_nothing(spark):
    with pytest.raises(ValueError):
        filters.scope(spark.range(1), "id", [])


def test_index_range():
    assert queues.index_range("0,1,2-5,99", 5) == [0, 1, 2, 3, 4]


def test_series(spark):
    ev = spark.createDataFrame([("s", 1, "landed"), ("s", 1, "raw_ready"), ("s", 2, "pending"), ("s", 4, "verified")], "series string, page int, state string")
    m = series.fold(ev)
    assert {(r.page, r.state) for r in m.collect()} == {(1, "landed"), (2, "pending"), (4, "verified")}
    total = spark.createDataFrame([("s", 5), ("z", 0)], "series string, expected_total int")
    assert sorted(r.page for r in series.gaps(m, total).collect()) == [2, 3, 5]


def test_names(spark):
    assert one(spark, T.parse_episode_name("n"), n="ep100_a.body.md")[:] == (100, "a", "body")
    assert one(spark, T.parse_episode_name("n"), n="ep7_a_body.md").kind == "stray"
    assert one(spark, T.parse_episode_name("n"), n="notes.md") is None


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "wiki")
    write = sinks.upsert_sink(spark, path, ["title"])
    write(spark.createDataFrame([("a", "1"), ("b", "1")], "title string, content string"))
    write(spark.createDataFrame([("a", "2")], "title string, content string"))
    assert sorted(map(tuple, sinks.read_upserted(spark, path).collect())) == [("a", "2"), ("b", "1")]
    bad = sinks.Sink("remote", lambda: True, lambda df: 1 / 0)
    local = sinks.Sink("local", lambda: True, sinks.folder_sink(str(tmp_path / "local")))
    assert sinks.resolve({"local": local}) == ["local"]
    assert sinks.resolve({"local": local, "remote": bad}) == ["remote"]
    df = spark.createDataFrame([("f", "a")], "folder string, title string")
    assert sinks.fan_out(df, {"local": local, "remote": bad}, ["remote", "local", "none"]) == {"remote": False, "local": True, "none": False}


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, text in (("a/x.md", "hi"), ("a/y_raw_1.md", "no"), ("z.txt", " \n"), ("w.txt", "yes"), ("_h.md", "no")):
        (tmp_path / name).write_text(text)
    assert sorted(r.text for r in files.text_folder(spark, str(tmp_path)).collect()) == ["hi", "yes"]
    assert files.json_state(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "s.json").write_text('{"a": 1}\n{broken\n')
    assert [r.a for r in files.json_state(spark, str(tmp_path / "s.json"), "a int").collect()] == [1]
    pages = spark.createDataFrame([("s", 1, list(range(20))), ("s", 2, [1]), ("s", 3, [2])], "source_key string, page int, items array<int>")
    assert files.feed_pages(pages).count() == 21


def test_title_pairs_compare_whole_titles_across_gaps(spark):
    from tidemark.plans.texts import title_pairs

    head = "the same forty characters begin them all and go on to more than eighty characters here "
    d = spark.createDataFrame([(1, head + "A\nx"), (2, head + "B"), (7, "other"), (9, head + "A\ny"), (10, None)], "doc_id long, text string")
    got = {(r.doc_id, r.other_id): (r.title, r.other) for r in title_pairs(d).collect()}
    assert set(got) == {(1, 2), (2, 7), (7, 9), (9, 10), (1, 9)}
    assert got[1, 2] == (head + "A", head + "B") and got[1, 9] == (head + "A", head + "A")


def test_promote_keeps_entries_without_condition_and_urls_once(spark):
    q = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None), (None, "x"), ("c", "y")], "url string, state string")
    stay, target = queues.promote(q, q.where("url = 'z'").select("url"), F.col("state") == "x")
    assert sorted(r.url for r in stay.collect()) == ["b", "c"]
    assert sorted(map(str, (r.url for r in target.collect()))) == ["None", "a"]


def test_upsert_keeps_one_row_a_key(spark):
    old = spark.createDataFrame([("a", 1), (None, 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2), ("a", 3), (None, 4), ("b", None)], "k string, v int")
    assert sorted(map(str, ((r.k, r.v) for r in feeds.upsert(old, new, ["k"]).collect()))) == ["('a', 3)", "('b', None)", "(None, 4)"]


def test_template_without_default_keeps_the_notes(spark):
    notes = spark.createDataFrame([("x",), (None,)], "note_type string")
    dim = spark.createDataFrame([("y", "Y"), ("y", "Z")], "note_type string, label string")
    assert [r.label for r in classify.with_template(notes, dim).collect()] == [None, None]
    dim = spark.createDataFrame([("structured", "S"), ("x", "X")], "note_type string, label string")
    assert sorted(r.label for r in classify.with_template(notes, dim).collect()) == ["S", "X"]


def test_tree_of_any_depth_and_cycles(spark):
    chain = [(i, i - 1 if i else None, str(i)) for i in range(40)] + [(99, 98, "orphan")]
    got = {r.node: (r.path, r.depth) for r in series.tree_paths(spark.createDataFrame(chain, "node long, parent long, title string")).collect()}
    assert got == {i: ("/".join(map(str, range(i + 1))), i) for i in range(40)}
    with pytest.raises(ValueError, match="cycle"):
        series.tree_paths(spark.createDataFrame([(1, 2, "a"), (2, 1, "b"), (3, None, "c")], "node long, parent long, title string"))


def test_provider_by_priority():
    assert classify.provider("b", {"a", "b"}, ["a", "b"]) == "b" and classify.provider("c", {"b"}, ["a", "b"]) == "b" and classify.provider(None, set(), ["a"]) is None


def test_chunks_cover_the_text_and_prefer_lines():
    text = "".join(f"{i:04d}, word word. " + ("\n" if i % 9 == 0 else "") for i in range(600))
    pieces = segments.chunk_one(text, 1000, 100)
    assert all(len(p) <= 1000 for p in pieces) and all(f"{i:04d}" in " ".join(pieces) for i in range(600))
    assert segments.chunk_one("ab. cd", 10, 2) == ["ab. cd"] and segments.chunk_one("  ", 10, 2) == []


def test_paid_items_are_skipped_and_counted(spark):
    kept, skipped = feeds.without_paid(spark.createDataFrame([("s", 1, True), ("s", 2, None), ("t", 3, False)], "source_key string, id int, paid boolean"))
    assert sorted(r.id for r in kept.collect()) == [2, 3] and {(r.source_key, r.skipped) for r in skipped.collect()} == {("s", 1), ("t", 0)}


def test_drained_series_are_one_grouping_by_page(spark):
    """Evidence may repeat a page, pages without evidence and unknown pages count for nothing, and no join holds both sides."""
    from tidemark.operators import series

    have = spark.createDataFrame([(1, 1, 0), (1, 1, 2), (1, 2, 1), (2, 1, 4), (3, 1, None), (3, None, 3)], "series long, page int, ord int")
    proof = spark.createDataFrame([(1, 1, True, None), (1, 1, None, True), (1, 2, True, False), (1, 3, True, True), (3, 1, False, True), (3, None, True, True), (9, 1, True, True)], "series long, page int, ok boolean, found boolean")
    got = series.drain(have, proof)
    assert {r.series: (r.pages, r.landed, r.verified, r.clean_up) for r in got.collect()} == {1: (2, 2, 1, False), 2: (1, 1, 1, True), 3: (2, 1, 0, False)}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
