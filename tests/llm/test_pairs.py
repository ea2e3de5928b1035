"""Near-duplicate operators against brute force, with hot groups, nulls, empty and repeated rows."""

import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embeddings, jaccard, substrings
from tidemark.llm.common import Tables, connected_components
from tidemark.llm.embeddings import near_duplicates, sign_code, top_k

from . import brute

LINE = "this very common line of text stands in nearly every document of the whole collection as it is and is long enough to be found again"


def corpus(words):
    rows = [(i, words(60 + 7 * i, i)) for i in range(20)]
    base = words(150, 99).split()
    for k in range(30):  # a family of near copies, some farther away
        w = list(base)
        for _ in range(1 + k % 5):
            w[random.Random(k).randrange(len(w))] = f"edit{k}"
        rows.append((100 + k, " ".join(w)))
    rows += [(200 + k, words(40, 5)) for k in range(12)]  # exact copies
    rows += [(300 + k, words(30, 50 + k) + " " + LINE + " " + words(30, 80 + k)) for k in range(25)]
    rows += [(400, ""), (401, None), (402, "one two"), (403, "One  TWO"), (404, LINE), (405, LINE.upper()), (406, " \t\n"), (407, "é ß " * 40), (408, words(6000, 7))]
    return rows


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df, Tables(spark, "t")).collect()}
    assert got == brute.components({x for e in edges for x in e}, edges)


def test_jaccard_against_all_pairs(docs, words):
    rows = corpus(words)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(docs(rows, extra=True)).collect()}
    assert got == brute.jaccard(rows)


def test_jaccard_any_order_of_shingles(docs, words, monkeypatch):
    rows = corpus(words)
    monkeypatch.setattr(jaccard, "OVERALL", 10**9)  # nothing is put last
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(docs(rows)).collect()}
    assert got == brute.jaccard(rows)


def test_jaccard_nulls_and_empty_tables(docs):
    got = [tuple(r) for r in jaccard.components(docs([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")])).collect()]
    assert sorted(got, key=str) == [(2, 2, 2), (2, 2, 2), (None, 2, None)]
    assert jaccard.components(docs([])).count() == 0
    kept = jaccard.representatives(docs([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "A b c d e f")]))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, None]


@pytest.mark.parametrize("many", [1000, 2])
def test_substrings_against_all_windows(docs, words, monkeypatch, many):
    monkeypatch.setattr(substrings, "MANY", many)
    rows = corpus(words) + [(500, "xy " * 300), (501, "ß" * 400), (502, words(20, 1) + "xy " * 100)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove(docs(rows, extra=True), digest=True).collect()}
    assert got == {i: (n, g, s, brute.sha(rest)) for i, (n, g, s, rest) in brute.substrings(rows).items()}


def test_substrings_of_long_texts_in_parts(docs, words, monkeypatch):
    monkeypatch.setattr(substrings, "SLICE", 700)
    rows = [(1, words(800, 1)), (2, words(300, 2) + words(800, 1)[1000:4200] + words(50, 3))]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove(docs(rows), digest=True).collect()}
    assert got == {i: (n, g, s, brute.sha(rest)) for i, (n, g, s, rest) in brute.substrings(rows).items()}


def test_substrings_nulls_repeats_and_empty_tables(docs):
    text = LINE + " end"
    got = {(r.doc_id, r.n_removed) for r in substrings.remove(docs([(None, text), (1, text), (1, text), (2, None)])).collect()}
    assert got == {(1, 0), (2, 0), (None, len(text))}  # equal rows are no copies of each other, a null id is the largest
    assert substrings.remove(docs([])).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16))
    x[100:160] = x[100] + rng.normal(0, 0.05, (60, 16))
    x[200:230] = x[7]
    x[300] = x[8] * 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (None, [1.0] * 16), (904, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "'x' as id", "1 as near")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(u @ u.T >= 0.9)
    links = [(i, j) for i, j in zip(a.tolist(), b.tolist()) if i != j]
    comp = brute.components(range(400), links)
    degree = np.bincount([i for i, _ in links], minlength=400)
    assert sum(got[i][0] for i in range(400)) >= 0.95 * degree.sum()
    assert all(got[i][0] <= degree[i] for i in range(400))
    assert sum(got[i][1] == comp[i] for i in range(400)) >= 396
    assert all(got[i] == (0, i, True) for i in (900, 901, 902, 903, 904)) and got[None] == (0, None, False)


def test_top_k_against_all(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 64))
    x[50:120] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").select("id", sign_code("v").alias("code"))
    asked = df.where("id % 20 = 0").selectExpr("id as query_id", "code")
    got = {(r.query_id, r["rank"]): (r.id, r.distance) for r in top_k(df, asked, 5).collect()}
    bits = x > 0
    for q in range(0, 300, 20):
        d = (bits != bits[q]).sum(1)
        best = sorted((int(d[i]), i) for i in range(300) if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, n) for n, i in best]
    assert (500, 1) not in got


def test_top_k_by_all_components(spark):
    """Codes of several words, of which vectors of another length are no neighbours; repeated rows count once."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 150))
    x[:, :64] = 1.0  # the first word tells nothing
    x[20:60, 64:140] = x[0, 64:140]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] * 2 + [(400 + i, v[:140].tolist()) for i, v in enumerate(x[:30])] + [(500, []), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumn("code", sign_code("v")).withColumn("rank", F.lit("x"))
    got = {(r.query_id, r["rank"]): (r.id, r.distance) for r in top_k(df, df.where("id % 20 = 0").selectExpr("id as query_id", "code"), 4).collect()}
    bits = x > 0
    for q in range(0, 200, 20):
        d = (bits != bits[q]).sum(1)
        assert [got[q, k + 1] for k in range(4)] == [(i, n) for n, i in sorted((int(d[i]), i) for i in range(200) if i != q)[:4]]
    assert {got[400, k][0] // 100 for k in range(1, 5)} == {4} and (500, 1) not in got
    assert top_k(df.limit(0), df.limit(0).selectExpr("id as query_id", "code"), 4).count() == 0


def isolated_pairs(n, pairs, dims=64):
    """n random vectors, of which the first ``pairs`` and the next ``pairs`` are partners at a cosine of 0.9 to 0.93."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, side = x[:pairs], x[pairs : 2 * pairs]
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.901, 0.93, (pairs, 1))
    x[pairs : 2 * pairs] = cos * a + np.sqrt(1 - cos * cos) * side
    return x


def test_isolated_pairs_in_a_table_much_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    x = isolated_pairs(5000, 600)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.component_id for r in near_duplicates(df).where("n_links > 0").collect()}
    assert sum(got.get(600 + i) == i for i in range(600)) >= 595


def test_projections_grow_with_the_table():
    counts = [embeddings.projections(n, 0.9) for n in (5_000, 100_000, 1_000_000, 10_000_000)]
    assert counts == sorted(set(counts)) and counts[0] >= embeddings.PROJECTIONS


def test_audit_counts_every_vector_alike(spark):
    # 100 vectors with 99 links each, all found; 100 vectors with one link each, none found
    true = spark.createDataFrame([(i, 99 if i < 100 else 1) for i in range(200)], "id long, n long")
    lists = spark.createDataFrame([(i, list(range(99)) if i < 100 else []) for i in range(200)], "id long, links array<long>")
    assert abs(embeddings._audit(true, lists) - 0.5) < 1e-9


def test_recall_under_the_target_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "ROUNDS", 1)
    monkeypatch.setattr(embeddings, "RECALL", 1.01)
    df = spark.createDataFrame([(i, [1.0, 0.01 * i]) for i in range(20)], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError, match="recall"):
        near_duplicates(df)


def test_a_group_of_copies_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    x = np.vstack([np.tile(np.eye(8)[0], (100, 1)), np.eye(8)[1:], [[1, 0.1, 0, 0, 0, 0, 0, 0]]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    report = {}
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(df, report=report).collect()}
    assert all(got[i] == (100, 0) for i in (*range(100), 107)) and all(got[i] == (0, i) for i in range(100, 107))
    assert report["audited"] == 2  # the copies are one vector


def test_substrings_of_many_null_ids_and_of_many_texts_under_one_id(docs, words):
    texts = [words(40 + k % 9, k) for k in range(1500)]
    texts[700:720] = [t + " " + LINE for t in texts[700:720]]
    for one in (None, 5):
        got = sorted((r.n_bytes, r.n_removed) for r in substrings.remove(docs([(one, t) for t in texts])).collect())
        whole = sum(n for _, n in got)
        assert len(got) == 1500 and 19 * len(LINE) <= whole <= 19 * (len(LINE) + 2)  # all but one keep the line


def test_vectors_that_share_an_id_and_vectors_of_other_lengths(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [2.0, 0.0, 0.0]), (6, [1.0]), (3, [1.0, 0.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (3, 1, 1), (3, 1, 1), (4, 1, 4), (5, 1, 4), (6, 0, 6)]


def test_substrings_of_null_beside_the_largest_id_and_of_many_equal_rows(docs, words, spark):
    a, b, c = words(60, 1), words(90, 2), words(50, 3)
    rows = [(None, f"{a} {c}"), (2**63 - 1, f"{b} {c} x"), (1, b)]
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in substrings.remove(docs(rows)).collect()}
    want = substrings_of([(1, b), (2**63 - 1, f"{b} {c} x")])
    assert got[1, len(b)] == 0 and len(got) == 3 and got[2**63 - 1, len(b) + len(c) + 3] >= want
    # null and the largest id are one document id: which of its rows comes first is told by a hash of the text, and one keeps the passage
    assert got[None, len(a) + len(c) + 1] + got[2**63 - 1, len(b) + len(c) + 3] >= want + len(c)
    same = f"{a} " + "again and again " * 12
    many = substrings.remove(docs([(None, same)] * 300 + [(5, a)])).collect()
    assert len(many) == 301 and len({(r.n_removed, r.n_spans) for r in many if r.doc_id is None}) == 1


def substrings_of(rows):
    return brute.substrings(rows)[max(i for i, _ in rows)][1]


def test_substrings_keep_no_disk_of_steps_that_are_done(docs, words, spark, monkeypatch):
    """Shuffle files of one step are gone when the next begins, tables when nothing reads them any more, and no text is dealt for keys that are not there."""

    def shuffled(below: int | None = None) -> int:
        for _ in range(50):  # files are deleted by another thread
            n = sum(f.stat().st_size for d in spark._jsc.sc().env().blockManager().diskBlockManager().localDirs() for f in Path(d.getPath()).rglob("shuffle_*"))
            if below is None or n <= below:
                break
            time.sleep(0.1)
        return n

    rows = corpus(words)
    df = docs(rows)
    Tables(spark, "t").release()
    before, saved, tables, save = shuffled(), {}, [], Tables.save

    def watched(self, part, name):
        saved[name] = shuffled(before) if name in ("level1-2", "candidates-1", "candidates-2", "few", "spans") else 0
        tables.append(self)
        return save(self, part, name)

    monkeypatch.setattr(Tables, "save", watched)
    got = substrings.remove(df, digest=True)
    assert max(saved.values()) <= before and shuffled(before) <= before and "candidates-2" in saved
    assert "windows" not in saved  # no key has more than MANY runs
    left = [p.name for p in Path(tables[0].root.removeprefix("file://")).iterdir() if p.is_dir()]
    assert left == ["spans"]
    assert {r.doc_id: r.n_removed for r in got.collect()} == {i: g for i, (_, g, _, _) in brute.substrings(rows).items()}
