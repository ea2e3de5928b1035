"""Personal data, spelling variants and periodic runs against plain versions of their contracts, on tables and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import periods, pii, queries, variants

from ..conftest import SF

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(figures):
    twice = [int(c) * 2 for c in figures[-2::-2]]
    return (sum(int(c) for c in figures[::-2]) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def valid(kind, found):
    figures = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in found.split("."))
    return kind == "email" or kind == "card" and 16 <= len(figures) <= 19 and luhn(figures) or kind == "phone" and 8 <= len(figures) <= 15


def personal(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, rx in PATTERNS.items() for m in re.finditer(rx, text) if valid(k, m.group())]


def same_findings(rows, got):
    for i, text in rows:
        want = personal(text or "")
        assert got[i].base_sha256 == sha(",".join(want)), text
        assert [getattr(got[i], f"n_{k}") for k in PATTERNS] == [sum(w.startswith(k + ":") for w in want) for k in PATTERNS]
        assert [s for s in got[i].spans.split(",") if s.split(":")[0] in PATTERNS] == want


def test_personal_data_of_a_table(spark):
    sf = SF.replace("0.001", "0.01")
    got = {r.doc_id: r for r in queries.op11_pii(spark, sf).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    same_findings(rows, got)
    assert len(got) == len(rows) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got.values()) > 50


def test_personal_data_of_odd_texts(docs):
    rng = random.Random(7)
    parts = ["@", ".", "+", "-", " ", "1", "25", "255", "256", "a", "é", "%", "(", ")", "\n", "ab.c", "4111111111111111", "4111 1111-1111 1111", "10.0.0.1", "x@y.z", "+1 (017) 555-7713", "€"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 50)))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, "1." * 9), (403, "a@b@c.d a@b.c@d.e"), (404, "0" * 5000 + "1.1.1.1"), (405, "x" * 300_000 + "@y.z"), (406, "1" * 50_000), (407, "@" * 20_000)]
    got = {r.doc_id: r for r in pii.digest(pii.scan(docs(rows, extra=True))).collect()}
    same_findings(rows, got)
    assert pii.scan(docs([])).count() == 0
    twice = pii.scan(docs([(None, "a@b.c"), (3, "a@b.c"), (3, "a@b.c")])).collect()
    assert [(f.kind, f.start, f.end) for r in twice for f in r.findings] == [("email", 0, 5)] * 3


@pytest.mark.parametrize(
    "text, want",
    [
        ("to josé@exämple.com now", ["mailbox:3:19"]), ("ftp://bob:pw@host.org/x", ["address:0:21"]), ("https://host.org/a", []), ("IBAN: DE89 3704 0044 0532 0130 00.", ["account:6:33"]),
        ("iban DE88 3704 0044 0532 0130 00", []), ("SSN 078-05-1120", ["account:4:15"]), ("ssn 900-05-1120", []), ("Account number: AB-1234567, ok", ["account:16:26"]), ("account opened yesterday", []), ("discount 1234567", []),
    ],
)
def test_added_personal_data(docs, text, want):
    (r,) = pii.digest(pii.scan(docs([(1, text)]))).collect()
    assert [s for s in r.spans.split(",") if s and s.split(":")[0] not in PATTERNS] == want


def test_places_of_personal_data_are_long_in_every_batch(spark, docs):
    rows = docs([(1, "é bob@x.org"), (2, "plain"), (3, "€€ 1.2.3.4")]).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)  # a batch without findings between two with some
    try:
        found = pii.scan(rows).selectExpr("doc_id", "inline(findings)")
        assert dict(found.dtypes)["start"] == dict(found.dtypes)["end"] == "bigint"
        assert sorted(found.collect()) == [(1, "email", 2, 11), (3, "ip", 3, 10)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_redacted_personal_data(docs):
    rows = [(1, "é bob@x.org, +1 (017) 555-7713"), (2, None), (3, "plain"), (None, "ftp://bob@x.org 1.2.3.4")]
    got = {r.doc_id: r for r in pii.redact(docs(rows, extra=True)).collect()}
    assert got[1].text == "é [EMAIL], [PHONE]" and got[1].n_chars == len(got[1].text) and got[1].kept == "k"
    assert got[2].text is None and got[3].text == "plain" and got[None].text == "[ADDRESS] [IP]"


def spelled(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out, form = {}, {}
    for w, n in words.items():
        found = [x for x in words if abs(len(x) - len(w)) <= 1 and near(w, x)]
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
        out[w] = (n, len(found), form[w], words.get(form[w]))
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] += (root,)
    return out


def spellings(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_spellings_of_a_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = spelled(rows)
    assert spellings(queries.op12_variants(spark, SF)) == want and any(v[2] for v in want.values())


def test_spellings_of_odd_texts(docs):
    rng = random.Random(4)

    def bent(w):
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3])):
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + rng.choice("abé") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("abÉ") + w[k + 1 :]])
        return w

    base = ["aaaaaaa", "aabbaab", "letters", "résumés", "spelled", "ABCdefg"]
    rows = [(rng.choice([None, *range(40)]), " ".join(bent(rng.choice(base)) for _ in range(rng.randint(1, 400)))) for _ in range(60)]
    rows += [(None, None), (7, ""), (8, "1 2"), (9, "letters " * 3000), (9, "letters " * 3000)]
    want = spelled(rows)
    assert spellings(variants.group(docs(rows, extra=True).repartition(5))) == want
    assert max(v[1] for v in want.values()) > 20 and any(v[4] not in (w, v[2]) for w, v in want.items())  # long chains too
    assert variants.group(docs([])).count() == 0


def test_equal_hashes_are_told_apart():
    """Members of one key that leave different strings, as if their hashes had met."""
    members = [(0, "xletter", 9), (0, "yletter", 5), (2, "spelled", 7), (-1, "letter", 3), (2, "stalled", 5)]
    got = sorted(variants.neighbours(members))
    assert got == [("letter", 2, 9, "xletter"), ("xletter", 1, 3, "letter"), ("xletter", 1, 5, "yletter"), ("yletter", 1, 3, "letter"), ("yletter", 1, 9, "xletter")]


def test_deletion_keys_are_hashes_of_what_is_left():
    words = ["abcdefg", "abcefg", "é" * 6, "aabaab", "q" * 500]
    number, place, key = variants.deletion_keys(words)
    by: dict = {}
    for i, p, k in zip(number.tolist(), place.tolist(), key.tolist()):
        by.setdefault(variants.left_of(words[i], p), set()).add(k)
    assert all(len(k) == 1 for k in by.values()) and len({next(iter(k)) for k in by.values()}) == len(by)


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def periodic(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    head = (len(runs), *best, best[1] * 1000 // best[2] if runs else None)
    return (*head, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periods_of_a_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_periods(spark, SF).collect()}
    assert got == {i: periodic(i, t) for i, t in rows} and sum(g[0] > 0 for g in got.values()) > 10


def test_periods_of_odd_texts(docs):
    rng, rows = random.Random(3), [(-1, None), (-2, ""), (-3, " \n"), (-4, "a " * 3000), (-5, "\x1c\xa0 b\x85 c"), (-6, "a b c d e f " * 400 + "a b")]
    for i in range(300):
        w = []
        while len(w) < rng.choice([5, 30, 90]):
            w += [rng.choice("abé" if i % 2 else "abcdef") for _ in range(rng.randint(1, 6))] * rng.randint(1, 7)
        rows.append((i, rng.choice(["", " ", "\n"]) + rng.choice([" ", "  ", "\t"]).join(w) + rng.choice(["", " "])))
    got = {r.doc_id: tuple(r)[1:] for r in periods.find(docs(rows, extra=True), plant=True, digest=True).collect()}
    assert got == {i: periodic(i, t) for i, t in rows}
    assert periods.find(docs([])).count() == 0
    twice = periods.find(docs([(None, "x " * 6), (None, "x " * 6), (5, "q r " * 4 + "q z")])).collect()
    assert [(r.n_runs, r.collapsed) for r in twice] == [(1, "x"), (1, "x"), (1, "q r z")]
    assert [tuple(x) for x in twice[2].runs] == [(0, 9, 2)] and twice[2].exponent_milli == 4500


def test_masked_words_are_in_no_run():
    rng = random.Random(9)
    for _ in range(300):
        w = []
        while len(w) < 120:
            w += [str(rng.randint(0, 30)) for _ in range(rng.randint(1, 8))] * rng.choice([1, 1, 2, 4, 5])
        raw = " ".join(w).encode()
        data, offsets = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
        starts, ends, first = periods.word_bounds(offsets, data)
        keep = periods.survivors(periods.word_hashes(data, starts, ends), first)
        assert all(keep[s : s + n].all() for s, n, _ in plain_runs(w))
