"""Secret scans: fixed rules, and a character convolutional network over every other candidate with its context.

Rules find assignments, access keys and long hexadecimal runs. Every other run of secret-like characters is a candidate; a
small convolutional network (as in ``quality``) reads it with CONTEXT characters on both sides. It is trained on labelled findings: what the rules
find in a bounded sample of documents is labelled 1, other candidates, failing matches and ordinary words are labelled 0. Findings are also
shown without their keyword, so that the network learns the secrets and not only the rules. Examples are dealt by a hash of the
candidate itself into three parts: one to learn from, one on which the output is calibrated and the threshold set (the largest that still
finds RECALL of the labelled ones), and one on which recall and precision are measured; no candidate stands in two of them.
Candidates above it are added to the rules' findings, which always stay. Positions count code points, ends are exclusive.

Null texts count as empty and have no findings; ids are passed through, repeats included; whole texts are scanned.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .classify import byte_batches, few_rows, sigmoid
from .common import replaced, text_of, with_row, with_text

KINDS = ("assign", "access", "hex", "net")
#: The rules (fixed values): pattern, group whose length counts, least length.
RULES = {
    "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
#: As short as the shortest secret that a rule takes.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{6,}")
CONTEXT, RECALL = 24, 0.98
#: Bounds of the training sample: documents, characters a document, and examples of each label (and half as many made-up ones).
DOCS, MAX_CHARS, EXAMPLES = 1500, 20_000, 1500


#: What every match of a rule holds; texts without it are not searched for the rule.
SIGNS = {"assign": (":", "="), "access": ("AKIA",), "hex": ("",)}


def by_rules(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind, start and end of the secret itself) of every rule's matches, leftmost and non-overlapping per kind."""
    rules = [(kind, *RULES[kind]) for kind, signs in SIGNS.items() if any(s in text for s in signs)]
    return [(m.start(), m.end(), kind, m.start(g), m.end(g)) for kind, rule, g, least in rules for m in rule.finditer(text) if m.end(g) - m.start(g) >= least]


class Spans:
    """Sorted spans, with the greatest end up to each, so that a question costs one search."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts, self.tops = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))

    def cover(self, a: int, b: int) -> bool:
        """Whether one span holds all of a..b."""
        k = bisect_right(self.starts, a)
        return k > 0 and self.tops[k - 1] >= b

    def touch(self, a: int, b: int) -> bool:
        """Whether a span shares a place with a..b."""
        k = bisect_left(self.starts, b)
        return k > 0 and self.tops[k - 1] > a


def candidates(text: str, found: list) -> list[tuple[int, int]]:
    """Runs of secret-like characters, of letters in one case too, that no rule's match covers as a whole."""
    if not found:
        return [m.span() for m in CANDIDATE.finditer(text)]
    ruled = Spans([f[:2] for f in found])
    return [m.span() for m in CANDIDATE.finditer(text) if not ruled.cover(*m.span())]


def window(text: str, a: int, b: int) -> str:
    """The candidate between markers, with its surroundings."""
    return text[max(0, a - CONTEXT) : a] + "\x02" + text[a:b] + "\x03" + text[b : b + CONTEXT]


def examples(texts: list[str]) -> list[tuple[str, int, str]]:
    """(window, label, candidate) of labelled findings, of other candidates as they occur, and of made-up runs that are no secrets."""
    good, bad, made = [], [], []
    for text in texts:
        found = by_rules(text)
        ruled = Spans([f[:2] for f in found])
        for k, (_, _, _, a, b) in enumerate(found):
            good.append((window(text, a, b), text[a:b]))
            # the same secret where ordinary words stand around it
            at = (7919 * (k + 1)) % max(1, len(text))
            good.append((text[max(0, at - CONTEXT) : at] + " \x02" + text[a:b] + "\x03 " + text[at : at + CONTEXT], text[a:b]))
        failing = [m.span(g) for rule, g, least in RULES.values() for m in rule.finditer(text) if m.end(g) - m.start(g) < least]
        words = [m.span() for m in re.finditer(r"\S{7,}", text)][:: max(1, len(text) // 400)]
        bad += [(window(text, a, b), text[a:b]) for a, b in [*candidates(text, found), *failing, *words[:12]] if not ruled.touch(a, b)]
        # long runs of ordinary letters, in capitals too, and of figures alone are no secrets
        letters, figures = re.sub(r"[^A-Za-z]", "", text[:400]), str(int(hashlib.md5(text.encode()).hexdigest(), 16))
        if len(letters) >= 80:
            size = 6 + int(figures[-2:]) % 18
            runs = (letters[:24], letters[24:64], letters[: size - 2].upper(), letters[40 : 40 + size], figures[:size], figures[:16])
            made += [(f"{text[:CONTEXT]}\x02{x}\x03{text[24 : 24 + CONTEXT]}", x) for x in runs]
            made.append((f"{text[: size // 2]} {figures[3:19]} {text[6:9]} \x02{figures[-16:]}\x03 {text[9:14]} {figures[5:21]}"[-2 * CONTEXT - 18 :], figures[-16:]))
            made.append((f"{text[:CONTEXT].upper()}\x02{runs[2]}\x03{text[24 : 24 + CONTEXT].upper()}", runs[2]))
    pick = lambda rows, n: sorted(rows, key=lambda t: hashlib.md5(t[0].encode()).digest())[:n]
    return [(t, 1, x) for t, x in pick(good, EXAMPLES)] + [(t, 0, x) for t, x in pick(bad, EXAMPLES) + pick(made, EXAMPLES // 2)]


def part_of(candidate: str) -> str:
    """Which part of the examples a candidate belongs to, wherever and however often it occurs."""
    return ("measure", "calibrate", "train", "train")[zlib.crc32(candidate.encode()) % 4]


def fit(texts: list[str]) -> dict | None:
    """Network, calibration (slope, shift), threshold, and the recall and precision on candidates that neither has seen (None where
    there are none); None if the sample holds no findings or nothing else."""
    import numpy as np

    from . import quality

    parts: dict[str, list] = {"train": [], "calibrate": [], "measure": []}
    for t, y, x in examples(texts):
        parts[part_of(x)].append((t, y))
    if any(len({y for _, y in parts[k]}) < 2 for k in ("train", "calibrate")):
        return None
    net = quality.fit(parts["train"])
    table = quality.tables(net["kernel"])
    z, y = logits(net, [t for t, _ in parts["calibrate"]], table), np.array([y for _, y in parts["calibrate"]], float)
    a, b = 1.0, 0.0
    for _ in range(500):  # logistic regression of the label on the network's output
        err = sigmoid(a * z + b) - y
        a, b = a - 0.05 * float((err * z).mean()), b - 0.05 * float(err.mean())
    cut = threshold(sigmoid(a * z + b)[y == 1])
    said, recall, precision = parts["measure"], None, None
    if said:
        p, y = sigmoid(a * logits(net, [t for t, _ in said], table) + b), np.array([y for _, y in said])
        recall = float((p[y == 1] >= cut).mean()) if (y == 1).any() else None
        precision = float(y[p >= cut].mean()) if (p >= cut).any() else None
    return net | {"slope": a, "shift": b, "threshold": cut, "recall": recall, "precision": precision}


def threshold(scores) -> float:
    """The largest threshold at which RECALL of the labelled findings with these scores are found."""
    import numpy as np

    return float(np.sort(scores)[int((1 - RECALL) * len(scores))])


def logits(net: dict, texts: list[str], table):
    """Output of the network for each text; ``table`` holds ``quality.tables`` of its kernel."""
    import numpy as np

    from . import quality

    raw = [t.encode() for t in texts]
    offsets, data = np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8)
    p, owner = quality.pooled(table, offsets, data)
    return quality.summary(p, owner, len(texts)) @ net["w"] + net["b"]


def worth(offsets, data):
    """Which texts of a slice can hold a finding or a candidate: they have a run of 6 secret-like characters, or a sign of an assignment."""
    import numpy as np

    run, first = LIKELY[data], np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a run ends where its text ends
    start = np.flatnonzero(run & (np.concatenate([[True], ~run[:-1]]) | first[:-1])) if len(data) else np.zeros(0, int)
    end = np.flatnonzero(run & (np.concatenate([~run[1:], [True]]) | first[1:])) + 1 if len(data) else np.zeros(0, int)
    at = np.concatenate([start[end - start >= 6], np.flatnonzero((data == 58) | (data == 61))])
    flags = np.zeros(len(offsets) - 1, bool)
    flags[np.searchsorted(offsets, at, "right") - 1] = True
    return flags


def _likely():
    import numpy as np

    table = np.zeros(256, bool)
    table[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
    return table


LIKELY = _likely()


def sample(docs: DataFrame) -> list[str]:
    """Texts of at most DOCS documents that may hold findings, those with the smallest hash of their id."""
    hint = F.col("text").contains("=") | F.col("text").contains(":") | F.col("text").contains("AKIA")
    rows = docs.where(hint & (F.length("text") <= MAX_CHARS)).select(F.col("doc_id").alias("key"), "text")
    return [r.text for r in few_rows(rows, DOCS)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id and findings (array of kind, start, end; by start, then kind as in KINDS) of every row, and ``row`` if ``carry``."""
    plain = text_of(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(fit(sample(plain)))  # bounded by the sample's parameters

    def score(net: dict, table: list, asked: list, out: list) -> None:
        if asked:
            p = sigmoid(net["slope"] * logits(net, [x[3] for x in asked], table) + net["shift"])
            for (i, a, b, _), one in zip(asked, p.tolist()):
                if one >= net["threshold"]:
                    out[i].append((a, b, "net"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from . import quality

        net = shared.value
        table = quality.tables(net["kernel"]) if net else []
        order = {k: i for i, k in enumerate(KINDS)}
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            batch = with_text(batch, text_col) if carry else batch
            texts, out, asked = batch.column(1), [[] for _ in range(len(batch))], []
            for lo, offsets, data in byte_batches(batch, 1, 1 << 20):
                for i in (np.flatnonzero(worth(offsets, data)) + lo).tolist():
                    text = texts[i].as_py()
                    found = by_rules(text)
                    out[i] = [(s, e, k) for s, e, k, _, _ in found]
                    if net:
                        for a, b in candidates(text, found):
                            asked.append((i, a, b, window(text, a, b)))
                            if len(asked) == 512:  # most words are candidates, so they are not kept
                                score(net, table, asked, out)
                                asked = []
            score(net, table, asked, out)
            rows = [[{"kind": k, "start": s, "end": e} for s, e, k in sorted(found, key=lambda f: (f[0], order[f[2]]))] for found in out]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in (0, *range(2, batch.num_columns))] + [pa.array(rows, kind)], ["doc_id", *carried, "findings"])

    carried = ["row"] * carry
    wide = with_row(docs, id_col, text_col).drop("text") if carry else plain
    finding = T.StructType().add("kind", T.StringType()).add("start", T.LongType()).add("end", T.LongType())
    return wide.mapInArrow(run, T.StructType([f for f in wide.schema.fields if f.name != "text"]).add("findings", T.ArrayType(finding)))


def digest(found: DataFrame) -> DataFrame:
    """Counts by rule, a checksum of the rules' findings, and all findings as text."""
    said = "array_join(transform({}, f -> concat(f.kind, ':', f.start, ':', f.end)), ',')"
    base = "filter(findings, f -> f.kind <> 'net')"
    count = [F.expr(f"cast(size(filter(findings, f -> f.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *count, F.sha2(F.expr(said.format(base)), 256).alias("base_sha256"), F.expr(said.format("findings")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every finding replaced by ``mark``; texts without findings, nulls included, stay as they are."""
    found = scan(docs, carry=True).select("row", "findings", F.col("row.text").alias("text"))
    # overlapping findings are joined first; pieces of the text between them are concatenated
    joined = """aggregate(findings, cast(array() as array<struct<s:long,e:long>>), (acc, f) ->
        if(size(acc) > 0 and f.start <= acc[size(acc) - 1].e,
           concat(slice(acc, 1, size(acc) - 1), array(struct(acc[size(acc) - 1].s as s, greatest(acc[size(acc) - 1].e, f.end) as e))),
           concat(acc, array(struct(f.start as s, f.end as e)))))"""
    cleaned = f"""aggregate({joined}, struct('' as done, 0L as at),
        (acc, x) -> struct(concat(acc.done, substring(text, int(acc.at) + 1, int(x.s - acc.at)), '{mark}') as done, x.e as at),
        acc -> concat(acc.done, substring(text, int(acc.at) + 1)))"""
    text = F.when(F.size("findings") > 0, F.expr(cleaned)).otherwise(F.col("text"))
    return replaced(docs, found.select("row", text.alias("clean")), "clean")
