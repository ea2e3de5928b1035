"""Similarity joins of short texts by the ratio 2M/T of their matching blocks, without comparing all pairs.

M is found as Ratcliff and Obershelp say: the longest common block (the first in the left text, then in the right one), then the same
left and right of it; T is the length of both texts. M matched characters in order bound the ratio from above by lengths
alone, and leave a known least number of common q-grams at nearly the same places. Both bounds are exact, so no pair is lost:

* lengths m and n need 2 min(m, n) >= t (m + n);
* at least ``shared`` q-grams survive, so of the rarest q-grams of an item, all but ``shared`` - k, k must stand in the other text, at places not
  further off than the characters that may be unmatched;
* what passes is counted in full, and pairs that still pass are compared.

Left texts (a table of any size) are read once; the right ones (the items) are dealt into blocks of a bounded size, each of which is indexed
and sent to the tasks. Texts on both sides are made distinct before, so copies cost nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config

#: Length of a q-gram; characters of items that are indexed at once; pairs that are counted at once.
Q, BLOCK, PAIRS = 3, 4 << 20, 1 << 21
#: How many of an item's rarest q-grams are asked for at least, of so many more that are indexed.
MORE = 12


class SuffixAutomaton:
    """All substrings of a text, with the end of the first occurrence of each."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [0]
        last = 0
        for i, c in enumerate(text):
            s = self._state(self.length[last] + 1, i + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = s
                p = self.link[p]
            if p < 0:
                self.link[s] = 0
            else:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[s] = q
                else:
                    copy = self._state(self.length[p] + 1, self.first[q])
                    self.next[copy], self.link[copy] = dict(self.next[q]), self.link[q]
                    self.link[q] = self.link[s] = copy
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = self.link[p]
            last = s

    def _state(self, length: int, first: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def ends(self, text: str) -> Iterator[tuple[int, int, int]]:
        """For each place of another text: (end there, length of the longest block that ends there, end of its first occurrence here)."""
        s = n = 0
        for i, c in enumerate(text):
            while s and c not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if c in self.next[s]:
                s, n = self.next[s][c], n + 1
            yield i + 1, n, self.first[s]


def longest_block(a: str, b: str) -> tuple[int, int, int]:
    """(place in a, place in b, length) of the longest common block; of equal ones the first in a, then in b. The automaton is built
    of the shorter text, and the other one runs through it once."""
    best = (0, 0, 0)
    if len(b) <= len(a):
        for end, n, other in SuffixAutomaton(b).ends(a):
            if n > best[2]:
                best = (end - n, other - n, n)
    else:
        for end, n, other in SuffixAutomaton(a).ends(b):
            if n > best[2] or n and n == best[2] and other - n < best[0]:
                best = (other - n, end - n, n)
    return best


def matched(a: str, b: str) -> int:
    """M: characters in matching blocks."""
    total, todo = 0, [(a, b)]
    while todo:
        a, b = todo.pop()
        if a and b:
            i, j, n = longest_block(a, b)
            if n:
                total += n
                todo += [(a[:i], b[:j]), (a[i + n :], b[j + n :])]
    return total


def ratio(a: str, b: str) -> float:
    """[STR-9] 2M/T; two empty texts are equal."""
    return 1.0 if a == b else 2.0 * matched(a, b) / (len(a) + len(b))


def block_ratio(a, b) -> Column:
    """[STR-9] The ratio of two columns; null if one is null."""

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else ratio(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())

    return run(a, b)


def least_matched(total, t: float):
    """Fewest matched characters at which texts of ``total`` characters together reach the ratio t (a little less for rounding)."""
    return np.ceil(t * total / 2 - 1e-9)


def shared(m, n, t: float, q: int = Q):
    """Fewest q-grams of a text of m characters that must stand in one of n: an unmatched character spoils at most q of them, and one
    that the other has in excess q - 1."""
    least = least_matched(m + n, t)
    return (m - q + 1) - q * (m - least) - (q - 1) * (n - least)


def grams(texts: Sequence[str], q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, gram) of all q-grams (exact: 21 bits a character), and the texts' lengths."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    many = np.maximum(lengths - q + 1, 0)
    text = np.repeat(np.arange(len(texts)), many)
    place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    at = starts[text] + place
    gram = np.zeros(len(at), np.uint64)
    for k in range(q):
        gram = (gram << np.uint64(21)) | codes[at + k]
    return text, place, gram, lengths


def gathered(text: np.ndarray, code: np.ndarray, place: np.ndarray, codes: int) -> tuple[np.ndarray, ...]:
    """(text, code, count, first place, last place) of the different q-grams of each text."""
    order = np.lexsort((place, text * codes + code))
    key, place = (text * codes + code)[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(key))
    return key[first] // codes, key[first] % codes, ends - first, place[first], place[ends - 1] if len(key) else place


class Index:
    """Items by the rarest of their q-grams."""

    def __init__(self, items: list[str], t: float):
        self.items, self.t = items, t
        text, place, gram, self.lengths = grams(items)
        self.known, code = np.unique(gram, return_inverse=True)
        count = np.bincount(code, minlength=len(self.known))
        # an item's least overlap is that with the shortest text it can meet; short items have none and are listed apart
        shortest = np.ceil(self.lengths * t / (2 - t) - 1e-9)
        need = shared(self.lengths, shortest, t)
        self.loose = np.flatnonzero((need < 1) | (self.lengths < Q))
        order = np.lexsort((place, count[code], text))
        many = np.bincount(text, minlength=len(items))
        rank = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        self.need = need.astype(np.int64)
        self.asked = np.clip(self.need, 1, MORE)
        head = order[rank < np.repeat(many - self.need + self.asked, many)]
        self.item, code_, self.count, self.low, self.high = gathered(text[head], code[head], place[head], len(self.known))
        # the entries of a q-gram stand by the length of their items, so that those of fitting lengths are one range
        self.wide = int(self.lengths.max(initial=0)) + 2
        key = code_ * self.wide + self.lengths[self.item]
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.item, self.count, self.low, self.high = (x[order] for x in (self.item, self.count, self.low, self.high))
        self.own = np.cumsum(many) - many, many, code  # all q-grams of each item, for counting

    def number(self, gram: np.ndarray) -> np.ndarray:
        """The index of each q-gram, or -1."""
        if not len(self.known):
            return np.full(len(gram), -1)
        at = np.minimum(np.searchsorted(self.known, gram), len(self.known) - 1)
        return np.where(self.known[at] == gram, at, -1)

    def pairs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) of all pairs that the bounds do not rule out."""
        text, place, gram, lengths = grams(texts)
        code = self.number(gram)
        on = code >= 0
        text, code, count, low, high = gathered(text[on], code[on], place[on], max(1, len(self.known)))
        n = lengths[text]
        shortest = np.ceil(n * self.t / (2 - self.t) - 1e-9).astype(np.int64)
        longest = np.floor(n * (2 - self.t) / self.t + 1e-9).astype(np.int64)
        begin = np.searchsorted(self.key, code * self.wide + np.minimum(shortest, self.wide - 1))
        many = np.searchsorted(self.key, code * self.wide + np.minimum(longest, self.wide - 2), "right") - begin
        many = np.maximum(many, 0)
        found, hits = [], []
        # as many q-grams at a time as have PAIRS entries in the index
        cuts = np.searchsorted(np.cumsum(many), np.arange(0, many.sum() + PAIRS, PAIRS), "left")
        for lo, hi in zip(cuts[:-1].tolist(), [*cuts[1:-1].tolist(), len(code)]):
            if hi <= lo:
                continue
            m = many[lo:hi]
            row = np.repeat(np.arange(lo, hi), m)
            entry = np.arange(m.sum()) + np.repeat(begin[lo:hi] - (np.cumsum(m) - m), m)
            x, y = n[row], self.lengths[self.item[entry]]
            off = np.maximum(x, y) - least_matched(x + y, self.t)
            ok = (low[row] - self.high[entry] <= off) & (self.low[entry] - high[row] <= off)
            row, entry = row[ok], entry[ok]
            found.append(text[row] * len(self.items) + self.item[entry])
            hits.append(np.minimum(count[row], self.count[entry]))
        pair, at = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_inverse=True)
        hits = np.bincount(at, np.concatenate(hits) if hits else None, len(pair))
        left, item = pair // max(1, len(self.items)), pair % max(1, len(self.items))
        # texts longer than the shortest must share more q-grams, and all but need - asked of an item's are among its rarest here
        enough = hits >= shared(self.lengths[item], lengths[left], self.t) - self.need[item] + self.asked[item]
        left, item = self.counted(left[enough], item[enough], text, code, lengths)
        if len(self.loose):
            near = self.compatible(lengths[:, None], self.lengths[None, self.loose])
            a, b = np.nonzero(near)
            left, item = np.concatenate([left, a]), np.concatenate([item, self.loose[b]])
        return left, item

    def compatible(self, m, n):
        return 2 * np.minimum(m, n) >= self.t * (m + n) - 1e-9

    def counted(self, left, item, text, code, lengths) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose texts hold enough of the item's q-grams."""
        have = np.unique(text * len(self.known) + code)  # q-grams of the texts, in order
        starts, many, own = self.own
        keep = np.zeros(len(left), bool)
        step = max(1, PAIRS // max(1, int(many.max(initial=1))))
        for lo in range(0, len(left), step):
            a, b = left[lo : lo + step], item[lo : lo + step]
            m = many[b]
            row = np.repeat(np.arange(len(a)), m)
            grams_ = own[np.arange(m.sum()) + np.repeat(starts[b] - (np.cumsum(m) - m), m)]
            key = a[row] * len(self.known) + grams_
            at = np.minimum(np.searchsorted(have, key), max(0, len(have) - 1))
            hit = np.bincount(row, have[at] == key, len(a)) if len(have) else np.zeros(len(a))
            keep[lo : lo + step] = hit >= shared(self.lengths[b], lengths[a], self.t)
        return left[keep], item[keep]


def blocks(items: DataFrame, most: int = BLOCK) -> Iterator[list[str]]:
    """The texts of ``items(other)``, a block of bounded size at a time: their sizes are summed first."""
    size = items.agg(F.sum(F.length("other"))).first()[0] or 0
    parts = max(1, math.ceil(size / most))
    for k in range(parts):
        yield [r.other for r in items.where(F.pmod(F.xxhash64("other"), F.lit(parts)) == k).collect()]


def candidates(texts: DataFrame, items: DataFrame, t: float = config.NEAR_RATIO, most: int = BLOCK) -> DataFrame:
    """(text, other) of distinct ``texts(text)`` and ``items(other)`` that may reach the ratio ``t``: all that do, and few others.

    Every block of items is one reading of the texts; only pairs leave the tasks. Null and empty texts are in no pair.
    """
    texts = texts.select("text").where("text <> ''").distinct()
    context, out = texts.sparkSession.sparkContext, None
    for block in blocks(items.select("other").where("other <> ''").distinct(), most):
        sent = context.broadcast(Index(block, t))  # of a block's size, whatever the number of items

        def run(batches: Iterator, sent=sent) -> Iterator:
            index = sent.value
            names = np.array(index.items, object)
            for batch in batches:
                for lo in range(0, len(batch), 2048):
                    own = batch.column(0).slice(lo, 2048)
                    left, item = index.pairs(own.to_pylist())
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(left)), pa.array(names[item], pa.string())], ["text", "other"])

        found = texts.mapInArrow(run, "text string, other string")
        out = found if out is None else out.unionByName(found)
    return out


def near_pairs(texts: DataFrame, items: DataFrame, t: float = config.NEAR_RATIO, most: int = BLOCK) -> DataFrame:
    """[FLT-19] (text, other, ratio) of all distinct texts and items whose ratio reaches ``t``. Equal texts are joined, not compared."""
    found = candidates(texts, items, t, most)
    return found.select("text", "other", F.when(F.col("text") == F.col("other"), F.lit(1.0)).otherwise(block_ratio("text", "other")).alias("ratio")).where(F.col("ratio") >= t)


def sentences(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(key, text) of the trimmed sentences of each text (up to a full stop, question or exclamation mark, or a line's end) of at least so many characters."""
    parts = F.transform(F.split(F.col(text), r"(?<=[.!?])[ \t]+|\n"), lambda s: F.trim(s))
    return df.select(F.col(key), F.explode(F.array_distinct(parts)).alias("text")).where(F.length("text") >= least)


def shared_sentences(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, t: float = config.NEAR_RATIO, least: int = 20) -> DataFrame:
    """[FLT-19] Documents and items with sentences that are equal or nearly so: (doc_key, item_key, equal, near, best).

    ``equal`` and ``near`` are how many different sentences of the document have one in the item, ``best`` the highest ratio below 1 (0 if
    there is none). Sentences are compared once, whatever the number of documents that hold them.
    """
    left, right = sentences(docs, doc_key, "text", least), sentences(items, item_key, "text", least).withColumnRenamed("text", "other")
    pairs = near_pairs(left, right, t)
    of = pairs.join(right, "other").groupBy("text", item_key).agg(F.max("ratio").alias("ratio"))
    best = F.coalesce(F.max(F.when(F.col("ratio") < 1, F.col("ratio"))), F.lit(0.0))
    return left.join(of, "text").groupBy(doc_key, item_key).agg(F.count_if(F.col("ratio") == 1).alias("equal"), F.count_if(F.col("ratio") < 1).alias("near"), best.alias("best"))
