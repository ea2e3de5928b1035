"""Periodic runs of words: stretches that repeat a block at least four times, found per document.

A run is a stretch of consecutive words with smallest period q, at least max(SHORTEST, REPEATS * q) words long, that no neighbouring
word extends. Two copies of it, q words apart, overlap in at least K words (K is the least overlap over all periods), so each of
its words lies in a K-gram that occurs twice in the document. Everything else is masked out: K-grams of all documents of a slice are
hashed and sorted at once in NumPy (equal hashes of different K-grams only mask less). What survives falls into
segments, and the algorithm of Main and Lorentz finds the runs of each: it halves a segment again and again, and of every period
it takes, by Z-functions from the middle, how far the repetition that crosses the middle reaches to both sides.

Words are `[^\\x20\\x09-\\x0D]+`, compared as they are. Null texts have no words, a null id counts as the text ''. Rows are handled each on
its own, repeats and ties included, whatever their length; empty tables give empty results and further columns are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame

from ..functions.automaton import slices
from .common import text_of

SHORTEST, REPEATS = 6, 4
#: Least overlap of a run with itself, one period on: for the period 1 it is SHORTEST - 1, for period q it is (REPEATS - 1) * q.
K = min(max(SHORTEST, REPEATS * q) - q for q in range(1, SHORTEST + 1))
#: One document in so many (by the checksum of its id) has its tail made periodic before the search.
PLANTED = 10
#: Odd bases of the hashes of words and K-grams (any would do).
BYTE, WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def planted(doc_id, n: int) -> np.ndarray | None:
    """Which original word stands at each of n places if the checksum chooses the document."""
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % PLANTED or n == 0:
        return None
    g = h // PLANTED
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def word_bounds(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the number of words at last) of all words of a slice."""
    inside = np.concatenate([[False], ~WHITE[data], [False]])
    head, tail = ~inside[:-1] & inside[1:], inside[:-1] & ~inside[1:]
    cut = offsets[1:-1][inside[offsets[1:-1]] & inside[offsets[1:-1] + 1]]  # a word ends with its text
    head[cut], tail[cut] = True, True
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each word's bytes."""
    lengths = ends - starts
    if not len(starts):
        return np.zeros(0, np.uint64)
    places = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    powers = np.ones(int(lengths.max()), np.uint64)
    np.cumprod(np.full(len(powers) - 1, BYTE, np.uint64), out=powers[1:])
    terms = (data[np.repeat(starts, lengths) + places].astype(np.uint64) + np.uint64(1)) * powers[places]
    return np.add.reduceat(terms, np.cumsum(lengths) - lengths)


def survivors(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each word lies in a K-gram that occurs at least twice in its text."""
    n = len(hashes)
    keep = np.zeros(n + 1, np.int64)
    if n >= K:
        gram = np.zeros(n - K + 1, np.uint64)
        for k in range(K):
            gram = gram * WORD + hashes[k : n - K + 1 + k]
        gram ^= gram >> np.uint64(29)
        owner = np.searchsorted(first, np.arange(n - K + 1), "right") - 1
        at = np.flatnonzero(np.arange(n - K + 1) + K <= first[owner + 1])
        key = (gram[at] * WORD) ^ (owner[at].astype(np.uint64) * BYTE)
        order = np.argsort(key, kind="stable")
        twice = np.zeros(len(at) + 1, bool)
        np.equal(key[order][1:], key[order][:-1], out=twice[1:-1])
        repeated = at[order[twice[1:] | twice[:-1]]]
        np.add.at(keep, repeated, 1)
        np.add.at(keep, repeated + K, -1)
    return np.cumsum(keep)[:n] > 0


def z_function(x: list, most: int | None = None) -> list[int]:
    """How far x agrees with itself from each place on (0 at the first place), for the first ``most`` places."""
    n = len(x)
    z, lo, hi = [0] * n, 0, 0
    for i in range(1, min(n, most or n)):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z


def segment_runs(x: list[int]) -> dict[tuple[int, int], int]:
    """(start, end) -> smallest period of all runs of a segment, by divide and conquer around middles."""
    found: dict[tuple[int, int], int] = {}
    todo = [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < SHORTEST:
            continue
        mid, most = (lo + hi) // 2, (hi - lo) // REPEATS
        todo += [(lo, mid), (mid, hi)]
        left, right = x[lo:mid], x[mid:hi]
        back = left[::-1]
        ahead = z_function(right, most + 1)  # from the middle and q words on
        behind = z_function(back, most + 1)
        # ahead of the middle and q words before it; behind the middle and q words on
        over = z_function([*right, -1, *left[-most:], *right])[len(right) + 1 :]
        under = z_function([*back, -1, *right[:most][::-1], *back])[len(back) + 1 :]
        for q in range(1, most + 1):
            least = max(SHORTEST, REPEATS * q)
            spans = []
            if q <= len(right):
                up = ahead[q] if q < len(right) else 0
                spans.append((mid - under[min(most, len(right)) - q], mid + q + up))
            if q <= len(left):
                down = behind[q] if q < len(left) else 0
                spans.append((mid - q - down, mid + over[min(most, len(left)) - q]))
            for s, e in spans:
                s, e = max(s, lo), min(e, hi)
                # what goes on over an end of this part crosses the middle of a larger one
                if e - s >= least and not (s > 0 and x[s - 1] == x[s - 1 + q]) and not (e < len(x) and x[e] == x[e - q]):
                    if q < found.get((s, e), q + 1):
                        found[s, e] = q
    return found


def runs_of(keep: np.ndarray, word) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text, by start and period, from its surviving segments. ``word`` gives a word's bytes:
    segments are searched by numbers of the words themselves, not by hashes."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
    out = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if b - a >= SHORTEST:
            number: dict[bytes, int] = {}
            x = [number.setdefault(word(i), len(number)) for i in range(a, b)]
            out += [(a + s, e - s, q) for (s, e), q in segment_runs(x).items()]
    return sorted((s, n, q) for s, n, q in out if n >= max(SHORTEST, REPEATS * q))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stays: those that a run holds after its first period go."""
    gone = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        gone[s + q] += 1
        gone[s + length] -= 1
    return np.cumsum(gone)[:n] == 0


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, digest: bool = False) -> DataFrame:
    """doc_id, n_runs, the run with most repetitions (start, length, period, exponent_milli; nulls if there is none), and all runs
    (array of start, length, period) with the collapsed text, or with ``digest`` their sha256. ``plant`` makes the tails of some texts periodic first."""

    def rows(batch, lo: int, offsets: np.ndarray, data: np.ndarray) -> Iterator[dict]:
        starts, ends, first = word_bounds(offsets, data)
        hashes, raw = word_hashes(data, starts, ends), data.tobytes()
        ids = batch.column(0).slice(lo, len(offsets) - 1).to_pylist()
        source = np.arange(len(starts))  # which word of the slice stands at each place
        changed = set()
        if plant:
            for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                if (at := planted(ids[k], b - a)) is not None:
                    source[a:b] = a + at
                    changed.add(k)
        keep = survivors(hashes[source], first)
        busy = np.concatenate([[0], np.cumsum(keep)])[first]
        for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            word = lambda i, a=a: raw[starts[j := source[a + i]] : ends[j]]
            runs = runs_of(keep[a:b], word) if busy[k + 1] > busy[k] else []
            if runs or k in changed:
                stay = kept_words(b - a, runs)
                text = b" ".join([word(i) for i in np.flatnonzero(stay).tolist()])
            else:
                text = b" ".join(raw[offsets[k] : offsets[k + 1]].split())
            best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
            yield {"n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": 1000 * best[1] // best[2] if runs else None, "runs": runs, "text": text}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo, offsets, data in slices(batch.column(1)):
                got = list(rows(batch, lo, offsets, data))
                cols = [pa.array([g[c] for g in got], pa.int64()) for c in NUMBERS]
                if digest:
                    said = (("".join(f"{s},{n},{q}\n" for s, n, q in g["runs"]).encode(), g["text"]) for g in got)
                    cols += [pa.array(c) for c in zip(*((hashlib.sha256(a).hexdigest(), hashlib.sha256(b).hexdigest()) for a, b in said))]
                else:
                    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                    cols += [pa.array([[dict(zip(("start", "length", "period"), r)) for r in g["runs"]] for g in got], kind), pa.array([g["text"].decode() for g in got])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(got)), *cols], ["doc_id", *NUMBERS, *names])

    names = ["runs_sha256", "collapsed_sha256"] if digest else ["runs", "collapsed"]
    kind = docs.schema[id_col].dataType.simpleString()
    rest = "runs_sha256 string, collapsed_sha256 string" if digest else "runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return text_of(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in NUMBERS)}, {rest}")


NUMBERS = ("n_runs", "start", "length", "period", "exponent_milli")
