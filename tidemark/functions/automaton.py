"""Many-pattern search: one Aho-Corasick automaton over bytes finds all terms of all lexicons in one pass over Arrow buffers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa


class Automaton:
    """Transitions as one dense table (state x byte class), completed by failure links, built level by level of the trie.

    The state after a byte depends on no more than the last ``longest`` bytes, so a buffer is cut into lanes, each warmed up
    on the bytes before it, and all lanes step together: one gather a step, whatever the number of terms.
    """

    #: Bytes that a lane reads after its warm-up, at least.
    LANE = 256

    def __init__(self, terms: Sequence[bytes]):
        if any(not t for t in terms):
            raise ValueError("a term must not be empty")
        self.terms = list(terms)
        self.lengths = np.array([len(t) for t in terms], np.int64)
        self.longest = int(self.lengths.max()) if len(terms) else 1
        used = sorted(set(b"".join(self.terms)))
        self.classes = np.zeros(256, np.uint8 if len(used) < 256 else np.uint16)  # class 0: bytes that stand in no term
        self.classes[used] = np.arange(1, len(used) + 1)
        children, end_of = [{}], []
        depth_of = [0]
        for t in self.terms:
            s = 0
            for b in t:
                nxt = children[s].get(b)
                if nxt is None:
                    nxt = children[s][b] = len(children)
                    children.append({})
                    depth_of.append(depth_of[s] + 1)
                s = nxt
            end_of.append(s)
        n, width = len(children), len(used) + 1
        parent, step = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for s, kids in enumerate(children):
            for b, c in kids.items():
                parent[c], step[c] = s, self.classes[b]
        depth, table, fail = np.array(depth_of), np.zeros((n, width), np.int32), np.zeros(n, np.int64)
        levels = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[levels], np.arange(depth.max() + 2))
        level = lambda d: levels[cuts[d] : cuts[d + 1]] if d + 1 < len(cuts) else levels[:0]
        for d in range(len(cuts) - 1):
            here, kids = level(d), level(d + 1)
            if d:
                fail[kids] = table[fail[parent[kids]], step[kids]]
                table[here] = table[fail[here]]
            table[parent[kids], step[kids]] = kids
        own: list[list[int]] = [[] for _ in range(n)]
        for k, s in enumerate(end_of):
            own[s].append(k)
        found: list[tuple[int, ...]] = [()] * n
        for s in levels.tolist():  # a state also ends the terms that its failure ends
            found[s] = (*own[s], *found[fail[s]]) if s else ()
        ends = np.array([len(f) for f in found])
        order = np.argsort(ends > 0, kind="stable")  # states that end a term stand last
        place = np.argsort(order)
        self.width, self.first = width, int((ends == 0).sum()) * width
        self.table = (place[table[order]] * width).astype(np.int32).ravel()
        self.ends = np.concatenate([[0], np.cumsum(ends[order])])
        self.found = np.array([k for s in order.tolist() for k in found[s]], np.int64)

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(term, end) of all occurrences in a buffer, overlapping ones too, by end."""
        n, warm = len(data), self.longest - 1
        none = np.zeros(0, np.int64)
        if n == 0 or not self.terms:
            return none, none
        lane = max(self.LANE, 4 * self.longest, n >> 14)
        lanes = -(-n // lane)
        codes = np.zeros(lanes * lane + warm, self.classes.dtype)
        codes[warm : warm + n] = self.classes[data]
        state, at, states = np.zeros(lanes, np.int32), [], []
        for t in range(lane + warm):
            state = self.table[state + codes[t::lane][:lanes]]
            if t >= warm:
                hit = np.flatnonzero(state >= self.first)
                if len(hit):
                    at.append(hit * lane + (t - warm))
                    states.append(state[hit] // self.width)
        if not at:
            return none, none
        at, states = np.concatenate(at), np.concatenate(states)
        order = np.argsort(at, kind="stable")
        at, states = at[order], states[order]
        many = self.ends[states + 1] - self.ends[states]
        before = np.repeat(self.ends[states] - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
        return self.found[np.arange(many.sum()) + before], np.repeat(at + 1, many)

    def search(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, start) of all occurrences inside one of the texts between ``offsets``, by end."""
        term, end = self.hits(data)
        start = end - self.lengths[term]
        text = np.searchsorted(offsets, end, "left") - 1
        inside = start >= offsets[text]
        return text[inside], term[inside], start[inside]

    @cached_property
    def borders(self) -> np.ndarray:
        """Whether each term can overlap itself."""
        return np.array([any(t.startswith(t[k:]) for k in range(1, len(t))) for t in self.terms], bool)


def leftmost(text: np.ndarray, term: np.ndarray, start: np.ndarray, lengths: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Which occurrences a replacement of each term on its own would take: from the left, none overlapping the one before."""
    keep = np.ones(len(term), bool)
    some = np.flatnonzero(borders[term])  # other terms cannot overlap themselves
    last, free = None, 0
    for k in some[np.lexsort((start[some], term[some], text[some]))].tolist():
        one = (text[k], term[k])
        keep[k] = one != last or start[k] >= free
        if keep[k]:
            last, free = one, start[k] + lengths[term[k]]
    return keep


@lru_cache(64)
def automaton(terms: tuple[str, ...]) -> Automaton:
    return Automaton([t.encode() for t in terms])


#: A table of more bytes than this is sent to each executor once, as a broadcast; smaller ones travel with the tasks.
TRAVELS = 1 << 20
#: Bytes of text that are searched at once; the arrays of a search are many times as large, and every task has its own.
SLICE = 1 << 20


def shared(terms: tuple[str, ...]):
    """A function that gives the automaton on an executor. Its size follows the terms, which are a parameter, not the data."""
    a = automaton(terms)
    if a.table.nbytes <= TRAVELS:
        return lambda: a
    from pyspark.sql import SparkSession

    sent = SparkSession.active().sparkContext.broadcast(a)
    return lambda: sent.value


def slices(texts, most: int = SLICE):
    """(first, offsets, bytes) of parts of an Arrow array of strings, each of up to ``most`` bytes or one text; null texts are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
        lo = hi


def parts(texts, most: int = SLICE):
    """Parts of an Arrow array of strings, each of up to ``most`` bytes or one text."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def code_points(data: np.ndarray) -> np.ndarray:
    """How many code points begin before each byte."""
    out = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def lexicon_hits(c, groups: Mapping[str, Sequence[str]], each: bool = False):
    """[JN-11, AG-3, AG-4] One pass over a text for all lexicons: struct of a struct (hits, total, first) for each group.

    ``hits`` is how many different terms occur, ``total`` how often all terms of the group occur together (each term counted as a
    replacement of it would, from the left and not overlapping itself), ``first`` the code point at which the first occurrence
    starts, or -1. Null texts give a null struct; a group without terms has no hits; a term named twice counts as often in ``total``.
    With ``each`` the column holds arrays of texts, and the result is an array of such structs.
    """
    from pyspark.sql import functions as F

    names = list(groups)
    if not names:
        raise ValueError("name at least one lexicon")
    terms = tuple(dict.fromkeys(t for ts in groups.values() for t in ts))
    place = {t: k for k, t in enumerate(terms)}
    member = np.zeros((len(names), len(terms)), np.int64)
    for g, name in enumerate(names):
        for t in groups[name]:
            member[g, place[t]] += 1
    get = shared(terms)
    kind = f"struct<{', '.join(f'`{n}`: struct<hits: int, total: int, first: int>' for n in names)}>"

    def count(texts: pa.Array) -> pa.Array:
        a, n = get(), len(texts)
        hits, total, first = (np.full((len(names), n), v, np.int32) for v in (0, 0, -1))
        for lo, offsets, data in slices(texts):
            text, term, start = a.search(offsets, data)
            if not len(text):
                continue
            taken = leftmost(text, term, start, a.lengths, a.borders)
            pair = np.unique(text * len(terms) + term)
            points, m = code_points(data), len(offsets) - 1
            for g in range(len(names)):
                hits[g, lo : lo + m] = np.bincount(pair // len(terms), (member[g] > 0)[pair % len(terms)], m)
                total[g, lo : lo + m] = np.bincount(text[taken], member[g][term[taken]], m)
                own = member[g][term] > 0
                least = np.full(m, len(data))
                np.minimum.at(least, text[own], start[own])
                some = np.flatnonzero(least < len(data))
                first[g, lo + some] = points[least[some]] - points[offsets[some]]
        parts = [pa.StructArray.from_arrays([pa.array(x[g]) for x in (hits, total, first)], ["hits", "total", "first"]) for g in range(len(names))]
        return pa.StructArray.from_arrays(parts, names, mask=texts.is_null())

    def of_arrays(lists: pa.Array) -> pa.Array:
        found = count(lists.flatten())  # what null lists may hold is left out
        ends = np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found, mask=lists.is_null())

    if each:

        @F.arrow_udf(f"array<{kind}>")
        def run(lists: pa.Array) -> pa.Array:
            return of_arrays(lists)

    else:

        @F.arrow_udf(kind)
        def run(texts: pa.Array) -> pa.Array:
            return count(texts)

    return run(F.col(c) if isinstance(c, str) else c)
