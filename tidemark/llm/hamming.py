"""Nearest binary codes within one part of a table: a multi-index over segments of the codes, and blocks compared by popcounts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

#: Bits of a segment, segments of a code that are indexed at most, and the largest radius of a search of one.
BITS, MOST, RADIUS = 16, 32, 5
#: Pairs compared at once, hits held before they are cut to the nearest, words of queries searched together.
BLOCK, HELD, BATCH = 1 << 17, 1 << 20, 3 << 19
#: In pairs that could be compared instead: looking up one entry, one neighbourhood of a segment's value, making an index.
LOOKUP, GROUP, INDEX = 1, 40_000, 1 << 28


def masks() -> list:
    """By radius, the values of a segment with that many bits set or fewer."""
    import numpy as np

    found = [np.array([sum(1 << b for b in c) for c in combinations(range(BITS), r)], np.int64) for r in range(RADIUS + 1)]
    return [np.sort(np.concatenate(found[: r + 1])) for r in range(RADIUS + 1)]


def share(reach: int, segments: int) -> float:
    """Rows that a search to the distance ``reach`` looks up, as a share of all rows, if codes are evenly spread."""
    from math import comb

    segments = min(segments, MOST)
    radius, more = divmod(reach + 1, segments)  # radius is the number of shells: one more than the radius of a segment
    if radius + (more > 0) > RADIUS + 1:
        return 1.0
    ball = lambda shells: sum(comb(BITS, i) for i in range(shells)) / (1 << BITS)
    return min(1.0, LOOKUP * (more * ball(radius + 1) + (segments - more) * ball(radius)))


class Index:
    """Rows by the value of one segment: those of a value stand together."""

    def __init__(self, values, words):
        import numpy as np

        order = np.argsort(values, kind="stable")
        self.order, self.words = order.astype(np.int32), words[:, order]
        self.count = np.bincount(values, minlength=1 << BITS)
        self.start = np.cumsum(self.count) - self.count

    def balls(self):
        """How many rows lie within a radius of a value, at [radius + 1, value]; nothing at 0, and more than can be at the end."""
        import numpy as np

        shells = np.zeros((RADIUS + 1, 1 << BITS), np.int32)
        shells[0] = self.count
        for b in range(BITS):
            flipped = shells.reshape(RADIUS + 1, -1, 2, 1 << b)[:, :, ::-1].reshape(shells.shape)
            shells[1:] += flipped[:-1]
        return np.concatenate([np.zeros((1, 1 << BITS), np.int32), np.cumsum(shells, 0, dtype=np.int32), np.full((1, 1 << BITS), 1 << 30, np.int32)])

    def near(self, value: int, ball):
        """Places, in the order of the index, of the rows whose value differs from ``value`` by one of the masks in ``ball``."""
        import numpy as np

        values = ball ^ value
        count = self.count[values]
        end = np.cumsum(count)
        return np.arange(end[-1]) + np.repeat(self.start[values] - end + count, count)


class Part:
    """Entries (code, its ids in ascending order) whose codes have one number of components.

    ``nearest`` finds all entries within a distance. A row at distance d of a query differs from it in some segment by the segment's radius or
    less if the radii, each with one added, add up to more than d; a segment that is not searched counts as radius -1. Which radii
    a query takes goes by the rows that they lead to, counted beforehand; where these are too many, all rows are compared.
    """

    def __init__(self, codes, ids, starts):
        import numpy as np

        self.words = np.ascontiguousarray(codes.T)
        self.ids, self.starts = ids, starts
        self.first, self.lone = ids[starts[:-1]], np.diff(starts) == 1
        self.second = ids[np.minimum(starts[:-1] + 1, len(ids) - 1)]
        self.index = None
        counts = np.uint8 if len(self.words) < 4 else np.uint16
        self.room = [np.empty(BLOCK, t) for t in (np.uint64, np.uint8, counts, bool)]  # of one block; else each would ask for memory anew

    def nearest(self, asker, codes, reach, k: int):
        """(query, distance, id) of the k nearest ids, ties by id, within the distance ``reach`` of each query; not those of the asker itself."""
        import numpy as np

        self.asker, self.k, self.reach = asker, k, np.minimum(reach, 64 * len(self.words))
        self.asked, self.held, self.size, self.kept = np.ascontiguousarray(codes.T), [], 0, 0
        queries = np.arange(len(codes))
        if self.words.shape[1] * len(codes) > INDEX * len(self.words):
            queries = self._look_up(codes)
        self._scan(queries)
        self._cut()
        query, entry, distance = self.held[0]
        count = np.diff(self.starts)[entry]
        at = np.arange(count.sum()) + np.repeat(self.starts[entry] - np.cumsum(count) + count, count)
        query, distance, ids = np.repeat(query, count), np.repeat(distance, count), self.ids[at]
        other = ids != asker[query]
        query, distance, ids = query[other], distance[other], ids[other]
        order = np.lexsort((ids, distance, query))
        order = order[self._place(query[order]) < k]
        return query[order], distance[order], ids[order]

    def _look_up(self, codes):
        """Searches by the index where that is the least work; returns the queries that are left."""
        import numpy as np

        n, segments = len(codes), min(MOST, 4 * len(self.words))
        cut = lambda words: np.ascontiguousarray(words).view(np.uint16)[:, :segments]
        if self.index is None:
            values = cut(self.words.T)
            self.index = [Index(values[:, s], self.words) for s in range(segments)]
            self.balls, self.masks = np.stack([i.balls() for i in self.index]), masks()
            # rows that a step leads to, on a coarse scale: queries that share a value then share radii, if segments hardly differ
            self.steps = np.rint(2 * np.log2(1 + np.diff(self.balls, axis=1).astype(np.float32))).astype(np.int8)
        values = cut(codes).astype(np.int32)
        # the radius grows by one in the segment where that leads to the fewest more rows, until the distance is reached
        radius, live, shells = np.zeros((n, segments), np.int8), np.arange(n), 0
        more, total = self.steps[np.arange(segments)[None, :], 0, values], np.zeros(n, np.int64)
        while len(live):
            s = more[live].argmin(1)
            r, v = radius[live, s], values[live, s]
            total[live] += self.balls[s, r + 1, v] - self.balls[s, r, v]
            radius[live, s] += 1
            more[live, s] = self.steps[s, np.minimum(r + 1, RADIUS + 1), v]
            shells += 1
            live = live[(self.reach[live] >= shells) & (total[live] < self.words.shape[1])]
        used = (radius > 0).sum(1)
        little = LOOKUP * total + used * GROUP * (1 << BITS) // max(n, 1 << BITS) < self.words.shape[1]
        for s, index in enumerate(self.index):
            queries = np.flatnonzero(little & (radius[:, s] > 0))
            key = values[queries, s] * 8 + radius[queries, s] - 1
            order = np.argsort(key, kind="stable")
            queries, key = queries[order], key[order]
            cuts = np.flatnonzero(np.diff(key, prepend=-1, append=-1))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                at = index.near(int(key[lo]) >> 3, self.masks[int(key[lo]) & 7])
                if len(at):
                    self._compare(queries[lo:hi], index.words.take(at, 1), lambda x, at=at, order=index.order: order[at[x]])
        return np.flatnonzero(~little)

    def _scan(self, queries) -> None:
        """All rows. Counts of the distances seen so far tighten the reach."""
        import numpy as np

        step = 64
        for lo in range(0, len(queries), step):
            some = queries[lo : lo + step]
            seen = np.zeros((len(some), 64 * len(self.words) + 1), np.int64)
            self._compare(some, self.words, lambda x: x.astype(np.int32), seen)

    def _compare(self, queries, words, rows, seen=None) -> None:
        """Holds the pairs of queries and rows that are within reach; ``rows`` tells the entries of columns of ``words``. Rows are
        distinct; ``seen`` has the number of others by query and distance."""
        import numpy as np

        wide = 64 * len(self.words) + 1
        step = max(1, BLOCK // max(1, words.shape[1])) if seen is None else len(queries)
        width = BLOCK // min(step, len(queries))
        for top in range(0, len(queries), step):
            some = queries[top : top + step]
            asked, reach = self.asked[:, some], self.reach[some]
            fresh = 0
            for lo in range(0, words.shape[1], width):
                part = words[:, lo : lo + width]
                shape = len(some), part.shape[1]
                differ, bits, apart, within = (x[: shape[0] * shape[1]].reshape(shape) for x in self.room)
                for w, (a, b) in enumerate(zip(asked, part)):
                    np.bitwise_xor(a[:, None], b[None, :], out=differ)
                    np.bitwise_count(differ, out=bits if w else apart)
                    if w:
                        apart += bits
                np.less_equal(apart, reach.astype(apart.dtype)[:, None], out=within)
                hit = self._true(apart.size)
                if not len(hit):
                    continue
                q, e, d = hit // part.shape[1], rows(lo + hit % part.shape[1]), apart.ravel()[hit].astype(np.int32)
                other = ~(self.lone[e] & (self.first[e] == self.asker[some[q]]))
                q, e, d = q[other], e[other], d[other]
                fresh += len(q)
                if seen is not None or len(q) > 8 * self.k * len(some):
                    counts = np.bincount(q * wide + d, minlength=len(some) * wide).reshape(-1, wide)
                    if seen is not None:
                        seen += counts
                        counts = seen
                    if fresh > 2 * self.k * len(some):
                        fresh = 0
                        enough = np.cumsum(counts, 1) >= self.k
                        reach = np.where(enough[:, -1], np.minimum(reach, enough.argmax(1)), reach)
                        near = d <= reach[q]
                        q, e, d = q[near], e[near], d[near]
                self.held.append((some[q].astype(np.int32), e, d))
                self.size += len(q)
                if self.size > max(HELD, self.kept):
                    self._cut()
                    reach = np.minimum(reach, self.reach[some])

    def _true(self, size: int):
        """Places of what is within reach among the first ``size`` pairs of a block; eight are looked at together, as few are."""
        import numpy as np

        within = self.room[-1]
        within[size : -(-size // 8) * 8] = False
        some = np.flatnonzero(within[: -(-size // 8) * 8].view(np.uint64))
        places = (some[:, None] * 8 + np.arange(8)[None, :]).ravel()
        return places[within[places]]

    def _cut(self) -> None:
        """Leaves the k nearest entries of a query, by distance and by their first id, and tightens its reach. Pairs held twice are one."""
        import numpy as np

        none = np.zeros(0, np.int32)
        q, e, d = (np.concatenate([none, *x]) for x in (zip(*self.held) if self.held else ((), (), ())))
        self.held = []
        first = np.where(self.first[e] == self.asker[q], self.second[e], self.first[e])
        order = np.lexsort((e, first, q.astype(np.int64) * (64 * len(self.words) + 1) + d))
        q, e, d = q[order], e[order], d[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (e[1:] != e[:-1])
        q, e, d = q[new], e[new], d[new]
        place = self._place(q)
        last = place == self.k - 1
        self.reach[q[last]] = np.minimum(self.reach[q[last]], d[last])
        keep = place < self.k
        self.held, self.size, self.kept = [(q[keep], e[keep], d[keep])], 0, int(keep.sum())

    @staticmethod
    def _place(q):
        """Place of each row among those of its query, where queries are sorted."""
        import numpy as np

        begins = np.flatnonzero(np.diff(q, prepend=-1))
        return np.arange(len(q)) - np.repeat(begins, np.diff(np.append(begins, len(q))))


class Rows:
    """Rows of Arrow batches, in numpy: ids or lists of ids, and codes, apart by their number of components."""

    def __init__(self):
        self.held, self.words = [], 0

    def add(self, batch) -> None:
        self.held.append(batch)
        self.words += len(batch.column(4).flatten())

    def by_length(self) -> Iterator:
        """(components, codes, id, reach, ids, starts of ids)"""
        import numpy as np
        import pyarrow as pa

        if not self.held:
            return
        t = pa.Table.from_batches(self.held).combine_chunks()
        lists = [c.chunk(0) for c in (t.column(4), t.column(5))]
        (code, ids), (size, ids_of) = ([x.flatten().to_numpy() for x in lists], [x.value_lengths().to_numpy() for x in lists])
        asker, reach = t.column(2).to_numpy(), t.column(3).to_numpy()
        start, ids_start = np.cumsum(size) - size, np.cumsum(ids_of) - ids_of
        length = code[start]
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            codes = code[start[at][:, None] + 1 + np.arange(size[at[0]] - 1)[None, :]].view(np.uint64)
            count = ids_of[at]
            ends = np.cumsum(count)
            picked = ids[np.arange(count.sum()) + np.repeat(ids_start[at] - ends + count, count)]
            yield n, codes, asker[at], reach[at], picked, np.concatenate([[0], ends])


SCHEMA = "part int, asks boolean, id long, reach int, code array<long>, ids array<long>"


def search(batches: Iterator, k: int) -> Iterator:
    """Rows of SCHEMA, sorted by part and asks, so that a part's entries precede its queries, to (query_id, distance, id)."""
    import numpy as np
    import pyarrow as pa

    at, entries, asked, index = None, Rows(), Rows(), None

    def answer():
        nonlocal index, entries, asked
        if index is None:
            index = {n: Part(codes, ids, starts) for n, codes, _, _, ids, starts in entries.by_length()}
            entries = Rows()
        lengths, asked = list(asked.by_length()), Rows()  # batches are let go before the search
        for n, codes, asker, reach, _, _ in lengths:
            if n in index:
                q, d, ids = index[n].nearest(asker, codes, reach, k)
                for lo in range(0, len(q), 1 << 16):
                    s = slice(lo, lo + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(asker[q[s]], pa.int64()), pa.array(d[s], pa.int32()), pa.array(ids[s], pa.int64())], ["query_id", "distance", "id"])

    for batch in batches:
        if not len(batch):
            continue
        part, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(part * 2 + asks, prepend=-1)).tolist() + [len(batch)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if part[lo] != at:
                yield from answer()
                at, entries, index = part[lo], Rows(), None
            (asked if asks[lo] else entries).add(batch.slice(lo, hi - lo))
            if asked.words > BATCH:
                yield from answer()
    yield from answer()
