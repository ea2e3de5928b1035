"""Exact repeated-substring removal by a logarithmic family of sparse suffix arrays.

Texts are UTF-8 bytes. Every LENGTH-byte window chooses one anchor inside it, the position whose DEPTH bytes have the
least hash, so equal windows choose equal anchors, and about one position in forty is indexed. A suffix array holds the
anchors of a batch in the order of the text that follows them (the first four bytes as they are, then a fingerprint of DEPTH bytes).
A new batch gets a suffix array of its own and is scanned in merge order against the levels that exist; suffixes that
agree to DEPTH bytes are kept as matches. Two levels of the same rank merge into one of the next rank, so that a batch meets
a number of levels logarithmic in the number of batches.

Matches are then settled exactly. An anchor carries the run of windows that chose it and a fingerprint of all their bytes: where whole
runs agree, all but the earliest are repeats. Runs that differ somewhere are compared window by window,
where the runs of a key are few in one task, otherwise by a shuffle of window fingerprints. A byte is removed if a window over it
also starts earlier: at a smaller id, or earlier in the same document. Everything is judged on the input.

A null text is an empty one. A null id counts as larger than all others. Rows that share an id (null ids too) are told apart by a 64-bit hash
of their text and ordered by it; equal rows (same id, same text) don't count as copies of each other. Fingerprints have 64 bits and are
compared only between suffixes that agree to DEPTH bytes. Other columns are passed through where asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .classify import byte_batches, mix
from .common import Tables, replaced, text_of, with_row

LENGTH, DEPTH, BATCHES = 100, 24, 4
#: Keys with more different runs are compared by a shuffle of their windows, so that no task gets them all.
MANY = 20_000
#: Groups with more than one in so many of all rows, of which there are fewer than this, are sent to the rows instead of being dealt.
HEAVY = 1000
#: Bytes of text that are hashed at a time; a longer text is taken in overlapping parts.
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LAST = (1 << 63) - 1
#: A place: the start, and in the last 7 bits the run length.
_RUN = 7


def running(data):
    """Running sums of table[byte] * base^place, and the inverse powers, from which the hash of any stretch follows."""
    import numpy as np

    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    n = len(data)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]))
    total = np.concatenate([[np.uint64(0)], np.cumsum(table[data] * power[:-1])])
    return total, np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE, np.uint64)]))


def parts(offsets, data) -> Iterator[tuple]:
    """(number of the first text, start of the part in it, offsets, bytes): a slice itself, or overlapping parts of one long text."""
    import numpy as np

    if len(data) <= 4 * SLICE:
        yield 0, 0, offsets, data
        return
    for a in range(0, max(1, len(data) - LENGTH + 1), 4 * SLICE):
        piece = data[a : a + 4 * SLICE + LENGTH - 1]
        yield 0, a, np.array([0, len(piece)]), piece


def anchors(offsets, data, length: int = LENGTH, depth: int = DEPTH):
    """The runs of windows that choose one anchor: (text, anchor's key, fingerprint of the run, first window, windows - 1)."""
    import numpy as np

    none = np.zeros(0, np.int64)
    windows = len(data) - length + 1
    if windows <= 0:
        return none, none, none, none, none
    total, inverse = running(data)
    h = mix((total[depth:] - total[:-depth]) * inverse[: len(data) - depth + 1])
    low = np.uint64((1 << 24) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, size = length - depth + 1, 1
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    m = np.minimum(m[:windows], m[width - size : width - size + windows])
    # windows inside one text
    good = np.zeros(len(data) + 1, np.int32)
    lens = np.diff(offsets)
    long = lens >= length
    np.add.at(good, offsets[:-1][long], 1)
    np.add.at(good, (offsets[1:] - length + 1)[long], -1)
    j = np.flatnonzero(np.cumsum(good)[:windows] > 0)
    if not len(j):
        return none, none, none, none, none
    at = (m[j] & low).astype(np.int64)
    text = np.searchsorted(offsets, j, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (j[1:] != j[:-1] + 1)]))
    first, last, at, text = j[new], j[np.append(new[1:], len(j)) - 1], at[new], text[new]
    head = sum(data[at + i].astype(np.uint64) << np.uint64(24 - 8 * i) for i in range(4))
    key = (head << np.uint64(32)) | (h[at] >> np.uint64(32))
    run = (total[last + length] - total[first]) * inverse[first]
    run = mix(mix(run) + (at - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (last - first).astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    return text, key.view(np.int64), run.view(np.int64), first - offsets[text], last - first


def keyed(plain: DataFrame, shared: bool, *keep: str) -> DataFrame:
    """doc, tag, text of (doc_id, text): ids with null as the largest; if rows share ids, ``tag`` is a hash of the text, else 0."""
    tag = F.xxhash64("text") if shared else F.lit(0).cast("long")
    return plain.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), tag.alias("tag"), "text", *keep)


def ids_shared(plain: DataFrame) -> bool:
    """Whether two rows have one ``doc``; null counts as the largest id here, too."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc")
    return not plain.groupBy(doc).count().where("count > 1").isEmpty()


def by_group(rows: DataFrame, groups: DataFrame, by: list[str], total: int) -> DataFrame:
    """Inner join of rows with one row a group, which has the number of its rows in ``n``; all groups together have at most ``total`` rows.

    A common passage is one group of very many rows. Groups of more than a ``HEAVY``-th of the rows are broadcast (they are fewer
    than ``HEAVY``, whatever the input), the others meet their rows by a shuffle, so no task gets a hot group whole.
    """
    hot = F.col("n") > total // HEAVY
    heavy = groups.where(hot)
    rest = rows.join(F.broadcast(heavy.select(*by)), by, "left_anti").join(groups.where(~hot), by)
    return rows.join(F.broadcast(heavy), by).unionByName(rest)


def suffix_array(plain: DataFrame) -> DataFrame:
    """Anchors of a batch of (doc, tag, text): key, run (fingerprint), doc, tag and place, in key order within partitions.

    They are dealt by key and document, as one key may hold a good part of all anchors.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            doc, tag = batch.column(0), batch.column(1)
            for lo, offsets, data in byte_batches(batch, 2, SLICE):
                for _, begin, o, d in parts(offsets, data):
                    text, key, fp, first, more = anchors(o, d)
                    where, of = ((first + begin) << _RUN) + more, pa.array(lo + text)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), doc.take(of), tag.take(of), pa.array(where)], ["key", "run", "doc", "tag", "place"])

    return plain.mapInArrow(run, "key long, run long, doc long, tag long, place long").repartition("key", "doc").sortWithinPartitions("key", "run")


class IndexFamily:
    """Levels of suffix arrays over all batches so far; ``add`` scans a new batch against them."""

    def __init__(self, spark: SparkSession, tables: Tables):
        self.spark, self.tables = spark, tables
        self.levels: list[tuple[int, str, DataFrame]] = []  # rank, table, rows
        self.matches: list[DataFrame] = []
        self.found: list[str] = []  # tables of candidates
        self.added = 0

    def add(self, plain: DataFrame, more: bool = True) -> DataFrame:
        """Index a batch; returns the keys of its suffixes that occur twice in it or also in a level, with the number of times up to now. ``more``: further batches follow."""
        name = f"level0-{self.added}"
        new = self.tables.save(suffix_array(plain), name)
        scan = new.select("key", F.lit(1).alias("new"))
        for _, _, level in self.levels:
            scan = scan.union(level.select("key", F.lit(0)))
        met = scan.groupBy("key").agg(F.count("*").alias("n"), F.max("new").alias("new")).where("n > 1 and new = 1").select("key", "n")
        self.matches.append(self.tables.save(met, f"matches-{self.added}"))
        self.levels.append((0, name, new))
        self.added += 1
        while more and len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a, x), (_, b, y) = self.levels[-2:]
            self.tables.release()  # what the batch has shuffled is not kept beside the merge
            name = f"level{rank + 1}-{self.added}"
            self.levels[-2:] = [(rank + 1, name, self.tables.save(x.union(y).repartition("key", "doc").sortWithinPartitions("key", "run"), name))]
            self.tables.drop(a, b)
        self.tables.release()
        return self.matches[-1]

    def candidates(self) -> DataFrame:
        """All suffixes whose key was matched: key, run, doc, tag, place.

        Levels are looked through one at a time, the smallest first, and each goes when it is done, as all levels beside the
        shuffle of all levels would be twice the disk.
        """
        keys, total = self.matches[0], sum(level.count() for _, _, level in self.levels)
        for m in self.matches[1:]:
            keys = keys.union(m)
        # the last batch that holds a key has counted it in all
        keys = self.tables.save(keys.groupBy("key").agg(F.max("n").alias("n")), "keys")
        self.tables.drop(*[f"matches-{i}" for i in range(self.added)])
        rows = []
        for _, name, level in reversed(self.levels):
            self.found.append(f"candidates-{len(rows)}")
            rows.append(self.tables.save(by_group(level, keys, ["key"], total).drop("n"), self.found[-1]))
            self.tables.drop(name)
            self.tables.release()
        self.tables.drop("keys")
        self.levels, self.matches = [], []
        return reduce(DataFrame.union, rows)


def _asked(plain: DataFrame, runs: DataFrame) -> DataFrame:
    """Texts with the runs (key, place) that are asked of them; a list is bounded by its text's length."""
    asked = runs.groupBy("doc", "tag").agg(F.collect_list(F.struct("key", "place")).alias("asked"))
    return plain.join(asked, ["doc", "tag"]).select("doc", "tag", "text", "asked")


def _slices(batch) -> Iterator[tuple]:
    """For each slice of a batch of ``_asked``: bytes, doc and tag of the slice, and its runs: text, key, start, windows."""
    import numpy as np

    lists = batch.column(3)
    pairs, cut = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    keys, places = pairs.field(0).to_numpy(), pairs.field(1).to_numpy()
    for lo, offsets, data in byte_batches(batch, 2, SLICE):
        n = len(offsets) - 1
        rows = slice(cut[lo], cut[lo + n])
        text = np.repeat(np.arange(n), np.diff(cut[lo : lo + n + 1]))
        start, windows = places[rows] >> _RUN, (places[rows] & ((1 << _RUN) - 1)) + 1
        yield data, offsets, batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), text, keys[rows], start, windows


def spread(counts):
    """0, 1, .. counts[0] - 1, 0, 1, .. and the number of the row that each belongs to."""
    import numpy as np

    row = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts), row


def window_hashes(plain: DataFrame, runs: DataFrame) -> DataFrame:
    """One row for each window of ``runs`` (key, doc, tag, place): key, window (fingerprint), doc, tag, place (of the window, run length 0)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for data, offsets, doc, tag, text, key, start, windows in _slices(batch):
                total, inverse = running(data)
                for part in np.array_split(np.arange(len(key)), max(1, len(key) // 8192)):
                    k, row = spread(windows[part])
                    row = part[row]
                    j = start[row] + k
                    at = offsets[text[row]] + j
                    h = mix((total[at + LENGTH] - total[at]) * inverse[at])
                    of = pa.array(text[row])
                    yield pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array(h.view(np.int64)), doc.take(of), tag.take(of), pa.array(j << _RUN)], ["key", "window", "doc", "tag", "place"])

    return _asked(plain, runs).mapInArrow(run, "key long, window long, doc long, tag long, place long")


def contexts(plain: DataFrame, runs: DataFrame) -> DataFrame:
    """The bytes of all windows of each run: key, doc, tag, place, context."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for data, offsets, doc, tag, text, key, start, windows in _slices(batch):
                raw, at = data.tobytes(), offsets[text] + start
                parts = [raw[a:b] for a, b in zip(at.tolist(), (at + windows - 1 + LENGTH).tolist())]
                of = pa.array(text)
                yield pa.RecordBatch.from_arrays([pa.array(key), doc.take(of), tag.take(of), pa.array((start << _RUN) + windows - 1), pa.array(parts, pa.binary())], ["key", "doc", "tag", "place", "context"])

    return _asked(plain, runs).mapInArrow(run, "key long, doc long, tag long, place long, context binary")


def settle(rows: DataFrame) -> DataFrame:
    """Removed spans (doc, tag, place of the first window with run length) among the runs of each key, compared window by window.

    Rows are dealt by key and sorted by key, doc, tag and place; a task goes through them in order and holds the runs of a few
    thousand keys at a time. Keys with very many different runs don't come here.
    """

    def ready(t) -> Iterator:
        import numpy as np
        import pyarrow as pa

        context = t.column("context").combine_chunks()
        context = context.chunk(0) if hasattr(context, "chunk") else context
        _, offsets, data = context.buffers()
        offsets = np.frombuffer(offsets, np.int32)[context.offset : context.offset + len(t) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        total, inverse = running(data)
        k, row = spread(np.diff(offsets) - LENGTH + 1)
        at = offsets[row] + k
        h = mix((total[at + LENGTH] - total[at]) * inverse[at])
        key = t.column("key").to_numpy().view(np.uint64)
        h = mix(h + key[row] * np.uint64(0xD6E8FEB86659FD93))
        gone = np.ones(len(h), bool)
        gone[np.unique(h, return_index=True)[1]] = False
        # runs of removed windows that follow each other in one row
        g = np.flatnonzero(gone)
        if not len(g):
            return
        new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1] + 1) | (row[g[1:]] != row[g[:-1]])]))
        first, last = g[new], g[np.append(new[1:], len(g)) - 1]
        place = t.column("place").to_numpy()[row[first]]
        where = (place & ~np.int64((1 << _RUN) - 1)) + (k[first] << _RUN) + (last - first)
        of = pa.array(row[first])
        yield pa.RecordBatch.from_arrays([t.column("doc").combine_chunks().take(of), t.column("tag").combine_chunks().take(of), pa.array(where)], ["doc", "tag", "place"])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held, size = [], 0
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                part = batch.slice(lo, 4096)
                held.append(part)
                size += len(part)
                keys = part.column(0)
                if keys[0].as_py() != keys[-1].as_py() or held[0].column(0)[0].as_py() != keys[0].as_py():
                    t = pa.Table.from_batches(held)
                    cut = int(np.searchsorted(t.column("key").to_numpy(), keys[-1].as_py()))
                    if cut:
                        yield from ready(t.slice(0, cut).combine_chunks())
                        held, size = t.slice(cut).to_batches(), size - cut
        if size:
            yield from ready(pa.Table.from_batches(held).combine_chunks())

    return rows.repartition("key").sortWithinPartitions("key", "doc", "tag", "place").mapInArrow(run, "doc long, tag long, place long")


def later(rows: DataFrame, by: list[str], total: int) -> DataFrame:
    """(doc, tag, place) of all rows but the earliest of each group; rows equal in all three to the earliest count as the earliest."""
    first = rows.groupBy(*by).agg(F.min(F.struct("doc", "tag", "place")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return by_group(rows, first, by, total).where(F.struct("doc", "tag", "place") != F.col("first")).select("doc", "tag", "place")


def repeats(plain: DataFrame, tables: Tables, batches: int = BATCHES) -> DataFrame:
    """doc, tag and spans (array of start, end; not merged) of the bytes to remove."""
    family = IndexFamily(plain.sparkSession, tables)
    for i in range(batches):
        family.add(plain.where(F.pmod(F.xxhash64("doc"), F.lit(batches)) == i).select("doc", "tag", "text"), more=i + 1 < batches)
    found = family.candidates()
    total = found.count()
    whole = later(found, ["key", "run"], total)
    classes = found.groupBy("key", "run").agg(F.min(F.struct("doc", "tag", "place")).alias("f")).select("key", "f.*")
    several = tables.save(by_group(classes, classes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), ["key"], total), "several")
    tables.release()
    texts = plain.select("doc", "tag", "text")
    few = tables.save(settle(contexts(texts, several.where(F.col("n") <= MANY))), "few")  # on its own, as it deals all texts
    tables.release()
    gone = whole.union(few)
    many = several.where(F.col("n") > MANY)
    if not many.isEmpty():  # else all texts would be dealt for nothing
        windows = tables.save(window_hashes(texts, many), "windows")
        tables.release()
        gone = gone.union(later(windows, ["key", "window"], windows.count()))
    start = F.shiftright("place", _RUN)
    gone = gone.select("doc", "tag", start.alias("start"), (start + F.col("place").bitwiseAND((1 << _RUN) - 1) + LENGTH).alias("end"))
    spans = gone.groupBy("doc", "tag").agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # a set, as equal rows find the same spans: bounded by the text's length
    spans = tables.save(spans, "spans")
    tables.drop("several", "few", "windows", *family.found)
    tables.release()  # the texts are dealt next
    return spans


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, carry: bool = False, digest: bool = False) -> DataFrame:
    """doc_id (and ``row`` if ``carry``), n_bytes, n_removed, n_spans (maximal removed runs), and the remaining text (``kept``) or, with ``digest``, the sha256 of its bytes.

    As a text, ``kept`` leaves out the rest of a character that a removal has cut.
    """
    tables = Tables(docs.sparkSession, "substrings")
    carried = ["row"] * carry
    plain = text_of(docs, id_col, text_col)
    shared = ids_shared(plain)
    marked = keyed(with_row(docs, id_col, text_col) if carry else plain, shared, "doc_id", *carried)
    text = "row" if carry else "text"  # the row holds the text, which is dealt once
    spans = repeats(keyed(plain, shared), tables, batches)
    last = "kept_sha256" if digest else "kept"

    def run(frames: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in frames:
            n, removed, runs, rest = [], [], [], []
            texts = pa.RecordBatch.from_arrays([batch.column(1).field(text_col) if carry else batch.column(1)], ["text"])
            lists = batch.column(2)
            pairs, cut = lists.flatten(), np.concatenate([[0], np.cumsum(np.nan_to_num(lists.value_lengths().fill_null(0).to_numpy()))]).astype(np.int64)
            starts, ends = pairs.field(0).to_numpy(), pairs.field(1).to_numpy()
            for lo, offsets, data in byte_batches(texts, 0):
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist()), lo):
                    text, s, e = data[a:b], starts[cut[i] : cut[i + 1]], ends[cut[i] : cut[i + 1]]
                    if len(s):
                        order = np.argsort(s, kind="stable")
                        s, top = s[order], np.maximum.accumulate(e[order])
                        new = np.flatnonzero(np.concatenate([[True], s[1:] > top[:-1]]))
                        s, e = s[new], top[np.append(new[1:], len(top)) - 1]
                        if e[-1] > len(text):
                            raise ValueError("a span reaches beyond its text")
                        edge = np.zeros(len(text) + 1, np.int8)
                        edge[s], edge[e] = 1, -1
                        text = text[np.cumsum(edge[:-1]) == 0]
                    n.append(b - a)
                    removed.append(b - a - len(text))
                    runs.append(len(s))
                    rest.append(hashlib.sha256(text.tobytes()).hexdigest() if digest else text.tobytes().decode("utf-8", "ignore"))
            kept = pa.array(rest, pa.string())
            cols = [pa.array(x, pa.int64()) for x in (n, removed, runs)]
            yield pa.RecordBatch.from_arrays([batch.column(3), *[batch.column(1)] * carry] + cols + [kept], names)

    names = ["doc_id", *carried, "n_bytes", "n_removed", "n_spans", last]
    joined = marked.join(spans, ["doc", "tag"], "left").select("doc", text, "spans", "doc_id")
    kind = T.StructType([joined.schema[c] for c in ("doc_id", *carried)])
    for name in names[-4:-1]:
        kind = kind.add(name, T.LongType())
    return joined.mapInArrow(run, kind.add(last, T.StringType()))


def strip(docs: DataFrame) -> DataFrame:
    """The documents (doc_id, text, any others) with repeated substrings removed from their texts; n_chars, if there, counts what is left."""
    return replaced(docs, remove(docs, carry=True), "kept")
