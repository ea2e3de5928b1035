"""Anchored greedy windows over timed segments, in parallel even within one medium.

A group closes when a segment starts more than W after the group's first one, its anchor. So an anchor is later than all segments before
it, and the next one is the first place at which the running maximum of the starts is more than W after it: a binary search, whatever
the order of the starts.

Segments are dealt by ranges of (medium, place), in parts of even size. What passes from one part to the next is only the last anchor.
For a part that goes on with a medium, a first pass tells for every anchor that can come in (the maxima up to W after all that was before: the
segments of about one window) where the chain of anchors leaves the part and how many it holds, found by pointer doubling. These few rows are
chained on the driver, part by part, and a second pass numbers the groups with the right anchor from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..kept import saved


def next_place(top: np.ndarray, anchor, window: float):
    """The first place at which ascending ``top`` is more than ``window`` after each anchor (exactly as the subtraction says)."""
    at = np.searchsorted(top, np.asarray(anchor) + window, "right")
    while True:  # the sum may have been rounded to the wrong side
        less = (at > 0) & (top[np.maximum(at - 1, 0)] - anchor > window)
        more = (at < len(top)) & ~(top[np.minimum(at, len(top) - 1)] - anchor > window)
        if not (less.any() or more.any()):
            return at
        at = at - less + (more & ~less)


def exits(values: np.ndarray, window: float) -> tuple[np.ndarray, np.ndarray]:
    """(last anchor, anchors) of the chain that begins at each of some ascending values, by pointer doubling."""
    n = len(values)
    jump, last, count = next_place(values, values, window), np.arange(n), np.ones(n, np.int64)
    while (jump < n).any():
        to = np.minimum(jump, n - 1)
        last, count = np.where(jump < n, last[to], last), count + np.where(jump < n, count[to], 0)
        jump = np.where(jump < n, jump[to], n)
    return values[last], count


def starts_of(column: pa.Array, first: bool) -> np.ndarray:
    """Starts as numbers. A null start never closes a group, and a group whose first start is null stays open."""
    x = column.cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False).copy()
    if first and len(x) and column[0].as_py() is None:
        x[0] = np.inf
    return x


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """((part, medium), rows) of the stretches of a batch, whose first columns are part and medium."""
    keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    lo = 0
    for k in range(1, len(keys) + 1):
        if k == len(keys) or keys[k] != keys[lo]:
            yield keys[lo], batch.slice(lo, k - lo)
            lo = k


def numbered(segments: DataFrame, window: float = config.SEGMENT_WINDOW) -> DataFrame:
    """The segments (media_id, seq, start, duration, text) with the number of their group in their medium, from 0.

    Segments are in order of seq; those that share one, of start, duration and text. Media without an id are one medium.
    """
    order = ["media_id", "seq", "start", "duration", "text"]
    dealt = segments.select(*order).repartitionByRange("media_id", "seq").withColumn("part", F.spark_partition_id())
    rows = saved(dealt.select("part", *order), "segments")
    spark = rows.sparkSession

    # media that lie in several parts: fewer than twice as many rows as parts
    by_part = rows.groupBy("media_id", "part").agg(F.max("start").alias("top"))
    several = by_part.groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("part", "top"))).alias("p")).where(F.size("p") > 1).collect()
    before: dict[int, float] = {}  # parts that go on with a medium -> the greatest start of it before
    goes_on: set[int] = set()  # parts whose last medium has more
    for r in several:
        most = -np.inf
        for k, (part, top) in enumerate(r.p):
            if k:
                before[part] = most
            if k + 1 < len(r.p):
                goes_on.add(part)
            most = max(most, np.inf if top is None else top)
    sent = spark.sparkContext.broadcast((before, goes_on))  # a number for each part at most

    def sweep(df: DataFrame):
        return df.repartition("part").sortWithinPartitions("part", *[F.col(c).asc_nulls_first() for c in order])

    def tell(batches: Iterator) -> Iterator:
        """What an anchor that comes into a part becomes, for the first medium of the part and the last one."""
        before, goes_on = sent.value

        def out(key: tuple, held: list[np.ndarray], first: bool):
            x = np.concatenate(held)
            top = np.maximum.accumulate(x)
            place = np.flatnonzero(np.concatenate([[True], top[1:] > top[:-1]]))  # only maxima can be anchors
            values = top[place]
            last, count = exits(values, window)
            if first:
                some = min(len(values), int(next_place(values, before[key[0]], window)) + 1) if np.isfinite(before[key[0]]) else len(values)
                cols = [values[:some], last[:some], count[:some]]
            else:
                cols = [values[:1], last[:1], count[:1]]
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(cols[0]), pa.int32()), pa.array([first] * len(cols[0])), *map(pa.array, cols)], ["part", "first", "value", "exit", "groups"])

        key, held, first, seen = None, [], False, None
        for batch in batches:
            for now, piece in pieces(batch):
                if now != key:
                    # a medium that neither comes from an earlier part nor goes on asks nothing of others
                    if key and (first or key[0] in goes_on and now[0] != key[0]):
                        yield out(key, held, first)
                    first, held = now[0] != seen and now[0] in before, []
                    key, seen = now, now[0]
                held.append(starts_of(piece.column(2), not first and not held))
        if key and (first or key[0] in goes_on):
            yield out(key, held, first)

    told: dict[tuple[int, bool], list] = {}
    for r in sweep(rows).select("part", "media_id", "start").mapInArrow(tell, "part int, first boolean, value double, exit double, groups long").collect() if several else []:
        told.setdefault((r.part, r.first), []).append((r.value, r.exit, r.groups))
    into: dict[int, tuple[float, int]] = {}
    anchor, groups = np.inf, 0
    for part in sorted({p for p, _ in told}):
        if (part, True) in told:
            into[part] = (anchor, groups)
            entry = next((e for e in sorted(told[part, True]) if e[0] - anchor > window), None)
            if entry:
                anchor, groups = entry[1], groups + entry[2]
        if (part, False) in told:
            ((_, anchor, groups),) = told[part, False]
    coming = spark.sparkContext.broadcast(into)

    def number(batches: Iterator) -> Iterator:
        key, anchor, group, seen = None, np.inf, -1, None
        for batch in batches:
            for now, piece in pieces(batch):
                fresh = False
                if now != key:
                    came = coming.value.get(now[0]) if now[0] != seen else None
                    fresh = came is None
                    anchor, group = (np.inf, -1) if fresh else (came[0], came[1] - 1)
                    key, seen = now, now[0]
                x = starts_of(piece.column(3), fresh)
                new = np.zeros(len(x), np.int64)
                at = 0
                if fresh:
                    anchor, new[0], at = x[0], 1, 1
                top = np.maximum.accumulate(x)
                while at < len(x) and (at := max(at, int(next_place(top, anchor, window)))) < len(x):
                    anchor, new[at] = x[at], 1
                    at += 1
                numbers = group + np.cumsum(new)
                group = int(numbers[-1])
                yield pa.RecordBatch.from_arrays([*piece.columns[1:], pa.array(numbers, pa.int64())], [*order, "group"])

    kind = T.StructType([*rows.select(*order).schema.fields, T.StructField("group", T.LongType())])
    return sweep(rows).mapInArrow(number, kind)


def greedy_windows(segments: DataFrame, window: float = config.SEGMENT_WINDOW) -> DataFrame:
    """[WN-8, ALG-2] Groups of segments: media_id, group, start (of the first), end (of the last), text (trimmed texts, blank ones left out, one a line)."""
    s = F.sort_array(F.collect_list(F.struct("seq", "start", "duration", "text")))  # bounded by a window
    out = numbered(segments, window).groupBy("media_id", F.col("group").cast("int").alias("group")).agg(s.alias("s"))
    last = F.element_at("s", -1)
    text = F.array_join(F.filter(F.transform("s", lambda x: F.trim(x["text"])), lambda t: t != ""), "\n")
    return out.select("media_id", "group", F.col("s")[0]["start"].alias("start"), (last["start"] + last["duration"]).alias("end"), text.alias("text"))
