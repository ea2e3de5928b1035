"""Structured Streaming forms of discovery and series state; each gives what its batch form gives on the same rows.

The stateful ones keep their state in the RocksDB store (``use_state_store``), so it may outgrow memory, and go on from a checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..config import STATE_KEEP
from ..operators.series import state_number

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB store; a session that names another provider is changed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def timed(events: DataFrame, late: str | None = "2 days") -> DataFrame:
    """[STM-4, STM-5] Feed items with a watermark; rows later than it may be left out by what follows. Without ``late`` there is none, as
    ``discover`` sets its own."""
    items = events.select(F.col("user_id").alias("source_key"), F.col("event_id").alias("id"), F.col("event_type").alias("route"), F.col("props").alias("title"), F.col("ts").cast("timestamp").alias("publish_time"))
    return items.withWatermark("publish_time", late) if late else items


def unseen(items: DataFrame) -> DataFrame:
    """[STM-1, STM-3] Every (source, id) once while the watermark remembers it."""
    return items.dropDuplicatesWithinWatermark(["source_key", "id"])


def hourly(items: DataFrame, width: str = "1 hour") -> DataFrame:
    """[AG-1] Counters by time window and route."""
    return items.groupBy(F.window("publish_time", width), "route").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "route", "n")


class Discovery(StatefulProcessor):
    """Discovery of one source: polls at multiples of ``every`` in event time.

    State: ``waiting`` holds the items that each poll to come will look at (its newest ``keep``), ``seen`` the last ``keep`` ids that polls have
    marked. Polls to come lie between the watermark and the newest item, so the state is bounded by the sources. A timer stands for the
    next of them; it fires when the watermark, ``days`` behind the newest item, tells that the time of the poll is over, and holds
    all polls that are over by then. Every call to the store is a message from Python to the executor and back, so ``waiting`` is one
    value of arrays: a source costs a few messages a batch, however many items and polls it has.
    """

    def __init__(self, days: float, n: int, every: float, keep: int):
        self.reach, self.n, self.every, self.keep = int(days * DAY_MS), n, int(every * DAY_MS), keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "polls array<long>, published array<long>, ids array<long>, routes array<string>, titles array<string>")
        self.seen = handle.getListState("seen", "id long, published long")

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: TimerValues) -> None:
        self.seen.appendValue((initialState["id"], initialState["published"]))

    def _load(self) -> list[tuple]:
        """(poll, published, id, route, title) of the waiting items."""
        held = self.waiting.get()
        return list(zip(*held)) if held else []

    def _store(self, waiting: list[tuple]) -> None:
        """The waiting items and a timer for the next poll."""
        if waiting:
            self.waiting.update(tuple(list(c) for c in zip(*waiting)))
            self.handle.registerTimer(min(x[0] for x in waiting) - self.reach)
        else:
            self.waiting.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        known = {i for i, _ in self.seen.get()}
        over = timerValues.getCurrentWatermarkInMs() + self.reach  # polls up to here have been held
        waiting, new = {x[2]: x for x in self._load()}, set()
        for at, i, route, title in ((int(r["published"]), r["id"], r["route"], r["title"]) for r in rows):
            old = waiting.get(i)
            # of several rows of an id the first published counts
            if i not in known and (old is None or at < old[1]):
                poll = (max(at, over) // self.every + 1) * self.every
                waiting[i] = (poll, at, i, route, title)
                new.add(poll)
        if new:
            polls: dict[int, list[tuple]] = {}
            for x in sorted(waiting.values(), key=lambda x: x[:3]):
                polls.setdefault(x[0], []).append(x)
            self._store([x for poll, own in polls.items() for x in (own[-self.keep :] if poll in new else own)])
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        over = timerValues.getCurrentWatermarkInMs() + self.reach
        polls: dict[int, list[tuple]] = {}
        later = []
        for x in sorted(self._load(), key=lambda x: x[:3]):
            if x[0] > over:
                later.append(x)
            elif x[1] >= x[0] - self.reach:  # what is older by now is neither emitted nor marked
                polls.setdefault(x[0], []).append(x)
        self._store(later)
        if polls:
            marked = [(i, at) for own in polls.values() for _, at, i, _, _ in own]
            self.seen.put([*map(tuple, self.seen.get()), *marked][-self.keep :])
        for poll, own in polls.items():
            for rank, (_, at, i, route, title) in enumerate(reversed(own[-self.n :] if self.n else []), 1):
                yield Row(source_key=key[0], id=i, route=route, title=title, published=at, poll=poll, rank=rank)

    def close(self) -> None:
        pass


def discover(items: DataFrame, days: float, n: int, every: float = 1.0, title_filter=None, keep: int = STATE_KEEP, seen: DataFrame | None = None) -> DataFrame:
    """[STM-1, STM-2, STM-3, STM-5] Discovery on a stream: at every poll the ``n`` newest unseen items of each source in its window.

    A poll at time T looks at all items that have arrived, were published in the ``days`` before T, and were not seen at an earlier poll;
    all of them are marked seen, also those over ``n``, and refused titles are neither emitted nor replaced. A late item is looked
    at by the next poll whose window reaches it; one later than that is dropped by the watermark. An id that comes again while it is
    remembered (``keep`` ids a source) is no new item. ``seen`` (source_key, id, published as milliseconds) starts the memory of a new
    query, for instance from a batch run. ``items`` must not have a watermark yet. Results do not depend on how rows are cut into batches as long as a source has no
    more than ``keep`` items for one poll. Columns: source_key, id, route, title, published, poll (times), rank.
    """
    use_state_store(items.sparkSession)
    kept = items if title_filter is None else items.where(~title_filter)
    rows = kept.withWatermark("publish_time", f"{int(days * 86400)} seconds").withColumn("published", F.expr("unix_millis(publish_time)"))
    start = seen.select("source_key", "id", "published").groupBy("source_key") if seen is not None else None
    kind = f"source_key {items.schema['source_key'].dataType.simpleString()}, id long, route string, title string, published long, poll long, rank int"
    out = rows.groupBy("source_key").transformWithState(Discovery(days, n, every, keep), kind, "append", "eventTime", start)
    return out.withColumns({c: F.timestamp_millis(c) for c in ("published", "poll")})


class LastIds(StatefulProcessor):
    """The last ids of one source; an id that has not been met for ``ttl_ms`` is forgotten too."""

    def __init__(self, keep: int, ttl_ms: int | None):
        self.keep, self.ttl_ms = keep, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getListState("ids", "id long", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        old = [r[0] for r in self.ids.get()] if self.ids.exists() else []
        known, new = set(old), []
        for i in sorted(r["id"] for r in rows):
            if i not in known:
                known.add(i)
                new.append(i)
        if new:
            left = (old + new)[-self.keep :]
            if self.ttl_ms is None or len(left) < len(old) + len(new):
                self.ids.put([(i,) for i in left])
            else:  # those that were there keep their age
                self.ids.appendList([(i,) for i in new])
        for i in new:
            yield Row(source_key=key[0], id=i)

    def close(self) -> None:
        pass


def seen_last_k(items: DataFrame, keep: int = STATE_KEEP, ttl: float | None = None) -> DataFrame:
    """[STM-2, STM-3] New ids of each source, with a memory of its last ``keep`` ids: state is bounded by source. With ``ttl`` (seconds
    of processing time) ids are forgotten after it, too, so that sources that have gone silent cost nothing in the end; such a query
    never runs out of work, so it is stopped, not run with ``availableNow``."""
    use_state_store(items.sparkSession)
    kind = f"source_key {items.schema['source_key'].dataType.simpleString()}, id long"
    return items.groupBy("source_key").transformWithState(LastIds(keep, int(ttl * 1000) if ttl else None), kind, "append", "processingTime" if ttl else "none")


def series_states(evidence: DataFrame) -> DataFrame:
    """[STM-15] The running maximum state of each (series, page); update or complete mode."""
    return evidence.groupBy("series", "page").agg(F.max(state_number(F.col("state"))).alias("ord"))
