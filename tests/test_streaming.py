"""Streaming forms give what the batch forms give on the same rows; stopped and started again, they go on."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import feeds as batch_feeds
from tidemark.operators import series
from tidemark.streaming import feeds

from .conftest import SF


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def source(spark, name):
    df = spark.read.parquet(f"{SF}/{name}.parquet")
    return df, spark.readStream.schema(df.schema).option("pathGlobFilter", f"{name}.parquet").parquet(SF)


def test_unseen(spark):
    batch, stream = source(spark, "events")
    drain(feeds.unseen(feeds.timed(stream, "60 days")), "unseen")
    assert spark.table("unseen").count() == batch.select("user_id", "event_id").distinct().count()


def test_last_k(spark):
    batch, stream = source(spark, "events")
    drain(feeds.seen_last_k(feeds.timed(stream, "60 days"), 5), "lastk")
    want = batch.select(F.col("user_id").alias("source_key"), F.col("event_id").alias("id")).distinct()
    got = spark.table("lastk")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_series_states(spark):
    kind = F.when(F.col("l_linestatus") == "O", "raw_ready").otherwise("verified").alias("state")
    batch, stream = (d.select(F.col("l_orderkey").alias("series"), F.col("l_linenumber").alias("page"), kind) for d in source(spark, "lineitem"))
    drain(feeds.series_states(stream), "states", "complete")
    want = series.fold(batch).select("series", "page", "ord")
    assert spark.table("states").exceptAll(want).count() == 0 and want.count() == spark.table("states").count()


class Landed:
    """A folder into which item files land, a query over it with a checkpoint, and all rows that it has put out."""

    kind = "user_id long, event_id long, event_type string, props string, ts timestamp"

    def __init__(self, spark, root):
        self.spark, self.root, self.runs = spark, root, 0

    def land(self, rows):
        self.spark.createDataFrame(rows, self.kind).coalesce(1).write.mode("append").parquet(f"{self.root}/in")

    def run(self, make, ends=True):
        """One run until nothing is left; its progress."""
        stream = self.spark.readStream.schema(self.kind).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/in")
        q = make(stream).writeStream.format("parquet").option("path", f"{self.root}/out").option("checkpointLocation", f"{self.root}/ck")
        if ends:
            q = q.trigger(availableNow=True).start()
            assert q.awaitTermination(180)
        else:
            q = q.trigger(once=True).start()
            assert q.awaitTermination(60)
        return [p for p in q.recentProgress if p["stateOperators"]]

    def out(self):
        return {(r.source_key, r.id, r.poll, r.rank) for r in self.spark.read.parquet(f"{self.root}/out").collect()}


DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 1)


def polls(batches, days, n, keep=10**9):
    """What polls do, in plain Python: ``batches`` are lists of (source, id, published) as they arrive; polls are held at midnights
    when the newest published item has passed them."""
    seen, waiting, held, newest, out = {}, {}, START - 400 * DAY, START - 400 * DAY, set()
    for rows in batches:
        for s, i, at in sorted(rows, key=lambda r: r[2]):
            if i not in seen.get(s, ()) and at >= newest - days * DAY and at < waiting.setdefault(s, {}).get(i, dt.datetime.max):
                waiting[s][i] = at
        newest = max([newest, *(at for _, _, at in rows)])
        t = dt.datetime(newest.year, newest.month, newest.day)
        due = sorted({dt.datetime(at.year, at.month, at.day) + DAY for s in waiting for at in waiting[s].values()} | {t})
        for poll in [x for x in due if x <= t]:
            for s in waiting:
                # late items wait for the poll after the last that was held
                own = sorted(((at, i) for i, at in waiting[s].items() if at < poll and poll > held))
                for at, i in own:
                    del waiting[s][i]
                own = [x for x in own if x[0] >= poll - days * DAY]
                seen[s] = (seen.get(s, []) + [i for _, i in own])[-keep:]
                out |= {(s, i, poll, k) for k, (_, i) in enumerate(reversed(own[-n:]), 1)}
        held = max(held, t)
    return out


def test_discovery_over_two_runs_with_late_and_repeated_rows(spark, tmp_path):
    events = [(r.user_id, r.event_id, r.event_type, r.props, r.ts) for r in spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id", "event_id", "event_type", "props", "cast(ts as timestamp) ts").orderBy("ts").collect()]
    cut = START + 12 * DAY + dt.timedelta(hours=1)
    first, rest = [r for r in events if r[4] < cut], [r for r in events if r[4] >= cut]
    late = [r for r in first if r[4] > cut - 1 * DAY and r[1] % 2]  # these come in the second run
    first = [r for r in first if r not in late]
    again = [r for r in first if r[1] % 5 == 0]  # and these once more
    lost = [(1, 10**6 + k, "view", "x", START + k * DAY) for k in range(3)]  # too late for every window
    landed = Landed(spark, str(tmp_path))
    make = lambda stream: feeds.discover(feeds.timed(stream, None), 2, 2)
    landed.land(first)
    landed.run(make)
    once = landed.out()
    plain = lambda rows: [(r[0], r[1], r[4]) for r in rows]
    assert once == polls([plain(first)], 2, 2) and once
    landed.land([*late, *again, *lost])
    landed.run(make)
    landed.land(rest)
    landed.run(make)
    want = polls([plain(first), plain([*late, *again, *lost]), plain(rest)], 2, 2)
    got = landed.out()
    assert got == want and once < got and any(i in {r[1] for r in late} for _, i, _, _ in got) and not any(i >= 10**6 for _, i, _, _ in got)


def test_discovery_equals_the_batch_operator(spark, tmp_path):
    """One poll, with a memory taken over from a batch run: the stream puts out what the batch form puts out for that time."""
    end = dt.datetime(1970, 1, 1) + 19740 * DAY  # a multiple of 20 days: 2024-01-18
    items = spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id", "event_id", "event_type", "props", "cast(ts as timestamp) ts").where(F.col("ts") < end)
    feed = batch_feeds.feed_items(items)
    seen, refused = feed.where("id % 3 = 0").select("source_key", "id", F.lit(0).cast("long").alias("published")), F.col("title").contains("7")
    landed = Landed(spark, str(tmp_path))
    landed.land([tuple(r) for r in items.collect()])
    landed.land([(0, -1, "view", "{}", end + dt.timedelta(hours=1))])  # a later item tells that the time has passed
    landed.run(lambda stream: feeds.discover(feeds.timed(stream, None), 10, 3, every=20, title_filter=refused, seen=seen))
    got, _ = batch_feeds.discover(feed, seen, str(end), 10, 3, refused)
    want = {(r.source_key, r.id, end, r.rank) for r in got.collect()}
    assert landed.out() == want and want


def test_state_of_discovery_is_bounded(spark, tmp_path):
    """However many items come, a source keeps no more than ``keep`` waiting ones for each of the few polls to come and ``keep`` seen ids."""
    landed, most = Landed(spark, str(tmp_path)), []
    make = lambda stream: feeds.discover(feeds.timed(stream, None), 2, 3, keep=10)
    for day in range(0, 12, 3):
        landed.land([(s, 1000 * d + 100 * s + k, "view", "x", START + d * DAY + dt.timedelta(minutes=k)) for d in range(day, day + 3) for s in range(4) for k in range(60)])
        most += [p["stateOperators"][0]["numRowsTotal"] for p in landed.run(make)]
    polls = 6  # three days of a batch and those that the watermark keeps open, with a timer each
    assert 0 < max(most) <= 4 * (10 * polls + 10 + 4 * polls) < 4 * 60 * 12
    got = landed.out()
    assert all(r <= 3 for _, _, _, r in got) and len(got) == 4 * 3 * 11  # the last day's poll is to come


@pytest.mark.parametrize("ttl", [None, 3600.0])
def test_last_ids_over_a_restart(spark, tmp_path, ttl):
    landed = Landed(spark, str(tmp_path))
    make = lambda stream: feeds.seen_last_k(feeds.timed(stream), 3, ttl)
    row = lambda i: (1, i, "view", "x", START)
    landed.land([row(1), row(2), row(2)])
    landed.run(make, not ttl)
    landed.land([row(2), row(3), row(4), row(5)])
    landed.run(make, not ttl)
    landed.land([row(5), row(1), row(6)])  # 1 has been pushed out by 3, 4 and 5
    landed.run(make, not ttl)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 1, 2, 3, 4, 5, 6]


def test_ids_are_forgotten_after_their_time(spark, tmp_path):
    landed = Landed(spark, str(tmp_path))
    make = lambda stream: feeds.seen_last_k(feeds.timed(stream), 3, 0.001)
    landed.land([(1, 1, "view", "x", START)])
    landed.run(make, False)
    landed.land([(1, 1, "view", "x", START)])
    landed.run(make, False)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


class Store:
    """A state store that counts the messages to it."""

    def __init__(self):
        self.held, self.timers, self.calls = {}, set(), 0

    def _count(self, value=None):
        self.calls += 1
        return value

    def registerTimer(self, at):
        self._count(self.timers.add(at))

    def getValueState(self, name, schema, ttl=None):
        return _State(self, name)

    getListState = getMapState = getValueState


class _State:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def get(self):
        return self.store._count(iter(self.store.held.get(self.name, ())) if self.name == "seen" else self.store.held.get(self.name))

    def exists(self):
        return self.store._count(self.name in self.store.held)

    def update(self, value):
        self.store._count(self.store.held.update({self.name: value}))

    put = update

    def clear(self):
        self.store._count(self.store.held.pop(self.name, None))

    def iterator(self):
        return self.store._count(iter(self.store.held.get(self.name, {}).items()))

    def containsKey(self, key):
        return self.store._count(key in self.store.held.get(self.name, {}))

    def updateValue(self, key, value):
        self.store._count(self.store.held.setdefault(self.name, {}).update({key: value}))

    def removeKey(self, key):
        self.store._count(self.store.held[self.name].pop(key))


class _Times:
    def __init__(self, watermark, expiry=None):
        self.getCurrentWatermarkInMs, self.getExpiryTimeInMs = (lambda: watermark), (lambda: expiry)


@pytest.mark.parametrize("items", [10, 1000])
def test_messages_to_the_store_do_not_grow_with_items_or_polls(items):
    store, day = Store(), feeds.DAY_MS
    d = feeds.Discovery(2, 2, 1, 1000)
    d.init(store)
    rows = [{"id": k, "published": 19_723 * day + k * 20 * day // items, "route": "view", "title": None} for k in range(items)]
    list(d.handleInputRows((1,), iter(rows), _Times(0)))
    watermark, out = rows[-1]["published"] - 2 * day, []
    while store.timers and min(store.timers) <= watermark:
        at = min(store.timers)
        store.timers.discard(at)
        out += d.handleExpiredTimer((1,), _Times(watermark, at), _Times(watermark, at))
    assert len(out) == sum(min(2, sum(r["published"] // day == k for r in rows)) for k in range(19_723, rows[-1]["published"] // day)) and store.calls <= 12


def test_a_poll_at_the_time_of_the_newest_item(spark, tmp_path):
    """Several polls are over at once, the last of them at the very time of the newest item."""
    landed = Landed(spark, str(tmp_path))
    make = lambda stream: feeds.discover(feeds.timed(stream, None), 2, 2)
    rows = [(1, 10 * d + k, "view", "x", START + d * DAY + k * dt.timedelta(hours=5)) for d in range(4) for k in range(3)] + [(2, 99, "view", "x", START + 4 * DAY)]
    landed.land(rows)
    landed.run(make)
    assert {(i, poll) for _, i, poll, _ in landed.out()} == {(10 * d + k, START + (d + 1) * DAY) for d in range(4) for k in (1, 2)}
