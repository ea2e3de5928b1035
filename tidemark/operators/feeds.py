"""Incremental discovery over feed items with state per source: windows, seen ids, caps, catch-up and backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config


def feed_items(events: DataFrame) -> DataFrame:
    """Feed items from an event table: source_key, id, route, title, publish_time (UTC instant), feed_pos (0 = newest)."""
    ts = F.col("ts").cast("timestamp")
    out = events.select(F.col("user_id").alias("source_key"), F.col("event_id").alias("id"), F.col("event_type").alias("route"), F.col("props").alias("title"), ts.alias("publish_time"))
    return out.withColumn("feed_pos", F.row_number().over(W.partitionBy("source_key").orderBy(F.desc("publish_time"), F.desc("id"))) - 1)


def in_window(items: DataFrame, now: str, days: float) -> DataFrame:
    """[FLT-9, FLT-10] Items not older than so many days before ``now``, a parameter."""
    return items.where(F.col("publish_time") >= F.lit(now).cast("timestamp") - F.expr(f"interval {int(days * 86400)} seconds"))


def unseen(items: DataFrame, seen: DataFrame) -> DataFrame:
    """[JN-1, AG-7] Items whose id is not in the state of their source."""
    return items.join(seen.select("source_key", "id"), ["source_key", "id"], "left_anti")


def newest(items: DataFrame, n: int, *more: str) -> DataFrame:
    """[WN-1, WN-2, ST-2] The n newest of every source, or of every source and route."""
    w = W.partitionBy("source_key", *more).orderBy(F.desc("publish_time"), F.desc("id"))
    return items.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def discover(items: DataFrame, seen: DataFrame, now: str, days: float, n: int, title_filter=None) -> tuple[DataFrame, DataFrame]:
    """[STM-1, STM-5, STM-6] (emitted, newly seen): window, title filter, not seen, the n newest of each source.

    All items inside the window are marked seen, also those over the cap, which are therefore never emitted. Items that
    the title filter refuses are neither emitted nor replaced.
    """
    inside = in_window(items, now, days)
    fresh = unseen(inside, seen)
    kept = fresh if title_filter is None else fresh.where(~title_filter)
    return newest(kept, n), fresh.select("source_key", "id", "publish_time")


def remember(seen: DataFrame, new: DataFrame, keep: int = config.STATE_KEEP) -> DataFrame:
    """[STM-3, WN-3] The last ``keep`` ids of each source by order of arrival (seq): old ones first, new ones after, each once (an id
    that a batch repeats has its first place)."""
    last = seen.groupBy("source_key").agg(F.max("seq").alias("last"))
    order = W.partitionBy("source_key").orderBy("feed_pos", "id")
    added = unseen(new, seen).groupBy("source_key", "id").agg(F.min("feed_pos").alias("feed_pos")).join(last, "source_key", "left")
    added = added.select("source_key", "id", (F.coalesce("last", F.lit(-1)) + F.row_number().over(order)).alias("seq"))
    tail = W.partitionBy("source_key").orderBy(F.desc("seq"))
    return seen.select("source_key", "id", "seq").unionByName(added).withColumn("_r", F.row_number().over(tail)).where(F.col("_r") <= keep).drop("_r")


def backfill_progress(items: DataFrame, seen: DataFrame, since: str, batch: int = config.BACKFILL_BATCH) -> DataFrame:
    """[STM-7, AG-5, AG-6] One row a source: what a backfill step would emit, whether it is done, and why.

    Done when nothing new is left, or no more than a batch; never when there are no items at all.
    """
    marked = items.join(seen.select("source_key", "id", F.lit(True).alias("known")), ["source_key", "id"], "left")
    reach = F.col("publish_time") >= F.lit(since).cast("timestamp")
    out = marked.groupBy("source_key").agg(
        F.count("*").alias("n_items"), F.min("publish_time").alias("oldest"), F.max("publish_time").alias("latest"),
        F.count_if(reach).alias("n_reachable"), F.count_if(reach & F.col("known").isNull()).alias("n_unseen"),
    )
    done = (F.col("n_reachable") > 0) & (F.col("n_unseen") <= batch)
    reason = F.when(~done, "").when(F.col("oldest") < F.lit(since).cast("timestamp"), "reached_since").otherwise(F.concat(F.lit("proxy_depth:"), F.date_format("oldest", "yyyy-MM-dd")))
    return out.select("source_key", "n_items", "n_reachable", "n_unseen", F.least("n_unseen", F.lit(batch)).alias("n_emit"), done.alias("done"), reason.alias("reason"))


def health(items: DataFrame) -> DataFrame:
    """[AG-1, AG-12, AG-14] Counters by source and route, in columns."""
    routes = ["click", "view", "purchase", "signup"]
    return items.groupBy("source_key").agg(F.count("*").alias("total"), *[F.count_if(F.col("route") == r).alias(f"n_{r}") for r in routes])


def enrich(items: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """[PRJ-1, PRJ-2, SRC-9] Attributes of the subscription, which may be missing; Spark broadcasts the dimension if it is small."""
    return items.drop("content").join(subscriptions, "source_key", "left")


def upsert(table: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """[SNK-6, STM-8, STM-11, STM-17] New rows replace old ones of the same key. Of several new rows with one key the last by
    ``order`` stays, or the greatest by its columns, so that the key remains one. Keys compare null-safely."""
    rest = [c for c in new.columns if c not in key]
    by = F.struct(*([F.col(order).alias("_order")] if order else []), *rest)
    last = new.groupBy(*key).agg(F.max(by).alias("_row")).select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*new.columns)
    same = [table[k].eqNullSafe(last[k]) for k in key]
    return table.join(last, same, "left_anti").unionByName(last)


def without_paid(items: DataFrame, flag: str = "paid") -> tuple[DataFrame, DataFrame]:
    """[FLT-12] (items to fetch, how many each source had to skip): what must be paid for is skipped and counted; no flag means free."""
    paid = F.coalesce(F.col(flag), F.lit(False))
    return items.where(~paid), items.groupBy("source_key").agg(F.count_if(paid).alias("skipped"))
