"""Retry queues, promotions and merges as splits and anti-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config


def retry_or_drop(failed: DataFrame, most: int = config.REFETCH_MAX) -> DataFrame:
    """[STM-9] The count goes up by one; at the maximum the item is dropped with a reason."""
    out = failed.withColumn("refetch_count", F.coalesce(F.col("refetch_count"), F.lit(0)) + 1)
    over = F.col("refetch_count") >= most
    return out.withColumn("action", F.when(over, "drop").otherwise("requeue")).withColumn("reason", F.when(over, F.concat(F.lit("gave up after "), F.col("refetch_count").cast("string"))).otherwise(""))


def work_order(retries: DataFrame, new: DataFrame) -> DataFrame:
    """[ST-1] Retries first, then new items; of several with one url the first stays."""
    both = retries.withColumn("priority", F.lit(0)).unionByName(new.withColumn("priority", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_k", F.row_number().over(W.partitionBy("url").orderBy("priority", "queued_at"))).where("_k = 1").drop("_k")


def promote(queue: DataFrame, target: DataFrame, condition) -> tuple[DataFrame, DataFrame]:
    """[STM-10, ST-5, JN-7] (what stays, the target with what moves): moved entries whose url is there already are not added twice.
    An entry whose condition is null stays; of several moved entries with one url one is added, entries without url all are."""
    moves = F.coalesce(condition, F.lit(False))
    moved = queue.where(moves & F.col("url").isNotNull()).dropDuplicates(["url"]).unionByName(queue.where(moves & F.col("url").isNull()))
    return queue.where(~moves), target.unionByName(moved.join(target.select("url"), "url", "left_anti"), allowMissingColumns=True)


def drain(queue: DataFrame, saved: DataFrame) -> DataFrame:
    """[STM-12, STM-13] What is left after the saved items went; failed items stay in the queue."""
    return queue.join(saved.where("ok").select("url"), "url", "left_anti")


def merge_series(queue: DataFrame, new: DataFrame) -> DataFrame:
    """[STM-11, AG-9] Raw files of one series as one sorted set."""
    both = queue.select("series", F.explode("raws").alias("raw")).union(new.select("series", F.explode("raws")))
    return both.groupBy("series").agg(F.array_sort(F.collect_set("raw")).alias("raws"))


def index_range(spec: str, size: int) -> list[int]:
    """[SO-5] ``0,1,2-5`` clipped to the size, sorted, once each."""
    found: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        lo, _, hi = part.partition("-")
        found.update(range(int(lo), int(hi or lo) + 1))
    return sorted(i for i in found if 0 <= i < size)


def batches(items: DataFrame, order: str, size: int) -> DataFrame:
    """[WN-11, WN-10] Numbered batches in a global order. The numbers are made from counts of ranges, not by one task."""
    from .segments import global_index

    return global_index(items, order).withColumn("batch", F.floor(F.col("index") / size).cast("int"))


def first_pending(jobs: DataFrame) -> DataFrame:
    """[WN-12, AG-10, AG-11] By job signature: whether all names are done, and the first that is not."""
    return jobs.groupBy("job").agg(F.bool_and("done").alias("all_done"), F.bool_or(~F.col("done")).alias("any_pending"), F.min_by("name", F.when(~F.col("done"), F.col("queue_pos"))).alias("first_pending"))
