"""Sinks: resolution, fan-out, upserts and logs, written by Spark to folders that all executors share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import BUCKETS, DELTAS, VersionedTable


@dataclass
class Sink:
    """A named target. ``available`` is asked before every write; ``write`` gets the rows, and in streams the number of the batch."""

    name: str
    available: Callable[[], bool]
    write: Callable[..., None]


def resolve(sinks: dict[str, Sink], want_vault: bool = False, remote: bool = True) -> list[str]:
    """[SNK-1] The remote one if available and not disabled, the vault if asked for, the local one only if there is no other."""
    up = lambda name: name in sinks and sinks[name].available()
    chosen = [n for n, wanted in (("remote", remote), ("vault", want_vault)) if wanted and up(n)]
    return chosen or (["local"] if "local" in sinks else [])


def fan_out(df: DataFrame, sinks: dict[str, Sink], names: list[str]) -> dict[str, bool]:
    """[SNK-2, SNK-3] Every sink on its own; one that fails or is unknown gives False and does not stop the others."""
    df = df.persist()
    done = {}
    try:
        for name in names:
            try:
                ok = name in sinks and sinks[name].available()
                if ok:
                    sinks[name].write(df)
                done[name] = ok
            except Exception:
                done[name] = False
    finally:
        df.unpersist()
    return done


def folder_sink(path: str) -> Callable[[DataFrame], None]:
    """[SNK-4, SNK-5, SNK-9] Notes as Parquet, one partition a folder; a write replaces the partitions it has rows for."""
    return lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(path)


def vault_rows(notes: DataFrame, inbox: str = "inbox") -> DataFrame:
    """[SNK-5] (folder, path, ...) of notes by their path: what stands before the last slash, or the inbox if there is none."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return notes.withColumn("folder", F.when(folder == "", inbox).otherwise(folder))


def batch_folder_sink(path: str) -> Callable[[DataFrame, int], None]:
    """[SNK-4] A folder for each batch of a stream; a batch that is written again replaces its own folder."""
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def upsert_sink(spark: SparkSession, path: str, key: list[str], order: str | None = None, buckets: int = BUCKETS, deltas: int = DELTAS) -> Callable[[DataFrame], None]:
    """[SNK-6, SNK-12, STM-8] New rows replace old ones of the same key. Only the buckets that have new rows are written, and a version
    counts once its file of the log is there, so a crash leaves the old version; buckets with many deltas are compacted."""

    def write(df: DataFrame, batch: int = 0) -> None:
        table = VersionedTable(spark, path, key, df.schema, buckets)
        table.upsert(df, order)
        table.compact(deltas)

    return write


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    return VersionedTable(spark, path).read()


def batch_fan_out(spark: SparkSession, sinks: dict[str, Sink], names: list[str], records: str) -> Callable[[DataFrame, int], None]:
    """[SNK-2, SNK-3] For ``foreachBatch``: every sink writes every batch once, whatever fails in between.

    A file <records>/<sink>/<batch> is made when a sink has written a batch. A sink that fails or is not available does not stop the others, but
    the batch fails in the end, so the stream runs it again; sinks that have their record are left out then. A crash between a
    write and its record repeats the write, so sinks replace what they wrote of a batch (``batch_folder_sink``) or upsert.
    """
    unknown = set(names) - set(sinks)
    if unknown:
        raise ValueError(f"unknown sinks: {sorted(unknown)}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(records).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def run(df: DataFrame, batch: int) -> None:
        todo = [n for n in names if not fs.exists(path(f"{records}/{n}/{batch}"))]
        if not todo:
            return
        rows, failed = df.persist() if len(todo) > 1 else df, {}
        try:
            for name in todo:
                try:
                    if not sinks[name].available():
                        raise ConnectionError("not available")
                    sinks[name].write(rows, batch)
                    fs.create(path(f"{records}/{name}/{batch}"), True).close()
                except Exception as e:
                    failed[name] = f"{type(e).__name__}: {e}"[:300]
        finally:
            if rows.is_cached:
                rows.unpersist()
        if failed:
            raise RuntimeError(f"batch {batch} is not complete: {failed}")

    return run


def stage_raw(df: DataFrame, path: str) -> None:
    """[SNK-10] Raw texts with their header, appended to a bronze table."""
    df.withColumn("raw", F.concat_ws("\n", F.concat(F.lit("# "), "title"), F.concat(F.lit("Link: "), "url"), F.lit("---"), "text")).write.mode("append").parquet(path)


def log_progress(df: DataFrame, path: str, now: str) -> None:
    """[SNK-14] time, page, OK or FAIL, base, detail; appended."""
    df.select(F.lit(now).cast("timestamp").alias("ts"), "page", F.when(F.col("ok"), "OK").otherwise("FAIL").alias("status"), "base", "detail").write.mode("append").json(path)
