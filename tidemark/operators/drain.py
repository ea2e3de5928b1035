"""A drain of pending series that can be killed at any point and started again.

Tables below one folder, each a ``VersionedTable``: ``files`` (what collectors left: raw texts and bodies), ``notes`` (the target), ``manifest``
(the state of each page), ``queue`` (series to drain), ``leases`` (who drains a series, until when). A drain takes all free series of the queue
and goes through its steps for all of them at once. Every step reads what is there, writes what is lacking by one upsert, and does nothing
if it has been done, so a new run after a crash repeats at most the step that had not been committed.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import STATES
from ..functions.text import parse_episode_name
from ..kept import saved
from ..sources.versions import VersionedTable
from .queues import batches
from .series import state_number

TABLES = {
    "files": (["series", "name"], "series string, name string, size long, text string"),
    "notes": (["series", "page"], "series string, page int, base string, text string"),
    "manifest": (["series", "page"], "series string, page int, ord int"),
    "queue": (["series"], "series string, url string"),
    "leases": (["series"], "series string, owner string, until double"),
}
RAW, BODY, LANDED, VERIFIED = (STATES.index(s) for s in ("raw_ready", "summarized", "landed", "verified"))


class SeriesDrain:
    """[STM-14] ``after`` is called with the name of each step that has been committed; ``clock`` tells the time of leases."""

    def __init__(self, spark: SparkSession, root: str, batch: int = 10_000, lease: float = 3600.0, buckets: int = 16, after: Callable[[str], None] = lambda step: None, clock: Callable[[], float] = time.time):
        self.batch, self.lease, self.after, self.clock = batch, lease, after, clock
        self.tables = {name: VersionedTable(spark, f"{root}/{name}", key, kind, buckets) for name, (key, kind) in TABLES.items()}

    def take(self, owner: str) -> DataFrame:
        """Leases on all series of the queue that are free, run out or one's own: the version read must be the last one when
        they are written, so two drains never get one series."""
        leases, now = self.tables["leases"], self.clock()
        while True:
            version = leases.version()
            held = leases.read(version).where((F.col("until") > now) & (F.col("owner") != owner)).select("series")
            free = saved(self.tables["queue"].read().select("series").join(held, "series", "left_anti"), "free")
            if free.isEmpty() or leases.upsert(free.withColumn("owner", F.lit(owner)).withColumn("until", F.lit(now + self.lease)), after=version) is not None:
                return free

    def _files(self, mine: DataFrame) -> DataFrame:
        """Files of the leased series with what their names say; others than pages of a series are left alone."""
        named = self.tables["files"].read().join(mine, "series", "left_semi").withColumn("n", parse_episode_name("name"))
        return named.where("n is not null").select("series", "name", "size", "text", F.col("n.page").alias("page"), F.col("n.kind").alias("kind"))

    def _write(self, step: str, table: str, rows: DataFrame, gone=None) -> None:
        rows = saved(rows, step.split("-")[0])
        if not rows.isEmpty():
            self.tables[table].upsert(rows, gone=gone)
        self.after(step)

    def fix_names(self, mine: DataFrame) -> None:
        """Misnamed bodies get the right name; if that is taken, the larger of both stays, the rightly named one if they are equal."""
        bodies = self._files(mine).where("kind in ('body', 'stray')")
        to = F.regexp_replace("name", r"_body\.md$", ".body.md")
        best = bodies.groupBy("series", to.alias("to")).agg(F.max(F.struct("size", F.col("kind") == "body", "text")).alias("b"), F.bool_or(F.col("kind") == "stray").alias("stray"))
        right = best.where("stray").select("series", F.col("to").alias("name"), F.col("b.size").alias("size"), F.col("b.text").alias("text"))
        wrong = bodies.where("kind = 'stray'").select("series", "name", F.lit(-1).cast("long").alias("size"), "text")
        self._write("names", "files", right.unionByName(wrong), gone=F.col("size") < 0)

    def reconcile(self, mine: DataFrame) -> None:
        """States that files and notes prove, where they are higher than those of the manifest."""
        files = self._files(mine).select("series", "page", F.when(F.col("kind") == "raw", "raw_ready").when(F.col("kind") == "body", "summarized").otherwise("pending").alias("state"))
        notes = self.tables["notes"].read().join(mine, "series", "left_semi").select("series", "page", F.lit("landed").alias("state"))
        proved = files.unionByName(notes).groupBy("series", "page").agg(F.max(state_number(F.col("state"))).alias("ord"))
        self._write("reconcile", "manifest", self._higher(proved))

    def _higher(self, states: DataFrame) -> DataFrame:
        """[STM-15] States only rise."""
        old = self.tables["manifest"].read().select("series", "page", F.col("ord").alias("old"))
        return states.join(old, ["series", "page"], "left").where("old is null or ord > old").select("series", "page", "ord")

    def save(self, mine: DataFrame) -> None:
        """Bodies of pages that are not verified become notes, a batch of pages at a time; a batch is in the notes before it is in the manifest."""
        done = self.tables["manifest"].read().where(F.col("ord") >= VERIFIED).select("series", "page")
        bodies = self._files(mine).where("kind = 'body' and trim(text) <> ''").join(done, ["series", "page"], "left_anti")
        one = bodies.groupBy("series", "page").agg(F.max(F.struct("size", "name", "text")).alias("b"))
        rows = one.select("series", "page", F.regexp_replace("b.name", r"\.body\.md$", "").alias("base"), F.col("b.text").alias("text"))
        same = self.tables["notes"].read()
        todo = saved(batches(rows.join(same, [*rows.columns], "left_anti"), "series", self.batch), "todo")
        for k in range((todo.agg(F.max("batch")).first()[0] or 0) + 1):
            part = todo.where(F.col("batch") == k).select(*rows.columns)
            self._write(f"notes-{k}", "notes", part)
            self._write(f"landed-{k}", "manifest", self._higher(part.select("series", "page", F.lit(LANDED).alias("ord"))))

    def verify(self, mine: DataFrame) -> None:
        """Pages whose note, read again, holds the text of the body are verified."""
        bodies = self._files(mine).where("kind = 'body'").select("series", "page", "text")
        found = self.tables["notes"].read().join(bodies, ["series", "page", "text"], "left_semi").select("series", "page", F.lit(VERIFIED).alias("ord"))
        self._write("verify", "manifest", self._higher(found))

    def clean_up(self, mine: DataFrame) -> None:
        """Raw texts and bodies of verified pages go."""
        done = self.tables["manifest"].read().where(F.col("ord") >= VERIFIED).select("series", "page")
        gone = self._files(mine).where("kind in ('raw', 'body')").join(done, ["series", "page"], "left_semi").select("series", "name", "size", "text")
        self._write("clean_up", "files", gone, gone=F.lit(True))

    def close(self, mine: DataFrame) -> None:
        """Series without a raw text that lacks its body leave the queue."""
        files = self._files(mine)
        body = files.where("kind = 'body'").select("series", "page")
        open_ = files.where("kind = 'raw'").select("series", "page").join(self.tables["manifest"].read().where(F.col("ord") >= VERIFIED), ["series", "page"], "left_anti")
        waits = open_.join(body, ["series", "page"], "left_anti").select("series").distinct()
        ready = self.tables["queue"].read().join(mine.join(waits, "series", "left_anti"), "series", "left_semi")
        self._write("queue", "queue", ready, gone=F.lit(True))

    def release(self, owner: str) -> None:
        """The owner's leases end, those of a drain that was killed before too."""
        self._write("release", "leases", self.tables["leases"].read().where(F.col("owner") == owner), gone=F.lit(True))

    def run(self, owner: str, clean_up: bool = False) -> DataFrame:
        """One drain; pages by series and state of what it held."""
        mine = self.take(owner)
        self.after("lease")
        if not mine.isEmpty():
            for step in (self.fix_names, self.reconcile, self.save, self.verify, *([self.clean_up] if clean_up else []), self.close):
                step(mine)
        self.release(owner)
        manifest = self.tables["manifest"].read().join(mine, "series", "left_semi")
        return manifest.groupBy("series").agg(F.count("*").alias("pages"), F.count_if(F.col("ord") >= LANDED).alias("landed"), F.count_if(F.col("ord") >= VERIFIED).alias("verified"))
