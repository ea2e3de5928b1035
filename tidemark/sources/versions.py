"""Tables with upserts that write only the buckets they touch: a log of versions, deltas by bucket, merge on read, compaction.

    <path>/log/00000000000000000007.json   what version 7 adds: one line for each bucket
    <path>/data/<write>/bucket=<b>/...     its rows, as Parquet

A write first puts its rows into a folder of its own, then claims the next version by creating that version's file of the log, which
fails if another writer was faster; then it takes the one after. Rows of a later version replace those of an earlier one with the same
key, so blind upserts never conflict. Nobody sees a write that ended before its log file was there, and what it left is removed by ``vacuum``.
A reader takes for every bucket the last base and the deltas after it, and keeps the last version of each key; buckets without
deltas are read as they are. ``compact`` writes new bases for the buckets with most deltas. Files are opened by Spark and Hadoop only.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a new table, deltas that make a bucket due for compaction.
BUCKETS, DELTAS = 64, 8
GONE, VERSION = "_gone", "_version"


@dataclass(frozen=True)
class Part:
    """Rows of one bucket. ``upto``: the version whose rows a base holds; a delta stands for its own version only."""

    version: int
    bucket: int
    folder: str
    base: bool
    upto: int


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, key: list[str] | None = None, schema: T.StructType | str | None = None, buckets: int = BUCKETS):
        """Opens a table, or makes one of this key and schema if there is none."""
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._io = jvm.org.apache.hadoop.io.IOUtils
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if schema is not None:
            kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
            if not key or set(key) - set(kind.names) or {GONE, VERSION, "bucket"} & set(kind.names):
                raise ValueError("the schema must hold the key, and no column named bucket, _gone or _version")
            self._claim(0, [{"key": key, "buckets": buckets, "schema": kind.json()}])
        said = json.loads(self._read(self._log(0)).splitlines()[0])
        self.key, self.buckets, self.schema = said["key"], said["buckets"], T.StructType.fromJson(json.loads(said["schema"]))
        if key and list(key) != self.key:
            raise ValueError(f"the table's key is {self.key}")

    # -- the log

    def _log(self, version: int):
        return self._path(f"{self.path}/log/{version:020d}.json")

    def _read(self, path) -> str:
        out = self.spark.sparkContext._jvm.java.io.ByteArrayOutputStream()
        stream = self.fs.open(path)
        self._io.copyBytes(stream, out, 65536, True)
        return bytes(out.toByteArray()).decode()

    def _claim(self, version: int, lines: list[dict]) -> bool:
        """Make a version's file of the log; False if it is there. The lines are written aside and renamed, so the file is whole or
        absent; stores whose rename replaces files need one writer at a time (the target is looked at first)."""
        aside = self._path(f"{self.path}/log/.{uuid.uuid4().hex}")
        self.fs.mkdirs(self._path(f"{self.path}/log"))
        stream = self.fs.create(aside, False)
        stream.write(bytearray("".join(json.dumps(x) + "\n" for x in lines).encode()))
        stream.close()
        target = self._log(version)
        if not self.fs.exists(target) and self._rename(aside, target):
            return True
        self.fs.delete(aside, False)
        return False

    def _rename(self, aside, target) -> bool:
        local = self.fs.getUri().getScheme() == "file"
        if not local:
            return self.fs.rename(aside, target)  # a file that is there stays, and the answer is False
        import os

        try:  # a local rename would replace the file of a faster writer; a link does not
            os.link(aside.toUri().getPath(), target.toUri().getPath())
        except FileExistsError:
            return False
        self.fs.delete(aside, False)
        return True

    def version(self) -> int:
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.path}/log"))]
        return max(int(n[:20]) for n in names if n.endswith(".json") and not n.startswith("."))

    def parts(self, version: int | None = None) -> list[Part]:
        """What readers of a version need: by bucket, the last base and the deltas after it. One small row a bucket and delta; compaction bounds their number."""
        top = self.version() if version is None else version
        log = self.spark.read.schema("version long, bucket int, folder string, base boolean, upto long").json(f"{self.path}/log/*.json")
        rows = log.where(F.col("bucket").isNotNull() & (F.col("version") <= top))
        last = rows.where("base").groupBy("bucket").agg(F.max(F.struct("upto", "version")).alias("b")).select("bucket", F.col("b.upto").alias("at"), F.col("b.version").alias("of"))
        live = rows.join(last, "bucket", "left").where(F.when(F.col("base"), F.col("version") == F.col("of")).otherwise(F.col("at").isNull() | (F.col("version") > F.col("at"))))
        return sorted((Part(r.version, r.bucket, r.folder, r.base, r.upto) for r in live.collect()), key=lambda p: (p.bucket, p.version))

    # -- writing

    def _bucket(self):
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.key]), F.lit(self.buckets)).cast("int")

    def _stage(self, rows: DataFrame) -> tuple[str, list[int]]:
        """Rows with a column ``bucket`` as files of a folder of their own; the buckets that have any."""
        folder = uuid.uuid4().hex
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        there = self.fs.listStatus(self._path(f"{self.path}/data/{folder}"))
        return folder, sorted(int(s.getPath().getName()[7:]) for s in there if s.getPath().getName().startswith("bucket="))

    def upsert(self, new: DataFrame, order: str | None = None, gone=None, after: int | None = None) -> int | None:
        """Rows that replace those of the same key; the version they make. Of several rows of a key the last by ``order`` stays, or the
        greatest by its columns. ``gone`` is a condition: keys of rows that meet it are removed. Keys compare null-safely. With
        ``after`` the version must be the next one to it; None if another writer was faster (nothing is changed then)."""
        names = self.schema.names
        by = F.struct(*([F.col(order).alias("_order")] if order else []), *[F.col(f"`{c}`") for c in names], F.coalesce(F.lit(False) if gone is None else gone, F.lit(False)).alias(GONE))
        last = new.groupBy(*[F.col(f"`{k}`") for k in self.key]).agg(F.max(by).alias("_row"))
        rows = last.select(*[F.col(f"_row.`{c}`").cast(self.schema[c].dataType).alias(c) for c in names], F.col(f"_row.{GONE}").alias(GONE)).withColumn("bucket", self._bucket())
        folder, buckets = self._stage(rows)
        if after is None:
            return self.commit(folder, buckets)
        return after + 1 if self._claim(after + 1, self._delta(after + 1, folder, buckets)) else None

    def _delta(self, version: int, folder: str, buckets: list[int]) -> list[dict]:
        return [{"version": version, "bucket": b, "folder": folder, "base": False, "upto": version} for b in buckets]

    def commit(self, folder: str, buckets: list[int]) -> int:
        """Claim the next free version for a staged delta."""
        version = self.version() + 1
        while not self._claim(version, self._delta(version, folder, buckets)):
            version += 1
        return version

    # -- reading

    def _files(self, parts: list[Part]) -> DataFrame:
        """The rows of some parts, with the version they count for and, for bases, no removed keys."""
        kind = T.StructType([*self.schema.fields, T.StructField(GONE, T.BooleanType())])
        rows = self.spark.read.schema(kind).parquet(*[f"{self.path}/data/{p.folder}/bucket={p.bucket}" for p in parts])
        listed = self.spark.createDataFrame([(f"{p.folder}/bucket={p.bucket}", p.upto) for p in parts], f"_part string, {VERSION} long")
        part = F.regexp_extract(F.col("_metadata.file_path"), r"([0-9a-f]{32}/bucket=\d+)/[^/]*$", 1)
        return rows.withColumn("_part", part).join(F.broadcast(listed), "_part").drop("_part")  # a row for each bucket and delta

    def _merged(self, parts: list[Part]) -> DataFrame:
        names = self.schema.names
        last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in names], GONE), VERSION)
        rows = self._files(parts).groupBy(*[F.col(f"`{k}`") for k in self.key]).agg(last.alias("_row"))
        return rows.where(~F.coalesce(F.col(f"_row.{GONE}"), F.lit(False))).select(*[F.col(f"_row.`{c}`").alias(c) for c in names])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows as of a version. Only buckets with deltas are merged; the others are a scan."""
        parts = self.parts(version)
        several = {p.bucket for p in parts if not p.base}
        merge, plain = [p for p in parts if p.bucket in several], [p for p in parts if p.bucket not in several]
        out = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{p.folder}/bucket={p.bucket}" for p in plain]) if plain else self.spark.createDataFrame([], self.schema)
        return out.unionByName(self._merged(merge)) if merge else out

    # -- upkeep

    def compact(self, deltas: int = DELTAS) -> int | None:
        """New bases for the buckets with at least so many deltas; None if there are none. Upserts may go on meanwhile: their
        versions are later than what a base holds. If two compactions meet, the one that has read more counts, as bases are chosen by what they hold."""
        top = self.version()
        parts = self.parts(top)
        many: dict[int, int] = {}
        for p in parts:
            many[p.bucket] = many.get(p.bucket, 0) + (not p.base)
        due = {b for b, n in many.items() if n >= deltas}
        if not due:
            return None
        rows = self._merged([p for p in parts if p.bucket in due]).withColumn(GONE, F.lit(False)).withColumn("bucket", self._bucket())
        folder, full = self._stage(rows)
        for b in due - set(full):  # all rows of a bucket are gone: its base is an empty folder
            self.fs.mkdirs(self._path(f"{self.path}/data/{folder}/bucket={b}"))
        version = self.version() + 1
        while not self._claim(version, [{"version": version, "bucket": b, "folder": folder, "base": True, "upto": top} for b in sorted(due)]):
            version += 1
        return version

    def vacuum(self, older: float = 7 * 86400.0) -> int:
        """Remove data that no reader of the present version needs and that is older than so many seconds (a writer that has not
        committed by then is lost); how many folders went."""
        live = {p.folder for p in self.parts()}
        limit, gone = (time.time() - older) * 1000, 0
        data = self._path(f"{self.path}/data")
        for s in self.fs.listStatus(data) if self.fs.exists(data) else []:
            if s.getPath().getName() not in live and s.getModificationTime() <= limit:
                gone += bool(self.fs.delete(s.getPath(), True))
        return gone
