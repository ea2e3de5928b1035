"""Helpers shared by the training-data operators: intermediate tables, row keys, components."""

from __future__ import annotations

import atexit
import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs on one machine, as in tests.
LOCAL_WORK = "file:///tmp/checkpoints/tidemark"


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session."""
    given = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return LOCAL_WORK


class Tables:
    """Intermediate tables of one operator run, below the shared folder.

    ``save`` writes a DataFrame as Parquet and rereads it, which cuts its lineage: a lost executor costs a reread.
    ``drop`` deletes a table that no later step reads. What remains is deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._delete, self.root)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended already
            pass

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def release(self) -> None:
        """Let Spark delete the shuffle files of DataFrames that are no longer referenced. Spark's own listeners hold the last
        query until another event comes, so an empty job goes before the collection."""
        gc.collect()
        self.spark.range(1).collect()
        self.spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)  # the files are deleted by another thread


def text_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; other columns, whatever their names, are left out."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def with_row(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, row): as ``text_of``, with the whole original row in one column, so that no name of it can clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def with_text(batch, text_col: str = "text"):
    """(doc_id, text, row) of an Arrow batch of (doc_id, row): the text is that of the row, so it need not be sent twice. Null texts have no bytes."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).field(text_col), batch.column(1)], ["doc_id", "text", "row"])


def replaced(docs: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` from ``rows.row``, with another text and, if there is one, n_chars of it."""
    out = [F.col(text).alias("text") if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return rows.select(*out)


def crc_fold(id_col: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo ``modulus``: what tells training rows from held-out ones. A null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def connected_components(edges: DataFrame, tables: Tables, name: str = "cc", rounds: int = 40) -> DataFrame:
    """Smallest reachable node of every node in ``edges(a, b)``: rows (node, component).

    Alternates large-star and small-star steps; each is a grouped minimum (combined before the shuffle) joined back
    to the edges by a join that Spark can split where one node has very many edges. Ends when all edges lead to roots.
    Self-loops keep a node in the result; null ends and repeated edges are dropped.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null")
    e = tables.save(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    e = e.where("a <> b")

    def stars(df: DataFrame) -> bool:
        """Whether every edge leads to a root and every node has one: then nothing can change any more."""
        ends = df.selectExpr("stack(2, a, 1, 0, b, 0, 1) as (node, up, down)")
        return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1").isEmpty()

    k = 0
    while not stars(e):
        if k == rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        both = e.selectExpr("stack(2, a, b, b, a) as (a, b)")
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least2, "a").selectExpr("stack(2, b, m, a, m) as (a, b)").where("a <> b").distinct()
        k += 1
        e = tables.save(small, f"{name}-{k}")
        if k > 1:  # the first holds the nodes
            tables.drop(f"{name}-{k - 1}")
    comp = e.groupBy("a").agg(F.min("b").alias("m"))
    return nodes.join(comp, nodes.node == comp.a, "left").select("node", F.coalesce("m", "node").alias("component"))
