"""Sources: folders of texts, JSON state, tables, paged feeds, dropped payloads. All are Spark readers; nothing is fetched live."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import listed_path
from .history import reachable


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def text_folder(spark: SparkSession, path: str, glob: str = "*.{md,txt}") -> DataFrame:
    """[SRC-2, SO-3, FLT-17] Whole texts below a folder (path, text): raw staging files, hidden ones and blank ones left out."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.where(~F.col("path").contains("_raw_") & (F.trim(F.regexp_replace("text", r"\s+", " ")) != "") & listed_path("path"))


def json_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """[SRC-3] State as JSON lines or documents; a missing path is an empty table, corrupt records are left out."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    kind = T._parse_datatype_string(schema)
    wide = T.StructType([*kind.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where(F.col("_corrupt").isNull()).drop("_corrupt")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """[SRC-1, SRC-4, SRC-7, SRC-8, SRC-12] Pages, feeds and metadata that a collector has landed as Parquet."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def feed_pages(pages: DataFrame, size: int = 20, empty_limit: int = 2) -> DataFrame:
    """[SRC-5, SRC-6] Items of landed history pages (source_key, page from 1, items), up to the page where reading would have ended.

    Reading ends after a short page, or after ``empty_limit`` empty pages in a row; ``history.reachable`` finds the ends.
    """
    n = F.size("items").alias("page_items")
    items = pages.select(F.col("source_key").alias("source"), "page", n, F.posexplode("items").alias("position", "item"))
    return reachable(items, size, empty_limit).select(F.col("source").alias("source_key"), "page", "position", "item")


def resolve(urls: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """[SRC-9, SRC-17] (resolved, misses) of share urls or media against a cache by key."""
    hit = urls.join(cache, "key", "left_semi")
    return hit.join(cache, "key"), urls.join(cache, "key", "left_anti")


def dropped_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """[SRC-22] A stream of transcript payloads that clients drop as JSON files."""
    schema = "url string, video_id string, title string, description string, chapters array<struct<title:string,start:double>>, lang string, text string, fetched_at timestamp"
    return spark.readStream.schema(schema).json(folder)


def payload_notes(payloads: DataFrame, most: int = 2000) -> DataFrame:
    """[JSN-13] Notes of payloads: description (cut), chapters with their clock, text."""
    from ..functions.text import clock

    chapters = F.array_join(F.transform("chapters", lambda c: F.concat(F.lit("- "), clock(c["start"]), F.lit(" "), c["title"])), "\n")
    body = F.concat_ws("\n", F.concat(F.lit("# "), F.col("title")), F.concat(F.lit("Link: "), F.col("url")), F.lit("## Description"), F.substring("description", 1, most), F.lit("## Chapters"), chapters, F.lit("## Text"), F.col("text"))
    return payloads.select("video_id", body.alias("note"))
