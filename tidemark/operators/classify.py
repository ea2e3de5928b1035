"""Note types by an ordered cascade of keyword lists, and interview heuristics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..config import DEFAULT
from ..functions.automaton import lexicon_hits
from ..functions.text import col


def interview_like(title, content, lex=DEFAULT) -> Column:
    """[CLS-2] Two host probes and not many more of the audience, or four host probes."""
    text = F.substring(F.concat(col(title), F.lit("\n"), F.substring(col(content), 1, config.INTERVIEW_PREFIX)), 1, config.INTERVIEW_PREFIX)
    found = lexicon_hits(text, {"host": lex.host_probes, "audience": lex.audience_probes})
    host, audience = found["host"]["total"], found["audience"]["total"]
    return ((host >= 2) & (audience <= host + 1)) | (host >= 4)


def note_type(title, content, lex=DEFAULT) -> Column:
    """[CLS-1] First match in order: tutorial, interview words, interview heuristics, key points, roundup, reading, opinion, case.

    The automaton reads the beginning of a note once for the words of all types."""
    text = F.lower(F.concat(col(title), F.lit("\n"), F.substring(col(content), 1, config.CLASSIFY_PREFIX)))
    words = ("tutorial", "interview", "key_points", "roundup", "reading", "opinion", "case")
    found = lexicon_hits(text, {name: getattr(lex, name) for name in words})
    has = lambda name: found[name]["hits"] > 0
    quoted = col(title).contains("《") & col(title).contains("》")
    return (
        F.when(has("tutorial"), "structured").when(has("interview") | interview_like(title, content, lex), "interview").when(has("key_points"), "key_points")
        .when(has("roundup"), "roundup").when(quoted | has("reading"), "reading").when(has("opinion"), "opinion").when(has("case"), "case").otherwise("structured")
    )


def templates(spark: SparkSession, lex=DEFAULT) -> DataFrame:
    """[CLS-4] The dimension of note types: key, label."""
    return spark.createDataFrame(list(lex.type_labels.items()), "note_type string, label string")


def with_template(notes: DataFrame, dimension: DataFrame, default: str = "structured") -> DataFrame:
    """[CLS-3] Unknown types get the default's template, or null if the dimension lacks it. A type that the dimension repeats has its least label."""
    one = dimension.groupBy("note_type").agg(F.min("label").alias("label"))
    fallback = one.where(F.col("note_type") == default).select(F.col("label").alias("_default"), F.lit(1).alias("_one"))
    found = notes.join(one, "note_type", "left").withColumn("_one", F.lit(1)).join(fallback, "_one", "left")
    return found.withColumn("label", F.coalesce("label", "_default")).drop("_default", "_one")


def provider(configured: str | None, available: set[str], order: list[str]) -> str | None:
    """[CLS-5] The configured provider if it is available, else the first available one by priority, else none."""
    return configured if configured in available else next((p for p in order if p in available), None)
