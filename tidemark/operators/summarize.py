"""Two-stage summaries with a pluggable provider, and a quality gate with one retry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from .providers import Policy, called

#: A provider makes a summary (or null) of each text of a batch. Providers that call services go behind this interface.
Provider = Callable[[Column], Column]


def extractive(most: int = 200) -> Provider:
    """[UDF-1, UDF-2] Deterministic and offline: the first sentence, at most so many characters; null for blank texts."""
    return lambda text: F.nullif(F.trim(F.substring(F.regexp_extract(F.trim(text), r"(?s)^[^.!?]*[.!?]?", 0), 1, most)), F.lit(""))


def hosted(function: Callable[[str], str | None], tries: int = 3, policy: Policy | None = None) -> Provider:
    """[UDF-3, UDF-5, FLT-21] A Python function for each text, tried again with back-off on errors whose message tells that they pass; what
    fails for good is null. ``providers.called`` gives the errors too, and one client a task."""
    ask = called(lambda: function, policy or Policy(tries=tries))
    return lambda text: ask(text)["value"]


def two_stage(chunks: DataFrame, provider: Provider, key: str = "media_id", order: tuple[str, ...] = ("group", "chunk"), merge: Provider | None = None) -> DataFrame:
    """[UDF-6, ALG-3] Every chunk is summarised, then the partial summaries, in order, are merged or joined.

    Any null partial makes the whole null; one chunk's partial is the result as it is; nothing gives no row.
    """
    done = chunks.withColumn("partial", F.nullif(provider(F.col("text")), F.lit("")))
    parts = F.sort_array(F.collect_list(F.struct(*order, "partial")))
    out = done.groupBy(key).agg(parts.alias("p"), F.count("*").cast("int").alias("n_chunks"), F.count_if(F.col("partial").isNull()).alias("bad"))
    text = F.array_join(F.transform("p", lambda x: x["partial"]), "\n\n---\n\n")
    final = F.when(F.col("n_chunks") == 1, text).otherwise(merge(text) if merge else text)
    return out.select(key, "n_chunks", F.when(F.col("bad") == 0, final).alias("summary"))


def needs_retry(score, passed, threshold: int = config.GATE_SCORE, enabled: bool = True) -> Column:
    """[UDF-7] A review below the threshold that did not pass; null reviews and closed gates never retry."""
    return F.lit(enabled) & F.coalesce((score < threshold) & ~passed, F.lit(False))


def gated(reviews: DataFrame, again: Provider, threshold: int = config.GATE_SCORE, enabled: bool = True) -> DataFrame:
    """[UDF-7] Summaries that need it are made once more from the text; where that gives nothing the first stays."""
    retry = needs_retry(F.col("score"), F.col("passed"), threshold, enabled)
    return reviews.withColumn("retried", retry).withColumn("summary", F.when(retry, F.coalesce(again(F.col("text")), F.col("summary"))).otherwise(F.col("summary")))
