"""Filters and predicates over documents, posts, files and errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config
from ..config import DEFAULT
from ..functions.automaton import lexicon_hits
from ..functions.text import col, contains_any, generic_title, hash16, normalize_url, strip_markdown


def ad_title(title, lex=DEFAULT) -> Column:
    """[FLT-1]"""
    return contains_any(title, lex.ad_titles)


def ad_phrases(text, lex=DEFAULT) -> Column:
    """[AG-3] How many different phrases of advertisements occur; compute it once where several operators ask."""
    return lexicon_hits(text, {"phrases": lex.ad_phrases})["phrases"]["hits"]


def ad_document(title, text, lex=DEFAULT, phrases=None) -> Column:
    """[FLT-2] An advertising title, or a short text with two different phrases; only short texts are searched for them."""
    short = F.length(col(text)) < config.AD_DOC_CHARS
    hits = ad_phrases(F.when(short, col(text)), lex) if phrases is None else col(phrases)
    return ad_title(title, lex) | (short & (hits >= config.AD_HITS))


def ad_block(plain, found) -> Column:
    """[FLT-3] A short block with a strong term, or any block with two different phrases; ``found`` is what the automaton says of it."""
    return ((found["strong"]["hits"] >= 1) & (F.length(plain) < config.AD_BLOCK_CHARS)) | (found["phrases"]["hits"] >= config.AD_HITS)


def purify(text, lex=DEFAULT, separator: str = "\n\n") -> Column:
    """[FLT-4] Images of codes out, advertising blocks out, the rest joined by the separator again."""
    clean = F.regexp_replace(col(text), r"!\[[^\]]*(?:QR|qr|code)[^\]]*\]\([^)]*\)", "")
    blocks = F.split(clean, separator)
    plain = F.transform(blocks, lambda b: strip_markdown(b))
    found = lexicon_hits(plain, {"strong": lex.ad_strong, "phrases": lex.ad_phrases}, each=True)
    told = F.arrays_zip(blocks.alias("block"), plain.alias("plain"), found.alias("found"))
    kept = F.filter(told, lambda x: (F.trim(x["block"]) != "") & ~ad_block(x["plain"], x["found"]))
    return F.trim(F.array_join(F.transform(kept, lambda x: x["block"]), separator))


def wall(text, lex=DEFAULT) -> Column:
    """[FLT-5]"""
    return contains_any(F.lower(col(text)), lex.wall_markers)


def long_enough(text, least: int = config.MIN_CONTENT) -> Column:
    """[FLT-6]"""
    return F.length(F.trim(col(text))) >= least


def substantive(text, lex=DEFAULT) -> Column:
    """[FLT-7] Long enough, also without urls, and free of noise patterns."""
    text = F.trim(col(text))
    bare = F.trim(F.regexp_replace(text, r"https?://[^ \n]+", ""))
    return (F.length(text) >= config.SUBSTANTIVE) & (F.length(bare) >= config.SUBSTANTIVE) & ~contains_any(text, lex.post_noise)


def length_band(text) -> Column:
    """[FLT-14] drop / light / full by the length of the trimmed text."""
    n = F.length(F.trim(col(text)))
    return F.when(n < config.BAND_DROP, "drop").when(n <= config.BAND_LIGHT, "light").otherwise("full")


def route(kind) -> Column:
    """[FLT-13]"""
    return F.when(col(kind).isin("article", "cv"), "article").when(col(kind).isin("video", "dynamic"), col(kind)).otherwise("ignored")


def empty_raw(body, link_marker: str = "Original link:", least: int = config.MIN_CONTENT) -> Column:
    """[FLT-16] What follows the header, cut at the link marker, is too short."""
    after = F.when(col(body).contains("\n---\n"), F.element_at(F.split(col(body), "\n---\n", 2), -1)).otherwise(col(body))
    return F.length(F.trim(F.substring_index(after, link_marker, 1))) < least


def listed_path(path, skip_folders=("_archive", ".git", "templates"), skip_prefixes=("_", ".")) -> Column:
    """[FLT-17, SRC-2] Paths outside the folders to skip whose base name has no prefix to skip."""
    parts = F.split(col(path), "/")
    bad_prefix = reduce(lambda a, b: a | b, [F.element_at(parts, -1).startswith(p) for p in skip_prefixes])
    return ~F.arrays_overlap(parts, F.array(*map(F.lit, skip_folders))) & ~bad_prefix


def playlist_url(url) -> Column:
    """[FLT-18]"""
    return col(url).rlike(r"[?&]list=|/playlist|/channel/|/series/|[?&]page=")


def retryable(message, lex=DEFAULT) -> Column:
    """[FLT-21]"""
    return contains_any(F.lower(col(message)), lex.retryable)


def keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """[WN-4] The first row of every key in a given order."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")


def dedup_content(docs: DataFrame) -> DataFrame:
    """[JN-3, STM-20] First row of every text; only ids, lengths and hashes are shuffled, and all but a task's first rows of a hash are left out before."""
    return keep_first(docs.select("doc_id", "lang", F.length("text").alias("n_chars"), hash16("text").alias("hash16")), "hash16", "doc_id")


def known(items: DataFrame, index: DataFrame) -> DataFrame:
    """[JN-3, STM-20] Items with the record of the index that has their key, by url first and by content after; null if new."""
    return items.join(index.select(F.col("hash16").alias("key"), F.col("title").alias("known_title")), "key", "left")


def dedup_urls(pages: DataFrame) -> DataFrame:
    """[STR-1..3] First page of every normalised url."""
    return keep_first(pages.select("page_id", normalize_url("url").alias("norm_url")).withColumn("hash16", hash16("norm_url")), "norm_url", "page_id")


def scope(df: DataFrame, column: str, names: list) -> DataFrame:
    """[FLT-11] Only the named ones; an empty scope is refused."""
    if not names:
        raise ValueError("name at least one account")
    return df.where(F.col(column).isin(*names))


def title_usable(title) -> Column:
    return ~generic_title(title)
