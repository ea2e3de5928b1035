"""Title and text of HTML pages by regular expressions, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, first_filled, unescape


def visible(c) -> Column:
    """Text of a fragment of markup: comments, scripts and styles out, tags out, entities decoded, white space folded."""
    out = F.regexp_replace(col(c), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(out, r"(?s)<[^>]*>", " ")), r"[ \t\r\n]+", " "))


def element(c, tag: str) -> Column:
    """Inner markup of the first element of that name, closed or not; empty if there is none."""
    clean = F.regexp_replace(col(c), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    return F.regexp_extract(clean, rf"(?is)<{tag}\b[^>]*>(.*?)(?:</{tag}\s*>|$)", 1)


def page_title(c, default: str = "untitled", suffixes=(" - Site", " | Site")) -> Column:
    """[JSN-5] og:title over 5 characters, ``main-title`` over 10, h1 over 10, the title element without suffixes, or the default."""
    og = F.trim(unescape(F.regexp_extract(col(c), r"""(?is)<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']*)["']""", 1)))
    main = visible(F.regexp_extract(col(c), r"""(?is)<(\w+)[^>]+class=["'][^"']*main-title[^"']*["'][^>]*>(.*?)</\1>""", 2))
    h1, title = visible(element(c, "h1")), visible(element(c, "title"))
    for s in suffixes:
        title = F.regexp_replace(title, f"\\Q{s}\\E$", "")
    return first_filled(F.when(F.length(og) > 5, og), F.when(F.length(main) > 10, main), F.when(F.length(h1) > 10, h1), title, default=default)


def page_text(c, least: int = 100, walls=()) -> Column:
    """[JSN-6, JSN-7, FLT-5, FLT-6] Text of the article element, else of main, else of the paragraphs; null if short or behind a wall."""
    body = F.regexp_replace(col(c), r"(?is)<!--.*?-->|<(script|style|nav|aside|footer)\b.*?</\1\s*>", " ")
    paragraphs = F.array_join(F.filter(F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<p\b[^>]*>(.*?)(?=</p\s*>|<p\b|$)"), F.lit(1)), visible), lambda p: p != ""), "\n\n")
    enough = lambda x: F.when(F.length(x) >= least, x)
    found = F.coalesce(enough(visible(element(c, "article"))), enough(visible(element(c, "main"))), enough(paragraphs))
    wall = F.lit(False)
    for w in walls:
        wall = wall | F.lower(found).contains(w)
    return F.when(~wall, found)
