"""Queries over web pages: urls, titles, texts, transcripts in markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html
from ..functions import text as T
from ..operators import filters
from .common import read


def url_normalize_key(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", T.normalize_url("url").alias("norm_url"), T.dedup_key("url", "html").alias("key"))


def dedup_url_first(spark, sf_dir):
    return filters.dedup_urls(read(spark, sf_dir, "pages"))


def url_routes(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", T.transcript_key("url").alias("key"), filters.playlist_url("url").alias("playlist"), T.split_path("url")["base"].alias("base"))


def page_title_cascade(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", html.page_title("html").alias("title"))


def page_text(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", html.page_text("html").alias("text"))
    return p.select("page_id", F.length("text").alias("n"), F.md5("text").alias("h"))


def page_headings(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(html.visible(html.element("html", "h1"))).alias("h1"), F.regexp_count("html", F.lit("<p[ >]")).alias("n_p"))


QUERIES = {f.__name__: f for f in (url_normalize_key, dedup_url_first, url_routes, page_title_cascade, page_text, page_headings)}

_RX = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
_P = lambda g: f"regexp_extract(trim(url), '{_RX}', {g})"
_URL = f"""(case when {_P(1)} <> '' then lower({_P(1)}) || ':' else '' end || case when {_P(2)} <> '' then '//' || lower({_P(2)}) else '' end || regexp_replace({_P(3)}, '/+$', '')
    || case when {_P(4)} <> '' then '?' || array_to_string(list_sort(string_split({_P(4)}, '&')), '&') else '' end)"""
_OUT = r"regexp_replace({}, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g')"


def _visible(c: str) -> str:
    x = f"regexp_replace({_OUT.format(c)}, '(?s)<[^>]*>', ' ', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"trim(regexp_replace({x}, '[ \\t\\r\\n]+', ' ', 'g'))"


def _element(tag: str) -> str:
    return f"regexp_extract({_OUT.format('html')}, '(?is)<{tag}\\b[^>]*>(.*?)(?:</{tag}\\s*>|$)', 1)"


_H1, _TITLE = _visible(_element("h1")), _visible(_element("title"))
SQL = {
    "url_normalize_key": f"select page_id, {_URL} norm_url, substr(sha256({_URL}), 1, 16) as key from pages",
    "dedup_url_first": f"select page_id, {_URL} norm_url, substr(sha256({_URL}), 1, 16) hash16 from pages qualify row_number() over (partition by {_URL} order by page_id) = 1",
    "url_routes": """select page_id, substr(regexp_replace(regexp_replace(url, '^https?://', ''), '[^A-Za-z0-9]+', '-', 'g'), 1, 64) as key,
        regexp_matches(url, '[?&]list=|/playlist|/channel/|/series/|[?&]page=') playlist, string_split(url, '/')[-1] base from pages""",
    "page_title_cascade": f"select page_id, coalesce(case when length({_H1}) > 10 then {_H1} end, nullif({_TITLE}, ''), 'untitled') title from pages",
    "page_text": f"select page_id, case when length(t) >= 100 then length(t) end n, case when length(t) >= 100 then md5(t) end h from (select page_id, {_visible(_element('article'))} t from pages)",
    "page_headings": f"select page_id, md5({_H1}) h1, len(regexp_extract_all(html, '<p[ >]'))::int n_p from pages",
}
