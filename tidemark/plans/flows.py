"""Queries over what sinks, sources and streams give back, and over predicates of names and messages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..kept import folder
from ..operators import audit, filters, providers
from ..sources import files, sinks
from ..sources.versions import VersionedTable
from ..streaming import feeds as streams
from .common import read
from .feeds import items
from .texts import docs



def place(spark, name: str) -> str:
    """A folder of its own for what a query writes."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def generic_titles(spark, sf_dir):
    """[FLT-15]"""
    return docs(spark, sf_dir).where(T.generic_title("title")).select("doc_id", "title")


def empty_raws(spark, sf_dir):
    """[FLT-16] Texts of which too little is left before the licence line."""
    return docs(spark, sf_dir).where(filters.empty_raw("text", "Licensed under", 400)).select("doc_id", F.length("text").alias("n"))


def listed_paths(spark, sf_dir):
    """[FLT-17, SO-3] Paths of pages, in order, without those in folders to skip and those whose base name has a prefix to skip."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", "")
    return read(spark, sf_dir, "pages").select("page_id", path.alias("path")).where(filters.listed_path("path", ("en", "archive"), ("1", "_"))).orderBy("path", "page_id")


def retryable_errors(spark, sf_dir):
    """[FLT-21] Answers of a service, by their codes."""
    message = F.concat(F.lit("HTTP "), (F.floor("value") % 110 + 400).cast("string"))
    return read(spark, sf_dir, "events").select("event_id", message.alias("message")).where(filters.retryable("message"))


def full_width_titles(spark, sf_dir):
    """[STR-6]"""
    return docs(spark, sf_dir).select("doc_id", T.full_width_title(F.concat("title", F.lit(' a/b: "c" <d>|*?'))).alias("title"))


def payload_notes(spark, sf_dir):
    """[SRC-22, JSN-13]"""
    chapter = F.struct(F.col("lang").alias("title"), (F.col("doc_id") % 7000).cast("double").alias("start"))
    p = docs(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("video_id"), "title", F.col("source").alias("url"), F.substring("text", 1, 2500).alias("description"), F.array(chapter).alias("chapters"), F.col("lang").alias("text"))
    return files.payload_notes(p).select(F.col("video_id").cast("long").alias("doc_id"), F.md5("note").alias("h"), F.length("note").alias("n"))


def resolved_urls(spark, sf_dir):
    """[SRC-9, SRC-17] Addresses of pages that a cache of every third page knows, with their record, and the others without."""
    urls = read(spark, sf_dir, "pages").select("page_id", T.transcript_key("url").alias("key"))
    cache = urls.where("page_id % 3 = 0").groupBy("key").agg(F.min("page_id").alias("cached"))
    hit, miss = files.resolve(urls, cache)
    return hit.select("page_id", "cached").unionByName(miss.select("page_id", F.lit(None).cast("long").alias("cached")))


def scoped_items(spark, sf_dir):
    """[FLT-11]"""
    return filters.scope(items(spark, sf_dir), "source_key", [1, 2, 3, 5, 8, 13]).groupBy("source_key").agg(F.count("*").alias("n"))


def vault_folders(spark, sf_dir):
    """[SNK-4, SNK-5, SNK-9] Notes written by folder and read again; those without a folder are in the inbox."""
    path = F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit("/x/"), F.col("doc_id").cast("string"), F.lit(".md"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    out = place(spark, "vault")
    sinks.folder_sink(out)(sinks.vault_rows(docs(spark, sf_dir).select("doc_id", path.alias("path"))))
    return spark.read.parquet(out).groupBy("folder").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def staged_raws(spark, sf_dir):
    """[SNK-10] Raw texts with their header, appended twice."""
    out = place(spark, "raw")
    for k in range(2):
        sinks.stage_raw(docs(spark, sf_dir).where(F.col("doc_id") % 2 == k).select("doc_id", "title", F.col("source").alias("url"), "text"), out)
    return spark.read.parquet(out).select("doc_id", F.md5("raw").alias("h"))


def logged_progress(spark, sf_dir):
    """[SNK-14, SRC-3] A log of pages, read again as state."""
    out = place(spark, "log")
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("page"), (F.length("text") > 500).alias("ok"), F.col("lang").alias("base"), F.col("source").alias("detail"))
    sinks.log_progress(rows, out, "2024-01-20 00:00:00")
    return files.json_state(spark, out, "page long, status string, base string, detail string")


def versioned_rows(spark, sf_dir):
    """[SNK-6, SNK-12, STM-8, STM-17] Old and new rows of (source, route), upserted into buckets, compacted, and read as they are and as they were."""
    old = items(spark, sf_dir).groupBy("source_key").agg(F.max("id").alias("id")).select("source_key", F.lit("click").alias("route"), "id", F.lit("old").alias("v"))
    new = items(spark, sf_dir).where("route <> 'view'").select("source_key", "route", "id", F.lit("new").alias("v"))
    t = VersionedTable(spark, place(spark, "versions"), ["source_key", "route"], old.schema, 8)
    first = t.upsert(old)
    t.upsert(new, "id")
    t.compact(2)
    return t.read().withColumn("at", F.lit("now")).unionByName(t.read(first).withColumn("at", F.lit("before")))


def audit_digests(spark, sf_dir):
    """[JN-4, STM-21] Orders against their lines: numbers of lines as the id says against those that there are; digests say which to compare."""
    want = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), (F.col("o_orderkey") % 7).alias("n"))
    have = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.count("*").alias("n"))
    return audit.reconcile(want.where("n > 0"), have, ["order_id"], ["n"])


def provider_calls(spark, sf_dir):
    """[UDF-3, UDF-5] Every title sent to a client of its task; some fail for good, some at first."""

    def connect():
        met = set()

        def client(title):
            if "the" in title:
                raise ValueError("malformed")
            if title not in met:
                met.add(title)
                raise TimeoutError("503")
            met.discard(title)
            return title[:9].upper() if title.isascii() else ""

        return client

    got = providers.called(connect, providers.Policy(base=0.0))("title")
    return docs(spark, sf_dir).select("doc_id", got.alias("c")).select("doc_id", "c.*")


def stream_discovery(spark, sf_dir):
    """[STM-1, STM-2, STM-3, STM-5] Discovery over the stream of events: the two newest of each source at every midnight."""
    schema = read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = place(spark, "discovered")
    found = streams.discover(streams.timed(stream, None), 2, 2).select("source_key", "id", "route", F.date_format("poll", "yyyy-MM-dd").alias("poll"), "rank")
    q = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


QUERIES = {f.__name__: f for f in (generic_titles, empty_raws, listed_paths, retryable_errors, full_width_titles, payload_notes, resolved_urls, scoped_items, vault_folders, staged_raws, logged_progress, versioned_rows, audit_digests, provider_calls, stream_discovery)}

_T = "split_part(text, chr(10), 1)"
_NL = "chr(10)"
_KEY = "case when regexp_extract(url, '(?:v=|youtu\\.be/|/shorts/)([A-Za-z0-9_-]{11})', 1) <> '' then regexp_extract(url, '(?:v=|youtu\\.be/|/shorts/)([A-Za-z0-9_-]{11})', 1) when regexp_extract(url, '(BV[0-9A-Za-z]{10})', 1) <> '' then regexp_extract(url, '(BV[0-9A-Za-z]{10})', 1) else substr(regexp_replace(regexp_replace(url, '^https?://', ''), '[^A-Za-z0-9]+', '-', 'g'), 1, 64) end"
_CLOCK = "(case when s >= 3600 then lpad((s // 3600)::varchar, 2, '0') || ':' else '' end || lpad((s % 3600 // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0'))"
_OLD = "select user_id source_key, 'click' route, max(event_id) id, 'old' v from events group by 1"
_NEW = "select user_id source_key, event_type route, max(event_id) id, 'new' v from events where event_type <> 'view' group by 1, 2"
SQL = {
    "generic_titles": f"select doc_id, t title from (select doc_id, {_T} t from documents) where trim(t) = '' or regexp_matches(trim(t), '(?i)^(hello|hi|good (morning|evening))\\b') or length(trim(t)) <= 6 and not regexp_matches(trim(t), '[一-鿿]{{4}}')",
    "empty_raws": f"select doc_id, length(text) n from (select *, case when contains(text, {_NL} || '---' || {_NL}) then substr(text, strpos(text, {_NL} || '---' || {_NL}) + 5) else text end body from documents) where length(trim(split_part(body, 'Licensed under', 1))) < 400",
    "listed_paths": "select page_id, path from (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') path from pages) where not list_has_any(string_split(path, '/'), ['en', 'archive']) and not starts_with(string_split(path, '/')[-1], '1') and not starts_with(string_split(path, '/')[-1], '_')",
    "retryable_errors": "select event_id, 'HTTP ' || (floor(value)::bigint % 110 + 400) message from events where floor(value)::bigint % 110 + 400 in (429, 502, 503)",
    "full_width_titles": f"select doc_id, translate({_T} || ' a/b: \"c\" <d>|*?', '/:*?\"<>|', '／：＊？＂＜＞｜') title from documents",
    "payload_notes": f"""select doc_id, md5(note) h, length(note) n from (select doc_id, '# ' || {_T} || {_NL} || 'Link: ' || source || {_NL} || '## Description' || {_NL} || substr(text, 1, 2000) || {_NL} || '## Chapters' || {_NL} || '- ' || {_CLOCK} || ' ' || lang || {_NL} || '## Text' || {_NL} || lang note
        from (select *, doc_id % 7000 s from documents))""",
    "resolved_urls": f"with u as (select page_id, {_KEY} as key from pages) select page_id, c.cached from u left join (select key, min(page_id) cached from u where page_id % 3 = 0 group by 1) c using (key)",
    "scoped_items": "select user_id source_key, count(*) n from events where user_id in (1, 2, 3, 5, 8, 13) group by 1",
    "vault_folders": "select case when doc_id % 3 = 0 then lang || '/x' else 'inbox' end folder, count(*) n, sum(doc_id)::bigint ids from documents group by 1",
    "staged_raws": f"select doc_id, md5('# ' || {_T} || {_NL} || 'Link: ' || source || {_NL} || '---' || {_NL} || text) h from documents",
    "logged_progress": "select doc_id page, case when length(text) > 500 then 'OK' else 'FAIL' end status, lang base, source detail from documents",
    "versioned_rows": f"with n as ({_NEW}), o as ({_OLD}) select *, 'now' as at from n union all select *, 'now' from o where not exists (select 1 from n where n.source_key = o.source_key and n.route = o.route) union all select *, 'before' from o",
    "audit_digests": """with w as (select o_orderkey k, o_orderkey % 7 n from orders where o_orderkey % 7 > 0), h as (select l_orderkey k, count(*) n from lineitem group by 1)
        select coalesce(w.k, h.k) order_id, case when h.k is null then 'missing' when w.k is null then 'orphan' else 'changed' end side from w full join h on w.k = h.k where w.n is distinct from h.n""",
    "provider_calls": f"""select doc_id, case when trim(t) = '' or contains(t, 'the') then null when regexp_matches(t, '^[\\x00-\\x7F]*$') then upper(substr(t, 1, 9)) else '' end as value,
        case when trim(t) <> '' and contains(t, 'the') then 'ValueError: malformed' end error, case when trim(t) = '' then 0 when contains(t, 'the') then 1 else 2 end attempts from (select doc_id, {_T} t from documents)""",
    "stream_discovery": """select user_id source_key, event_id id, event_type route, strftime(poll, '%Y-%m-%d') poll, r::int as rank
        from (select *, date_trunc('day', ts) + interval 1 day poll, row_number() over (partition by user_id, date_trunc('day', ts) order by epoch_ms(ts) desc, event_id desc) r from events)
        where r <= 2 and poll <= (select max(ts) from events)""",
}
