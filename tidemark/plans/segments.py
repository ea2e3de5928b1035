"""Queries over timed segments: a conversation is a medium, a turn a segment of a minute; and over markup of transcripts and posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import segments as S
from ..operators import summarize
from .common import read, sql_chunks, sql_summary


def timed(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media_id"), F.col("turn").alias("seq"), (F.col("turn") * 60.0).alias("start"), F.lit(60.0).alias("duration"), "text")


def segments_to_text(spark, sf_dir):
    return S.joined(timed(spark, sf_dir)).select("media_id", F.length("text").alias("n"), F.md5("text").alias("h"))


def segments_windows(spark, sf_dir):
    g = S.greedy_windows(timed(spark, sf_dir), 120.0)
    return g.select("media_id", "group", "start", "end", F.md5("text").alias("h"), T.clock("start").alias("clock"))


def segments_chunk(spark, sf_dir):
    g = S.segment_chunks(timed(spark, sf_dir), 120.0, 900)
    return g.select("media_id", "group", "chunk", "start", "end", F.length("text").alias("n"), F.md5("text").alias("h"))


def segments_clean(spark, sf_dir):
    g = S.clean_segments(timed(spark, sf_dir))
    return g.select("media_id", "seq", "start", "duration", F.md5("text").alias("h"))


def segments_summary(spark, sf_dir):
    return summarize.two_stage(S.segment_chunks(timed(spark, sf_dir), 120.0, 900), summarize.extractive(80))


def vtt_cues(spark, sf_dir):
    cue = F.concat(F.lit("1\n00:0"), F.col("turn").cast("string"), F.lit(":01.500 --> 00:0"), F.col("turn").cast("string"), F.lit(":04.000\n"), "role", F.lit("\nsays"))
    vtt = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", cue.alias("cue")))).alias("c"))
    vtt = vtt.select("conv_id", F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("c", lambda x: x["cue"]), "\n\n")).alias("vtt"))
    return vtt.select("conv_id", F.posexplode(T.parse_vtt("vtt")).alias("k", "c")).select("conv_id", "k", F.col("c.start").alias("start"), F.col("c.duration").alias("duration"), F.col("c.text").alias("text"))


def timed_text(spark, sf_dir):
    xml = F.concat(F.lit('<transcript><text start="0">'), "role", F.lit("&amp;amp;</text><text start='1'>b</text></transcript>"))
    j = F.concat(F.lit('{"events":[{"segs":[{"utf8":"'), "role", F.lit('"},{"utf8":"!"}]},{}]}'))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.timed_text(xml).alias("xml"), T.timed_text(j).alias("json"))


def short_posts(spark, sf_dir):
    """[SRC-8, JSN-1, FLT-8] Nested posts as JSON: id, time, and the first text there is; posts of other kinds and without text go."""
    kind = "struct<id_str:string,id:string,type:string,modules:struct<module_author:struct<name:string,pub_ts:string>,module_dynamic:struct<desc:struct<text:string>,major:struct<opus:struct<title:string,summary:struct<text:string>>,archive:struct<title:string>>>>>"
    body = F.when(F.col("turn") % 3 == 0, F.struct(F.struct(F.col("role").alias("text")).alias("desc"))).cast("struct<desc:struct<text:string>>")
    raw = F.to_json(F.struct(
        F.when(F.col("turn") % 2 == 0, F.lit("")).otherwise(F.col("conv_id").cast("string")).alias("id_str"), F.col("turn").cast("string").alias("id"), F.when(F.col("turn") == 5, "video").otherwise("post").alias("type"),
        F.struct(F.struct(F.lit("a").alias("name"), F.when(F.col("turn") == 1, "x").otherwise("1700000000").alias("pub_ts")).alias("module_author"),
                 F.struct(body["desc"].alias("desc"), F.struct(F.when(F.col("turn") % 3 == 1, F.struct(F.lit("t").alias("title"), F.struct(F.col("role").alias("text")).alias("summary"))).alias("opus")).alias("major")).alias("module_dynamic")).alias("modules"),
    ))
    return flatten_posts(read(spark, sf_dir, "conversations").select("conv_id", "turn", F.from_json(raw, kind).alias("post")))


def flatten_posts(posts):
    d = F.col("post.modules.module_dynamic")
    opus = F.concat_ws("\n", F.nullif(d["major"]["opus"]["title"], F.lit("")), F.nullif(d["major"]["opus"]["summary"]["text"], F.lit("")))
    text = T.first_filled(F.trim(d["desc"]["text"]), opus, F.trim(d["major"]["archive"]["title"]))
    out = posts.select("conv_id", "turn", T.first_filled("post.id_str", "post.id").alias("id"), F.col("post.type").alias("type"), F.coalesce(F.col("post.modules.module_author.pub_ts").try_cast("long"), F.lit(0)).alias("ts"), text.alias("text"))
    return out.where("type <> 'video' and text <> ''").drop("type")


def track_choice(spark, sf_dir):
    """[SRC-11, SRC-16] The subtitle track of the best language; texts from the first source that has one."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(F.lit("assistant"), F.lit("user")), F.col("role")), F.lit(0)), F.lit(99))
    t = read(spark, sf_dir, "conversations")
    return t.groupBy("conv_id").agg(F.min_by("role", F.struct(rank, "turn")).alias("track"), F.min_by("turn", F.struct(rank, "turn")).alias("turn"))


def frame_times(spark, sf_dir):
    t = read(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.count("*") * 60.0).alias("duration"))
    return t.select("conv_id", F.posexplode(T.sample_times("duration", 4)).alias("k", "t"), T.timeout_seconds("duration").alias("timeout"), T.backoff_seconds(2.0, 2.0, F.lit(3)).alias("backoff"))


def usage_totals(spark, sf_dir):
    u = T.token_usage(F.length("text"), F.col("turn"), F.when(F.col("turn") % 2 == 0, F.lit(0)))
    return read(spark, sf_dir, "conversations").select("role", u.alias("u")).groupBy("role").agg(F.sum("u.prompt_tokens").alias("prompt"), F.sum("u.completion_tokens").alias("completion"), F.sum("u.total_tokens").alias("total"))


def track_bodies(spark, sf_dir):
    """A body of two entries for each conversation's turn; the second has no end."""
    entry = lambda k, end: F.struct((F.col("turn") * 10 + k).cast("double").alias("from"), end.alias("to"), F.concat(F.lit(" "), "role").alias("content"))
    body = F.to_json(F.struct(F.array(entry(0, F.col("turn") * 10 + 1.5), entry(2, F.lit(None).cast("double"))).alias("body")))
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.track_segments(body)).alias("k", "s"))
    return t.select("conv_id", "turn", "k", "s.start", "s.duration", "s.text")


QUERIES = {f.__name__: f for f in (track_bodies, segments_to_text, segments_windows, segments_chunk, segments_clean, segments_summary, vtt_cues, timed_text, short_posts, track_choice, frame_times, usage_totals)}

_W = """(with recursive s as (select conv_id media_id, turn seq, turn * 60.0::double start, text, row_number() over (partition by conv_id order by turn) k from conversations),
    f as (select media_id, seq, k, start, start anchor, 0 grp, text from s where k = 1
        union all select s.media_id, s.seq, s.k, s.start, case when s.start - f.anchor > 120 then s.start else f.anchor end, case when s.start - f.anchor > 120 then f.grp + 1 else f.grp end, s.text from f join s on s.media_id = f.media_id and s.k = f.k + 1)
    select media_id, grp as group, min(start) start, max(start) + 60 as end, coalesce(string_agg(trim(text), chr(10) order by seq) filter (trim(text) <> ''), '') text from f group by 1, 2)"""
_W = _W.replace("grp as group", 'grp as "group"').replace("60 as end", '60 as "end"')
# groups of the windows, keyed as one column, and their chunks: long ones are cut
_G = f"""(select row_number() over (order by media_id, "group") g, * from {_W})"""
_C = f"""(select media_id, "group", 0 chunk, start, "end", text from {_W} where length(text) <= 900 union all
    select media_id, "group", c.chunk, start, "end", c.text from {_G} w join {sql_chunks(f"(select g, text from {_G} where length(text) > 900)", "g", 900, 200)} c on w.g = c.g)"""
SQL = {
    "segments_chunk": f"""select media_id, "group", chunk, start, "end", length(text) n, md5(text) h from {_C}""",
    "segments_summary": f"""select media_id, count(*)::int n_chunks, case when count({sql_summary(80)}) = count(*) then string_agg({sql_summary(80)}, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by "group", chunk) end summary from {_C} group by 1""",
    "track_bodies": "select conv_id, turn, k::int k, (turn * 10 + 2 * k)::double start, case k when 0 then 1.5 else 3.0 end::double duration, role as text from conversations, (select unnest([0, 1]) k)",
    "segments_to_text": "select media_id, length(text) n, md5(text) h from (select conv_id media_id, coalesce(string_agg(trim(text), chr(10) order by turn) filter (trim(text) <> ''), '') text from conversations group by 1)",
    "segments_windows": f"""select media_id, "group", start, "end", md5(text) h, lpad((start // 60)::int::varchar, 2, '0') || ':' || lpad((start % 60)::int::varchar, 2, '0') clock from {_W}""",
    "vtt_cues": "select conv_id, (row_number() over (partition by conv_id order by turn) - 1)::int k, turn * 60 + 1.5::double start, 2.5::double duration, role || ' says' text from conversations",
    "timed_text": "select conv_id, turn, role || '&' || chr(10) || 'b' xml, role || '!' json from conversations",
    "short_posts": "select conv_id, turn, case when turn % 2 = 0 then turn::varchar else conv_id::varchar end id, case when turn = 1 then 0 else 1700000000 end::bigint ts, case when turn % 3 = 0 then role else 't' || chr(10) || role end text from conversations where turn <> 5 and turn % 3 < 2",
    "track_choice": "select conv_id, (list(role order by case role when 'assistant' then 1 when 'user' then 2 else 99 end, turn))[1] track, (list(turn order by case role when 'assistant' then 1 when 'user' then 2 else 99 end, turn))[1] turn from conversations group by 1",
    "frame_times": "select conv_id, k::int k, d * (k + 0.5) / 4 t, d * 3 + 600 timeout, 16.0::double backoff from (select conv_id, count(*) * 60.0::double d, unnest([0, 1, 2, 3]) k from conversations group by 1)",
    "usage_totals": "select role, sum(length(text))::bigint prompt, sum(turn)::bigint completion, sum(length(text) + turn)::bigint total from conversations group by 1",
}
