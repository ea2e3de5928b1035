"""Scalar text, name and time functions as Column expressions (ids of the coverage list in brackets)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_filled(*cols, default: str = "") -> Column:
    """[PRJ-4] The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cols], F.lit(default))


def contains_any(c, terms) -> Column:
    """[FLT-1, JN-11] Whether any term of a short list occurs; an empty list never matches. ``automaton.lexicon_hits`` takes long lists, and several at once."""
    return reduce(lambda a, b: a | b, [col(c).contains(t) for t in terms], F.lit(False))


def normalize_url(c) -> Column:
    """[STR-1, SO-2] Lower-case scheme and authority, no trailing slashes in the path, sorted query, no fragment."""
    c = F.trim(col(c))
    part = lambda g: F.regexp_extract(c, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", g)
    query = F.array_join(F.array_sort(F.split(part(4), "&")), "&")
    return F.concat(
        F.when(part(1) != "", F.concat(F.lower(part(1)), F.lit(":"))).otherwise(""),
        F.when(part(2) != "", F.concat(F.lit("//"), F.lower(part(2)))).otherwise(""),
        F.regexp_replace(part(3), "/+$", ""),
        F.when(part(4) != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def hash16(c) -> Column:
    """[STR-2]"""
    return F.substring(F.sha2(F.trim(col(c)), 256), 1, 16)


def dedup_key(url, content) -> Column:
    """[STR-3] Hash of the normalised url if there is one, else of the content, else null."""
    return F.when(F.trim(col(url)) != "", hash16(normalize_url(url))).when(F.trim(col(content)) != "", hash16(content))


def safe_filename(c, cap: int = 50, fold_space: bool = False) -> Column:
    """[STR-4] Characters that file systems refuse become ``_``."""
    out = F.regexp_replace(F.trim(col(c)), r'[\\/:*?"<>|\r\n\t]', "_")
    return F.substring(F.regexp_replace(out, " +", " ") if fold_space else out, 1, cap)


def safe_folder(c) -> Column:
    """[STR-5] Segments cleaned one by one; empty ones, ``.`` and ``..`` go."""
    parts = F.transform(F.split(F.replace(col(c), F.lit("\\"), F.lit("/")), "/"), lambda p: F.trim(F.regexp_replace(p, r'[:*?"<>|]', "_")))
    return F.array_join(F.filter(parts, lambda p: ~p.isin("", ".", "..")), "/")


def full_width_title(c) -> Column:
    """[STR-6] Eight characters become their full-width forms."""
    return F.translate(col(c), '\\/:*?"<>|'.replace("\\", "", 1), "\uff0f\uff1a\uff0a\uff1f\uff02\uff1c\uff1e\uff5c")


def file_name(title, category, day) -> Column:
    """[STR-7] ``[category]title-YYYYMMDD.md``, titles shorter than two characters become ``unnamed``."""
    t = safe_filename(title)
    return F.concat(F.when(col(category) != "", F.concat(F.lit("["), col(category), F.lit("]"))).otherwise(""), F.when(F.length(t) < 2, "unnamed").otherwise(t), F.lit("-"), F.date_format(col(day), "yyyyMMdd"), F.lit(".md"))


def folder_path(category, name, default: str = "inbox") -> Column:
    """[PRJ-3]"""
    return F.concat(first_filled(category, default=default), F.when(first_filled(name) != "", F.concat(F.lit("/"), col(name))).otherwise(""))


def normal_text(c) -> Column:
    """[STR-8] Without white space and punctuation."""
    return F.regexp_replace(col(c), r"[ \t\r\n\x0b\x0c,.!?;:'()\[\]\u3000-\u3002\uff0c\uff01\uff1f\uff1b\uff1a\u2026\u2014\u201c\u201d]", "")


def strip_fillers(c, fillers=DEFAULT.fillers) -> Column:
    """[STR-10] Leading interjections go if punctuation follows, again and again; a text of one alone becomes empty."""
    words = "|".join(sorted(fillers, key=len, reverse=True))
    text = F.trim(col(c))
    return F.when(text.rlike(f"^(?:{words})$"), "").otherwise(F.regexp_replace(text, f"^(?:(?:{words})[,.!?][,.!? ]*)+", ""))


def sentences(c) -> Column:
    """[STR-11] Pieces that end in a sentence mark (full stops of Latin script are none) or with the text."""
    return F.regexp_extract_all(col(c), F.lit("([^\u3002\uff01\uff1f!?;\uff1b]+[\u3002\uff01\uff1f!?;\uff1b]?|[\u3002\uff01\uff1f!?;\uff1b])"), F.lit(1))


def strip_markdown(c) -> Column:
    """[STR-12]"""
    out = F.regexp_replace(col(c), r"!\[[^\]]*\]\([^)]*\)", "")
    return F.regexp_replace(F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1"), "[#>*_`-]", "")


def first_heading(c, strict: bool = True) -> Column:
    """[STR-13] Text of the first ``# `` line, or with ``strict`` off of the first line of any heading level."""
    return F.trim(F.regexp_extract(col(c), r"(?m)^[ \t]*# (.+)$" if strict else r"(?m)^[ \t]*#+[ \t]*([^#\s].*)$", 1))


def one_liner(c, label: str) -> Column:
    """[STR-14] What follows a bold label on its line, or the first line below a heading of that name."""
    inline = F.trim(F.regexp_extract(col(c), rf"(?m)^\s*\**{label}\**\s*[:\uff1a]\**\s*(.+)$", 1))
    below = F.trim(F.regexp_extract(col(c), rf"(?m)^#+ *{label} *\n+([^\n#].*)$", 1))
    return first_filled(inline, below)


def lines(c) -> Column:
    return F.split(col(c), "\n")


def title_of_text(c, label: str = "Title", default: str = "untitled") -> Column:
    """[STR-15] A labelled line among the first ten, a second-level heading among the first twenty, the first short plain line, or the default."""
    ls = F.transform(lines(c), lambda t: F.trim(t))
    labelled = F.filter(F.slice(ls, 1, 10), lambda x: x.startswith(label + ":"))
    headed = F.filter(F.slice(ls, 1, 20), lambda x: x.startswith("## "))
    plain = F.filter(ls, lambda x: (F.length(x) > 0) & (F.length(x) < 100) & ~x.startswith("#"))
    return F.substring(first_filled(F.trim(F.substring(F.get(labelled, F.lit(0)), len(label) + 2, 1000)), F.substring(F.get(headed, F.lit(0)), 4, 1000), F.get(plain, F.lit(0)), default=default), 1, 50)


def title_of_summary(c) -> Column:
    """[STR-16] The last line above the author line that is neither empty nor a line of tags."""
    ls = F.transform(lines(c), lambda t: F.trim(t))
    author = F.array_position(F.transform(ls, lambda x: x.startswith("Author:")), True)
    above = F.filter(F.slice(ls, F.lit(1), F.greatest(author - 1, F.lit(0)).cast("int")), lambda x: (x != "") & ~x.startswith("#"))
    return F.coalesce(F.try_element_at(above, F.lit(-1)), F.lit(""))


def generic_title(c) -> Column:
    """[FLT-15] Empty, a greeting, or at most six characters without four Han characters in a row."""
    t = F.trim(F.coalesce(col(c), F.lit("")))
    return (t == "") | t.rlike(r"(?i)^(hello|hi|good (morning|evening))\b") | ((F.length(t) <= 6) & ~t.rlike("[\u4e00-\u9fff]{4}"))


def title_of_body(title, body) -> Column:
    """[STR-17] A generic title gives way to the first line of the body after ``---``, cut at a sentence end and at 36 characters."""
    after = F.when(col(body).contains("\n---\n"), F.element_at(F.split(col(body), "\n---\n", 2), -1)).otherwise(col(body))
    line = F.coalesce(F.get(F.filter(F.transform(lines(after), lambda t: F.trim(t)), lambda x: (x != "") & ~x.startswith("#")), F.lit(0)), F.lit(""))
    cut = F.regexp_extract(line, "^[^\u3002\uff01\uff1f!?]*", 0)
    short = F.when(F.length(cut) > 36, F.concat(F.regexp_replace(F.substring(cut, 1, 36), "[\uff0c,\u3001\uff1b; ]+$", ""), F.lit("\u2026"))).otherwise(cut)
    return F.when(generic_title(title) & (short != ""), short).otherwise(col(title))


def episode_name(page, part, kind: str = "raw") -> Column:
    """[STR-19] ``epNN_part_raw.md`` or ``epNN_part.body.md``; three digits where needed."""
    number = F.when(col(page) < 100, F.lpad(col(page).cast("string"), 2, "0")).otherwise(col(page).cast("string"))
    return F.concat(F.lit("ep"), number, F.lit("_"), col(part), F.lit(".body.md" if kind == "body" else f"_{kind}.md" if kind else ".md"))


def parse_episode_name(c) -> Column:
    """[STR-19, FLT-20] (page, part, kind) of a name; body names are told first, other names give nulls."""
    rx = r"^ep(\d+)_(.*?)(\.body|_raw|_body)?\.md$"
    g = lambda i: F.regexp_extract(col(c), rx, i)
    kind = F.when(g(3) == ".body", "body").when(g(3) == "_raw", "raw").when(g(3) == "_body", "stray").otherwise("note")
    return F.when(col(c).rlike(rx), F.struct(g(1).cast("int").alias("page"), g(2).alias("part"), kind.alias("kind")))


def table_cell(c) -> Column:
    """[STR-20]"""
    return F.replace(col(c), F.lit("|"), F.lit("/"))


def clock(c, always_hours: bool = False) -> Column:
    """[STR-21] Seconds as ``mm:ss``, or ``hh:mm:ss`` from one hour on."""
    s = F.floor(col(c)).cast("int")
    h, m, x = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60
    long, short = F.format_string("%02d:%02d:%02d", h, m, x), F.format_string("%02d:%02d", m, x)
    return long if always_hours else F.when(h > 0, long).otherwise(short)


def video_id(c) -> Column:
    """[STR-22]"""
    return first_filled(F.regexp_extract(col(c), r"(?:v=|youtu\.be/|/shorts/)([A-Za-z0-9_-]{11})", 1), F.regexp_extract(col(c), r"(BV[0-9A-Za-z]{10})", 1))


def transcript_key(c) -> Column:
    """[STR-23] A video id, else a slug of the url, else a hash."""
    slug = F.substring(F.regexp_replace(F.regexp_replace(col(c), "^https?://", ""), "[^A-Za-z0-9]+", "-"), 1, 64)
    return first_filled(video_id(c), F.when(col(c).rlike("^https?://"), slug), F.substring(F.md5(col(c)), 1, 16))


def sink_key(c) -> Column:
    """[STR-24] A path without ``.md`` whose last segment is made safe."""
    parts = F.split(F.regexp_replace(col(c), r"\.md$", ""), "/")
    last = full_width_title(F.replace(F.element_at(parts, -1), F.lit("&"), F.lit("_")))
    return F.array_join(F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(last)), "/")


def split_path(c) -> Column:
    """[STR-25] (folders, base)."""
    parts = F.split(col(c), "/")
    return F.struct(F.slice(parts, F.lit(1), F.size(parts) - 1).alias("folders"), F.element_at(parts, -1).alias("base"))


def freshness(ts, now: str) -> Column:
    """[DT-1] ``now`` is a parameter."""
    days = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(col(ts).cast("timestamp"))) / 86400
    return F.when(col(ts).isNull(), "").when(days < 1, "fresh").when(days < 7, "recent").otherwise("archive")


def effective_window(last_check, now: str, daily: int = 1, cap: int = 30) -> Column:
    """[DT-2, STM-4] Days to look back: the daily window, widened to the gap since the last check plus one, but not over the cap."""
    gap = F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(col(last_check).cast("timestamp"))) / 86400)
    return F.when(col(last_check).isNull(), daily).otherwise(F.least(F.greatest(F.lit(daily), gap + 1), F.lit(cap))).cast("int")


def parse_since(c) -> Column:
    """[DT-3] Epoch seconds, or a day as Y-m-d or Y/m/d; null if neither."""
    c = F.trim(col(c))
    return F.coalesce(F.when(c.rlike(r"^\d+$"), F.timestamp_seconds(c.try_cast("long"))), F.try_to_timestamp(c, F.lit("yyyy-M-d")), F.try_to_timestamp(c, F.lit("yyyy/M/d")))


def day_start(ts, zone: str = "+08:00") -> Column:
    """[DT-4] Midnight of the day in a zone, as an instant."""
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(col(ts), zone)), zone)


def cue_seconds(c) -> Column:
    """[DT-5] ``hh:mm:ss.mmm`` in seconds."""
    p = F.split(F.trim(col(c)), ":")
    n = lambda i: F.get(p, F.lit(i)).try_cast("double")
    return n(0) * 3600 + n(1) * 60 + n(2)


def timeout_seconds(duration) -> Column:
    """[DT-7]"""
    return F.coalesce(col(duration) * 3 + 600, F.lit(10800.0))


def backoff_seconds(base: float, factor: float, attempt) -> Column:
    """[DT-8]"""
    return F.lit(base) * F.pow(F.lit(factor), col(attempt))


def default_tags(note_type, title, content, lex=DEFAULT) -> Column:
    """[TAG-1, TAG-2] The type's label and every term contained in title or content, once each, in order."""
    labels = F.create_map(*[F.lit(x) for kv in lex.type_labels.items() for x in kv])
    text = F.concat(col(title), F.lit("\n"), col(content))
    label = F.array(F.coalesce(F.element_at(labels, col(note_type)), F.lit(lex.type_labels["structured"])))
    return F.array_distinct(F.concat(label, F.array_compact(F.array(*[F.when(text.contains(t), F.lit(t)) for t in lex.tag_terms]))))


def saved_tags(tags, url, fresh) -> Column:
    """[TAG-4] A repost tag if there is a url, and the freshness label last."""
    return F.array_distinct(F.concat(col(tags), F.array_compact(F.array(F.when(first_filled(url) != "", F.lit("repost")), F.nullif(col(fresh), F.lit(""))))))


def category(tags, lex=DEFAULT) -> Column:
    """[TAG-3] The first tag that is no system tag, else empty."""
    own = F.filter(col(tags), lambda t: ~t.isin(*lex.system_tags, *lex.type_labels.values()))
    return F.coalesce(F.get(own, F.lit(0)), F.lit(""))


def tag_line(c) -> Column:
    """[JSN-9] Lines ``Tags: a, b`` become ``#a #b``; lines that hold only separators go."""
    def norm(line):
        rest = F.regexp_replace(line, r"^\s*\**[Tt]ags?\**\s*[:\uff1a]", "")
        tags = F.array_distinct(F.filter(F.transform(F.split(rest, "[,\uff0c\u3001 \u00b7/\uff5c|]+"), lambda t: F.regexp_replace(F.trim(t), "^#+", "")), lambda t: t != ""))
        return F.when(line.rlike(r"^\s*\**[Tt]ags?\**\s*[:\uff1a]"), F.when(F.size(tags) > 0, F.concat(F.lit("#"), F.array_join(tags, " #")))).otherwise(line)

    return F.array_join(F.filter(F.transform(lines(c), norm), lambda x: x.isNotNull()), "\n")


def frontmatter(meta, nested: str | None = None, nested_col=None) -> Column:
    """[JSN-8] A YAML head of a string map (sorted by key, null as empty), and one nested level."""
    entries = F.transform(F.array_sort(F.map_entries(col(meta))), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    parts = [F.lit("---"), F.array_join(entries, "\n")]
    if nested:
        inner = F.transform(F.array_sort(F.map_entries(col(nested_col))), lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
        parts += [F.lit(f"{nested}:"), F.array_join(inner, "\n")]
    return F.concat_ws("\n", *parts, F.lit("---"))


def note(title, tags, author, url, published, body) -> Column:
    """[JSN-10] Title, tag line, author and link, optional date, body."""
    return F.concat_ws("\n", F.concat(F.lit("# "), col(title)), F.when(F.size(col(tags)) > 0, F.concat(F.lit("#"), F.array_join(col(tags), " #"))), F.concat(F.lit("Author: "), col(author), F.lit(" | "), col(url)), F.concat(F.lit("Published: "), F.date_format(col(published), "yyyy-MM-dd HH:mm")), F.lit(""), col(body))


def gate(c, threshold: int = 85) -> Column:
    """[JSN-2] Score, verdict and issues of a review: from the JSON in it, else from a line ``score: n``; empty reviews score 0."""
    kind = "struct<score:double,pass:boolean,issues:array<string>>"
    j = F.from_json(F.regexp_extract(col(c), r"(?s)\{.*\}", 0), kind)
    said = F.regexp_extract(col(c), r"(?i)score\D{0,3}(\d+)", 1).try_cast("double")
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(j["score"], said, F.lit(0.0))))
    issues = F.filter(F.coalesce(j["issues"], F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    empty = F.trim(F.coalesce(col(c), F.lit(""))) == ""
    return F.struct(score.alias("score"), F.when(empty, False).otherwise(F.coalesce(j["pass"], score >= threshold)).alias("passed"), F.when(empty, F.array(F.lit("empty review"))).otherwise(issues).alias("issues"))


def token_usage(prompt, completion, total) -> Column:
    """[AG-13]"""
    p, c = F.coalesce(col(prompt), F.lit(0)), F.coalesce(col(completion), F.lit(0))
    return F.struct(p.alias("prompt_tokens"), c.alias("completion_tokens"), F.coalesce(F.nullif(col(total), F.lit(0)), p + c).alias("total_tokens"))


def parse_vtt(c) -> Column:
    """[SRC-18, JSN-3] Cues of a WebVTT text: array of (start, duration, text)."""
    blocks = F.split(F.replace(col(c), F.lit("\r"), F.lit("")), r"\n[ \t]*\n")

    def cue(block):
        ls = F.filter(F.split(block, "\n"), lambda x: ~F.trim(x).rlike(r"^(\d+|WEBVTT.*|)$"))
        at = F.get(ls, F.lit(0))
        rx = r"^\s*(\d+:\d\d:\d\d\.\d+)\s*-->\s*(\d+:\d\d:\d\d\.\d+)"
        a, b = cue_seconds(F.regexp_extract(at, rx, 1)), cue_seconds(F.regexp_extract(at, rx, 2))
        text = F.trim(F.array_join(F.transform(F.slice(ls, F.lit(2), F.greatest(F.size(ls) - 1, F.lit(0))), lambda t: F.trim(t)), " "))
        return F.when(at.rlike(rx), F.struct(a.alias("start"), F.greatest(F.lit(0.0), b - a).alias("duration"), text.alias("text")))

    return F.filter(F.transform(blocks, cue), lambda x: x.isNotNull() & (x["text"] != ""))


def unescape(c) -> Column:
    out = col(c)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def timed_text(c) -> Column:
    """[SRC-19, JSN-4] Text of json3 events, or of the <text> elements of an XML transcript."""
    j = F.from_json(col(c), "struct<events:array<struct<segs:array<struct<utf8:string>>>>>")
    said = F.array_join(F.transform(F.filter(j["events"], lambda e: e["segs"].isNotNull()), lambda e: F.array_join(F.transform(e["segs"], lambda s: s["utf8"]), "")), "")
    xml = F.array_join(F.transform(F.regexp_extract_all(col(c), F.lit("(?s)<text[^>]*>(.*?)</text>"), F.lit(1)), lambda t: unescape(unescape(t))), "\n")
    return F.when(F.ltrim(col(c)).startswith("{"), F.coalesce(said, F.lit(""))).otherwise(xml)


def sample_times(duration, n: int) -> Column:
    """[SRC-20] n evenly spaced times."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: col(duration) * (i + 0.5) / n)


def track_segments(body, gap: float = 3.0) -> Column:
    """[SRC-10] Segments (start, duration, text) of a subtitle body as JSON; an entry without end lasts ``gap`` seconds."""
    b = F.from_json(col(body), "struct<body:array<struct<`from`:double,`to`:double,content:string>>>")["body"]
    full = F.filter(F.coalesce(b, F.array().cast("array<struct<`from`:double,`to`:double,content:string>>")), lambda x: F.trim(x["content"]) != "")
    begin = lambda x: F.coalesce(x["from"], F.lit(0.0))
    return F.transform(full, lambda x: F.struct(begin(x).alias("start"), (F.coalesce(x["to"], begin(x) + gap) - begin(x)).alias("duration"), F.trim(x["content"]).alias("text")))


def shares_any(a, b) -> Column:
    """[ST-4] Whether two arrays have an element in common; a null array or only null elements mean no."""
    keep = lambda c: F.filter(F.coalesce(col(c), F.array().cast("array<string>")), lambda x: x.isNotNull())
    return F.arrays_overlap(keep(a), keep(b))
