"""Queries over documents: dedup, filters, classification, tags, names, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from ..functions.automaton import lexicon_hits
from ..operators import classify, filters, segments, series
from .common import PROSE as L
from .common import read, sql_any, sql_chunks, sql_hits, sql_list, sql_occurrences, sql_summary

_T = "split_part(text, chr(10), 1)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.split("text", "\n")[0].alias("title"))


def dedup_documents(spark, sf_dir):
    return filters.dedup_content(read(spark, sf_dir, "documents").where(filters.long_enough("text")))


def dedup_content_groups(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", T.hash16("text").alias("hash16"))
    return d.groupBy("hash16").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("n > 1")


def dedup_known(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", T.dedup_key(F.lit(""), "text").alias("key"))
    index = d.where("doc_id % 10 = 0").groupBy("key").agg(F.min("doc_id").alias("t")).select(F.col("key").alias("hash16"), F.col("t").cast("string").alias("title"))
    return filters.known(d.where("doc_id % 10 <> 0"), index)


def min_length_gate(spark, sf_dir):
    return docs(spark, sf_dir).where(filters.long_enough("text")).select("doc_id", F.length(F.trim("text")).alias("n"))


def wall_filter(spark, sf_dir):
    return docs(spark, sf_dir).where(~filters.wall("text", L)).select("doc_id", "lang")


def ad_title_filter(spark, sf_dir):
    return docs(spark, sf_dir).where(filters.ad_title("title", L)).select("doc_id", "title")


def ad_full_filter(spark, sf_dir):
    told = docs(spark, sf_dir).select("doc_id", "title", "text", filters.ad_phrases("text", L).alias("hits"))
    return told.where(filters.ad_document("title", "text", L, "hits")).select("doc_id", F.length("text").alias("n"), "hits")


def ad_purify_lines(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", filters.purify("text", L, separator="\n").alias("clean"))
    return d.select("doc_id", F.length("clean").alias("n"), T.hash16("clean").alias("h"))


def substantive_filter(spark, sf_dir):
    return docs(spark, sf_dir).where(filters.substantive("text", L)).select("doc_id", F.length("text").alias("n"))


def length_band_counts(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang", filters.length_band("text").alias("band")).agg(F.count("*").alias("n"))


def classify_note_type(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", classify.note_type("title", "text", L).alias("note_type"))


def classify_counts_by_lang(spark, sf_dir):
    return classify_note_type_lang(spark, sf_dir).groupBy("lang", "note_type").agg(F.count("*").alias("n"))


def classify_note_type_lang(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "lang", classify.note_type("title", "text", L).alias("note_type"))


def template_lookup(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "interview").when(F.col("doc_id") % 3 == 1, "unheard").otherwise("case").alias("note_type"))
    return classify.with_template(d, classify.templates(spark))


def lexicon_occurrence_counts(spark, sf_dir):
    found = lexicon_hits("text", {"host": L.host_probes, "audience": L.audience_probes, "ads": L.ad_phrases})
    d = docs(spark, sf_dir).select("doc_id", found.alias("f"))
    return d.select("doc_id", F.col("f.host.total").alias("host"), F.col("f.audience.total").alias("audience"), F.col("f.ads.hits").alias("ad_hits"))


def interview_heuristic(spark, sf_dir):
    return docs(spark, sf_dir).where(classify.interview_like("title", "text", L)).select("doc_id", "lang")


def default_tags(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(T.default_tags(F.lit("case"), "title", "text", L), ",").alias("tags"))


def category_from_tags(spark, sf_dir):
    tags = T.saved_tags(F.concat(F.array(F.lit("Case"), F.lit("repost")), F.split("lang", "x")), F.col("source"), F.lit("fresh"))
    return docs(spark, sf_dir).select("doc_id", F.array_join(tags, ",").alias("tags"), T.category(tags).alias("category"))


def filename_generate(spark, sf_dir):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int"))
    return docs(spark, sf_dir).select("doc_id", T.file_name("title", "lang", day).alias("filename"), T.safe_filename("title", 30, True).alias("short"))


def filename_collisions(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.concat(T.safe_filename("title", 12), F.lit(".md")).alias("name"))
    return series.unique_names(d, "name", "doc_id")


def folder_sanitize(spark, sf_dir):
    raw = F.concat_ws("/", "lang", F.lit(".."), F.lit("a:b"), F.lit(""), F.col("source"))
    return docs(spark, sf_dir).select("doc_id", T.safe_folder(raw).alias("folder"), T.folder_path("lang", "source").alias("path"), T.sink_key(F.concat("lang", F.lit("/a&b?"), F.col("source"), F.lit(".md"))).alias("sink_key"))


def frontmatter_render(spark, sf_dir):
    meta = F.create_map(F.lit("title"), "title", F.lit("source_url"), "source", F.lit("published_at"), F.lit(None).cast("string"))
    d = docs(spark, sf_dir).select("doc_id", T.frontmatter(meta, "tokens", F.create_map(F.lit("total"), F.length("text").cast("string"))).alias("head"))
    return d.select("doc_id", F.md5("head").alias("h"), F.length("head").alias("n"))


def tag_line_normalize(spark, sf_dir):
    raw = F.concat(F.lit("Tags: "), "lang", F.lit(" · #"), "source", F.lit(" | "), "lang", F.lit("\nbody\ntags: , /"))
    return docs(spark, sf_dir).select("doc_id", T.tag_line(raw).alias("text"))


def note_header(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", T.note("title", F.array("lang", "source"), F.lit("a"), F.lit("u"), F.lit("2024-01-02 03:04:05").cast("timestamp"), F.length("text").cast("string")).alias("note"))
    return d.select("doc_id", F.md5("note").alias("h"))


def titles_from_text(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select("doc_id", T.title_of_text("text").alias("title"), T.title_of_body(F.lit("Hello"), "text").alias("body_title"), T.first_heading(F.concat(F.lit("x\n# "), "lang", F.lit("\n# y"))).alias("h1"))


def one_liners(spark, sf_dir):
    raw = F.concat(F.lit("# t\n**Summary**: "), "source", F.lit("\n## Point\n\n"), "lang", F.lit("\nrest"))
    return docs(spark, sf_dir).select("doc_id", T.one_liner(raw, "Summary").alias("inline"), T.one_liner(raw, "Point").alias("below"), T.title_of_summary(F.concat("title", F.lit("\n#a #b\nAuthor: x"))).alias("above"))


def sentence_lists(spark, sf_dir):
    s = T.sentences(F.replace("text", F.lit("."), F.lit(";")))
    return docs(spark, sf_dir).select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "|")).alias("h"))


def sentence_dedup(spark, sf_dir):
    return segments.dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", F.md5("text").alias("h"))


def normal_texts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.normal_text("title")).alias("h"), T.strip_fillers(F.concat(F.lit("well, um, "), "title")).alias("stripped"), T.strip_markdown(F.concat(F.lit("**"), "title", F.lit("** [a](b) ![c](d)"))).alias("plain"))


def text_chunks(spark, sf_dir):
    d = segments.chunk_text(read(spark, sf_dir, "documents").select("doc_id", "text"), most=1000, overlap=50)
    return d.select("doc_id", "chunk", F.length("text").alias("n"), F.md5("text").alias("h"))


def gate_parse(spark, sf_dir):
    raw = F.concat(F.lit('review: {"score": '), F.col("quality") * 60 + F.col("toxic") * 90, F.lit(', "issues": ["a", " ", "b"]}'))
    g = T.gate(raw)
    return read(spark, sf_dir, "labels").select("doc_id", g["score"].alias("score"), g["passed"].alias("passed"), F.size(g["issues"]).alias("n_issues"))


def gate_retry(spark, sf_dir):
    from ..operators import summarize as S

    g = read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 90.0).alias("score"), (F.col("toxic") == 0).alias("passed"))
    d = read(spark, sf_dir, "documents").select("doc_id", "text").join(g, "doc_id").withColumn("summary", F.lit("first"))
    return S.gated(d, S.extractive(40)).select("doc_id", "retried", "summary")


def title_pairs(documents: DataFrame) -> DataFrame:
    """(doc_id, title, other_id, other) of whole first lines: neighbours by id, whatever gaps lie between ids, and the first
    document of each normalised title with all others of that title; exact blocks, no all-pairs."""
    from ..operators.queues import batches

    d = batches(documents.where("doc_id is not null").select("doc_id", F.split("text", "\n")[0].alias("title")), "doc_id", 1).select("index", "doc_id", "title", segments.normal_text("title").alias("key"))
    other = d.select(F.col("doc_id").alias("other_id"), F.col("title").alias("other"), "index", "key")
    beside = d.select("doc_id", "title", (F.col("index") + 1).alias("index")).join(other.drop("key"), "index").drop("index")
    first = d.where("key <> ''").groupBy("key").agg(F.min(F.struct("index", "doc_id", "title")).alias("f")).select("key", F.col("f.doc_id").alias("doc_id"), F.col("f.title").alias("title"), F.col("f.index").alias("at"))
    # a neighbour is a pair already
    same = first.join(other, "key").where("index > at + 1").drop("key", "at", "index")
    return beside.unionByName(same)


def similarity_titles(spark, sf_dir):
    """How alike the titles (whole first lines) of neighbours by id and of documents with one normalised title are."""
    pairs = title_pairs(read(spark, sf_dir, "documents"))
    # pairs are few bytes and much work: parts joined for their small bytes would be long tasks
    pairs = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "other_id")
    return pairs.select("doc_id", "other_id", F.round(segments.similarity("title", "other"), 9).alias("ratio"), segments.redundant_title("title", "other").alias("redundant"))


def similarity_benchmark(spark, sf_dir):
    """[FLT-19] Documents that hold sentences of benchmark items, equal or nearly so."""
    from ..operators.similarity import shared_sentences

    got = shared_sentences(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "item_id")
    return got.withColumn("best", F.round("best", 9))


def two_stage_summary(spark, sf_dir):
    from ..operators import summarize as S

    chunks = segments.chunk_text(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_id"), "text"), most=2000, overlap=100).withColumn("group", F.lit(0))
    return S.two_stage(chunks, S.extractive(60))


def audit_full_outer(spark, sf_dir):
    return series.two_sided(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where("quality = 1").withColumn("doc_id", F.col("doc_id") + 3), "doc_id")


def fanout_health_counters(spark, sf_dir):
    d = docs(spark, sf_dir).select("lang", filters.ad_document("title", "text", L).alias("ad"), filters.long_enough("text").alias("ok"), filters.wall("text", L).alias("wall"))
    return d.groupBy("lang").agg(F.count("*").alias("seen"), F.count_if("ad").alias("ads"), F.count_if(~F.col("ok")).alias("short"), F.count_if("wall").alias("walls"), F.count_if(F.col("ok") & ~F.col("ad") & ~F.col("wall")).alias("kept"))


def note_fill_rate(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.groupBy("source").agg(F.count_if(F.col("text").contains("Licensed")).alias("with_license"), F.sum(F.regexp_count("text", F.lit(r"\|"))).alias("bars"), F.max_by("doc_id", F.struct(F.length("text"), "doc_id")).alias("longest"))


def global_sequence(spark, sf_dir):
    from ..operators.queues import batches

    return batches(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 15)


def tags_overlap(spark, sf_dir):
    """[ST-4] Documents one of whose default tags is wanted."""
    d = docs(spark, sf_dir).select("doc_id", T.default_tags(F.lit("case"), "title", "text", L).alias("tags"))
    return d.select("doc_id", T.shares_any("tags", F.array(F.lit("que"), F.lit("lich"), F.lit(None).cast("string"))).alias("hit"))


_DOCS = (tags_overlap, dedup_documents, dedup_content_groups, dedup_known, min_length_gate, wall_filter, ad_title_filter, ad_full_filter, ad_purify_lines, substantive_filter, length_band_counts, classify_note_type, classify_counts_by_lang, template_lookup, lexicon_occurrence_counts, interview_heuristic, default_tags, category_from_tags, filename_generate, filename_collisions, folder_sanitize, frontmatter_render, tag_line_normalize, note_header, titles_from_text, one_liners, sentence_lists, sentence_dedup, normal_texts, text_chunks, gate_parse, gate_retry, similarity_titles, similarity_benchmark, two_stage_summary, audit_full_outer, fanout_health_counters, note_fill_rate, global_sequence)
QUERIES = {f.__name__: f for f in _DOCS}

_H = "substr(sha256(trim({})), 1, 16)"
_LOW = f"lower({_T} || chr(10) || substr(text, 1, {config.CLASSIFY_PREFIX}))"
_INT = f"substr({_T} || chr(10) || substr(text, 1, {config.INTERVIEW_PREFIX}), 1, {config.INTERVIEW_PREFIX})"
_LIKE = "((host >= 2 and audience <= host + 1) or host >= 4)"
_CLASS = f"""(select doc_id, lang, case when {sql_any("low", L.tutorial)} then 'structured' when {sql_any("low", L.interview)} or {_LIKE} then 'interview'
    when {sql_any("low", L.key_points)} then 'key_points' when {sql_any("low", L.roundup)} then 'roundup' when {sql_any("low", L.reading)} then 'reading'
    when {sql_any("low", L.opinion)} then 'opinion' when {sql_any("low", L.case)} then 'case' else 'structured' end note_type
    from (select *, {sql_occurrences("txt", L.host_probes)} host, {sql_occurrences("txt", L.audience_probes)} audience
          from (select doc_id, lang, {_LOW} low, {_INT} txt from documents)))"""
_PLAIN = r"regexp_replace(b, '[#>*_`-]', '', 'g')"
_SAFE = r"""regexp_replace(trim({}), '[\\/:*?"<>|\r\n\t]', '_', 'g')"""
_AD = f"({sql_any('title', L.ad_titles)} or (length(text) < 1500 and {sql_hits('text', L.ad_phrases)} >= 2))"
_D = f"(select *, {_T} title from documents)"
_NORM = r"""regexp_replace({}, '[ \t\r\n\x0b\x0c,.!?;:''()\[\]]', '', 'g')"""

SQL = {
    "dedup_documents": f"select doc_id, lang, length(text) n_chars, {_H.format('text')} hash16 from documents where length(trim(text)) >= 100 qualify row_number() over (partition by sha256(trim(text)) order by doc_id) = 1",
    "dedup_content_groups": f"select {_H.format('text')} hash16, count(*) n, min(doc_id) first_id, max(doc_id) last_id from documents group by 1 having count(*) > 1",
    "dedup_known": f"""with d as (select doc_id, case when trim(text) <> '' then {_H.format('text')} end as key from documents), i as (select key, min(doc_id)::varchar t from d where doc_id % 10 = 0 group by 1)
        select d.key, d.doc_id, i.t known_title from d left join i using (key) where doc_id % 10 <> 0""",
    "min_length_gate": "select doc_id, length(trim(text)) n from documents where length(trim(text)) >= 100",
    "wall_filter": f"select doc_id, lang from documents where not {sql_any('lower(text)', L.wall_markers)}",
    "ad_title_filter": f"select doc_id, title from {_D} where {sql_any('title', L.ad_titles)}",
    "ad_full_filter": f"select doc_id, length(text) n, {sql_hits('text', L.ad_phrases)} hits from {_D} where {_AD}",
    "ad_purify_lines": f"""select doc_id, length(clean) n, {_H.format('clean')} h from (select doc_id, trim(coalesce((
        select string_agg(b, chr(10) order by i) from (select unnest(string_split(text, chr(10))) b, generate_subscripts(string_split(text, chr(10)), 1) i)
        where trim(b) <> '' and not (({sql_hits(_PLAIN, L.ad_strong)} >= 1 and length({_PLAIN}) < 140) or {sql_hits(_PLAIN, L.ad_phrases)} >= 2)), '')) clean from documents)""",
    "substantive_filter": f"select doc_id, length(text) n from documents where length(trim(text)) >= 15 and length(trim(regexp_replace(trim(text), 'https?://[^ \\n]+', '', 'g'))) >= 15 and not {sql_any('trim(text)', L.post_noise)}",
    "length_band_counts": f"select lang, case when length(trim(text)) < 20 then 'drop' when length(trim(text)) <= 80 then 'light' else 'full' end band, count(*) n from documents group by 1, 2",
    "classify_note_type": f"select doc_id, note_type from {_CLASS}",
    "classify_counts_by_lang": f"select lang, note_type, count(*) n from {_CLASS} group by 1, 2",
    "template_lookup": "select doc_id, case doc_id % 3 when 0 then 'interview' when 1 then 'unheard' else 'case' end note_type, case doc_id % 3 when 0 then 'Interview' when 1 then 'Notes' else 'Case' end as label from documents",
    "lexicon_occurrence_counts": f"select doc_id, {sql_occurrences('text', L.host_probes)}::int host, {sql_occurrences('text', L.audience_probes)}::int audience, {sql_hits('text', L.ad_phrases)} ad_hits from documents",
    "interview_heuristic": f"select doc_id, lang from (select doc_id, lang, {sql_occurrences('txt', L.host_probes)} host, {sql_occurrences('txt', L.audience_probes)} audience from (select doc_id, lang, {_INT} txt from documents)) where {_LIKE}",
    "tags_overlap": "select doc_id, contains(text, 'que') or contains(text, 'lich') hit from documents",
    "default_tags": f"select doc_id, array_to_string(list_concat(['Case'], list_filter({sql_list(L.tag_terms)}, lambda t: contains(title || chr(10) || text, t))), ',') tags from {_D}",
    "category_from_tags": "select doc_id, 'Case,repost,' || lang || ',fresh' tags, lang category from documents",
    "filename_generate": f"""select doc_id, '[' || lang || ']' || case when length(substr({_SAFE.format('title')}, 1, 50)) < 2 then 'unnamed' else substr({_SAFE.format('title')}, 1, 50) end || '-' || strftime(date '2024-01-01' + (doc_id % 28)::int, '%Y%m%d') || '.md' filename,
        substr(regexp_replace({_SAFE.format('title')}, ' +', ' ', 'g'), 1, 30) short from {_D}""",
    "filename_collisions": f"""with d as (select doc_id, substr({_SAFE.format('title')}, 1, 12) || '.md' as name from {_D}), k as (select *, row_number() over (partition by name order by doc_id) - 1 k from d)
        select doc_id, name, case when k = 0 then name else regexp_replace(name, '\\.md$', '') || '-' || k || '.md' end unique_name from k""",
    "folder_sanitize": "select doc_id, lang || '/a_b/' || source folder, lang || '/' || source as path, lang || '/a_b？' || source sink_key from documents",
    "frontmatter_render": f"select doc_id, md5(head) h, length(head) n from (select doc_id, '---' || chr(10) || 'published_at: ' || chr(10) || 'source_url: ' || source || chr(10) || 'title: ' || title || chr(10) || 'tokens:' || chr(10) || '  total: ' || length(text) || chr(10) || '---' head from {_D})",
    "tag_line_normalize": "select doc_id, '#' || lang || ' #' || source || chr(10) || 'body' as text from documents",
    "note_header": f"select doc_id, md5('# ' || title || chr(10) || '#' || lang || ' #' || source || chr(10) || 'Author: a | u' || chr(10) || 'Published: 2024-01-02 03:04' || chr(10) || chr(10) || length(text)) h from {_D}",
    "titles_from_text": """with l as (select doc_id, lang, list_transform(string_split(text, chr(10)), lambda x: trim(x)) ls from documents),
        b as (select *, coalesce(list_filter(ls, lambda x: x <> '' and not starts_with(x, '#'))[1], '') line from l), c as (select *, regexp_extract(line, '^[^!?]*') cut from b)
        select doc_id, substr(coalesce(nullif(list_filter(ls, lambda x: length(x) > 0 and length(x) < 100 and not starts_with(x, '#'))[1], ''), 'untitled'), 1, 50) title,
        case when cut = '' then 'Hello' when length(cut) > 36 then regexp_replace(substr(cut, 1, 36), '[,; ]+$', '') || '…' else cut end body_title, lang h1 from c""",
    "one_liners": f"select doc_id, source inline, lang below, case when starts_with(trim(title), '#') then '' else trim(title) end above from {_D}",
    "sentence_lists": "select doc_id, len(s) n, md5(array_to_string(s, '|')) h from (select doc_id, regexp_extract_all(replace(text, '.', ';'), '([^!?;]+[!?;]?|[!?;])', 1) s from documents)",
    "sentence_dedup": f"""with r as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) pos from documents), k as (select *, {_NORM.format('line')} as key from r),
        f as (select * from k qualify row_number() over (partition by doc_id, key order by pos) = 1 or length(key) < 8)
        select doc_id, count(*)::int n_lines, md5(string_agg(line, chr(10) order by pos)) h from f group by 1""",
    "normal_texts": f"select doc_id, md5({_NORM.format('title')}) h, case when regexp_replace(trim(title), '^([,.!?][,.!? ]*)+', '') = '' then '' else regexp_replace('well, um, ' || rtrim(title), '^(?:(?:you know|well|um|uh|so)[,.!?][,.!? ]*)+', '') end stripped, regexp_replace(title, '[#>*_`-]', '', 'g') || ' a ' plain from {_D}",
    "gate_parse": "select doc_id, least(100.0, quality * 60 + toxic * 90)::double score, least(100, quality * 60 + toxic * 90) >= 85 passed, 2 n_issues from labels",
    "gate_retry": """select d.doc_id, quality = 0 and toxic = 1 retried, case when quality = 0 and toxic = 1 then coalesce(nullif(trim(substr(regexp_extract(trim(text), '^[^.!?]*[.!?]?'), 1, 40)), ''), 'first') else 'first' end summary from documents d join labels using (doc_id)""",
    "audit_full_outer": "with a as (select distinct doc_id from documents), b as (select distinct doc_id + 3 doc_id from labels where quality = 1) select coalesce(a.doc_id, b.doc_id) doc_id, case when b.doc_id is null then 'missing' else 'orphan' end side from a full join b on a.doc_id = b.doc_id where a.doc_id is null or b.doc_id is null",
    "fanout_health_counters": f"select lang, count(*) seen, count_if(ad) ads, count_if(not ok) short, count_if(wall) walls, count_if(ok and not ad and not wall) kept from (select lang, {_AD} ad, length(trim(text)) >= 100 ok, {sql_any('lower(text)', L.wall_markers)} wall from {_D}) group by 1",
    "note_fill_rate": "select source, count_if(contains(text, 'Licensed')) with_license, sum(length(text) - length(replace(text, '|', '')))::bigint bars, (list(doc_id order by length(text) desc, doc_id desc))[1] longest from documents group by 1",
    "text_chunks": f"select doc_id, chunk, length(text) n, md5(text) h from {sql_chunks('documents', 'doc_id', 1000, 50)}",
    "two_stage_summary": f"""select doc_id media_id, count(*)::int n_chunks, case when count({sql_summary(60)}) = count(*) then string_agg({sql_summary(60)}, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by chunk) end summary
        from {sql_chunks('documents', 'doc_id', 2000, 100)} group by 1""",
    "global_sequence": "select doc_id, lang, row_number() over (order by doc_id) - 1 as index, ((row_number() over (order by doc_id) - 1) // 15)::int batch from documents",
}
