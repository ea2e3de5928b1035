"""Queries over series: an order is a series, a line an episode (the line's status gives its state)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import queues, series
from .common import read

def line_state():
    status, flag = F.col("l_linestatus"), F.col("l_returnflag")
    return F.when((status == "O") & (flag == "A"), "pending").when(status == "O", "raw_ready").when(flag == "A", "summarized").when(flag == "N", "landed").otherwise("verified")


def evidence(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("series"), F.col("l_linenumber").cast("int").alias("page"), line_state().alias("state"))


def expected(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("series"), (F.col("o_orderkey") % 8).cast("int").alias("expected_total"))


def series_monotone_state(spark, sf_dir):
    return series.fold(evidence(spark, sf_dir))


def series_state_histogram(spark, sf_dir):
    return series.histogram(series.fold(evidence(spark, sf_dir)))


def series_gap_pages(spark, sf_dir):
    return series.gaps(series.fold(evidence(spark, sf_dir)), expected(spark, sf_dir))


def series_pending(spark, sf_dir):
    m = series.fold(evidence(spark, sf_dir)).select("series", F.col("page").alias("base"), "ord")
    return series.pending(m.select("series", "base"), m.where("ord >= 3"))


def series_totals(spark, sf_dir):
    more = expected(spark, sf_dir).withColumn("expected_total", (F.col("series") % 5).cast("int"))
    return series.grow_total(expected(spark, sf_dir), more)


def series_overview(spark, sf_dir):
    notes = series.fold(evidence(spark, sf_dir)).select("series", "page", F.concat(F.lit("a|"), "state").alias("title"))
    return series.overview(notes)


def series_fill(spark, sf_dir):
    m = series.fold(evidence(spark, sf_dir))
    old = m.select("series", "page", F.lit("old").alias("url"), F.lit("").alias("body"))
    new = m.where("page < 4").select("series", "page", F.when(F.col("page") == 2, "").otherwise("new").alias("url"), F.lit("b").alias("body"))
    return series.fill(old, new, ["series", "page"], ["url", "body"])


def episode_names(spark, sf_dir):
    m = series.fold(evidence(spark, sf_dir)).select("series", "page", T.episode_name(F.col("page") * 30, F.col("state"), "raw").alias("raw"), T.episode_name("page", F.col("state"), "body").alias("body"))
    return m.select("series", "page", "raw", T.parse_episode_name("raw")["page"].alias("raw_page"), T.parse_episode_name("body")["part"].alias("part"), T.parse_episode_name("body")["kind"].alias("kind"))


def queue_merge_series(spark, sf_dir):
    one = evidence(spark, sf_dir).groupBy("series").agg(F.collect_set("page").alias("raws"))
    return queues.merge_series(one, one.where("series % 2 = 0").withColumn("raws", F.array(F.lit(9)))).select("series", F.array_join(F.col("raws").cast("array<string>"), ",").alias("raws"))


def playlist_expand(spark, sf_dir):
    e = evidence(spark, sf_dir).groupBy("series").agg(F.array_sort(F.collect_set("page")).alias("entries"))
    return series.expand_playlist(e, 3)


def tree_flatten(spark, sf_dir):
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    nodes = region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("title"))
    nodes = nodes.union(nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.col("n_name")))
    return series.tree_paths(nodes)


def folders_missing(spark, sf_dir):
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    paths = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.concat_ws("/", "r_name", "n_name", F.lit("x")).alias("path"))
    return series.missing_folders(paths, region.where("r_regionkey < 2").select(F.col("r_name").alias("path")))


def store_audit(spark, sf_dir):
    left = read(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("k"))
    right = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    return series.two_sided(left, right, "k")


def tree_deep(spark, sf_dir):
    """A tree in which customer k stands below customer k / 2."""
    key = F.col("c_custkey").cast("long")
    nodes = read(spark, sf_dir, "customer").select(key.alias("node"), F.when(key > 1, F.floor(key / 2)).alias("parent"), (key % 10).cast("string").alias("title"))
    return series.tree_paths(nodes)


def child_lookup(spark, sf_dir):
    """Customers are containers, their orders children titled by priority; two titles are looked for in each."""
    children = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("node"))
    wanted = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("parent"), F.explode(F.array(F.lit("1-URGENT"), F.lit("5-LOW"))).alias("title"))
    return series.child_by_title(children, wanted)


def summary_files(spark, sf_dir):
    queue = read(spark, sf_dir, "orders").select(F.concat(F.lit("notes/_raw_"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("raw"))
    files = read(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.concat(F.lit("notes/"), F.col("l_orderkey").cast("string"), F.lit(".md")).alias("path"))
    return series.summaries_of(queue, files)


def series_drained(spark, sf_dir):
    """Every line of an open order was saved; those of even suppliers are found at the target."""
    lines = read(spark, sf_dir, "lineitem")
    saved = lines.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("series"), F.col("l_linenumber").cast("int").alias("page"), F.lit(True).alias("ok"), (F.col("l_suppkey") % 2 == 0).alias("found"))
    proved = evidence(spark, sf_dir).select("series", "page", series.state_number(F.col("state")).alias("ord"))
    return series.drain(proved, saved)


QUERIES = {f.__name__: f for f in (tree_deep, child_lookup, summary_files, series_drained, series_monotone_state, series_state_histogram, series_gap_pages, series_pending, series_totals, series_overview, series_fill, episode_names, queue_merge_series, playlist_expand, tree_flatten, folders_missing, store_audit)}

_ORD = "case when l_linestatus = 'O' and l_returnflag = 'A' then 0 when l_linestatus = 'O' then 1 when l_returnflag = 'A' then 2 when l_returnflag = 'N' then 3 else 4 end"
_M = f"(select *, ['pending', 'raw_ready', 'summarized', 'landed', 'verified'][ord + 1] state from (select l_orderkey series, l_linenumber::int page, max({_ORD}) ord, count(*) n_evidence from lineitem group by 1, 2))"
SQL = {
    "tree_deep": "with recursive t as (select c_custkey::bigint node, (c_custkey % 10)::varchar path, 0 depth from customer where c_custkey <= 1 union all select c.c_custkey, t.path || '/' || (c.c_custkey % 10), depth + 1 from t join customer c on c.c_custkey > 1 and c.c_custkey // 2 = t.node) select node, path, depth from t",
    "child_lookup": "select c_custkey parent, t title, min(o_orderkey) node from (select c_custkey, unnest(['1-URGENT', '5-LOW']) t from customer) left join orders on o_custkey = c_custkey and o_orderpriority = t group by 1, 2",
    "summary_files": "select 'notes/_raw_' || o_orderkey || '.md' raw, 'notes/' || o_orderkey || '.md' path, o_orderkey in (select l_orderkey from lineitem where l_linestatus = 'F') found from orders",
    "series_drained": f"with s as (select l_orderkey series, l_linenumber::int page, bool_or(l_suppkey % 2 = 0) f from lineitem where l_linestatus = 'O' group by 1, 2), p as (select m.series, greatest(m.ord, case when s.f then 4 when s.f is not null then 3 else 0 end) ord from {_M} m left join s on s.series = m.series and s.page = m.page) select series, count(*) pages, count_if(ord >= 3) landed, count_if(ord >= 4) verified, bool_and(ord >= 4) clean_up from p group by 1",
    "series_monotone_state": f"select series, page, state, ord, n_evidence from {_M}",
    "series_state_histogram": f"select series, count(*)::int total, count_if(ord = 0)::int pending, count_if(ord = 1)::int raw_ready, count_if(ord = 2)::int summarized, count_if(ord = 3)::int landed, count_if(ord = 4)::int verified from {_M} group by 1",
    "series_gap_pages": f"select o_orderkey series, p::int page from (select o_orderkey, unnest(range(1, (o_orderkey % 8) + 1)) p from orders) where (o_orderkey, p) not in (select (series, page::bigint) from {_M} where ord >= 1)",
    "series_pending": f"select series, page base from {_M} where ord < 3",
    "series_totals": "select o_orderkey series, greatest(o_orderkey % 8, o_orderkey % 5)::int expected_total from orders",
    "series_overview": f"select series, string_agg('| ' || page || ' | a/' || state || ' |', chr(10) order by page) navigation, string_agg('a/' || state, ' → ' order by page) as path from {_M} group by 1",
    "series_fill": f"select series, page, case when page < 4 and page <> 2 then 'new' else 'old' end url, case when page < 4 then 'b' else '' end body from {_M}",
    "episode_names": f"select series, page, 'ep' || case when page * 30 < 100 then lpad((page * 30)::varchar, 2, '0') else (page * 30)::varchar end || '_' || state || '_raw.md' raw, page * 30 raw_page, state part, 'body' kind from {_M}",
    "queue_merge_series": "select series, string_agg(page::varchar, ',' order by page) raws from (select distinct l_orderkey series, l_linenumber page from lineitem union select distinct l_orderkey, 9 from lineitem where l_orderkey % 2 = 0) group by 1",
    "playlist_expand": "select series, (k - 1)::int as position, page entry from (select *, row_number() over (partition by series order by page) k from (select distinct l_orderkey series, l_linenumber::int page from lineitem)) where k <= 3",
    "tree_flatten": "with recursive n as (select 'r' || r_regionkey node, null::varchar parent, r_name title from region union all select 'n' || n_nationkey, 'r' || n_regionkey, n_name from nation), t as (select node, title as path, 0 depth from n where parent is null union all select n.node, t.path || '/' || n.title, depth + 1 from n join t on n.parent = t.node) select node, path, depth from t",
    "folders_missing": "with p as (select r_name a, r_name || '/' || n_name b, r_name || '/' || n_name || '/x' c from nation join region on n_regionkey = r_regionkey) select distinct path from (select a as path from p union select b from p union select c from p) where path not in (select r_name from region where r_regionkey < 2)",
    "store_audit": "with a as (select distinct o_orderkey k from orders where o_orderkey % 7 <> 0), b as (select distinct l_orderkey k from lineitem) select coalesce(a.k, b.k) k, case when b.k is null then 'missing' else 'orphan' end side from a full join b on a.k = b.k where a.k is null or b.k is null",
}
