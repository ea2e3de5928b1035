"""Queries over feed items: discovery, seen state, caps, backfill, queues. source = user, item = event, at a fixed time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import feeds, filters, queues
from ..sources import history
from .common import NOW, read


def items(spark, sf_dir):
    return feeds.feed_items(read(spark, sf_dir, "events"))


def seen(spark, sf_dir):
    """Every third item counts as seen, in order of its id."""
    return items(spark, sf_dir).where("id % 3 = 0").select("source_key", "id", F.col("id").alias("seq"))


def discover_topn(spark, sf_dir):
    got, _ = feeds.discover(items(spark, sf_dir), seen(spark, sf_dir), NOW, 10, 2)
    return got.select("source_key", "id", "route", "rank")


def discover_marked(spark, sf_dir):
    _, new = feeds.discover(items(spark, sf_dir), seen(spark, sf_dir), NOW, 10, 2)
    return new.groupBy("source_key").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))


def discover_caps_by_route(spark, sf_dir):
    return feeds.newest(feeds.unseen(items(spark, sf_dir), seen(spark, sf_dir)), 1, "route").select("source_key", "route", "id")


def seen_anti_join(spark, sf_dir):
    return feeds.unseen(items(spark, sf_dir), seen(spark, sf_dir)).groupBy("route").agg(F.count("*").alias("n"))


def seen_keep_last_k(spark, sf_dir):
    new = feeds.unseen(items(spark, sf_dir), seen(spark, sf_dir))
    return feeds.remember(seen(spark, sf_dir), new, 5).select("source_key", "id", "seq")


def backfill_progress(spark, sf_dir):
    return feeds.backfill_progress(items(spark, sf_dir), seen(spark, sf_dir), "2024-01-05 00:00:00", 4)


def source_health(spark, sf_dir):
    return feeds.health(items(spark, sf_dir))


def subscription_enrich(spark, sf_dir):
    subs = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_key"), F.col("c_name").alias("sub_name"), F.col("c_mktsegment").alias("category"))
    got = feeds.enrich(items(spark, sf_dir).withColumn("content", F.lit("x")), subs)
    return got.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("sub_name").isNull()).alias("unnamed"))


def freshness_label(spark, sf_dir):
    return items(spark, sf_dir).select("id", T.freshness("publish_time", NOW).alias("label"))


def effective_window(spark, sf_dir):
    last = items(spark, sf_dir).groupBy("source_key").agg(F.max("publish_time").alias("last_check"))
    return last.select("source_key", T.effective_window("last_check", NOW).alias("days"))


def date_parts(spark, sf_dir):
    raw = F.when(F.col("id") % 3 == 0, F.date_format("publish_time", "yyyy/M/d")).when(F.col("id") % 3 == 1, F.date_format("publish_time", "yyyy-MM-dd")).otherwise("soon")
    got = items(spark, sf_dir).select("id", T.parse_since(raw).alias("since"), T.day_start("publish_time").alias("day"))
    return got.select("id", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"), F.date_format("day", "yyyy-MM-dd HH:mm:ss").alias("day_start"))


def route_counts(spark, sf_dir):
    kind = F.when(F.col("route") == "click", "article").when(F.col("route") == "view", "video").when(F.col("route") == "purchase", "dynamic").otherwise("other")
    return items(spark, sf_dir).select(filters.route(kind).alias("route")).groupBy("route").agg(F.count("*").alias("n"))


def _failed(spark, sf_dir):
    """Every item that is no click has failed; urls repeat, and some counts are missing."""
    count = F.when(F.col("id") % 4 < 3, (F.col("id") % 4).cast("int"))
    return items(spark, sf_dir).where("route <> 'click'").select(F.concat(F.lit("u"), (F.col("id") % 700).cast("string")).alias("url"), "id", F.col("id").alias("queued_at"), count.alias("refetch_count"))


def retry_or_drop(spark, sf_dir):
    return queues.retry_or_drop(_failed(spark, sf_dir)).select("id", "refetch_count", "action", "reason")


def queue_upsert(spark, sf_dir):
    new = items(spark, sf_dir).select(F.concat(F.lit("u"), (F.col("id") % 900).cast("string")).alias("url"), "id", F.col("id").alias("queued_at"))
    return queues.work_order(_failed(spark, sf_dir).drop("refetch_count"), new).select("url", "id", "priority")


def _entries(spark, sf_dir):
    """All items as queue entries: two of a source share a url, and some have no state."""
    return items(spark, sf_dir).select(F.concat_ws("/", F.col("source_key").cast("string"), F.floor(F.col("feed_pos") / 2).cast("string")).alias("url"), F.when(F.col("id") % 6 > 0, F.col("route")).alias("state"))


def queue_promote(spark, sf_dir):
    q = _entries(spark, sf_dir)
    stay, moved = queues.promote(q, q.where("state = 'view'").select("url").distinct(), F.col("state") != "click")
    return stay.select("url", F.lit("stay").alias("queue")).unionByName(moved.select("url", F.lit("target").alias("queue")))


def queue_drain(spark, sf_dir):
    q = items(spark, sf_dir).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"))
    return queues.drain(q, q.select("url", (F.length("url") % 2 == 0).alias("ok")))


def paid_skip(spark, sf_dir):
    flagged = items(spark, sf_dir).withColumn("paid", F.when(F.col("id") % 5 > 0, F.col("id") % 3 == 0))
    kept, skipped = feeds.without_paid(flagged)
    return kept.groupBy("source_key").agg(F.count("*").alias("kept")).join(skipped, "source_key", "full")


def remember_repeats(spark, sf_dir):
    """A batch that gives every item twice, at two places."""
    new = items(spark, sf_dir)
    twice = new.unionByName(new.withColumn("feed_pos", F.col("feed_pos") + 100))
    return feeds.remember(seen(spark, sf_dir), twice, 4).select("source_key", "id", "seq")


def index_range_select(spark, sf_dir):
    picked = queues.index_range("0,1,3-6,2-4,990000", 1000)
    return items(spark, sf_dir).where(F.col("feed_pos").isin(picked)).groupBy("feed_pos").agg(F.count("*").alias("n"))


def job_status(spark, sf_dir):
    jobs = items(spark, sf_dir).select((F.col("source_key") % 50).alias("job"), F.col("id").alias("name"), (F.col("id") % 3 == 0).alias("done"), F.col("id").alias("queue_pos"))
    return queues.first_pending(jobs)


def upsert_rows(spark, sf_dir):
    """Old and new rows by (source, route); a batch repeats its keys, and the row with the largest id stays."""
    old = items(spark, sf_dir).groupBy("source_key").agg(F.max("id").alias("id")).select("source_key", F.lit("click").alias("route"), "id", F.lit("old").alias("v"))
    new = items(spark, sf_dir).where("route <> 'view'").select("source_key", "route", "id", F.lit("new").alias("v"))
    return feeds.upsert(old, new, ["source_key", "route"], "id")


def history_events(spark, sf_dir):
    """[SRC-5, SRC-6] All events, read page by page from the paged source, up to the end of the history."""
    got = history.reachable(history.history(spark, "event_id long, user_id long, event_type string", path=f"{sf_dir}/events.parquet"))
    return got.select("page", "position", "item.*")


QUERIES = {f.__name__: f for f in (history_events, discover_topn, discover_marked, discover_caps_by_route, seen_anti_join, seen_keep_last_k, backfill_progress, source_health, subscription_enrich, freshness_label, effective_window, date_parts, route_counts, retry_or_drop, queue_upsert, queue_promote, queue_drain, paid_skip, remember_repeats, index_range_select, job_status, upsert_rows)}

_I = "(select user_id source_key, event_id id, event_type route, props title, ts publish_time, row_number() over (partition by user_id order by ts desc, event_id desc) - 1 feed_pos from events)"
_IN = f"ts >= timestamp '{NOW}' - interval 10 days"
_FAILED = f"(select 'u' || (id % 700) url, id, id queued_at, case when id % 4 < 3 then (id % 4)::int end refetch_count from {_I} where route <> 'click')"
SQL = {
    "history_events": "select ((row_number() over (order by event_id) - 1) // 20 + 1)::int page, ((row_number() over (order by event_id) - 1) % 20)::int as position, event_id, user_id, event_type from events",
    "discover_topn": f"select user_id source_key, event_id id, event_type route, row_number() over (partition by user_id order by ts desc, event_id desc)::int as rank from events where {_IN} and event_id % 3 <> 0 qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 2",
    "discover_marked": f"select user_id source_key, count(*) n, min(event_id) lo, max(event_id) hi from events where {_IN} and event_id % 3 <> 0 group by 1",
    "discover_caps_by_route": "select user_id source_key, event_type route, event_id id from events where event_id % 3 <> 0 qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1",
    "seen_anti_join": "select event_type route, count(*) n from events where event_id % 3 <> 0 group by 1",
    "seen_keep_last_k": f"""with s as (select source_key, id, id seq from {_I} where id % 3 = 0), l as (select source_key, max(seq) last from s group by 1),
        a as (select i.source_key, i.id, coalesce(l.last, -1) + row_number() over (partition by i.source_key order by feed_pos, id) seq from {_I} i left join l using (source_key) where i.id % 3 <> 0)
        select source_key, id, seq from (select * from s union all select * from a) qualify row_number() over (partition by source_key order by seq desc) <= 5""",
    "backfill_progress": """with g as (select user_id source_key, count(*) n_items, min(ts) oldest, count_if(ts >= timestamp '2024-01-05') n_reachable, count_if(ts >= timestamp '2024-01-05' and event_id % 3 <> 0) n_unseen from events group by 1)
        select source_key, n_items, n_reachable, n_unseen, least(n_unseen, 4) n_emit, n_reachable > 0 and n_unseen <= 4 done,
        case when not (n_reachable > 0 and n_unseen <= 4) then '' when oldest < timestamp '2024-01-05' then 'reached_since' else 'proxy_depth:' || strftime(oldest, '%Y-%m-%d') end reason from g""",
    "source_health": "select user_id source_key, count(*) total, count_if(event_type = 'click') n_click, count_if(event_type = 'view') n_view, count_if(event_type = 'purchase') n_purchase, count_if(event_type = 'signup') n_signup from events group by 1",
    "subscription_enrich": "select c_mktsegment category, count(*) n, count_if(c_name is null) unnamed from events left join customer on user_id = c_custkey group by 1",
    "freshness_label": f"select event_id id, case when epoch(timestamp '{NOW}') - floor(epoch(ts)) < 86400 then 'fresh' when epoch(timestamp '{NOW}') - floor(epoch(ts)) < 7 * 86400 then 'recent' else 'archive' end as label from events",
    "effective_window": f"select user_id source_key, least(greatest(1, floor((epoch(timestamp '{NOW}') - floor(epoch(max(ts)))) / 86400) + 1), 30)::int as days from events group by 1",
    "date_parts": "select event_id id, case when event_id % 3 < 2 then strftime(ts, '%Y-%m-%d 00:00:00') end since, strftime(date_trunc('day', ts + interval 8 hours) - interval 8 hours, '%Y-%m-%d %H:%M:%S') day_start from events",
    "route_counts": "select case event_type when 'click' then 'article' when 'view' then 'video' when 'purchase' then 'dynamic' else 'ignored' end route, count(*) n from events group by 1",
    "retry_or_drop": f"select id, coalesce(refetch_count, 0) + 1 refetch_count, case when coalesce(refetch_count, 0) + 1 >= 3 then 'drop' else 'requeue' end as action, case when coalesce(refetch_count, 0) + 1 >= 3 then 'gave up after ' || (refetch_count + 1) else '' end reason from {_FAILED}",
    "queue_upsert": f"select url, id, priority from (select url, id, queued_at, 0 priority from {_FAILED} union all select 'u' || (id % 900), id, id, 1 from {_I}) qualify row_number() over (partition by url order by priority, queued_at) = 1",
    "queue_promote": f"with q as (select source_key || '/' || (feed_pos // 2) url, case when id % 6 > 0 then route end state from {_I}), t as (select distinct url from q where state = 'view') select url, 'stay' queue from q where state = 'click' or state is null union all select url, 'target' from t union all select distinct url, 'target' from q where state <> 'click' and url not in (select url from t)",
    "queue_drain": "select 'u' || event_id url from events where length('u' || event_id) % 2 = 1",
    "paid_skip": "select user_id source_key, nullif(count_if(not (event_id % 5 > 0 and event_id % 3 = 0)), 0) kept, count_if(event_id % 5 > 0 and event_id % 3 = 0) skipped from events group by 1",
    "remember_repeats": f"""with s as (select source_key, id, id seq from {_I} where id % 3 = 0), l as (select source_key, max(seq) last from s group by 1),
        a as (select i.source_key, i.id, coalesce(l.last, -1) + row_number() over (partition by i.source_key order by feed_pos, id) seq from {_I} i left join l using (source_key) where i.id % 3 <> 0)
        select source_key, id, seq from (select * from s union all select * from a) qualify row_number() over (partition by source_key order by seq desc) <= 4""",
    "index_range_select": f"select feed_pos::int feed_pos, count(*) n from {_I} where feed_pos in (0, 1, 2, 3, 4, 5, 6) group by 1",
    "job_status": "select user_id % 50 job, bool_and(event_id % 3 = 0) all_done, bool_or(event_id % 3 <> 0) any_pending, min(event_id) filter (event_id % 3 <> 0) first_pending from events group by 1",
    "upsert_rows": "with n as (select user_id source_key, event_type route, max(event_id) id, 'new' v from events where event_type <> 'view' group by 1, 2), o as (select user_id source_key, 'click' route, max(event_id) id, 'old' v from events group by 1) select * from n union all select * from o where not exists (select 1 from n where n.source_key = o.source_key and n.route = o.route)",
}
