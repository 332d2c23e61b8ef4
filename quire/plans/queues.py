"""Queries over the work queue and the audit stream: statistics, claims, feeds, windows, state, recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import size_category
from quire.operators import dedup, filterlang, queues, state
from quire.sources.tables import audit_events, table, work_queue
from quire.streaming import jobs

NOW = "timestamp '1998-01-01 00:00:00'"
FIELDS = {"status": "event_type", "stage": "event_type", "type": "event_type", "worker": "user_id", "name": "props", "path": "props"}
TEXTS = ["event_type", "props"]
FILTER_QUERY = 'status:error OR name:7 AND type:error "4"'


def _events(spark, d):
    return table(spark, d, "events")


def stage_status_pivot(spark, d):
    return queues.status_pivot(audit_events(spark, d), ["stage"], ("completed", "failed"))


def queue_status_counts(spark, d):
    q = work_queue(spark, d).select(F.lit("extraction").alias("queue"), "status").unionByName(audit_events(spark, d).select(F.col("stage").alias("queue"), "status"))
    return q.groupBy("queue", "status").agg(F.count("*").alias("n"))


def extraction_rollup(spark, d):
    q = work_queue(spark, d).select(size_category((F.col("size") * 200).cast("long")).alias("size_category"), "status")
    return q.rollup("size_category").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "completed")])


def completion_stats(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("l_orderkey", "l_quantity", "l_returnflag", "o_totalprice")
    return j.agg(F.count("*").alias("completed"), F.count_if(F.col("l_returnflag") == "R").alias("duplicates"), F.avg("l_quantity").alias("avg_extract"), F.countDistinct("l_orderkey").alias("distinct_files"))


def inflight_bytes(spark, d):
    o = work_queue(spark, d)
    li = table(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("id")).distinct()
    return o.join(li, "id").groupBy("status").agg(F.count("*").alias("files"), F.sum(F.col("size").cast("decimal(18,2)")).cast("double").alias("bytes"))


def root_completions(spark, d):
    """Distinct files of the completed rows and their bytes, each file once."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return table(spark, d, "orders").join(li, "o_orderkey", "left_semi").agg(F.count("*").alias("files"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("bytes"))


def failure_breakdown(spark, d):
    kind = F.get_json_object("props", "$.k").cast("int") % 5
    by = _events(spark, d).where("event_type = 'error'").groupBy(kind.alias("error_type")).agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("t"))
    return by.crossJoin(F.broadcast(total)).select("error_type", "n", (F.col("n") / F.col("t") * 100).alias("percent"))  # total is one row


def claim_batch(spark, d):
    return queues.claim(work_queue(spark, d), 50, ["priority", "id"], F.expr(NOW), 600).select("id", "priority", "status")


def stale_reset(spark, d):
    out = queues.reset_stale(work_queue(spark, d), F.expr("timestamp '1996-06-01 00:00:00'"))
    return out.groupBy("status").agg(F.count("*").alias("n"), F.count("claimed_at").alias("claimed"))


def retry_routing(spark, d):
    e = _events(spark, d).where("event_type = 'error'").select("event_id", (F.col("value") > 50).alias("transient"), (F.col("user_id") % 5).cast("int").alias("retry_count"))
    return queues.route_failures(e)


def largest_completed(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    return work_queue(spark, d).join(li, "id", "left_semi").orderBy(F.col("size").desc(), "id").limit(100).select("id", "size")


def live_feed(spark, d):
    return filterlang.search(_events(spark, d), "", FIELDS, TEXTS, "event_id", 100).select("event_id", "event_type", "user_id")


def filter_events(spark, d):
    return _events(spark, d).where(filterlang.predicate(FILTER_QUERY, FIELDS, TEXTS)).select("event_id", "event_type", "props")


def latest_heartbeat(spark, d):
    return jobs.heartbeats(_events(spark, d))


def rate_limit_window(spark, d):
    out = queues.sliding_count(_events(spark, d), "user_id", "ts", 86_400, "recent")
    return out.select("event_id", "user_id", "recent", (F.col("recent") > 3).alias("limited"))


def crash_window(spark, d):
    return queues.sliding_count(_events(spark, d), "user_id", "ts", 7 * 86_400, "crashes", F.col("event_type") == "error").where("event_type = 'error'").select("event_id", "crashes")


def state_merge_latest(spark, d):
    e = _events(spark, d).select("user_id", "event_id", F.col("event_type").alias("status"), F.when(F.col("value") > 60, F.col("event_type")).otherwise("").alias("category"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("props")).alias("payload"), (F.col("value") - 50).alias("score"), F.when(F.col("event_type") == "purchase", "tagging").otherwise("other").alias("stage"))
    rules = state.Rules(keep=("payload",), positive=("score",), always=("status",), stage=("category",))
    return state.merge_events(e, "user_id", "event_id", rules)


def upsert_latest(spark, d):
    e = _events(spark, d).select(F.col("user_id").alias("id"), "event_id", F.col("event_type").alias("status"))
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"), F.lit(0).cast("long").alias("event_id"))
    return state.upsert(base, e, "id", "event_id").select("id", "status")


def anti_join_zombies(spark, d):
    li = table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("id"))
    failed = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    return queues.missing(work_queue(spark, d).where("status <> 'completed'"), li, failed).select("id", "status")


def insert_ignore(spark, d):
    old = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("id"))
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    return dedup.insert_ignore(old, new, ["id"])


def unchanged_files(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.lit(100.0).alias("mtime"))
    known = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).otherwise(0).alias("size"), F.when(F.col("doc_id") % 5 == 0, 100.5).otherwise(100.0005).alias("mtime"))
    return dedup.unchanged(files, known).select("path")


def backlog_eta(spark, d):
    q = work_queue(spark, d).groupBy("priority").agg(F.count_if(F.col("status") != "completed").alias("remaining"), F.avg(F.when(F.col("status") == "completed", F.col("size") / 100000)).alias("seconds"), F.countDistinct("worker").alias("workers"))
    return q.select("priority", "remaining", queues.eta(q, "remaining", "seconds", "workers", 10.0).alias("eta_seconds"), F.coalesce(F.try_divide(F.col("remaining") * 100.0, F.col("remaining") + F.col("workers")), F.lit(100.0)).alias("share"))


def reconcile_metrics(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("metric")).agg(F.count("*").alias("expected"))
    li = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("metric")).agg(F.count("*").alias("actual"))
    return queues.reconcile(o, li, ["F", "N"])


def streaming_status_counts(spark, d):
    return jobs.run_once(jobs.status_counts(jobs.event_stream(spark, d)).select("event_type", "n"))


def streaming_window_counts(spark, d):
    return jobs.run_once(jobs.window_counts(jobs.event_stream(spark, d), "1 day")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


QUERIES = {f.__name__: f for f in (stage_status_pivot, queue_status_counts, extraction_rollup, completion_stats, inflight_bytes, root_completions, failure_breakdown, claim_batch, stale_reset, retry_routing, largest_completed, live_feed, filter_events, latest_heartbeat, rate_limit_window, crash_window, state_merge_latest, upsert_latest, anti_join_zombies, insert_ignore, unchanged_files, backlog_eta, reconcile_metrics, streaming_status_counts, streaming_window_counts)}

_Q = "(select o_orderkey as id, o_custkey as worker, case o_orderstatus when 'O' then 'pending' when 'P' then 'processing' else 'completed' end as status, o_orderpriority[1]::int as priority, o_totalprice as size, o_orderdate as claimed_at from orders)"
_STAGE = "case event_type when 'view' then 'discovery' when 'click' then 'extraction' when 'signup' then 'indexing' when 'purchase' then 'tagging' else 'ocr' end"
_STATUS = "case when event_type = 'error' then 'failed' else 'completed' end"
_LAST = lambda c, ok, name: f"arg_max({c}, event_id) filter (where {ok}) as {name}"
SQL = {
    "stage_status_pivot": f"select {_STAGE} as stage, count(*) as total, count(*) filter (where event_type <> 'error') as completed, count(*) filter (where event_type = 'error') as failed from events group by 1",
    "queue_status_counts": f"select queue, status, count(*) as n from (select 'extraction' as queue, status from {_Q} q union all select {_STAGE}, {_STATUS} from events) x group by all",
    "extraction_rollup": f"select size_category, count(*) as total, count(*) filter (where status = 'pending') as pending, count(*) filter (where status = 'processing') as processing, count(*) filter (where status = 'completed') as completed from (select status, case when trunc(size * 200) < 1048576 then 'tiny' when trunc(size * 200) < 10485760 then 'small' when trunc(size * 200) < 52428800 then 'medium' else 'large' end as size_category from {_Q} q) x group by rollup(size_category)",
    "completion_stats": "select count(*) as completed, count(*) filter (where l_returnflag = 'R') as duplicates, avg(l_quantity) as avg_extract, count(distinct l_orderkey) as distinct_files from lineitem join orders on l_orderkey = o_orderkey",
    "inflight_bytes": f"select status, count(*) as files, sum(size::decimal(18,2))::double as bytes from {_Q} q where id in (select l_orderkey from lineitem where l_linestatus = 'O') group by status",
    "root_completions": "select count(*) as files, sum(o_totalprice::decimal(18,2))::double as bytes from orders where o_orderkey in (select l_orderkey from lineitem)",
    "failure_breakdown": "select (props->>'$.k')::int % 5 as error_type, count(*) as n, count(*) / sum(count(*)) over () * 100 as percent from events where event_type = 'error' group by 1",
    "claim_batch": f"select id, priority, status from {_Q} q where status = 'pending' or (status = 'processing' and claimed_at < {NOW} - interval 600 seconds) order by priority, id limit 50",
    "stale_reset": f"select case when s then 'pending' else status end as status, count(*) as n, count(*) filter (where not s) as claimed from (select *, status = 'processing' and claimed_at < timestamp '1996-06-01 00:00:00' - interval 1800 seconds as s from {_Q} q) x group by 1",
    "retry_routing": "select event_id, value > 50 as transient, (user_id % 5 + (value > 50 and user_id % 5 < 3)::int)::int as retry_count, case when value > 50 and user_id % 5 < 3 then 'requeue' else 'dead_letter' end as route from events where event_type = 'error'",
    "largest_completed": "select o_orderkey as id, o_totalprice as size from orders where o_orderkey in (select l_orderkey from lineitem) order by size desc, id limit 100",
    "live_feed": "select event_id, event_type, user_id from events order by event_id desc limit 100",
    "filter_events": f"select event_id, event_type, props from events where {filterlang.sql_predicate(FILTER_QUERY, FIELDS, TEXTS)}",
    "latest_heartbeat": "select user_id, max(ts) as last_seen from events group by user_id",
    "rate_limit_window": "select event_id, user_id, n as recent, n > 3 as limited from (select event_id, user_id, count(*) over (partition by user_id order by ts range between interval 86400 seconds preceding and current row) as n from events) x",
    "crash_window": "select event_id, n as crashes from (select event_id, event_type, count(*) filter (where event_type = 'error') over (partition by user_id order by ts range between interval 7 days preceding and current row) as n from events) x where event_type = 'error'",
    "state_merge_latest": f"select user_id, {_LAST('props', 'event_id % 3 <> 0', 'payload')}, {_LAST('value - 50', 'value - 50 > 0', 'score')}, arg_max(event_type, event_id) as status, {_LAST('''case when value > 60 then event_type else '' end''', '''value > 60 or event_type = 'purchase' ''', 'category')} from events group by user_id",
    "upsert_latest": "select coalesce(e.id, c_custkey) as id, coalesce(e.status, c_mktsegment) as status from customer full join (select user_id as id, arg_max(event_type, event_id) as status from events group by 1) e on e.id = c_custkey",
    "anti_join_zombies": f"select id, status from {_Q} q where status <> 'completed' and not exists (select 1 from lineitem where l_quantity > 25 and l_orderkey = id) and not exists (select 1 from orders o where o.o_orderpriority = '1-URGENT' and o.o_orderkey = id)",
    "insert_ignore": "select distinct o_custkey as id from orders where o_custkey not in (select o_custkey from orders where o_orderkey % 3 = 0)",
    "unchanged_files": "select doc_id::varchar as path from documents where doc_id % 2 = 0 and doc_id % 5 <> 0",
    "backlog_eta": f"select priority, r as remaining, r * coalesce(case when s > 0 then s end, 10.0) / greatest(w, 1) as eta_seconds, r * 100.0 / (r + w) as share from (select priority, count(*) filter (where status <> 'completed') as r, avg(size / 100000) filter (where status = 'completed') as s, count(distinct worker) as w from {_Q} q group by 1) x",
    "reconcile_metrics": "select coalesce(o.m, l.m) as metric, expected, actual, abs(coalesce(expected, 0) - coalesce(actual, 0)) <= case when coalesce(o.m, l.m) in ('F', 'N') then greatest(5, floor(coalesce(expected, 0) * 0.03)) else 0 end as ok from (select o_orderstatus as m, count(*) as expected from orders group by 1) o full join (select l_returnflag as m, count(*) as actual from lineitem group by 1) l on o.m = l.m",
    "streaming_status_counts": "select event_type, count(*) as n from events group by 1",
    "streaming_window_counts": "select time_bucket(interval '1 day', ts) as start, event_type, count(*) as n from events group by 1, 2",
}
