"""Queries over queue transitions, completions, review accounting, document builders and metadata rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import builders as B
from quire.functions.text import size_category
from quire.operators import lifecycle as L
from quire.plans.queues import _Q
from quire.plans.reports import _pages, _reviews
from quire.sources.tables import audit_events, table, work_queue


def _queue(spark, d):
    return work_queue(spark, d).select("id", "status", "claimed_at", (F.col("priority") % 3).alias("retry_count"))


def queue_transitions(spark, d):
    """Line items stand for reports on their order: accepted ones complete it, returned ones put it back, others fail it."""
    moves = table(spark, d, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") == "A", "completed").when(F.col("l_returnflag") == "R", "pending").otherwise("failed").alias("to"))
    return L.transition(_queue(spark, d), moves)


def queue_enqueue(spark, d):
    queue = _queue(spark, d).where("id % 2 = 0")
    return L.enqueue(queue, table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id")))


def completed_items(spark, d):
    done = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("took_ms"))
    return L.completed_rows(done, work_queue(spark, d).select("id", "size"))


def first_completion(spark, d):
    done = table(spark, d, "lineitem").select(F.col("l_partkey").alias("hash"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at"))
    return L.first_completions(done, "hash", "at").select("hash", "item")


def completed_page(spark, d):
    return L.page(work_queue(spark, d).where("status = 'completed'").select("id", "size"), [F.col("id")], 50, 100)


def completion_flags(spark, d):
    flags = spark.createDataFrame([("discovery_complete", "0")], "key string, value string")
    q = work_queue(spark, d)
    return L.discovery_complete(q.where("priority = 1"), flags).withColumn("what", F.lit("discovery")).unionByName(L.work_complete(q).withColumn("what", F.lit("work")))


def worker_pools(spark, d):
    name = F.concat(F.when(F.col("o_custkey") % 4 == 0, "extraction-fast").when(F.col("o_custkey") % 4 == 1, "extraction-std").when(F.col("o_custkey") % 4 == 2, "ocr").otherwise("tagging"), F.lit("-"), F.col("o_custkey"))
    return L.worker_pools(table(spark, d, "orders").select(name.alias("w")).distinct(), "w")


def processing_counts(spark, d):
    q = work_queue(spark, d).where("status = 'processing'")
    return q.groupBy(size_category((F.col("size") * 200).cast("long")).alias("size_category")).agg(F.count("*").alias("n"), F.countDistinct("worker").alias("workers"))


def stage_summary(spark, d):
    return L.summary(audit_events(spark, d).groupBy("stage", "status").agg(F.count("*").alias("n")))


def failed_newest(spark, d):
    return L.page(audit_events(spark, d).where("status = 'failed'"), [F.col("ts").desc(), F.col("id")], 100).select("id", "worker", "payload")


def recent_documents(spark, d):
    return L.page(table(spark, d, "documents"), [F.col("doc_id").desc()], 20).select("doc_id", "source", "n_chars")


def file_info(spark, d):
    return work_queue(spark, d).where("id = 7")


def state_matrix(spark, d):
    return L.page(work_queue(spark, d), [F.col("claimed_at").desc(), F.col("id")], 200).select("id", "status", "claimed_at")


def document_candidates(spark, d):
    """Documents asked for by number, by path or by `file-` number, whichever is there first."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("file-"), F.col("doc_id"))).otherwise(F.concat("source", F.lit("/"), F.col("doc_id"))).alias("key"))
    wanted = table(spark, d, "documents").where("doc_id % 5 <> 0").select("doc_id", "source")
    c = [F.col("doc_id").cast("string"), F.concat("source", F.lit("/"), F.col("doc_id")), F.concat(F.lit("file-"), F.col("doc_id"))]
    return L.first_candidate(wanted, docs.where("doc_id % 4 <> 0"), c, "doc_id", "key")


def embedded_parents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    lineage = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("child"), F.concat(F.lit("p"), F.col("doc_id") % 10).alias("parent"))
    return L.with_parents(docs, lineage.distinct(), "doc_id")


def export_validation(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "None").when(F.col("c_custkey") % 5 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("category"))
    allowed = table(spark, d, "customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_mktsegment").alias("value"))
    return L.validated(rows, "category", allowed, "Undefined")


def _state(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id")).alias("file_name")).where("doc_id % 3 <> 0")


def _review_rows(spark, d):
    return _reviews(spark, d).withColumn("review_id", F.concat_ws("-", "doc_id", "page"))


def document_reviews(spark, d):
    return L.reviews_with_state(_review_rows(spark, d), _state(spark, d)).select("doc_id", "page", "review_id", "status", "file_name")


def review_storage(spark, d):
    return L.storage(_reviews(spark, d), _state(spark, d))


def review_activity(spark, d):
    log = audit_events(spark, d).select("id", "worker", "ts", "stage")
    return L.page(log.where("worker % 2 = 0"), [F.col("ts").desc(), F.col("id")], 100)


def _dated(spark, d):
    at = F.concat(F.date_format(F.expr("date'2024-01-01' + cast(page * 40 as int)"), "yyyy-MM-dd"), F.lit("T00:00:00"), F.when(F.col("doc_id") % 2 == 0, "Z").otherwise(""))
    return _review_rows(spark, d).withColumns({"reviewed_at": at, "snippet_path": F.concat(F.lit("s/"), F.col("doc_id") % 10, F.lit("-"), F.col("page"))})


def review_purges(spark, d):
    """Reviews that may be purged, and pending reviews whose crop is lost, by kind."""
    r = _dated(spark, d)
    crops = r.where("page % 2 = 0").select(F.col("snippet_path").alias("path"))
    kept = L.without_lost_crops(r, crops).groupBy("status").agg(F.count("*").alias("n")).select(F.concat(F.lit("kept "), F.col("status")).alias("kind"), "n")
    return kept.unionByName(L.purgeable(r, "2024-03-21T00:00:00").groupBy("status").agg(F.count("*").alias("n")).select(F.concat(F.lit("purgeable "), F.col("status")).alias("kind"), "n"))


def accept_payloads(spark, d):
    c = table(spark, d, "conversations")
    kind = F.when(F.length("text") % 2 == 0, "faded_text").otherwise("stamp")
    return c.select("conv_id", "turn", L.acceptable(kind, F.when(F.length("text") % 3 == 0, F.col("text")).otherwise(" ")).alias("acceptable"))


def _composition(spark, d):
    p = _pages(spark, d).withColumns({"loss": F.when(F.col("doc_id") % 2 == 0, F.col("weight")).otherwise(0.0), "text_area": F.col("weight") * 0.6, "non_text_area": F.col("weight") * 0.3, "accuracy": F.col("base")})
    return L.breakdown(p.withColumn("zero", F.lit(0.0)), {"clean": "loss", "faded": "zero", "logo": "zero", "stamp": "zero", "handwritten": "zero", "whitespace": "zero", "noise": "zero"})


def page_breakdown(spark, d):
    return _composition(spark, d)


def review_waterfall(spark, d):
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("logo", "stamp", "signature", "faded_text", "text_anomaly")]), (F.col("page") % 5 + 1).cast("int"))
    out = L.waterfall(_composition(spark, d), _reviews(spark, d).withColumn("snippet_type", kinds))
    return out.withColumns({"value": F.round("value", 6), "bottom": F.round("bottom", 6)})


def segmentation_upsert(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_partkey") % 50).alias("page"), F.concat_ws("/", F.col("l_orderkey"), "l_linenumber").alias("v"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return L.last_wins(rows, ["doc_id", "page"], "seq").select("doc_id", "page", "v")


def approved_features(spark, d):
    return _review_rows(spark, d).where("status = 'accepted' and snippet_type <> 'text'").select("doc_id", "review_id")


def filtered_documents(spark, d):
    docs = embedded_parents(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").withColumn("category", F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "x"))
    return L.tagged(L.roots(L.multiselect(docs, {"lang": ["en", "de"], "source": []}))).select("doc_id", "lang", "category")


_WORDS = r"[a-z0-9\p{L}]{4,}"


def metadata_overlap(spark, d):
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(_WORDS), F.lit(0))
    docs = table(spark, d, "documents").select("doc_id", words(F.col("text")).alias("words"))
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("row"), words(F.col("text")).alias("words"))
    return L.by_overlap(docs, rows)


def canonical_labels(spark, d):
    aliases = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("the "), F.col("n_name")).alias("alias"), F.initcap("n_name").alias("label"))
    labels = table(spark, d, "region").select(F.initcap("r_name").alias("label"), (F.col("r_regionkey") != 2).alias("active"))
    rows = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit(" The  "), F.lower("n_name"))).otherwise("n_name").alias("v"))
    more = table(spark, d, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.lower("r_name").alias("v"))
    return L.canonical(rows.unionByName(more), "v", aliases, labels).select("n_nationkey", "canonical")


DEALS = ("Thered", "Of the", "a", "que (la)", "und-der", "In The")


def deal_names(spark, d):
    names = spark.createDataFrame([(x,) for x in DEALS], "name string")
    return L.deals(table(spark, d, "documents").select("doc_id", "text"), names, "text")


def embedded_contents(spark, d):
    f = lambda i, name, c: F.struct(F.lit(name).alias("name"), F.lit(i).alias("index"), c.alias("content"))
    files = F.array(f(0, "a", F.col("text")), f(1, None, F.lit("")), f(2, "c", F.substring("text", 1, 40)), f(3, "d", F.lit(None).cast("string")))
    return table(spark, d, "documents").select("doc_id", B.embedded_text(files, 6_000).alias("embedded_content"))


def extractor_metadata(spark, d):
    m = F.map_filter(F.create_map(F.lit("Content-Type"), F.concat(F.lit("text/"), "lang", F.lit("; charset=x")), F.lit("title"), F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 10)), F.lit("Page-Count"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).when(F.col("doc_id") % 3 == 1, "many"), F.lit("unknown"), F.lit("x")), lambda k, v: v.isNotNull())
    out = table(spark, d, "documents").select("doc_id", B.metadata(m).alias("m"))
    return out.select("doc_id", *[F.col("m")[k].alias(k) for k in ("content_type", "title", "page_count", "mime_type")], F.size("m").alias("fields"))


def derived_tags(spark, d):
    t = F.concat_ws(" ", F.when(F.col("p_partkey") % 4 == 0, "Payment of").when(F.col("p_partkey") % 4 == 1, "legal reference"), F.when(F.col("p_partkey") % 5 == 0, "not public, internal").when(F.col("p_partkey") % 5 == 1, "Public"), "p_name")
    active = F.when(F.col("p_partkey") % 3 == 0, " No ").when(F.col("p_partkey") % 3 == 1, "").otherwise("yes")
    explicit = B.first_alias({"kind": F.when(F.col("p_partkey") % 2 == 0, "N/A").otherwise(F.col("p_type")), "brand": F.col("p_brand")}, ("kind", "brand"))
    return table(spark, d, "part").select("p_partkey", *[c.alias(k) for k, c in B.derived_tags(t).items()], B.parse_bool(active).alias("active"), explicit.alias("explicit"))


def generic_accuracies(spark, d):
    office = B.office_accuracy(F.length("text"), F.col("n_chars"), F.col("doc_id") % 50, F.col("doc_id") % 7, F.col("doc_id") % 4)
    return table(spark, d, "documents").select("doc_id", B.generic_accuracy(F.col("text"), F.col("n_chars") * (F.col("doc_id") % 3)).alias("generic"), office.alias("o")).select("doc_id", "generic", "o.*")


def ocr_updates(spark, d):
    u = B.ocr_update(F.col("text"), (F.col("doc_id") % 100).cast("double"), F.lit("2024-01-01T00:00:00"), 300)
    keys = B.request_keys(F.lit(" s "), F.when(F.col("doc_id") % 4 == 0, " k "), F.when(F.col("doc_id") % 4 == 1, "h"), F.when(F.col("doc_id") % 4 == 2, F.col("doc_id")), F.lit(""), F.concat(F.lit("a/"), "source"))
    return table(spark, d, "documents").select("doc_id", u.alias("u"), keys.alias("k")).select("doc_id", "u.*", "k.file_key", "k.file_name")


QUERIES = {f.__name__: f for f in (
    queue_transitions, queue_enqueue, completed_items, first_completion, completed_page, completion_flags, worker_pools, processing_counts, stage_summary, failed_newest, recent_documents, file_info, state_matrix,
    document_candidates, embedded_parents, export_validation, document_reviews, review_storage, review_activity, review_purges, accept_payloads, page_breakdown, review_waterfall, segmentation_upsert, approved_features,
    filtered_documents, metadata_overlap, canonical_labels, deal_names, embedded_contents, extractor_metadata, derived_tags, generic_accuracies, ocr_updates,
)}

_R = """(select conv_id as doc_id, turn as page, case length(text) % 3 when 0 then 'accepted' when 1 then 'pending' else 'rejected' end as status, case when length(text) % 5 = 0 then 'logo' else 'text' end as snippet_type,
  (length(text) % 7)::double as impact, conv_id || '-' || turn as review_id from conversations where length(text) % 2 = 0)"""
_DATED = f"(select *, strftime(date '2024-01-01' + (page * 40)::int, '%Y-%m-%d') || 'T00:00:00' || case when doc_id % 2 = 0 then 'Z' else '' end as reviewed_at, 's/' || (doc_id % 10) || '-' || page as snippet_path from {_R} r)"
_EV = "(select event_id as id, ts, user_id as worker, case event_type when 'view' then 'discovery' when 'click' then 'extraction' when 'signup' then 'indexing' when 'purchase' then 'tagging' else 'ocr' end as stage, case when event_type = 'error' then 'failed' else 'completed' end as status, props as payload from events)"
_PARENTS = "(select d.*, l.doc_id is not null as is_embedded, coalesce('p' || (l.doc_id % 10), '') as parent from documents d left join (select distinct doc_id from labels where toxic = 1) l on l.doc_id = d.doc_id)"
_SHARES = """(select conv_id as doc_id, turn as page, w, conv_id % 2 = 0 and w <> 0 as known, w * 0.6::double as ta, w * 0.3::double as na, b / 100 as acc
  from (select *, (length(text) % 100)::double as w, (length(text) % 40 + 60)::double as b from conversations) c)"""
_BREAKDOWN = f"""select doc_id, page, case when known then w else ta * acc end as clean, case when known then 0 else ta * (1 - acc) end as faded, case when known then 0 else na * 0.3::double end as logo, case when known then 0 else na * 0.3::double end as stamp,
  case when known then 0 else na * 0.2::double end as handwritten, case when known then 0 else greatest(0, 100 - ta - na) end as whitespace, case when known then 0 else na * 0.2::double end as noise from {_SHARES} s"""
_BAR = lambda b, test: f"case when s.doc_id is not null and n_{b} > 0 then p_{b} else m.{b} end"
_TYPES = {"faded": "= 'faded_text'", "logo": "= 'logo'", "stamp": "= 'stamp'", "handwritten": "in ('handwritten', 'signature')", "noise": "= 'text_anomaly'"}
_cut = "case when length(text) > 5000 then text[:5000] || ' [truncated]' else text end"

SQL = {
    "queue_transitions": f"""with m as (select l_orderkey as id, max(case l_returnflag when 'A' then 0 when 'R' then 2 else 1 end) as k from lineitem where l_linenumber <= 2 group by 1)
select q.id, case k when 0 then 'completed' when 1 then 'failed' when 2 then 'pending' else status end as status, case when coalesce(k, 0) = 0 then claimed_at end as claimed_at, (priority % 3 + coalesce(k = 2, false)::int)::int as retry_count from {_Q} q left join m using (id)""",
    "queue_enqueue": f"select id, status, claimed_at, priority % 3 as retry_count from {_Q} q where id % 2 = 0 union all select o_orderkey, 'pending', null, 0 from orders where o_orderkey % 3 = 0 and o_orderkey % 2 <> 0",
    "completed_items": "select l_orderkey as id, l_quantity as took_ms, o_totalprice as size, false as is_duplicate, null::varchar as content_hash from lineitem join orders on l_orderkey = o_orderkey where l_linenumber = 1",
    "first_completion": "select l_partkey as hash, l_orderkey || '-' || l_linenumber as item from lineitem qualify row_number() over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber) = 1",
    "completed_page": f"select id, size from {_Q} q where status = 'completed' order by id limit 50 offset 100",
    "completion_flags": f"select 'discovery' as what, count(*) > 0 and count(*) filter (where status = 'pending') = 0 as complete from {_Q} q where priority = 1 union all select 'work', count(*) filter (where status in ('pending', 'processing')) = 0 from {_Q} q",
    "worker_pools": "select case when o_custkey % 4 < 2 then 'extraction' when o_custkey % 4 = 2 then 'ocr' else 'tagging' end as pool, count(distinct o_custkey) as workers from orders group by 1",
    "processing_counts": f"select case when (size * 200)::bigint < 1048576 then 'tiny' when (size * 200)::bigint < 10485760 then 'small' when (size * 200)::bigint < 52428800 then 'medium' else 'large' end as size_category, count(*) as n, count(distinct worker) as workers from {_Q} q where status = 'processing' group by 1",
    "stage_summary": f"select stage, 0::bigint as pending, 0::bigint as processing, count(*) filter (where status = 'completed') as completed, count(*) filter (where status = 'failed') as failed, count(*) filter (where status = 'completed') as total from {_EV} e group by stage",
    "failed_newest": f"select id, worker, payload from {_EV} e where status = 'failed' order by ts desc, id limit 100",
    "recent_documents": "select doc_id, source, n_chars from documents order by doc_id desc limit 20",
    "file_info": f"select * from {_Q} q where id = 7",
    "state_matrix": f"select id, status, claimed_at from {_Q} q order by claimed_at desc, id limit 200",
    "document_candidates": """with k as (select case doc_id % 3 when 0 then doc_id::varchar when 1 then 'file-' || doc_id else source || '/' || doc_id end as key from documents where doc_id % 4 <> 0)
select doc_id, coalesce((select key from k where key = doc_id::varchar limit 1), (select key from k where key = source || '/' || doc_id limit 1), (select key from k where key = 'file-' || doc_id limit 1)) as found from documents where doc_id % 5 <> 0""",
    "embedded_parents": f"select doc_id, source, parent, is_embedded from {_PARENTS} p",
    "export_validation": """with r as (select c_custkey, case when c_custkey % 7 = 0 then 'Undefined' when c_custkey % 5 = 0 then lower(c_mktsegment) else c_mktsegment end as category from customer)
select c_custkey, category, case when not (lower(category) in (select lower(c_mktsegment) from customer where c_mktsegment <> 'MACHINERY')) then 'category not allowed: ' || category end as warning from r""",
    "document_reviews": f"select doc_id, page, review_id, status, 'f' || doc_id as file_name from {_R} r where doc_id in (select doc_id from documents where doc_id % 3 <> 0)",
    "review_storage": f"select r.doc_id, count(*) filter (where status = 'pending') as pending, count(*) filter (where status = 'accepted') as accepted, count(*) filter (where status = 'rejected') as rejected, any_value(f.file_name) as file_name from {_R} r left join (select doc_id, 'f' || doc_id as file_name from documents where doc_id % 3 <> 0) f using (doc_id) group by r.doc_id",
    "review_activity": f"select id, worker, ts, stage from {_EV} e where worker % 2 = 0 order by ts desc, id limit 100",
    "review_purges": f"""select 'kept ' || status as kind, count(*) as n from {_DATED} r where status <> 'pending' or snippet_path in (select snippet_path from {_DATED} x where page % 2 = 0) group by 1
union all select 'purgeable ' || status, count(*) from {_DATED} r where status in ('accepted', 'rejected') and (reviewed_at < '2024-03-21T00:00:00Z' or replace(reviewed_at, 'Z', '') < '2024-03-21T00:00:00') group by 1""",
    "accept_payloads": "select conv_id, turn, length(text) % 2 <> 0 or (length(text) % 3 = 0 and trim(text) <> '') as acceptable from conversations",
    "page_breakdown": _BREAKDOWN,
    "review_waterfall": f"""with b as ({_BREAKDOWN}), m as (select doc_id, {", ".join(f"avg({x}) as {x}" for x in L.BARS)} from b group by doc_id),
r as (select doc_id, status, impact, (['logo', 'stamp', 'signature', 'faded_text', 'text_anomaly'])[page % 5 + 1] as kind from {_R} r),
s as (select doc_id, coalesce(sum(impact) filter (where status = 'accepted'), 0) as acc, {", ".join(f"count(*) filter (where kind {t}) as n_{x}, coalesce(sum(impact) filter (where kind {t} and status = 'pending'), 0) as p_{x}" for x, t in _TYPES.items())} from r group by doc_id),
v as (select m.doc_id, m.clean + coalesce(acc, 0) as clean, m.whitespace, {", ".join(f"{_BAR(x, t)} as {x}" for x, t in _TYPES.items())} from m left join s on m.doc_id = s.doc_id),
t as (select *, {" + ".join(L.BARS)} as total from v),
u as ({" union all ".join(f"select doc_id, {i} as i, '{x}' as bar, case when total > 0 then {x} * 100 / total else {100 if x == 'whitespace' else 0} end as value from t" for i, x in enumerate(L.BARS))})
select doc_id, bar, round(value, 6) as value, round(least(100, coalesce(sum(value) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)), 6) as bottom from u where value > 0.001::double""",
    "segmentation_upsert": "select l_suppkey as doc_id, l_partkey % 50 as page, arg_max(l_orderkey || '/' || l_linenumber, l_orderkey * 10 + l_linenumber) as v from lineitem group by 1, 2",
    "approved_features": f"select doc_id, review_id from {_R} r where status = 'accepted' and snippet_type <> 'text'",
    "filtered_documents": f"select doc_id, lang, case doc_id % 3 when 0 then '' else 'x' end as category from {_PARENTS} p where lang in ('en', 'de') and not is_embedded and doc_id % 3 <> 2",
    "metadata_overlap": """with a as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9\\p{L}]{4,}')) as w from documents), b as (select distinct item_id as row, unnest(regexp_extract_all(lower(text), '[a-z0-9\\p{L}]{4,}')) as w from benchmark)
select doc_id, row, overlap from (select doc_id, row, count(*) as overlap from a join b using (w) group by all having count(*) >= 3) x qualify row_number() over (partition by doc_id order by overlap desc, row) = 1""",
    "canonical_labels": """with v as (select n_nationkey, case when n_nationkey % 3 = 0 then 'the ' || lower(n_name) else lower(n_name) end as k from nation union all select r_regionkey + 100, lower(r_name) from region),
cap as (select w, array_to_string(list_transform(string_split(w, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') as c from (select n_name as w from nation union select r_name from region) x)
select n_nationkey, coalesce((select c from cap join nation on w = n_name where n_nationkey % 2 = 0 and v.k = 'the ' || lower(n_name) limit 1), (select c from cap join region on w = r_name where r_regionkey <> 2 and v.k = lower(r_name) limit 1), '') as canonical from v""",
    "deal_names": "select doc_id, coalesce(array_to_string(list_sort(list_filter([" + ", ".join(f"case when regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_]){x.lower().replace('(', chr(92) + '(').replace(')', chr(92) + ')')}($|[^\\p{{L}}\\p{{N}}_])') then '{x}' end" for x in DEALS if len(x) > 1) + "], lambda x: x is not null))[1:3], ', '), '') as deals from documents",
    "embedded_contents": f"""with e as (select doc_id, array_to_string(list_filter([{_cut}, text[:40]], lambda x: x <> ''), chr(10) || chr(10)) as t from documents)
select doc_id, case when length(t) <= 6000 then t else case when length(regexp_extract(t[:6000], '(?s)^(.*) ', 1)) > 4800 then regexp_extract(t[:6000], '(?s)^(.*) ', 1) else t[:6000] end || ' [content truncated]' end as embedded_content from e""",
    "extractor_metadata": """with x as (select doc_id, 'text/' || lang as mime, 'text/' || lang || '; charset=x' as content_type, case when doc_id % 2 = 0 and text[:10] <> '' then text[:10] end as title, case doc_id % 3 when 0 then doc_id::varchar when 1 then 'many' end as page_count from documents)
select doc_id, content_type, title, page_count, mime as mime_type, (2 + (title is not null)::int + (page_count is not null)::int)::int as fields from x""",
    "derived_tags": """with x as (select p_partkey, case when p_partkey % 2 = 0 then p_brand else p_type end as explicit, p_partkey % 3 <> 0 as active, p_partkey % 4 as a, p_partkey % 5 as b from part)
select p_partkey, case a when 0 then 'Finance' when 1 then 'Legal' end as department, case a when 0 then 'Payment' when 1 then 'Compliance' end as purpose, case a when 0 then 'Invoice' when 1 then 'Contract' end as category,
  case b when 0 then 'Internal' when 1 then 'Public' end as confidentiality, active, explicit from x""",
    "generic_accuracies": """with x as (select doc_id, octet_length(encode(text)) as bytes, length(text) as n, n_chars * (doc_id % 3) as size, n_chars + doc_id % 50 + doc_id % 7 as total, doc_id % 4 as images from documents)
select doc_id, round(case when size > 0 then least(bytes / size * 100, 100) else 0 end, 2) as generic, round(case when total > 0 then least(n / total * 100, 100) when n = 0 then 100 else 0 end, 2) as accuracy, round(case when total + images > 0 then total / (total + images * 60) * 100 else 100 end, 2) as text_area_pct from x""",
    "ocr_updates": """select doc_id, case when length(text) <= 300 then text else case when length(regexp_extract(text[:300], '(?s)^(.*) ', 1)) > 240 then regexp_extract(text[:300], '(?s)^(.*) ', 1) else text[:300] end || ' [content truncated]' end as ocr_content,
  (doc_id % 100)::double as ocr_confidence, true as ocr_completed, '2024-01-01T00:00:00' as ocr_updated_at, case doc_id % 4 when 0 then 'k' when 1 then 'h' when 2 then case when doc_id = 0 then '' else 'file-' || doc_id end else '' end as file_key, string_split(source, '/')[-1] as file_name from documents""",
}
