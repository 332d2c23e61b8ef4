"""Queries over the search router, run modes, completions, logs, back-fills and document updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quire.operators import routes, runs
from quire.plans.routes import _index, _pick
from quire.sources.tables import table

SEARCHES = (("/ext pdf", {}), ("24", {"main_content": 2.0, "smart_id": 3.0}), ("a\\cold", {"file_path": 1.0, "file_name": 2.0, "main_content": 3.0}), ('"cold widget"', {"purpose": 2.0, "category": 1.0}), ("cold widget", {"purpose": 2.0, "category": 1.0}), ("!", {"purpose": 2.0}))
TOP = 10
STAMP = "2024-01-01"


def _union(parts):  # noqa: ANN001, ANN202
    return reduce(lambda a, b: a.unionByName(b), parts)


def routed_search(spark, d):
    """The first page of each search."""
    index = _index(spark, d)
    return _union([routes.find(index, q, boosts, size=TOP).select(F.lit(q).alias("query"), "id", "score") for q, boosts in SEARCHES])


def run_folders(spark, d):
    """Customers as folders, of which two thirds were seen and some have changed since."""
    folders = table(spark, d, "customer").select(F.col("c_name").alias("folder"), (F.col("c_custkey") * 10 + F.pmod(F.col("c_custkey"), F.lit(4)) / 8).alias("mtime"))
    seen = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_name").alias("folder"), (F.col("c_custkey") * 10 + (F.col("c_custkey") % 5 == 0).cast("int")).cast("double").alias("mtime"))
    return _union([runs.folders_to_scan(folders, seen, m).select(F.lit(m).alias("mode"), "folder") for m in ("full", "incremental")])


def synced_queue(spark, d):
    """Orders as a queue that is copied to one that has those of fivefold ids."""
    queue = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("processing").alias("status"))
    copied, after = runs.sync_pending(queue, queue.where("id % 5 = 0"))
    return after.join(copied.select("id", F.lit(True).alias("copied")), "id", "left").select("id", "status", F.coalesce("copied", F.lit(False)).alias("copied"))


def _done(spark, d):
    """Line items as completions of their orders' files; contents are shared by parts of a supplier."""
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.select(
        F.col("l_orderkey").alias("id"), F.when(F.col("l_partkey") % 9 != 0, F.concat_ws("-", "l_suppkey", F.col("l_partkey") % 50)).alias("hash"), (F.col("l_quantity") * 10 + F.col("l_linenumber")).cast("long").alias("size"),
        (F.unix_timestamp("l_shipdate") * 10 + F.col("l_linenumber")).alias("at"), (F.col("l_quantity") - 5).cast("long").alias("extract_ms"), F.col("l_linenumber").cast("long").alias("index_ms"), (F.col("l_returnflag") == "R").alias("is_duplicate"),
    ).groupBy("id", "hash", "at").agg(F.max(F.struct("size", "extract_ms", "index_ms", "is_duplicate")).alias("m")).select("id", "hash", "at", "m.*")


def completions_by_hash(spark, d):
    return runs.completions(_done(spark, d))


def completion_counters(spark, d):
    return runs.completion_counters(_done(spark, d))


def last_failures(spark, d):
    e = table(spark, d, "events")
    return runs.last_failures(e.select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), _pick(F.col("event_id"), "extraction", "ocr").alias("stage"), F.col("event_type").alias("error"), (F.col("event_id") % 4).alias("retries")))


def review_logs(spark, d):
    """Rows of the suppression log, the retry queue and the purge log, as text."""
    p, at = table(spark, d, "part"), F.lit(STAMP)
    snippets = p.select(F.concat(F.lit("PT-"), "p_partkey").alias("smart_id"), F.col("p_size").alias("page"), F.array(F.lit(0), "p_size").alias("box"), F.col("p_type").alias("kind"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("impact"))
    logs = {
        "suppressed": runs.suppression_rows(snippets, F.lit("Ann"), at),
        "retry": runs.retry_rows(p.where("p_partkey % 10 = 0").select(F.concat(F.lit("PT-"), "p_partkey").alias("smart_id"), F.col("p_partkey").cast("string").alias("review_id"), F.col("p_name").alias("payload")), at),
        "purge": runs.purge_row(p.select((F.col("p_size") * (1 << 20)).alias("size")), 30, at),
        "no purge": runs.purge_row(p.where("p_size < 0").select(F.col("p_size").alias("size")), 30, at),
    }
    return _union([rows.select(F.lit(name).alias("log"), F.concat_ws("|", *[F.col(c).cast("string") for c in rows.columns]).alias("line")) for name, rows in logs.items()])


def accuracy_backfill(spark, d):
    k = F.col("p_partkey")
    name = F.concat("p_name", _pick(k, ".docx", ".PDF", ".txt", ".rtf", ""))
    state = table(spark, d, "part").select(k.alias("file_key"), F.when(k % 11 != 0, F.concat(F.lit("/a.b/"), name)).alias("file_path"), F.lit("").alias("file_type"), (F.col("p_size") - 1).alias("file_size"), F.when(k % 4 != 0, (k % 4 - 1).cast("double")).alias("extraction_accuracy"))
    return runs.accuracy_backfill(state).select("file_key", "source", F.col("chars").cast("long").alias("chars"))


def flushed_updates(spark, d):
    """Texts as recognised contents; a third of the documents is not in the index yet, some have no id."""
    docs = table(spark, d, "documents")
    pending = docs.select(F.when(F.col("doc_id") % 7 != 0, F.col("doc_id").cast("string")).alias("doc_id"), F.col("text").alias("ocr_content"), F.lit(0.5).alias("ocr_confidence"))
    sent, waiting = runs.flush_updates(pending, docs.where("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("doc_id")))
    return _union([rows.select(F.lit(state).alias("state"), "doc_id", F.length("ocr_content").alias("chars")) for state, rows in (("sent", sent), ("waiting", waiting))])


def document_updates(spark, d):
    k = F.col("p_partkey")
    tags = table(spark, d, "part").select(k.alias("id"), F.col("p_type").alias("category"), F.split("p_name", " ").alias("key_names"), F.when(k % 3 != 0, k % 2 == 0).alias("review_required"), F.when(k % 4 != 0, F.col("p_size") / 64).alias("tag_confidence_overall"), F.col("p_brand").alias("extra"))
    out = runs.document_update(tags, "id")
    return out.select("id", "category", F.array_join("key_names", "|").alias("key_names"), "department", "review_required", "forced_flag", "tag_confidence_overall", "tag_confidence", F.lit(len(out.columns) - 1).alias("fields"))


def single_row_metadata(spark, d):
    docs, regions = table(spark, d, "nation").select("n_nationkey"), table(spark, d, "region").select("r_name")
    one = runs.only_row(docs, regions.where("r_name = 'ASIA'"))
    return runs.only_row(one, regions, "many").select("n_nationkey", F.col("metadata.r_name").alias("one"), F.col("many.r_name").alias("many"))


def field_evidence(spark, d):
    k = F.col("p_partkey")
    label, entities = _pick(k, "Finance", "Legal", "HR"), F.when(k % 5 != 0, F.array(_pick(k, "MONEY", "LAW"), _pick(k, "PERCENT", "LAW", "ORG")))
    points = lambda model: F.round(runs.evidence_points(label, (F.col("p_size") - 5) / 50, F.when(k % 2 == 0, F.col("p_size") % 6), entities, model), 6)
    return table(spark, d, "part").select("p_partkey", points(True).alias("points"), points(False).alias("without_model"))


QUERIES = {f.__name__: f for f in (
    routed_search, run_folders, synced_queue, completions_by_hash, completion_counters, last_failures, review_logs, accuracy_backfill, flushed_updates, document_updates, single_row_metadata, field_evidence,
)}

_top = lambda q, score, where: f"(select '{q}' as query, id, ({score})::double as score from x where {where} order by 3 desc, 2 limit {TOP})"
_ext = "(id % 3 = 0)::int * 20 + (id % 2 = 0)::int * 10 + (id % 4 = 0)::int * 5"
_words = "contains(p_name, 'cold')::int + contains(p_name, 'widget')::int"
_done_sql = """d as (select l_orderkey as id, case when l_partkey % 9 <> 0 then l_suppkey || '-' || l_partkey % 50 else l_orderkey::varchar end as hash, (l_quantity * 10 + l_linenumber)::bigint as size, epoch(l_shipdate)::bigint * 10 + l_linenumber as "at",
  greatest((l_quantity - 5)::bigint, 0) as extract_ms, l_linenumber::bigint as index_ms, l_returnflag = 'R' as is_duplicate from lineitem
  qualify row_number() over (partition by l_orderkey, case when l_partkey % 9 <> 0 then l_suppkey || '-' || l_partkey % 50 end, epoch(l_shipdate)::bigint * 10 + l_linenumber order by l_quantity desc, l_returnflag = 'R' desc) = 1),
c as (select hash, first(extract_ms order by "at", id) as extract_ms, first(index_ms order by "at", id) as index_ms, first(is_duplicate order by "at", id) as is_duplicate, last(id order by "at", id) as id, last(size order by "at", id) as size, max("at") as "at" from d group by 1)"""

SQL = {
    "routed_search": "with x as (select *, p_partkey as id from part) "
    + " union all ".join((
        _top("/ext pdf", _ext, f"id % 11 <> 0 and {_ext} > 0"),
        _top("24", "case when p_size = 24 then 22 else 0 end + case when id = 24 then 3 else 0 end", "p_size = 24 or id = 24"),
        _top("a\\cold", "14 + case when id % 2 = 0 then 10 else 0 end", "p_name like 'cold%'"),
        _top('"cold widget"', "2", "p_name = 'cold widget'"),
        _top("cold widget", f"2 * ({_words}) + case when p_name = 'cold widget' then 4 else 0 end", f"{_words} > 0"),
    )),
    "run_folders": """select 'full' as mode, c_name as folder from customer union all select 'incremental', c_name from customer where c_custkey % 3 = 0 or c_custkey % 5 = 0""",
    "synced_queue": "select o_orderkey as id, case when o_orderstatus = 'O' then 'synced' else 'processing' end as status, o_orderstatus = 'O' and o_orderkey % 5 <> 0 as copied from orders",
    "completions_by_hash": f"with {_done_sql} select * from c",
    "completion_counters": f"""with {_done_sql}, f as (select first(size order by "at", size) as size from d group by id)
select count(*) as completed, sum(extract_ms)::bigint as extract_ms, sum(index_ms)::bigint as index_ms, count_if(is_duplicate) as duplicates, (select count(*) from f) as files, (select sum(size)::bigint from f) as bytes from c""",
    "last_failures": """select user_id as id, count(*) as failures, last(event_type order by event_id) as error, max(event_id) as "at", case when max(event_id) % 2 = 0 then 'extraction' else 'ocr' end as stage, max(event_id) % 4 as retries from events group by 1""",
    "review_logs": f"""select 'suppressed' as log, concat_ws('|', 'PT-' || p_partkey, p_size, '[0,' || p_size || ']', 'Ann', p_type, case when p_partkey % 3 <> 0 then p_size else 0 end::double, '{STAMP}') as line from part
union all select 'retry', concat_ws('|', 'PT-' || p_partkey, p_partkey, p_name, 'pending', 0, '{STAMP}') from part where p_partkey % 10 = 0
union all select 'purge', 'system_purge|system|snippet_purged|System|Purged ' || count(*) || ' snippet files older than 30 days, freed ' || sum(p_size) || '.00 MB|{STAMP}|all|system_cleanup' from part""",
    "accuracy_backfill": """with x as (select *, p_partkey % 5 as e from part where p_partkey % 4 in (0, 1))
select p_partkey as file_key, case when p_partkey % 11 = 0 then 'skip' when e in (2, 4) then 'text' else 'size' end as source, case when p_partkey % 11 <> 0 and e in (0, 1, 3) then greatest(1, (p_size - 1) // case when e = 0 then 2 else 3 end) end::bigint as chars from x""",
    "flushed_updates": f"select case when doc_id % 3 <> 0 then 'sent' else 'waiting' end as state, doc_id::varchar as doc_id, case when doc_id % 3 <> 0 then length(text) else least(length(text), {runs.MOST_PENDING_CHARS}) end as chars from documents where doc_id % 7 <> 0",
    "document_updates": """select p_partkey as id, p_type as category, replace(p_name, ' ', '|') as key_names, null::varchar as department, p_partkey % 3 <> 0 and p_partkey % 2 = 0 as review_required, false as forced_flag,
  case when p_partkey % 4 <> 0 then p_size / 64 else 0 end::double as tag_confidence_overall, case when p_partkey % 4 <> 0 then p_size / 64 else 0 end::double as tag_confidence, 38 as fields from part""",
    "single_row_metadata": "select n_nationkey, 'ASIA' as one, null::varchar as many from nation",
    "field_evidence": """with x as (select *, greatest(p_size - 5, 0) / 50 as s, case when p_partkey % 2 = 0 then p_size % 6 else 0 end as c, p_partkey % 5 <> 0 as told, p_partkey % 2 = 0 as money, p_partkey % 3 as r from part)
select p_partkey, round(0.3 * s + least(c * 0.08, 0.25) + case when not told then 0 when r = 0 then (money::int + 1) * 0.1 when r = 1 then 0.1 else 0 end, 6)::double as points, round(0.2 * s, 6)::double as without_model from x""",
}
