"""Index documents, archive lineage, stage batches and metadata schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import indexdocs, lineage, metadata, stages
from quire.session import scratch
from quire.sources.tables import table


def _extracted(spark, d):
    """documents as the extraction stage's JSON: lists as texts or lists, an embedded file or two, some broken or no object."""
    k = F.col("doc_id")
    hashed = F.when(k % 6 != 0, F.sha1(k.cast("string"))).otherwise("")
    same = [
        F.concat(F.lit("box/"), "source", F.lit("/"), k, F.when(k % 4 == 0, ".TXT").when(k % 4 == 1, ".tar.gz").otherwise("")).alias("file_path"), hashed.alias("file_hash"), F.sha1("text").alias("content_hash"), F.col("text").alias("main_content"), F.col("lang").alias("category"),
        F.col("n_chars").alias("file_size"), (k % 2 == 0).alias("needs_ocr"), F.create_map(F.lit("Author"), F.col("source")).alias("metadata"),
    ]
    texts = F.to_json(F.struct(*same, F.concat(F.lit(" x "), "lang", F.lit("; ,y|"), "source").alias("dynamic_subtags"), F.lit("A B; C").alias("key_names"), F.lit(7).alias("embedded_count"), F.lit("no list").alias("embedded_files")))
    files = F.array(F.struct(F.lit("in.doc").alias("name"), F.lit(1).alias("index"), F.substring("text", 1, 60).alias("content")), F.struct(F.lit("alt.doc").alias("name"), F.lit(2).alias("index"), F.lit("").alias("content")))
    lists = F.to_json(F.struct(*same, F.array("lang", "source").alias("dynamic_subtags"), F.lit(5).alias("key_names"), files.alias("embedded_files"), F.lit("DOC").alias("file_type")))
    whole = F.when(k % 3 == 0, texts).otherwise(lists)
    json = F.when(k % 11 == 0, F.substring(whole, 1, 40)).when(k % 13 == 0, F.concat(F.lit("["), whole, F.lit("]"))).when(k % 17 != 0, whole)
    return table(spark, d, "documents").select("doc_id", json.alias("json"))


def index_documents(spark, d):
    k = F.col("doc_id")
    docs = table(spark, d, "documents")
    parents = docs.where("doc_id % 5 = 0").select(F.sha1(k.cast("string")).alias("child_hash"), F.concat(F.lit("p"), k % 7).alias("parent_hash"))
    out = indexdocs.index_documents(_extracted(spark, d), "json", parents, F.lit("2024-01-01T00:00:00"), 2_000, 50)
    x = F.col("document")
    return out.select(
        "doc_id", x.isNotNull().alias("built"), x["file_path"].alias("file_path"), x["file_name"].alias("file_name"), indexdocs.document_key(x, k).alias("key"), F.sha2(x["main_content"], 256).alias("main_hash"), x["content_truncated"].alias("truncated"),
        x["content_original_length"].alias("length"), x["metadata"]["Author"].alias("author"), F.to_json(F.transform(x["embedded_files"], lambda f: f["name"])).alias("embedded"), x["embedded_count"].alias("embedded_count"), x["needs_ocr"].alias("needs_ocr"),
        F.array_join(x["dynamic_subtags"], "/").alias("subtags"), F.array_join(x["key_names"], "/").alias("names"), x["category"].alias("category"), x["file_type"].alias("file_type"), x["file_size"].alias("file_size"), x["embedded_content"].alias("embedded_content"),
        x["parent_file"].alias("parent_file"), x["is_embedded"].alias("is_embedded"),
    )


def archive_roots(spark, d):
    """orders as archives of archives: an order lies in the one of half its number, some lie in each other."""
    k = F.col("o_orderkey")
    nested = table(spark, d, "orders").where(k > 1).select(k.alias("child"), F.when(k % 1009 == 7, k + 1).when(k % 1009 == 8, k - 1).otherwise(F.floor(k / 2)).alias("parent")).where("parent % 37 <> 5")
    return lineage.roots(nested, scratch=scratch(spark))


def _sheets(spark, d):
    """part, customer and orders as sheets of one load, and a sheet of definitions that is left out."""
    k = F.col("p_partkey")
    parts = table(spark, d, "part").select(F.col("p_type").alias("Record Category"), F.when(k % 3 == 0, "N/A").otherwise(F.col("p_brand")).alias(" Business  UNIT"), F.col("p_name").alias("File Name"), F.lit("defined").alias("Definition"), F.col("p_size").alias("Tax Related"), F.lit("").alias("Commentary"), k.alias("part id"))
    c = F.col("c_custkey")
    people = table(spark, d, "customer").select(F.col("c_name").alias("Customer Name"), c.alias("Customer Number"), F.col("c_mktsegment").alias("domain"), F.when(c % 2 == 0, "/a/b").alias("old path"), F.lit("-").alias("Disposition"))
    orders = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("Creation Date"), F.col("o_orderkey").alias("ID"), F.col("o_orderpriority").alias("status"), F.col("o_orderpriority").alias("Purpose"))
    definitions = table(spark, d, "region").select(F.col("r_name").alias("Record Class"))
    return [metadata.sheet_rows(s, n) for n, s in (("Records", parts), ("People", people), ("Orders", orders), ("Metadata  definition", definitions))]


def metadata_schema(spark, d):
    """Columns of two loads, each profiled by itself, classified from the merged profiles."""
    records, *rest = _sheets(spark, d)
    second = rest[0]
    for s in rest[1:]:
        second = second.unionByName(s)
    out = metadata.schema(metadata.merged(metadata.profile(records), metadata.profile(second)))
    near = (F.col("distinct") >= F.col("filled") * 0.9).alias("mostly_distinct")
    return out.select("column", "role", "field", "kind", "filled", "placeholders", near)


def metadata_values(spark, d):
    """What each row of the first two sheets states: tags, keys, further cells."""
    records, people, *_ = _sheets(spark, d)
    rows = records.unionByName(people)
    flat = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    v = F.col("values")
    out = rows.select("sheet", flat(metadata.explicit_tags(v)).alias("tags"), flat(metadata.join_values(v)).alias("keys"), flat(metadata.extended_values(v)).alias("extended"))
    return out.groupBy("sheet", "tags", "keys", "extended").agg(F.count("*").alias("n"))


def discovery_batches(spark, d):
    """documents as files in three discovery batches, the last of them sent twice; the audit with state and queue."""
    k = F.col("doc_id")
    path = F.when(k % 23 != 0, F.concat(F.lit("in/"), "source", F.lit("/"), k.cast("string"), F.when(k % 2 == 0, ".TXT").otherwise("")))
    files = table(spark, d, "documents").select(
        k, path.alias("file_path"), F.concat(F.lit("f"), k, F.lit(".Md")).alias("file_name"), F.when(k % 29 != 0, F.col("n_chars") * 3000).alias("file_size"), F.when(k % 3 == 0, ".PDF").alias("extension"), F.sha1("text").alias("file_hash"),
        F.lit(1.0).alias("modified_time"), F.lit(2.0).alias("created_time"), F.element_at(F.array(*map(F.lit, (1, 5, 10, 4))), (F.floor(k / 7) % 4 + 1).cast("int")).alias("priority"),
    )
    root = scratch(spark)
    for batch in (0, 1, 2, 2):
        stages.discover(spark, root, files.where(k % 3 == batch).drop("doc_id"), batch, "w1", "2024-05-06T00:00:00Z")
    events, states, queue, taken = (stages.output(spark, root, x) for x in ("events", "states", "queue", "files"))
    same = ("batch", "file_key", "smart_id", "file_path", "file_type")
    rows = events.select(F.lit("event").alias("output"), *same, "status", F.coalesce("payload_json", "error_message").alias("detail"))
    rows = rows.unionByName(states.select(F.lit("state").alias("output"), *same, F.col("current_status").alias("status"), F.col("file_size").cast("string").alias("detail")))
    for name, t, key in (("queue", queue, F.lit("")), ("file", taken, F.col("file_hash"))):
        rows = rows.unionByName(t.select(F.lit(name).alias("output"), "batch", key.alias("file_key"), F.lit("").alias("smart_id"), "file_path", F.lit("").alias("file_type"), "status", F.concat_ws("/", "size_category", "priority").alias("detail")))
    return rows


QUERIES = {f.__name__: f for f in (index_documents, archive_roots, metadata_schema, metadata_values, discovery_batches)}

SQL = {
    "index_documents": r"""
with x as (select *, 'box/' || source || '/' || doc_id || case doc_id % 4 when 0 then '.TXT' when 1 then '.tar.gz' else '' end as path, case when doc_id % 6 <> 0 then sha1(doc_id::varchar) else '' end as hash, doc_id % 3 = 0 as t,
  not (doc_id % 11 = 0 or doc_id % 13 = 0 or doc_id % 17 = 0) as built, text[:2000] as head, text[:60] as part from documents),
y as (select *, case when length(text) <= 2000 then text else coalesce(nullif(case when length(regexp_extract(head, '(?s)^(.*) ', 1)) > 1600 then regexp_extract(head, '(?s)^(.*) ', 1) end, ''), head) || ' [content truncated]' end as main,
  case when length(part) <= 50 then part else case when length(regexp_extract(part[:50], '(?s)^(.*) ', 1)) > 40 then regexp_extract(part[:50], '(?s)^(.*) ', 1) else part[:50] end || ' [content truncated]' end as cut from x)
select doc_id, built, case when built then path end as file_path, case when built then doc_id || case doc_id % 4 when 0 then '.TXT' when 1 then '.tar.gz' else '' end end as file_name, case when built then coalesce(nullif(hash, ''), sha1(text)) else 'file-' || doc_id end as key,
  case when built then sha256(main) end as main_hash, case when built then length(text) > 2000 end as truncated, case when built then length(text) end as length, case when built then source end as author,
  case when built then case when t then '[]' else '["in.doc","alt.doc"]' end end as embedded, case when built then case when t then 7 else 2 end end as embedded_count, case when built then doc_id % 2 = 0 end as needs_ocr,
  case when built then case when t then 'x ' || lang || '/y/' || source else lang || '/' || source end end as subtags, case when built then case when t then 'A B/C' else '' end end as names, case when built then lang end as category,
  case when built then case when not t then 'DOC' when doc_id % 4 = 0 then 'txt' when doc_id % 4 = 1 then 'gz' else '' end end as file_type, case when built then n_chars end as file_size, case when built then case when t then '' else cut end end as embedded_content,
  case when built then case when doc_id % 5 = 0 and hash <> '' then 'p' || doc_id % 7 else '' end end as parent_file, case when built then doc_id % 5 = 0 and hash <> '' end as is_embedded from y""",
    "archive_roots": """
with recursive e as (select o_orderkey as child, case o_orderkey % 1009 when 7 then o_orderkey + 1 when 8 then o_orderkey - 1 else o_orderkey // 2 end as parent from orders where o_orderkey > 1),
p as (select * from e where parent % 37 <> 5),
w as (select child, parent as here, 1::bigint as depth from p union all select w.child, p.parent, depth + 1 from w join p on w.here = p.child where depth < 64),
r as (select child, here as root, depth from w where not exists (select 1 from p where p.child = w.here))
select p.child, root, depth from p left join r using (child)""",
    "metadata_schema": """
with c as (select 'record category' as k, p_type as v from part union all select 'business unit', case when p_partkey % 3 = 0 then 'N/A' else p_brand end from part union all select 'file name', p_name from part union all select 'definition', 'defined' from part
  union all select 'tax related', p_size::varchar from part union all select 'part id', p_partkey::varchar from part union all select 'customer name', c_name from customer union all select 'customer number', c_custkey::varchar from customer union all select 'domain', c_mktsegment from customer
  union all select 'old path', '/a/b' from customer where c_custkey % 2 = 0 union all select 'disposition', '-' from customer union all select 'creation date', (o_orderdate::date)::varchar from orders union all select 'id', o_orderkey::varchar from orders
  union all select 'status', o_orderpriority from orders union all select 'purpose', o_orderpriority from orders),
r as (select * from (values ('record category', 'tag', 'category', 'text'), ('business unit', 'tag', 'department', 'text'), ('file name', 'key', 'file_name', 'text'), ('definition', 'none', '', 'text'), ('tax related', 'extended', '', 'number'), ('part id', 'none', '', 'number'), ('customer name', 'extended', '', 'text'),
  ('customer number', 'extended', '', 'number'), ('domain', 'tag', 'department', 'text'), ('old path', 'none', '', 'text'), ('disposition', 'extended', '', 'empty'), ('creation date', 'extended', '', 'date'), ('id', 'key', 'doc_id', 'number'), ('status', 'extended', '', 'text'), ('purpose', 'tag', 'purpose', 'text')) v(k, role, field, kind))
select k as column, role, field, kind, count(*) as filled, count(*) filter (where v in ('N/A', '-')) as placeholders, count(distinct v) >= count(*) * 0.9 as mostly_distinct from c join r using (k) group by all""",
    "metadata_values": """
with x as (select 'Records' as sheet, 'category=' || p_type || case when p_partkey % 3 = 0 then '' else ';department=' || p_brand end as tags, 'doc_id=' || p_partkey || ';file_name=' || p_name as keys, 'tax related=' || p_size as extended from part
  union all select 'People', 'department=' || c_mktsegment, case when c_custkey % 2 = 0 then 'file_path=/a/b' else '' end, 'customer name=' || c_name || ';customer number=' || c_custkey from customer)
select *, count(*) as n from x group by all""",
    "discovery_batches": """
with f as (select doc_id % 3 as batch, case when doc_id % 23 <> 0 then 'in/' || source || '/' || doc_id || case when doc_id % 2 = 0 then '.TXT' else '' end end as path, case when doc_id % 29 <> 0 then n_chars * 3000 end as size, doc_id % 3 = 0 as pdf, sha1(text) as hash, [1, 5, 10, 4][doc_id // 7 % 4 + 1] as priority from documents),
e as (select *, case when path is null then 'no file path' when size is null then 'no file size' when priority = 4 then 'unknown priority' end as error from f),
g as (select *, row_number() over (partition by hash, error is null order by batch, path) as place from e),
k as (select *, case when size < 1048576 then 'tiny' when size < 10485760 then 'small' when size < 52428800 then 'medium' else 'large' end as category from g where error is not null or place = 1),
s as (select *, batch::int as b, 'DOC-20240506-' || upper(sha1(hash)[:4]) as smart_id, coalesce(path, '') as file_path, case when pdf then 'pdf' else 'md' end as file_type from k)
select 'event' as output, b as batch, hash as file_key, smart_id, file_path, file_type, case when error is null then 'completed' else 'failed' end as status, coalesce(error, '{"size_category":"' || category || '","priority":' || priority || '}') as detail from s
union all select 'state', b, hash, smart_id, file_path, file_type, case when error is null then 'pending' else 'failed' end, coalesce(size, 0)::varchar from s
union all select 'queue', b, '', '', file_path, '', 'pending', category || '/' || priority from s where error is null
union all select 'file', b, hash, '', file_path, '', 'pending', category || '/' || priority from s where error is null""",
}
