"""Queries over the search routes, small rules, Bloom filters and queue back-fill."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quire.functions import rules as R
from quire.operators import bloom, routes
from quire.operators.vectors import cosine
from quire.sources.tables import table

COMMANDS = (("uid", "PT-7"), ("ext", "pdf"), ("person", "widget"), ("category", "economy"), ("department", "Brand#13"), ("tag", "economy"))
ACCURATE = "of the report"
MARKED = ["the", "und"]


def _pick(of, *names):  # noqa: ANN001, ANN202
    return F.element_at(F.array(*[F.lit(n) for n in names]), (of % len(names) + 1).cast("int"))


def _index(spark, d):
    """part as an index of documents."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("id"), F.concat(F.lit("PT-"), k).alias("smart_id"), _pick(k, "pdf", "docx", "txt").alias("file_type"), _pick(k, "application/pdf", "text/plain").alias("mime_type"), F.concat("p_name", F.when(k % 4 == 0, ".pdf").otherwise(".doc")).alias("file_name"),
        F.concat(F.when(k % 2 == 0, "a\\").otherwise("a/"), "p_name").alias("file_path"), F.when(k % 7 != 0, F.col("p_type")).alias("category"), F.col("p_brand").alias("department"), F.col("p_name").alias("purpose"), F.split("p_name", " ").alias("key_names"),
        F.array("p_type", F.lower("p_type")).alias("dynamic_subtags"), (k % 11 == 0).alias("is_embedded"), F.col("p_size").cast("string").alias("main_content"),
    )


def _commands(spark, d, run):  # noqa: ANN001
    index = _index(spark, d)
    return reduce(lambda a, b: a.unionByName(b), [run(index, m, v).select(F.lit(m).alias("mode"), "id", "score") for m, v in COMMANDS])


def strict_slash_search(spark, d):
    return _commands(spark, d, routes.strict_slash)


def service_slash_search(spark, d):
    return _commands(spark, d, routes.slash)


def numeric_search(spark, d):
    return routes.numeric(_index(spark, d), "24", {"main_content": 2.0, "smart_id": 3.0}).select("id", "score")


def path_search(spark, d):
    return routes.path(_index(spark, d), "a\\cold", {"file_path": 1.0, "file_name": 2.0, "main_content": 3.0}).select("id", "score")


def accurate_boosts(spark, d):
    """The plain-terms route with constant boosts; accurate_search ranks by term statistics."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source", "lang")
    return routes.accurate(docs, ACCURATE, {"text": 2.0, "source": 5.0}, {"lang": ["en", "fr"]}).select("doc_id", "score")


def highlight_fragments(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(routes.fragments(F.col("text"), MARKED, 200, 3), "|").alias("fragments"))


def crop_rules(spark, d):
    n = F.length("text")
    kind = _pick(n, *R.VISUAL, "handwritten")
    ink, area, rows, columns = n % 90, n * 20, (n % 10) / 10, (n % 7) / 10
    fine = R.refined(kind, (n % 200).cast("double"), (n % 60).cast("double"), F.lit(1000.0))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", R.reviewer_role(kind).alias("role"), fine["kind"].alias("refined"), fine["role"].alias("refined_role"), R.text_like(kind, F.substring("text", F.lit(1), n % 12), (n % 100).cast("double")).alias("text_like"),
        R.sparse_noise(kind, ink, area, rows, columns).alias("noise"), R.sparse_noise(kind, n, n * 250, F.lit(0.5), F.lit(0.5), True).alias("strict_noise"),
    )


def recogniser_confidence(spark, d):
    row = lambda v: F.concat(F.repeat(F.lit("x\t"), 10), v)
    tsv = F.concat_ws("\n", row(F.lit("50")), row((F.length("text") % 100).cast("string")), row(F.lit("-1")), F.concat(row(F.col("turn").cast("string")), F.lit("\tend")), row(F.lit("none")), F.lit("short"))
    return table(spark, d, "conversations").select("conv_id", "turn", R.tsv_confidence(tsv).alias("confidence"), R.tsv_confidence(F.lit("only\thead")).alias("nothing"))


def control_rules(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    m = R.memory_thresholds(size.cast("double"), F.lit(20.0), (k % 40).cast("double"))
    batch = R.next_batch(size, (k % 30).cast("double"), 5.0, 20.0, 10, 5, 45, k % 13 == 0)
    return table(spark, d, "part").select("p_partkey", m["warning"].alias("warning"), m["critical"].alias("critical"), batch.cast("long").alias("batch"))


def coerced_values(spark, d):
    k = F.col("p_partkey")
    names = F.array(F.col("p_name"), F.when(k % 2 == 0, F.col("p_brand")), F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", R.joined_value(F.when(k % 5 != 0, names)).alias("joined"), R.payload_json(F.when(k % 3 != 0, F.struct("p_size", "p_brand"))).alias("payload"))


def embedded_pdfs(spark, d):
    f = lambda name, c: F.struct(name.alias("name"), c.alias("content"))
    files = F.array(f(F.lit("b.txt"), F.col("text")), f(F.when(F.col("doc_id") % 4 != 0, "z.PDF").otherwise("z.doc"), F.col("text")), f(F.when(F.col("doc_id") % 3 != 0, "m.pdf").otherwise("m.csv"), F.col("lang")))
    return table(spark, d, "documents").select("doc_id", R.embedded_pdf(files, "And").alias("pdf"))


def state_fields(spark, d):
    fields = R.state_fields({k: F.col(k) for k in ("smart_id", "category", "department", "purpose", "key_names")})
    return _index(spark, d).select("id", *[(F.array_join(c, "|") if k in ("key_names", "important_dates", "location_mentioned") else c).alias(k) for k, c in fields.items()])


BITS, HASHES = bloom.shape(1000, 0.01)


def bloom_members(spark, d):
    """The customers of urgent orders, in a filter of two merged halves, asked for all customers."""
    keys = table(spark, d, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("key"))
    halves = [bloom.build(keys.where(F.col("key") % 2 == i), "key", BITS, HASHES) for i in (0, 1)]
    return bloom.members(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), "key", bloom.merge(*halves), BITS, HASHES)


def semantic_similarity(spark, d):
    """Similarity to the next vector, held between 0 and 1."""
    e = table(spark, d, "embeddings")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    return pairs.select("vec_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col("embedding"), F.col("next")))), 4).alias("similarity"))


def tagging_backfill(spark, d):
    """Every indexed document as an item of the tagging queue; ids of the form file-<n> tell the file."""
    key = F.concat(F.when(F.col("doc_id") % 3 == 0, "x-").otherwise("file-"), F.col("doc_id"))
    docs = table(spark, d, "documents").select(key.alias("doc_key"), F.concat_ws("/", "source", "doc_id").alias("file_path"))
    number = F.regexp_extract("doc_key", r"^file-(\d+)$", 1)
    return docs.select("doc_key", "file_path", F.when(number != "", number.cast("long")).otherwise(0).alias("file_id"), F.lit(5).alias("priority"), F.lit("pending").alias("status"))


QUERIES = {f.__name__: f for f in (
    strict_slash_search, service_slash_search, numeric_search, path_search, accurate_boosts, highlight_fragments, crop_rules, recogniser_confidence, control_rules, coerced_values, embedded_pdfs, state_fields, bloom_members,
    semantic_similarity, tagging_backfill,
)}

_pos = lambda c, i: f"((('0x' || substr(md5({c}::varchar), 1, 8))::bigint + {i} * (('0x' || substr(md5({c}::varchar), 9, 8))::bigint | 1)) % {BITS})"
_tok = lambda c: f"list_filter(string_split_regex(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_kinds = "['signature', 'stamp', 'logo', 'text_anomaly', 'faded_text', 'handwritten']"
_term = lambda group: f"greatest(case when list_has_any(t, {group}) then 2 else 0 end, case when list_has_any(s, {group}) then 5 else 0 end)"

SQL = {
    "strict_slash_search": """with x as (select *, p_partkey as id, p_type as t from part where p_partkey % 11 <> 0)
select 'uid' as mode, id, 25::double as score from x where id = 7
union all select 'ext', id, s::double from (select id, (id % 3 = 0)::int * 20 + (id % 2 = 0)::int * 10 + (id % 4 = 0)::int * 5 as s from x) y where s > 0
union all select 'person', id, 15 from x where list_contains(string_split(p_name, ' '), 'widget')
union all select 'category', id, 25 from x where id % 7 <> 0 and lower(t) = 'economy'
union all select 'department', id, 30 from x where p_brand = 'Brand#13'
union all select 'tag', id, 25 from x where id % 7 <> 0 and t = 'ECONOMY'""",
    "service_slash_search": """with x as (select *, p_partkey as id from part)
select 'uid' as mode, id, 25::double as score from x where id = 7
union all select 'ext', id, s::double from (select id, (id % 3 = 0)::int * 20 + (id % 2 = 0)::int * 10 + (id % 4 = 0)::int * 5 as s from x) y where s > 0
union all select 'person', id, 5 from x where list_contains(string_split(p_name, ' '), 'widget')
union all select m, id, case when id % 7 <> 0 then 32 else 12 end from x, (values ('category'), ('tag')) v(m) where p_type = 'ECONOMY'
union all select 'department', id, 20 from x where p_brand = 'Brand#13'""",
    "numeric_search": "select p_partkey as id, (case when p_size = 24 then 22 else 0 end + case when p_partkey = 24 then 3 else 0 end)::double as score from part where p_size = 24 or p_partkey = 24",
    "path_search": "select p_partkey as id, (14 + case when p_partkey % 2 = 0 then 10 else 0 end)::double as score from part where p_name like 'cold%'",
    "accurate_boosts": f"""with x as (select doc_id, {_tok("text")} as t, {_tok("source")} as s, list_aggregate([' ' || array_to_string({_tok("text")}, ' ') || ' '], 'first') as line from documents where lang in ('en', 'fr')),
y as (select doc_id, line, {_term("['of']")} as a, {_term("['the']")} as b, {_term("['report', 'analysis', 'summary']")} as c from x)
select doc_id, (a + b + c + case when contains(line, ' of the report ') then 4 else 0 end)::double as score from y where (a > 0)::int + (b > 0)::int + (c > 0)::int >= 2""",
    "highlight_fragments": r"""with p as (select doc_id, unnest(regexp_extract_all(text, '(?s)\S(?:.{0,198}\S)?(?:\s|$)|\S{200}')) as p, generate_subscripts(regexp_extract_all(text, '(?s)\S(?:.{0,198}\S)?(?:\s|$)|\S{200}'), 1) as i from documents),
c as (select doc_id, i, rtrim(translate(p, chr(9) || chr(10) || chr(13), '   ')) as p, len(regexp_extract_all(p, '(?i)(the|und)')) as n from p),
b as (select * from c where n > 0 qualify row_number() over (partition by doc_id order by n desc, i) <= 3)
select d.doc_id, coalesce(f, '') as fragments from documents d left join (select doc_id, string_agg(regexp_replace(p, '(?i)(the|und)', '<mark>\1</mark>', 'g'), '|' order by n desc, i) as f from b group by 1) g on d.doc_id = g.doc_id""",
    "crop_rules": f"""with x as (select *, length(text) as n, {_kinds}[length(text) % 6 + 1] as k, length(text) % 100 as conf, text[:length(text) % 12] as t from conversations),
y as (select *, length(regexp_replace(t, '[^A-Za-z0-9]', '', 'g')) as an, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) as al, case when k = 'signature' and greatest(n % 200, 1) / greatest(n % 60, 1) < 2 and n % 60 > 20 then 'text_anomaly' else k end as fine from x)
select conv_id, turn, case k when 'handwritten' then 'Transcription Auditor' when 'faded_text' then 'Faded Text Specialist' when 'stamp' then 'Compliance Officer' when 'logo' then 'Brand Integrity Reviewer' else 'Reviewer' end as role, fine as refined,
  case fine when 'signature' then 'Contract Auditor' when 'stamp' then 'Operations Manager' when 'text_anomaly' then 'Text Specialist' else 'Marketing Reviewer' end as refined_role,
  k <> 'handwritten' and t <> '' and ((k = 'faded_text' and conf >= 70) or (an >= 4 and conf >= 18) or (an >= 7 and conf >= 12) or (k = 'signature' and al >= 6 and al / an >= 0.85 and conf >= 8)) as text_like,
  k in ('signature', 'text_anomaly') and (n % 90 = 0 or (n % 90) / (n * 20) <= 0.004 or ((n % 90) / (n * 20) < 0.01 and n % 10 < 4 and n % 7 < 4) or (n * 20 > 1500 and n % 90 < 60)) as noise,
  k in ('signature', 'text_anomaly') and (n = 0 or (n * 250 > 1500 and n < 60)) as strict_noise from y""",
    "recogniser_confidence": "select conv_id, turn, (length(text) % 100 + turn) / 2 as confidence, 0::double as nothing from conversations",
    "control_rules": """with x as (select *, greatest(p_size, p_partkey % 40 * 0.85::double) as w, greatest(20, p_partkey % 40 * 0.9::double) as c, p_partkey % 30 as s from part)
select p_partkey, w as warning, case when c <= w then w + 1 else c end as critical,
  case when p_partkey % 13 = 0 then least(p_size, greatest(p_size // 2, 5)) when s < 5 then least(p_size + 10, 45) when s > 20 then greatest(p_size - 10, 5) else p_size end::bigint as batch from x""",
    "coerced_values": """select p_partkey, case when p_partkey % 5 = 0 then '' else concat_ws(', ', p_name, case when p_partkey % 2 = 0 then p_brand end, p_type) end as joined,
  case when p_partkey % 3 = 0 then '{}' else '{"p_size":' || p_size || ',"p_brand":"' || p_brand || '"}' end as payload from part""",
    "embedded_pdfs": "select doc_id, case when doc_id % 4 <> 0 and contains(lower(text), 'and') then 'z.PDF' when doc_id % 3 <> 0 then 'm.pdf' when doc_id % 4 <> 0 then 'z.PDF' end as pdf from documents",
    "state_fields": """select p_partkey as id, 'PT-' || p_partkey as smart_id, case when p_partkey % 7 = 0 then '' else p_type end as category, p_brand as department, p_name as purpose, '' as amount_found, '' as confidentiality,
  replace(p_name, ' ', '|') as key_names, '' as important_dates, '' as location_mentioned, 0::double as tag_confidence from part""",
    "bloom_members": f"""with bits as (select distinct unnest([{", ".join(_pos("o_custkey", i) for i in range(HASHES))}]) as at from orders where o_orderpriority like '1%'),
asked as (select c_custkey as key, unnest([{", ".join(_pos("c_custkey", i) for i in range(HASHES))}]) as at from customer)
select key, bool_and(b.at is not null) as maybe from asked a left join bits b on a.at = b.at group by 1""",
    "semantic_similarity": "select a.vec_id, round(greatest(0, least(1, list_cosine_similarity(a.embedding::double[], b.embedding::double[]))), 4) as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
    "tagging_backfill": """select case when doc_id % 3 = 0 then 'x-' else 'file-' end || doc_id as doc_key, source || '/' || doc_id as file_path, case when doc_id % 3 = 0 then 0 else doc_id end as file_id, 5 as priority, 'pending' as status from documents""",
}
