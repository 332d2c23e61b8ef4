"""Small rules and their tables: snippets, record formats, zones, recognition coverage, siblings, accuracy updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import accuracy as A
from quire.functions import measures as M
from quire.functions import text as T
from quire.operators import ocr, review, runs, search, state, tagging
from quire.sources.tables import table
from quire.streaming import jobs

UNITS = ["Energy - Grid", "Energy - Wind", "Energy - Multiple", "Aviation - Engines", "Aviation - Parts"]
SCOPE = {"EN": ("energy",), "AV": ("aviation",)}


def _docs(spark, d):
    return table(spark, d, "documents"), F.col("doc_id")


def snippet_choices(spark, d):
    docs, k = _docs(spark, d)
    part = F.concat(F.when(k % 8 == 0, "docProps ").otherwise(""), F.substring("text", F.lit(1), (k % 100).cast("int")))
    x = search.snippet_choice(F.when(k % 10 == 0, F.concat(F.lit("R "), "lang")), F.when(k % 3 == 0, F.col("text")).when(k % 3 == 1, F.lit("  ")), F.when(k % 4 == 0, part), F.when(k % 5 == 0, F.col("lang")), F.col("source"))
    return docs.select("doc_id", F.sha1(x["snippet"]).alias("snippet_hash"), x["field"].alias("field"))


def record_places(spark, d):
    docs, k = _docs(spark, d)
    body = F.concat(F.when(k % 7 == 0, "hello\n subject :").when(k % 7 == 1, "on SharePoint ").when(k % 7 == 2, "see box.com/x ").when(k % 7 == 3, "an Application of the SYSTEM ").otherwise(""), "text")
    path = F.when(k % 5 == 0, "\\\\srv\\x").when(k % 5 == 1, "/sites/sharepoint/y").otherwise("/z")
    form = T.record_format(F.when(k % 3 != 0, F.col("text")).otherwise(" "), F.when(k % 2 == 0, F.lit("x")), F.when(k % 4 == 0, "Image/PNG").otherwise("text/plain"))
    return docs.select("doc_id", form.alias("format"), T.location_type(body, path).alias("place"))


def sub_business_units(spark, d):
    docs, k = _docs(spark, d)
    body = F.concat(F.when(k % 5 == 0, "the wind, ").when(k % 5 == 1, "GRID and parts ").when(k % 5 == 2, "engines; ").otherwise(""), F.col("lang"))
    return docs.select("doc_id", tagging.sub_units(body, UNITS, SCOPE, F.when(k % 3 == 0, "EN").when(k % 3 == 1, "AV").otherwise("none")).alias("unit"))


def zone_losses(spark, d):
    q, disc, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    x = A.loss_breakdown({"clean_text": q, "stamp": disc * 200, "noise": tax * 300}, disc * 10 + 0.5)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(x["clean_text"], 6).alias("clean_text"), F.round(x["stamp"], 6).alias("stamp"), F.round(x["noise"], 6).alias("noise"), F.round(x["whitespace"], 6).alias("whitespace"), A.total_chars(F.lit(2480), q.cast("long") * 7, (q * 2).cast("long") % 101).alias("chars"))


def page_crops(spark, d):
    k, q = F.col("l_partkey") % 1000, F.col("l_quantity").cast("long")
    box = F.array(k, q * 10, k + q, q * 11)
    wide, high = F.when(q % 3 != 0, F.lit(1000)), F.when(q % 4 != 0, F.lit(2000))
    norm, pad = A.normalised_box(box, wide, high), A.padded_box(box, F.lit(1020).cast("long"), F.lit(540).cast("long"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.get(norm, F.lit(i)).alias(f"n{i}") for i in range(4)], *[F.get(pad, F.lit(i)).alias(f"p{i}") for i in range(4)])


def recognition_coverage(spark, d):
    words = table(spark, d, "conversations").select("conv_id", F.posexplode(F.split("text", " ")).alias("i", "word"))
    return ocr.coverage(words.select("conv_id", F.when(F.col("i") % 2 == 0, "raw").otherwise("processed").alias("variant"), "word", (F.length("word") * 17 % 100).cast("double").alias("confidence")), "conv_id")


def page_means(spark, d):
    n = F.length("text")
    pages = table(spark, d, "conversations").select("conv_id", (n % 100).cast("double").alias("confidence"), (n % 30).cast("double").alias("skew"), n.cast("long").alias("chars"))
    return ocr.page_metrics(pages, "conv_id", ["confidence", "skew"], ["chars"])


def text_densities(spark, d):
    docs, k = _docs(spark, d)
    x = A.pdf_accuracy(F.col("n_chars"), k % 5)
    return docs.select("doc_id", x["density"].alias("density"), x["area"].alias("area"))


def listed_values(spark, d):
    docs, _ = _docs(spark, d)
    raw = F.concat(F.lit(" a b;, "), "lang", F.lit(" | "), "source", F.lit(";"))
    return docs.select("doc_id", F.array_join(T.split_values(raw), "/").alias("three"), F.array_join(T.split_values(raw, ",;"), "/").alias("two"))


def sibling_tags(spark, d):
    k = F.col("vec_id")
    e = table(spark, d, "embeddings")
    kind = F.element_at(F.array(*map(F.lit, ("signature", "stamp", "logo", "text"))), (k % 4 + 1).cast("int"))
    reviews = e.select(k.alias("review_id"), (k % 40).alias("doc_id"), kind.alias("snippet_type"), F.when(k % 3 == 0, "accepted").otherwise("pending").alias("status"))
    pairs = e.select(k.alias("a"), F.explode(F.array(*[F.lit(s).cast("long") for s in (40, 50, 80, 120)])).alias("s")).select("a", (F.col("a") + F.col("s")).alias("b"), ((F.col("a") * 7 + F.col("s")) % 20 / 100 + 0.81).alias("s"))
    return review.auto_tag_siblings(reviews, pairs)


def accuracy_updates(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("file_key"), F.col("c_acctbal").alias("extraction_accuracy"), F.when(F.col("c_custkey") % 3 == 0, 50.0).alias("enhanced_accuracy"), F.col("c_mktsegment").alias("accuracy_tier"))
    new = table(spark, d, "orders").groupBy((F.col("o_custkey") + 7).alias("file_key")).agg(F.max("o_totalprice").alias("extraction_accuracy"), F.min("o_totalprice").alias("enhanced_accuracy"))
    return state.accuracy_update(base, new, "file_key")


def users_seen_once(spark, d):
    """The users of the event stream, each once, with state that outlives a restart."""
    return jobs.run_once(jobs.first_seen(jobs.event_stream(spark, d).select("user_id", "ts"), "user_id", "36500 days").select("user_id"), "append")


_EXTENSIONS = ("txt", "csv", "md", "json", "xml", "html", "docx", "xlsx", "pdf", "rtf")


def format_measures(spark, d):
    """documents as files of every format, office files with counts or, one in four, unopened."""
    docs, k = _docs(spark, d)
    ext = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (k % 10 + 1).cast("int"))
    path = F.concat(F.lit("a.b/"), F.col("source"), F.lit("."), ext)
    raw = F.when(k % 10 == 3, F.concat(F.lit('{"a": ["'), F.col("text"), F.lit('", 1]}'))).otherwise(F.concat(F.lit("<p><IMG src=x>"), F.col("text"), F.lit("</p>  <img>")))
    n = F.col("n_chars")
    counts = F.when(k % 4 != 0, F.struct((n / 2).cast("long").alias("paragraph_chars"), F.lit(10).alias("table_chars"), F.lit(5).alias("header_chars"), (k % 5).alias("images"), (k % 9).alias("text_cells"), (k % 6).alias("number_cells"), F.lit(20).alias("cells"), n.alias("cell_chars"), (k % 7).alias("pages")))
    m = M.measures(path, F.col("text"), raw, n * (k % 3), counts)
    out = docs.select("doc_id", m.alias("m"), path.alias("path"))
    loss = F.array_join(F.array_sort(F.map_keys("m.loss")), ",")
    return out.select("doc_id", "m.extraction_accuracy", "m.text_area_pct", "m.raw_char_count", "m.processed_char_count", loss.alias("loss"), F.size(M.page_measures(F.col("m"), F.col("path"))).alias("pages"))


def accuracy_recomputed(spark, d):
    docs, k = _docs(spark, d)
    path = F.when(k % 8 != 0, F.concat(F.lit("f/"), k, F.element_at(F.array(*map(F.lit, (".txt", ".pdf", ".docx"))), (k % 3 + 1).cast("int"))))
    rows = docs.select(k.alias("file_key"), path.alias("file_path"), F.lit("").alias("file_type"), F.col("n_chars").alias("file_size"), F.when(k % 5 == 0, 88.0).when(k % 5 == 1, 0.0).alias("extraction_accuracy"))
    texts = docs.where("doc_id % 7 <> 0").select(path.alias("file_path"), F.lower("text").alias("text"))
    return runs.recomputed_accuracy(rows, texts).select("file_key", "extraction_accuracy", "processed_char_count")


QUERIES = {f.__name__: f for f in (snippet_choices, record_places, sub_business_units, zone_losses, page_crops, recognition_coverage, page_means, text_densities, listed_values, sibling_tags, accuracy_updates, users_seen_once, format_measures, accuracy_recomputed)}

SQL = {
    "snippet_choices": """with x as (select doc_id, case when doc_id % 10 = 0 then 'R ' || lang end as r, case doc_id % 3 when 0 then text when 1 then '  ' end as m, case when doc_id % 4 = 0 then case when doc_id % 8 = 0 then 'docProps ' else '' end || text[:doc_id % 100] end as e, case when doc_id % 5 = 0 then lang end as o, source as n from documents),
y as (select *, case when trim(coalesce(r, '')) <> '' then 'reviewed' when trim(coalesce(m, '')) <> '' then 'main_content' when length(e) > 50 and not contains(e, 'docProps') then 'embedded_content' when trim(coalesce(o, '')) <> '' then 'ocr_content' else 'file_name' end as field from x)
select doc_id, sha1(case field when 'reviewed' then r when 'main_content' then m when 'embedded_content' then e when 'ocr_content' then o else n end) as snippet_hash, field from y""",
    "record_places": r"""with x as (select doc_id, case doc_id % 7 when 0 then 'hello' || chr(10) || ' subject :' when 1 then 'on SharePoint ' when 2 then 'see box.com/x ' when 3 then 'an Application of the SYSTEM ' else '' end || text as b, case doc_id % 5 when 0 then '\\srv\x' when 1 then '/sites/sharepoint/y' else '/z' end as p, text from documents)
select doc_id, case when doc_id % 2 = 0 and (doc_id % 3 = 0 or doc_id % 4 = 0 or trim(text) = '') then 'Physical' else 'Electronic' end as format,
  case when regexp_matches(b, '(?i)(^|\n)\s*(From|To|Subject|Date|Sent|Cc)\s*:') then 'Email' when contains(lower(b), 'sharepoint') or contains(p, 'sharepoint') then 'SharePoint' when contains(lower(b), 'box.com') then 'Box'
    when contains(p, '\\') then 'Shared Drive' when contains(lower(b), 'application') and (contains(lower(b), 'system') or contains(lower(b), 'platform')) then 'Application' else 'Shared Drive' end as place from x""",
    "sub_business_units": """select doc_id, case doc_id % 3 when 0 then case doc_id % 5 when 0 then 'Energy - Wind' when 1 then 'Energy - Grid' else 'Energy - Multiple' end
  when 1 then case doc_id % 5 when 1 then 'Aviation - Parts' when 2 then 'Aviation - Engines' else 'Aviation - Engines' end else '' end as unit from documents""",
    "zone_losses": """with x as (select *, l_discount * 10 + 0.5 as r from lineitem)
select l_orderkey, l_linenumber, round(l_quantity * r, 6) as clean_text, round(l_discount * 200 * r, 6) as stamp, round(l_tax * 300 * r, 6) as noise, round(greatest(100 - (l_quantity + l_discount * 200 + l_tax * 300) * r, 0), 6) as whitespace,
  greatest(floor(2480 * (l_quantity::bigint * 7) * ((l_quantity * 2)::bigint % 101) / 100 / 420), 1)::bigint as chars from x""",
    "page_crops": """with x as (select l_orderkey, l_linenumber, l_partkey % 1000 as k, l_quantity::bigint as q from lineitem), y as (select *, case when q % 3 <> 0 then 1000 else 2480 end as w, case when q % 4 <> 0 then 2000 else 3508 end as h, greatest(floor(q * 0.08), 1)::bigint as g from x)
select l_orderkey, l_linenumber, round(k / w, 6) as n0, round(q * 10 / h, 6) as n1, round((k + q) / w, 6) as n2, round(q * 11 / h, 6) as n3,
  greatest(k - g, 0) as p0, greatest(q * 10 - g, 0) as p1, least(k + q + g, 1020) as p2, least(q * 11 + g, 540) as p3 from y""",
    "recognition_coverage": """with w as (select conv_id, unnest(string_split(text, ' ')) as word, generate_subscripts(string_split(text, ' '), 1) - 1 as i from conversations),
s as (select conv_id, coalesce(sum(length(trim(word))) filter (where i % 2 = 0 and length(word) * 17 % 100 > 30), 0)::bigint as raw_chars, coalesce(sum(length(trim(word))) filter (where i % 2 = 1 and length(word) * 17 % 100 > 30), 0)::bigint as processed_chars from w group by 1)
select *, case when raw_chars = 0 then 0 else (processed_chars - raw_chars) * 100.0::double / raw_chars end as gain_percent from s""",
    "page_means": "select conv_id, count(*) as pages, avg(length(text) % 100)::double as avg_confidence, avg(length(text) % 30)::double as avg_skew, sum(length(text))::bigint as sum_chars from conversations group by 1",
    "text_densities": "select doc_id, x as density, x * 85 as area from (select doc_id, case when doc_id % 5 > 0 then least(n_chars / (doc_id % 5) / 2500.0::double, 1) else 0 end as x from documents) y",
    "listed_values": "select doc_id, 'a b/' || lang || '/' || source as three, 'a b/' || lang || ' | ' || source as two from documents",
    "sibling_tags": """with r as (select vec_id as id, vec_id % 40 as doc, ['signature', 'stamp', 'logo', 'text'][vec_id % 4 + 1] as kind, vec_id % 3 = 0 as accepted from embeddings),
p as (select vec_id as a, vec_id + s as b, (vec_id * 7 + s) % 20 / 100 + 0.81 as s from embeddings, (values (40), (50), (80), (120)) v(s))
select b as review_id, arg_max(x.kind, (p.s, -a)) as label from p join r x on x.id = a and x.accepted and x.kind <> 'text' join r y on y.id = b and not y.accepted and y.kind <> 'text' where x.doc = y.doc and p.s >= 0.9 group by 1""",
    "accuracy_updates": """with n as (select o_custkey + 7 as k, max(o_totalprice) as a, min(o_totalprice) as e from orders group by 1)
select c_custkey as file_key, coalesce(a, c_acctbal) as extraction_accuracy, coalesce(case when c_custkey % 3 = 0 then 50.0::double end, e) as enhanced_accuracy, c_mktsegment as accuracy_tier from customer left join n on k = c_custkey""",
    "format_measures": r"""with x as (select doc_id, text, n_chars * (doc_id % 3) as size, doc_id % 10 as e, doc_id % 4 <> 0 as opened, length(text) as n, octet_length(encode(text)) as b, doc_id % 9 as tc, doc_id % 6 as nc, n_chars // 2 + 15 as w, greatest(case when doc_id % 4 <> 0 then doc_id % 7 else 0 end, 1) as pages,
  n_chars, doc_id % 5 as images, case when doc_id % 10 = 3 then '{"a": ["' || text || '", 1]}' else '<p><IMG src=x>' || text || '</p>  <img>' end as raw from documents),
y as (select *, case e when 3 then length(regexp_replace(raw, '[^{}\[\]",:]', '', 'g')) else length(raw) - length(regexp_replace(raw, '<[^>]+>', '', 'g')) end as cut, length(trim(regexp_replace(regexp_replace(raw, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) as stripped from x),
z as (select *, length(raw) - floor(length(raw) * (cut / length(raw) * 100) / 100 + 1e-9) as expected, least(n / pages / 2500.0::double, 1) as density, case when e = 6 and opened then 'w' when e = 7 and opened then 'x' when e in (6, 7, 9) then 'g' when e < 3 then 't' when e < 5 then 's' when e = 5 then 'h' else 'p' end as f from y)
select doc_id, round(least(case f when 't' then case when size = 0 then 0 else b / size * 100 end when 's' then n / greatest(expected, 1) * 100 when 'h' then n / greatest(stripped, 1) * 100 when 'w' then n / w * 100 when 'x' then n / greatest(n_chars, 1) * 100 when 'p' then density * 100 else case when size = 0 then 0 else b / size * 100 end end, 100), 2) as extraction_accuracy,
  round(case f when 't' then case when size = 0 then 0 else 100 - case e when 1 then 5 when 2 then 3 else 0 end end when 's' then 100 - cut / length(raw) * 100 when 'h' then (length(raw) - cut) / length(raw) * 100 when 'w' then w / (w + images * 60) * 100 when 'x' then (tc + nc) / 20 * 100 when 'p' then density * 85 else 95 end, 2)::double as text_area_pct,
  (case f when 's' then expected when 'h' then stripped when 'w' then w when 'x' then n_chars else n end)::bigint as raw_char_count, n as processed_char_count,
  case f when 't' then 'format,syntax_overhead_pct' when 's' then 'format,syntax_overhead_pct' when 'h' then 'embedded_images,html_tags_pct,image_area_estimate_pct' when 'w' then 'image_area_pct,images' when 'x' then 'empty_cell_pct,empty_cells,number_cells,text_cells,total_cells'
    when 'p' then 'chars_per_page,low_text_warning,page_count,text_density' else 'format,method' end as loss, case when f = 'p' then pages when e in (6, 7) then 1 when f = 'g' then 0 else 1 end as pages from z""",
    "accuracy_recomputed": """with x as (select *, doc_id % 3 as e, greatest(1, n_chars // case doc_id % 3 when 1 then 3 else 2 end) as chars from documents where doc_id % 8 <> 0 and doc_id % 5 <> 0)
select doc_id as file_key, round(least(case e when 0 then case when n_chars = 0 then 0 else octet_length(encode(lower(text))) / n_chars * 100 end when 1 then least(chars / 2500.0::double, 1) * 100 else case when n_chars = 0 then 0 else chars / n_chars * 100 end end, 100), 2) as extraction_accuracy,
  case e when 0 then length(lower(text)) else chars end as processed_char_count from x where e <> 0 or doc_id % 7 <> 0""",
    "users_seen_once": "select distinct user_id from events",
}
