"""Reports, reviews, search and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import accuracy as A
from quire.functions import analysis
from quire.functions.text import format_size, seconds_to_human, snippet
from quire.operators import ocr, review, search, vectorindex, vectors
from quire.operators.quantiles import exact_quantile
from quire.session import scratch
from quire.sources.tables import registry, table



def facet_terms(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy("source").limit(100)


def facet_union(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.trim("source").alias("value")).unionByName(docs.select(F.trim("lang").alias("value"))).where("value <> ''").distinct()


def value_counts_share(spark, d):
    docs = table(spark, d, "documents")
    by = docs.groupBy(F.when(F.trim(F.coalesce("lang", F.lit(""))) == "", "(blank)").otherwise(F.col("lang")).alias("value")).agg(F.count("*").alias("n"))
    return by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("t")))).select("value", "n", (F.col("n") / F.col("t") * 100).alias("percent"))


def fill_rates(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    one = j.agg(*[(F.count(c) / F.count("*")).alias(c) for c in ("text", "lang", "quality", "toxic")])
    return one.unpivot([], ["text", "lang", "quality", "toxic"], "column_name", "fill_rate")


def accuracy_summary(spark, d):
    v = table(spark, d, "events").select("value")
    return v.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.lit(exact_quantile(v, "value", 0.5)).cast("double").alias("median"), F.min("value").alias("low"), F.max("value").alias("high"), F.stddev_samp("value").alias("std"), F.count_if(F.col("value") >= 90).alias("excellent"), F.count_if(F.col("value") < 70).alias("poor"))


def accuracy_tiers(spark, d):
    v = F.col("value")
    tier = F.when(v >= 90, "90+").when(v >= 80, "80-90").when(v >= 70, "70-80").otherwise("<70")
    return table(spark, d, "events").where("value is not null").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


def accuracy_by_group(spark, d):
    return table(spark, d, "events").where("value is not null").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


def gain_impact(spark, d):
    gain = F.col("value") - 50
    return table(spark, d, "events").agg(F.avg(gain).alias("mean_gain"), F.count_if(gain > 0).alias("improved"), F.max(F.when(gain > 0, gain)).alias("best"), F.count_if(gain == 0).alias("unchanged"))


def bottom10(spark, d):
    return table(spark, d, "events").where("value is not null").orderBy("value", "event_id").limit(10).select("event_id", "value")


def loss_reason_rollup(spark, d):
    parsed = table(spark, d, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("reason", "v"))
    by = parsed.withColumn("x", F.expr("try_cast(v as double)")).where("x > 0").groupBy("reason").agg(F.sum("x").alias("loss"))
    return by.crossJoin(F.broadcast(by.agg(F.sum("loss").alias("t")))).select("reason", "loss", (F.col("loss") / F.col("t") * 100).alias("percent")).orderBy(F.col("loss").desc(), "reason").limit(15)


def _pages(spark, d):
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), (F.length("text") % 40 + 60).cast("double").alias("base"), (F.length("text") % 100).cast("double").alias("weight"))


def _reviews(spark, d):
    c = table(spark, d, "conversations")
    n = F.length("text")
    return c.where(n % 2 == 0).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.when(n % 3 == 0, "accepted").when(n % 3 == 1, "pending").otherwise("rejected").alias("status"), F.when(n % 5 == 0, "logo").otherwise("text").alias("snippet_type"), (n % 7).cast("double").alias("impact"))


def weighted_doc_accuracy(spark, d):
    return review.document_accuracy(_pages(spark, d), _reviews(spark, d))


def approval_status(spark, d):
    return review.approval(_reviews(spark, d))


def feedback_weights(spark, d):
    return review.feedback_boost(table(spark, d, "labels").select(F.lit("quality").alias("field"), F.when(F.col("quality") == 1, "good").otherwise("").alias("value")))


def review_queue_page(spark, d):
    r = _reviews(spark, d).where("status = 'pending'")
    return search.page_of(r, [F.col("impact").desc(), F.col("doc_id"), F.col("page")], 2, 20).select("doc_id", "page", "impact")


def size_labels(spark, d):
    return table(spark, d, "documents").select("doc_id", format_size(F.col("n_chars") * 2000 + 1).alias("size"), seconds_to_human(F.col("n_chars")).alias("duration"))


def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", snippet(F.col("text"), ["with", "und"]).alias("snippet"))


def page_boxes(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(*[F.col("l_quantity") + F.lit(float(x)) for x in (0, 5, 40, 60)]).alias("a"), F.array(*[F.lit(float(x)) for x in (10, 10, 60, 60)]).alias("b"))
    return li.select("l_orderkey", "l_linenumber", A.iou(F.col("a"), F.col("b")).alias("iou"))


def bloom_sizing(spark, d):
    rows = table(spark, d, "region").select("r_regionkey", F.pow(F.lit(10.0), F.col("r_regionkey") + 4).alias("n"))
    x = A.bloom_size(F.col("n"), F.lit(0.001))
    return rows.select("r_regionkey", x["m"].alias("bits"), x["k"].alias("hashes"))


def allowed_registry(spark, d):
    return registry(table(spark, d, "part"), {"p_brand": "business_unit_name", "p_type": "record_type"})


def dis_max_rank(spark, d):
    p = table(spark, d, "part")
    s = [F.when(F.col("p_type").contains("BRASS"), 5.0).otherwise(0.0), F.when(F.col("p_brand").endswith("1"), 3.0).otherwise(0.0), F.when(F.col("p_size") > 25, 1.0).otherwise(0.0)]
    return p.select("p_partkey", search.dis_max(s).alias("score"))


def decay_rank(spark, d):
    age = F.date_diff(F.lit("1998-12-31").cast("date"), F.col("ts").cast("date")).cast("double")
    return table(spark, d, "events").select("event_id", F.round(search.boosted(F.lit(1.0), age, F.col("value")), 9).alias("score"))


def fuzzy_terms(spark, d):
    words = table(spark, d, "documents").select(F.explode(analysis.search_tokens(F.col("text"))).alias("token"))
    return search.fuzzy_terms(words, spark.createDataFrame([("within",), ("their",), ("einen",), ("quelle",), ("of",)], "term string"))


def synonym_counts(spark, d):
    b = table(spark, d, "part").select(F.explode(analysis.search_tokens(F.concat_ws(" ", F.lit("Agreement bill staff"), "p_name"))).alias("t"))
    return b.groupBy(analysis.canonical(F.col("t")).alias("term")).agg(F.count("*").alias("n"))


def name_prefixes(spark, d):
    s = table(spark, d, "supplier").select(F.explode(analysis.search_tokens(F.col("s_name"))).alias("t"))
    return s.select(F.explode(analysis.edge_ngrams(F.col("t"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def analyzer_stem_tokens(spark, d):
    words = table(spark, d, "documents").select(F.explode(analysis.search_tokens(F.col("text"))).alias("token"))
    return analysis.stems(words)


def _vectors(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector")


def cosine_matches(spark, d):
    base, asked = _vectors(spark, d)
    return vectorindex.nearest(base, asked, 5).select("query_id", "vec_id")


def near_vectors(spark, d):
    """Approximate: the nearest cells only; tests measure its recall."""
    base, asked = _vectors(spark, d)
    return vectorindex.search(vectorindex.build(base, scratch(spark)), asked, 5).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


def vector_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(vectors.dot(F.col("embedding"), F.col("embedding"))), 4).alias("norm"))


def tier_scores(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", search.tier_score(F.col("source"), F.col("lang"), F.col("text"), F.col("text"), F.lit(""), "of the").alias("score"))


def highlights(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(search.highlight(F.col("text"), ["with", "und"]), 256).alias("marked_hash"))


def best_attempts(spark, d):
    c = table(spark, d, "conversations")
    rows = c.select("conv_id", F.col("turn").cast("int").alias("attempt"), "text", (F.length("text") % 97).cast("double").alias("confidence"), (F.length("text") % 5 == 0).alias("valid"))
    return ocr.best_attempts(rows, "conv_id").select("conv_id", "attempt", "confidence", "valid")


def joined_pages(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("page"), "text", (F.length("text") % 97).cast("double").alias("confidence"))
    return ocr.join_pages(c, "conv_id")


def snippet_policy(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("page"), F.col("l_linenumber").alias("snippet_id"), F.element_at(F.array(F.lit("signature"), F.lit("logo"), F.lit("stamp")), (F.col("l_partkey") % 3 + 1).cast("int")).alias("type"), F.col("l_discount").alias("impact"))
    return ocr.snippet_policy(li, ["signature", "logo"], {"signature": 0.05, "logo": 0.02}, {"logo": 1})


def snippet_artefacts(spark, d):
    li = table(spark, d, "lineitem")
    box = F.array(F.lit(10.0), F.lit(20.0), F.lit(10.0) + F.col("l_quantity") * 47, F.lit(20.0) + F.col("l_linenumber") * 3)
    kind = F.when(F.col("l_partkey") % 2 == 0, "signature").otherwise("logo")
    category = ocr.deficit_category(F.when(F.col("l_partkey") % 3 == 0, "text_anomaly").otherwise(kind), F.col("l_tax") / 5, F.col("l_discount") / 5, F.col("l_quantity") * 70, F.lit(3508), F.col("l_quantity") * 2)
    return li.select("l_orderkey", "l_linenumber", ocr.is_artefact(kind, F.col("l_discount"), box, F.lit(2480.0), F.lit(3508.0)).alias("artefact"), category.alias("category"))


def cancelled_actions(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("review_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "revert").otherwise(F.col("event_type")).alias("action"))
    return review.cancelled_actions(e).groupBy("action", "is_cancelled").agg(F.count("*").alias("n"))


def current_reviews(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("review_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "revert").otherwise(F.col("event_type")).alias("action"))
    return review.current_reviews(e)


QUERIES = {f.__name__: f for f in (facet_terms, facet_union, value_counts_share, fill_rates, accuracy_summary, accuracy_tiers, accuracy_by_group, gain_impact, bottom10, loss_reason_rollup, weighted_doc_accuracy, approval_status, feedback_weights, review_queue_page, size_labels, snippets, page_boxes, bloom_sizing, allowed_registry, dis_max_rank, decay_rank, fuzzy_terms, synonym_counts, name_prefixes, analyzer_stem_tokens, cosine_matches, near_vectors, vector_norms, tier_scores, highlights, best_attempts, joined_pages, snippet_policy, snippet_artefacts, cancelled_actions, current_reviews)}

_T = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_P = "(select conv_id as doc_id, turn as page, (length(text) % 40 + 60)::double as base, (length(text) % 100)::double as weight from conversations)"
_R = "(select conv_id as doc_id, turn as page, case length(text) % 3 when 0 then 'accepted' when 1 then 'pending' else 'rejected' end as status, case when length(text) % 5 = 0 then 'logo' else 'text' end as snippet_type, (length(text) % 7)::double as impact from conversations where length(text) % 2 = 0)"


_SIZE = "case when n_chars * 2000 + 1 < 1024 then printf('%.2f B', (n_chars * 2000 + 1)::double) when n_chars * 2000 + 1 < 1048576 then printf('%.2f KB', (n_chars * 2000 + 1) / 1024) else printf('%.2f MB', (n_chars * 2000 + 1) / 1048576) end"
# "of the" in five tiers; its confusable forms are ofthe and 0f the.
_TIERS = r"""
with x as (select doc_id, source, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as t, regexp_extract_all(lower(coalesce(source, '')), '[\p{L}\p{N}]+') as s, regexp_extract_all(lower(coalesce(lang, '')), '[\p{L}\p{N}]+') as l from documents),
y as (select *, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' and t[i + 1] = 'the')) > 0 as pt, len(list_filter(range(1, len(s)), lambda i: s[i] = 'of' and s[i + 1] = 'the')) > 0 as ps, len(list_filter(range(1, len(l)), lambda i: l[i] = 'of' and l[i + 1] = 'the')) > 0 as pl,
  len(list_filter(range(1, len(t)), lambda i: t[i] = '0f' and t[i + 1] = 'the')) > 0 as pz, t || s || l as a from x)
select doc_id, ((lower(coalesce(source, '')) = 'of the')::int * 100 + ps::int * 80 + pl::int * 60 + pt::int * 100 + (list_contains(a, 'of') and list_contains(a, 'the'))::int * 35 + list_has_any(a, ['of', 'the'])::int * 20
  + (list_contains(a, 'of') or len(list_filter(a, lambda w: w[:3] = 'the' and length(w) <= 4)) > 0)::int * 10 + list_contains(t, 'ofthe')::int * 15 + pz::int * 15)::double as score from y"""

SQL = {
    "tier_scores": _TIERS,
    "facet_terms": "select source, count(*) as n from documents group by 1 order by 1 limit 100",
    "facet_union": "select distinct value from (select trim(source) as value from documents union all select trim(lang) from documents) x where value <> ''",
    "value_counts_share": "select case when trim(coalesce(lang, '')) = '' then '(blank)' else lang end as value, count(*) as n, count(*) / sum(count(*)) over () * 100 as percent from documents group by 1",
    "fill_rates": "with j as (select * from documents left join labels using (doc_id)) select 'text' as column_name, count(text) / count(*) as fill_rate from j union all select 'lang', count(lang) / count(*) from j union all select 'quality', count(quality) / count(*) from j union all select 'toxic', count(toxic) / count(*) from j",
    "accuracy_summary": "select count(value) as n, avg(value) as mean, median(value) as median, min(value) as low, max(value) as high, stddev_samp(value) as std, count(*) filter (where value >= 90) as excellent, count(*) filter (where value < 70) as poor from events",
    "accuracy_tiers": "select case when value >= 90 then '90+' when value >= 80 then '80-90' when value >= 70 then '70-80' else '<70' end as tier, count(*) as n from events where value is not null group by 1",
    "accuracy_by_group": "select event_type, count(*) as n, avg(value) as mean, min(value) as low, max(value) as high from events where value is not null group by 1",
    "gain_impact": "select avg(value - 50) as mean_gain, count(*) filter (where value > 50) as improved, max(value - 50) filter (where value > 50) as best, count(*) filter (where value = 50) as unchanged from events",
    "bottom10": "select event_id, value from events where value is not null order by value, event_id limit 10",
    "loss_reason_rollup": "select reason, loss, loss / sum(loss) over () * 100 as percent from (select k as reason, sum(v) as loss from (select unnest(json_keys(props)) as k, try_cast(props->>('$.' || unnest(json_keys(props))) as double) as v from events) x where v > 0 group by 1) y order by loss desc, reason limit 15",
    "weighted_doc_accuracy": f"with a as (select doc_id, page, sum(impact) as accepted from {_R} r where status = 'accepted' and snippet_type not in ('logo', 'stamp') group by all) select p.doc_id, case when sum(weight) > 0 then sum(least(100, base + coalesce(accepted, 0)) * weight) / sum(weight) else avg(least(100, base)) end as accuracy from {_P} p left join a using (doc_id, page) group by p.doc_id",
    "approval_status": f"select *, case when pending > 0 then 'Pending Review' when accepted > 0 then 'Approved' else 'Full Baseline' end as approval_status from (select doc_id, count(*) filter (where status = 'pending') as pending, count(*) filter (where status = 'accepted') as accepted, count(*) filter (where status = 'rejected') as rejected, count(*) as total, coalesce(sum(impact) filter (where status = 'pending'), 0) as pending_impact from {_R} r group by 1) x",
    "feedback_weights": "select 'quality' as field, 'good' as value, count(*) as n, least(0.20::double, count(*) * 0.02::double) as boost from labels where quality = 1",
    "review_queue_page": f"select doc_id, page, impact from {_R} r where status = 'pending' order by impact desc, doc_id, page limit 20 offset 20",
    "size_labels": f"select doc_id, {_SIZE} as size, case when n_chars >= 3600 then printf('%dh %dm %ds', n_chars // 3600, n_chars // 60 % 60, n_chars % 60) when n_chars >= 60 then printf('%dm %ds', n_chars // 60, n_chars % 60) else printf('%ds', n_chars) end as duration from documents",
    "snippets": "select doc_id, case when first is null then text[:180] || case when length(text) > 180 then '...' else '' end else case when s > 1 then '...' else '' end || substr(text, s, 180) || case when s + 180 <= length(text) then '...' else '' end end as snippet from (select *, greatest(first - 90, 1) as s from (select doc_id, text, least(nullif(instr(lower(text), 'with'), 0), nullif(instr(lower(text), 'und'), 0)) as first from documents) x) y",
    "page_boxes": "select l_orderkey, l_linenumber, i / ((40 * 55) + 2500 - i) as iou from (select l_orderkey, l_linenumber, greatest(least(l_quantity + 40, 60) - greatest(l_quantity, 10), 0) * greatest(least(l_quantity + 60, 60) - greatest(l_quantity + 5, 10), 0) as i from lineitem) x",
    "bloom_sizing": "select r_regionkey, trunc(-(n * ln(0.001)) / (ln(2) * ln(2)))::bigint as bits, trunc(trunc(-(n * ln(0.001)) / (ln(2) * ln(2))) / n * ln(2))::int as hashes from (select r_regionkey, pow(10.0, r_regionkey + 4) as n from region) x",
    "allowed_registry": "select distinct 'business_unit_name' as field, p_brand as value from part union select distinct 'record_type', p_type from part",
    "dis_max_rank": "select p_partkey, (m + 0.1 * (a + b + c - m))::double as score from (select *, greatest(a, b, c) as m from (select p_partkey, case when contains(p_type, 'BRASS') then 5.0 else 0 end as a, case when ends_with(p_brand, '1') then 3.0 else 0 end as b, case when p_size > 25 then 1.0 else 0 end as c from part) x) y",
    "decay_rank": "select event_id, round(exp(-pow(greatest(date_diff('day', ts::date, date '1998-12-31') - 7.0, 0), 2) / (2 * (-(90.0 * 90.0) / (2 * ln(0.5))))) * 1.2 + case when value >= 80 then 1.3 else 0 end + case when value >= 0 and value < 50 then 0.8 else 0 end, 9) as score from events",
    "fuzzy_terms": f"with t as (select distinct unnest({_T}) as token from documents), q as (select term, case when length(term) <= 2 then 0 when length(term) <= 5 then 1 else 2 end as most from (values ('within'), ('their'), ('einen'), ('quelle'), ('of')) v(term)) select term, token, levenshtein(term, a) as distance from q, (select token, translate(token, 'äöüßéèêàâçñóíáúëïôûîœ', 'ABCDEFGHIJKLMNOPQRSTU') as a from t) x where term[:3] = token[:3] and levenshtein(term, a) <= most",
    "name_prefixes": r"with t as (select unnest(regexp_extract_all(lower(s_name), '[\p{L}\p{N}]+')) as t from supplier), g as (select t[:unnest(range(3, least(length(t), 15) + 1))] as gram from t where length(t) >= 3) select gram, count(*) as n from g group by 1",
    "synonym_counts": r"with t as (select unnest(regexp_extract_all(lower('Agreement bill staff ' || p_name), '[\p{L}\p{N}]+')) as t from part) select case t when 'agreement' then 'contract' when 'bill' then 'invoice' when 'staff' then 'employee' else t end as term, count(*) as n from t group by 1",
    "cosine_matches": "with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), s as (select q.vec_id as query_id, e.vec_id, list_cosine_similarity(q.v, e.v) as c from e, e q where q.vec_id % 20 = 0 and q.vec_id <> e.vec_id), r as (select *, row_number() over (partition by query_id order by c desc, vec_id) as k from s) select query_id, vec_id from r where k <= 5",
    "vector_norms": "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 4) as norm from embeddings",
    "highlights": "select doc_id, sha256(regexp_replace(text, '(?i)(with|und)', '<mark>\\1</mark>', 'g')) as marked_hash from documents",
    "best_attempts": "select conv_id, attempt, confidence, valid from (select *, row_number() over (partition by conv_id order by valid desc, case when valid then 0 else confidence end desc, attempt) as k from (select conv_id, turn::int as attempt, (length(text) % 97)::double as confidence, length(text) % 5 = 0 as valid, text from conversations) x where valid or length(trim(text)) > 0) y where k = 1",
    "joined_pages": "select conv_id, string_agg('--- Page ' || turn || ' ---' || chr(10) || text, chr(10) || chr(10) order by turn) as text, avg(length(text) % 97)::double as confidence from conversations where turn <= 50 and length(trim(text)) > 0 group by 1",
    "snippet_policy": "with s as (select l_orderkey as doc_id, l_suppkey as page, l_linenumber as snippet_id, ['signature', 'logo', 'stamp'][l_partkey % 3 + 1] as type, l_discount as impact from lineitem where l_partkey % 3 < 2), f as (select *, impact >= case type when 'signature' then 0.05::double else 0.02::double end as fits from s), r as (select *, row_number() over (partition by doc_id, page, type order by fits desc, impact desc, snippet_id) as k, bool_or(fits) over (partition by doc_id, page) as a from f) select doc_id, page, snippet_id, type, impact from r where case when a then fits and (type <> 'logo' or k <= 1) else k = 1 end",
    "snippet_artefacts": "with x as (select *, least(10 + l_quantity * 47, 2480) - 10 as w, l_linenumber * 3.0::double as h, case when l_partkey % 2 = 0 then 'signature' else 'logo' end as kind from lineitem), y as (select *, case when l_partkey % 3 = 0 then 'text_anomaly' else kind end as k2, case when l_quantity * 70 > 3508 * 0.4::double then 'signature' else 'handwritten' end as place from x) select l_orderkey, l_linenumber, kind = 'signature' and (l_discount <= 0.03::double or h / 3508 < 0.002::double or w / 2480 > 0.95::double or w / h > 40 or h < 4 or w < 4 or w * h < 16) as artefact, case when l_tax / 5 > 0.01::double then 'stamp' when l_discount / 5 > 0.005::double and l_discount / 5 < 0.4::double then place when k2 = 'signature' then place when k2 = 'text_anomaly' then case when l_quantity * 2 >= 70 then 'text_anomaly' when l_quantity * 2 < 30 then 'faded_text' else k2 end else k2 end as category from y",
    "cancelled_actions": "with e as (select user_id as r, event_id as seq, case when event_type = 'error' then 'revert' else event_type end as action from events), l as (select r, max(seq) as m from e where action = 'revert' group by 1) select action, coalesce(seq < m and action <> 'revert', false) as is_cancelled, count(*) as n from e left join l using (r) group by all",
    "current_reviews": "select user_id as review_id, case when arg_max(event_type, event_id) = 'error' then 'pending' else arg_max(event_type, event_id) end as status from events group by 1",
}
