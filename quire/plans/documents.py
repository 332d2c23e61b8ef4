"""Queries over documents and pages: dedup, text functions, classification, accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import accuracy as A
from quire.functions import entities
from quire.functions import text as T
from quire.functions import values as V
from quire.operators import dedup, tagging
from quire.session import written
from quire.sources.tables import table

_SPACES = r"'\s+', ' ', 'g'"
NORM = rf"trim(regexp_replace(lower(coalesce(text, '')), {_SPACES}))"
CONTENT = NORM
for _p in (r"\d{4}-\d{2}-\d{2}[t ]\d{2}:\d{2}:\d{2}", r"\d{2}/\d{2}/\d{4}", r"page \d+", r"\d+ of \d+"):
    CONTENT = f"regexp_replace({CONTENT}, '{_p}', '', 'g')"
HASH = f"case when coalesce(text, '') = '' then '' else sha256({CONTENT}) end"


def dedup_content_hash(spark, d):
    hashed = written(table(spark, d, "documents").select("doc_id", "source", T.content_hash(F.col("text")).alias("hash")))  # the texts are hashed once
    out = dedup.mark_duplicates(hashed, F.col("hash"), ["doc_id"])
    return out.select("doc_id", "source", F.col("key").alias("content_hash"), "is_duplicate", F.col("primary_id").alias("primary_doc_id"))


def dedup_file_hash_registry(spark, d):
    return dedup.registry(table(spark, d, "documents"), F.sha2("text", 256), "doc_id", "source").withColumnRenamed("key", "file_hash")


def duplicates_by_source(spark, d):
    out = dedup_content_hash(spark, d)
    return out.groupBy("source").agg(F.count("*").alias("files"), F.count_if("is_duplicate").alias("duplicates"), F.countDistinct("content_hash").alias("distinct_contents"))


def size_category_rollup(spark, d):
    rows = table(spark, d, "documents").select(T.size_category(F.col("n_chars") * 1024).alias("size_category"), "n_chars")
    return rows.rollup("size_category").agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"))


def truncate_content(spark, d):
    t = T.truncate(F.col("text"), 500)
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.col("t.text").alias("content"), "t.truncated", F.col("t.length").alias("original_length"))


def token_stats(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(T.norm(F.col("text"))).cast("long").alias("norm_chars"), F.size(T.tokens(F.col("text"))).cast("long").alias("distinct_tokens"))


def ocr_corrections(spark, d):
    c = T.correct(F.concat(F.col("text"), F.lit(" Total Assests in 2041 | sale prlce $ 97 621 on June 45, MuItisite fulIy.")))
    return table(spark, d, "documents").select("doc_id", F.sha2(c["text"], 256).alias("corrected_hash"))


def ocr_correction_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.correct(F.concat(F.col("text"), F.lit(" sale prlce in 2041")))["corrections"].alias("corrections"))


def _sql_rules() -> str:
    text = "text || ' Total Assests in 2041 | sale prlce $ 97 621 on June 45, MuItisite fulIy.'"
    esc = lambda s: s.replace("'", "''")
    java = lambda r: esc(r).replace(r"\$", "\0").replace(r"\(", "(").replace("$1", r"\1").replace("$2", r"\2").replace("\0", "$")
    for _, kind, p, r in T.correction_rules():
        if kind == "re":
            text = f"regexp_replace({text}, '{esc(p)}', '{java(r)}', 'g')"
        elif kind == "phrase":
            text = f"regexp_replace({text}, '(?i){esc(T.quoted(p))}', '{esc(r)}', 'g')"
        else:
            text = f"replace({text}, '{esc(p)}', '{esc(r)}')"
    return text


def _sql_counts() -> str:
    """All rules one after the other, each with the number of its hits in the text as it is then."""
    esc = lambda s: s.replace("'", "''")
    java = lambda r: esc(r).replace(r"\$", "\0").replace(r"\(", "(").replace("$1", r"\1").replace("$2", r"\2").replace("\0", "$")
    steps = ["s0 as materialized (select doc_id, text || ' sale prlce in 2041' as t, 0::bigint as n from documents)"]
    for i, (_, kind, p, r) in enumerate(T.correction_rules()):
        pattern = esc(p) if kind == "re" else "(?i)" + esc(T.quoted(p))
        if kind == "lit":
            new, hits = f"replace(t, '{esc(p)}', '{esc(r)}')", f"(length(t) - length(replace(t, '{esc(p)}', ''))) // {len(p)}"
        else:
            new, hits = f"regexp_replace(t, '{pattern}', '{java(r) if kind == 're' else esc(r)}', 'g')", f"len(regexp_extract_all(t, '{pattern}'))"
        steps.append(f"s{i + 1} as materialized (select doc_id, {new} as t, n + {hits} as n from s{i})")
    return f"with {', '.join(steps)} select doc_id, n as corrections from s{len(steps) - 1}"


def html_accuracy(spark, d):
    return table(spark, d, "pages").select("page_id", A.html_accuracy(F.col("html")).alias("a")).select("page_id", "a.*")


def text_accuracy(spark, d):
    return table(spark, d, "documents").select("doc_id", A.text_accuracy(F.col("text"), F.col("n_chars"), F.lit("md")).alias("accuracy"), A.json_structure(F.col("text")).alias("structure_pct"))


def url_paths(spark, d):
    p = table(spark, d, "pages")
    norm = F.replace("url", F.lit("\\"), F.lit("/"))
    name = F.substring_index(F.regexp_replace(norm, r"[?#].*$", ""), "/", -1)
    return p.select("page_id", name.alias("file_name"), F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)).alias("extension"), F.col("url").ilike("%/en/%").alias("is_english_path"))


def ocr_routing(spark, d):
    p = table(spark, d, "documents").select("doc_id", "text", "n_chars", F.when(F.col("doc_id") % 3 == 0, "application/pdf").when(F.col("doc_id") % 3 == 1, "image/png").otherwise("text/plain").alias("mime"))
    return p.select("doc_id", A.needs_ocr(F.col("text"), F.col("mime"), F.col("n_chars") % 2).alias("needs_ocr"), A.valid_ocr(F.col("text"), (F.col("n_chars") % 100).cast("double"), F.lit(40.0)).alias("verdict"))


#: The corpus is invented prose without such marks, so frequent words of its four languages stand in for them, in each text.
MARKS = (("the", "confidential"), ("und", "restricted"), ("que", "internal use"), ("los", "public"), ("with", "not"))
_marked_sql = "text"
for _a, _b in MARKS:
    _marked_sql = f"regexp_replace({_marked_sql}, '(^|[^\\p{{L}}]){_a}($|[^\\p{{L}}])', '\\1{_b}\\2', 'g')"


def confidentiality(spark, d):
    """Marks of secrecy in the text of every document."""
    t = F.col("text")
    for a, b in MARKS:
        t = F.regexp_replace(t, rf"(^|[^\p{{L}}]){a}($|[^\p{{L}}])", f"$1{b}$2")
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", T.confidentiality(F.col("t")).alias("confidentiality"), T.data_classification(F.col("t")).alias("data_classification"))


_EL, _ER = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def _has(p: str) -> str:
    return f"regexp_matches(t, '{_EL}{p}{_ER}')"


CONF_SQL = rf"""
with x as (select doc_id, trim(regexp_replace(lower(coalesce({_marked_sql}, '')), '\s+', ' ', 'g')) as t from documents)
select doc_id, case when {_has('(strictly )?confidential')} and not {_has('not confidential')} then 'Confidential' when {_has('(internal (use|only)|restricted)')} and not {_has('unrestricted')} then 'Internal' else 'Public' end as confidentiality,
 case when {_has('spii')} or regexp_matches(t, '{_EL}sensitive personal') then 'GE Confidential with SPII'
  when regexp_matches(regexp_replace(t, '{_EL}restricted (to|from|access)', '\1x', 'g'), '{_EL}restricted{_ER}') and not {_has('unrestricted')} then 'GE Restricted'
  when {_has('confidential')} and not {_has('not confidential')} then 'GE Confidential' when {_has('internal (use|only)')} or {_has('ge internal')} then 'GE Internal'
  when {_has('public')} or {_has('unrestricted')} then 'Public' else 'GE Internal' end as data_classification from x
"""


def _hinted():
    """A keyword-bearing text for the classifiers: the corpus is invented prose, so part names stand in for a title."""
    return F.concat_ws(" ", F.element_at(F.array(*[F.lit(x) for x in HINTS]), (F.col("doc_id") % len(HINTS) + 1).cast("int")), F.col("text"))


HINTS = ("invoice amount due", "service agreement term", "employee leave policy", "audit finding in Germany, USD", "general ledger", "lease of real estate property, Hong Kong", "quarterly report", "xyz")
_HINT_SQL = "concat_ws(' ', [" + ", ".join(f"'{h}'" for h in HINTS) + f"][doc_id % {len(HINTS)} + 1], text)"


def record_type_votes(spark, d):
    code = tagging.votes(_hinted(), V.RECORD_TYPES, "")
    out = table(spark, d, "documents").select("doc_id", code.alias("record_type"), tagging.votes(_hinted(), V.BUSINESS_UNITS, "GECC HQ", by_length=True).alias("business_unit"))
    return out.withColumn("record_category", T.record_category(F.col("record_type")))


#: The distinct words of each text t, joined with phrases on their first word; only those pairs see a pattern.
_FIRST = "w as (select doc_id, unnest(list_distinct(regexp_extract_all(t, '[\\p{L}\\p{N}_]+'))) as word from x)"


def _first(phrase: str) -> str:
    return T.spaced(phrase).replace("-", " ").replace("&", " ").replace(".", " ").split()[0]


def _votes_sql(table_: dict, by_length: bool) -> str:
    rows = ", ".join(f"({i}, '{code}', '{_first(k)}', '{T.phrase_pattern(k)}', {1 + 0.5 * (len(k.split()) - 1) if by_length else 1.0})" for i, (code, ks) in enumerate(table_.items()) for k in ks)
    return f"(select doc_id, arg_min(code, (-n, i)) as code from (select doc_id, code, i, sum(s) as n from w join (values {rows}) v(i, code, word, p, s) using (word) join x using (doc_id) where regexp_matches(t, p) group by all) group by doc_id)"


VOTES_SQL = f"""
with x as (select doc_id, trim(regexp_replace(lower(translate({_HINT_SQL}, '_', ' ')), {_SPACES})) as t from documents),
{_FIRST}
select x.doc_id, coalesce(r.code, '') as record_type, coalesce(b.code, 'GECC HQ') as business_unit,
  coalesce(map {{{', '.join(f"'{k}': '{v}'" for k, v in V.CATEGORY_OF_PREFIX.items())}}}[regexp_extract(coalesce(r.code, ''), '^([A-Z]+)', 1)], '') as record_category
from x left join {_votes_sql(V.RECORD_TYPES, False)} r on x.doc_id = r.doc_id left join {_votes_sql(V.BUSINESS_UNITS, True)} b on x.doc_id = b.doc_id
"""


def country_votes(spark, d):
    return table(spark, d, "documents").select("doc_id", tagging.countries(_hinted()).alias("countries"))


_COUNTRY_ROWS = ", ".join(f"('{iso}', '{_first(name)}', '{T.phrase_pattern(name)}')" for name, iso in V.COUNTRIES.items())
_CURRENCY_ROWS = ", ".join(f"('{iso}', '{code.lower()}')" for code, iso in V.CURRENCIES.items())
COUNTRY_SQL = f"""
with x as (select doc_id, trim(regexp_replace(lower({_HINT_SQL}), {_SPACES})) as t from documents),
{_FIRST},
hits as (select doc_id, iso from w join (values {_COUNTRY_ROWS}) v(iso, word, p) using (word) join x using (doc_id) where regexp_matches(t, p)
  union all select doc_id, iso from x join (values {_CURRENCY_ROWS}) c(iso, code) on contains(t, code)),
v as (select doc_id, iso, count(*) as n from hits group by all),
r as (select *, row_number() over (partition by doc_id order by n desc, iso) as k, max(n) over (partition by doc_id) as top from v)
select x.doc_id, coalesce(any_value(c), 'USA') as countries from x left join (select doc_id, string_agg(iso, ', ' order by k) as c from r where k <= 3 and n * 2 >= top group by doc_id) y on x.doc_id = y.doc_id group by x.doc_id
"""


def taxonomy_labels(spark, d):
    rows = table(spark, d, "documents").select("doc_id", _hinted().alias("t"), F.col("source").alias("p"))
    out = tagging.tag(rows, "t", "p")
    fields = list(V.TAXONOMY_DEFAULTS)
    return out.select("doc_id", *[F.col(f"{f}.label").alias(f) for f in fields], *[F.col(f"{f}.review").alias(f"{f}_review") for f in fields], F.round("tag_confidence", 4).alias("tag_confidence"), "needs_review")


def _taxonomy_sql(weak: bool = False) -> str:
    rows = []
    for f, label, aliases, keywords, priority in V.TAXONOMY:
        names = [label.lower(), *aliases]
        any_of = lambda c: " or ".join(f"regexp_matches({c}, '{T.phrase_pattern(a)}')" for a in names)  # noqa: B023, E731
        cover = " + ".join(f"regexp_matches(t, '{T.phrase_pattern(k)}')::int" for k in keywords)
        own = sorted(set(label.lower().split()))
        over = " + ".join(f"list_contains(w, '{k}')::int" for k in own)
        rows.append(f"select doc_id, '{f}' as f, '{label}' as label, {priority} as pr, 0.30::double * case when {any_of('t')} then 1 else 0 end + 0.20::double * case when {any_of('p')} then 1 else 0 end + 0.35::double * (({cover}) / {len(keywords)}) + 0.15::double * (({over}) / {len(own)}) as raw from x")
    default = " ".join(f"when '{k}' then '{v}'" for k, v in V.TAXONOMY_DEFAULTS.items())
    pick = lambda f, c: f"max({c}) filter (where f = '{f}')"
    fields = list(V.TAXONOMY_DEFAULTS)
    return f"""
with x as (select doc_id, trim(regexp_replace(lower(translate({_HINT_SQL}, '_\\/', '   ')), {_SPACES})) as t, trim(regexp_replace(lower(translate(source, '_\\/', '   ')), {_SPACES})) as p,
  list_distinct(regexp_extract_all(lower({_HINT_SQL}), '[a-z0-9]{{2,}}')) as w from documents),
s as ({' union all '.join(rows)}),
r as (select *, row_number() over w as k, lead(raw) over w as second from s window w as (partition by doc_id, f order by raw desc, pr desc, lower(label))),
b as (select doc_id, f, label, greatest(0, least(least(case when raw - second < 0.05 and raw < 0.30 then least(raw, 0.15) else raw end, 1.2) / 2.0, 0.99)) as score from r where k = 1),
c as (select doc_id, f, case when score < 0.75 and score <= 0.10 then case f {default} end else label end as label, case when score < 0.75 and score <= 0.10 then 0.35 else score end as score, score < 0.75 as review, score < 0.75 and score <= 0.10 as weak from b)
select doc_id, {"bool_or(weak) filter (where f = 'category') as weak_category, bool_or(weak) filter (where f = 'purpose') as weak_purpose, " if weak else ""}{', '.join(f"{pick(f, 'label')} as {f}" for f in fields)}, {', '.join(f"bool_or(review) filter (where f = '{f}') as {f}_review" for f in fields)},
  round(({' + '.join(f"{pick(f, 'score')}" for f in fields)}) / 3, 4) as tag_confidence, bool_and(review) as needs_review from c group by doc_id
"""


CATEGORY = "Invoice"  # the only category that the query's registry allows


def tag_requests(spark, d):
    """The whole tagger over every document; a quarter has an explicit label, a quarter one that the taxonomy doesn't know, a
    quarter a derived purpose."""
    k = F.col("doc_id") % 4
    rows = table(spark, d, "documents").select("doc_id", "text", _hinted().alias("t"), F.col("source").alias("p"), F.when(k == 0, F.lower(F.lit(CATEGORY))).when(k == 1, " Own label ").alias("m_category"), F.when(k == 2, "Odd purpose").alias("m_purpose"))
    allowed = {"category": spark.createDataFrame([(CATEGORY,)], "value string")}
    out = tagging.tag_requests(rows, "t", "p", {"category": "m_category"}, {"purpose": "m_purpose"}, allowed)
    return out.select("doc_id", "final_category", "final_department", "final_purpose", F.col("category.source").alias("category_source"), F.col("purpose.source").alias("purpose_source"), F.col("department.label").alias("department_label"), "review_required", "tagging_status", "countries")


def money_and_dates(spark, d):
    t = F.concat_ws(" ", F.lit("Paid USD 1,200.50 and $ 7 on 2024-01-31, 3/4/21 or Jan 5, 2020."), F.col("text"))
    all_of = lambda p: F.array_join(F.slice(F.array_distinct(F.regexp_extract_all(t, F.lit(p), F.lit(0))), 1, 5), "|")
    return table(spark, d, "documents").select("doc_id", all_of(V.MONEY).alias("amounts"), all_of(V.DATES).alias("dates"))


def smart_ids(spark, d):
    key = T.file_key(F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)), F.when(F.col("doc_id") % 3 == 1, F.col("doc_id")), F.col("source"))
    sid = T.smart_id(F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.when(F.col("doc_id") % 5 == 0, "2024-03-09T10:00:00Z"), key, "20260101")
    return table(spark, d, "documents").select("doc_id", key.alias("file_key"), sid.alias("smart_id"), T.file_type(F.when(F.col("doc_id") % 2 == 0, ".PDF"), F.lit("image/jpeg")).alias("file_type"))


def allowed_values(spark, d):
    allowed = spark.createDataFrame([(x,) for x in ("Standard Brass", "promo", "ECONOMY ANODIZED STEEL", "Small Tin", "Copper Large", "nothing")], "value string")
    return tagging.allowed_value(table(spark, d, "part"), allowed, "p_type")


ALLOWED_SQL = r"""
with a as (select value, trim(regexp_replace(lower(value), '\s+', ' ', 'g')) as a from (values ('Standard Brass'), ('promo'), ('ECONOMY ANODIZED STEEL'), ('Small Tin'), ('Copper Large'), ('nothing')) v(value)),
c as (select distinct p_type, trim(regexp_replace(lower(p_type), '\s+', ' ', 'g')) as c from part),
j as (select p_type, value, len(list_intersect(list_distinct(regexp_extract_all(c, '[a-z0-9]{2,}')), list_distinct(regexp_extract_all(a, '[a-z0-9]{2,}')))) as o, c = a as e, length(c) >= 4 and (contains(a, c) or contains(c, a)) as s from c, a),
r as (select p_type, value, case when e then 1 when s then 2 else 3 end as tier, case when e or s then 0 else -o end as o from j where e or s or o > 0),
b as (select *, row_number() over (partition by p_type order by tier, o, value) as k from r)
select c.p_type, b.value, case b.tier when 1 then 'exact' when 2 then 'partial' when 3 then 'overlap' else 'none' end as mode from c left join b on c.p_type = b.p_type and b.k = 1
"""


def metadata_row_match(spark, d):
    """Every document against a stated sheet of rows (the nations stand in), the best row by points."""
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("row"), F.lower("n_name").alias("rname"), F.concat(F.lit("src"), F.col("n_nationkey")).alias("rpath"))
    docs = table(spark, d, "documents").select("doc_id", "source", F.concat(F.lit("x "), F.col("lang"), F.lit(" "), F.col("source")).alias("name"))
    return tagging.best_rows(docs, rows, "doc_id", "row", {"name": "name", "path": "source"}, {"name": "rname", "path": "rpath"})


GARBAGE = ("A", "GL", "CCAC8CFC6P", "74,564,570", "1.3E11", "A1:D10", "x=12345", "Total Amount", "ONE TWO THREE", "www.site.com page", "www.site.de page", "c:\\users\\x", "Jane Doe", "Société Générale", "12ab34567890", "report.pdf file")


def _entity_candidates():
    """One value of each row of documents: a word, two words or a piece of the text, or one of the golden values."""
    kinds = [F.split("text", r"\s+")[0], F.regexp_extract("text", r"(\S+\s+\S+)", 1), F.substring("text", 1, 90), F.upper(F.translate(F.substring("text", 1, 24), "ß", "s")), F.concat(F.col("source"), F.lit("="), F.col("n_chars"), F.lit("000"))]
    golden = F.element_at(F.array(*[F.lit(g) for g in GARBAGE]), (F.col("doc_id") % len(GARBAGE) + 1).cast("int"))
    out = golden
    for i, k in enumerate(kinds):
        out = F.when(F.col("doc_id") % (len(kinds) + 1) == i, k).otherwise(out)
    return out


def entity_cleanup(spark, d):
    value = _entity_candidates()
    return table(spark, d, "documents").select("doc_id", value.alias("entity"), entities.is_garbage(value).alias("garbage"))


def _garbage_sql() -> str:
    """The rules over a column v, written for DuckDB."""
    letters, s = "length(regexp_replace(v, '[^\\p{L}]', '', 'g'))", "trim(v)"
    headers = "|".join(w for w in entities.HEADER_WORDS if w != "No.")
    long_words = f"list_filter(regexp_extract_all({s}, '\\S+'), lambda w: length(w) > 1)"
    return f"""(length(v) < 2 or length(v) > 80 or {letters} < 2 or (length(v) > 4 and {letters} < 0.4 * length(v))
 or regexp_matches({s}, '^(\\p{{Lu}}{{1,4}}|[A-Z0-9]{{6,}}|-?[0-9][0-9.,-]*|[0-9]{{1,3}}(,[0-9]{{3}})+|-?[0-9]+\\.?[0-9]*[Ee][+-]?[0-9]+)$')
 or regexp_matches({s}, '^(col|row)_|\\$[A-Z]+\\$?[0-9]+|^[A-Z]+[0-9]+:[A-Z]+[0-9]+$') or (contains({s}, '=') and len(regexp_extract_all({s}, '[0-9]')) > 3)
 or regexp_matches({s}, '(?i)^({headers})($|[^A-Za-z0-9_])|^No\\.[A-Za-z0-9_]')
 or (len(regexp_extract_all({s}, '\\S+')) >= 3 and len(list_filter({long_words}, lambda w: not ((upper(w) = w and lower(w) <> w) or not regexp_matches(w, '^\\p{{L}}')))) = 0)
 or regexp_matches({s}, '{entities.WEB}') or regexp_matches(v, '(?i){entities.PATH_PIECES}'))"""


def entity_lists(spark, d):
    t = F.concat(F.lit("Jane Doe met JANE DOE and Jane  Doe at Société Générale for USD 5 or $7. "), F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.array_join(entities.proper_names(t, 10), "|").alias("names"), entities.first_money(t).alias("amount"))


def tag_details(spark, d):
    rows = table(spark, d, "documents").select("doc_id", _hinted().alias("t"), "text", F.when(F.col("doc_id") % 4 == 0, "forced").when(F.col("doc_id") % 4 == 1, "pass").otherwise("no_match").alias("a"), F.when(F.col("doc_id") % 3 == 0, "no_match").otherwise("x").alias("b"))
    return rows.select("doc_id", F.array_join(tagging.subtags(F.col("t")), ",").alias("subtags"), tagging.provenance(F.array("a", "b")).alias("provenance"), tagging.too_little([F.col("text")], F.col("doc_id") % 2 == 0).alias("too_little"))


def registry_casing(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.concat_ws(" , ", F.lower("p_type"), F.lit("unknown"), F.upper("p_brand")).alias("labels"))
    allowed = table(spark, d, "part").select(F.col("p_type").alias("value")).unionByName(table(spark, d, "part").select(F.col("p_brand").alias("value"))).distinct()
    return tagging.registry_casing(rows, "labels", allowed)


def enhancement(spark, d):
    li = table(spark, d, "lineitem")
    b, c, s = F.col("l_quantity") * 5, F.col("l_quantity") + F.col("l_linenumber") * 5, F.col("l_partkey") % 300
    return li.select("l_orderkey", "l_linenumber", A.enhancement_mode(b, c, s, F.when(F.col("l_linenumber") == 1, F.col("l_discount") * 10)).alias("mode"), A.gamma(b).alias("gamma"))


def page_shares(spark, d):
    li = table(spark, d, "lineitem")
    x = A.shares({"clean": F.when(F.col("l_linenumber") > 1, F.col("l_quantity")), "noise": F.when(F.col("l_linenumber") > 2, F.col("l_discount") * 100), "whitespace": F.lit(None).cast("double")})
    return li.select("l_orderkey", "l_linenumber", x.alias("x")).select("l_orderkey", "l_linenumber", "x.*")


QUERIES = {f.__name__: f for f in (dedup_content_hash, dedup_file_hash_registry, duplicates_by_source, size_category_rollup, truncate_content, token_stats, ocr_corrections, ocr_correction_counts, html_accuracy, text_accuracy, url_paths, ocr_routing, confidentiality, record_type_votes, country_votes, taxonomy_labels, tag_requests, money_and_dates, smart_ids, allowed_values, metadata_row_match, entity_cleanup, entity_lists, tag_details, registry_casing, enhancement, page_shares)}

_DUP = f"select doc_id, source, {HASH} as content_hash from documents"
SQL = {
    "dedup_content_hash": f"select *, content_hash <> '' and row_number() over (partition by content_hash order by doc_id) > 1 as is_duplicate, case when content_hash = '' then doc_id else min(doc_id) over (partition by content_hash) end as primary_doc_id from ({_DUP}) x",
    "dedup_file_hash_registry": "select sha256(text) as file_hash, min(doc_id) as first_id, count(*) - 1 as duplicates, coalesce(array_to_string((list(source order by doc_id))[2:], ','), '') as later_paths from documents where text is not null group by 1",
    "duplicates_by_source": f"select source, count(*) as files, count(*) filter (where dup) as duplicates, count(distinct content_hash) as distinct_contents from (select *, content_hash <> '' and row_number() over (partition by content_hash order by doc_id) > 1 as dup from ({_DUP}) x) y group by source",
    "size_category_rollup": "select size_category, count(*) as files, sum(n_chars)::bigint as bytes from (select n_chars, case when n_chars * 1024 < 1048576 then 'tiny' when n_chars * 1024 < 10485760 then 'small' when n_chars * 1024 < 52428800 then 'medium' else 'large' end as size_category from documents) x group by rollup(size_category)",
    "truncate_content": "select doc_id, case when length(text) <= 500 then text else case when length(regexp_extract(text[:500], '(?s)^(.*) ', 1)) > 400 then regexp_extract(text[:500], '(?s)^(.*) ', 1) else text[:500] end || ' [content truncated]' end as content, length(text) > 500 as truncated, length(text)::bigint as original_length from documents",
    "token_stats": f"select doc_id, length({NORM})::bigint as norm_chars, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')))::bigint as distinct_tokens from documents",
    "html_accuracy": r"select page_id, (length(html) - length(regexp_replace(html, '<[^>]+>', '', 'g'))) / length(html) * 100 as tag_pct, least(len(regexp_extract_all(lower(html), '<img')) * 5.0, 25.0)::double as image_pct, length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) / length(html) * 100 as text_pct from pages",
    "text_accuracy": r"""select doc_id, case when n_chars > 0 then greatest(least(octet_length(encode(text)) / n_chars * 100, 100) - 3, 0) else 0 end::double as accuracy, length(regexp_replace(text, '[^{}\[\]",:]', '', 'g')) / length(text) * 100 as structure_pct from documents""",
    "url_paths": r"select page_id, n as file_name, lower(regexp_extract(n, '[^.](\.[^.]+)$', 1)) as extension, url ilike '%/en/%' as is_english_path from (select page_id, url, string_split(regexp_replace(replace(url, '\', '/'), '[?#].*$', ''), '/')[-1] as n from pages) x",
    "ocr_routing": r"""select doc_id, ((length(trim(text)) < 100 and (doc_id % 3 = 0 or n_chars % 2 > 0)) or doc_id % 3 = 1) as needs_ocr,
 case when n_chars % 100 < 40 then 'low confidence' when length(trim(text)) < 3 then 'too short' when length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) / greatest(length(regexp_replace(text, '[ \n]', '', 'g')), 1) < 0.5 then 'too few letters' else 'ok' end as verdict from documents""",
    "confidentiality": CONF_SQL,
    "record_type_votes": VOTES_SQL,
    "country_votes": COUNTRY_SQL,
    "taxonomy_labels": _taxonomy_sql(),
    "smart_ids": r"""with k as (select *, case when doc_id % 3 = 0 then sha256(text) when doc_id % 3 = 1 then 'file-' || doc_id else 'path-' || source end as file_key from documents)
select doc_id, file_key, case when doc_id % 2 = 0 then regexp_replace(upper(source), '[^A-Z0-9]', '', 'g')[:3] else 'DOC' end || '-' || case when doc_id % 5 = 0 then '20240309' else '20260101' end || '-' || upper(sha1(file_key)[:4]) as smart_id, case when doc_id % 2 = 0 then 'pdf' else 'jpg' end as file_type from k""",
    "allowed_values": ALLOWED_SQL,
    "metadata_row_match": """with r as (select n_nationkey as row, lower(n_name) as rname, 'src' || n_nationkey as rpath from nation),
p as (select doc_id, row, case when ('x ' || lang || ' ' || source) = rname then 80 when contains('x ' || lang || ' ' || source, rname) then 45 else 0 end + case when source = rpath then 70 when contains(source, rpath) then 35 else 0 end as points from documents, r),
b as (select *, row_number() over (partition by doc_id order by points desc, row) as k from p where points > 0)
select doc_id, points::bigint as points, row::bigint as row from b where k = 1""",
}
SQL["ocr_correction_counts"] = _sql_counts()
SQL["ocr_corrections"] = f"select doc_id, sha256({_sql_rules()}) as corrected_hash from documents"


def _subtags_sql() -> str:
    words = sorted({w for _, label, aliases, keywords, _ in V.TAXONOMY for w in (label.lower(), *aliases, *keywords) if len(w) >= 3})
    return "[" + ", ".join(f"case when regexp_matches(t, '{T.phrase_pattern(w)}') then '{w}' end" for w in words) + "]"


_CANDIDATES_SQL = "case doc_id % 6 when 0 then regexp_extract(text, '^(\\S*)', 1) when 1 then regexp_extract(text, '(\\S+\\s+\\S+)', 1) when 2 then text[:90] when 3 then upper(replace(text[:24], 'ß', 's')) when 4 then source || '=' || n_chars || '000' else [" + ", ".join(f"'{g}'" for g in GARBAGE) + f"][doc_id % {len(GARBAGE)} + 1] end"
SQL["entity_cleanup"] = f"select doc_id, v as entity, {_garbage_sql()} as garbage from (select doc_id, {_CANDIDATES_SQL} as v from documents) x"
_MONEY_TEXT = "concat_ws(' ', 'Paid USD 1,200.50 and $ 7 on 2024-01-31, 3/4/21 or Jan 5, 2020.', text)"
_ordered = lambda p, t: f"list_transform(list_filter(list_zip(regexp_extract_all({t}, '{p}'), range(0, len(regexp_extract_all({t}, '{p}')))), lambda z: list_position(regexp_extract_all({t}, '{p}'), z[1]) = z[2] + 1), lambda z: z[1])"
SQL["money_and_dates"] = f"select doc_id, array_to_string({_ordered(V.MONEY, _MONEY_TEXT)}[1:5], '|') as amounts, array_to_string({_ordered(V.DATES, _MONEY_TEXT)}[1:5], '|') as dates from documents"
_NAMES_TEXT = "'Jane Doe met JANE DOE and Jane  Doe at Société Générale for USD 5 or $7. ' || text"
SQL["entity_lists"] = f"""
with c as (select doc_id, unnest(regexp_extract_all({_NAMES_TEXT}, '\\p{{Lu}}\\p{{Ll}}+(?: \\p{{Lu}}\\p{{Ll}}+){{1,3}}')) as v, generate_subscripts(regexp_extract_all({_NAMES_TEXT}, '\\p{{Lu}}\\p{{Ll}}+(?: \\p{{Lu}}\\p{{Ll}}+){{1,3}}'), 1) as i from documents),
good as (select doc_id, arg_min(v, i) as v, min(i) as i from c where not {_garbage_sql()} group by doc_id, lower(v)),
firsts as (select doc_id, v, i from good qualify row_number() over (partition by doc_id order by i) <= 10),
m as (select doc_id, regexp_extract_all({_NAMES_TEXT}, '{V.MONEY}') as a from documents)
select m.doc_id, coalesce(n.names, '') as names, coalesce(list_filter(a, lambda y: regexp_matches(y, '[₹$€£]'))[1], a[1], '') as amount
from m left join (select doc_id, string_agg(v, '|' order by i) as names from firsts group by doc_id) n using (doc_id)"""
SQL["tag_details"] = f"""select doc_id, array_to_string(list_filter({_subtags_sql()}, lambda x: x is not null)[1:15], ',') as subtags,
 case when doc_id % 4 = 0 then case when doc_id % 3 = 0 then 'no_match' else 'forced' end when doc_id % 4 = 1 then 'pass' else 'none' end as provenance, length(trim(text)) < 50 and doc_id % 2 <> 0 as too_little
 from (select doc_id, text, trim(regexp_replace(lower(translate({_HINT_SQL}, '_\\/', '   ')), {_SPACES})) as t from documents) x"""
SQL["registry_casing"] = """
with known as (select distinct v, lower(trim(v)) as k from (select p_type as v from part union all select p_brand from part) x),
parts as (select p_partkey, i, lower(trim(([lower(p_type), 'unknown', upper(p_brand)])[i])) as k from part, range(1, 4) r(i))
select p_partkey, coalesce(string_agg(v, ', ' order by i), '') as labels from parts left join known using (k) group by p_partkey"""
SQL["enhancement"] = "with x as (select l_orderkey, l_linenumber, l_quantity * 5 as b, l_quantity + l_linenumber * 5 as c, l_partkey % 300 as s, case when l_linenumber = 1 then l_discount * 10 end as q from lineitem) select l_orderkey, l_linenumber, case when q is not null then case when q < 0.3::double then 'EXTREME_RESTORE' when q < 0.5::double then 'AGGRESSIVE' when q < 0.7::double then 'BALANCED' else 'LIGHT' end when c < 25 then 'EXTREME_RESTORE' when c < 40 or s < 80 then 'AGGRESSIVE' when s < 150 then 'BALANCED' when b < 60 or b > 200 then 'AGGRESSIVE' when b < 100 or b > 160 then 'BALANCED' else 'LIGHT' end as mode, case when b < 80 then 0.85 when b > 180 then 1.15 else 1.0 end::double as gamma from x"
SQL["page_shares"] = "with x as (select l_orderkey, l_linenumber, case when l_linenumber > 1 then l_quantity else 0 end::double as c, case when l_linenumber > 2 then l_discount * 100 else 0 end::double as n from lineitem) select l_orderkey, l_linenumber, case when c + n > 0 then c * 100 / (c + n) else 0 end as clean, case when c + n > 0 then n * 100 / (c + n) else 0 end as noise, case when c + n > 0 then 0 else 100 end::double as whitespace from x"
SQL["tag_requests"] = f"""
with base as ({_taxonomy_sql().strip()}), v as ({VOTES_SQL.strip()}), c as ({COUNTRY_SQL.strip()}), x as (select doc_id, length(trim({_HINT_SQL})) < 50 and doc_id % 4 = 3 as little from documents),
j as (select base.doc_id, little, v.record_category, v.business_unit, c.countries, department, department_review, base.doc_id % 4 as k, base.category, base.purpose, category_review, purpose_review, base.category in (select label from (values {", ".join(f"('{r[1]}')" for r in V.TAXONOMY if r[0] == "category")}) t(label)) as is_label,
  case base.doc_id % 4 when 0 then '{CATEGORY}' when 1 then 'Own label' else base.category end as cat from base join v using (doc_id) join c using (doc_id) join x using (doc_id)),
m as (select *, list_distinct(regexp_extract_all(lower(cat), '[a-z0-9]{{2,}}')) as w, list_distinct(regexp_extract_all(lower('{CATEGORY}'), '[a-z0-9]{{2,}}')) as cw from j),
n as (select *, case when lower(cat) = lower('{CATEGORY}') then 'pass' when length(cat) >= 4 and (contains(lower('{CATEGORY}'), lower(cat)) or contains(lower(cat), lower('{CATEGORY}'))) or len(list_intersect(w, cw)) > 0 then 'forced' else 'no_match' end as how from m)
select doc_id, case when little then 'Unclassified' when record_category <> '' then record_category when how = 'no_match' then cat else '{CATEGORY}' end as final_category,
  case when little then 'Unclassified' else business_unit end as final_department, case when little then 'Unclassified' when k = 2 then 'Odd purpose' else purpose end as final_purpose,
  s.source || '/' || how as category_source, case when k = 2 then 'metadata_derived' else s.purpose_source end as purpose_source, department as department_label,
  little or how = 'forced' or (k > 1 and category_review) or (k <> 2 and purpose_review) or department_review as review_required,
  case when little then 'insufficient_content' when how = 'forced' or (k > 1 and category_review) or (k <> 2 and purpose_review) or department_review then 'needs_review' else 'tagged' end as tagging_status, countries
from n join (select doc_id, case when doc_id % 4 < 2 then 'metadata_explicit' when weak_category then 'deterministic_default' else 'model' end as source, case when weak_purpose then 'deterministic_default' else 'model' end as purpose_source from ({_taxonomy_sql(weak=True).strip()}) z) s using (doc_id)
"""
