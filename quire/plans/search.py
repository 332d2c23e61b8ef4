"""Searches over the inverted index of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import routes, textindex
from quire.operators.search import minimum_should_match as floor_of
from quire.session import input_state, shared_base
from quire.sources.tables import table

TERMS = ("the", "with", "und", "contract", "der")
RARE = ("with", "und", "thand")
ACCURATE = "of the report"
INDEXED = ["text", "source"]


def documents_index(spark, d):
    """The index of the documents' texts and sources, in the shared folder under a name that the table's files give; made where
    it isn't there yet, and opened once in a session."""
    path = f"{shared_base(spark)}/quire-index-2-{input_state(spark, f'{d}/documents.parquet')}"
    opened = spark.sparkContext.__dict__.setdefault("_quire_indexes", {})
    if path not in opened:
        opened[path] = textindex.append(path, table(spark, d, "documents"), "doc_id", INDEXED, "0")
    return opened[path]


def phrase_search(spark, d):
    return textindex.phrase_matches(documents_index(spark, d), {"text": 2.0, "source": 5.0}, ["of", "the"]).select(F.col("key").alias("doc_id"), "score")


def minimum_should_match(spark, d):
    return textindex.term_matches(documents_index(spark, d), "text", list(TERMS), floor_of(len(TERMS), 0.5)).select(F.col("key").alias("doc_id"), "matched")


def bm25_topk(spark, d):
    return textindex.top_k(documents_index(spark, d), "text", list(RARE), 50).rows.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


def search_router(spark, d):
    return textindex.top_k(documents_index(spark, d), "text", ["with", "their"], 25).rows.select(F.col("key").alias("doc_id"))


def accurate_search(spark, d):
    found = textindex.blended(documents_index(spark, d), {"text": 2.0, "source": 5.0}, routes.words_of(ACCURATE), routes.synonyms)
    allowed = table(spark, d, "documents").where(F.col("lang").isin("en", "fr")).select(F.col("doc_id").alias("key"))
    return found.join(allowed, "key", "left_semi").select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


def term_statistics(spark, d):
    """Documents and occurrences of each term of each field, from the postings alone."""
    rows = documents_index(spark, d).rows
    return rows.groupBy("field", "term").agg(F.sum("n").alias("documents"), F.sum("words").alias("occurrences"))


QUERIES = {f.__name__: f for f in (phrase_search, minimum_should_match, bm25_topk, search_router, accurate_search, term_statistics)}

_T = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
_S = r"regexp_extract_all(lower(coalesce(source, '')), '[\p{L}\p{N}]+')"


def bm25_sql(terms: tuple[str, ...]) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) as tf{i}" for i, t in enumerate(terms))
    score = " + ".join(f"ln(1 + (docs - d{i} + 0.5) / (d{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(terms)))
    return f"""with c as (select doc_id, len(w) as n, {tf} from (select doc_id, {_T} as w from documents) x), f as (select count(*)::double as docs, avg(n) as mean, {', '.join(f'count(*) filter (where tf{i} > 0) as d{i}' for i in range(len(terms)))} from c)
select doc_id, {score} as score from c, f where {' + '.join(f'tf{i}' for i in range(len(terms)))} > 0"""


SQL = {
    "phrase_search": r"select doc_id, 2.0::double as score from documents where regexp_matches(lower(text), '(^|[^\p{L}\p{N}])of[^\p{L}\p{N}]+the($|[^\p{L}\p{N}])')",
    "minimum_should_match": f"select doc_id, m as matched from (select doc_id, {' + '.join(f'''list_contains({_T}, '{t}')::int''' for t in TERMS)} as m from documents) x where m >= 2",
    "bm25_topk": f"select doc_id, round(score, 6) as score from ({bm25_sql(RARE)}) x order by x.score desc, doc_id limit 50",
    "search_router": f"select doc_id from ({bm25_sql(('with', 'their'))}) x order by score desc, doc_id limit 25",
    "accurate_search": f"""with f as (select doc_id, lang, {_T} as t, {_S} as s from documents),
m as (select 'text' as field, 2.0 as boost, count(*)::double as docs, avg(len(t)) as mean from f union all select 'source', 5.0, count(*)::double, avg(len(s)) from f),
p as (select doc_id, 'text' as field, len(t) as n, unnest(t) as w from f union all select doc_id, 'source', len(s), unnest(s) from f),
tf as (select doc_id, field, n, w, count(*) as tf from p where w in ('of', 'the', 'report', 'analysis', 'summary') group by all),
df as (select field, w, count(*) as df from tf group by all),
g as (select * from (values ('of', 'of'), ('the', 'the'), ('report', 'report'), ('report', 'analysis'), ('report', 'summary')) v(term, w)),
gd as (select term, max(df) as df from g join df using (w) group by 1),
x as (select doc_id, field, n, term, sum(tf) as tf from tf join g using (w) group by all),
best as (select doc_id, term, max(boost * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) as s from x join gd using (term) join m using (field) group by all),
terms as (select doc_id, sum(s) as score from best group by 1 having count(*) >= 2),
said as (select doc_id, 'text' as field, len(t) as n, len(list_filter(range(1, len(t) - 1), lambda i: t[i] = 'of' and t[i + 1] = 'the' and t[i + 2] = 'report')) as tf from f
  union all select doc_id, 'source', len(s), len(list_filter(range(1, len(s) - 1), lambda i: s[i] = 'of' and s[i + 1] = 'the' and s[i + 2] = 'report')) from f),
w as (select field, sum(ln(1 + (docs - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5))) as idf from m cross join (values ('of'), ('the'), ('report')) q(w) left join df using (field, w) group by 1),
phrase as (select doc_id, max(2 * boost * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) as more from said join m using (field) join w using (field) where tf > 0 group by 1)
select doc_id, round(score + coalesce(more, 0), 6) as score from terms left join phrase using (doc_id) join f using (doc_id) where lang in ('en', 'fr')""",
    "term_statistics": f"with p as (select doc_id, 'text' as field, unnest({_T}) as term from documents union all select doc_id, 'source', unnest({_S}) from documents) select field, term, count(distinct doc_id) as documents, count(*) as occurrences from p group by all",
}
