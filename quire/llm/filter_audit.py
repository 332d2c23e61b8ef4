"""How filters interact: what each filter removes at each step of every order of application.

Method.  With five filters there are 80 edges (already-applied subset, next filter) of the subset lattice, and an order is
a path of five edges.  A document's outcome on an edge depends only on the set of filters it fails, so documents are first
counted by (part, set failed); these counts contribute to all 80 edges, and the aggregated edges are joined to the 600
(order, step) pairs.  A filter's Shapley figure is its removals weighted by the number of paths over each edge.

Scale.  The texts are read once; what is shuffled is one short row a document, by (digest, id) and by id, so neither a
text with very many copies nor a part with a third of the rows meets in one task.  All later tables have 32, 80 or 600
rows a part."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialise, spread

LETTERS = "ABCDE"


@dataclass(frozen=True)
class AuditParams:
    min_words: int = 200
    min_distinct_percent: int = 50
    max_capital_percent: int = 2
    symbols: str = "[#$%&*|]"


def failed_by_text(text: Column, params: AuditParams = AuditParams()) -> Column:
    """The filters A to D that a text fails, as bits 1, 2, 4, 8."""
    p = params
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    tests = (n < p.min_words, distinct * 100 < n * p.min_distinct_percent, capitals * 100 > F.length(text) * p.max_capital_percent, text.rlike(p.symbols))
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))


def failures(docs: DataFrame, params: AuditParams = AuditParams(), doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """id, part and failed (bits of A to E) of each row.

    Null texts count as empty, null parts as the empty string.  E: the text is that of a smaller id anywhere in the table;
    rows of one id don't duplicate each other, and a row without an id is neither a duplicate nor the first of one.  Very
    long texts are judged whole; an empty table gives no row; other columns don't matter.

    The first id of each text comes from one aggregation with partial minima; rows then meet it by (digest, id)."""
    body = F.coalesce(docs[text], F.lit(""))
    own = spread(docs.select(docs[doc_id].alias("id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), body.alias("body")))
    rows = materialise(own.select("id", "part", failed_by_text(F.col("body"), params).alias("low"), F.unhex(F.sha2("body", 256)).alias("digest")), "failures")
    known = rows.where("id is not null")
    firsts = known.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    judged = known.join(firsts, ["digest", "id"], "left").select("id", "part", (F.col("low") + F.when(F.col("first").isNull(), 16).otherwise(0)).alias("failed"))
    return judged.unionByName(rows.where("id is null").select("id", "part", F.col("low").alias("failed")))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic (0 or 1); of repeated labels of an id any 1 counts, null labels and ids count as absent."""
    one = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))))
    zero = F.lit(0)
    known = rows.where("id is not null").join(one, "id", "left").select("part", "failed", F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"))
    return known.unionByName(rows.where("id is null").select("part", "failed", zero.alias("good"), zero.alias("toxic")))


def lattice_edges(cells: DataFrame) -> DataFrame:
    """part, subset, filter (its place), kept, removed, redundant, unique_fails, good_lost, toxic_lost of the 80 edges of each
    part, from cells (part, failed, n, good, toxic)."""
    edges = F.array(*(F.struct(F.lit(s).alias("subset"), F.lit(f).alias("filter")) for f in range(5) for s in range(32) if not s >> f & 1))
    at = cells.select("*", F.explode(edges).alias("e")).select("part", "failed", "n", "good", "toxic", "e.subset", "e.filter")
    bit = F.expr("shiftleft(1, filter)")
    fails, gone = F.col("failed").bitwiseAND(bit) != 0, F.col("failed").bitwiseAND(F.col("subset")) != 0

    def count(what: str, when: Column, name: str) -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long").alias(name)

    return at.groupBy("part", "subset", "filter").agg(
        count("n", ~fails & ~gone, "kept"), count("n", fails & ~gone, "removed"), count("n", fails & gone, "redundant"), count("n", F.col("failed") == bit, "unique_fails"), count("good", fails & ~gone, "good_lost"), count("toxic", fails & ~gone, "toxic_lost")
    )


def steps(spark) -> DataFrame:
    """filter_order, step, subset, filter of the 600 steps of the 120 orders."""
    rows = []
    for order in permutations(range(5)):
        applied = 0
        for i, f in enumerate(order):
            rows.append(("".join(LETTERS[x] for x in order), i + 1, applied, f))
            applied |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, subset int, filter int")


def filter_audit(docs: DataFrame, labels: DataFrame, params: AuditParams = AuditParams(), doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part,
    order and step, zeros included.

    Rows with odd values are treated as failures() and with_labels() say; repeated rows count each; an empty table has no
    part and gives no row; columns besides those named don't matter."""
    rows = with_labels(failures(docs, params, doc_id, text, part), labels)
    cells = rows.groupBy("part", "failed").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    paths = F.element_at(F.array(*(F.lit(factorial(k) * factorial(4 - k)) for k in range(5))), F.bit_count("subset") + 1)
    over = Window.partitionBy("part", "filter")
    edges = lattice_edges(cells).withColumn("shapley", F.sum(F.col("removed") * paths).over(over))
    return edges.join(F.broadcast(steps(docs.sparkSession)), ["subset", "filter"]).drop("subset", "filter")  # 600 rows


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The audit of filters A to E over all documents."""
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


# Plain: every order is applied step by step to the documents, counted by what they fail.
SQL = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
b as (select doc_id, part, len(w) < 200 as a, 100 * len(list_distinct(w)) < 50 * len(w) as b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) as c, regexp_matches(t, '[#$%&*|]') as d,
    coalesce(doc_id > min(doc_id) over (partition by t), false) as e from d),
l as (select doc_id, max((coalesce(quality, 0) = 1)::int) as good, max((coalesce(toxic, 0) = 1)::int) as toxic from labels group by 1),
c as (select part, case when a then 'A' else '' end || case when b then 'B' else '' end || case when c then 'C' else '' end || case when d then 'D' else '' end || case when e then 'E' else '' end as fails,
    count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from b left join l using (doc_id) group by all),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select p.x || q.x || r.x || s.x || t.x as filter_order from f p, f q, f r, f s, f t where len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
s as (select filter_order, step::int as step, filter_order[:step - 1] as before, filter_order[step] as x from o, range(1, 6) g(step)),
r as (select part, filter_order, step, x, coalesce(sum(n) filter (where not early and not late), 0)::bigint as kept, coalesce(sum(n) filter (where late and not early), 0)::bigint as removed, coalesce(sum(n) filter (where late and early), 0)::bigint as redundant,
    coalesce(sum(n) filter (where fails = x), 0)::bigint as unique_fails, coalesce(sum(good) filter (where late and not early), 0)::bigint as good_lost, coalesce(sum(toxic) filter (where late and not early), 0)::bigint as toxic_lost
  from (select *, contains(fails, x) as late, step > 1 and fails <> '' and regexp_matches(fails, '[' || before || '_]') as early from c, s) y group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, x))::bigint as shapley from r"""
