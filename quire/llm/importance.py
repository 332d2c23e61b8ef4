"""Importance resampling towards a target: documents whose hashed n-grams look like the benchmark's get higher weights, and
a sample is drawn by the Gumbel trick.

Method, in Spark SQL functions only.  Each document's n-grams are exploded and hashed by crc32 into buckets; bucket counts
of the corpus and of the target give a gain for each bucket; the table of gains (`buckets` rows at most) is broadcast and
joined to the exploded n-grams, and a document's gains are summed.  The score adds Gumbel noise from a hash of the id, and
the highest scores are drawn: a range-partitioned sort, whose partitions' sizes are summed to offsets, so a rank is offset
plus place.

Scale.  The n-grams are aggregated where they are made: per bucket before the first shuffle, per row before the second, so
what is shuffled is a row for each bucket and task and a row for each document.  The only task-wide tables have a row a
bucket or a row a partition."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialise, spread

#: What stands between words: all ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class ImportanceParams:
    longest: int = 1  # words of the longest n-gram
    buckets: int = 10_000
    min_words: int = 20
    percent: int = 10
    seed: int = 2024


def _lowered(x: Column) -> Column:
    """A-Z lowered, all else as it is; lower() does that faster where every character is ASCII."""
    return F.when(F.length(x) == F.octet_length(x), F.lower(x)).otherwise(F.translate(x, _UPPER, _LOWER))


def _features(df: DataFrame, params: ImportanceParams) -> DataFrame:
    """df with text exploded to a row for each feature, as its bucket, and one (whether it is a single word); a row with nulls for a text
    without words."""
    words, rest = F.split("text", BETWEEN), [c for c in df.columns if c != "text"]
    if params.longest == 1:
        grams = df.select(*rest, F.explode_outer(words).alias("gram")).withColumn("one", F.lit(1))
    else:
        held = df.select(*rest, F.filter(words, lambda w: w != "").alias("w"))

        def runs_of(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.size("w") - n + 1)
            return F.when(F.size("w") >= n, F.transform(starts, lambda i: F.struct(F.array_join(F.slice("w", i, n), " ").alias("gram"), F.lit(int(n == 1)).alias("one"))))

        none = F.array().cast("array<struct<gram: string, one: int>>")
        runs = F.flatten(F.array(*(F.coalesce(runs_of(n), none) for n in range(1, params.longest + 1))))
        grams = held.select(*rest, F.explode_outer(runs).alias("g")).select(*rest, "g.gram", "g.one")
    bucket = F.when(F.col("gram") != "", (F.crc32(_lowered(F.col("gram")).cast("binary")) % params.buckets).cast("int"))
    return grams.select(*rest, bucket.alias("bucket"), "one")


def gains(docs: DataFrame, target: DataFrame, params: ImportanceParams = ImportanceParams()) -> DataFrame:
    """bucket, gain: floor(1000 ln of target's over corpus's smoothed share) for each bucket that either has; docs and target
    need a column text."""
    n = params.buckets
    s = _features(docs.select("text"), params).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("s")).withColumn("t", F.lit(0))
    t = _features(target.select("text"), params).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("t")).select("bucket", F.lit(0).alias("s"), "t")
    every = Window.partitionBy()  # `buckets` rows at most
    both = s.unionByName(t).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).select("bucket", "s", "t", F.sum("s").over(every).alias("all_s"), F.sum("t").over(every).alias("all_t"))
    d = {c: F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t")}
    ratio = (d["t"] + 1) * (d["all_s"] + n) / ((d["s"] + 1) * (d["all_t"] + n))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def resample(docs: DataFrame, target: DataFrame, params: ImportanceParams = ImportanceParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of each row of docs; target has a column `text`.

    Null and empty texts have no feature and weight 0; very long texts count whole.  A null id counts as the empty string
    in the noise and comes last among equal scores; repeated rows are scored each and, as ties, ranked one after another;
    an empty corpus gives no row, an empty target smoothed shares of nothing; other columns don't matter."""
    p = params
    own = spread(docs.select(docs[doc_id].alias("id"), docs[text].alias("text"))).withColumn("place", F.monotonically_increasing_id())
    table = materialise(gains(docs.select(docs[text].alias("text")), target.select("text"), p), "gains")
    found = _features(own, p).join(F.broadcast(table), "bucket", "left")  # p.buckets rows at most
    sums = found.groupBy("place", "id").agg(F.count("bucket").alias("n_features"), F.count(F.when(F.col("bucket").isNotNull(), F.nullif("one", F.lit(0)))).alias("n_words"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = materialise(sums.withColumn("score", F.col("weight") + noise), "scores")
    able, unable = scored.where(F.col("n_words") >= p.min_words), scored.where(F.col("n_words") < p.min_words)
    in_order = materialise(able.orderBy(F.desc("score"), F.asc_nulls_last("id"), "place").withColumn("at", F.monotonically_increasing_id()), "order")
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = in_order.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row a partition
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.floor(F.sum("n").over(Window.partitionBy()) * p.percent / 100).alias("drawn"))
    rank = F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = in_order.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.when(rank <= F.col("drawn"), rank))
    columns = (F.col("id").alias(doc_id), "n_features", "weight", "score", "rank")
    return ranked.select(*columns).unionByName(unable.withColumn("rank", F.lit(None).cast("long")).select(*columns))


def op13_importance(spark, sf_dir: str) -> DataFrame:
    """All documents weighed towards the benchmark's texts, a tenth of those with 20 words drawn."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


# crc32 of each distinct word, byte by byte with the usual table of the reversed polynomial.
SQL = r"""
with words as (select 0 as kind, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from documents
  union all select 1, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) from benchmark),
crc as (select list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as tab from (select range::bigint as i from range(256)) r),
hashed as (select w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::bigint, 2))::bigint)), lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1])), 4294967295) % 10000 as bucket from (select distinct w from words) u, crc),
f as (select kind, doc_id, bucket from words join hashed using (w)),
b as (select bucket, (count(*) filter (where kind = 0))::double as s, (count(*) filter (where kind = 1))::double as t from f group by 1),
g as (select bucket, floor(1000 * ln((t + 1) * ((select sum(s) from b) + 10000) / ((s + 1) * ((select sum(t) from b) + 10000))))::bigint as gain from b),
d as (select doc_id, count(bucket) as n_features, coalesce(sum(gain), 0)::bigint as weight from documents left join (select doc_id, bucket from f where kind = 0) x using (doc_id) left join g using (bucket) group by 1),
s as (select *, weight + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[:8])::bigint + 0.5) / 4294967296)))::bigint as score from d),
r as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from s where n_features >= 20)
select s.doc_id, n_features, weight, score, case when rank <= n * 10 // 100 then rank end as rank from s left join r using (doc_id)"""
