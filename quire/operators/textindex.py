"""A positional inverted index as Parquet: segments of postings, cut into blocks of documents and bucketed by term.

A row of postings is one term in one field of one block: the keys of the documents that hold it, how often, the lengths of
their fields, and the positions of one document after the other.  A document's block is a hash of its key, so all its postings carry one block number, and
no row holds more than a block's documents, however common the term.  Rows lie in a folder for each bucket of terms, sorted
by term and block; a query for some terms reads only their buckets and, by the files' statistics, only their row groups,
and of these only the columns it needs (positions for phrases alone).

Each row also has its number of documents and what bounds a document's BM25 part in it, so the k best are found without
decoding blocks that can't reach the k-th score.

A segment is one append.  Its statistics are written last and name it; a segment without them, as a failed append leaves,
is never read and is written anew by the next append of its name; appending a complete segment again changes nothing.  Keys
must be new to the index."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.analysis import search_tokens
from quire.session import exists

MEAN_DOCS = 2_000
LISTED_BLOCKS = 2_000  # block numbers that are pushed to the scan as a list; more of them are joined


@dataclass(frozen=True)
class Layout:
    buckets: int = 16
    block_docs: int = 512  # on average
    k1: float = 1.2
    b: float = 0.75
    partition_bytes: int = 16 << 20  # of the stored documents for each task, which holds all their postings


@dataclass(frozen=True)
class TextIndex:
    """A snapshot: the postings of the segments that were complete when it was loaded, and their statistics."""

    path: str
    layout: Layout
    rows: DataFrame = field(repr=False)
    parts: tuple[tuple[str, str, int, int], ...]  # segment, field, documents, words


def load(spark: SparkSession, path: str, layout: Layout = Layout()) -> TextIndex:
    parts = tuple(sorted((r["segment"], r["field"], r["docs"], r["words"]) for r in spark.read.parquet(f"{path}/fields").collect()))  # a row a segment and field
    rows = spark.read.parquet(f"{path}/postings").where(F.col("segment").isin(*{p[0] for p in parts}))
    return TextIndex(path, layout, rows, parts)


def _bucket_of(term: str, layout: Layout) -> int:
    return zlib.crc32(term.encode()) % layout.buckets


def _block_postings(fields: list[str], per_word: list[float], b: float) -> Callable[[pa.Table], pa.Table]:
    """From the documents of a block (key, block, a column of tokens for each field) to its rows of postings."""

    def of_field(block: pa.Array, key: pa.Array, tokens: pa.ListArray, name: str, u: float) -> pa.Table | None:
        lens = np.diff(tokens.offsets.to_numpy())
        words = tokens.flatten().dictionary_encode()
        code = words.indices.to_numpy()
        order = np.argsort(code, kind="stable")  # by term, then document, then place
        code, doc = code[order], np.repeat(np.arange(len(lens)), lens)[order]
        place = order - (np.cumsum(lens) - lens)[doc]
        changes = lambda *xs: np.flatnonzero(np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in xs])]) if len(xs[0]) else np.zeros(0, np.int64)
        hit = changes(code, doc)  # where a document's places of a term begin
        tf, of, term = np.diff(np.r_[hit, len(code)]), doc[hit], code[hit]
        row = changes(term)
        if not len(row):
            return None
        int32 = lambda x: pa.array(x.astype(np.int32))
        n, ends = len(row), np.r_[row, len(hit)]
        listed = lambda values: pa.ListArray.from_arrays(int32(ends), values)
        positions = pa.ListArray.from_arrays(int32(np.r_[hit, len(code)][ends]), int32(place))
        return pa.table({
            "term": words.dictionary.take(pa.array(term[row])), "field": pa.array([name] * n), "block": pa.array(np.full(n, block[0].as_py())), "n": int32(np.diff(ends)), "words": int32(np.add.reduceat(tf, row)),
            "max_tf": int32(np.maximum.reduceat(tf, row)), "least": pa.array(np.minimum.reduceat(((1 - b) + b * lens[of] * u) / tf, row)), "u": pa.array(np.full(n, u)),
            "keys": listed(key.take(pa.array(of))), "tfs": listed(int32(tf)), "lens": listed(int32(lens[of])), "positions": positions,
        })

    def run(docs: pa.Table) -> pa.Table:
        docs = docs.take(pc.sort_indices(docs, [("key", "ascending")])).combine_chunks()
        column = lambda c: docs.column(c).combine_chunks()
        parts = [of_field(column("block"), column("key"), column(f"t{i}"), f, per_word[i]) for i, f in enumerate(fields)]
        parts = [x for x in parts if x is not None]
        return pa.concat_tables(parts) if parts else pa.table({})

    return run


def append(path: str, docs: DataFrame, key: str, fields: list[str], segment: str, layout: Layout = Layout()) -> TextIndex:
    """The index at the path with the documents added as a segment; the first one makes it.

    Only the texts are shuffled, once, by block: a task makes all postings of its documents, block by block, and writes them
    into the buckets' folders, so a term that every document holds is written by all tasks, and a task's size is that of its
    share of the texts.  The fields' lengths are summed from the postings; the mean that the blocks' bounds are made for is that
    of MEAN_DOCS documents, as bounds hold for any."""
    spark, lay = docs.sparkSession, layout
    if exists(spark, f"{path}/fields/segment=s-{segment}/_SUCCESS"):
        return load(spark, path, layout)
    held = docs.select(F.col(key).alias("key"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)])
    sized = [F.size(search_tokens(F.col(f"f{i}"))) for i in range(len(fields))]
    some = held.limit(MEAN_DOCS).agg(F.count("*"), *[F.sum(x) for x in sized]).first()
    n = held.count()
    blocks = max(1, -(-n // lay.block_docs))
    estimate = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = -(-estimate // lay.partition_bytes) if estimate < 1 << 50 else int(spark.conf.get("spark.sql.shuffle.partitions"))  # rows from the driver have no estimate
    parts = max(1, min(blocks, max(parts, spark.sparkContext.defaultParallelism)))
    by_block = held.withColumn("block", F.pmod(F.xxhash64(F.col("key")), F.lit(blocks))).repartition(parts, "block").sortWithinPartitions("block")  # texts are sorted, not their tokens
    tokens = by_block.select("key", "block", *[search_tokens(F.col(f"f{i}")).alias(f"t{i}") for i in range(len(fields))])
    made = _block_postings(fields, [(some[0] or 1) / max(1, words or 1) for words in some[1:]], lay.b)
    kind = held.schema["key"].dataType.simpleString()
    packed = tokens.groupBy("block").applyInArrow(made, f"term string, field string, block long, n int, words int, max_tf int, least double, u double, keys array<{kind}>, tfs array<int>, lens array<int>, positions array<int>")
    out = packed.withColumn("bucket", (F.crc32(F.col("term").cast("binary")) % lay.buckets).cast("int"))
    out.sortWithinPartitions("bucket", "term", "field", "block").write.mode("overwrite").option("parquet.page.size", 64 << 10).partitionBy("bucket").parquet(f"{path}/postings/segment=s-{segment}")
    words = {r["field"]: r["words"] for r in spark.read.schema("field string, words int").parquet(f"{path}/postings/segment=s-{segment}").groupBy("field").agg(F.sum("words").alias("words")).collect()}  # a row a field
    facts = spark.createDataFrame([(f, int(n), int(words.get(f, 0))) for f in fields], "field string, docs long, words long")
    facts.coalesce(1).write.mode("overwrite").parquet(f"{path}/fields/segment=s-{segment}")
    return load(spark, path, layout)


def postings(index: TextIndex, terms: list[str]) -> DataFrame:
    """The rows of the terms: bucket and segment are folders, the term is what the files are sorted by."""
    return index.rows.where(F.col("bucket").isin(*sorted({_bucket_of(t, index.layout) for t in terms})) & F.col("term").isin(*terms))


@dataclass(frozen=True)
class Facts:
    """What a ranking needs to know of the index: documents, mean length by field, documents that hold a term by field."""

    docs: int
    mean: dict[str, float]
    held: dict[tuple[str, str], int]

    def idf(self, df: int) -> float:
        return math.log(1 + (self.docs - df + 0.5) / (df + 0.5))


def facts(index: TextIndex, terms: list[str]) -> Facts:
    """A row for each field and term goes to the driver."""
    by_field: dict[str, list[int]] = {}
    for _, f, docs, words in index.parts:
        at = by_field.setdefault(f, [0, 0])
        at[0] += docs
        at[1] += words
    held = {(r["field"], r["term"]): r["df"] for r in postings(index, terms).groupBy("field", "term").agg(F.sum("n").alias("df")).collect()}
    return Facts(max((d for d, _ in by_field.values()), default=0), {f: w / d if d and w else 1.0 for f, (d, w) in by_field.items()}, held)


def _by(values: dict, of: Column) -> Column:  # noqa: ANN001
    """The literal that belongs to a column's value."""
    out = F.lit(0.0)
    for k, v in values.items():
        out = F.when(of == k, F.lit(float(v))).otherwise(out)
    return out


def _part(index: TextIndex, tf: Column, length: Column, mean: float) -> Column:
    k1, b = index.layout.k1, index.layout.b
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def _hits(rows: DataFrame, *more: str) -> DataFrame:
    """A row for each document of the postings: key, tf, len and further columns."""
    return rows.select(*more, F.explode(F.arrays_zip(F.col("keys").alias("key"), F.col("tfs").alias("tf"), F.col("lens").alias("len"))).alias("h")).select(*more, "h.key", "h.tf", "h.len")


def term_matches(index: TextIndex, on: str, terms: list[str], need: int) -> DataFrame:
    """key, matched: documents whose field holds at least `need` of the distinct terms."""
    terms = list(dict.fromkeys(terms))
    rows = postings(index, terms).where(F.col("field") == on)
    return rows.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").cast("int").alias("matched")).where(F.col("matched") >= need)


def phrase_counts(index: TextIndex, fields: list[str], words: list[str]) -> DataFrame:
    """field, key, len, freq: how often a field holds the words one after the other.

    Only documents whose field holds each distinct word are intersected; a group is one document's postings of the words."""
    places = {w: [i for i, x in enumerate(words) if x == w] for w in dict.fromkeys(words)}
    of = F.create_map(*[x for w, at in places.items() for x in (F.lit(w), F.array(*map(F.lit, at)))])
    rows = postings(index, list(places)).where(F.col("field").isin(*fields))
    begins = F.aggregate("tfs", F.array(F.lit(0)), lambda a, tf: F.array_append(a, F.element_at(a, -1) + tf))  # in positions, of each document
    hits = rows.select("field", "term", "keys", "tfs", "lens", "positions", begins.alias("begins")).select("field", "term", F.explode(F.transform("keys", lambda k, i: F.struct(k.alias("key"), F.get("lens", i).alias("len"), F.slice("positions", F.get("begins", i) + 1, F.get("tfs", i)).alias("at")))).alias("h"))
    each = hits.select("field", "h.key", "h.len", F.transform(F.element_at(of, F.col("term")), lambda i: F.transform("h.at", lambda p: p - i)).alias("starts"))
    met = each.groupBy("field", "key").agg(F.first("len").alias("len"), F.count("*").alias("n"), F.flatten(F.collect_list("starts")).alias("starts")).where(F.col("n") == len(places))
    both = F.aggregate(F.slice("starts", 2, len(words)), F.get("starts", F.lit(0)), F.array_intersect)
    return met.select("field", "key", "len", F.size(both).alias("freq")).where("freq > 0")


def phrase_matches(index: TextIndex, boosts: dict[str, float], words: list[str], tie: float = 0.1) -> DataFrame:
    """key, score: the largest boost of a field that holds the phrase plus a share of the others."""
    if not words:
        return index.rows.select(F.get("keys", F.lit(0)).alias("key"), F.lit(0.0).alias("score")).where(F.lit(False))
    boost = _by(boosts, F.col("field"))
    found = phrase_counts(index, list(boosts), words).groupBy("key").agg(F.max(boost).alias("best"), F.sum(boost).alias("all"))
    return found.select("key", (F.col("best") + tie * (F.col("all") - F.col("best"))).alias("score"))


def _scores(index: TextIndex, rows: DataFrame, known: Facts, on: str) -> DataFrame:
    idf = _by({t: known.idf(df) for (f, t), df in known.held.items() if f == on}, F.col("term"))
    return _hits(rows, "term").groupBy("key").agg(F.sum(idf * _part(index, F.col("tf"), F.col("len"), known.mean[on])).alias("score"), F.count("*").cast("int").alias("matched"))


def bm25(index: TextIndex, on: str, terms: list[str], need: int = 1) -> DataFrame:
    """key, score, matched of all documents that hold at least `need` of the distinct terms."""
    terms = list(dict.fromkeys(terms))
    known = facts(index, terms)
    return _scores(index, postings(index, terms).where(F.col("field") == on), known, on).where(F.col("matched") >= need)


def block_bounds(index: TextIndex, on: str, terms: list[str], known: Facts) -> DataFrame:
    """segment, block, bound, rows: no document of the block scores above the bound.

    A document's part falls with g = (1 - b + b len / mean) / tf, whose least value over a block is concave in 1 / mean.  It is
    known for 1 / mean = 0 (from the largest tf) and for the mean of the segment as it was written, so between the two the
    chord lies below it, and beyond, the latter value does."""
    k1, b = index.layout.k1, index.layout.b
    at = F.lit(1 / known.mean[on])
    low = (1 - b) / F.col("max_tf")
    g = F.when(at <= F.col("u"), low + (F.col("least") - low) * at / F.col("u")).otherwise(F.col("least"))
    idf = _by({t: known.idf(df) for (f, t), df in known.held.items() if f == on}, F.col("term"))
    bound = idf * (k1 + 1) / (1 + k1 * g) * (1 + 1e-9)
    rows = postings(index, terms).where(F.col("field") == on)
    return rows.groupBy("segment", "block").agg(F.sum(bound).alias("bound"), F.count("*").alias("rows"))


@dataclass(frozen=True)
class Found:
    """The k best rows and how many blocks of documents were there and were decoded."""

    rows: DataFrame = field(repr=False)
    blocks: int
    decoded: int


def top_k(index: TextIndex, on: str, terms: list[str], k: int, first_blocks: int = 8) -> Found:
    """key, score of the k best documents (equals in nine digits by key), as bm25() ranks them.

    The blocks with the highest bounds are scored first; their k-th score is a floor, and only blocks whose bound reaches it
    are decoded for the answer.  Block numbers are pushed to the scan while they are few (LISTED_BLOCKS), else joined; k
    scores and these numbers are all that the driver sees."""
    terms = list(dict.fromkeys(terms))
    known = facts(index, terms)
    bounds = block_bounds(index, on, terms, known).persist()
    rows = postings(index, terms).where(F.col("field") == on)
    total, n_docs = bounds.count(), max(1, known.docs)
    ahead = max(first_blocks, 4 * k * total // n_docs)
    listed = bounds.orderBy(F.desc("bound"), "segment", "block").limit(min(ahead, LISTED_BLOCKS)).collect()
    some = _scores(index, _only(rows, listed), known, on).orderBy(F.desc("score")).limit(k).select("score").collect()
    floor = some[-1]["score"] if len(some) == k else 0.0
    reach = bounds.where(F.col("bound") >= floor - 1e-9)
    keep = reach.select("segment", "block").limit(LISTED_BLOCKS + 1).collect()
    if len(keep) <= LISTED_BLOCKS:
        read, n = _only(rows, keep), len(keep)
        bounds.unpersist()  # the other way reads it again
    else:
        read, n = rows.join(reach.select("segment", "block"), ["segment", "block"]), reach.count()
    best = _scores(index, read, known, on).orderBy(F.round("score", 9).desc(), "key").limit(k).select("key", "score")  # sums of another order differ in their last bits
    return Found(best, total, n)


def _only(rows: DataFrame, blocks: list) -> DataFrame:  # noqa: ANN001
    """Rows of the listed (segment, block) pairs; the block numbers go to the scan."""
    by_segment: dict[str, list[int]] = {}
    for r in blocks:
        by_segment.setdefault(r["segment"], []).append(r["block"])
    if not by_segment:
        return rows.where(F.lit(False))
    every = sorted({b for bs in by_segment.values() for b in bs})
    exact = F.lit(False)
    for s, bs in by_segment.items():
        exact = exact | ((F.col("segment") == s) & F.col("block").isin(*bs))
    return rows.where(F.col("block").isin(*every) & exact)


def blended(index: TextIndex, boosts: dict[str, float], words: list[str], synonyms=lambda w: [w], share: float = 0.75, phrase_boost: float = 2.0) -> DataFrame:  # noqa: ANN001
    """key, score of documents that hold, over all fields together, at least the floor of share x distinct terms.

    A term is looked for with its synonyms as one: their counts add up, and the documents that hold it are counted by the most
    frequent of them in the field where it is most frequent, so a term weighs the same in every field and a rare field doesn't
    make it rare.  Each term gives its best field's boost times its weight and that field's own length norm; the whole query
    as a phrase adds, in its best field, `phrase_boost` times the boost, the sum of the words' weights in the field and its
    norm."""
    terms = list(dict.fromkeys(words))
    groups = {t: list(dict.fromkeys(synonyms(t))) for t in terms}
    every = sorted({s for g in groups.values() for s in g} | set(terms))
    known = facts(index, every)
    weight = [known.idf(max((known.held.get((f, s), 0) for f in boosts for s in groups[t]), default=0)) for t in terms]
    of = F.create_map(*[x for s in every for x in (F.lit(s), F.array(*[F.lit(j) for j, t in enumerate(terms) if s in groups[t]]).cast("array<int>"))])
    rows = postings(index, every).where(F.col("field").isin(*boosts))
    each = _hits(rows.withColumn("groups", F.element_at(of, F.col("term"))), "field", "groups").select("key", "field", "tf", "len", F.explode("groups").alias("term"))
    norm = F.lit(0.0)
    for f in boosts:
        norm = F.when(F.col("field") == f, _part(index, F.col("tf"), F.col("len"), known.mean[f])).otherwise(norm)
    by_field = each.repartition("key").groupBy("key", "term", "field").agg(F.sum("tf").alias("tf"), F.first("len").alias("len"))
    scored = by_field.withColumn("s", _by(boosts, F.col("field")) * F.get(F.array(*map(F.lit, weight)), F.col("term")) * norm)
    best = scored.groupBy("key", "term").agg(F.max("s").alias("s")).groupBy("key").agg(F.sum("s").alias("score"), F.count("*").alias("matched"))
    need = max(1, int(len(terms) * share))
    found = best.where(F.col("matched") >= need).select("key", "score")
    if len(words) < 2:
        return found
    said = phrase_counts(index, list(boosts), words).withColumnRenamed("freq", "tf")
    sums = {f: b * phrase_boost * sum(known.idf(known.held.get((f, w), 0)) for w in words) for f, b in boosts.items()}
    phrases = said.groupBy("key").agg(F.max(_by(sums, F.col("field")) * norm).alias("phrase"))
    return found.join(phrases, "key", "left").select("key", (F.col("score") + F.coalesce("phrase", F.lit(0.0))).alias("score"))
