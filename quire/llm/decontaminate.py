"""Benchmark decontamination by SimHash of item-sized windows and multi-index Hamming search.

Method.  Words are runs of letters and digits, lower-cased.  A window has as many words as an item; it and the item are
bags of shingles of five words.  The SimHash of a bag sets bit i if more than half of its shingle hashes do.  A
fingerprint has `blocks` blocks; two fingerprints within `radius` bits agree in some block up to radius // blocks bits,
so an equi-join of the windows' blocks with all such variants of the items' blocks finds every pair within the radius.
Only fingerprints and ids go through the index; words are joined to the pairs that it leaves.  These are verified on the
shingles themselves: sum of smaller over sum of larger counts, at least `similarity`.  At 0.75 a bit differs with
probability about 0.17 (11 of 64, deviation 3), so a radius of 17 keeps 98 % of the windows that just reach it, and more of
all others; a block of 11 bits with up to 2 flipped meets 3.3 % of all values, so the index joins a quarter of the
pairs of windows and items of equal length and the radius leaves about one in ten thousand of unlike pairs.

Which windows.  A window that reaches the similarity holds shingles of the item; moved right until its first shingle is
one of the item's, it loses none of them and stays as similar.  So windows are taken where a shingle of an item stands,
of that item's size (shorter at the end of the text).  This loses no item.  Without it, an index at this similarity can't
be selective: every word of the corpus would begin a window for each length of an item, to be joined with a quarter of
its items.

Everything is DataFrame functions; no text is cut, and no two documents are compared."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialise, without_ids


@dataclass(frozen=True)
class DecontaminationParams:
    size: int = 5
    similarity: float = 0.75
    radius: int = 17
    blocks: int = 6  # of 64 // blocks bits or one more
    broadcast_rows: int = 500_000  # rows of items up to which they are broadcast; beyond that, a shuffle join


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def shingle_hashes(w: Column, size: int) -> Column:
    """64-bit hashes of the runs of `size` words; none if there are fewer."""
    n = F.size(w)
    at = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)]))
    return F.when(n >= size, at).otherwise(F.array().cast("array<bigint>"))


def shingles(w: Column, size: Column) -> Column:
    """The shingles as strings, numbered by occurrence, so that a bag becomes a set."""
    texts = F.array_sort(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, size), " ")))
    return let(texts, lambda t: F.transform(t, lambda s, i: F.concat_ws("\n", s, (i - F.array_position(t, s)).cast("string"))))


def overlap(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays of distinct elements."""
    return let(F.struct(F.size(F.array_intersect(a, b)).alias("c"), (F.size(a) + F.size(b)).alias("n")), lambda x: x["c"] / (x["n"] - x["c"]))


def simhash(hashes: Column, lane: int) -> Column:
    """Bit i: whether more than half of the hashes have it. Counts are kept in lanes of a long, 64 / lane at a time."""
    ones = sum(1 << lane * f for f in range(64 // lane))
    top = lane - 2
    more = (F.lit((1 << top) - 1) - F.floor(F.size(hashes) / 2)) * F.lit(ones)
    out = F.lit(0).cast("long")
    for j in range(lane):
        def add(acc: Column, h: Column, j: int = j) -> Column:
            return acc + F.shiftright(h, j).bitwiseAND(F.lit(ones))

        count = F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: add(acc, h))  # noqa: B023
        over = F.shiftright((count + more).bitwiseAND(F.lit(ones << top)), top)
        out = out.bitwiseOR(F.shiftleft(over, j))
    return out


def widths(blocks: int) -> list[int]:
    """Bits of each block: 64 in all."""
    return [64 // blocks + (b < 64 % blocks) for b in range(blocks)]


def block_values(fingerprint: Column, blocks: int, flips: int = 0) -> Column:
    """(block number, value) of each block, with up to `flips` bits flipped."""
    out, at = [], 0
    for b, width in enumerate(widths(blocks)):
        value = F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1))
        masks = F.array(*[F.lit(m).cast("long") for m in variants(width, flips)])
        out.append(F.transform(masks, _flipped(b, value)))
        at += width
    return F.concat(*out)


def _flipped(block: int, value: Column) -> Callable[[Column], Column]:
    return lambda mask: F.struct(F.lit(block).alias("block"), value.bitwiseXOR(mask).alias("value"))


def variants(width: int, most: int) -> list[int]:
    """All masks of `width` bits with at most `most` bits set."""
    return [m for m in range(1 << width) if m.bit_count() <= most]


def candidates(ours: DataFrame, theirs: DataFrame, params: DecontaminationParams, *keep: str) -> DataFrame:
    """`keep` columns of ours and item: the pairs of ours(keep, length, print) and theirs(item, length, print) of equal length
    within the radius, each once."""
    p = params
    index = theirs.select("item", "length", F.col("print").alias("item_print"), F.explode(block_values(F.col("print"), p.blocks, p.radius // p.blocks)).alias("b")).select("item", "length", "item_print", "b.*")
    index = materialise(index, "index")
    small = index.limit(p.broadcast_rows + 1).count() <= p.broadcast_rows
    asked = ours.select(*keep, "length", "print", F.explode(block_values(F.col("print"), p.blocks)).alias("b")).select(*keep, "length", "print", "b.*")
    met = asked.join(F.broadcast(index) if small else index, ["length", "block", "value"])
    return met.where(F.bit_count(F.expr("print ^ item_print")) <= p.radius).select(*keep, "item").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, start, length: the most similar window (first of equals) of each document for each
    item that it leaks, start and length in words.

    Null and empty texts and items leak nothing; items of fewer words than a shingle are one shingle, found whole; rows of
    one id are one document, which leaks what any of its texts does; equal items and different items of one id are
    reported by id; very long texts are searched whole; of equally similar windows the first counts, then the shorter; empty
    tables give an empty result; other columns don't matter."""
    p = params
    own = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    items = own.select("item_id", "w", F.size("w").alias("length"), F.least(F.size("w"), F.lit(p.size)).alias("size"), F.xxhash64("item_id", "w").alias("item")).distinct()
    items = materialise(items, "items")
    facts = items.agg(F.max("length"), F.sort_array(F.collect_set("size"))).first()
    longest, sizes = facts[0] or 1, facts[1] or [p.size]  # at most p.size values
    lane = 16 if longest < 16_000 else 32
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("t")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())

    def hashed(rows: DataFrame, size: int, *keep: str) -> DataFrame:
        return rows.select(*keep, F.posexplode(shingle_hashes(F.col("w"), size)).alias("start", "h"))

    anchors = None
    for size in sizes:
        theirs = hashed(items.where(F.col("size") == size), size, "length").select("length", "h").distinct()
        small = theirs.limit(p.broadcast_rows + 1).count() <= p.broadcast_rows
        split = texts.select("doc_id", "t", words(F.col("text")).alias("w"))
        met = hashed(split, size, "doc_id", "t").join(F.broadcast(theirs) if small else theirs, "h").select("doc_id", "t", "start", "length", F.lit(size).alias("size"))
        anchors = met if anchors is None else anchors.unionAll(met)
    anchors = materialise(anchors.groupBy("doc_id", "t").agg(F.collect_set(F.struct("start", "length", "size")).alias("at")), "anchors")
    chosen = F.broadcast(anchors) if anchors.agg(F.sum(F.size("at"))).first()[0] in range(p.broadcast_rows) else anchors
    # let() keeps Spark from computing an expression anew for each window and each use
    cut = let(words(F.col("text")), lambda w: F.transform("at", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"), x["size"].alias("size"), F.slice(w, x["start"] + 1, x["length"]).alias("w"))))
    windows = texts.join(chosen, ["doc_id", "t"]).select("doc_id", "t", F.explode(cut).alias("x")).select("doc_id", "t", "x.*").distinct()

    def print_of(w: Column, size: Column) -> Column:
        hashes = F.lit(None).cast("array<bigint>")
        for k in sizes:
            hashes = F.when(size == k, shingle_hashes(w, k)).otherwise(hashes)
        return let(hashes, lambda h: simhash(h, lane))

    windows = materialise(windows.withColumn("print", print_of(F.col("w"), F.col("size"))), "windows")
    theirs = items.select("item", "length", print_of(F.col("w"), F.col("size")).alias("print"))
    place = ("doc_id", "t", "start", "length")
    pairs = candidates(windows, theirs, p, *place)
    told = items.select("item", "item_id", F.col("w").alias("item_w"), F.col("size").alias("item_size"))
    few = items.limit(p.broadcast_rows // 10 + 1).count() <= p.broadcast_rows // 10
    both = pairs.join(F.broadcast(told) if few else told, "item").join(windows.select(*place, "w"), list(place))
    bags = F.struct(shingles(F.col("w"), F.col("item_size")).alias("a"), shingles(F.col("item_w"), F.col("item_size")).alias("b"))
    similarity = let(bags, lambda x: overlap(x["a"], x["b"]))
    verified = both.select("doc_id", "item_id", "start", F.size("w").alias("length"), similarity.alias("similarity")).where(F.col("similarity") >= p.similarity)
    best = verified.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("similarity", "start", "length"), F.struct("similarity", (-F.col("start")).alias("s"), (-F.col("length")).alias("n"))).alias("best"))
    return best.select(F.col("doc_id").alias(doc_id), "item_id", "best.similarity", F.col("best.start").cast("long").alias("start"), F.col("best.length").cast("long").alias("length"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that leak no item, with all their columns.

    Rows with null or empty text or without an id stay; rows of one id go together; repeated rows stay each; very long texts
    are searched whole; an empty benchmark leaves docs as they are; columns of any name stay as they are."""
    return without_ids(docs, leaks(docs, benchmark, params, doc_id, text).select(doc_id), doc_id)


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """The benchmark items that each document leaks."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
