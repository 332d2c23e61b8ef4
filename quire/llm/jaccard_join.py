"""Exact n-gram Jaccard self-join by adaptive multi-match prefixes.

Sets: distinct hashes (64 bits) of the runs of `size` words.  Documents of equal sets are one class and are joined once.

Filter of all data.  Order all shingles by hash.  If two sets reach the threshold t, the first n - ceil(t n) + m
shingles of both share at least m of them, for any m.  Each class takes m in proportion to its size, and its prefix is
counted over the whole corpus: a class with fewer than m shingles in its prefix that any other class's prefix has links
with nothing.  On a corpus of mostly distinct texts this leaves the copies, near copies and texts made of common
passages.

Join of the rest.  Their shingles' document frequencies are counted exactly; a class with fewer than ceil(t n) shared
shingles links with nothing.  Shingles are then ordered from rare to common, and each class chooses its own m by
estimated cost: the postings that a prefix meets, and the candidates that are left when m of them must agree.  Two
classes are candidates if their prefixes share at least the smaller m of the two.  Candidates are verified on their
whole sets.

Large groups.  Posting lists of more than `long_list` members are not spelt out as pairs.  All long lists with the same
smallest member form one group, so every pair of a long list is in some group.  Members are verified against the
smallest one, which is linear and merges most of a group of near copies; then the members outside the group's largest
component are the queries of a block join with the whole group: blocks of sets are compared in one task through an
inverted index, and only one link for each query and component comes out.  The pairs of short lists are spelt out last,
and only between different components.  Every pair that may link is either verified or already connected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import blobs
from quire.llm.common import drop, free_shuffles, materialise, mix, partitions, pieces_of, shingle_hashes, spread, without_ids, word_hashes
from quire.llm.components import connected_components

U, I = np.uint64, np.int64


@dataclass(frozen=True)
class JoinParams:
    size: int = 5
    threshold: Fraction = Fraction(3, 4)
    matches_percent: int = 15  # m of the first filter, in percent of the set
    most_matches: int = 8  # largest m that a class may choose in the join
    long_list: int = 16  # members up to which a posting list is spelt out as pairs
    queries_per_block: int = 128
    members_per_block: int = 512
    broadcast_rows: int = 100_000  # ids up to which the survivors' ids are broadcast; beyond that, a shuffle join


def needed(n: np.ndarray, t: Fraction) -> np.ndarray:
    """ceil(t n): shingles that any set linked with one of n shingles shares with it."""
    return -(-n * t.numerator // t.denominator)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text with A-Z lower-cased."""
    if not text:
        return np.zeros(0, U)
    return np.unique(shingle_hashes(word_hashes(text.encode("utf-8", "surrogatepass").lower().split()), size))


def set_key(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes())


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(I)


def _sets(texts: list[str | None], size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    sets = [shingle_set(t, size) for t in texts]
    return sets, np.array([len(s) for s in sets], I), np.array([set_key(s) for s in sets], U)


def _groups(sorted_values: np.ndarray) -> np.ndarray:
    """Group numbers of equal neighbours."""
    return np.cumsum(np.append(False, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.zeros(0, I)


def _filter_all(docs: DataFrame, p: JoinParams, parts: int) -> DataFrame:
    """kind 0: a = doc_id, b = n, c = class key.  kind 1: a = class key, b = prefix shingles that other classes' prefixes have."""

    def emit(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        ids = b.column(0).to_numpy(zero_copy_only=False).astype(I)
        for s in range(0, b.num_rows, 2048):
            sets, n, keys = _sets(b.column(1).slice(s, 2048).to_pylist(), p.size)
            own = ids[s : s + 2048]
            # the class of each document, as a posting of kind 0 (column 3); dealt by document, so that no class's copies meet
            yield (mix(own.view(U)) % U(parts)).astype(I), [own.view(U), n.view(U), keys, np.zeros(len(keys), np.uint8)]
            _, first = np.unique(keys, return_index=True)
            m = -(-n * p.matches_percent // 100)
            length = np.minimum(n, n - needed(n, p.threshold) + m)
            first = first[n[first] > 0]
            tokens = np.concatenate([sets[i][: length[i]] for i in first]) if len(first) else np.zeros(0, U)
            owner = np.repeat(keys[first], length[first])
            yield (tokens % U(parts)).astype(I), [tokens, np.zeros(len(tokens), U), owner, np.ones(len(tokens), np.uint8)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, n, key, kind = blobs.unpack(batches, [U, U, U, np.uint8])
        doc = kind == 0
        names = ["kind", "a", "b", "c"]
        if doc.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(doc.sum(), np.int32)), *(pa.array(_signed(x[doc])) for x in (a, n, key))], names)
        a, key = a[~doc], key[~doc]
        order = np.lexsort((key, a))
        a, key = a[order], key[order]
        fresh = np.append(True, (a[1:] != a[:-1]) | (key[1:] != key[:-1]))[: len(a)]
        a, key = a[fresh], key[fresh]
        if len(a):
            group = _groups(a)
            shared = np.bincount(group)[group] > 1
            owners, times = np.unique(key[shared], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(owners), np.int32)), pa.array(_signed(owners)), pa.array(times.astype(I)), pa.array(np.zeros(len(owners), I))], names)

    types = [U, U, U, np.uint8]
    return blobs.deal(docs, parts, types, emit).mapInArrow(count, "kind int, a long, b long, c long")


def _survivors(table: DataFrame, p: JoinParams) -> tuple[DataFrame, DataFrame]:
    """classes(key, n, rep) of all non-empty sets, and those that the filter leaves."""
    classes = table.where("kind = 0 and b > 0").groupBy(F.col("c").alias("key")).agg(F.max("b").alias("n"), F.min("a").alias("rep"))
    shared = table.where("kind = 1").groupBy(F.col("a").alias("key")).agg(F.sum("b").alias("shared"))
    left = classes.join(shared, "key").where(F.col("shared") >= F.ceil(F.col("n") * p.matches_percent / F.lit(100)))
    return classes, left.select("key", "n", "rep")


def _tokens_of(docs: DataFrame, left: DataFrame, p: JoinParams, parts: int) -> DataFrame:
    """node, n, chunk, tokens of the classes that are left, read anew from the text of one document each."""
    reps = left.select(F.col("rep").alias("doc_id")).distinct()
    small = reps.limit(p.broadcast_rows + 1).count() <= p.broadcast_rows
    chosen = docs.join(F.broadcast(reps) if small else reps, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches):
            sets, n, _ = _sets(b.column(1).to_pylist(), p.size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), blobs.lists(np.concatenate(sets), n)], ["node", "n", "tokens"])

    return materialise(chosen.mapInArrow(run, "node long, n long, tokens binary").where("n > 0"), "tokens")


def _chunk(nodes: np.ndarray, parts: int) -> np.ndarray:
    x = nodes.view(U) * U(0x9E3779B97F4A7C15)
    return ((x ^ (x >> U(29))) % U(parts)).astype(I)


def _explode(b: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of a binary column of uint64."""
    values = [np.frombuffer(x, U) for x in b.column(column).to_pylist()]
    counts = np.array([len(v) for v in values], I)
    return np.repeat(np.arange(len(values)), counts), np.concatenate(values) if values else np.zeros(0, U)


def _prefixes(tokens: DataFrame, p: JoinParams, parts: int) -> DataFrame:
    """node, n, m, prefix, tokens of the classes with enough shared shingles; prefixes hold shared shingles only, from rare to common."""
    types = [U, I, np.int32]

    def postings(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        rows, values = _explode(b, 2)
        nodes = b.column(0).to_numpy().astype(I)[rows]
        yield (values % U(parts)).astype(I), [values, nodes]

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, node = blobs.unpack(batches, [U, I])
        order = np.lexsort((node, token))
        token, node = token[order], node[order]
        if not len(token):
            return
        fresh = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))
        token, node = token[fresh], node[fresh]
        group = _groups(token)
        df = np.bincount(group)[group]
        keep = df > 1
        out = blobs.packed(parts, _chunk(node[keep], parts), [token[keep], node[keep], df[keep].astype(np.int32)])
        if out is not None:
            yield out

    def whole(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        rows, values = _explode(b, 2)
        nodes = b.column(0).to_numpy().astype(I)[rows]
        yield _chunk(nodes, parts), [values, nodes, np.zeros(len(values), np.int32)]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, node, df = blobs.unpack(batches, types)
        # a shingle of a set comes once with frequency 0, and once more with its frequency if others have it
        order = np.lexsort((-df, token, node))
        token, node, df = token[order], node[order], df[order]
        fresh = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))[: len(token)]
        token, node, df = token[fresh], node[fresh], df[fresh]
        edges = np.append(np.flatnonzero(np.append(True, node[1:] != node[:-1])), len(node)) if len(node) else np.zeros(1, I)
        rows = []
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            n, shared = e - s, df[s:e] > 0
            alpha = int(needed(np.int64(n), p.threshold))
            if shared.sum() < alpha:
                continue
            own = np.flatnonzero(shared) + s
            own = own[np.lexsort((token[own], df[own]))]
            m, length = _matches(df[own].astype(np.float64), n, alpha, p.most_matches)
            rows.append((int(node[s]), n, m, token[own[:length]].tobytes(), token[s:e].tobytes()))
            if len(rows) == 1000:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)

    counted = blobs.deal(tokens, parts, types[:2], postings).mapInArrow(frequencies, blobs.schema_of(3))
    own = tokens.mapInArrow(lambda bs: (x for b in bs for part, cols in whole(b) if (x := blobs.packed(parts, part, cols)) is not None), blobs.schema_of(3))
    return materialise(own.unionAll(counted).repartition(parts, F.col("key")).mapInArrow(choose, "node long, n long, m int, prefix binary, tokens binary"), "prefixes")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())], ["node", "n", "m", "prefix", "tokens"])


def _matches(df: np.ndarray, n: int, alpha: int, most: int) -> tuple[int, int]:
    """The m with the least estimated cost, and the length of its prefix in shared shingles (rare to common).

    The n - len(df) shingles that nobody else has come first in the order and are left out of the prefix."""
    unique = n - len(df)
    best = None
    for m in range(1, min(most, alpha) + 1):
        length = n - alpha + m - unique
        met = df[:length].sum() - length
        cost = met + 10 * met / m  # a posting costs about a tenth of a verification
        if best is None or cost < best[0]:
            best = cost, m, length
    return best[1], best[2]


def _postings(prefixes: DataFrame, labels: DataFrame | None, parts: int) -> DataFrame:
    """Packed (shingle, node, n, m, component), dealt by shingle."""
    rows = prefixes.select("node", "n", "m", "prefix")
    if labels is None:
        rows = rows.withColumn("component", F.col("node"))
    else:
        rows = rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def emit(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        at, values = _explode(b, 4)
        yield (values % U(parts)).astype(I), [values, *(b.column(i).to_numpy()[at] for i in range(4))]

    return blobs.deal(rows.select("node", "n", "m", "component", "prefix"), parts, _POSTING, emit)


_POSTING = [U, I, I, np.int32, I]


def _posting_lists(batches: Iterator[pa.RecordBatch]) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of a partition's postings in order of (shingle, node), and the edges of the lists."""
    columns = blobs.unpack(batches, _POSTING)
    order = np.lexsort((columns[1], columns[0]))
    columns = [x[order] for x in columns]
    token = columns[0]
    edges = np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token)) if len(token) else np.zeros(1, I)
    return columns, edges


def _long_groups(prefixes: DataFrame, p: JoinParams, parts: int) -> DataFrame:
    """group, node: the members of all long lists with the same smallest member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, node, *_), edges = _posting_lists(batches)
        sizes = np.diff(edges)
        big = np.repeat(sizes > p.long_list, sizes)
        leader = node[np.repeat(edges[:-1], sizes)][big]
        if len(leader):
            pair = np.unique(np.stack([leader, node[big]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["group", "node"])

    return materialise(_postings(prefixes, None, parts).mapInArrow(run, "group long, node long").distinct(), "groups")


def _short_pairs(prefixes: DataFrame, labels: DataFrame, p: JoinParams, parts: int) -> DataFrame:
    """Pairs a < b of short lists, of different components, that share as many prefix shingles as the smaller m of the two.

    A pair that also shares a long list was compared there; any other pair shares short lists only, so its count is whole."""
    t = p.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, node, n, m, component), edges = _posting_lists(batches)
        sizes = np.diff(edges)
        for step in range(1, p.long_list):  # each member with the one `step` places further in its list
            place = np.arange(len(node)) - np.repeat(edges[:-1], sizes)
            i = np.flatnonzero(np.repeat((sizes <= p.long_list) & (sizes > step), sizes) & (place + step < np.repeat(sizes, sizes)))
            j = i + step
            ok = (component[i] != component[j]) & (node[i] != node[j]) & _fits(n[i], n[j], t)
            i, j = i[ok], j[ok]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j]), pa.array(np.minimum(m[i], m[j]))], ["a", "b", "m"])

    met = _postings(prefixes, labels, parts).mapInArrow(run, "a long, b long, m int")
    return met.groupBy("a", "b").agg(F.min("m").alias("m"), F.count("*").alias("n")).where("n >= m").select("a", "b")


def _block_links(groups: DataFrame, labels: DataFrame, prefixes: DataFrame, p: JoinParams) -> DataFrame:
    """a, b: for each member outside its group's largest component, a link to each other component that it has one to.

    Members are cut into bands of size, each 4 / 3 (one over the threshold) of the one before; as linked sets are at most
    that far apart, a query meets its own band and the two beside it only."""
    members = groups.join(labels, "node", "left").select("group", "node", F.coalesce("component", "node").alias("component"))
    each = members.groupBy("group", "component").count()
    whole = each.groupBy("group").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.sum("count").alias("members"), F.max("count").alias("most")).where("members > most")
    band = F.floor(F.ln("n") / math.log(p.threshold.denominator / p.threshold.numerator)).cast("int")
    rows = members.join(whole.select("group", "main"), "group").join(prefixes.select("node", band.alias("own"), "tokens"), "node")
    rows = rows.withColumn("query", F.col("component") != F.col("main"))
    near = F.explode(F.array(*[F.col("own") + d for d in (-1, 0, 1)])).alias("band")
    told_in = rows.groupBy("group", F.col("own").alias("band")).agg(F.count("*").alias("told"))
    asked_in = rows.where("query").select("group", near).groupBy("group", "band").agg(F.count("*").alias("asked"))
    blocks = told_in.join(asked_in, ["group", "band"]).select("group", "band", F.ceil(F.col("told") / p.members_per_block).cast("int").alias("mb"), F.ceil(F.col("asked") / p.queries_per_block).cast("int").alias("qb"))
    blocks = materialise(blocks, "blocks")
    draw = F.xxhash64("node", F.lit(3))
    asked = rows.where("query").select("*", near).join(blocks, ["group", "band"])
    asked = asked.select("group", "band", F.pmod(draw, F.col("qb")).cast("int").alias("i"), F.explode(F.expr("sequence(0, mb - 1)")).alias("j"), F.lit(True).alias("query"), "node", "component", "tokens")
    told = rows.withColumn("band", F.col("own")).join(blocks, ["group", "band"])
    told = told.select("group", "band", F.explode(F.expr("sequence(0, qb - 1)")).alias("i"), F.pmod(draw, F.col("mb")).cast("int").alias("j"), F.lit(False).alias("query"), "node", "component", "tokens")
    num, den = p.threshold.numerator, p.threshold.denominator

    def compare(table: pa.Table) -> pa.Table:
        query = table.column("query").to_numpy()
        node, component = table.column("node").to_numpy(), table.column("component").to_numpy()
        sets = [np.frombuffer(x, U) for x in table.column("tokens").to_pylist()]
        sizes = np.array([len(x) for x in sets], I)
        told = np.flatnonzero(~query)
        token = np.concatenate([sets[i] for i in told]) if len(told) else np.zeros(0, U)
        owner = np.repeat(np.arange(len(told)), sizes[told])
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        found: list[np.ndarray] = []
        for q in np.flatnonzero(query):
            low, high = np.searchsorted(token, sets[q], "left"), np.searchsorted(token, sets[q], "right")
            length = high - low
            at = np.repeat(low - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())
            common = np.bincount(owner[at], minlength=len(told))
            hit = told[den * common >= num * (sizes[q] + sizes[told] - common)]
            hit = hit[component[hit] != component[q]]
            if len(hit):
                _, one = np.unique(component[hit], return_index=True)
                found.append(np.stack([np.full(len(one), node[q]), node[hit[one]]]))
        pair = np.concatenate(found, axis=1) if found else np.zeros((2, 0), I)
        return pa.table({"a": pa.array(pair[0]), "b": pa.array(pair[1])})

    return asked.unionAll(told).groupBy("group", "band", "i", "j").applyInArrow(compare, "a long, b long")


def _fits(n: np.ndarray, other: np.ndarray, t: Fraction) -> np.ndarray:
    """Whether two set sizes allow the threshold."""
    low, high = np.minimum(n, other), np.maximum(n, other)
    return low * t.denominator >= high * t.numerator


def _verify(pairs: DataFrame, prefixes: DataFrame, p: JoinParams) -> DataFrame:
    """The pairs whose sets reach the threshold."""
    sets = prefixes.select("node", "tokens")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    num, den = p.threshold.numerator, p.threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                u, v = np.frombuffer(x, U), np.frombuffer(y, U)
                common = len(u) + len(v) - len(np.unique(np.concatenate([u, v])))
                keep.append(den * common >= num * (len(u) + len(v) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, params: JoinParams = JoinParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row with an id: the smallest id reachable over links of the threshold or more.

    Null texts and texts without a word have empty sets and link with nothing; texts of fewer than `size` words are one
    shingle; repeated rows are in one component; very long texts are compared whole; rows without an id are left out, as
    nothing can refer to them; an empty table gives an empty result; other columns don't matter.  Ids must be integers."""
    spark, p = docs.sparkSession, params
    parts = partitions(docs)
    rows = spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null"))
    table = materialise(_filter_all(rows, p, parts), "classes")
    classes, left = _survivors(table, p)
    free_shuffles(spark)
    tokens = _tokens_of(rows, left, p, parts)
    prefixes = _prefixes(tokens, p, parts)
    drop(tokens)
    free_shuffles(spark)
    groups = _long_groups(prefixes, p, parts)
    stars = groups.where("group <> node").select(F.col("group").alias("a"), F.col("node").alias("b"))
    links = materialise(_verify(stars, prefixes, p), "links")
    labels = connected_components(links)
    if not groups.isEmpty():  # else there is no long list, and nothing more to link here
        links = links.unionAll(materialise(_block_links(groups, labels, prefixes, p), "links"))
        drop(labels)
        labels = connected_components(links)
    free_shuffles(spark)
    more = materialise(_verify(_short_pairs(prefixes, labels, p, parts), prefixes, p), "links")
    drop(labels, groups, prefixes)
    labels = connected_components(links.unionAll(more))
    found = classes.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    found = materialise(found, "components")  # so that the join below has plain exchanges, which AQE splits where one class has very many copies
    docs_of = table.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("key"))
    some, none = docs_of.where("n_shingles > 0"), docs_of.where("n_shingles = 0")
    out = some.join(found, "key").select("doc_id", "n_shingles", "component_id")
    return out.unionAll(none.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))).withColumnRenamed("doc_id", doc_id)


def near_duplicates_removed(docs: DataFrame, params: JoinParams = JoinParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with all their columns.

    Rows without an id and with null or empty text stay; repeated rows of an id stay or go together; very long texts are
    compared whole; an empty table gives an empty result; columns of any name stay as they are."""
    found = jaccard_components(docs, params, doc_id, text)
    return without_ids(docs, found.where(F.col("component_id") != F.col(doc_id)).select(doc_id), doc_id)


def op8_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Components of all documents under five-word shingles and a similarity of 0.75."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
