"""Language identification by prediction by partial matching.

Method.  For each language a byte context tree of orders 0 to `max_order` is counted on a bounded training sample and
then frozen.  In a context with N observations of T different bytes, a byte seen c times costs -log2(c / (N + T)) bits
and the escape to the next shorter context costs -log2(T / (N + T)); below order 0 a byte costs 8 bits (method C,
without exclusion).  As the statistics are frozen, the cost of a byte depends on its context alone, so the trees of all
languages are compiled into one hash table from (context, byte) to a row of costs, and a text's exact code lengths are
sums of table rows.  The language of the shortest code wins; ties go to the smallest name.

Training.  The sample is bounded in rows and bytes: per language about `docs_per_lang` documents of at most `doc_bytes`,
chosen by a hash of id and text, of which whole texts are read until `bytes_per_lang` bytes are reached.  The table has a
row for each context and byte of the sample and four bytes a language in it, so its size is bounded by the sample's
parameters and the number of languages, not by the input.  Prediction reads all bytes of all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import pieces_of, spread

UND = "und"
_LETTER = regex.compile(r"\p{L}")
_MUL = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 18  # bytes scored at once


@dataclass(frozen=True)
class LangParams:
    max_order: int = 4
    docs_per_lang: int = 500
    doc_bytes: int = 65_536  # longer texts teach nothing; they are predicted like all others
    bytes_per_lang: int = 1_500_000


class Table:
    """Open addressing from uint64 keys (not 0) to row numbers, probed for arrays of keys at once."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.bits = max(4, int(np.ceil(np.log2(max(n, 1) * 3))))
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.rows = np.zeros(1 << self.bits, np.int32)
        self.probes = 0
        left = np.arange(n)
        while len(left):
            at = self._slot(keys[left], self.probes)
            free = np.flatnonzero(self.keys[at] == 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.rows[at[put]] = keys[left[put]], left[put]
            left = np.delete(left, put)
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        at = (keys * _MUL) >> np.uint64(64 - self.bits)
        return ((at + np.uint64(probe)) & np.uint64((1 << self.bits) - 1)).astype(np.int64) if probe else at.astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where a key is absent."""
        at = self._slot(keys, 0)
        found = self.keys[at]
        out = np.where(found == keys, self.rows[at], -1)
        left = np.flatnonzero((found != keys) & (found != 0))
        for probe in range(1, self.probes):
            if not len(left):
                break
            at = self._slot(keys[left], probe)
            found = self.keys[at]
            hit = found == keys[left]
            out[left[hit]] = self.rows[at[hit]]
            left = left[~hit & (found != 0)]
        return out


def _codes(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte from position max_order on: the byte and the `order` bytes before it, as one number."""
    n = len(data)
    out = data[order:].astype(np.uint64)
    for i in range(1, order + 1):
        out |= data[order - i : n - i].astype(np.uint64) << np.uint64(8 * i)
    return out


def _tag(codes: np.ndarray, order: int) -> np.ndarray:
    return codes | np.uint64((order + 1) << 48)


class Model:
    """The compiled context trees of some languages."""

    def __init__(self, texts: dict[str, list[bytes]], max_order: int):
        if not 0 <= max_order <= 4:
            raise ValueError("max_order must lie between 0 and 4")
        self.langs, self.max_order = sorted(texts), max_order
        if not texts:  # nothing learnt: predict() answers und
            return
        pad = b"\0" * max_order
        data = {x: np.frombuffer(b"".join(pad + t for t in texts[x]), np.uint8) for x in self.langs}
        body = {x: np.concatenate([np.r_[np.zeros(max_order, bool), np.ones(len(t), bool)] for t in texts[x]]) for x in self.langs}
        n_lang = len(self.langs)
        lower_keys, lower_cost = np.zeros(1, np.uint64), np.full((1, n_lang), 8.0)
        grams, costs, contexts, escapes = [], [], [], []
        for order in range(max_order + 1):
            seen = [np.unique(_codes(data[x], order)[body[x][order:]], return_counts=True) for x in self.langs]
            keys = np.unique(np.concatenate([s[0] for s in seen]))
            shorter = keys & np.uint64((1 << 8 * order) - 1) if order else np.zeros(len(keys), np.uint64)
            cost = lower_cost[np.searchsorted(lower_keys, shorter)].copy()
            ctx = np.unique(keys >> np.uint64(8))
            esc = np.zeros((len(ctx), n_lang))
            for i, (k, c) in enumerate(seen):
                own, start = np.unique(k >> np.uint64(8), return_index=True)
                if not len(own):
                    continue
                total, kinds = np.add.reduceat(c, start), np.diff(np.append(start, len(k)))
                esc[np.searchsorted(ctx, own), i] = -np.log2(kinds / (total + kinds))
                cost[:, i] += esc[np.searchsorted(ctx, keys >> np.uint64(8)), i]
                cost[np.searchsorted(keys, k), i] = -np.log2(c / np.repeat(total + kinds, kinds))
            grams.append(_tag(keys, order))
            costs.append(cost)
            contexts.append(_tag(ctx, order))
            escapes.append(esc)
            lower_keys, lower_cost = keys, cost
        self.grams, self.costs = Table(np.concatenate(grams)), np.concatenate(costs).astype(np.float32)
        self.contexts, self.escapes = Table(np.concatenate(contexts)), np.concatenate(escapes).astype(np.float32)

    def bits(self, data: bytes, before: bytes = b"") -> np.ndarray:
        """Cost of each byte in each language; `before`: the bytes that come before data."""
        k = self.max_order
        whole = np.frombuffer((b"\0" * k + before)[-k:] + data if k else data, np.uint8)
        out = np.zeros((len(data), len(self.langs)), np.float32)
        left = np.arange(len(data))
        codes = _codes(whole, k)
        for order in range(k, -1, -1):
            own = codes[left] & np.uint64((1 << 8 * (order + 1)) - 1)
            row = self.grams.find(_tag(own, order))
            hit = row >= 0
            if order == k and hit.all():
                return self.costs[row]
            out[left[hit]] += self.costs[row[hit]]
            left = left[~hit]
            if not len(left):
                return out
            ctx = self.contexts.find(_tag(own[~hit] >> np.uint64(8), order))
            known = ctx >= 0
            out[left[known]] += self.escapes[ctx[known]]
        out[left] += 8
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text (row) in each language; texts are joined to be scored in large pieces."""
        out = np.zeros((len(texts), len(self.langs)))
        k = self.max_order
        pad = b"\0" * k
        group: list[int] = []
        size = 0
        for i, t in enumerate([*texts, None]):
            if group and (t is None or size + len(t) > _CHUNK):
                joined = pad.join(texts[g] for g in group)
                cost = self.bits(joined)
                at = 0
                for g in group:
                    out[g] = cost[at : at + len(texts[g])].sum(axis=0, dtype=np.float64)
                    at += len(texts[g]) + k
                group, size = [], 0
            if t is None:
                break
            if len(t) > _CHUNK:
                for s in range(0, len(t), _CHUNK):
                    out[i] += self.bits(t[s : s + _CHUNK], t[max(0, s - k) : s]).sum(axis=0, dtype=np.float64)
            elif t:
                group.append(i)
                size += len(t) + k
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the winner's share among codes weighed as 2 ** -(bits a byte), so that it tells how
        much shorter the winner's code is, and not how long the text."""
        letters = np.array([bool(t and _LETTER.search(t)) for t in texts], bool)
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts))
        data = [t.encode("utf-8", "surrogatepass") if ok else b"" for t, ok in zip(texts, letters, strict=True)]
        bits = self.lengths(data)
        best = bits.argmin(axis=1)
        size = np.maximum(1, np.fromiter(map(len, data), np.int64, len(data)))[:, None]
        rest = np.exp2((bits.min(axis=1, keepdims=True) - bits) / size).sum(axis=1)
        return [self.langs[b] if ok else UND for b, ok in zip(best, letters, strict=True)], np.where(letters, 1 / rest, 0.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, params: LangParams = LangParams(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of the languages of docs, learnt on the bounded sample of rows that aren't held out.

    Rows with null lang or text are left out, and texts of more than `doc_bytes`; rows without an id are drawn by their text;
    repeated rows are drawn together; an empty table gives a model that answers `und`.  Two scans: one counts rows per language, one reads the sample."""
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l"))
    rows = rows.where(F.col("l").isNotNull() & (F.octet_length("t") <= params.doc_bytes) & ~held_out(F.col("i")))
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}  # one row for each language
    if not counts:
        return Model({}, params.max_order)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, params.docs_per_lang / n)])
    draw = F.pmod(F.xxhash64(F.col("i"), F.col("t"), F.lit(17)), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.where(draw < F.element_at(share, F.col("l"))).select("l", "t", draw.alias("d"))
    texts: dict[str, list[bytes]] = {k: [] for k in counts}
    size = dict.fromkeys(counts, 0)
    picked = sample.orderBy("d", "t").limit(2 * params.docs_per_lang * len(counts))  # the draw's mean is half of this
    for r in picked.toLocalIterator():
        if size[r["l"]] < params.bytes_per_lang:
            texts[r["l"]].append(r["t"].encode("utf-8", "surrogatepass"))
            size[r["l"]] += len(texts[r["l"]][-1])
    return Model({k: v for k, v in texts.items() if any(v)}, params.max_order)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of each row.  Null texts and texts without a letter get `und` and score 0; ties go to
    the smallest language name; very long texts are scored whole; repeated rows are predicted each; an empty table gives an
    empty result; other columns don't matter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches):
            langs, scores = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores)], [doc_id, "lang_pred", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return spread(docs.select(doc_id, text)).mapInArrow(run, f"{doc_id} {kind}, lang_pred string, score double")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every text of documents, by a model that never saw the held-out quarter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
