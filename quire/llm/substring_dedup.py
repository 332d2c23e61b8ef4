"""Substring dedup by sliding sentence spans.

Method.  A text is cut into sentences, at the end marks of its script and at blank lines.  From each sentence on, the
shortest run of at least `min_sentences` sentences and `min_words` words, or of `enough_words` words, is hashed over its
lower-cased words, and so is the shortest such run back from each sentence's end.  Any longer run of consecutive
sentences is made of these, so they find and cover just what all runs would.  As passages are also set into the middle of a
sentence, a run may begin at a capital letter, too, as the rest of a sentence, and end before one; such a place counts for
no sentence, so names don't make sentences.  What bounds a run depends on its words alone, so a passage gives the same
runs wherever it stands.  Runs are joined over the whole corpus by hash; the first occurrence, by document id and place,
stays, and the words of all sentences that any other occurrence of a repeated run covers are removed.

Words are what white space parts; of scripts without spaces each character is a word, and where they have no end marks
either (Thai, Lao, Khmer, Burmese), a space ends a sentence.

The join deals packed (hash, id, place) values by hash; of a run that very many documents have, only the first occurrence
in each batch goes to the run's partition.  Texts move once, with the spans to remove."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import blobs
from quire.llm.common import materialise, mix, partitions, pieces_of, spread, word_hashes

U, I = np.uint64, np.int64
#: Characters of scripts that put no space between words, those of them without end marks, and end marks.
_SPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
_DENSE = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff" + _SPACED
_ENDS = ".!?\u2026\u3002\uff01\uff1f\uff61\uff0e\u061f\u06d4\u0964\u0965\u1362\u17d4\u104b"
_AFTER = "\"')]}\u00bb\u201d\u2019\u300d\u300f\uff09"  # what may stand behind an end mark
_HAS_DENSE = re.compile(f"[{_DENSE}]")
_IS_SPACED = re.compile(f"[{_SPACED}]")
_WORDS = re.compile(r"\S+")
_DENSE_WORDS = re.compile(rf"[{_DENSE}][{re.escape(_ENDS + _AFTER)}\u3001\uff0c]*|[^\s{_DENSE}]+")
_BLANK = re.compile(r"\n[^\S\n]*\n")
_R = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64


@dataclass(frozen=True)
class SpanParams:
    min_sentences: int = 2
    min_words: int = 20
    enough_words: int = 40


class _Powers:
    """Powers of _R and of its inverse modulo 2 ** 64, as far as they were needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(1024, 1 << n.bit_length())
            with np.errstate(over="ignore"):
                self.up, self.down = (np.multiply.accumulate(np.r_[U(1), np.full(size - 1, U(r), U)]) for r in (_R, pow(_R, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def words_in(text: str) -> re.Pattern:
    return _DENSE_WORDS if _HAS_DENSE.search(text) else _WORDS


def edges_of(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of a text, the word numbers at which a run may begin or end (the last is the number of words), and for each
    how many sentences have begun by then."""
    dense = bool(_HAS_DENSE.search(text))
    words, strong = [], []
    for part in _BLANK.split(text) if "\n" in text else (text,):
        strong.append(len(words))
        if dense:
            spans = list(_DENSE_WORDS.finditer(part))
            for m in spans[:-1]:
                if m.end() < len(part) and part[m.end()].isspace() and _IS_SPACED.match(m[0]):
                    strong.append(len(words) + 1)
                words.append(m[0])
            words += [m[0] for m in spans[-1:]]
        else:
            words += part.split()
    n = len(words)
    begins = np.zeros(n + 1, bool)
    begins[strong] = True
    begins[1:] |= np.fromiter((w[-1] in _ENDS or (w[-1] in _AFTER and w.rstrip(_AFTER)[-1:] in _ENDS and len(w) > 1 and w.rstrip(_AFTER) != "") for w in words), bool, n)
    begins[0] = begins[n] = True
    may = begins.copy()
    may[:n] |= np.fromiter((w[0].isupper() for w in words), bool, n)
    edges = np.flatnonzero(may)
    return words, edges, np.cumsum(begins)[edges]


def runs(text: str | None, p: SpanParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and number of words of each run of a text."""
    none = np.zeros(0, U), np.zeros(0, I), np.zeros(0, I)
    if not text:
        return none
    words, edges, begun = edges_of(text)
    n = len(words)
    if n < p.min_words:
        return none
    # the run between edges i < j spans the sentences begun before j, from the one that i is in or begins
    m = len(edges)
    i = np.arange(m)
    before = np.append(0, begun[1:] - (begun[1:] > begun[:-1]))  # sentences begun before the edge
    short = np.searchsorted(before, begun + p.min_sentences - 1)
    last = np.minimum(np.maximum(short, np.searchsorted(edges, edges + p.min_words)), np.searchsorted(edges, edges + p.enough_words))
    ok = last < m
    s, e = edges[ok], edges[last[ok]]
    at = lambda words: np.searchsorted(edges, edges - words, "right") - 1
    back = np.maximum(np.minimum(np.searchsorted(begun, before - p.min_sentences + 1, "right") - 1, at(p.min_words)), at(p.enough_words))
    new = back >= 0
    new[new] = last[back[new]] != i[new]  # the others are runs from their start on, too
    s, e = np.append(s, edges[back[new]]), np.append(e, edges[i[new]])
    up, down = _powers.get(n + 1)
    h = np.append(U(0), np.cumsum(word_hashes(" ".join(words).lower().encode("utf-8", "surrogatepass").split(b" ")) * up[:n]))
    return mix((h[e] - h[s]) * down[s] + (e - s).astype(U)), s, e - s


def _removals(docs: DataFrame, p: SpanParams, parts: int) -> DataFrame:
    """doc_id and packed (first word, words) of the non-first occurrences of repeated runs."""
    types = [U, I, np.int32, np.int32, np.uint8]

    def emit(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        ids = b.column(0).to_numpy(zero_copy_only=False).astype(I)
        for at in range(0, b.num_rows, 4096):
            found = [runs(t, p) for t in b.column(1).slice(at, 4096).to_pylist()]
            counts = [len(f[0]) for f in found]
            h, s, n = (np.concatenate([f[i] for f in found]) for i in range(3))
            doc = np.repeat(ids[at : at + 4096], counts)
            order = np.lexsort((s, doc, h))
            h, doc, s, n = h[order], doc[order], s[order], n[order]
            # what has an earlier occurrence in the batch is known to go: it is dealt by document, so a run that very many
            # documents have gives its own partition one value a batch
            known = _later(h, doc, s)
            yield np.where(known, mix(doc.view(U)) % U(parts), h % U(parts)).astype(I), [h, doc, s, n, known.astype(np.uint8)]

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, doc, s, n, known = blobs.unpack(batches, types)
        done = known == 1
        gone = [(doc[done], s[done], n[done])]
        h, doc, s, n = (x[~done] for x in (h, doc, s, n))
        order = np.lexsort((s, doc, h))
        h, doc, s, n = h[order], doc[order], s[order], n[order]
        later = _later(h, doc, s)
        gone.append((doc[later], s[later], n[later]))
        doc, s, n = (np.concatenate(x) for x in zip(*gone, strict=True))
        order = np.lexsort((s, doc))
        doc, spans = doc[order], np.stack([s[order], n[order]], axis=1)
        owners, sizes = np.unique(doc, return_counts=True)
        if len(owners):
            yield pa.RecordBatch.from_arrays([pa.array(owners), blobs.lists(spans.astype(np.int32).ravel(), 2 * sizes)], ["doc_id", "spans"])

    return blobs.deal(docs, parts, types, emit).mapInArrow(repeated, "doc_id long, spans binary")


def _later(h: np.ndarray, doc: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Of values in order of (h, doc, s): whether an earlier place has the same hash."""
    same = np.append(False, h[1:] == h[:-1])[: len(h)]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(h)))) if len(h) else np.zeros(0, I)
    return (doc != doc[head]) | (s != s[head])


def cut(text: str, spans: np.ndarray) -> tuple[str, int]:
    """The text without the words of the spans (rows of first word and words), and how many words went."""
    where = [m.span() for m in words_in(text).finditer(text)]
    edge = np.zeros(len(where) + 1, I)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 0] + spans[:, 1], -1)
    gone = np.cumsum(edge[:-1]) > 0
    flips = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    out, at = [], 0
    for s, e in zip(flips[::2].tolist(), flips[1::2].tolist(), strict=True):
        out.append(text[at : where[s][0]])
        at = where[e][0] if e < len(where) else len(text)
    return "".join([*out, text[at:]]), int(gone.sum())


def dedup_spans(docs: DataFrame, params: SpanParams = SpanParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with all their columns and rows, repeated passages removed from text, and the count of removed words (last column,
    `n_removed`).

    Null and empty texts stay as they are, and so do texts shorter than a run; very long texts are searched whole; rows
    without an id keep their text; rows with the same id count as one document, so a repeated row isn't a copy of itself;
    of occurrences in one document the first place counts as the earlier; an empty table gives an empty result.  A column
    that is called n_removed already is replaced; other columns stay as they are."""
    parts = partitions(docs)
    rows = docs.drop("n_removed")
    keyed = rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    spans = _removals(spread(keyed), params, parts).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list("spans").alias("__spans"))
    spans = materialise(spans, "spans")
    joined = rows.join(spans, F.col(doc_id).cast("long") == F.col("__id"), "left").drop("__id")
    at = rows.columns.index(text)
    kind = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches):
            texts, removed = b.column(at).to_pylist(), np.zeros(b.num_rows, I)
            for i, packs in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if packs and texts[i] is not None:
                    texts[i], removed[i] = cut(texts[i], np.concatenate([np.frombuffer(x, np.int32) for x in packs]).reshape(-1, 2))
            columns = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed)], [*(f.name for f in kind), "n_removed"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kind), "n_removed long"])
    return joined.mapInArrow(run, schema)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the passages that an earlier place has: doc_id, removed words, what is left of the text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_spans(docs).select("doc_id", "n_removed", "text")
