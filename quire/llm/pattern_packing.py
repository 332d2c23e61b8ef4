"""Best-fit packing of tokenised documents by length patterns.

Method.  Documents of more than `sequence` tokens are cut into full pieces and a last one.  The histogram of piece lengths
(at most `sequence` numbers) goes to the driver.  There, all patterns of at most `most_docs` length classes that fill a
sequence are enumerated, and non-negative least squares fits how often each is to be used so that the classes' counts come
out.  Pieces are dealt into randomised groups; in each group the patterns are used their share of times, rounded, and what
is left is packed best-fit decreasing into the free space of these sequences or new ones.  A pattern gives the make-up of a
sequence in classes of `grid` tokens; its last two members are chosen so that they leave the least space.

Scale.  Token ids never leave the task that made them: piece descriptions (some 40 bytes) are written once and shuffled
once.  Groups are dealt by a hash of a row's place, so null or repeated ids spread.  The fit depends on the histogram only,
and its cost on `grid` and `most_docs` only.

Tokeniser.  The normaliser and the pre-tokeniser treat white space as nothing but a border, so a text's ids are those of
its white-space-separated chunks, each encoded by `tokenizers` itself and remembered; what is remembered of earlier texts takes about `memo_bytes` at most."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialise, mix, pieces_of, spread


@dataclass(frozen=True)
class PatternParams:
    sequence: int = 4096
    end_id: int = 1
    grid: int = 64  # tokens of a length class
    most_docs: int = 6  # of a pattern
    group_pieces: int = 65_536
    seed: int = 31
    tokenizer: str = "word_bpe_49k.json"  # a file of public_tokenizers or a path
    memo_bytes: int = 256_000_000  # of remembered chunks in each Python worker, at most


# Unicode's White_Space; str.split() also cuts at four control characters that are none.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_CONTROL = re.compile("[\x1c-\x1f]")
_LONGEST = 64  # characters of a chunk that is remembered
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII punctuation without the apostrophe
_LATIN_END = "\u0250"
_ENTRY = 400  # bytes of a remembered chunk, about


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit numbers: those of its white-space-separated chunks, each by `tokenizers`
    and remembered.  Of a chunk of plain Latin letters with or without ASCII marks after them (not apostrophes, which may begin a
    pre-token of letters), the letters are one pre-token and the marks another, so the library's model encodes each at once."""

    def __init__(self, name: str, memo_bytes: int):
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        self.own = Tokenizer.from_file(name if Path(name).exists() else public_tokenizers.path(name))
        self.model = self.own.model
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.memo: dict[str, bytes] = {}
        self.most = memo_bytes // _ENTRY

    def _token(self, token: str) -> bytes:
        """Ids of one pre-token of lower-case letters or of marks, remembered under itself."""
        ids = self.memo.get(token)
        if ids is None:
            ids = self.memo[token] = array("I", [t.id for t in self.model.tokenize(token if token.isascii() else self.as_bytes(token)[0][0])]).tobytes()
        return ids

    def _ids(self, chunk: str) -> bytes:
        letters = chunk.rstrip(_MARKS)
        if letters.isalpha() and "|" not in chunk and len(chunk) <= _LONGEST:
            lower = letters.lower()
            if chunk.isascii() or (lower.isalpha() and max(lower) < _LATIN_END and is_normalized("NFC", chunk)):
                return self._token(lower) + self._token(chunk[len(letters) :]) if len(letters) < len(chunk) else self._token(lower)
        return array("I", self.own.encode(chunk, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        chunks = _SPACE.split(text) if _CONTROL.search(text) else text.split()
        memo = self.memo
        if len(memo) > self.most:
            memo.clear()
        fresh = set(chunks).difference(memo)
        rare = {c: self._ids(c) for c in fresh if len(c) > _LONGEST}
        for c in fresh:
            if len(c) <= _LONGEST:
                memo[c] = self._ids(c)
        return b"".join([rare[c] if len(c) > _LONGEST else memo[c] for c in chunks]) if rare else b"".join(map(memo.__getitem__, chunks))


@lru_cache(maxsize=2)
def encoder(name: str, memo_bytes: int) -> Encoder:
    return Encoder(name, memo_bytes)


def pieces(docs: DataFrame, params: PatternParams = PatternParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, and draw, a hash of the row's place in the scan.

    Null and empty texts give one piece of the end id; equal rows give pieces each; texts of any length are encoded whole; an
    empty table gives an empty result; other columns don't matter."""
    p = params
    width = 4 * p.sequence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before, task, end = encoder(p.tokenizer, p.memo_bytes), 0, TaskContext.get().partitionId(), p.end_id.to_bytes(4, "little")
        for b in pieces_of(batches):
            row, piece, length, crc = [], [], [], []
            for r in range(b.num_rows):
                t = b.column(1)[r].as_py()
                ids = (encode(t) if t else b"") + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    row.append(r)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            draw = mix((np.array(row, np.uint64) + np.uint64(before)) * np.uint64(1 << 20) + np.array(piece, np.uint64) + np.uint64((task << 44) + p.seed)).view(np.int64)
            before += b.num_rows
            k = pa.array(piece, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), k, pa.array(np.array(piece, np.int64) * p.sequence), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(draw)], [doc_id, "piece", "start", "length", "ids_crc32", "draw"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return spread(docs.select(docs[doc_id], docs[text])).mapInArrow(run, f"{doc_id} {kind}, piece int, start long, length long, ids_crc32 long, draw long")


def enumerate_patterns(total: int, most: int) -> list[tuple[int, ...]]:
    """All falling sequences of 1 to `most` positive numbers with sum `total`."""
    out = []

    def grow(head: tuple[int, ...], left: int, top: int) -> None:
        if not left:
            out.append(head)
        elif len(head) < most:
            for x in range(min(left, top), 0, -1):
                if x * (most - len(head)) < left:
                    break
                grow((*head, x), left - x, x)

    grow((), total, total)
    return out


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative least squares by active sets (Lawson and Hanson): x >= 0 with the least |a x - b|."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    scale = 1e-9 * max(1.0, float(np.abs(b).max(initial=0))) * max(1.0, float(np.abs(a).max(initial=0)))
    for _ in range(3 * a.shape[0] + 30):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        best = int(gradient.argmax())
        if gradient[best] <= scale:
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = (x[at][low] / np.maximum(x[at][low] - s[low], 1e-300)).min()
            x[at] += step * (s - x[at])
            gone = at[(x[at] <= 1e-12) | (low & (x[at] <= 1e-9 * max(1.0, x.max())))]
            x[gone] = 0
            active[gone] = False
            if not len(gone):
                break
    return x


def fit(counts: np.ndarray, params: PatternParams) -> list[tuple[tuple[int, ...], float]]:
    """Patterns (of classes, longest first) with the number of times each is to be used for all pieces; counts[l] is the number
    of pieces of l tokens.  Pieces under half a class belong to none; they fill what the patterns leave.  Full pieces are a
    pattern of one.  A class weighs as its length."""
    p = params
    classes = p.sequence // p.grid
    held = counts.astype(float).copy()
    alone = held[p.sequence]
    held[p.sequence] = 0
    of = (np.arange(p.sequence + 1) + p.grid // 2) // p.grid
    b = np.bincount(of, held, classes + 1)[1 : classes + 1]
    patterns = [x for x in enumerate_patterns(classes, p.most_docs) if all(b[c - 1] for c in x)]
    out = [((classes,), alone)] if alone else []
    if patterns:
        a = np.zeros((classes, len(patterns)))
        for j, x in enumerate(patterns):
            np.add.at(a[:, j], np.array(x) - 1, 1)
        w = np.arange(1, classes + 1) / classes
        x = nnls(a * w[:, None], b * w)
        out += [(patterns[j], float(x[j])) for j in np.argsort(-x, kind="stable") if x[j] > 0]
    return out


class Shelf:
    """Numbers kept by size 0..top: the bits of `sizes` say which sizes have any."""

    def __init__(self, top: int):
        self.held: list[list[int]] = [[] for _ in range(top + 1)]
        self.sizes = 0

    def put(self, size: int, number: int) -> None:
        self.held[size].append(number)
        self.sizes |= 1 << size

    def take(self, size: int) -> int:
        number = self.held[size].pop()
        if not self.held[size]:
            self.sizes &= ~(1 << size)
        return number

    def longest(self, most: int) -> int:
        """The largest size up to `most` that has any; -1 for none."""
        return (self.sizes & ((2 << most) - 1)).bit_length() - 1

    def shortest(self, least: int) -> int:
        """The smallest size from `least` on that has any; -1 for none."""
        above = self.sizes >> least
        return least + (above & -above).bit_length() - 1 if above else -1


def choose(shelf: Shelf, pattern: tuple[int, ...], params: PatternParams) -> list[int] | None:
    """Sizes on the shelf that follow the pattern: of each class but the last two the longest; the last two so that they leave the
    least space, the last one being whatever fits best.  None if a class is used up or over half a class of space would stay."""
    p, taken, left = params, [], params.sequence
    need: dict[int, int] = {}

    def held(size: int) -> bool:
        return size > 0 and len(shelf.held[size]) > need.get(size, 0)

    def longest(most: int, least: int = 1) -> int:
        size = shelf.longest(most) if most > 0 else -1
        while size >= least and not held(size):
            size = shelf.longest(size - 1)
        return size if size >= least else -1

    def low(c: int) -> int:
        return max(1, c * p.grid - p.grid // 2)

    for c in pattern[:-2]:
        size = longest(min(low(c + 1) - 1, left), low(c))
        if size < 0:
            return None
        taken.append(size)
        need[size] = need.get(size, 0) + 1
        left -= size
    if len(pattern) == 1:
        best = (left - longest(left), [longest(left)])
    else:
        best = (left, [])
        c = pattern[-2]
        size = longest(min(low(c + 1) - 1, left - 1), low(c))
        while size > 0 and best[0]:
            need[size] = need.get(size, 0) + 1
            last = longest(left - size)
            need[size] -= 1
            if last > 0 and left - size - last < best[0]:
                best = (left - size - last, [size, last])
            size = longest(size - 1, low(c))
    return None if not best[1] or best[1][-1] < 0 or best[0] > p.grid // 2 else [*taken, *best[1]]


def place(lengths: np.ndarray, patterns: list[tuple[tuple[int, ...], int]], params: PatternParams) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, and how many pieces the patterns placed; patterns come with their whole number of
    uses."""
    p = params
    n, full = len(lengths), p.sequence
    bins, offsets = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    shelf, spaces = Shelf(full), Shelf(full)
    for i in range(n - 1, -1, -1):
        shelf.put(int(lengths[i]), i)
    free: list[int] = []

    def add(i: int, at: int) -> None:
        bins[i], offsets[i] = at, full - free[at]
        free[at] -= int(lengths[i])

    for pattern, times in patterns:
        for _ in range(times):
            chosen = choose(shelf, pattern, p)
            if chosen is None:
                break
            free.append(full)
            for size in chosen:
                add(shelf.take(size), len(free) - 1)
            spaces.put(free[-1], len(free) - 1)
    by_patterns = int((bins >= 0).sum())
    while shelf.sizes:
        size = shelf.longest(full)
        i, room = shelf.take(size), spaces.shortest(size)
        if room < 0:
            free.append(full)
            at = len(free) - 1
        else:
            at = spaces.take(room)
        add(i, at)
        spaces.put(free[at], at)
    return bins, offsets, by_patterns


def pack_patterns(docs: DataFrame, params: PatternParams = PatternParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece.

    Null and empty texts are one piece of the end id; equal rows and null ids are packed each; very long texts are cut into full
    pieces and a last one; an empty table gives an empty result; other columns don't matter.  Within a sequence, offsets are
    gapless from 0.  Ties in length are placed by id, piece and ids."""
    p = params
    found = materialise(pieces(docs, p, doc_id, text), "pieces")
    counts = np.zeros(p.sequence + 1, np.int64)
    for length, n in found.groupBy("length").count().collect():  # a row a length
        counts[length] = n
    total = int(counts.sum())
    groups = max(1, -(-total // p.group_pieces))
    fitted = fit(counts, p)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["length", doc_id, "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        uses = [(x, round(n * len(g) / total)) for x, n in fitted]
        bins, offsets, _ = place(g["length"].to_numpy(), uses, p)
        return g.drop(columns="g").assign(sequence_id=bins + (int(g["g"].iloc[0]) << 32), offset=offsets)

    rows = found.withColumn("g", F.pmod("draw", F.lit(groups))).drop("draw")
    return rows.groupBy("g").applyInPandas(run, f"{doc_id} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op12_pattern_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids."""
    return pack_patterns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
