"""Packing of tokenised documents into sequences.

Method.  A document's ids are cut into full sequences and one remainder.  Rows are dealt into randomised groups of about
`group_docs` by a hash of their place in the scan, so that null or repeated ids spread like all others.  Within a group, pieces are placed by first-fit decreasing: a tournament tree
over the free space of the bins finds the first bin that a piece fits into in log(bins) steps.  Groups are independent,
so placing is one shuffle of piece descriptions; token ids never leave the task that made them.

Tokeniser.  The ids of the byte-level BPE file in the format of `tokenizers`.  The same vocabulary and pattern as ranks
gives the same ids several times faster, so that is used for texts without a special token's string and without a run
of `long_run` characters, whose pattern search would need a stack as deep as the run is long.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialise, mix, pieces_of, spread


@dataclass(frozen=True)
class PackParams:
    sequence: int = 2048
    end_id: int = 1
    group_docs: int = 8192
    seed: int = 29
    tokenizer: str = "byte_bpe_50k.json"  # a file of public_tokenizers or a path


LONG_RUN = 50_000
_RUNS = re.compile(r"\s+|\S+")


def _has_long_run(text: str) -> bool:
    return len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in _RUNS.finditer(text))


@lru_cache(maxsize=2)
def tokenizer(name: str):
    """A function from a text to its ids, made once in each Python worker."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = name if Path(name).exists() else public_tokenizers.path(name)
    slow = Tokenizer.from_file(path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    by_rank = Path(path).with_suffix(".tiktoken")
    if not by_rank.exists():
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, by_rank.open("rb"))}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: slow.encode(text, add_special_tokens=False).ids if any(s in text for s in special) or _has_long_run(text) else fast.encode_ordinary(text)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, given in decreasing order, by a tournament tree of free space."""
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, size in enumerate(lengths.tolist()):
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        bins[i], offsets[i] = at - leaves, capacity - tree[at]
        tree[at] -= size
        while at > 1:
            at //= 2
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
    return bins, offsets


def pieces(docs: DataFrame, params: PackParams = PackParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece, and draw, a hash of the row's place in the scan.

    Null and empty texts give one piece of the end id; equal rows give pieces each; texts of any length are encoded whole; an
    empty table gives an empty result; other columns don't matter."""
    p = params

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before, task = tokenizer(p.tokenizer), 0, TaskContext.get().partitionId()
        for b in pieces_of(batches):
            row, start, length, crc, total = [], [], [], [], []
            for r, t in enumerate(b.column(1).to_pylist()):
                ids = np.array([*(encode(t) if t else ()), p.end_id], "<u4")
                for s in range(0, len(ids), p.sequence):
                    part = ids[s : s + p.sequence]
                    row.append(r)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
            draw = mix(np.array(row, np.uint64) + np.uint64(before + (task << 40) + p.seed)).view(np.int64)
            before += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array(draw)], [doc_id, "start", "length", "ids_crc32", "doc_tokens", "draw"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return spread(docs.select(doc_id, text)).mapInArrow(run, f"{doc_id} {kind}, start long, length long, ids_crc32 long, doc_tokens long, draw long")


def pack(docs: DataFrame, params: PackParams = PackParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents with sequence_id and offset.

    Null and empty texts are one piece of the end id; equal rows are packed each; an empty table gives an empty result.
    Very long texts are cut like all others; null and repeated ids spread over the groups; other columns don't matter.
    Within a sequence, offsets are gapless from 0; each id of a document lies in exactly one piece.  Ties in length are
    placed by id, start and ids.  Descriptions of pieces (a hundredth of the texts) are written once, so no text is encoded
    twice."""
    p = params
    found = materialise(pieces(docs, p, doc_id, text), "pieces")
    groups = max(1, -(-found.where("start = 0").count() // p.group_docs))
    rows = found.withColumn("g", F.pmod("draw", F.lit(groups))).drop("draw")
    kind = docs.schema[doc_id].dataType.simpleString()

    def place(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["length", doc_id, "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(g["length"].to_numpy(), p.sequence)
        return g.drop(columns="g").assign(sequence_id=bins + (int(g["g"].iloc[0]) << 32), offset=offsets)

    return rows.groupBy("g").applyInPandas(place, f"{doc_id} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
