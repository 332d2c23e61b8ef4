"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

Method.  A pre-token is a word with a leading word mark.  The distinct pre-tokens of a piece of a batch are taken in
sorted order, which walks their trie depth first: a node has the forward score of its prefix (best log probability, with
its token count), and as only the nodes above the current one are needed again, the trie is held as the stack of the
current branch.  Of the next pre-token only the part after the prefix it shares with the one before is computed.  A
forward score is pushed along the trie of the vocabulary's pieces, which ends at the first letter that no piece goes on
with.  The count at a pre-token's last letter is stored, and a document's count is the sum over its words.

Model.  The pieces of a public SentencePiece vocabulary, with log probability -ln(rank + `shift`): a Zipf law over the
vocabulary's own order (the file's scores are merge ranks, not probabilities).  A letter that isn't a piece falls back
to its UTF-8 bytes, each at the probability of the last rank.  Nothing is trained."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import pieces_of, spread

MARK = "▁"
_PIECE = 2048  # documents whose words share a trie


@dataclass(frozen=True)
class CountParams:
    model: str = "piece_bpe_32k.model"  # a file of public_tokenizers or a path
    shift: float = 2.7
    memo_bytes: int = 64_000_000  # of stored words and counts in each Python worker


@lru_cache(maxsize=2)
def vocabulary(name: str, shift: float) -> tuple[dict[str, float], float, int]:
    """Piece -> log probability, that of a byte, and the longest piece's length."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=name if Path(name).exists() else public_tokenizers.path(name))
    plain = (i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)))
    pieces = {model.id_to_piece(i): -math.log(i + shift) for i in plain}
    return pieces, -math.log(model.vocab_size() + shift), max(map(len, pieces), default=1)


@lru_cache(maxsize=2)
def piece_ends(name: str, shift: float) -> dict[str, float | None]:
    """The trie of the reversed pieces as a map from each suffix of a piece to its log probability, None where it is no piece
    itself: a walk back from a place stops at the first suffix that is absent."""
    pieces = vocabulary(name, shift)[0]
    return {piece[i:]: pieces.get(piece[i:]) for piece in pieces for i in range(len(piece))}


def terminal_counts(words: list[str], params: CountParams) -> dict[str, int]:
    """Tokens of the best segmentation of each distinct word; ties go to fewer tokens."""
    pieces, byte, _ = vocabulary(params.model, params.shift)
    ends = piece_ends(params.model, params.shift)
    out: dict[str, int] = {}
    score, count = [0.0], [0]
    before = ""
    absent = object()
    for word in sorted(words):
        w = MARK + word
        k = 0
        top = min(len(w), len(before))
        while k < top and w[k] == before[k]:
            k += 1
        del score[k + 1 :], count[k + 1 :]
        for j in range(k + 1, len(w) + 1):
            best, n = -math.inf, 0
            if w[j - 1] not in pieces:
                n = len(w[j - 1].encode("utf-8", "surrogatepass"))
                best, n = score[j - 1] + n * byte, count[j - 1] + n
            for i in range(j - 1, -1, -1):
                p = ends.get(w[i:j], absent)
                if p is absent:
                    break
                if p is not None:
                    s = score[i] + p
                    if s > best or (s == best and count[i] + 1 < n):
                        best, n = s, count[i] + 1
            score.append(best)
            count.append(n)
        out[word] = count[-1]
        before = w
    return out


_memo: dict[CountParams, tuple[dict[str, int], list[int]]] = {}
_ENTRY = 150  # bytes of a stored word besides its letters


def _size(words: set[str]) -> int:
    return sum(map(len, words)) + _ENTRY * len(words)


def count_texts(texts: list[str | None], params: CountParams) -> tuple[np.ndarray, np.ndarray]:
    """Words and tokens of each text."""
    memo, used = _memo.setdefault(params, ({}, [0]))
    words = [t.split() if t else [] for t in texts]
    fresh = set().union(*words).difference(memo)
    size = _size(fresh)
    if used[0] + size > params.memo_bytes:  # keep memory bounded: start anew with this piece's words
        memo.clear()
        used[0] = 0
        fresh = set().union(*words)
        size = _size(fresh)
    memo.update(terminal_counts(list(fresh), params))
    used[0] += size
    get = memo.__getitem__
    return np.array([len(w) for w in words], np.int64), np.array([sum(map(get, w)) for w in words], np.int64)


def token_counts(docs: DataFrame, params: CountParams = CountParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of each row.

    Null and empty texts have none; words are what str.split() gives, of any length, and very long texts are counted whole; repeated rows are counted each; an
    empty table gives an empty result; other columns don't matter.  No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches, _PIECE):
            words, tokens = count_texts(b.column(1).to_pylist(), params)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(tokens)], [doc_id, "n_words", "n_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return spread(docs.select(doc_id, text)).mapInArrow(run, f"{doc_id} {kind}, n_words long, n_tokens long")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """Words and unigram tokens of every document."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
