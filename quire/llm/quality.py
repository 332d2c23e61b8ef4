"""Quality rules with suffix-array repetition.

Method.  The words of a text are numbered and their suffixes sorted by prefix doubling (only groups that are still tied
are sorted again).  The longest common prefix of neighbours in the suffix array, by binary lifting over the ranks of
each doubling step, gives the LCP intervals: the repeated substring of largest length that begins at each word.  The
union of the spans of all repeated substrings of at least `min_repeat` words is the covered part.  A text is rejected
if that exceeds `max_covered` of its words, or if one repeat is longer than `max_longest` words.

Memory is bounded by one text: about 12 bytes a word and doubling step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quire.llm.common import pieces_of, spread, words_of

SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 50
    max_repeat_percent: int = 50  # of words in 3-word windows found twice or more
    min_repeat: int = 10  # words from which a repeated substring counts
    max_covered_percent: int = 30  # of words covered by such substrings
    max_longest: int = 100  # words of the longest repeated substring


def longest_repeats(ids: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring that begins there and also begins elsewhere.

    Lengths under three are given as 0.  ids: int64 from 0."""
    n = len(ids)
    out = np.zeros(n, np.int64)
    if n < 4:
        return out
    base = int(ids.max()) + 2
    if base < 1 << 21:
        x = np.zeros(n + 2, np.int64)
        x[:n] = ids + 1
        key = (x[:n] * base + x[1 : n + 1]) * base + x[2:]
    else:
        key = _triple_ranks(ids)
    order = np.argsort(key, kind="stable")
    fresh = np.empty(n, bool)
    fresh[0] = True
    sorted_key = key[order]
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=fresh[1:])
    if fresh.all():
        return out
    starts = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.full(n + 1, -1, np.int64)  # of the group's first place; beyond the end -1
    rank[order] = starts
    levels = [(3, rank)]
    alone = fresh & np.append(fresh[1:], True)
    tied = np.flatnonzero(~alone)  # places in the suffix array
    first = tied
    h = 3
    while len(tied):
        rank = rank.copy()
        p = order[tied]
        after = rank[np.minimum(p + h, n)]
        by = np.lexsort((after, rank[p]))
        p, after = p[by], after[by]
        old = rank[p]
        order[tied] = p
        new = np.empty(len(tied), bool)
        new[0] = True
        np.logical_or(old[1:] != old[:-1], after[1:] != after[:-1], out=new[1:])
        rank[p] = np.maximum.accumulate(np.where(new, tied, 0))
        h *= 2
        levels.append((h, rank))
        tied = tied[~(new & np.append(new[1:], True))]
    # LCP of neighbours that share at least three words
    base_rank = levels[0][1]
    i = first[:-1][(np.diff(first) == 1)]
    a, b = order[i], order[i + 1]
    same = base_rank[a] == base_rank[b]
    a, b = a[same], b[same]
    lcp = np.zeros(len(a), np.int64)
    for length, ranks in reversed(levels):
        lcp += np.where(ranks[a + lcp] == ranks[b + lcp], length, 0) * (a + lcp < n) * (b + lcp < n)
    ends = np.append(ids, -1)
    for _ in range(2):
        ea, eb = a + lcp, b + lcp
        lcp += (ends[ea] == ends[eb]) & (ea < n) & (eb < n)
    np.maximum.at(out, a, lcp)
    np.maximum.at(out, b, lcp)
    return out


def _triple_ranks(ids: np.ndarray) -> np.ndarray:
    """Order-preserving keys of three words where packing would overflow."""
    n = len(ids)
    x = np.append(ids + 1, [0, 0])
    by = np.lexsort((x[2:], x[1 : n + 1], x[:n]))
    t = np.stack([x[:n], x[1 : n + 1], x[2:]])[:, by]
    out = np.empty(n, np.int64)
    out[by] = np.append(0, np.cumsum((t[:, 1:] != t[:, :-1]).any(axis=0)))
    return out


def covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> int:
    """Positions in the union of spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeated_words", "longest_repeat")


def measure(text: str | None, p: QualityParams) -> tuple[int, ...]:
    """The figures COLUMNS of one text; zeros for null or empty."""
    if not text:
        return (0,) * 7
    words = words_of(text)
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    dup, seen = 0, set()
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line and line.strip(SPACES):
            seen.add(line)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return n, chars, symbols, dup, 0, 0, 0
    longest = longest_repeats(ids)
    at3 = np.flatnonzero(longest >= 3)
    if not len(at3):
        return n, chars, symbols, dup, 0, 0, 0
    at = at3[longest[at3] >= p.min_repeat]
    return n, chars, symbols, dup, covered(at3, 3, n), covered(at, longest[at], n) if len(at) else 0, int(longest.max())


def verdicts(figures: np.ndarray, p: QualityParams) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept from rows of COLUMNS."""
    n, repeat, cover, longest = figures[:, 0], figures[:, 4], figures[:, 5], figures[:, 6]
    base = (n < p.min_words) | (100 * repeat > p.max_repeat_percent * n)
    return base, ~base & (100 * cover <= p.max_covered_percent * n) & (longest <= p.max_longest)


def _figures(texts: pa.Array, p: QualityParams) -> np.ndarray:
    return np.array([measure(t, p) for t in texts.to_pylist()], np.int64).reshape(-1, 7)


def quality_report(docs: DataFrame, params: QualityParams = QualityParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the figures COLUMNS, base_failed and kept of each row.

    Null and empty texts have no word, so they fail; repeated rows are judged each; an empty table gives an empty
    result; other columns don't matter.  The figures are exact for texts of any length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches):
            f = _figures(b.column(1), params)
            base, kept = verdicts(f, params)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(f[:, i]) for i in range(7)), pa.array(base), pa.array(kept)], [doc_id, *COLUMNS, "base_failed", "kept"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return spread(docs.select(doc_id, text)).mapInArrow(run, f"{doc_id} {kind}, {', '.join(f'{c} long' for c in COLUMNS)}, base_failed boolean, kept boolean")


def quality_filter(docs: DataFrame, params: QualityParams = QualityParams(), text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; no shuffle.

    Null and empty texts have no word, so their rows go; repeated rows are judged each; texts of any length are judged whole;
    an empty table gives an empty result; other columns stay as they are."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches):
            yield b.filter(pa.array(verdicts(_figures(b.column(at), params), params)[1]))

    return spread(docs).mapInArrow(run, docs.schema)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every text of documents under the production rules."""
    report = quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "repeated_words")


_P = QualityParams()
_W = r"[^\x20\x09-\x0D]+"


def _windows(size: int, name: str) -> str:
    """Words of each text that lie in windows of `size` words found twice or more in it."""
    return f"""
{name}_all as (select doc_id, i, array_to_string(w[i:i + {size - 1}], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - {size - 2})) as i from words where len(w) >= {size}) s),
{name}_twice as (select doc_id, g from {name}_all group by all having count(*) > 1),
{name} as (select doc_id, count(distinct j) as n from (select a.doc_id, unnest(range(a.i, a.i + {size})) as j from {name}_all a join {name}_twice t on a.doc_id = t.doc_id and a.g = t.g) x group by doc_id)"""


SQL = f"""
with words as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_W}') as w from documents),
lines as (select doc_id, l, count(*) as c from (select doc_id, unnest(string_split(text, chr(10))) as l from words) s where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by all),
dup as (select doc_id, sum(c - 1) as n from lines group by doc_id),
{_windows(3, "w3")},
{_windows(_P.min_repeat, "wm")},
{_windows(_P.max_longest + 1, "wl")},
figures as (
  select words.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines,
    coalesce(w3.n, 0)::bigint as n_repeat_words, coalesce(wm.n, 0)::bigint as repeated_words, coalesce(wl.n, 0) as too_long
  from words left join dup using (doc_id) left join w3 using (doc_id) left join wm using (doc_id) left join wl using (doc_id)),
judged as (select *, n_words < {_P.min_words} or 100 * n_repeat_words > {_P.max_repeat_percent} * n_words as base_failed from figures)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and 100 * repeated_words <= {_P.max_covered_percent} * n_words and too_long = 0 as kept, repeated_words
from judged
"""
