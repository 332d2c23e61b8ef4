"""URL filter: a Bloom filter cascade gives exact membership of a url's keys in a rule list, without joins.

Method.  A rule is a key (host followed by a path prefix) with a verdict.  The keys that a url asks for are all its
host suffixes with all path prefixes as long as some rule's.  For each verdict, level 1 encodes the listed keys;
level 2 encodes those keys of the corpus's complete key universe that level 1 takes wrongly; level 3 encodes the
listed keys that level 2 takes wrongly, and so on until a level takes none wrongly.  A key is listed if the first
level that lacks it has an even number (or if all levels have it and their count is odd).  As every key of the
universe was put through the levels when they were built, this is exact for every url of the table.

Everything is DataFrame expressions.  A level is an array of 64-bit words, once in the plan as a constant, which Spark
broadcasts to each executor with the stage's task; a joined one-row column would be copied into every row.  Its size is
checked against `max_bits` (2 MB by default, a million listed keys).  A false-positive set that doesn't fit gets a level 1 of lower error, which always ends:
the expected number of false positives falls with each step while the level grows by a few bits a listed key.  A rule
list too long for `max_bits` is refused with an error that says so, never cut.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """verdict: allow or block; host without a leading dot; path: empty or a prefix beginning with a slash."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def key(self) -> str:
        return self.host + self.path


#: The rules of the production query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or end; empty for null or without ://."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """All keys that may be listed for a url: host suffixes x path prefixes of the given lengths, longest first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    def of_length(k: int) -> Column:
        return F.transform(suffixes, lambda s: F.when(F.length(path) >= k, F.concat(s, F.substring(path, 1, k))))

    keys = [of_length(k) for k in path_lengths]
    flat = F.array_distinct(F.filter(F.concat(*keys), lambda k: k.isNotNull()))
    by_length = F.array_sort(F.transform(flat, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k"))))
    return F.when(host != "", F.transform(by_length, lambda s: s["k"])).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: tuple[int, ...]
    salt: int

    def has(self, key: Column) -> Column:
        """Whether the level may hold the key: all of its positions are set. The words stand in the plan once."""
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        places = F.array(*[_position(key, self.bits, self.salt, j) for j in range(self.hashes)])
        return F.forall(places, lambda at: F.getbit(F.get(words, F.floor(at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1)


def _position(key: Column, bits: int, salt: int, j: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt), F.lit(j)), F.lit(bits).cast("long"))


def _level(keys: DataFrame, n: int, fpp: float, salt: int, max_bits: int) -> Level | None:
    """The Bloom filter of the column `key`; None if it would be larger than max_bits."""
    bits = max(64, -(-int(-n * math.log(fpp) / math.log(2) ** 2) // 64) * 64)
    if bits > max_bits:
        return None
    hashes = max(1, round(bits / max(n, 1) * math.log(2)))
    hashes = min(hashes, max(1, round(-math.log2(fpp))))
    at = F.explode(F.array(*[_position(F.col("key"), bits, salt, j) for j in range(hashes)])).alias("at")
    one = F.expr("shiftleft(1L, cast(pmod(at, 64) as int))")
    rows = keys.select(at).groupBy(F.floor(F.col("at") / 64).alias("w")).agg(F.bit_or(one).alias("b")).collect()  # at most max_bits / 64 rows
    words = [0] * (bits // 64)
    for r in rows:
        words[r["w"]] = r["b"]
    return Level(bits, hashes, tuple(words), salt)


@dataclass(frozen=True)
class Cascade:
    """Levels of alternating content; exact for every key of the universe they were built over."""

    levels: tuple[Level, ...]

    def has(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[i].has(key), out).otherwise(F.lit(i % 2 == 1))
        return out & key.isNotNull()


def build_cascade(listed: DataFrame, universe: DataFrame, fpp: float = 1e-3, max_bits: int = 1 << 24, salt: int = 0, later_fpp: float = 0.01) -> Cascade:
    """listed, universe: DataFrames with a column `key` (universe: rows may repeat). Empty lists give no levels."""
    listed = listed.select("key").where(F.col("key").isNotNull()).distinct()
    n = listed.count()
    if not n:
        return Cascade(())
    while True:
        first = _level(listed, n, fpp, salt, max_bits)
        if first is None:
            raise ValueError("the rule list needs more than max_bits; raise max_bits")
        wrong = materialise(universe.select("key").where(first.has(F.col("key"))).distinct().join(listed, "key", "left_anti"), "false-positives")
        n_wrong = wrong.count()
        if n_wrong * 10 <= max_bits:
            break
        fpp *= 1e-3
    levels, inside, outside, n_in = [first], wrong, listed, n_wrong
    while n_in:
        level = _level(inside, n_in, later_fpp, salt + len(levels), max_bits)
        if level is None:
            raise ValueError("a level of the cascade needs more than max_bits")
        levels.append(level)
        inside, outside = outside.where(level.has(F.col("key"))), inside
        n_in = inside.count()
    return Cascade(tuple(levels))


def url_filter(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow", fpp: float = 1e-3, max_bits: int = 1 << 24) -> DataFrame:
    """`keep` columns, host, path, rule (the key of the longest rule that fits, else null) and verdict of each row.

    A rule fits its host and all subdomains if the path starts with the rule's; a url that no rule fits gets `default`,
    the method's verdict on an unlisted url.  Null urls and urls without :// have empty host and path, fit no rule and
    get `default`.  Very long urls are judged whole; of rules with one key the one whose verdict comes first by name counts;
    repeated rows stay; an empty table gives an empty result; other columns don't matter.
    """
    spark = pages.sparkSession
    lengths = sorted({len(r.path) for r in rules}, reverse=True)
    rows = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    keys = candidate_keys(F.col("host"), F.col("path"), lengths) if lengths else F.array().cast("array<string>")
    # one short row for each distinct (host, prefix that matters) before keys are spread out
    universe = rows.select("host", F.substring("path", 1, max(lengths, default=0)).alias("path")).distinct()
    universe = materialise(universe.select(F.explode(keys).alias("key")).distinct(), "universe")
    verdicts = {}
    for i, verdict in enumerate(sorted({r.verdict for r in rules})):
        listed = spark.createDataFrame([(r.key,) for r in rules if r.verdict == verdict], "key string")
        verdicts[verdict] = build_cascade(listed, universe, fpp, max_bits, salt=1000 * i)
    hit = F.filter(keys, lambda k: _any([c.has(k) for c in verdicts.values()]))
    out = rows.withColumn("rule", F.get(hit, F.lit(0)))
    verdict = F.lit(default)
    for name, cascade in reversed(verdicts.items()):  # of equal keys, the first verdict by name counts
        verdict = F.when(F.col("rule").isNotNull() & cascade.has(F.col("rule")), F.lit(name)).otherwise(verdict)
    return out.withColumn("verdict", verdict)


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every url of pages under the production rules."""
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def _sql() -> str:
    cases = sorted(RULES, key=lambda r: -len(r.key))
    fits = lambda r: f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')"
    rule = " ".join(f"when {fits(r)} then '{r.key}'" for r in cases)
    verdict = " ".join(f"when {fits(r)} then '{r.verdict}'" for r in cases)
    return rf"""
with rest as (select page_id, case when url is null or instr(url, '://') = 0 then '' else substr(url, instr(url, '://') + 3) end as rest from pages),
parts as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rest)
select page_id, host, path, case {rule} end as rule, case {verdict} else 'allow' end as verdict from parts
"""


SQL = _sql()
