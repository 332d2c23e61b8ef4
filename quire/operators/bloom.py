"""A Bloom filter as a table of 32-bit words, built, kept and asked without the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shape(n: int, p: float) -> tuple[int, int]:
    """(bits, hash functions) for n keys at the false-positive rate p."""
    m = max(32, int(-n * math.log(p) / math.log(2) ** 2))
    return m, max(1, int(m / max(n, 1) * math.log(2)))


def positions(key: Column, m: int, k: int) -> Column:
    """The k bit positions of a key by double hashing of two words of its MD5."""
    word = lambda i: F.conv(F.substring(F.md5(key.cast("binary")), i, 8), 16, 10).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (word(1) + i * word(9).bitwiseOR(F.lit(1))) % m)


def build(keys: DataFrame, key: str, m: int, k: int) -> DataFrame:
    """(word, bits): the set bits by word.  Bits are merged before the shuffle, so it carries at most m / 32 rows a task.
    Writing this table as Parquet keeps the filter; adding keys is one more aggregation over both."""
    bits = keys.where(F.col(key).isNotNull()).select(F.explode(positions(F.col(key).cast("string"), m, k)).alias("at"))
    return bits.groupBy(F.expr("at div 32").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at % 32))")).alias("bits"))


def merge(*filters: DataFrame) -> DataFrame:
    """The filter of all keys of several filters of one shape."""
    out = filters[0]
    for f in filters[1:]:
        out = out.unionByName(f)
    return out.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def members(rows: DataFrame, key: str, bloom: DataFrame, m: int, k: int) -> DataFrame:
    """(key, maybe) of the distinct keys: false is certain, true is wrong at the filter's rate."""
    asked = rows.where(F.col(key).isNotNull()).select(F.col(key)).distinct()
    bits = asked.select(key, F.explode(positions(F.col(key).cast("string"), m, k)).alias("at")).withColumn("word", F.expr("at div 32"))
    set_ = F.coalesce(F.expr("(bits & shiftleft(1L, int(at % 32))) <> 0"), F.lit(False))
    return bits.join(bloom, "word", "left").groupBy(key).agg(F.bool_and(set_).alias("maybe"))
