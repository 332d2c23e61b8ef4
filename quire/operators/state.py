"""Per-file state built from an event log, and keyed upserts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import blank


@dataclass(frozen=True)
class Rules:
    """How each column of the state follows from its events, in order of `seq`.

    keep: the last non-blank text wins; positive: the last number over zero wins; always: the last event's value wins;
    stage: as `keep`, but an event of the owning stage wins even when it is blank."""

    keep: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    always: tuple[str, ...] = ()
    stage: tuple[str, ...] = ()
    owner: str = "tagging"


def merge_events(events: DataFrame, key: str, seq: str, rules: Rules, stage: str = "stage") -> DataFrame:
    """One row per key.  Each column is a max over (sequence, value) of the events that count: partial aggregates, no
    window, so a key with very many events isn't sorted in one task."""

    def last(c: str, counts: Column) -> Column:
        pick = F.max(F.when(counts, F.struct(F.col(seq), F.col(c))))
        return pick[c].alias(c)

    aggs = [last(c, ~blank(F.col(c))) for c in rules.keep] + [last(c, F.col(c) > 0) for c in rules.positive]
    aggs += [last(c, F.lit(True)) for c in rules.always]
    aggs += [last(c, ~blank(F.col(c)) | (F.col(stage) == rules.owner)) for c in rules.stage]
    return events.groupBy(key).agg(*aggs)


def as_state(events: DataFrame, key: str, seq: str, rules: Rules, stage: str = "stage") -> DataFrame:
    """events as rows of an unfinished state: for each column a struct (s, v) of sequence and value, null where the event says
    nothing of it."""

    def told(c: str, counts: Column) -> Column:
        return F.when(counts, F.struct(F.col(seq).alias("s"), F.col(c).alias("v"))).alias(c)

    out = [told(c, ~blank(F.col(c))) for c in rules.keep] + [told(c, F.col(c) > 0) for c in rules.positive] + [told(c, F.lit(True)) for c in rules.always]
    return events.select(key, *out, *[told(c, ~blank(F.col(c)) | (F.col(stage) == rules.owner)) for c in rules.stage])


def merge_states(rows: DataFrame, key: str) -> DataFrame:
    """One unfinished state a key, whatever the order in which its rows came; merging merged rows again changes nothing."""
    return rows.groupBy(key).agg(*[F.max(c).alias(c) for c in rows.columns if c != key])


def finished(rows: DataFrame, key: str) -> DataFrame:
    """The values of unfinished states."""
    return rows.select(key, *[F.col(f"{c}.v").alias(c) for c in rows.columns if c != key])


def sanitise(state: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Blank required columns take their defaults."""
    return state.withColumns({c: F.when(blank(F.col(c)), F.lit(v)).otherwise(F.col(c)) for c, v in defaults.items()})


def upsert(base: DataFrame, updates: DataFrame, key: str, seq: str) -> DataFrame:
    """Whole-row replacement: the last update of each key, else the base row."""
    cols = [c for c in base.columns if c != key]
    latest = updates.groupBy(key).agg(F.max(F.struct(F.col(seq).alias("__seq"), *[F.col(c) for c in cols])).alias("u")).select(key, *[F.col(f"u.{c}").alias(c) for c in cols])
    return base.join(latest.select(key), key, "left_anti").select(key, *cols).unionByName(latest)


def partial_update(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Columns of updates that aren't null replace those of base; keys that base lacks change nothing."""
    cols = [c for c in updates.columns if c != key]
    u = updates.select(key, *[F.col(c).alias(f"__{c}") for c in cols])
    out = base.join(u, key, "left")
    return out.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in cols}).select(*base.columns)


def accuracy_update(base: DataFrame, metrics: DataFrame, key: str, once: tuple[str, ...] = ("enhanced_accuracy",)) -> DataFrame:
    """Measures replace those of the key's state, where they aren't null; those of `once` only fill what is null.  Keys without
    a state change nothing."""
    cols = [c for c in metrics.columns if c != key]
    out = base.join(metrics.select(key, *[F.col(c).alias(f"__{c}") for c in cols]), key, "left")
    return out.withColumns({c: F.coalesce(c, f"__{c}") if c in once else F.coalesce(f"__{c}", c) for c in cols}).select(*base.columns)


def ocr_update(base: DataFrame, ocr: DataFrame, key: str = "doc_id") -> DataFrame:
    """Recognised text and confidence; main content is filled only where it is missing; unknown documents are added."""
    both = base.join(ocr.select(key, F.col("ocr_content").alias("__t"), F.col("ocr_confidence").alias("__c")), key, "full")
    return both.select(
        key, F.when(F.coalesce("main_content", F.lit("")) == "", F.coalesce("__t", "main_content")).otherwise(F.col("main_content")).alias("main_content"),
        F.coalesce("__t", "ocr_content").alias("ocr_content"), F.coalesce("__c", "ocr_confidence").alias("ocr_confidence"), F.col("__t").isNotNull().alias("ocr_completed"),
    )


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Additive migration: columns that are missing are added with their default."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})
