"""Metadata sheets: what their columns are, and what each row says.

A sheet's rows are maps from normalised column names to texts, so sheets of any shape lie in one table.  Columns are profiled
in one scan by figures that merge: counts, type votes and sketches of the distinct values and of the lengths; profiles of two
loads combine without reading either again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import values as V
from quire.functions.text import norm


def sheet_rows(sheet: DataFrame, name: str) -> DataFrame:
    """sheet, values: a row as a map; of columns whose names are equal once normalised the last counts; empty cells are left out."""
    last = {" ".join(c.lower().split()): i for i, c in enumerate(sheet.columns)}
    cells = F.array(*[F.struct(F.lit(n).alias("key"), F.trim(F.col(f"c{i}").cast("string")).alias("value")) for n, i in last.items()])
    return sheet.toDF(*[f"c{i}" for i in range(len(sheet.columns))]).select(F.lit(name).alias("sheet"), F.map_from_entries(F.filter(cells, lambda e: F.coalesce(e["value"], F.lit("")) != "")).alias("values"))


def excluded_sheet(name: Column) -> Column:
    return norm(name).rlike("(?i)" + "|".join(V.EXCLUDED_SHEETS))


def column_role(name: Column) -> Column:
    """struct(role, field) of a normalised column name: a tag or key it gives, else extended if a kept pattern fits and no excluded
    one does, else none.  A name that gives both a tag and a key gives the tag."""
    tags = {a: f for f, names in reversed(V.TAG_ALIASES.items()) for a in names}
    keys = {a: f for f, names in reversed(V.JOIN_ALIASES.items()) for a in names}
    of = lambda table: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), name)
    kept = (name != "") & ~name.startswith("unnamed") & ~name.rlike("|".join(V.EXCLUDED_COLUMNS)) & name.rlike("|".join(V.EXTENDED_PATTERNS))
    role = F.when(of(tags).isNotNull(), "tag").when(of(keys).isNotNull(), "key").when(kept, "extended").otherwise("none")
    return F.struct(role.alias("role"), F.coalesce(of(tags), of(keys), F.lit("")).alias("field"))


_SUMS = ("filled", "placeholders", "numbers", "dates")


def profile(rows: DataFrame) -> DataFrame:
    """column, filled, placeholders, numbers, dates (votes), and sketches of the distinct values and of the lengths, in one scan of
    sheet_rows(); sheets that are excluded are left out."""
    cells = rows.where(~excluded_sheet(F.col("sheet"))).select(F.explode("values").alias("column", "value"))
    empty = norm(F.col("value")).isin(*V.PLACEHOLDERS)
    yes = lambda c: F.count_if(c & ~empty)
    return cells.groupBy("column").agg(
        F.count("*").alias("filled"), F.count_if(empty).alias("placeholders"), yes(F.expr("try_cast(value as double)").isNotNull()).alias("numbers"), yes(F.expr("try_cast(value as date)").isNotNull() & F.col("value").rlike("-")).alias("dates"),
        F.hll_sketch_agg("value").alias("values_sketch"), F.kll_sketch_agg_bigint(F.length("value").cast("long")).alias("lengths_sketch"),
    )


def merged(*profiles: DataFrame) -> DataFrame:
    """Profiles of several loads as one."""
    rows = profiles[0]
    for p in profiles[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("column").agg(*[F.sum(c).alias(c) for c in _SUMS], F.hll_union_agg("values_sketch").alias("values_sketch"), F.kll_merge_agg_bigint("lengths_sketch").alias("lengths_sketch"))


def schema(profiled: DataFrame) -> DataFrame:
    """column, role, field, kind, filled, placeholders, distinct (estimated), median_length (estimated) of a profile.  A column is of
    the kind that nine tenths of its cells, placeholders aside, vote for, else text."""
    told = F.col("filled") - F.col("placeholders")
    kind = F.when(told == 0, "empty").when(F.col("dates") * 10 >= told * 9, "date").when(F.col("numbers") * 10 >= told * 9, "number").otherwise("text")
    return profiled.select("column", column_role(F.col("column")).alias("r"), kind.alias("kind"), "filled", "placeholders", F.hll_sketch_estimate("values_sketch").alias("distinct"), F.kll_sketch_get_quantile_bigint("lengths_sketch", F.lit(0.5)).alias("median_length")).select("column", "r.*", "kind", "filled", "placeholders", "distinct", "median_length")


def _first(values: Column, names: tuple[str, ...], real: bool) -> Column:
    one = lambda n: F.element_at(values, n)
    ok = lambda v: (v != "") & ~norm(v).isin(*V.PLACEHOLDERS) if real else v != ""
    return F.coalesce(*[F.when(ok(one(n)), one(n)) for n in names])


def _filled(entries: dict[str, Column]) -> Column:
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in entries.items()])
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def explicit_tags(values: Column) -> Column:
    """map of the tags that a row states: the first of a tag's columns whose cell says something."""
    return _filled({f: _first(values, names, True) for f, names in V.TAG_ALIASES.items()})


def join_values(values: Column) -> Column:
    """map of the keys by which a row meets a document: the first filled of a key's columns; a name, path or id that no column of
    its own gives is taken from the first column, by name, that looks like one."""
    cells = F.array_sort(F.filter(F.map_entries(values), lambda e: e["value"] != ""))
    like = lambda test: F.get(F.filter(cells, lambda e: test(e["key"])), F.lit(0))["value"]
    guesses = {"file_name": lambda k: k.contains("file") & k.contains("name"), "file_path": lambda k: k.contains("path"), "doc_id": lambda k: k.endswith("id")}
    own = {f: _first(values, names, False) for f, names in V.JOIN_ALIASES.items()}
    return _filled({f: F.coalesce(c, like(guesses[f])) if f in guesses else c for f, c in own.items()})


def extended_values(values: Column) -> Column:
    """map of the cells of extended columns that say something."""
    return F.map_filter(values, lambda k, v: (column_role(k)["role"] == "extended") & (v != "") & ~norm(v).isin(*V.PLACEHOLDERS))
