"""Rule- and taxonomy-based classification with confidence scores and allowed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import values as V
from quire.functions.automaton import Phrases
from quire.functions.text import contains_phrase, holds, let, norm, record_category, tokens
from quire.session import written

MOST_RAW, DEGRADED_CAP, THRESHOLD = 2.0, 1.20, 0.75
SHORTEST_PART = 4  # letters of a candidate that may be part of an allowed value or hold one


def _count(conditions: list[Column]) -> Column:
    out = F.lit(0)
    for c in conditions:
        out = out + c.cast("int")
    return out


def prepared(text: Column, path: Column) -> Column:
    """struct(t, p, w): the taxonomy's phrases in the text and in the path, and the text's tokens.  A Python function is in it:
    make it a column of its own and give that to field_scores(), so that each text is read once for all fields."""
    plain = lambda c: norm(F.translate(F.coalesce(c, F.lit("")), "_\\/", "   "))
    phrases = _taxonomy_phrases()
    return F.struct(phrases.prepare(plain(text)).alias("t"), phrases.prepare(plain(path)).alias("p"), tokens(text).alias("w"))


def _taxonomy_phrases() -> Phrases:
    return Phrases([w for _, label, aliases, keywords, _ in V.TAXONOMY for w in (label, *aliases, *keywords)])


def field_scores(x: Column, field: str, feedback: dict[str, float] | None = None) -> Column:
    """array of struct(label, raw, priority) of the built-in taxonomy for one field of a prepared() text: alias in text 0.30,
    alias in path 0.20, keyword coverage x 0.35, label-token overlap x 0.15, and what reviewers' feedback gives a label, at
    most 0.20."""
    rows = [r for r in V.TAXONOMY if r[0] == field]
    phrases = _taxonomy_phrases()

    def score(t: Column, p: Column, words: Column) -> Column:
        out = []
        for _, label, aliases, keywords, priority in rows:
            names = [label.lower(), *aliases]
            hit = lambda c: F.when(_any([phrases.has(c, a) for a in names]), 1.0).otherwise(0.0)
            used = [k for k in keywords if len(k) >= 3]
            cover = _count([phrases.has(t, k) for k in used]) / F.lit(max(len(keywords), 1))
            own = sorted(set(label.lower().split()))
            overlap = _count([F.array_contains(words, w) for w in own]) / F.lit(len(own))
            liked = min(0.20, (feedback or {}).get(label, 0.0))
            raw = liked + 0.30 * hit(t) + 0.20 * hit(p) + 0.35 * cover + 0.15 * overlap
            out.append(F.struct(F.lit(label).alias("label"), raw.alias("raw"), F.lit(priority).alias("priority")))
        return F.array(*out)

    return score(x["t"], x["p"], x["w"])


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def best_label(scores: Column) -> Column:
    """struct(label, score): ranked by raw score, priority and name; near ties of low scores are held down, scores without a
    language model are capped, and the rest is scaled to at most 0.99."""
    ranked = F.array_sort(F.transform(scores, lambda s: F.struct((-s["raw"]).alias("r"), (-s["priority"]).alias("p"), F.lower(s["label"]).alias("l"), s["label"].alias("label"), s["raw"].alias("raw"))))

    def pick(r: Column) -> Column:
        raw, second = F.get(r, F.lit(0))["raw"], F.get(r, F.lit(1))["raw"]
        held = F.when((raw - F.coalesce(second, F.lit(-1.0)) < 0.05) & (raw < 0.30), F.least(raw, F.lit(0.15))).otherwise(raw)
        return F.struct(F.get(r, F.lit(0))["label"].alias("label"), F.greatest(F.lit(0.0), F.least(F.least(held, F.lit(DEGRADED_CAP)) / MOST_RAW, F.lit(0.99))).alias("score"))

    return let(ranked, pick)


def decide(best: Column, field: str) -> Column:
    """struct(label, score, review): under the threshold, over 0.10 the label stays and is reviewed, else the default at 0.35."""
    low = best["score"] < THRESHOLD
    weak = low & (best["score"] <= 0.10)
    return F.struct(F.when(weak, V.TAXONOMY_DEFAULTS[field]).otherwise(best["label"]).alias("label"), F.when(weak, 0.35).otherwise(best["score"]).alias("score"), low.alias("review"))


def tag(docs: DataFrame, text: str, path: str) -> DataFrame:
    """docs with a struct (label, score, review) per field, the overall confidence and the cross-field check."""
    out = docs.withColumn("__x", prepared(F.col(text), F.col(path)))
    for field in V.TAXONOMY_DEFAULTS:
        out = out.withColumn(field, _decided(field))
    out = out.drop("__x")
    fields = list(V.TAXONOMY_DEFAULTS)
    out = out.withColumn("tag_confidence", sum((F.col(f"{f}.score") for f in fields), F.lit(0.0)) / len(fields))
    all_low = F.col(f"{fields[0]}.review") & F.col(f"{fields[1]}.review") & F.col(f"{fields[2]}.review")
    return out.withColumn("needs_review", all_low)


def _decided(field: str) -> Column:
    return let(best_label(field_scores(F.col("__x"), field)), lambda b: decide(b, field))


def votes(text: Column, table: dict[str, list[str]], default: str, by_length: bool = False) -> Column:
    """The code with the most keyword hits (or hits weighed by phrase length); the first listed wins ties."""

    phrases = Phrases([k for ks in table.values() for k in ks])

    def run(t: Column) -> Column:
        each = []
        for i, (code, keywords) in enumerate(table.items()):
            total = F.lit(0.0)
            for k in keywords:
                total = total + F.when(phrases.has(t, k), 1.0 + (0.5 * (len(k.split()) - 1) if by_length else 0.0)).otherwise(0.0)
            each.append(F.struct(total.alias("n"), F.lit(-i).alias("i"), F.lit(code).alias("code")))
        return let(F.array_max(F.array(*each)), lambda b: F.when(b["n"] > 0, b["code"]).otherwise(default))

    return let(phrases.prepare(norm(F.translate(F.coalesce(text, F.lit("")), "_", " "))), run)


def countries(text: Column) -> Column:
    """ISO-3 codes by names (one each) and currency codes (one each): up to three with at least half of the top count, in
    order of count and name; USA if there is none."""

    phrases = Phrases(list(V.COUNTRIES))

    def run(x: Column) -> Column:
        points: dict[str, list[Column]] = {}
        for name, iso in V.COUNTRIES.items():
            points.setdefault(iso, []).append(phrases.has(x["p"], name))
        for code, iso in V.CURRENCIES.items():
            points.setdefault(iso, []).append(x["t"].contains(code.lower()))
        each = F.filter(F.array(*[F.struct((-_count(c)).alias("n"), F.lit(iso).alias("iso")) for iso, c in points.items()]), lambda x: x["n"] < 0)
        return let(F.slice(F.array_sort(each), F.lit(1), F.lit(3)), lambda top: F.when(F.size(top) == 0, "USA").otherwise(F.array_join(F.transform(F.filter(top, lambda x: x["n"] * 2 <= F.get(top, F.lit(0))["n"]), lambda x: x["iso"]), ", ")))

    return let(F.struct(norm(text).alias("t"), phrases.prepare(norm(text)).alias("p")), run)


def containing(left: DataFrame, x: str, right: DataFrame, y: str, n: int = SHORTEST_PART) -> DataFrame:
    """The pairs of rows where x contains y, as an equi-join: the first n letters of y (or all of a shorter y) meet the runs of as
    many letters of x.  Empty y meet nothing."""
    out = None
    for size in range(1, n + 1):
        runs = left.where(F.length(x) >= size).withColumn("__k", F.explode(F.array_distinct(_runs(x, size))))
        short = right.where(F.length(y) == size if size < n else F.length(y) >= n).withColumn("__k", F.substring(y, 1, size))
        met = runs.join(short, "__k").where(F.contains(x, y)).drop("__k")
        out = met if out is None else out.unionByName(met)
    return out


def _runs(x: str, size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(x) - size + 1), lambda i: F.substring(x, i, F.lit(size)))


def allowed_value(candidates: DataFrame, allowed: DataFrame, column: str) -> DataFrame:
    """column, value, mode: exact match, then either contains the other (four letters or more), then the largest token
    overlap; the smallest name wins ties.  Blank candidates and blank allowed values match nothing.

    Distinct candidates meet allowed(value), a registry of any size, on equal forms, on the first letters of the one among the
    runs of letters of the other, and on words; only those pairs are compared."""
    c = candidates.select(F.col(column).alias("candidate")).distinct().withColumn("c", norm(F.col("candidate")))
    a = allowed.select("value", norm(F.col("value")).alias("a")).where("a <> ''").distinct()
    long = c.where(F.length("c") >= SHORTEST_PART)
    exact = c.join(a, F.col("c") == F.col("a")).select("candidate", F.lit(1).alias("tier"), F.lit(0).alias("o"), "value")
    partial = [x.select("candidate", F.lit(2).alias("tier"), F.lit(0).alias("o"), "value") for x in (containing(long, "c", a, "a"), containing(a, "a", long, "c"))]
    words = lambda df, x, *keep: df.select(*keep, F.explode(tokens(F.col(x))).alias("w"))
    overlap = words(c, "c", "candidate").join(words(a, "a", "value"), "w").groupBy("candidate", "value").agg((-F.count("*")).cast("int").alias("o")).select("candidate", F.lit(3).alias("tier"), "o", "value")
    found = exact
    for x in (*partial, overlap):
        found = found.unionByName(x)
    ranked = found.groupBy("candidate").agg(F.min(F.struct("tier", "o", "value")).alias("best"))
    mode = F.when(F.col("best.tier") == 1, "exact").when(F.col("best.tier") == 2, "partial").when(F.col("best.tier") == 3, "overlap")
    return c.select("candidate").join(ranked, "candidate", "left").select(F.col("candidate").alias(column), F.col("best.value").alias("value"), F.coalesce(mode, F.lit("none")).alias("mode"))


def constrain(score: Column, mode: Column) -> Column:
    """struct(score, forced, source): a forced value keeps at most 0.75."""
    forced = mode.isin("partial", "overlap")
    return F.struct(F.when(forced, F.least(score, F.lit(0.75))).otherwise(score).alias("score"), forced.alias("forced"), F.when(mode == "exact", "pass").when(forced, "forced").otherwise("no_match").alias("source"))


def match_score(doc: dict[str, Column], row: dict[str, Column]) -> Column:
    """Points of a metadata row for a document: key 90, name 80 (contained 45), path 70 (contained 35), doc 60."""
    same = lambda k: F.coalesce((norm(doc[k]) == norm(row[k])) & (norm(row[k]) != ""), F.lit(False))
    within = lambda k: F.coalesce((norm(row[k]) != "") & norm(doc[k]).contains(norm(row[k])), F.lit(False))
    out = F.lit(0)
    for k, full, part in (("key", 90, 0), ("name", 80, 45), ("path", 70, 35), ("doc", 60, 0)):
        if k in doc and k in row:
            out = out + F.when(same(k), full).when(within(k) if part else F.lit(False), part).otherwise(0)
    return out


def best_rows(docs: DataFrame, rows: DataFrame, doc_id: str, row: str, of_doc: dict[str, str], of_row: dict[str, str]) -> DataFrame:
    """doc_id, points, row: the metadata row with most points (see match_score) for each document that any row has points for;
    the smallest row of equals.  of_doc and of_row name the columns of key, name, path and doc.

    Documents and rows meet on equal keys and documents, and on names and paths that hold the row's; only those pairs get
    points, so neither side need be small."""
    both = [k for k in ("key", "name", "path", "doc") if k in of_doc and k in of_row]
    d = docs.select(F.col(doc_id).alias("__d"), *[norm(F.col(of_doc[k])).alias(f"d_{k}") for k in both])
    r = rows.select(F.col(row).alias("__r"), *[norm(F.col(of_row[k])).alias(f"r_{k}") for k in both])
    pairs = None
    for k in both:
        a, b = d.select("__d", f"d_{k}"), r.select("__r", f"r_{k}").where(F.col(f"r_{k}") != "")
        met = (containing(a, f"d_{k}", b, f"r_{k}") if k in ("name", "path") else a.join(b, F.col(f"d_{k}") == F.col(f"r_{k}"))).select("__d", "__r")
        pairs = met if pairs is None else pairs.unionByName(met)
    points = match_score({k: F.col(f"d_{k}") for k in both}, {k: F.col(f"r_{k}") for k in both})
    scored = pairs.distinct().join(d, "__d").join(r, "__r").where(points > 0)
    best = scored.groupBy("__d").agg(F.max(F.struct(points.alias("points"), (-F.col("__r")).alias("r"))).alias("b"))
    return best.select(F.col("__d").alias(doc_id), F.col("b.points").cast("long").alias("points"), (-F.col("b.r")).cast("long").alias(row))


__all__ = ["best_rows", "allowed_value", "best_label", "constrain", "contains_phrase", "countries", "decide", "field_scores", "match_score", "tag", "tag_requests", "votes"]


def provenance(sources: Column) -> Column:
    """One word for the constraint sources of all fields: no_match or forced if any was forced, else pass, else none."""
    has = lambda s: F.array_contains(sources, s)
    return F.when(has("forced"), F.when(has("no_match"), "no_match").otherwise("forced")).when(has("pass"), "pass").otherwise("none")


def subtags(text: Column, limit: int = 15) -> Column:
    """Taxonomy aliases and keywords of three letters or more that the text holds, sorted, at most `limit`."""
    words = sorted({w for _, label, aliases, keywords, _ in V.TAXONOMY for w in (label.lower(), *aliases, *keywords) if len(w) >= 3})
    phrases = Phrases(words)
    plain = norm(F.translate(F.coalesce(text, F.lit("")), "_\\/", "   "))
    return let(phrases.prepare(plain), lambda x: F.slice(F.filter(F.array(*[F.when(phrases.has(x, w), w) for w in words]), lambda w: w.isNotNull()), F.lit(1), F.lit(limit)))


def too_little(contents: list[Column], has_metadata: Column, least: int = 50) -> Column:
    """Whether a document has too little content to be classified without metadata."""
    total = F.lit(0)
    for c in contents:
        total = total + F.length(F.trim(F.coalesce(c, F.lit(""))))
    return (total < least) & ~F.coalesce(has_metadata, F.lit(False))


def registry_casing(rows: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """rows with the comma-separated values of `column` in the registry's casing; values it doesn't know go.

    Each distinct cell is taken apart once and its parts meet allowed(value), of any size, on their normalised form; of names
    that differ in casing only the smallest counts."""
    cell = F.coalesce(F.col(column), F.lit(""))
    known = allowed.groupBy(norm(F.col("value")).alias("__k")).agg(F.min("value").alias("__v"))
    parts = rows.select(cell.alias("__cell")).distinct().select("__cell", F.posexplode(F.split("__cell", ",")).alias("__i", "__p")).withColumn("__k", norm(F.col("__p")))
    cased = parts.join(known, "__k").groupBy("__cell").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__i", "__v"))), lambda x: x["__v"]), ", ").alias("__c"))
    return rows.withColumn("__cell", cell).join(cased, "__cell", "left").withColumn(column, F.coalesce("__c", F.lit(""))).drop("__cell", "__c")


def sub_units(text: Column, units: list[str], scope: dict[str, tuple[str, ...]], parent: Column) -> Column:
    """The first unit of the parent's scope whose last name part the text holds, else the scope's `Multiple` unit, else its first."""

    def run(t: Column) -> Column:
        out = F.lit("")
        for p, marks in reversed(scope.items()):
            own = [u for u in units if any(m in u.lower() for m in marks)] or units
            first = F.lit(next((u for u in own if "multiple" in u.lower()), own[0] if own else ""))
            for u in reversed(own):
                first = F.when(holds(t, u.rsplit("-", 1)[-1].strip()), u).otherwise(first)
            out = F.when(parent == p, first).otherwise(out)
        return out

    return let(norm(text), run)


def canonical_label(field: str, label: Column) -> Column:
    """The taxonomy's label of a field that a label or alias stands for, null if there is none."""
    names = {}
    for f, name, aliases, _, _ in V.TAXONOMY:
        if f == field:
            for a in (name, *aliases):
                names.setdefault(" ".join(a.lower().split()), name)
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), norm(label))


def _with_modes(rows: DataFrame, allowed: DataFrame, few: int = 100_000, often: int = 100_000) -> DataFrame:
    """rows with value and mode of their label __l (see allowed_value).

    Most rows share a handful of labels, so rows are never dealt by label as they are: up to `few` distinct labels are
    broadcast.  Beyond that those of more than `often` rows are, and only the rows of the others meet the rest by shuffle."""
    counted = written(rows.groupBy("__l").agg(F.count("*").alias("__n")))
    modes = written(allowed_value(counted, allowed, "__l"))
    if modes.count() <= few:
        return rows.join(F.broadcast(modes), "__l", "left")
    known = modes.join(counted, "__l").select("__l", F.struct("value", "mode").alias("__m"), "__n")
    told = rows.join(F.broadcast(known.where(F.col("__n") > often).drop("__n")), "__l", "left")
    own = F.when(F.col("__m").isNull() & F.col("__l").isNotNull(), -1).otherwise(F.monotonically_increasing_id() % 10_000)  # what is told already or has no label lies anywhere
    rest = known.where(F.col("__n") <= often).select("__l", F.col("__m").alias("__r"), F.lit(-1).cast("long").alias("__own"))
    met = told.withColumn("__own", own).join(rest, ["__own", "__l"], "left")
    found = F.coalesce("__m", "__r")
    return met.withColumns({"value": found["value"], "mode": found["mode"]}).drop("__own", "__m", "__r")


def tag_requests(docs: DataFrame, text: str, path: str, explicit: dict[str, str], derived: dict[str, str], allowed: dict[str, DataFrame] | None = None, feedback: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The whole tagger: docs with a struct (label, score, source, review) for each field, the dimensions and `tagging_status`.

    A field's label is, in this order, the explicit metadata label (0.99, or 0.97 if the taxonomy doesn't know it), the
    derived one (0.86, 0.78), or the best-scored one; under the threshold it is kept for review, or without a signal
    replaced by the default.  allowed(value) of a field then constrains it (see allowed_value): a forced value is reviewed.
    Category and department give way to the record category and the business unit of the text, where these are told.
    Documents with too little text and no metadata are unclassified.  explicit and derived name columns by field; feedback
    gives labels by field up to 0.20 more."""
    out = docs
    has_metadata = _any([norm(F.col(c)) != "" for c in (*explicit.values(), *derived.values())])
    out = out.withColumn("__x", prepared(F.col(text), F.col(path)))
    out = out.withColumn("__little", too_little([F.col(text)], F.coalesce(has_metadata, F.lit(False))))
    for field, default in V.TAXONOMY_DEFAULTS.items():
        found = F.struct(F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("score"), F.lit("").alias("source"))
        told = []
        for columns, known, raw, source in ((explicit, 0.99, 0.97, "metadata_explicit"), (derived, 0.86, 0.78, "metadata_derived")):
            if field in columns:
                c = F.col(columns[field])
                label = canonical_label(field, c)
                told.append(F.when(norm(c) != "", F.struct(F.coalesce(label, F.trim(c)).alias("label"), F.when(label.isNotNull(), known).otherwise(raw).alias("score"), F.lit(source).alias("source"))))
        scored = let(best_label(field_scores(F.col("__x"), field, (feedback or {}).get(field))), lambda b: F.struct(b["label"].alias("label"), b["score"].alias("score"), F.lit("model").alias("source")))
        found = F.coalesce(*told, scored)

        def settle(x: Column) -> Column:
            low = x["score"] < THRESHOLD
            weak = low & (x["score"] <= 0.10)
            return F.struct(F.when(weak, default).otherwise(x["label"]).alias("label"), F.when(weak, 0.35).otherwise(x["score"]).alias("score"), F.when(weak, "deterministic_default").otherwise(x["source"]).alias("source"), low.alias("review"))

        out = out.withColumn(field, let(found, settle))
        if allowed and field in allowed:
            out = _with_modes(out.withColumn("__l", F.col(f"{field}.label")), allowed[field])
            bound = constrain(F.col(f"{field}.score"), F.col("mode"))
            new = F.struct(F.coalesce("value", F.col(f"{field}.label")).alias("label"), bound["score"].alias("score"), F.concat(F.col(f"{field}.source"), F.lit("/"), bound["source"]).alias("source"), (F.col(f"{field}.review") | bound["forced"]).alias("review"))
            out = out.withColumn(field, new).drop("__l", "value", "mode")
    code = votes(F.col(text), V.RECORD_TYPES, "")
    out = out.withColumns({"record_type": code, "business_unit": votes(F.col(text), V.BUSINESS_UNITS, "GECC HQ", by_length=True), "countries": countries(F.col(text))})
    out = out.withColumn("record_category", record_category(F.col("record_type")))
    fields = list(V.TAXONOMY_DEFAULTS)
    little = F.col("__little")
    review = _any([F.col(f"{f}.review") for f in fields])
    final = {"category": F.when(F.col("record_category") != "", F.col("record_category")).otherwise(F.col("category.label")), "department": F.col("business_unit"), "purpose": F.col("purpose.label")}
    mean = sum((F.col(f"{f}.score") for f in fields), F.lit(0.0)) / len(fields)
    out = out.withColumns({f"final_{f}": F.when(little, "Unclassified").otherwise(c) for f, c in final.items()} | {"review_required": little | review, "tagging_status": F.when(little, "insufficient_content").when(review, "needs_review").otherwise("tagged"), "overall": F.when(little, 0.0).otherwise(mean)})
    return out.drop("__little", "__x")
