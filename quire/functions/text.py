"""Scalar text functions as Column -> Column expressions (JVM side, no UDF)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import values as V

#: A word edge that treats accented letters as letters, in Java and in RE2.
EDGE_LEFT, EDGE_RIGHT = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""


def norm(c: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def tokens(c: Column) -> Column:
    """Distinct runs of two or more of a-z 0-9 in the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0)))


def quoted(s: str) -> str:
    """A literal as a pattern that Java and RE2 read alike."""
    return "".join(f"\\{x}" if x in r"\.[]{}()*+-?^$|/&" else x for x in s)


def phrase_pattern(phrase: str) -> str:
    return EDGE_LEFT + quoted(" ".join(phrase.lower().split())) + EDGE_RIGHT


def spaced(phrase: str) -> str:
    """A phrase with each character that is no letter, digit, underscore or space set apart by spaces."""
    return "".join(c if c.isalnum() or c in "_ " else f" {c} " for c in " ".join(phrase.lower().split()))


def holds(t: Column, phrase: str) -> Column:
    """Whether a normalised text holds the phrase between word edges; the plain search spares most texts the pattern."""
    return F.contains(t, F.lit(" ".join(phrase.lower().split()))) & t.rlike(phrase_pattern(phrase))


def contains_phrase(c: Column, phrase: str) -> Column:
    """Whether the normalised text holds the phrase between word edges; _ \\ and / count as spaces."""
    return let(norm(F.translate(c, "_\\/", "   ")), lambda t: holds(t, phrase))


def normalise_content(c: Column) -> Column:
    """The text that the content hash is taken of: lower case, single spaces, without dates and page numbers."""
    out = norm(c)
    for p in (r"\d{4}-\d{2}-\d{2}[t ]\d{2}:\d{2}:\d{2}", r"\d{2}/\d{2}/\d{4}", r"page \d+", r"\d+ of \d+"):
        out = F.regexp_replace(out, p, "")
    return out


def content_hash(c: Column) -> Column:
    """SHA-256 of the normalised content; empty for empty."""
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.sha2(normalise_content(c), 256))


def truncate(c: Column, most: int) -> Column:
    """struct(text, truncated, length): cut at `most`, back to the last space if that lies beyond 80 %, with a mark."""
    c = F.coalesce(c, F.lit(""))
    head = F.substring(c, 1, most)
    back = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    cut = F.when(F.length(back) > 0.8 * most, back).otherwise(head)
    over = F.length(c) > most
    return F.struct(F.when(over, F.concat(cut, F.lit(" [content truncated]"))).otherwise(c).alias("text"), over.alias("truncated"), F.length(c).cast("long").alias("length"))


def split_values(c: Column, separators: str = ",;|") -> Column:
    """Trimmed non-empty parts."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), f"[{separators}]"), lambda x: F.trim(x)), lambda x: x != "")  # trim alone would take the place for characters


Rule = tuple[str, str, str, str]


def correction_rules() -> list[Rule]:
    """(stage, kind, pattern, replacement) in order; kind: re (Java replacement groups), lit, or phrase (case-insensitive,
    tested on the text as it was before the stage)."""
    rules: list[Rule] = [("dates", "re", rf"\b{y}\b", "2011") for y in V.WRONG_YEARS]
    rules += [("dates", "re", rf"({'|'.join(V.MONTHS_31)})\s+[4-9]\d+", "$1 31"), ("dates", "re", rf"({'|'.join(V.MONTHS_30)})\s+[4-9]\d+", "$1 30"), ("dates", "re", r"February\s+[3-9]\d+", "February 28")]
    rules += [("amounts", "re", r"\$\s*(\d+)\s+(\d{3})\b", r"\$$1,$2"), ("amounts", "re", r"\(\s*\$?\s*(\d+)\s+(\d{3})\s*\)", r"(\$$1,$2)"), ("amounts", "re", r"\$\s+", r"\$")]
    rules += [("characters", "lit", a, b) for a, b in V.CHARACTERS.items()]
    rules += [("phrases", "phrase", a, b) for a, b in V.PHRASES.items()]
    rules += [("patterns", "lit", a, b) for a, b in (*V.BROKEN_WORDS.items(), *V.STATES)]
    return rules


def correct(c: Column) -> Column:
    """struct(text, corrections) after all rules in order, in one pass of an accumulator (nothing is computed twice)."""
    rules = correction_rules()
    out = F.struct(F.coalesce(c, F.lit("")).alias("text"), F.lit(0).cast("long").alias("n"))
    for stage in dict.fromkeys(r[0] for r in rules):
        out = let(out, _stage([r for r in rules if r[0] == stage]))
    return F.struct(out["text"].alias("text"), out["n"].alias("corrections"))


def _may_hold(t: Column, pattern: str) -> Column:
    """Whether the text has what any hit of a rule's pattern has: plain searches, which spare most texts the pattern."""
    if pattern.startswith(r"\b"):
        return F.contains(t, F.lit(pattern[2:-2].replace("\\|", "|")))
    names = next((g for g in (V.MONTHS_31, V.MONTHS_30) if pattern.startswith("(" + "|".join(g) + ")")), ("February",) if pattern.startswith("February") else ("(",) if pattern.startswith(r"\(") else ("$",))
    out = F.lit(False)
    for n in names:
        out = out | F.contains(t, F.lit(n))
    return out


def _stage(rules: list[Rule]) -> Callable[[Column], Column]:
    kind = rules[-1][1]
    if kind == "re":
        def run(x: Column) -> Column:
            for _, _, p, r in rules:
                def step(y: Column, p: str = p, r: str = r) -> Column:
                    changed = F.struct(F.regexp_replace(y["text"], p, r).alias("text"), (y["n"] + F.regexp_count(y["text"], F.lit(p))).alias("n"))
                    return F.when(_may_hold(y["text"], p), changed).otherwise(y)

                x = let(x, lambda y: step(y))  # noqa: B023
            return x

        return run
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit("(?i)" + quoted(a)).alias("p")) for _, _, a, b in rules])

    def fold(x: Column) -> Column:
        def literal(acc: Column, r: Column) -> Column:
            gone = (F.length(acc["text"]) - F.length(F.replace(acc["text"], r["a"], F.lit("")))) / F.length(r["a"])
            return F.struct(F.replace(acc["text"], r["a"], r["b"]).alias("text"), (acc["n"] + gone.cast("long")).alias("n"))

        def phrase(acc: Column, r: Column) -> Column:
            return F.struct(F.regexp_replace(acc["text"], r["p"], r["b"]).alias("text"), (acc["n"] + F.regexp_count(acc["text"], r["p"])).alias("n"))

        def used(before: Column) -> Column:  # no replacement of a stage makes another's pattern, so the text before it tells
            return F.filter(table, lambda r: F.contains(before, r["a"]))

        rules_used = let(F.lower(x["text"]) if kind == "phrase" else x["text"], used)
        start = F.struct(x["text"].alias("text"), x["n"].cast("long").alias("n"))
        return F.aggregate(rules_used, start, phrase if kind == "phrase" else literal)

    return fold


def confidentiality(c: Column) -> Column:
    t = norm(c)
    has = lambda p: t.rlike(EDGE_LEFT + p + EDGE_RIGHT)
    return F.when(has(r"(strictly )?confidential") & ~has("not confidential"), "Confidential").when(has("(internal (use|only)|restricted)") & ~has("unrestricted"), "Internal").otherwise("Public")


def data_classification(c: Column) -> Column:
    """Five levels, the most sensitive first; `restricted` counts unless to, from or access follows."""
    t = norm(c)
    has = lambda p: t.rlike(EDGE_LEFT + p + EDGE_RIGHT)
    return (
        F.when(has("spii") | t.rlike(EDGE_LEFT + "sensitive personal"), "GE Confidential with SPII")
        .when(t.rlike(EDGE_LEFT + r"restricted(?![\p{L}\p{N}_])(?! (to|from|access))") & ~has("unrestricted"), "GE Restricted")
        .when(has("confidential") & ~has("not confidential"), "GE Confidential")
        .when(has("internal (use|only)") | has("ge internal"), "GE Internal")
        .when(has("public") | has("unrestricted"), "Public")
        .otherwise("GE Internal")
    )


def record_format(main: Column, ocr: Column, mime: Column) -> Column:
    return F.when(~blank(ocr) & (blank(main) | F.lower(F.coalesce(mime, F.lit(""))).contains("image")), "Physical").otherwise("Electronic")


def location_type(text: Column, path: Column) -> Column:
    t, p = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(path, F.lit("")))
    return (
        F.when(F.coalesce(text, F.lit("")).rlike(r"(?i)(?:^|\n)\s*(?:From|To|Subject|Date|Sent|Cc)\s*:"), "Email")
        .when(t.contains("sharepoint") | p.contains("sharepoint"), "SharePoint")
        .when(t.contains("box.com") | p.contains("box.com"), "Box")
        .when(p.contains("\\\\"), "Shared Drive")
        .when(t.contains("application") & (t.contains("system") | t.contains("platform")), "Application")
        .otherwise("Shared Drive")
    )


def file_type(ext: Column, mime: Column) -> Column:
    """Extension, else the MIME map, else the MIME subtype, else unknown."""
    e = F.ltrim(F.lower(F.coalesce(ext, F.lit(""))), F.lit("."))
    m = F.lower(F.coalesce(mime, F.lit("")))
    table = F.create_map(*[F.lit(x) for kv in V.MIME_TO_EXT.items() for x in kv])
    return F.when(e != "", e).otherwise(F.coalesce(F.element_at(table, m), F.when(m.contains("/"), F.substring_index(m, "/", -1)), F.lit("unknown")))


def record_category(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in V.CATEGORY_OF_PREFIX.items() for x in kv])
    return F.coalesce(F.element_at(table, F.regexp_extract(code, "^([A-Z]+)", 1)), F.lit(""))


def smart_id(department: Column, when: Column, key: Column, today: str) -> Column:
    """Department letters, date and four hex digits of the key's SHA-1; `today` (yyyymmdd) if `when` has no ISO date."""
    letters = F.substring(F.regexp_replace(F.upper(F.when(blank(department), "DOC").otherwise(department)), "[^A-Z0-9]", ""), 1, 3)
    day = F.regexp_replace(F.regexp_extract(F.coalesce(when, F.lit("")), r"(\d{4}-\d{2}-\d{2})", 1), "-", "")
    return F.concat_ws("-", F.when(letters == "", "DOC").otherwise(letters), F.when(day == "", today).otherwise(day), F.upper(F.substring(F.sha1(F.when(blank(key), "unknown").otherwise(key)), 1, 4)))


def file_key(file_hash: Column, file_id: Column, path: Column) -> Column:
    return F.coalesce(F.when(~blank(file_hash), file_hash), F.when(file_id.isNotNull(), F.concat(F.lit("file-"), file_id.cast("string"))), F.when(~blank(path), F.concat(F.lit("path-"), path)), F.lit(""))


def size_category(size: Column) -> Column:
    mib = 1 << 20
    return F.when(size < mib, "tiny").when(size < 10 * mib, "small").when(size < 50 * mib, "medium").otherwise("large")


def format_size(size: Column) -> Column:
    steps = [("B", 0), ("KB", 10), ("MB", 20), ("GB", 30), ("TB", 40)]
    out = F.format_string("%.2f TB", size / F.lit(float(1 << 40)))
    for unit, bits in reversed(steps[:-1]):
        out = F.when(size < F.lit(1 << bits + 10), F.format_string(f"%.2f {unit}", size / F.lit(float(1 << bits)))).otherwise(out)
    return F.when(F.coalesce(size, F.lit(0)) == 0, "0 MB").otherwise(out)


def seconds_to_human(s: Column) -> Column:
    s = s.cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, r)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))


def snippet(c: Column, terms: list[str], window: int = 180) -> Column:
    """The text around the earliest term, with ellipses; the start of the text if there is none."""
    c = F.coalesce(c, F.lit(""))
    hits = [F.when(F.instr(F.lower(c), t.lower()) > 0, F.instr(F.lower(c), t.lower())) for t in terms]
    first = F.array_min(F.array(*hits, F.lit(None).cast("int")))
    start = F.greatest(first - window // 2, F.lit(1))
    body = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(c, start, F.lit(window)), F.when(start + window <= F.length(c), "...").otherwise(""))
    return F.when(first.isNull(), F.concat(F.substring(c, 1, window), F.when(F.length(c) > window, "...").otherwise(""))).otherwise(body)
