"""Full-text search: query router, matching predicates and scores as Columns over a documents table."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import values as V
from quire.functions.analysis import has_phrase, search_tokens
from quire.functions.text import let

WINDOW = 10_000
_NUMERIC = re.compile(r"^[\d,.\s$€£¥]+$")
_SMART_ID = re.compile(r"^[A-Za-z]{2,8}-\d{8}-[A-Za-z0-9]{4,}$")
_VARIANTS = (("rn", "m"), ("m", "rn"), ("l", "1"), ("1", "l"), ("o", "0"), ("0", "o"), ("i", "l"), ("l", "i"), ("s", "5"), ("5", "s"), ("b", "8"), ("8", "b"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"))


@dataclass(frozen=True)
class Parsed:
    """mode: slash, phrase, numeric, path or terms."""

    mode: str
    value: str
    terms: tuple[str, ...] = ()
    slash: str = ""
    filters: dict = field(default_factory=dict)


def parse_slash(q: str) -> tuple[str, str] | None:
    """(mode, value) of a command that begins with a slash or a backslash; None if it isn't one."""
    if q[:1] not in ("/", "\\"):
        return None
    body = q[1:].strip()
    if not body:
        return None
    low = body.lower()
    for mode, prefixes in V.SLASH_MODES:
        for p in prefixes:
            if low.startswith((p + ":", p + "=", p + " ")) and (value := body[len(p) + 1 :].strip()):
                return mode, value.lstrip(".") if mode == "ext" else value
    if _SMART_ID.match(body):
        return "uid", body
    if " " not in body and low.lstrip(".") in V.KNOWN_EXTENSIONS:
        return "ext", low.lstrip(".")
    return "tag", body


def parse(q: str, exact: bool = False) -> Parsed:
    """Slash command, quoted phrase, number, path or plain terms, in this order."""
    q = " ".join(q.split())
    if slash := parse_slash(q):
        return Parsed("slash", slash[1], slash=slash[0])
    bare = q.strip('"')
    terms = tuple(re.findall(r"[^\W_]+", bare.lower()))
    if exact or (len(q) > 1 and q[0] == q[-1] == '"'):
        return Parsed("phrase", bare, terms)
    if bare and _NUMERIC.match(bare):
        return Parsed("numeric", bare, terms)
    if "\\" in bare or "/" in bare or re.search(r"\.[A-Za-z0-9]{2,5}$", bare):
        return Parsed("path", bare, terms)
    return Parsed("terms", bare, terms)


def minimum_should_match(n: int, share: float = 0.75) -> int:
    return max(1, int(n * share))


def matched_terms(tokens: Column, terms: tuple[str, ...]) -> Column:
    """How many distinct query terms the tokens hold."""
    out = F.lit(0)
    for t in dict.fromkeys(terms):
        out = out + F.array_contains(tokens, t).cast("int")
    return out


def term_search(docs: DataFrame, text: str, terms: tuple[str, ...], share: float = 0.75) -> DataFrame:
    """Rows that hold at least the floor of share x distinct terms, with `matched`."""
    need = minimum_should_match(len(dict.fromkeys(terms)), share)
    return docs.withColumn("matched", let(search_tokens(F.col(text)), lambda t: matched_terms(t, terms))).where(F.col("matched") >= need)


def phrase_search(docs: DataFrame, fields: dict[str, float], phrase: str) -> DataFrame:
    """Rows that hold the phrase in some field, with `score`: the largest boost of a field that holds it plus a tenth of the others."""
    words = re.findall(r"[^\W_]+", phrase.lower())
    hits = [F.when(let(search_tokens(F.col(f)), lambda t: has_phrase(t, words)), F.lit(float(b))).otherwise(0.0) for f, b in fields.items()]
    return docs.withColumn("score", dis_max(hits)).where("score > 0")


def dis_max(scores: list[Column], tie: float = 0.1) -> Column:
    total = sum(scores, F.lit(0.0))
    best = F.greatest(*scores, F.lit(0.0))
    return best + tie * (total - best)


def bm25(docs: DataFrame, doc_id: str, text: str, terms: tuple[str, ...], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """doc_id, score of the rows that hold a term.  Only counts of the query's terms are made; document frequencies and the
    mean length are one partial aggregate, joined back as one row."""
    terms = tuple(dict.fromkeys(terms))
    names = [f"tf{i}" for i in range(len(terms))]
    counts = docs.select(doc_id, let(search_tokens(F.col(text)), lambda t: F.struct(F.size(t).alias("n"), *[F.size(_equal(t, x)).alias(c) for c, x in zip(names, terms, strict=True)])).alias("x")).select(doc_id, "x.*")
    facts = counts.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(c) > 0).alias(f"d{c}") for c in names])
    rows = counts.where(sum((F.col(c) for c in names), F.lit(0)) > 0).crossJoin(F.broadcast(facts))  # facts is one row
    score = F.lit(0.0)
    for c in names:
        idf = F.ln(1 + (F.col("docs") - F.col(f"d{c}") + 0.5) / (F.col(f"d{c}") + 0.5))
        score = score + idf * F.col(c) * (k1 + 1) / (F.col(c) + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return rows.select(doc_id, score.alias("score"))


def _equal(tokens: Column, term: str) -> Column:
    return F.filter(tokens, lambda w: w == term)


def decay(age_days: Column, offset: float = 7.0, scale: float = 90.0, at_scale: float = 0.5) -> Column:
    """Gaussian decay of recency."""
    import math

    variance = -(scale**2) / (2 * math.log(at_scale))
    return F.exp(-F.pow(F.greatest(age_days - offset, F.lit(0.0)), 2) / (2 * variance))


def boosted(score: Column, age_days: Column, confidence: Column) -> Column:
    """Score times the sum of the recency, high-confidence and low-confidence functions; no function: unchanged."""
    f = decay(age_days) * 1.2 + F.when(confidence >= 80, 1.3).otherwise(0.0) + F.when((confidence >= 0) & (confidence < 50), 0.8).otherwise(0.0)
    return score * f


def fuzzy_terms(tokens: DataFrame, terms: DataFrame, prefix: int = 3) -> DataFrame:
    """(term, token, distance) within the automatic distance (0 to two letters, 1 to five, 2 beyond) of tokens with the same first
    letters.  tokens(token) and terms(term) are joined by prefix on distinct values."""
    n = F.length("term")
    most = F.when(n <= 2, 0).when(n <= 5, 1).otherwise(2)
    a = terms.select("term", F.substring("term", 1, prefix).alias("p")).distinct()
    b = tokens.select("token", F.substring("token", 1, prefix).alias("p")).distinct()
    near = a.join(b, "p").where(F.abs(F.length("token") - n) <= most)
    return near.select("term", "token", F.levenshtein("term", "token").alias("distance"), most.alias("most")).where("distance <= most").drop("most")


def tier_score(name: Column, path: Column, main: Column, ocr: Column, embedded: Column, q: str) -> Column:
    """Five tiers: exact name 100; phrases 80, 60, 50, 50, 40; all terms over all fields 35; three quarters of them in one field
    20; a near term 10; and 15 for each confusable form of the query in the recognised text."""
    words = re.findall(r"[^\W_]+", q.lower())
    need = minimum_should_match(len(dict.fromkeys(words)))
    tokens = F.struct(*[search_tokens(c).alias(f"f{i}") for i, c in enumerate((name, path, main, ocr, embedded))])

    def score(t: Column) -> Column:
        fields = [t[f"f{i}"] for i in range(5)]
        out = F.when(F.lower(F.coalesce(name, F.lit(""))) == q.lower(), 100.0).otherwise(0.0)
        for f, boost in zip(fields, (80.0, 60.0, 50.0, 50.0, 40.0), strict=True):
            out = out + F.when(has_phrase(f, words), boost).otherwise(0.0)
        everywhere = F.concat(*fields)
        out = out + F.when(matched_terms(everywhere, tuple(words)) == len(dict.fromkeys(words)), 35.0).otherwise(0.0)
        out = out + F.when(F.greatest(*[matched_terms(f, tuple(words)) for f in fields]) >= need, 20.0).otherwise(0.0)
        near = F.lit(False)
        for w in dict.fromkeys(words):
            most = 0 if len(w) <= 2 else 1 if len(w) <= 5 else 2
            near = near | _any_near(everywhere, w, most)
        out = out + F.when(near, 10.0).otherwise(0.0)
        for v in ocr_variants(q.lower()):
            out = out + F.when(has_phrase(fields[3], re.findall(r"[^\W_]+", v)), 15.0).otherwise(0.0)
        return out

    return let(tokens, score)


def _any_near(tokens: Column, term: str, most: int) -> Column:
    return F.exists(tokens, lambda x: (F.substring(x, 1, 3) == term[:3]) & (F.abs(F.length(x) - len(term)) <= most) & (F.levenshtein(x, F.lit(term)) <= most))


def highlight(c: Column, terms: list[str], before: str = "<mark>", after: str = "</mark>") -> Column:
    """Every term of three letters or more between marks, case kept."""
    long = [re.escape(t) for t in terms if len(t) >= 3]
    return F.regexp_replace(c, f"(?i)({'|'.join(long)})", f"{before}$1{after}") if long else c


def snippet_choice(reviewed: Column, main: Column, embedded: Column, ocr: Column, name: Column) -> Column:
    """struct(snippet, field): the first source that has text; embedded text needs over 50 characters and no property listing."""
    has = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    use = [("reviewed", reviewed, has(reviewed)), ("main_content", main, has(main)), ("embedded_content", embedded, (F.length(embedded) > 50) & ~embedded.contains("docProps")), ("ocr_content", ocr, has(ocr)), ("file_name", name, F.lit(True))]
    text, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for f, c, ok in reversed(use):
        text, label = F.when(ok, c).otherwise(text), F.when(ok, f).otherwise(label)
    return F.struct(text.alias("snippet"), label.alias("field"))


def ocr_variants(q: str, limit: int = 8) -> list[str]:
    """Recognition confusions of a query, each once and everywhere, sorted."""
    out = {q.replace(" ", "")} if " " in q else set()
    for a, b in _VARIANTS:
        if a in q:
            out |= {q.replace(a, b), q.replace(a, b, 1)}
    return sorted(out - {q})[:limit]


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """A page of ranked rows. ValueError beyond the result window."""
    if page < 1 or size < 1 or page * size > WINDOW:
        raise ValueError(f"page {page} of {size} lies outside the window of {WINDOW} rows")
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def search(docs: DataFrame, q: str, doc_id: str = "doc_id", fields: dict[str, float] | None = None, page: int = 1, size: int = 10, filters: dict | None = None, path: str | None = None) -> DataFrame:
    """The router: a scored page of the documents that the query finds.  Slash commands match the columns of their mode
    where the table has them; filters are equalities or lists."""
    fields = fields or {"text": 2.0}
    parsed = parse(q)
    rows = docs
    for c, v in (filters or {}).items():
        rows = rows.where(F.col(c).isin(*v) if isinstance(v, list | tuple) else F.col(c) == v)
    main = max(fields, key=fields.get)
    if parsed.mode == "slash":
        cols = [parsed.slash] if parsed.slash in docs.columns else [c for c in docs.columns if c not in (doc_id, *fields)]
        hit = sum((F.when(F.lower(F.col(c).cast("string")) == parsed.value.lower(), 1.0).otherwise(0.0) for c in cols), F.lit(0.0))
        found = rows.withColumn("score", hit).where("score > 0")
    elif parsed.mode in ("phrase", "numeric"):
        found = phrase_search(rows, fields, parsed.value)
    elif parsed.mode == "path" and path:
        tail = parsed.value.replace("\\", "/")
        name = tail.rsplit("/", 1)[-1]
        p = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
        hit = F.when(p == tail, 20.0).otherwise(0.0) + F.when(p.contains(tail), 10.0).otherwise(0.0) + F.when(F.substring_index(p, "/", -1).contains(name), 8.0).otherwise(0.0)
        found = rows.withColumn("score", hit).where("score > 0")
    else:
        ranked = bm25(rows, doc_id, main, parsed.terms)
        found = term_search(rows, main, parsed.terms).join(ranked, doc_id).drop("matched")
    return page_of(found, [F.col("score").desc(), F.col(doc_id)], page, size)
