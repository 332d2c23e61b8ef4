"""Small rules as Column expressions: review crops, recognition output, batch sizes, thresholds, state fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Who reviews a kind of crop, in the two maps that are in use; others go to the last name.
ROLES = {"handwritten": "Transcription Auditor", "faded_text": "Faded Text Specialist", "stamp": "Compliance Officer", "logo": "Brand Integrity Reviewer"}
REFINED_ROLES = {"signature": "Contract Auditor", "stamp": "Operations Manager", "text_anomaly": "Text Specialist"}
OTHER_ROLE, OTHER_REFINED = "Reviewer", "Marketing Reviewer"
VISUAL = ("signature", "stamp", "logo", "text_anomaly", "faded_text")


def _among(kind: Column, table: dict[str, str], other: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), kind), F.lit(other))


def reviewer_role(kind: Column) -> Column:
    return _among(kind, ROLES, OTHER_ROLE)


def refined(kind: Column, width: Column, height: Column, page_height: Column) -> Column:
    """struct(kind, role): a signature crop under twice as wide as high and over 2 % of the page high is unclear text."""
    w, h = F.greatest(width, F.lit(1.0)), F.greatest(height, F.lit(1.0))
    unclear = (kind == "signature") & (w / h < 2.0) & (h / F.greatest(page_height, F.lit(1.0)) > 0.02)
    new = F.when(F.coalesce(unclear, F.lit(False)), "text_anomaly").otherwise(kind)
    return F.struct(new.alias("kind"), _among(new, REFINED_ROLES, OTHER_REFINED).alias("role"))


def text_like(kind: Column, text: Column, confidence: Column) -> Column:
    """Whether what recognition reads from a visual crop shows that it is text."""
    text, conf = F.coalesce(text, F.lit("")), F.coalesce(confidence, F.lit(0.0))
    alnum, alpha = F.length(F.regexp_replace(text, "[^A-Za-z0-9]", "")), F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    word = (kind == "signature") & (alpha >= 6) & (alpha / F.greatest(alnum, F.lit(1)) >= 0.85) & (conf >= 8.0)
    readable = ((kind == "faded_text") & (conf >= 70.0)) | ((alnum >= 4) & (conf >= 18.0)) | ((alnum >= 7) & (conf >= 12.0)) | word
    return F.coalesce(kind.isin(*VISUAL) & (text != "") & readable, F.lit(False))


def sparse_noise(kind: Column, ink: Column, area: Column, rows: Column, columns: Column, strict: bool = False) -> Column:
    """Whether a crop's ink pixels are too few or too scattered for a signature; strict: a share of just 0.004 passes."""
    share = ink / F.greatest(area, F.lit(1))
    faint = share < 0.004 if strict else share <= 0.004
    thin = (share < 0.010) & (rows < 0.35) & (columns < 0.35)
    return F.coalesce(kind.isin("signature", "text_anomaly") & ((ink == 0) | faint | thin | ((area > 1500) & (ink < 60))), F.lit(False))


def tsv_confidence(tsv: Column) -> Column:
    """Mean of the eleventh column of a recogniser's table where it is 0 or more; the header is left out; 0 without one."""
    cells = F.transform(F.slice(F.split(tsv, "\n"), 2, 2_000_000_000), lambda r: F.get(F.split(F.regexp_replace(r, r"^\s+|\s+$", ""), "\t"), F.lit(10)).try_cast("double"))
    kept = F.filter(cells, lambda c: c >= 0)
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, c: a + c) / F.size(kept)).otherwise(0.0)


def joined_value(values: Column) -> Column:
    """A list as text, nulls left out."""
    return F.coalesce(F.array_join(values, ", "), F.lit(""))


def payload_json(payload: Column) -> Column:
    """A struct or map as JSON; `{}` for null."""
    return F.coalesce(F.to_json(payload), F.lit("{}"))


def memory_thresholds(warning: Column, critical: Column, total: Column) -> Column:
    """struct(warning, critical) in GB: configured values, at least 85 and 90 percent of all, in this order."""
    w, c = F.greatest(warning, total * 0.85), F.greatest(critical, total * 0.90)
    return F.struct(w.alias("warning"), F.when(c <= w, w + 1.0).otherwise(c).alias("critical"))


def next_batch(size: Column, seconds: Column, fast: float, slow: float, step: int, low: int, high: int, failed: Column | None = None) -> Column:
    """The size of the next batch: a step up after a fast one, a step down after a slow one, half after a failure."""
    out = F.when(seconds < fast, F.least(size + step, F.lit(high))).when(seconds > slow, F.greatest(size - step, F.lit(low))).otherwise(size)
    return out if failed is None else F.when(failed, F.least(size, F.greatest(F.floor(size / 2), F.lit(low)))).otherwise(out)


def embedded_pdf(files: Column, query: str) -> Column:
    """The name of the first embedded PDF whose content holds the query in any case, else the first PDF by name; null if
    there is none."""
    pdf = F.filter(files, lambda f: F.lower(f["name"]).endswith(".pdf"))
    hit = F.filter(pdf, lambda f: F.contains(F.lower(f["content"]), F.lit(query.lower())))
    return F.coalesce(F.get(hit, F.lit(0))["name"], F.array_min(F.transform(pdf, lambda f: f["name"])))


def state_fields(document: dict[str, Column]) -> dict[str, Column]:
    """The fields of a document that its state row takes, with empty text, empty lists and 0 for what it lacks."""
    texts = ("smart_id", "category", "department", "purpose", "amount_found", "confidentiality")
    lists = ("key_names", "important_dates", "location_mentioned")
    none = F.lit(None)
    out = {k: F.coalesce(document.get(k, none).cast("string"), F.lit("")) for k in texts}
    out |= {k: F.coalesce(document.get(k, none.cast("array<string>")), F.array().cast("array<string>")) for k in lists}
    return out | {"tag_confidence": F.coalesce(document.get("tag_confidence", none).cast("double"), F.lit(0.0))}
