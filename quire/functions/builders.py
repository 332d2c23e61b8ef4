"""Fields of index documents and of metadata rows as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import values as V
from quire.functions.text import blank, let, norm, truncate

MOST_EMBEDDED, MOST_EMBEDDED_CHARS = 200, 5_000

#: The metadata fields that are kept of an extractor's answer, the fields a page count may stand in, in order.
METADATA_FIELDS = ("Content-Type", "Content-Length", "title", "Author", "creator", "producer", "Creation-Date", "modified", "Last-Modified", "page-count", "Page-Count", "xmpTPg:NPages", "meta:page-count")
PAGE_COUNTS = ("xmpTPg:NPages", "meta:page-count", "Page-Count", "page-count")

#: Words that tell the tags of a metadata row, in order; a field keeps its first value.
DERIVED = (
    (("invoice", "payment", "amount", "ledger", "account"), {"department": "Finance", "purpose": "Payment", "category": "Invoice"}),
    (("contract", "agreement", "clause", "legal", "compliance"), {"department": "Legal", "purpose": "Compliance", "category": "Contract"}),
    (("policy", "procedure", "guideline", "reference"), {"purpose": "Reference", "category": "Policy"}),
)
DERIVED_CONFIDENTIALITY = ((("confidential",), "Confidential"), (("internal", "restricted"), "Internal"), (("public",), "Public"))


def _any_word(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def embedded(files: Column) -> Column:
    """array of struct(name, index, content): at most 200 entries, contents over 5,000 characters cut and marked."""
    cut = lambda c: F.when(F.length(c) > MOST_EMBEDDED_CHARS, F.concat(F.substring(c, 1, MOST_EMBEDDED_CHARS), F.lit(" [truncated]"))).otherwise(F.coalesce(c, F.lit("")))
    return F.transform(F.slice(files, 1, MOST_EMBEDDED), lambda f: F.struct(F.coalesce(f["name"], F.lit("")).alias("name"), F.coalesce(f["index"], F.lit(0)).alias("index"), cut(f["content"]).alias("content")))


def embedded_text(files: Column, most: int) -> Column:
    """The contents of embedded files that aren't empty, joined by a blank line and cut at `most`."""
    return truncate(F.array_join(F.filter(F.transform(embedded(files), lambda f: f["content"]), lambda c: c != ""), "\n\n"), most)["text"]


def metadata(fields: Column) -> Column:
    """map of the kept fields of an extractor's map, renamed, with mime_type and page_count where they can be told."""
    value = lambda k: F.element_at(fields, k)
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    kept = {k.replace(":", "_").replace("-", "_").lower(): [] for k in METADATA_FIELDS}
    for k in METADATA_FIELDS:
        kept[k.replace(":", "_").replace("-", "_").lower()].append(value(k))
    filled = lambda v: F.when(F.coalesce(v, F.lit("")) != "", v)
    pages = F.coalesce(*[filled(value(k)) for k in PAGE_COUNTS])
    mime = F.trim(F.substring_index(F.coalesce(value("Content-Type"), F.lit("")), ";", 1))
    last = {k: F.coalesce(*[filled(v) for v in reversed(vs)]) for k, vs in kept.items()}
    last["page_count"] = F.coalesce(F.try_to_number(F.trim(pages), F.lit("999999999")).cast("int").cast("string"), last.get("page_count", F.lit(None)))
    last["mime_type"] = filled(mime)
    return F.map_from_entries(F.filter(F.array(*[entry(k, v) for k, v in last.items()]), lambda e: e["value"].isNotNull()))


def parse_bool(c: Column) -> Column:
    """Whether a cell says active: only 0, false, no, n and inactive say no."""
    return ~F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("0", "false", "no", "n", "inactive")


def derived_tags(text: Column) -> dict[str, Column]:
    """field -> tag told by words of a metadata row, null where none is."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out: dict[str, Column] = {}
    for field in ("department", "purpose", "category"):
        c = F.lit(None).cast("string")
        for words, tags in reversed(DERIVED):
            if field in tags:
                c = F.when(_any_word(low, words), tags[field]).otherwise(c)
        out[field] = c
    c = F.lit(None).cast("string")
    for words, tag in reversed(DERIVED_CONFIDENTIALITY):
        c = F.when(_any_word(low, words), tag).otherwise(c)
    return out | {"confidentiality": c}


def first_alias(values: dict[str, Column], aliases: tuple[str, ...]) -> Column:
    """The first alias's value that is no placeholder, null if there is none."""
    real = lambda c: F.when(~norm(c).isin("", *V.PLACEHOLDERS), c)
    return F.coalesce(*[real(values[a]) for a in aliases if a in values], F.lit(None).cast("string"))


def generic_accuracy(text: Column, size: Column) -> Column:
    """Bytes of the text as percent of the file's, 100 at most, two digits; 0 for an empty file."""
    share = F.octet_length(F.encode(F.coalesce(text, F.lit("")), "UTF-8")) / F.greatest(size, F.lit(1)) * 100
    return F.round(F.when(size > 0, F.least(share, F.lit(100.0))).otherwise(0.0), 2)


def office_accuracy(extracted: Column, paragraphs: Column, tables: Column, headers: Column, images: Column) -> Column:
    """struct(accuracy, text_area_pct) of a word-processor file from its counted characters and images; an image counts as
    60 characters of area."""
    def judge(total: Column) -> Column:
        area = F.when(total + images > 0, total / (total + images * 60) * 100).otherwise(100.0)
        accuracy = F.when(total > 0, F.least(extracted / total * 100, F.lit(100.0))).when(extracted == 0, 100.0).otherwise(0.0)
        return F.struct(F.round(accuracy, 2).alias("accuracy"), F.round(area, 2).alias("text_area_pct"))

    return let(paragraphs + tables + headers, judge)


def ocr_update(text: Column, confidence: Column, at: Column, most: int) -> Column:
    """The partial document of a recognised text."""
    return F.struct(truncate(text, most)["text"].alias("ocr_content"), confidence.alias("ocr_confidence"), F.lit(True).alias("ocr_completed"), at.alias("ocr_updated_at"))


def request_keys(smart_id: Column, key: Column, file_hash: Column, file_id: Column, name: Column, path: Column) -> Column:
    """struct of the keys by which a request is looked up."""
    own = F.coalesce(F.when(~blank(key), F.trim(key)), F.when(~blank(file_hash), file_hash), F.when(F.coalesce(file_id, F.lit(0)) != 0, F.concat(F.lit("file-"), file_id.cast("string"))), F.lit(""))
    base = F.when(~blank(name), name).otherwise(F.substring_index(F.coalesce(path, F.lit("")), "/", -1))
    return F.struct(F.trim(F.coalesce(smart_id, F.lit(""))).alias("smart_id"), own.alias("file_key"), base.alias("file_name"), F.coalesce(path, F.lit("")).alias("file_path"))
