"""Extraction measures of a file by its format: one struct for all formats, chosen by the extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.accuracy import pdf_accuracy
from quire.functions.builders import office_accuracy
from quire.functions.text import let

TEXT, STRUCTURED, MARKUP, WORDS, CELLS, PDF = ("txt", "csv", "md"), ("json", "xml"), ("html",), ("docx",), ("xlsx",), ("pdf",)
OVERHEAD = {"csv": 5.0, "md": 3.0}

#: What is counted in office files: columns of the struct `counts`, all numbers.
COUNTS = ("paragraph_chars", "table_chars", "header_chars", "images", "text_cells", "number_cells", "cells", "cell_chars", "pages")


def _percent(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1)) * 100


def _bytes(c: Column) -> Column:
    return F.octet_length(c)


def _measure(accuracy: Column, area: Column, raw: Column, read: Column, loss: dict[str, Column]) -> Column:
    """The struct: accuracy at most 100, two digits; loss as a map of texts; the page array is made from it."""
    entries = [x for k, v in loss.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(
        F.lit("text_extraction").alias("pipeline_type"), F.round(F.least(accuracy, F.lit(100.0)), 2).alias("extraction_accuracy"), F.round(area, 2).alias("text_area_pct"), F.round(100 - area, 2).alias("non_text_area_pct"),
        raw.cast("long").alias("raw_char_count"), read.cast("long").alias("processed_char_count"), F.create_map(*entries).alias("loss"),
    )


def tag_chars(markup: Column) -> Column:
    return F.length(markup) - F.length(F.regexp_replace(markup, "<[^>]+>", ""))


def plain(ext: Column, extracted: Column, size: Column) -> Column:
    over = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in OVERHEAD.items() for x in kv]), ext), F.lit(0.0))
    empty = size == 0
    return _measure(F.when(empty, 0.0).otherwise(_percent(_bytes(extracted), size)), F.when(empty, 0.0).otherwise(100.0 - over), F.length(extracted), F.length(extracted), {"syntax_overhead_pct": over, "format": ext})


def structured(ext: Column, extracted: Column, raw: Column) -> Column:
    """JSON's structural characters or XML's tags are no text; what is left is expected."""
    chars = F.when(ext == "json", F.length(F.regexp_replace(raw, r'[^{}\[\]",:]', ""))).otherwise(tag_chars(raw))

    def judge(n: Column) -> Column:
        over = _percent(n, F.length(raw))
        expected = F.length(raw) - F.floor(F.length(raw) * over / 100 + 1e-9)
        return _measure(F.when(raw == "", 0.0).otherwise(_percent(F.length(extracted), expected)), 100 - over, expected, F.length(extracted), {"syntax_overhead_pct": F.round(over, 2), "format": ext})

    return let(chars, judge)


def markup(extracted: Column, raw: Column) -> Column:
    images = F.regexp_count(F.lower(raw), F.lit("<img[^>]*>"))

    def judge(x: Column) -> Column:
        area = _percent(F.length(raw) - x["tags"], F.length(raw))
        return _measure(F.when(raw == "", 0.0).otherwise(_percent(F.length(extracted), x["expected"])), area, x["expected"], F.length(extracted), {"html_tags_pct": F.round(100 - area, 2), "embedded_images": images, "image_area_estimate_pct": F.least(images * 5.0, F.lit(25.0))})

    expected = F.length(F.trim(F.regexp_replace(F.regexp_replace(raw, "<[^>]+>", " "), r"\s+", " ")))
    return let(F.struct(tag_chars(raw).alias("tags"), expected.alias("expected")), judge)


def words_file(extracted: Column, counts: Column) -> Column:
    total = counts["paragraph_chars"] + counts["table_chars"] + counts["header_chars"]
    x = office_accuracy(F.length(extracted), counts["paragraph_chars"], counts["table_chars"], counts["header_chars"], counts["images"])
    return let(x, lambda o: _measure(o["accuracy"], o["text_area_pct"], total, F.length(extracted), {"images": counts["images"], "image_area_pct": F.round(100 - o["text_area_pct"], 2)}))


def cells_file(extracted: Column, counts: Column) -> Column:
    """A workbook: cells with text or numbers are text area; their characters are expected."""
    full = counts["text_cells"] + counts["number_cells"]
    empty = counts["cells"] - full
    loss = {"total_cells": counts["cells"], "text_cells": counts["text_cells"], "number_cells": counts["number_cells"], "empty_cells": empty, "empty_cell_pct": F.round(_percent(empty, counts["cells"]), 2)}
    return _measure(_percent(F.length(extracted), counts["cell_chars"]), _percent(full, counts["cells"]), counts["cell_chars"], F.length(extracted), loss)


def pdf_file(extracted: Column, counts: Column) -> Column:
    pages = F.greatest(counts["pages"], F.lit(1))
    per_page = F.length(extracted) / pages
    return let(pdf_accuracy(F.length(extracted), pages), lambda x: _measure(x["density"] * 100, x["area"], F.length(extracted), F.length(extracted), {"page_count": pages, "chars_per_page": F.round(per_page, 0), "text_density": F.round(x["density"], 4), "low_text_warning": per_page < 100}))


def generic(ext: Column, extracted: Column, size: Column) -> Column:
    share = F.when(size > 0, _percent(_bytes(extracted), size)).otherwise(0.0)
    return _measure(share, F.lit(95.0), F.length(extracted), F.length(extracted), {"format": ext, "method": F.lit("generic_byte_ratio")})


def measures(path: Column, extracted: Column, raw: Column, size: Column, counts: Column) -> Column:
    """The measures of a file: `raw` is its own text (structured text and markup), `counts` what was counted in it (COUNTS; null
    for other formats).  Null texts count as empty, a missing size as 0; office files that couldn't be opened (null counts)
    are judged by their bytes."""
    ext = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([^./\\]+)$", 1))
    text, own, bytes_ = F.coalesce(extracted, F.lit("")), F.coalesce(raw, F.lit("")), F.coalesce(size, F.lit(0))
    known = F.struct(*[F.coalesce(counts[c].cast("long"), F.lit(0)).alias(c) for c in COUNTS])
    opened = counts.isNotNull()
    return (
        F.when(ext.isin(*TEXT), plain(ext, text, bytes_)).when(ext.isin(*STRUCTURED), structured(ext, text, own)).when(ext.isin(*MARKUP), markup(text, own))
        .when(ext.isin(*WORDS) & opened, words_file(text, known)).when(ext.isin(*CELLS) & opened, cells_file(text, known)).when(ext.isin(*PDF), pdf_file(text, known)).otherwise(generic(ext, text, bytes_))
    )


def page_measures(measure: Column, path: Column) -> Column:
    """array of struct(page, text_area_pct, extraction_accuracy): one page, a PDF's pages alike, none for other formats."""
    ext = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([^./\\]+)$", 1))
    pages = F.when(ext.isin(*PDF), F.element_at(measure["loss"], "page_count").cast("int")).when(ext.isin(*TEXT, *STRUCTURED, *MARKUP, *WORDS, *CELLS), 1).otherwise(0)
    one = lambda p: F.struct(p.alias("page"), measure["text_area_pct"].alias("text_area_pct"), measure["extraction_accuracy"].alias("extraction_accuracy"))
    none = F.array().cast("array<struct<page: int, text_area_pct: double, extraction_accuracy: double>>")
    return F.when(pages > 0, F.transform(F.sequence(F.lit(1), pages), one)).otherwise(none)
