"""Extraction accuracy as arithmetic over text and counted columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def text_accuracy(text: Column, size: Column, ext: Column) -> Column:
    """Bytes of the text over the file's, at most 100, less the format's overhead (csv 5, md 3)."""
    over = F.when(ext == "csv", 5.0).when(ext == "md", 3.0).otherwise(0.0)
    share = F.least(F.octet_length(_text(text)) / size * 100, F.lit(100.0))
    return F.when(size > 0, F.greatest(share - over, F.lit(0.0))).otherwise(0.0)


def json_structure(text: Column) -> Column:
    """Percent of characters that are structure."""
    t = _text(text)
    return F.when(F.length(t) > 0, F.length(F.regexp_replace(t, r'[^{}\[\]",:]', "")) / F.length(t) * 100).otherwise(0.0)


def html_accuracy(html: Column) -> Column:
    """struct(tag_pct, image_pct, text_pct): shares of characters in tags, five points an image up to 25, the rest stripped."""
    h = _text(html)
    tags = F.length(h) - F.length(F.regexp_replace(h, "<[^>]+>", ""))
    stripped = F.length(F.trim(F.regexp_replace(F.regexp_replace(h, "<[^>]+>", " "), r"\s+", " ")))
    share = lambda x: F.when(F.length(h) > 0, x / F.length(h) * 100).otherwise(0.0)
    return F.struct(share(tags).alias("tag_pct"), F.least(F.regexp_count(F.lower(h), F.lit("<img")) * 5.0, F.lit(25.0)).alias("image_pct"), share(stripped).alias("text_pct"))


def pdf_accuracy(chars: Column, pages: Column, expected: float = 2500.0) -> Column:
    """struct(density, area): characters a page over the expected, and 85 times that as text area."""
    density = F.when(pages > 0, F.least(chars / pages / expected, F.lit(1.0))).otherwise(0.0)
    return F.struct(density.alias("density"), (density * 85.0).alias("area"))


def loss_breakdown(area: dict[str, Column], read: Column) -> Column:
    """Each zone's area times the share read; what is left goes to white space, never below zero."""
    got = {k: v * read for k, v in area.items()}
    total = sum(got.values(), F.lit(0.0))
    return F.struct(*[v.alias(k) for k, v in got.items()], F.greatest(100.0 - total, F.lit(0.0)).alias("whitespace"))


def total_chars(width: Column, height: Column, area_pct: Column) -> Column:
    return F.greatest(F.floor(width * height * area_pct / 100 / 420), F.lit(1))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes [x1, y1, x2, y2]."""
    side = lambda i: F.greatest(F.least(F.get(a, F.lit(i + 2)), F.get(b, F.lit(i + 2))) - F.greatest(F.get(a, F.lit(i)), F.get(b, F.lit(i))), F.lit(0.0))
    size = lambda x: (F.get(x, F.lit(2)) - F.get(x, F.lit(0))) * (F.get(x, F.lit(3)) - F.get(x, F.lit(1)))
    both = side(0) * side(1)
    return F.coalesce(F.try_divide(both, size(a) + size(b) - both), F.lit(0.0))


def normalised_box(box: Column, width: Column, height: Column) -> Column:
    """Box corners as shares of the page (2480 x 3508 if unknown), six decimals."""
    w, h = F.coalesce(width, F.lit(2480)), F.coalesce(height, F.lit(3508))
    return F.transform(box, lambda v, i: F.round(v / F.when(i % 2 == 0, w).otherwise(h), 6))


def padded_box(box: Column, width: Column, height: Column, share: float = 0.08) -> Column:
    """The box grown by a share of its sides, at least one pixel, within the page."""
    g = lambda i: F.get(box, F.lit(i))
    px, py = F.greatest(F.floor((g(2) - g(0)) * share), F.lit(1)), F.greatest(F.floor((g(3) - g(1)) * share), F.lit(1))
    return F.array(F.greatest(g(0) - px, F.lit(0)), F.greatest(g(1) - py, F.lit(0)), F.least(g(2) + px, width), F.least(g(3) + py, height))


def needs_ocr(content: Column, mime: Column, pages: Column, least: int = 100) -> Column:
    """Office files never; little text: PDFs and files with pages; else images."""
    m = F.lower(F.coalesce(mime, F.lit("")))
    office = m.rlike("word|excel|powerpoint|officedocument|msword|ms-")
    little = F.length(F.trim(_text(content))) < least
    return ~office & ((little & (m.contains("pdf") | (F.coalesce(pages, F.lit(0)) > 0))) | m.startswith("image/"))


def valid_ocr(text: Column, confidence: Column, target: Column) -> Column:
    """The reason why a recognised text is rejected, or ok."""
    t = _text(text)
    solid = F.length(F.regexp_replace(t, r"[ \n]", ""))
    alnum = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    return F.when(F.coalesce(confidence, F.lit(0.0)) < target, "low confidence").when(F.length(F.trim(t)) < 3, "too short").when(alnum / F.greatest(solid, F.lit(1)) < 0.5, "too few letters").otherwise("ok")


def bloom_size(n: Column, p: Column) -> Column:
    """struct(m, k): bits and hash functions of a Bloom filter."""
    ln2 = F.ln(F.lit(2.0))
    m = (-(n * F.ln(p)) / (ln2 * ln2)).cast("long")
    return F.struct(m.alias("m"), (m / n * ln2).cast("int").alias("k"))


def bloom_fpr(k: Column, n: Column, m: Column) -> Column:
    return F.pow(1 - F.exp(-k * n / m), k)


def enhancement_mode(brightness: Column, contrast: Column, sharpness: Column, quality: Column | None = None) -> Column:
    """How strongly an image is to be enhanced: by the quality score if there is one, else by what was measured."""
    measured = (
        F.when(contrast < 25, "EXTREME_RESTORE").when(contrast < 40, "AGGRESSIVE").when(sharpness < 80, "AGGRESSIVE").when(sharpness < 150, "BALANCED")
        .when((brightness < 60) | (brightness > 200), "AGGRESSIVE").when((brightness < 100) | (brightness > 160), "BALANCED").otherwise("LIGHT")
    )
    if quality is None:
        return measured
    scored = F.when(quality < 0.3, "EXTREME_RESTORE").when(quality < 0.5, "AGGRESSIVE").when(quality < 0.7, "BALANCED").otherwise("LIGHT")
    return F.when(quality.isNotNull(), scored).otherwise(measured)


def gamma(brightness: Column) -> Column:
    return F.when(brightness < 80, 0.85).when(brightness > 180, 1.15).otherwise(1.0)


def shares(parts: dict[str, Column], rest: str = "whitespace") -> Column:
    """Percentages scaled to 100; a page without any is all `rest`."""
    total = sum((F.coalesce(v, F.lit(0.0)) for v in parts.values()), F.lit(0.0))
    return F.struct(*[F.when(total > 0, F.coalesce(v, F.lit(0.0)) * 100 / total).otherwise(100.0 if k == rest else 0.0).alias(k) for k, v in parts.items()])
