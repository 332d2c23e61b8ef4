"""Index documents from the extraction stage's JSON, whose fields may be texts, lists or missing.

The JSON is parsed once, into a variant; a text that is no JSON object gives no document.  Fields are read from the variant by
the type they have, so a list field that came as a separated text is split, and one of another type is empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.builders import MOST_EMBEDDED, embedded, embedded_text
from quire.functions.text import split_values, truncate

MOST_MAIN_CHARS, MOST_EMBEDDED_TEXT_CHARS = 500_000, 200_000
LISTS = {"dynamic_subtags": ",;|", "key_names": ",;", "important_dates": ",;", "location_mentioned": ",;"}
TEXTS = ("smart_id", "category", "department", "purpose", "amount_found", "confidentiality")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def suffix(path: Column) -> Column:
    """The lower-cased extension without its dot; a name's leading dots begin none."""
    return F.lower(F.regexp_extract(base_name(path), r"^\.*[^.].*\.([^.]+)$", 1))


def _kind(v: Column, field: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))


def _text(v: Column, field: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{field}", "string"), F.lit(""))


def _list(v: Column, field: str, separators: str) -> Column:
    """A list's elements as texts, or the parts of a text."""
    listed = F.try_variant_get(v, f"$.{field}", "array<string>")
    return F.when(_kind(v, field) == "STRING", split_values(_text(v, field), separators)).otherwise(F.coalesce(listed, F.array().cast("array<string>")))


def _embedded(v: Column) -> Column:
    """The first entries of the embedded files; a name may stand under either of two keys."""
    raw = F.slice(F.coalesce(F.try_variant_get(v, "$.embedded_files", "array<variant>"), F.array().cast("array<variant>")), 1, MOST_EMBEDDED)

    def entry(e: Column) -> Column:
        get = lambda k, t: F.try_variant_get(e, f"$.{k}", t)
        return F.struct(F.coalesce(get("name", "string"), get("resourceName", "string"), F.lit("")).alias("name"), F.coalesce(get("index", "int"), F.lit(0)).alias("index"), F.coalesce(get("content", "string"), F.lit("")).alias("content"))

    return embedded(F.transform(raw, entry))


def index_documents(rows: DataFrame, json: str, parents: DataFrame, at: Column, most_main: int = MOST_MAIN_CHARS, most_embedded: int = MOST_EMBEDDED_TEXT_CHARS) -> DataFrame:
    """rows without `json` and with a struct `document`, null where the text is no JSON object.

    parents(child_hash, parent_hash) tells the archive that a file came out of; of several parents the smallest.  A document
    without a hash has none and isn't shuffled for it.  A text longer than `most_main` is cut at a space and marked."""
    v, files = F.col("__v"), F.col("__files")
    main = truncate(_text(v, "main_content"), most_main)
    path = _text(v, "file_path")
    count = F.when(_kind(v, "embedded_count").isin("BIGINT", "INT"), F.try_variant_get(v, "$.embedded_count", "long"))
    fields = {
        "file_path": path, "file_name": base_name(path), "file_hash": _text(v, "file_hash"), "content_hash": _text(v, "content_hash"), "main_content": main["text"], "content_truncated": main["truncated"], "content_original_length": main["length"],
        "metadata": F.coalesce(F.try_variant_get(v, "$.metadata", "map<string,string>"), F.create_map().cast("map<string,string>")), "embedded_files": files, "embedded_count": F.coalesce(count, F.size(files).cast("long")),
        "needs_ocr": F.coalesce(F.try_variant_get(v, "$.needs_ocr", "boolean"), F.lit(False)), "ocr_completed": F.lit(False), "indexed_at": at, "extraction_time_ms": F.coalesce(F.try_variant_get(v, "$.extraction_time_ms", "double"), F.lit(0.0)),
        **{f: _text(v, f) for f in TEXTS}, **{f: _list(v, f, s) for f, s in LISTS.items()},
        "file_type": F.when(_text(v, "file_type") != "", _text(v, "file_type")).otherwise(suffix(path)), "file_size": F.try_variant_get(v, "$.file_size", "long"),
        "embedded_content": embedded_text(files, most_embedded), "ocr_content": F.lit(""), "ocr_confidence": F.lit(0.0),
    }
    parsed = rows.withColumn("__v", F.try_parse_json(F.col(json))).withColumn("__files", _embedded(v))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    built = parsed.select(*[c for c in rows.columns if c != json], F.when(is_object, F.struct(*[c.alias(k) for k, c in fields.items()])).alias("document"))
    hashed = F.nullif(F.col("document.file_hash"), F.lit(""))
    one = parents.where("child_hash is not null and child_hash <> ''").groupBy("child_hash").agg(F.min("parent_hash").alias("__parent"))
    keyed = built.withColumn("__hash", hashed)
    met = keyed.where("__hash is not null").join(one, F.col("__hash") == F.col("child_hash"), "left").drop("child_hash")
    out = met.unionByName(keyed.where("__hash is null").withColumn("__parent", F.lit(None).cast("string")))
    parent = F.coalesce("__parent", F.lit(""))
    with_parent = F.col("document").withField("parent_file", parent).withField("is_embedded", parent != "")
    return out.withColumn("document", F.when(F.col("document").isNotNull(), with_parent)).drop("__hash", "__parent")


def document_key(document: Column, file_id: Column) -> Column:
    """The key under which a document is indexed: its file's hash, its content's, or the file's number."""
    return F.coalesce(F.nullif(document["file_hash"], F.lit("")), F.nullif(document["content_hash"], F.lit("")), F.concat(F.lit("file-"), file_id.cast("string")))
