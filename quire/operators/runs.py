"""Run modes, completions and failures by key, review logs, retries, accuracy back-fill and archives inside files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.measures import COUNTS, measures
from quire.functions.text import blank

#: Who may set the metadata source, weakest first.
SOURCE_ORDER = ("config", "api", "ui", "cli")

#: Extensions of archive members that are worth extraction; the most bytes of a member and of all members.
MEMBER_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".webp", ".svg", ".pdf", ".txt", ".html", ".htm", ".xml", ".csv", ".rtf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".tar", ".gz")
MOST_MEMBER, MOST_MEMBERS = 500 << 20, 1 << 30
MEMBERS = T.StructType([T.StructField(n, T.LongType() if n == "file_size" else T.StringType()) for n in ("parent_hash", "file_path", "file_name", "file_extension", "file_hash", "file_size")])

#: Fields of a document update in order, with the column type of those that aren't strings.
UPDATE_FIELDS = ("category", "department", "purpose", "file_type", "confidentiality", "metadata_level_code", "record_class_name", "record_category_name_functional", "record_category_name_transactional", "record_type_code", "business_unit_name", "sub_business_unit_name", "iso_country_code", "record_format_name", "original_record_location_type_name", "data_classification_name", "divestiture_deal_name", "dynamic_subtags", "key_names", "amount_found", "important_dates", "location_mentioned", "tagging_status", "review_required", "tagger_version", "taxonomy_version", "tag_confidence_overall", "tag_confidence_by_field", "tag_confidence", "metadata_mode", "metadata_source", "extended_metadata", "constraint_source", "forced_flag", "original_labels", "original_scores", "match_mode", "constraint_version")
FLAGS = ("review_required", "forced_flag")

MOST_PENDING_CHARS = 50_000

#: Kinds of entities that speak for a label.
ENTITY_KINDS = {"Finance": ("MONEY", "PERCENT"), "Legal": ("LAW",), "Compliance": ("LAW",)}


def folders_to_scan(folders: DataFrame, seen: DataFrame, mode: str) -> DataFrame:
    """Rows of folders(folder, mtime) whose files a run lists: all of a full run, which forgets what it has seen; in the
    modes resume and incremental those never seen or with another whole second of change than seen(folder, mtime)."""
    if mode not in ("full", "resume", "incremental"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "full":
        return folders
    before = seen.groupBy("folder").agg(F.max(F.col("mtime").cast("long")).alias("__before"))
    return folders.join(before, "folder", "left").where(F.col("__before").isNull() | (F.col("mtime").cast("long") != F.col("__before"))).drop("__before")


def sync_pending(queue: DataFrame, known: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(items to copy, the queue after it): pending items that the other queue lacks; all pending ones become `synced`."""
    pending = queue.where(F.col("status") == "pending")
    after = queue.withColumn("status", F.when(F.col("status") == "pending", "synced").otherwise(F.col("status")))
    return pending.join(known.select(key), key, "left_anti"), after


def completions(done: DataFrame) -> DataFrame:
    """One row per content of done(id, hash, size, at, extract_ms, index_ms, is_duplicate): its last completion, and the
    figures of its first, which alone are counted.  A blank hash gives way to the id; equal times go to the larger id."""
    key = F.when(blank(F.col("hash")), F.col("id").cast("string")).otherwise(F.col("hash"))
    when = F.struct("at", "id")
    last, first = F.max_by(F.struct("id", "size", "at"), when), F.min_by(F.struct("extract_ms", "index_ms", "is_duplicate"), when)
    rows = done.groupBy(key.alias("hash")).agg(last.alias("l"), first.alias("f"))
    positive = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    return rows.select("hash", "l.*", positive(F.col("f.extract_ms")).alias("extract_ms"), positive(F.col("f.index_ms")).alias("index_ms"), F.coalesce("f.is_duplicate", F.lit(False)).alias("is_duplicate"))


def completion_counters(done: DataFrame) -> DataFrame:
    """One row of counters: contents, their times and duplicates (see completions), and files with the bytes of each one's
    first completion."""
    by_hash = completions(done).agg(F.count("*").alias("completed"), F.sum("extract_ms").alias("extract_ms"), F.sum("index_ms").alias("index_ms"), F.count_if("is_duplicate").alias("duplicates"))
    by_file = done.groupBy("id").agg(F.min_by("size", F.struct("at", "size")).alias("size")).agg(F.count("*").alias("files"), F.sum(F.when(F.col("size") > 0, F.col("size"))).alias("bytes"))
    return by_hash.crossJoin(F.broadcast(by_file))  # one row each


def last_failures(failed: DataFrame) -> DataFrame:
    """The last failure of each file of failed(id, at, stage, error, retries), and how often the file failed with each error in
    all.  Of failures at one time the largest error counts."""
    one = failed.groupBy("id", "error").agg(F.max(F.struct("at", "stage", "retries")).alias("x"), F.count("*").alias("times"))
    return one.groupBy("id").agg(F.max_by(F.struct("error", "x"), F.struct(F.col("x.at"), "error")).alias("y"), F.sum("times").alias("failures")).select("id", "failures", "y.error", "y.x.*")


def suppression_rows(snippets: DataFrame, by: Column, at: Column) -> DataFrame:
    """Suppression log of snippets(smart_id, page, box, kind, impact)."""
    return snippets.select("smart_id", F.col("page").alias("page_num"), F.to_json("box").alias("bbox_json"), by.alias("suppressed_by"), F.col("kind").alias("snippet_type"), F.coalesce(F.col("impact").cast("double"), F.lit(0.0)).alias("accuracy_impact"), at.alias("suppressed_at"))


def retry_rows(updates: DataFrame, at: Column) -> DataFrame:
    """Retry queue of updates(smart_id, review_id, payload) that the index refused: pending, never tried."""
    return updates.select("smart_id", "review_id", "payload", F.lit("pending").alias("status"), F.lit(0).alias("attempt_count"), at.alias("created_at"))


def purge_row(files: DataFrame, days: int, at: Column) -> DataFrame:
    """The log row of a purge of files(size), none if there are no files."""
    n = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).where("n > 0")
    reason = F.format_string(f"Purged %d snippet files older than {days} days, freed %.2f MB", "n", F.col("bytes") / F.lit(float(1 << 20)))
    fixed = {"review_id": "system_purge", "smart_id": "system", "action": "snippet_purged", "actor": "System"}
    return n.select(*[F.lit(v).alias(k) for k, v in fixed.items()], reason.alias("reason"), at.alias("timestamp"), F.lit("all").alias("snippet_type"), F.lit("system_cleanup").alias("file_name"))


def accuracy_backfill(state: DataFrame) -> DataFrame:
    """Rows of state(file_key, file_path, file_type, file_size, extraction_accuracy) without accuracy, with `source`: read the
    text itself, or take half (new office files) or a third of the size (old ones and PDF) as its length in `chars`; rows
    without a path are skipped."""
    ext = F.lower(F.regexp_extract(F.coalesce("file_path", F.lit("")), r"(\.[^./\\]+)$", 1))
    part = F.when(ext.isin(".docx", ".xlsx"), 2).when(ext.isin(".pdf", ".doc", ".xls", ".ppt", ".pptx", ".rtf"), 3)
    lacking = state.where(F.coalesce("extraction_accuracy", F.lit(0.0)) == 0)
    source = F.when(blank(F.col("file_path")), "skip").when(part.isNull(), "text").otherwise("size")
    return lacking.withColumns({"source": source, "chars": F.when(source == "size", F.greatest(F.lit(1), F.floor(F.col("file_size") / part)))})


def recomputed_accuracy(state: DataFrame, texts: DataFrame) -> DataFrame:
    """file_key and the measures of the rows that lack an accuracy: texts(file_path, text) has what can be read of a file itself;
    of the rest the length is taken from the size (see accuracy_backfill).  Files without a path or a text are left out."""
    todo = accuracy_backfill(state).where("source <> 'skip'").join(texts.select("file_path", "text"), "file_path", "left")
    text = F.when(F.col("source") == "size", F.repeat(F.lit("x"), F.col("chars").cast("int"))).otherwise(F.col("text"))
    none = F.lit(None).cast("struct<" + ", ".join(f"{c}: long" for c in COUNTS) + ">")
    ready = todo.withColumn("__t", text).where("__t is not null")
    return ready.select("file_key", measures(F.col("file_path"), F.col("__t"), F.col("__t"), F.col("file_size"), none).alias("m")).select("file_key", "m.*")


def flush_updates(pending: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updates of pending(doc_id, ocr_content, ocr_confidence) that go to the index, those that wait for their document).
    Rows without an id go; what waits keeps 50,000 characters."""
    named = pending.where(~blank(F.col("doc_id")))
    known = index.select("doc_id").distinct()
    return named.join(known, "doc_id", "left_semi"), named.join(known, "doc_id", "left_anti").withColumn("ocr_content", F.substring("ocr_content", 1, MOST_PENDING_CHARS))


def document_update(tags: DataFrame, key: str) -> DataFrame:
    """The key and the fields of a document update in their order; columns that the table lacks are null strings, flags
    false, confidences 0."""

    def field(name: str) -> Column:
        source = "tag_confidence_overall" if name == "tag_confidence" else name
        c = F.col(source) if source in tags.columns else F.lit(None).cast("string")
        if name in FLAGS:
            return F.coalesce(c.cast("boolean"), F.lit(False))
        return F.coalesce(c.cast("double"), F.lit(0.0)) if source == "tag_confidence_overall" else c

    return tags.select(key, *[field(f).alias(f) for f in UPDATE_FIELDS])


def may_replace(current: str | None, new: str, force: bool = False) -> bool:
    """Whether a metadata source may take the place of the current one: it must be known and not weaker."""
    if new not in SOURCE_ORDER:
        return False
    return force or current not in SOURCE_ORDER or SOURCE_ORDER.index(current) <= SOURCE_ORDER.index(new)


def only_row(docs: DataFrame, rows: DataFrame, name: str = "metadata") -> DataFrame:
    """docs with a struct of the metadata row where there is just one, which then holds for all; else null."""
    one = rows.limit(2).agg(F.count("*").alias("__n"), F.first(F.struct(*rows.columns)).alias("__row"))
    return docs.crossJoin(F.broadcast(one)).withColumn(name, F.when(F.col("__n") == 1, F.col("__row"))).drop("__n", "__row")  # one row


def find_document(docs: DataFrame, key: str, value):  # noqa: ANN001, ANN201
    """The row of a key, KeyError if there is none; the filter reaches the scan."""
    found = docs.where(F.col(key) == value).take(1)
    if not found:
        raise KeyError(value)
    return found[0]


def evidence_points(label: Column, semantic: Column, chunks: Column, entities: Column, model: bool = True) -> Column:
    """Points that a language model's figures give a label: similarity x 0.30 (0.20 without a model), 0.08 a near phrase up
    to 0.25, 0.10 a kind of entity that speaks for it up to 0.20.  The figures are columns: any model can supply them."""
    close = F.greatest(F.coalesce(semantic, F.lit(0.0)), F.lit(0.0)) * (0.30 if model else 0.20)
    if not model:
        return close
    kinds = F.lit(0)
    for name, known in ENTITY_KINDS.items():
        kinds = F.when(label == name, F.size(F.array_intersect(F.coalesce(entities, F.array().cast("array<string>")), F.array(*[F.lit(k) for k in known])))).otherwise(kinds)
    return close + F.least(F.coalesce(chunks, F.lit(0)) * 0.08, F.lit(0.25)) + F.least(kinds * 0.10, F.lit(0.20))


def archive_members(files: DataFrame) -> DataFrame:
    """Members of the archives among files(path, content, file_hash) that are worth extraction, as new files with their
    parent's hash.

    Folders and other extensions are left out, members over 500 MB are skipped, and a parent ends at 1 GB in all.  Members
    are read in pieces for their SHA-256, never held whole; broken archives give what was read until then."""
    return files.select("path", "content", "file_hash").mapInPandas(_walk, MEMBERS)


def _walk(batches: Iterator) -> Iterator:
    import pandas as pd

    for batch in batches:
        for path, content, parent in zip(batch["path"], batch["content"], batch["file_hash"], strict=True):
            if rows := list(_members(path, content, parent)):
                yield pd.DataFrame(rows, columns=MEMBERS.names)


def _members(path: str, content: bytes | None, parent: str) -> Iterator[tuple]:
    import hashlib
    import io
    import zipfile
    import zlib

    if not content or not zipfile.is_zipfile(io.BytesIO(content)):
        return
    total = 0
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for info in archive.infolist():
                name = info.filename.replace("\\", "/").rsplit("/", 1)[-1]
                extension = f".{name.rsplit('.', 1)[-1].lower()}" if "." in name.lstrip(".") else ""
                if info.is_dir() or extension not in MEMBER_EXTENSIONS or info.file_size > MOST_MEMBER:
                    continue
                if total + info.file_size > MOST_MEMBERS:
                    break
                digest = hashlib.sha256()
                with archive.open(info) as member:
                    while piece := member.read(1 << 16):
                        digest.update(piece)
                total += info.file_size
                yield parent, f"{path}!/{info.filename}", name, extension.lstrip("."), digest.hexdigest(), info.file_size
    except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError):
        return
