"""Transitions of queued work, completions, pages of state and review accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import blank


def enqueue(queue: DataFrame, items: DataFrame, key: str = "id") -> DataFrame:
    """The queue with the items it lacks, pending."""
    new = items.join(queue.select(key), key, "left_anti")
    cols = [F.col(c) if c in items.columns else F.lit(v).cast(queue.schema[c].dataType).alias(c) for c, v in ((c, "pending" if c == "status" else 0 if c == "retry_count" else None) for c in queue.columns)]
    return queue.unionByName(new.select(*cols))


def transition(queue: DataFrame, moves: DataFrame, key: str = "id", retry: bool = True) -> DataFrame:
    """The queue after moves(key, to): completed keeps its claim, pending and failed lose it, and a return to pending counts as
    a retry.  Of several moves of an item the largest (pending, then failed, then completed) counts."""
    rank = F.when(F.col("to") == "completed", 0).when(F.col("to") == "failed", 1).otherwise(2)
    last = moves.groupBy(key).agg(F.max_by("to", rank).alias("__to"))
    out = queue.join(last, key, "left")
    back = F.col("__to").isin("pending", "failed")
    step = {"status": F.coalesce("__to", "status"), "claimed_at": F.when(~F.coalesce(back, F.lit(False)), F.col("claimed_at"))}
    if retry and "retry_count" in queue.columns:
        step["retry_count"] = F.col("retry_count") + F.coalesce((F.col("__to") == "pending").cast("int"), F.lit(0))
    return out.withColumns(step).select(*queue.columns)


def completed_rows(done: DataFrame, files: DataFrame, key: str = "id") -> DataFrame:
    """Completed rows of done(key, took_ms) with their file's columns, never a duplicate and without a content hash."""
    return done.join(files, key).withColumns({"is_duplicate": F.lit(False), "content_hash": F.lit(None).cast("string")})


def first_completions(done: DataFrame, key: str, order: str) -> DataFrame:
    """The first completion of each key, as later ones count for nothing."""
    cols = [c for c in done.columns if c != key]
    return done.groupBy(key).agg(F.min(F.struct(F.col(order).alias("__o"), *[F.col(c) for c in cols])).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in cols])


def discovery_complete(files: DataFrame, flags: DataFrame) -> DataFrame:
    """One row, complete: a forced run is not; else the completion flag, else some files and none of them pending.

    flags(key, value) holds discovery_force_run and discovery_complete as '1'."""
    on = lambda k: F.coalesce(F.bool_or((F.col("key") == k) & (F.col("value") == "1")), F.lit(False))
    f = flags.agg(on("discovery_force_run").alias("forced"), on("discovery_complete").alias("flagged"))
    n = files.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "pending").alias("pending"))
    return f.crossJoin(F.broadcast(n)).select((~F.col("forced") & (F.col("flagged") | ((F.col("n") > 0) & (F.col("pending") == 0)))).alias("complete"))  # one row each


def work_complete(queues: DataFrame) -> DataFrame:
    """One row, complete: whether no item of queues(queue, status) is pending or processing."""
    return queues.agg((F.count_if(F.col("status").isin("pending", "processing")) == 0).alias("complete"))


def worker_pools(workers: DataFrame, name: str) -> DataFrame:
    """pool, workers: a worker's name up to its last dash; all extraction pools are one."""
    prefix = F.regexp_replace(F.col(name), "-[^-]*$", "")
    return workers.groupBy(F.when(F.startswith(prefix, F.lit("extraction")), "extraction").otherwise(prefix).alias("pool")).agg(F.count("*").alias("workers"))


def page(df: DataFrame, order: list[Column], size: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(size)


def summary(counts: DataFrame) -> DataFrame:
    """stage, pending, processing, completed, failed, total of counts(stage, status, n); the total is the first three."""
    of = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(s)
    return counts.groupBy("stage").agg(of("pending"), of("processing"), of("completed"), of("failed")).withColumn("total", F.col("pending") + F.col("processing") + F.col("completed"))


def first_candidate(wanted: DataFrame, docs: DataFrame, candidates: list[Column], key: str, doc_key: str) -> DataFrame:
    """Each wanted row with the document of its first candidate id that exists, null if none does."""
    tried = wanted.select(key, F.posexplode(F.array(*candidates)).alias("i", "__id"))
    found = tried.join(docs.select(F.col(doc_key).alias("__id")), "__id").groupBy(key).agg(F.min_by("__id", "i").alias("found"))
    return wanted.select(key).join(found, key, "left")


def with_parents(docs: DataFrame, lineage: DataFrame, key: str) -> DataFrame:
    """docs with parent and is_embedded from lineage(child, parent), one row a child."""
    out = docs.join(lineage.withColumnRenamed("child", key), key, "left")
    return out.withColumns({"is_embedded": F.col("parent").isNotNull(), "parent": F.coalesce("parent", F.lit(""))})


def validated(rows: DataFrame, column: str, registry: DataFrame, default: str) -> DataFrame:
    """rows with empty values of the column defaulted and a warning where it isn't in registry(value), case aside."""
    value = F.when(F.lower(F.trim(F.coalesce(column, F.lit("")))).isin("", "nan", "none"), default).otherwise(F.col(column))
    known = registry.select(F.lower("value").alias("__k")).distinct().withColumn("__known", F.lit(True))
    out = rows.withColumn(column, value)
    out = out.join(known, F.lower(column) == F.col("__k"), "left")
    return out.withColumn("warning", F.when(F.col("__known").isNull(), F.concat(F.lit(f"{column} not allowed: "), F.col(column)))).drop("__k", "__known")


# reviews


def reviews_with_state(reviews: DataFrame, state: DataFrame, doc: Column | None = None) -> DataFrame:
    """Reviews of known documents with their state, in order of page and review; of one document if given."""
    out = reviews.join(state, "doc_id")
    return (out if doc is None else out.where(F.col("doc_id") == doc)).orderBy("doc_id", "page", "review_id")


def storage(reviews: DataFrame, state: DataFrame) -> DataFrame:
    """Each document's reviews by status, whether its state is known or not."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    by = reviews.groupBy("doc_id").agg(n("pending"), n("accepted"), n("rejected"))
    return by.join(state.select("doc_id", "file_name"), "doc_id", "left")


def purgeable(reviews: DataFrame, cutoff: str) -> DataFrame:
    """Decided reviews from before the cutoff, whose time may end in Z or not."""
    at = F.col("reviewed_at")
    return reviews.where(F.col("status").isin("accepted", "rejected") & ((at < f"{cutoff}Z") | (F.replace(at, F.lit("Z"), F.lit("")) < cutoff)))


def without_lost_crops(reviews: DataFrame, files: DataFrame) -> DataFrame:
    """Reviews without the pending ones whose crop is no longer among files(path)."""
    there = files.select(F.col("path").alias("snippet_path"), F.lit(True).alias("__there")).distinct()
    return reviews.join(there, "snippet_path", "left").where((F.col("status") != "pending") | F.col("__there")).drop("__there")


def acceptable(category: Column, transcription: Column) -> Column:
    """Whether an acceptance is complete: faded text wants its transcription."""
    return (F.coalesce(category, F.lit("")) != "faded_text") | ~blank(transcription)


def breakdown(pages: DataFrame, losses: dict[str, str]) -> DataFrame:
    """doc_id, page and seven shares: those of the document's losses, or, if all are zero, from the page's areas and accuracy.

    losses: share -> column of pages; pages also has text_area, non_text_area and accuracy (percent)."""
    known = {k: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for k, c in losses.items()}
    none = F.lit(True)
    for c in known.values():
        none = none & (c == 0)
    text, other = F.coalesce("text_area", F.lit(0.0)), F.coalesce("non_text_area", F.lit(0.0))
    share = F.when(F.coalesce("accuracy", F.lit(0.0)) == 0, 100.0).otherwise(F.col("accuracy")) / 100
    derived = {"clean": text * share, "faded": text * (1 - share), "logo": other * 0.3, "stamp": other * 0.3, "handwritten": other * 0.2, "whitespace": F.greatest(F.lit(0.0), 100 - text - other), "noise": other * 0.2}
    return pages.select("doc_id", "page", *[F.when(none, d).otherwise(known[k]).alias(k) for k, d in derived.items()])


BARS = ("clean", "whitespace", "faded", "logo", "stamp", "handwritten", "noise")
#: The snippet types that stand for a bar.
SNIPPETS_OF = {"faded": ("faded_text",), "logo": ("logo",), "stamp": ("stamp",), "handwritten": ("handwritten", "signature"), "noise": ("text_anomaly",)}


def waterfall(pages: DataFrame, reviews: DataFrame) -> DataFrame:
    """doc_id, bar, value, bottom: the mean composition of a document's pages; a bar that has snippets is the sum of its
    pending impacts, accepted impacts count as clean, all is scaled to 100, and each bar stands on those before it."""
    mean = pages.groupBy("doc_id").agg(*[F.avg(F.coalesce(b, F.lit(0.0))).alias(b) for b in BARS])
    impact = lambda s, t=None: F.coalesce(F.sum(F.when((F.col("status") == s) & (F.col("snippet_type").isin(*t) if t else F.lit(True)), F.col("impact"))), F.lit(0.0))
    sums = reviews.groupBy("doc_id").agg(impact("accepted").alias("__accepted"), *[F.struct((F.count_if(F.col("snippet_type").isin(*t)) > 0).alias("has"), impact("pending", t).alias("sum")).alias(f"__{b}") for b, t in SNIPPETS_OF.items()])
    j = mean.join(sums, "doc_id", "left")
    value = {"clean": F.col("clean") + F.coalesce("__accepted", F.lit(0.0)), "whitespace": F.col("whitespace")}
    value |= {b: F.when(F.coalesce(F.col(f"__{b}.has"), F.lit(False)), F.col(f"__{b}.sum")).otherwise(F.col(b)) for b in SNIPPETS_OF}
    j = j.select("doc_id", *[value[b].alias(b) for b in BARS])
    total = sum((F.col(b) for b in BARS), F.lit(0.0))
    scaled = [F.struct(F.lit(i).alias("i"), F.lit(b).alias("bar"), F.when(F.col("__t") > 0, F.col(b) * 100 / F.col("__t")).otherwise(100.0 if b == "whitespace" else 0.0).alias("value")) for i, b in enumerate(BARS)]
    rows = j.withColumn("__t", total).select("doc_id", F.explode(F.array(*scaled)).alias("x")).select("doc_id", "x.*").where("value > 0.001")
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)  # at most seven rows a document
    return rows.withColumn("bottom", F.least(F.lit(100.0), F.coalesce(F.sum("value").over(w), F.lit(0.0)))).drop("i")


def last_wins(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the largest `seq` of each key."""
    cols = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(F.col(seq).alias("__s"), *[F.col(c) for c in cols])).alias("x")).select(*keys, *[F.col(f"x.{c}").alias(c) for c in cols])


# search filters and metadata rows


def multiselect(docs: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    """Documents with one of the chosen values in every column that has a choice."""
    for c, values in chosen.items():
        if values:
            docs = docs.where(F.col(c).isin(values))
    return docs


def roots(docs: DataFrame) -> DataFrame:
    return docs.where(~F.coalesce(F.col("is_embedded"), F.lit(False)))


def tagged(docs: DataFrame, column: str = "category") -> DataFrame:
    """Documents that have a category; an empty one is one."""
    return docs.where(F.col(column).isNotNull())


def by_overlap(docs: DataFrame, rows: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, row, overlap: the metadata row that shares most words with a document, `least` or more; the first of equals.

    docs(doc_id, words) and rows(row, words) meet on words, so only pairs that share one are looked at."""
    a = docs.select("doc_id", F.explode(F.array_distinct("words")).alias("w"))
    b = rows.select("row", F.explode(F.array_distinct("words")).alias("w"))
    met = a.join(b, "w").groupBy("doc_id", "row").agg(F.count("*").alias("overlap")).where(F.col("overlap") >= least)
    return met.groupBy("doc_id").agg(F.max(F.struct("overlap", (-F.col("row")).alias("r"))).alias("x")).select("doc_id", (-F.col("x.r")).alias("row"), "x.overlap")


def canonical(rows: DataFrame, column: str, aliases: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with `canonical`: the label of the value's alias, else the active label that equals it, else empty.

    aliases(alias, label) and labels(label, active) meet the values on their normalised form."""
    from quire.functions.text import norm

    a = aliases.groupBy(norm(F.col("alias")).alias("__k")).agg(F.min("label").alias("__a"))
    b = labels.where("active").groupBy(norm(F.col("label")).alias("__k")).agg(F.min("label").alias("__b"))
    out = rows.withColumn("__k", norm(F.col(column))).join(a, "__k", "left").join(b, "__k", "left")
    return out.withColumn("canonical", F.when(F.col("__k") == "", "").otherwise(F.coalesce("__a", "__b", F.lit("")))).drop("__k", "__a", "__b")


MOST_LITERALS = 500  # names that stand in an expression; more of them are a table


def deals(docs: DataFrame, names: DataFrame, text: str, most: int = 3) -> DataFrame:
    """doc_id, deals: the registered names that stand as words in a text, by name, at most three.

    Names of up to MOST_BYTES together go to every worker as one automaton, which reads each text once; beyond that, words of
    the texts meet the first words of names(name), and only those pairs are searched."""
    from quire.functions.automaton import MOST_BYTES, Phrases
    from quire.functions.text import EDGE_LEFT, EDGE_RIGHT

    n = names.where(F.length("name") >= 2)
    if (n.agg(F.sum(F.octet_length("name"))).first()[0] or 0) <= MOST_BYTES // 2:
        spelled: dict[str, list[str]] = {}
        for r in n.select("name").distinct().collect():
            spelled.setdefault(r["name"].lower(), []).append(r["name"])
        phrases = Phrases(list(spelled), str.lower)
        own = F.array(*[F.array(*[F.lit(x) for x in sorted(spelled[p])]) for p in phrases.all]) if len(phrases.all) <= MOST_LITERALS else None
        found = docs.select("doc_id", phrases.prepare(F.lower(F.coalesce(text, F.lit("")))).alias("p"))
        if own is not None:
            said = F.flatten(F.transform("p", lambda i: F.get(own, i)))
            return found.select("doc_id", F.array_join(F.slice(F.array_sort(F.array_distinct(said)), 1, most), ", ").alias("deals"))
        table = docs.sparkSession.createDataFrame([(phrases.number[k], x) for k, v in spelled.items() for x in v], "i int, name string")
        hits = found.select("doc_id", F.explode("p").alias("i")).join(table, "i").groupBy("doc_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, most), ", ").alias("deals"))
        return docs.select("doc_id").join(hits, "doc_id", "left").select("doc_id", F.coalesce("deals", F.lit("")).alias("deals"))

    first = lambda c: F.regexp_extract(F.lower(c), r"([\p{L}\p{N}_]+)", 1)
    n = n.select("name", first(F.col("name")).alias("w"))
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("w"))
    pairs = words.join(n, "w").select("doc_id", "name").distinct().join(docs.select("doc_id", F.lower(text).alias("__t")), "doc_id")
    edge = F.concat(F.lit(EDGE_LEFT), F.regexp_replace(F.lower("name"), r"([^\p{L}\p{N}_ ])", r"\\$1"), F.lit(EDGE_RIGHT))
    hits = pairs.where(F.regexp_like("__t", edge)).groupBy("doc_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, most), ", ").alias("deals"))
    return docs.select("doc_id").join(hits, "doc_id", "left").select("doc_id", F.coalesce("deals", F.lit("")).alias("deals"))
