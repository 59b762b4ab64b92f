"""The library tables: facets, taxonomy statistics, suggestions, listings, and changes as folds over versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def library_views(documents: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """files, meta and tags in the shape of the library, derived from the test tables."""
    files = documents.select("doc_id", F.sha1("text").alias("sha1"), F.concat(F.lit("/lib/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), "lang", "source", "n_chars")
    meta = labels.select("doc_id", F.concat(F.lit("q"), "quality").alias("category"), F.when(F.col("toxic") == 1, "skipped").when(F.col("doc_id") % 3 == 0, "read").otherwise("unread").alias("status"))
    tags = documents.select("doc_id", F.col("lang").alias("tag"), F.lit("user").alias("origin")).union(documents.select("doc_id", F.col("source").alias("tag"), F.lit("suggested").alias("origin")))
    return {"files": files, "meta": meta, "tags": tags}


def records(files: DataFrame, meta: DataFrame) -> DataFrame:
    """Files with category and status, empty where there is no meta row."""
    return files.join(meta, "doc_id", "left").fillna({"category": "", "status": "unread"})


def category_counts(meta: DataFrame) -> DataFrame:
    return meta.groupBy("category").agg(F.count("*").alias("n"))


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy(F.lower("tag").alias("tag_norm")).agg(F.count("*").alias("n"), F.min("tag").alias("label"))


def cooccurrence(meta: DataFrame, tags: DataFrame, origin: str = "user") -> DataFrame:
    return meta.join(tags.where(F.col("origin") == origin), "doc_id").groupBy("category", "tag").agg(F.count("*").alias("n"))


def category_cards(record: DataFrame, tags: DataFrame, top: int = 3) -> DataFrame:
    """Per category: documents, unread ones, characters, and the most frequent tags."""
    counts = record.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "unread").alias("unread"), F.sum("n_chars").alias("chars"))
    own = record.select("doc_id", "category").join(tags, "doc_id").groupBy("category", "tag").agg(F.count("*").alias("k"))
    ranked = own.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("k"), "tag"))).where(F.col("place") <= top)
    best = ranked.groupBy("category").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "tag"))), lambda r: r["tag"]), ",").alias("top_tags"))
    return counts.join(best, "category", "left")


def faceted(record: DataFrame, tags: DataFrame, category: str | None = None, status: str | None = None, tag: str | None = None, keyword: str | None = None) -> DataFrame:
    """Records that meet all given facets."""
    out = record
    if category is not None:
        out = out.where(F.col("category") == category)
    if status is not None:
        out = out.where(F.col("status") == status)
    if keyword:
        out = out.where(F.lower(F.concat_ws(" ", "path", "category")).contains(keyword.lower()))
    if tag is not None:
        out = out.join(tags.where(F.lower("tag") == tag.lower()).select("doc_id").distinct(), "doc_id", "left_semi")
    return out


def tag_lists(tags: DataFrame, key: str = "doc_id") -> DataFrame:
    """One comma-joined, case-insensitively sorted list of tags per key and origin."""
    ordered = F.sort_array(F.collect_set(F.struct(F.lower("tag").alias("low"), F.col("tag").alias("tag"))))
    return tags.groupBy(key, "origin").agg(F.array_join(F.transform(ordered, lambda r: r["tag"]), ",").alias("tags"))


#: So many phrases are looked for in each text; more are joined with the texts' runs of words.
FEW_PHRASES = 200


def phrase_hits(phrases: DataFrame, signals: DataFrame) -> DataFrame:
    """doc_id, signal, weight, label and phrase, once for each signal whose text (normalised) has the phrase as whole words."""
    signals = signals.where("text is not null")
    if phrases.count() <= FEW_PHRASES:
        stands = F.concat(F.lit(" "), "text", F.lit(" ")).contains(F.concat(F.lit(" "), "phrase", F.lit(" ")))
        return signals.join(F.broadcast(phrases), stands).select("doc_id", "signal", "weight", "label", "phrase")  # its number is checked
    longest = phrases.agg(F.max(F.size(F.split("phrase", " ")))).first()[0]
    # A column of its own, so that a text is split once and not for each of its words.
    said = signals.select("doc_id", "signal", "weight", F.split("text", " ").alias("said")).select("*", F.size("said").alias("n"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - k + 1, F.lit(1))), lambda i: F.array_join(F.slice("said", i, k), " "))))
    return said.select("doc_id", "signal", "weight", F.explode(F.array_distinct(runs)).alias("phrase")).join(phrases, "phrase").select("doc_id", "signal", "weight", "label", "phrase")


def suggestions(phrases: DataFrame, signals: DataFrame, tags: DataFrame, floor: float = 1.8, most: int = 6) -> DataFrame:
    """phrases: label, phrase.  signals: doc_id, signal, weight, text (normalised).  Labels whose phrases stand in
    a document's signals, scored weight * (.9 + .4 (words - 1)), without those the user has already; the best few."""
    words = F.size(F.split("phrase", " "))
    hit = phrase_hits(phrases, signals)
    scored = hit.groupBy("doc_id", "label").agg(F.round(F.sum(F.col("weight") * (0.9 + 0.4 * (words - 1))), 6).alias("score")).where(F.col("score") >= floor)
    fresh = scored.join(tags.where("origin = 'user'").select("doc_id", F.lower("tag").alias("label")), ["doc_id", "label"], "left_anti")
    return fresh.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "label"))).where(F.col("place") <= most)


def duplicates(files: DataFrame, key: str = "sha1") -> DataFrame:
    """Members of groups of equal keys, with the group's size and first path."""
    groups = files.groupBy(key).agg(F.count("*").alias("copies"), F.min("path").alias("first_path")).where("copies > 1")
    return files.join(groups, key)


def missing_outputs(stems: DataFrame, done: DataFrame, key: str = "stem") -> DataFrame:
    """Stems without an output (anti join)."""
    return stems.join(done.select(key).distinct(), key, "left_anti")


def upserted(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table after inserts or updates by key: the last change of a key wins, a null field of it keeps the old value."""
    last = changes.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_place = 1").drop("_place", order)
    fields = [c for c in table.columns if c not in keys]
    new = last.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    return table.join(new, keys, "full_outer").select(*keys, *[F.coalesce(f"_{f}", f).alias(f) for f in fields])


def deleted(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def archived(conversations: DataFrame, keep: int, group: str, order: list[Column]) -> DataFrame:
    """Marks rows beyond the newest `keep` of each group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return conversations.withColumn("archived", place > keep)


def keyset_page(messages: DataFrame, before: int, size: int, key: str = "id") -> DataFrame:
    """The `size` rows before a key in ascending order, and whether there are more."""
    size = min(max(size, 1), 200)
    page = messages.where(F.col(key) < before).orderBy(F.desc(key)).limit(size + 1)  # a page is the feature
    place = F.row_number().over(Window.orderBy(F.desc(key)))
    return page.withColumn("place", place).withColumn("has_more", F.count("*").over(Window.partitionBy()) > size).where(F.col("place") <= size).drop("place")
