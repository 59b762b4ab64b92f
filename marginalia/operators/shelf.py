"""Changes of conversations, projects and renders as folds over event tables, and lists of cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The title that a conversation has until it gets one, and its longest title.
DEFAULT_TITLE, TITLE_CHARS = "新对话", 80


def epoch(x: Column | str) -> Column:
    """A timestamp of float seconds since 1970, to the microsecond."""
    return F.timestamp_micros(F.round((F.col(x) if isinstance(x, str) else x) * 1_000_000).cast("long"))


def is_fresh(cached_at: Column, now: Column, seconds: Column) -> Column:
    """Whether a cached row is still good; lifetimes are held between 0 and 30 seconds, a null one is 6."""
    life = F.least(F.greatest(F.coalesce(seconds, F.lit(6.0)), F.lit(0.0)), F.lit(30.0))
    return (now.cast("double") - cached_at.cast("double")) <= life


def conversations(events: DataFrame) -> DataFrame:
    """events: conv_id, kind (create, retitle, touch, archive, delete), title, project and at.  The conversations that are left: title (the first
    one given after the default), project, created, updated, archived.  A deleted one comes back only by a later create."""
    seen = F.max(F.when(F.col("kind") == "delete", F.col("at"))).over(Window.partitionBy("conv_id"))
    alive = events.withColumn("_gone", seen).where("_gone is null or at > _gone")
    title = F.substring(F.trim(F.regexp_replace("title", "\n", " ")), 1, TITLE_CHARS)
    named = F.when(F.col("kind").isin("create", "retitle") & (title != "") & (title != DEFAULT_TITLE), F.struct("at", title.alias("title")))
    active = F.col("kind").isin("create", "retitle", "touch")
    out = alive.groupBy("conv_id").agg(
        F.min(F.when(F.col("kind") == "create", F.col("at"))).alias("created"), F.max(F.when(active, F.col("at"))).alias("updated"), F.max(F.when(F.col("kind") == "archive", F.col("at"))).alias("_archived"),
        F.coalesce(F.min(named)["title"], F.lit(DEFAULT_TITLE)).alias("title"), F.max(F.when(F.col("kind") == "create", F.struct("at", "project")))["project"].alias("project"),
    )
    return out.where("created is not null").withColumn("archived", F.coalesce(F.col("_archived") > F.col("updated"), F.lit(False))).drop("_archived")


def projects(events: DataFrame, conversation: DataFrame) -> tuple[DataFrame, DataFrame]:
    """events: project, kind (create, rename, delete), name and at.  The projects that are left with their last name, and the conversations, without the
    project where it was deleted."""
    last = events.groupBy("project").agg(F.max(F.struct("at", "kind"))["kind"].alias("kind"), F.max(F.when((F.col("kind") != "delete") & (F.trim("name") != ""), F.struct("at", "name")))["name"].alias("name"))
    gone = last.where("kind = 'delete'").select("project", F.lit(True).alias("_gone"))
    left = conversation.join(gone, "project", "left")
    return last.where("kind <> 'delete'").select("project", "name"), left.withColumn("project", F.when(F.col("_gone").isNull(), F.col("project"))).drop("_gone")


def rendered(refs: DataFrame, changes: DataFrame) -> DataFrame:
    """refs: msg_id, sig, status, attempts.  changes: msg_id, sig, expected_sig, status, attempts and at, null where a field stays.  A change
    counts only for a row that is there and if it expects that row's signature (or none); of those the last value of each field wins."""
    fields = ("sig", "status", "attempts")
    own = refs.select("msg_id", *[F.col(f).alias(f"_{f}") for f in fields])
    fit = changes.join(own.select("msg_id", "_sig"), "msg_id").where("expected_sig is null or expected_sig = _sig")
    last = fit.groupBy("msg_id").agg(*[F.max(F.when(F.col(f).isNotNull(), F.struct("at", f)))[f].alias(f) for f in fields])
    out = own.join(last, "msg_id", "left").select("msg_id", *[F.coalesce(f, f"_{f}").alias(f) for f in fields])
    return out.withColumns({"status": F.coalesce("status", F.lit("")), "attempts": F.greatest(F.coalesce("attempts", F.lit(0)), F.lit(0))})


def ensured(records: DataFrame, files: DataFrame) -> DataFrame:
    """records with a row for each file whose content hash it lacks, the first path of each."""
    new = files.groupBy("sha1").agg(F.min("path").alias("path")).join(records.select("sha1"), "sha1", "left_anti")
    return records.unionByName(new, allowMissingColumns=True)


def force_kept(state: Column, explicit: Column, anchor_kind: Column, anchor_score: Column) -> Column:
    """A hit that no filter drops: pending, named by the prompt, or at an anchor that the prompt asks for."""
    return (F.lower(F.coalesce(state, F.lit(""))) == "pending") | (F.coalesce(explicit, F.lit(0.0)) >= 6) | ((F.coalesce(anchor_kind, F.lit("")) != "") & (F.coalesce(anchor_score, F.lit(0.0)) > 0))


def only_negated(term: str, surface: Column) -> Column:
    """Whether every place of a term (in lower case) stands up to six words behind a negation."""
    negation = "(?:without|not|no|never|instead\\s+of|rather\\s+than|free\\s+of|excluding|exclude(?:s|d|ing)?|avoid(?:s|ed|ing)?|omit(?:s|ted|ting)?|lack(?:s|ed|ing)?)"
    low = F.trim(F.regexp_replace(F.lower(surface), "[^a-z0-9]+", " "))
    n = F.regexp_count(low, F.lit(f"\\b{term}\\b"))
    return (n > 0) & (F.regexp_count(low, F.lit(f"\\b{negation}(?:\\s+[a-z0-9-]+){{0,6}}\\s+{term}\\b")) >= n)


def shelf(items: DataFrame, sort: str) -> DataFrame:
    """items: id, cited, year, impact, nulls as 0.  Their place by one of these, the highest first, others in the order of id."""
    return items.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.coalesce(F.col(sort).cast("double"), F.lit(0.0))), "id")))


def shelf_groups(items: DataFrame) -> DataFrame:
    """items: id, tags (an array), source.  Items by their first tag and by their source, with the number of each and its first item."""
    tag = F.coalesce(F.get("tags", F.lit(0)), F.lit("未标记"))
    source = F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("未知来源"))
    both = items.select("id", F.explode(F.array(F.struct(F.lit("tag").alias("mode"), F.lower(tag).alias("key"), tag.alias("label")), F.struct(F.lit("source").alias("mode"), source.alias("key"), source.alias("label")))).alias("g"))
    return both.groupBy("g.mode", "g.key").agg(F.count("*").alias("items"), F.min("id").alias("first"), F.min(F.struct("id", "g.label"))["label"].alias("label"))


def ranked_labels(candidates: DataFrame, by: str, most: int) -> DataFrame:
    """candidates: by, label, score, n.  The best labels of each, by score, then count, then name."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), F.desc("n"), F.lower("label"), "label"))
    return candidates.withColumn("place", place).where(F.col("place") <= most)


def library_counts(items: DataFrame) -> DataFrame:
    """items: category, state, replaces.  One row of counts."""
    busy = F.col("state").isin("queued", "running")
    n = {c: F.count_if(F.col("category") == c).alias(c) for c in ("pending", "converted")} | {s: F.count_if(F.col("state") == s).alias(s) for s in ("queued", "running")}
    return items.agg(F.count("*").alias("total"), *n.values(), F.count_if(F.col("replaces") & busy).alias("reconverting"))


def selected_cases(cases: DataFrame, papers: list[str] | None = None, words: list[str] | None = None) -> DataFrame:
    """cases: paper_id, case_id, family, tags.  Those of the papers whose id, family or one of whose tags is among the words; no list means all."""
    out = cases if not papers else cases.where(F.col("paper_id").isin(*papers))
    low = [w.lower() for w in words or []]
    return out if not low else out.where(F.lower("case_id").isin(*low) | F.lower("family").isin(*low) | F.exists("tags", lambda t: F.lower(t).isin(*low)))


def metric_at(payload: Column | str, path: str) -> Column:
    """The value of a dotted path in a JSON text, null where there is none."""
    return F.get_json_object(payload, "$." + path)


def published_year(item: Column | str) -> Column:
    """The year of a work's record: the first of its dates whose first part is a year."""
    found = [F.nullif(F.regexp_extract(F.get_json_object(item, f"$['{k}']['date-parts'][0][0]"), "^((?:19|20)\\d{2})$", 1), F.lit("")) for k in ("published-print", "published-online", "issued", "created")]
    return F.coalesce(*found, F.lit(""))
