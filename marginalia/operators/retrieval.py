"""Ranking: postings, BM25, evidence grouping by document, and decisions on the best source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.shared import kept

K1, B, NEGATIVE = 1.5, 0.75, 0.25
#: Rows up to which a side of a join is broadcast.
BROADCAST_ROWS = 100_000


def with_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("toks", tokens(text))


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for a broadcast if it has at most so many rows; else as it is, so that a join shuffles it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def corpus(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, toks and dl of all rows, tokenised once and kept in the shared folder: statistics, lengths and frequencies are all read from it."""
    return kept(with_tokens(docs.select(key, text), text).select(key, "toks", F.size("toks").alias("dl")), "corpus")


def term_statistics(tokenised: DataFrame, key: str) -> DataFrame:
    """term, df, idf: in how many rows each term stands; a negative idf is replaced by a share of the mean."""
    df = tokenised.select(F.explode(F.array_distinct("toks")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = tokenised.agg(F.count("*").alias("n"))
    raw = df.crossJoin(F.broadcast(n)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # n: one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, NEGATIVE * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25(tokenised: DataFrame, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """tokenised: corpus() of the documents.  queries: query_id and query.  Returns query_id, key and score of all rows that share a term.
    A token that a query repeats counts as often; a document's tokens are narrowed to terms of the queries before they are exploded, where these
    are few enough to be broadcast."""
    average = tokenised.agg(F.avg("dl").alias("avgdl"))
    asked = queries.select("query_id", F.explode(tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    wanted = small(asked.select(F.col("term").alias("wanted")).distinct())
    asked = asked.join(term_statistics(tokenised, key), "term")
    tf = tokenised.select(key, "dl", F.explode("toks").alias("term")).join(wanted, F.col("term") == F.col("wanted"), "left_semi").groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    hits = tf.join(asked, "term").crossJoin(F.broadcast(average))  # one row
    weight = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", key).agg(F.round(F.sum(weight), 6).alias("score"))


def top_k(scored: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The k best rows of each query, ties in the order of key; nothing where no score is positive.  Each task keeps its own k best before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    ranked = scored.withColumn("rank", rank).where(F.col("rank") <= k)
    best = F.max("score").over(Window.partitionBy("query_id"))  # of k rows
    return ranked.withColumn("best", best).where("best > 0").drop("best")


def choose_translation(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of the second ranking for each query in which its best score beats the first one's by a quarter and .1."""
    best = lambda df, name: df.groupBy("query_id").agg(F.max("score").alias(name))
    pick = best(first, "a").join(best(second, "b"), "query_id", "full_outer")
    pick = pick.select("query_id", (F.coalesce("b", F.lit(0.0)) > 1.25 * F.coalesce("a", F.lit(0.0)) + 0.10).alias("second"))
    return first.join(pick.where("not second"), "query_id", "left_semi").unionByName(second.join(pick.where("second"), "query_id", "left_semi"))


def group_by_source(hits: DataFrame, k: int) -> DataFrame:
    """hits: query_id, source, score, snippet, ordinal.  Per query and source: best score, hits, and up to two distinct
    snippets, best first; the k best sources of each query.  Each task keeps its own two best of a source before the shuffle."""
    keys = ["query_id", "source"]
    distinct = hits.groupBy(*keys, "snippet").agg(F.max("score").alias("score"), F.min("ordinal").alias("ordinal"), F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "ordinal"))
    two = distinct.withColumn("place", place).where("place <= 2")
    snippets = two.groupBy(*keys).agg(*[F.max(F.when(F.col("place") == i, F.col("snippet"))).alias(f"snippet_{i}") for i in (1, 2)])
    totals = distinct.groupBy(*keys).agg(F.max("score").alias("score"), F.sum("n").alias("hits"))
    return top_k(totals.join(snippets, keys), k, "source")


def locked_source(sources: DataFrame) -> DataFrame:
    """sources: query_id, source, hits, explicit, anchor.  The one source that a query is about, and why, if there is one."""
    own = Window.partitionBy("query_id").orderBy(F.desc("anchor"), F.desc("explicit"), F.desc("hits"), "source")
    top = sources.withColumn("place", F.row_number().over(own)).withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    for c in ("hits", "explicit", "anchor"):
        top = top.withColumn(f"next_{c}", F.coalesce(F.lead(c).over(own), F.lit(0)))
    reason = (
        F.when(F.col("n") == 1, "single")
        .when((F.col("anchor") > 0) & (F.col("anchor") >= F.greatest(F.lit(1.0), F.col("next_anchor") + 0.25)), "anchor")
        .when((F.col("explicit") >= 6) & (F.col("explicit") >= F.col("next_explicit") + 1.5), "explicit")
        .when((F.col("hits") >= F.greatest(F.lit(2), 2 * F.col("next_hits"))) & (F.col("explicit") >= F.greatest(F.lit(4.0), F.col("next_explicit"))), "hits")
    )
    return top.where("place = 1").select("query_id", "source", reason.alias("reason")).where("reason is not null")


def keep_semantic(scored: DataFrame, floor: float = 28.0, below: float = 35.0) -> DataFrame:
    """Rows within `below` of their query's best score and at least `floor`; all of a query where none would be left (its best is below the floor)."""
    best = scored.groupBy("query_id").agg(F.max("score").alias("_best"))
    kept = scored.join(best, "query_id").where((F.col("score") >= F.greatest(F.lit(floor), F.col("_best") - below)) | (F.col("_best") < floor) | F.col("_best").isNull())
    return kept.drop("_best")


def within_budget(hits: DataFrame, budget: int = 12000) -> DataFrame:
    """hits: query_id, rank, text.  Those up to the first at which a query's characters exceed the budget.

    Of rows with text no more than budget + 1 can matter, and each task keeps only these before the shuffle; the sum over the rows that fit comes last."""
    own = Window.partitionBy("query_id").orderBy("rank")
    run = own.rowsBetween(Window.unboundedPreceding, 0)
    size = F.coalesce(F.length("text"), F.lit(0))
    first = hits.select("query_id", "rank", size.alias("size")).where("size > 0").withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= budget + 1)
    stop = first.withColumn("used", F.sum("size").over(run)).where(F.col("used") > budget).groupBy("query_id").agg(F.min("rank").alias("_stop"))
    fit = hits.join(stop, "query_id", "left").where("_stop is null or rank < _stop").drop("_stop")
    return fit.withColumn("used", F.sum(size).over(run))


def first_of_each(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")
