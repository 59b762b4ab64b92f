"""Reference cards: how directly a hit answers a prompt, and which hits a prompt's focus leaves."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import duplicate_norm
from .intents import focus_action, paper_scope
from .reader import focus_terms

#: Scores from which a hit is direct, words of a direct, a passing and a negative mention, and headings.
COMPARE_FLOOR, COMPARE_LEAD, SINGLE_FLOOR = 5.0, 1.0, 4.25
COMPARES = "(?i)\\b(?:compare|compares|compared|comparison|versus|vs)\\b"
DIRECT = "(?i)\\b(?:directly|systematically|head[\\s-]?to[\\s-]?head)\\b"
NOT_COMPARED = "(?i)\\b(?:does\\s+not\\s+compare|not\\s+compare|without\\s+comparing|mentions?\\s+.*\\bbut\\s+does\\s+not)\\b"
IN_PASSING = "(?i)\\b(?:background example|mention(?:ed)?\\s+in\\s+passing|related work)\\b"
DEFINES = "(?i)\\b(?:defin(?:e|es|ed|ition)|refers?\\s+to|is\\s+defined\\s+as|introduced?\\s+as|means)\\b"
OWN_WORK = "(?i)\\b(?:this paper|the paper|this work|the work|we\\s+(?:present|propose|introduce|define|describe|analy[sz]e|study|show|demonstrate|develop|use|investigate|explore))\\b"
EXPLAINS = "(?i)\\b(?:discuss(?:es|ed)?|explain(?:s|ed)?|describe(?:s|d)?|analy[sz]e(?:s|d)?|introduce(?:s|d)?|define(?:s|d)?)\\b"
OTHERS_WORK = "(?i)\\b(?:mentioned\\s+here\\s+only|mentioned\\s+in\\s+passing|generic\\s+optimization\\s+family|background\\s+discussion|related\\s+work|prior\\s+work|previous\\s+work|existing\\s+methods?|instead\\s+of\\s+using|widely\\s+used|commonly\\s+used|citation\\s+in\\s+related\\s+work)\\b"
NEGATIVE = "(?i)\\bnot mentioned\\b|\\bnot discuss(?:ed)?\\b|\\bnot stated\\b|\\bdoes(?:n't| not) mention\\b|\\bdoes(?:n't| not) specify\\b|\\bnot found\\b|\\bcannot point\\b|\\bno external paper matched\\b|\\bno papers? in (?:my|your) library\\b|没有提到|没有命中|无法定位|不能指向|未提及|未提到"
HEADINGS = [("abstract", 2.2), ("introduction", 1.8), ("\\b(?:methods?|model|pipeline|architecture|framework|algorithm)\\b", 1.0), ("\\b(?:compare|comparison|analysis|experiment|results?|evaluation)\\b", 0.8), ("related work|background|literature review", -2.4), ("conclusion|discussion|future work", -0.8)]
NEGATION = "\\b(?:without|not|no|never|instead\\s+of|rather\\s+than|free\\s+of|excluding|exclude(?:s|d|ing)?|avoid(?:s|ed|ing)?|omit(?:s|ted|ting)?|lack(?:s|ed|ing)?)(?:\\s+[a-z0-9-]+){0,6}\\s+"


def _if(condition: Column, weight) -> Column:
    return F.when(condition, weight).otherwise(0.0)


def _on(term: Column, surface: Column) -> Column:
    """Whether a term stands on a surface; both normalised."""
    return F.concat(F.lit(" "), surface, F.lit(" ")).contains(F.concat(F.lit(" "), term, F.lit(" ")))


def with_directness(hits: DataFrame) -> DataFrame:
    """hits: prompt, title, heading, text.  Adds terms (of the prompt), how many of them a hit has, also apart from its title, whether all it has are negated, and the scores for a
    comparison and for the pick of one paper."""
    rows = hits.withColumns({"terms": focus_terms("prompt"), "_title": duplicate_norm("title"), "_heading": duplicate_norm("heading"), "_own": duplicate_norm(F.concat_ws(" ", "heading", "text")), "_all": duplicate_norm(F.concat_ws(" ", "title", "heading", "text"))})
    within = lambda t: F.col("_title").contains(t) | t.contains(F.col("_title"))
    keywords = F.array_distinct(F.flatten(F.transform("terms", lambda t: F.filter(F.split(t, " "), lambda w: F.length(w) >= 4))))
    found = F.filter("terms", lambda t: _on(t, F.col("_all")))
    own = F.filter("terms", lambda t: _on(t, F.col("_own")))
    negated = lambda t: F.regexp_count("_own", F.concat(F.lit(NEGATION), t, F.lit("\\b"))) >= F.regexp_count("_own", F.concat(F.lit("\\b"), t, F.lit("\\b")))
    rows = rows.withColumns({
        "matches": F.size(found), "other_matches": F.size(F.filter(found, lambda t: (F.col("_title") == "") | ~within(t))), "title_matches": F.size(F.filter("terms", lambda t: _on(t, F.col("_title")))), "only_negated": (F.size(own) > 0) & F.forall(own, negated),
        "_k": F.size(F.filter(keywords, lambda w: F.col("_all").contains(w))), "_kt": F.size(F.filter(keywords, lambda w: F.col("_title").contains(w))), "_kh": F.size(F.filter(keywords, lambda w: F.col("_heading").contains(w))),
    })
    head = None
    for pattern, weight in HEADINGS:
        hit = F.col("_heading").rlike(pattern)
        head = F.when(hit, weight) if head is None else head.when(hit, weight)
    head = head.otherwise(0.0)
    surface, n, nt = F.concat_ws(" ", "title", "heading", "text"), F.col("other_matches"), F.col("title_matches")
    defines = focus_action("prompt") == "define"
    compared = surface.rlike(COMPARES) | F.col("title").rlike(COMPARES)
    compare = [2.2 * n, _if(surface.rlike(COMPARES), 2.0), _if(F.col("title").rlike(COMPARES), 2.8), _if(F.col("_kt") >= 2, 2.0), _if(surface.rlike(DIRECT), 0.8), _if(surface.rlike(NOT_COMPARED), -4.2), _if(surface.rlike(IN_PASSING), -1.2), _if((n >= 2) & ~compared, -1.8)]
    single = [
        2.4 * n, 2.1 * nt, 1.6 * F.least(F.lit(2), F.col("_k")), _if(F.col("_kh") > 0, 0.8), F.when(F.col("_kt") >= 2, 1.2).when((F.col("_kt") == 1) & (nt == 0), 0.6).otherwise(0.0), head, _if((nt > 0) & (n == 0) & (head >= 0.8), 1.8),
        F.when(defines, F.when(surface.rlike(DEFINES), 3.0).when(F.col("_k") + F.col("_kh") + F.col("_kt") > 0, 1.4).otherwise(-1.8)).otherwise(_if(surface.rlike(OWN_WORK), 1.4) + _if(surface.rlike(EXPLAINS), 0.9)),
        _if(surface.rlike(OTHERS_WORK), -3.4), _if(surface.rlike(NEGATIVE), -4.4), _if((n > 0) & (nt == 0) & (F.col("_kt") <= 1) & (head <= 0) & ~surface.rlike(EXPLAINS) & ~surface.rlike(COMPARES), -0.6),
    ]
    none = (n == 0) & (nt == 0) & (F.col("_kt") == 0)
    rows = rows.withColumns({"compare_score": F.round(reduce(add, compare), 4), "single_score": F.when(none, -1000.0).otherwise(F.round(reduce(add, single), 4))})
    return rows.drop("_title", "_heading", "_own", "_all", "_k", "_kt", "_kh")


def focused(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """hits as in with_directness() with by, pos and why (the reason that was given for a hit).  The hits that a prompt's focus leaves: all without focus terms; else none whose reason is negative and whose text
    has no term, or that only negate their terms; of a comparison the direct ones, or the best alone where it leads; of a pick of one the direct ones; of a list those with
    a term beyond their title, else with any, else all; of several terms those with one beyond their title; of one term those with it."""
    rows = with_directness(hits)
    several = F.size("terms") > 0
    negative = F.coalesce("why", F.lit("")).rlike(NEGATIVE) & (F.col("matches") == 0)
    rows = rows.where(~several | (~negative & ~F.col("only_negated")))
    compares, scope = focus_action("prompt") == "compare", paper_scope("prompt")
    rows = rows.withColumn("mode", F.when(~several, "all").when(compares, "compare").when(scope == "single", "single").when(scope == "list", "list").when(F.size("terms") > 1, "terms").otherwise("term"))
    order = Window.partitionBy(by).orderBy(F.desc("compare_score"), "pos")
    rows = rows.withColumns({"_n": F.row_number().over(order), "_next": F.lead("compare_score").over(order)})
    totals = rows.groupBy(by).agg(F.count_if(F.col("compare_score") >= COMPARE_FLOOR).alias("_direct"), F.max(F.when(F.col("_n") == 1, F.col("compare_score") - F.col("_next"))).alias("_lead"), F.max("other_matches").alias("_other"), F.max("matches").alias("_any"))
    rows = rows.join(totals, by)
    alone = (F.col("_direct") >= 2) & (F.col("_lead") >= COMPARE_LEAD)
    kept = (
        F.when(F.col("mode") == "all", True)
        .when(F.col("mode") == "compare", (F.col("compare_score") >= COMPARE_FLOOR) & (~alone | (F.col("_n") == 1)))
        .when(F.col("mode") == "single", F.col("single_score") >= SINGLE_FLOOR)
        .when(F.col("mode") == "list", F.when(F.col("_other") > 0, F.col("other_matches") > 0).when(F.col("_any") > 0, F.col("matches") > 0).otherwise(True))
        .when(F.col("mode") == "terms", F.col("other_matches") > 0)
        .otherwise(F.col("matches") > 0)
    )
    return rows.where(kept).drop("_n", "_next", "_direct", "_lead", "_other", "_any")
