"""Names of files, venues and sources: their parts, keys and short forms.  All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

#: Organisations that are no conferences, words that a search leaves out, and tiers of venues.
ORGANISATIONS = ("IEEE", "ACM", "CVF", "IAPR", "IET", "SPIE", "OSA", "IFIP")
GENERIC = "(?i)\\b(?:proceedings|proc|conference|international|annual|ieee|acm|cvf|symposium|workshop)\\b"
CONFERENCE = "conference|symposium|workshop|proceedings|congress"


def name_hints(stem: Column | str) -> Column:
    """Struct of venue, year and title of a stem `venue-year-title`; another stem is all title."""
    x, pattern = _c(stem), "^(.+?)-(19\\d{2}|20\\d{2})-(.+)$"
    part = lambda k: F.trim(F.regexp_extract(x, pattern, k))
    return F.struct(part(1).alias("venue"), part(2).alias("year"), F.when(x.rlike(pattern), part(3)).otherwise(x).alias("title"))


def duplicate_norm(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(_c(x), F.lit("")))), "\\.pdf$", ""), "[^a-z0-9]+", " "))


def duplicate_key(venue: Column | str, year: Column | str, title: Column | str, display: Column | str, suggested: Column | str, old: Column | str) -> Column:
    """What two rows of one paper share: title with year or venue, else the first name that there is."""
    v, t, y = duplicate_norm(venue), duplicate_norm(title), F.trim(F.coalesce(_c(year), F.lit("")))
    out = F.when((t != "") & ((y != "") | (v != "")), F.concat(F.lit("meta|"), v, F.lit("|"), y, F.lit("|"), t))
    for prefix, c in (("display|", display), ("suggest|", suggested), ("old|", old)):
        out = out.when(duplicate_norm(c) != "", F.concat(F.lit(prefix), duplicate_norm(c)))
    return out.otherwise("")


def acronym(venue: Column | str) -> Column:
    """A venue's acronym: in brackets, else its first word in capitals that is no organisation, else its initials (3 to 10)."""
    v = F.trim(F.regexp_replace(F.coalesce(_c(venue), F.lit("")), "\\s+", " "))
    inside = F.regexp_extract(v, "\\(([A-Z][A-Z0-9]{2,12})\\)", 1)
    capitals = F.get(F.filter(F.regexp_extract_all(v, F.lit("\\b([A-Z][A-Z0-9]{2,12})\\b"), F.lit(1)), lambda c: ~c.isin(*ORGANISATIONS)), F.lit(0))
    initials = F.array_join(F.transform(F.regexp_extract_all(v, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.when((inside != "") & ~inside.isin(*ORGANISATIONS), inside).when(capitals.isNotNull(), capitals).when(F.length(initials).between(3, 10), initials).otherwise("")


def venue_query(venue: Column | str) -> Column:
    """A venue without years, marks and generic words."""
    v = F.regexp_replace(F.regexp_replace(F.coalesce(_c(venue), F.lit("")), "\\b(?:19|20)\\d{2}\\b", " "), "[()/,:;]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(v, GENERIC, " "), "\\s+", " "))


def tier_grade(tier: Column | str) -> Column:
    first = F.substring(F.upper(F.trim(F.coalesce(_c(tier), F.lit("")))), 1, 1)
    return F.when(first.isin("A", "B", "C"), first).otherwise("")


def venue_kind(kind: Column | str, venue: Column | str) -> Column:
    """conference or journal, by the kind of the record, else by words of the venue."""
    k, v = F.lower(F.trim(F.coalesce(_c(kind), F.lit("")))), F.lower(F.coalesce(_c(venue), F.lit("")))
    return F.when(k.rlike("proceedings|conference"), "conference").when(k.contains("journal") | (k == "article"), "journal").when(v.rlike(CONFERENCE), "conference").otherwise("journal")


def base_name(venue: Column | str, year: Column | str, title: Column | str, most: int = 88) -> Column:
    """venue-year-title; where it is too long the title is cut and a hash of the whole appended."""
    most = max(40, min(160, most))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(_c(c), F.lit("")), "[\\\\/:*?\"<>|\\x00-\\x1f]+", " "), "\\s+", " "))
    v, y, t = (F.nullif(plain(c), F.lit("")) for c in (venue, year, title))
    whole = F.coalesce(F.nullif(F.concat_ws("-", v, y, t), F.lit("")), F.lit("paper"))
    prefix, suffix = F.concat_ws("-", v, y), F.concat(F.lit("-"), F.substring(F.sha1(whole), 1, 8))
    room = F.lit(most - 9) - F.length(prefix) - 1
    cut = F.regexp_replace(F.substr(t, F.lit(1), F.greatest(room, F.lit(0))), "[ .\\-_]+$", "")
    short = F.when((prefix != "") & t.isNotNull() & (room >= 10), F.concat(prefix, F.lit("-"), cut, suffix))
    fallback = F.concat(F.regexp_replace(F.substring(whole, 1, most - 9), "[ .\\-_]+$", ""), suffix)
    return F.when(F.length(whole) <= most, whole).otherwise(F.coalesce(short, fallback))


def snippet(x: Column | str, most: int = 900) -> Column:
    """A snippet for display: plain line breaks, no lines of images alone, no wide gaps, cut with an ellipsis."""
    s = F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), "\r\n?", "\n"))
    lines = F.filter(F.split(s, "\n"), lambda line: ~line.rlike("^\\s*!\\[[^\\]]*\\]\\([^)]+\\)\\s*$"))
    s = F.regexp_replace(F.array_join(lines, "\n"), "[ \\t]{3,}", "  ")
    return F.when(F.length(s) > most, F.concat(F.regexp_replace(F.substring(s, 1, most), "\\s+$", ""), F.lit("…"))).otherwise(s)


def clean_citation_tokens(x: Column | str) -> Column:
    """[CITE:id:n] as [[CITE:id:n]]; tokens without a number, and ids of sources, go."""
    s = F.regexp_replace(_c(x), "(?i)(^|[^\\[])\\[\\s*CITE\\s*:\\s*([A-Za-z0-9_-]{4,24})\\s*:\\s*(\\d{1,4})\\s*\\](?=[^\\]]|$)", "$1[[CITE:$2:$3]]")
    s = F.regexp_replace(s, "(?i)\\[\\[\\s*CITE\\s*:\\s*[A-Za-z0-9_-]{4,24}\\s*\\]\\]", "")
    s = F.regexp_replace(s, "(?i)\\[\\[\\s*CITE\\s*:\\s*[A-Za-z0-9_-]{4,24}\\s*:\\s*(?!\\d{1,4}\\s*\\]\\])[^\\]\n]+\\]\\]", "")
    s = F.regexp_replace(s, "(?im)^\\s*(?:\\[\\d{1,3}\\]|DOC-\\d{1,3})\\s*\\[\\s*SID\\s*:\\s*[A-Za-z0-9_-]{4,24}\\s*\\][^\n]*\n?", "")
    return F.regexp_replace(s, "(?i)\\[\\s*SID\\s*:\\s*[A-Za-z0-9_-]{4,24}\\s*\\]", "")


def without_reference_section(x: Column | str) -> Column:
    """An answer up to a section of sources that the model wrote itself."""
    s = _c(x)
    for marker in ("参考定位", "Reference locate"):
        s = F.when(F.instr(s, marker) > 1, F.rtrim(F.substring_index(s, marker, 1))).otherwise(s)
    return s


def summary(x: Column | str, sentences: int = 3, most: int = 520) -> Column:
    """The first sentences (of 18 characters or more) of an abstract that fit; what is left of the room, if 30 or more, takes part of the next."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(_c(x), F.lit("")), "<[^>]+>", " "), "\\[[0-9,\\-\\s]{1,24}\\]", " ")
    s = F.regexp_replace(F.trim(F.regexp_replace(s, "\\s+", " ")), "(?i)^(?:abstract|摘要)\\s*[:：-]?\\s*", "")
    parts = F.filter(F.transform(F.split(F.regexp_replace(s, "([。！？!?.])\\s+", "$1\x01"), "\x01"), lambda v: F.trim(v)), lambda p: F.length(p) >= 18)
    cut = lambda t, n: F.concat(F.regexp_replace(F.substr(t, F.lit(1), n), "[ ,;:]+$", ""), F.lit("..."))
    state = F.struct(F.array().cast("array<string>").alias("picked"), F.lit(0).alias("total"), F.lit(False).alias("full"))

    def step(a: Column, p: Column) -> Column:
        room = F.lit(most) - a["total"]
        more = F.when(F.length(p) <= room, F.concat(a["picked"], F.array(p))).when(room >= 30, F.concat(a["picked"], F.array(cut(p, room)))).otherwise(a["picked"])
        made = F.struct(more.alias("picked"), (a["total"] + F.length(p)).alias("total"), ((F.length(p) > room) | (F.size(more) >= sentences)).alias("full"))
        return F.when(a["full"], a).otherwise(made)

    picked = F.aggregate(parts, state, step)["picked"]
    short = F.when(F.length(s) > most, cut(s, F.lit(most))).otherwise(s)
    return F.when(F.length(s) < 20, "").when(F.size(picked) > 0, F.array_join(picked, " ")).otherwise(short)
