"""License scans by diagonal voting, in DataFrame operations only.

The rolling word grams of a document are joined by hash (and by their words, so that a collision of hashes can't vote) to the
places of the license templates, a fixed small table: 2-grams for the base phrases, 3-grams for the templates, which are whole texts and
single sentences of public licenses.  Before they are exploded, a document's grams are narrowed to those that stand in a
template at all.  A gram at place p that stands at place t of a template votes for the diagonal p - t.

A diagonal with all votes of a base phrase is that phrase word for word.  For the templates neighbouring diagonals are merged (words were left out
or put in) wherever a document has enough of a template's grams at all: into bands of BAND diagonals and of four times as many again and again, until half a band is as
wide as the template is long, and at least REACH.  Each width has two series that are shifted by half a band, so that a copy that drifts by up to half a band lies whole in
one.  A band is verified in order: its longest chain of votes whose places ascend both in the document and in the template
counts.  With at least SHARE of the template's grams the document gets its label.

Null texts have no words; a null doc_id stays; repeated rows get a result each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import BASE, phrases
from .storage import cut, documents

#: Words of a gram of the base phrases and of the templates.
K_BASE, K = 2, 3
BAND = 8
#: Half of a template's widest bands is at least so wide, and at least as wide as it has grams.
REACH = 40
SHARE = 0.6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All ASCII characters that are no letters or digits: they separate words.
_MARKS = "".join(map(chr, (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))))


def _grams() -> list[tuple[int, str, bool, int, int, str]]:
    rows = []
    for n, (label, phrase) in enumerate(phrases()):
        words, k = phrase.split(), K_BASE if n < len(BASE) else K
        grams = len(words) - k + 1
        rows += [(n, label, n < len(BASE), grams, t, " ".join(words[t : t + k])) for t in range(grams)]
    return rows


def series() -> list[tuple[int, int, int]]:
    """template, width and shift of the series of bands of each template that isn't a base phrase."""
    rows = []
    for n, grams in sorted({(n, grams) for n, _, is_base, grams, *_ in _grams() if not is_base}):
        width = BAND
        rows += [(n, width, shift) for shift in (0, width // 2)]
        while width < 2 * max(grams, REACH):
            width *= 4
            rows += [(n, width, shift) for shift in (0, width // 2)]
    return rows


def template_grams(spark: SparkSession) -> DataFrame:
    """template, label, is_base, grams (their number), t and template_gram: a row a place."""
    return spark.createDataFrame(_grams(), "template int, label string, is_base boolean, grams int, t int, template_gram string")


def with_grams(docs: DataFrame) -> DataFrame:
    """number (of the row), doc_id, n_words, and found: the places p and the grams that stand in a base phrase or a template."""
    known = {is_base: sorted({g for *_, b, _, _, g in _grams() if b == is_base}) for is_base in (True, False)}
    first = sorted({g.split()[0] for own in known.values() for g in own})
    text = F.translate(F.coalesce("text", F.lit("")), _UPPER + _MARKS, _LOWER + " " * len(_MARKS))
    words = docs.select("doc_id", F.array_remove(F.split(text, " "), "").alias("words"))
    after = lambda i, o: F.get("words", i + o)
    gram = lambda x, i: F.struct(i.alias("p"), F.concat_ws(" ", x, after(i, 1)).alias("two"), F.concat_ws(" ", x, after(i, 1), after(i, 2)).alias("three"))
    begun = F.filter(F.transform("words", lambda x, i: F.when(x.isin(*first), gram(x, i))), lambda y: y.isNotNull())
    found = F.filter(begun, lambda y: y["two"].isin(*known[True]) | y["three"].isin(*known[False]))
    return words.select(F.monotonically_increasing_id().alias("number"), "doc_id", F.size("words").cast("long").alias("n_words"), found.alias("found"))


def votes(found: DataFrame) -> DataFrame:
    """number, template, label, is_base, grams, diagonal, and the template places ts that voted for it."""
    fixed = F.broadcast(template_grams(found.sparkSession).withColumn("h", F.xxhash64("template_gram")))  # a fixed table
    rolled = found.select("number", F.explode("found").alias("g")).select("number", "g.p", F.explode(F.array("g.two", "g.three")).alias("gram"))
    hits = rolled.withColumn("h", F.xxhash64("gram")).join(fixed, "h").where("gram = template_gram")
    return hits.groupBy("number", "template", "label", "is_base", "grams", (F.col("p") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("ts"))


def spans(voted: DataFrame) -> DataFrame:
    """number, label, share, first and last word of the bands that pass."""
    keys = ["number", "template", "label", "grams"]
    own = voted.select(*keys, "diagonal", "ts")
    likely = own.groupBy("number", "template", "grams").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("n")).where(F.col("n") >= SHARE * F.col("grams"))
    fixed = F.broadcast(voted.sparkSession.createDataFrame(series(), "template int, width int, shift int"))  # a fixed table
    bands = own.join(likely.select("number", "template"), ["number", "template"]).join(fixed, "template")
    bands = bands.withColumn("band", F.floor((F.col("diagonal") + F.col("shift")) / F.col("width")))
    places = F.transform("ts", lambda t: F.struct((F.col("diagonal") + t).alias("p"), (-t).alias("back")))
    merged = bands.groupBy(*keys, "width", "shift", "band").agg(F.array_sort(F.flatten(F.collect_list(places))).alias("votes"))  # of one document
    merged = merged.where(F.size("votes") >= SHARE * F.col("grams"))
    # Ends of the chains of each length, the smallest place in the template that each length can end at; votes of one place come with falling places in the template.
    start = F.expr("cast(array() as array<struct<t:int,first:int,last:int>>)")

    def step(ends, v):
        t, p = -v["back"], v["p"]
        before = F.filter(ends, lambda e: e["t"] < t)
        n = F.size(before)
        first = F.when(n > 0, F.element_at(before, n)["first"]).otherwise(p)
        return F.concat(before, F.array(F.struct(t.cast("int").alias("t"), first.cast("int").alias("first"), p.cast("int").alias("last"))), F.slice(ends, n + 2, F.size(ends)))

    verified = merged.withColumn("ends", F.aggregate("votes", start, step)).withColumn("share", F.size("ends") / F.col("grams")).where(F.col("share") >= SHARE)
    whole = F.element_at("ends", -1)
    return verified.select("number", "label", "share", whole["first"].alias("first"), (whole["last"] + (K - 1)).alias("last"))


def licenses(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = cut(with_grams(docs.select("doc_id", "text")))  # texts are read once; the numbers are fixed by it
    voted = cut(votes(rows))
    whole = voted.where(F.col("is_base") & (F.size("ts") == F.col("grams"))).select("number", "label", F.lit(1.0).alias("share"), F.col("diagonal").alias("start"))
    near = spans(voted.where("not is_base")).select("number", "label", "share", F.lit(None).cast("int").alias("start"))
    found = whole.union(near).groupBy("number").agg(
        F.count("start").alias("n_base"),
        F.min("start").cast("long").alias("first_word"),
        F.max("start").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    none = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    return rows.select("number", "doc_id", "n_words").join(found, "number", "left").fillna(none).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(documents(spark, sf_dir, "doc_id", "text"))


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_VALUES = ", ".join(f"({n}, '{label}', {'true' if n < len(BASE) else 'false'}, '{phrase}')" for n, (label, phrase) in enumerate(phrases()))
_SERIES = ", ".join(map(str, series()))
OP7_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS ws FROM documents),
v(template, label, is_base, phrase) AS (VALUES {_VALUES}),
tw AS (SELECT *, string_split(phrase, ' ') AS ws FROM v),
t2 AS (SELECT template, label, len(ws) - 1 AS grams, unnest(range(0, len(ws) - 1)) AS t, ws FROM tw WHERE is_base),
t3 AS (SELECT template, label, len(ws) - 2 AS grams, unnest(range(0, len(ws) - 2)) AS t, ws FROM tw WHERE NOT is_base),
g2 AS (SELECT r, p, ws[p + 1] || ' ' || ws[p + 2] AS gram FROM (SELECT r, ws, unnest(range(0, len(ws) - 1)) AS p FROM d WHERE len(ws) > 1)),
g3 AS (SELECT r, p, ws[p + 1] || ' ' || ws[p + 2] || ' ' || ws[p + 3] AS gram FROM (SELECT r, ws, unnest(range(0, len(ws) - 2)) AS p FROM d WHERE len(ws) > 2)),
base AS (
  SELECT r, label, p - t AS diagonal FROM g2 JOIN (SELECT *, ws[t + 1] || ' ' || ws[t + 2] AS gram FROM t2) USING (gram)
  GROUP BY r, template, label, grams, p - t HAVING count(*) = grams),
vote AS (SELECT r, template, label, grams, p, t, p - t AS diagonal FROM g3 JOIN (SELECT *, ws[t + 1] || ' ' || ws[t + 2] || ' ' || ws[t + 3] AS gram FROM t3) USING (gram)),
likely AS (SELECT r, template FROM vote GROUP BY r, template, grams HAVING count(DISTINCT t) >= {SHARE} * grams),
series(template, width, shift) AS (VALUES {_SERIES}),
band AS (
  SELECT r, template, label, grams, width, shift, floor((diagonal + shift) / width) AS band, list([t] ORDER BY p, t DESC) AS ts
  FROM vote JOIN likely USING (r, template) JOIN series USING (template) GROUP BY ALL HAVING count(*) >= {SHARE} * grams),
chain AS (
  SELECT r, label, len(list_reduce(ts, lambda ends, v: list_concat(list_concat(list_filter(ends, lambda e: e < v[1]), v), ends[len(list_filter(ends, lambda e: e < v[1])) + 2:]))) / grams::DOUBLE AS share FROM band),
near AS (SELECT r, label, share FROM chain WHERE share >= {SHARE}),
lab AS (SELECT r, label, 1.0::DOUBLE AS share FROM base UNION ALL SELECT r, label, share FROM near),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM lab GROUP BY r),
b AS (SELECT r, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN l USING (r)
"""
