"""Quality rules whose thresholds follow each language and source.

Every text gets a few counts; from them come five measures: symbols, ASCII marks and repeated words per ten thousand words, repeated lines
per ten thousand lines, and the mean length of a word in hundredths (short texts say little, so their shares are drawn towards that of a text
of a hundred words more, or ten lines more).  Their distributions are kept as mergeable sketches: counts by
bucket, whose width is at most a 32nd of the value (exact below 64).  Sketches add up in any order to the same
counts, so a source that holds a third of all rows is merged from the tasks' partial sketches, and the sketch of a language is the
sum of its sources'.  All documents are in the sketches, apart by whether the base rules reject them; the bounds come from those that pass.

A measure's upper bound lies `stretch` times the distance of two quantiles of its own group (MEASURES) beyond the higher one, for the
length of words a lower bound likewise below the lower one; no value is fixed.  Where a
group's quantiles nearly coincide, the distance is a 32nd of its median and one, so that equal texts don't reject all others; guarded() tells how
often (at sf0.1 in 20 of 400, all of them the length of words, whose quartiles lie within a bucket or two).  A source with fewer than ENOUGH documents in a language uses the language's sketch,
such a language that of all documents.

Null texts have no words; a null language or source counts as the empty one; a null doc_id and repeated rows stay; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import cut, documents
from .words import _BYTE_BASE, _BYTE_VALUES, SPACE, U64, Words, _span_hash, _sums, buffer_of, byte_set, mix, window_hash, with_columns

WINDOW = 3
LEAST_WORDS = 50
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
MARKS = byte_set((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
NEWLINE = byte_set((0x0A, 0x0A))
ENOUGH = 200
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks")
#: measure: SQL from the counts, the two quantiles in hundredths, and how many times their distance the bounds lie beyond them
MEASURES = {
    "symbols": ("10000 * (n_symbols + 1) div (n_words + 100)", 25, 75, 8),
    "marks": ("10000 * n_marks div n_words", 25, 75, 5),
    "repeats": ("10000 * n_repeat_words div (n_words + 100)", 50, 99, 1),
    "lines": ("10000 * n_dup_lines div (n_lines + 10)", 50, 99, 1),
    "length": ("100 * word_chars div n_words", 25, 75, 6),
}
#: Measures that have a lower bound too.
TWO_SIDED = ("length",)
LEVELS = (25, 50, 75, 99)


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[first])


def _again(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each hash: whether it stands elsewhere in the same text, and whether it stood before."""
    key = hashes ^ mix(text.astype(np.uint64) + U64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, later = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    later[order[1:]] = same
    return twice, later


def counts_of(texts: pa.Array) -> dict[str, np.ndarray]:
    buf, offsets = buffer_of(texts)
    words = Words(buf, offsets, SPACE)
    out = {"n_words": words.counts}
    out["word_chars"] = _per_text(~SPACE[buf] & ((buf & 0xC0) != 0x80), offsets)
    out["n_symbols"] = _per_text(SYMBOLS[buf], offsets)
    out["n_marks"] = _per_text(MARKS[buf], offsets)
    lines = Words(buf, offsets, NEWLINE)
    filled = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    start, end, text = lines.start[filled], lines.end[filled], lines.text_of_word()[filled]
    _, later = _again(_span_hash(_sums(_BYTE_VALUES[buf], _BYTE_BASE), start, end, _BYTE_BASE), text)
    out["n_lines"] = np.bincount(text, minlength=len(texts))
    out["n_dup_lines"] = np.bincount(text[later], minlength=len(texts))
    at = words.windows(WINDOW)
    twice, _ = _again(window_hash(words.hashes(), at, WINDOW), words.text_of_word()[at])
    cover = np.zeros(len(words) + WINDOW + 1, dtype=np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    out["n_repeat_words"] = _per_text(np.cumsum(cover)[: len(words)] > 0, words.first)
    return out


def with_counts(docs: DataFrame) -> DataFrame:
    """docs and the COUNTS of each text."""
    return with_columns(docs, "text", lambda _, texts: {k: pa.array(v, pa.int64()) for k, v in counts_of(texts).items()}, {k: T.LongType() for k in COUNTS})


def sketches(measured: DataFrame) -> DataFrame:
    """lang_key, source_key, base_failed, measure, bucket, n: the sketches, by language and source."""
    keys = ["lang_key", "source_key", "base_failed"]
    long = measured.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES])).alias("x")).select(*keys, "x.*")
    long = long.where("v is not null").withColumn("shift", F.expr("greatest(0, length(bin(v)) - 6)"))
    return long.withColumn("bucket", F.expr("shift * 32 + shiftright(v, shift)")).groupBy(*keys, "measure", "bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """keys, measure, rows and q<level> for each of LEVELS (the lower ends of their buckets)."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*keys, "measure")
    merged = merged.withColumn("below", F.sum("n").over(own.orderBy("bucket"))).withColumn("rows", F.sum("n").over(own))
    low = F.expr("case when bucket < 64 then bucket else shiftleft(bucket - (bucket div 32 - 1) * 32, cast(bucket div 32 - 1 as int)) end")
    merged = merged.withColumn("low", low)
    return merged.groupBy(*keys, "measure").agg(F.first("rows").alias("rows"), *[F.min(F.when(F.col("below") * 100 >= F.col("rows") * k, F.col("low"))).alias(f"q{k}") for k in LEVELS])


def bounds(measured: DataFrame) -> DataFrame:
    """lang_key, source_key, measure, lo, hi, and guarded: whether the least distance stands in for that of the quantiles."""
    sketch = cut(sketches(measured))
    fine = sketch.where("not base_failed")
    kept = F.struct("rows", *[f"q{k}" for k in LEVELS])
    q = sketch.select("lang_key", "source_key", "measure").distinct()
    q = q.join(quantiles(fine, "lang_key", "source_key").select("lang_key", "source_key", "measure", kept.alias("own")), ["lang_key", "source_key", "measure"], "left")
    q = q.join(quantiles(fine, "lang_key").select("lang_key", "measure", kept.alias("lang")), ["lang_key", "measure"], "left")
    q = q.join(F.broadcast(quantiles(fine).select("measure", kept.alias("every"))), "measure")  # a row a measure
    q = q.select("lang_key", "source_key", "measure", F.when(F.col("own.rows") >= ENOUGH, F.col("own")).when(F.col("lang.rows") >= ENOUGH, F.col("lang")).otherwise(F.col("every")).alias("q"))
    of = lambda at: F.create_map(*[x for m, spec in MEASURES.items() for x in (F.lit(m), at(spec))])[F.col("measure")]
    low, high = (of(lambda spec, i=i: F.col(f"q.q{spec[i]}")) for i in (1, 2))
    distance, least = high - low, F.expr("q.q50 div 32 + 1")
    beyond = of(lambda spec: F.lit(spec[3])) * F.greatest(distance, least)
    lo = F.when(F.col("measure").isin(*TWO_SIDED), low - beyond).otherwise(F.lit(-1))
    return q.select("lang_key", "source_key", "measure", lo.alias("lo"), (high + beyond).alias("hi"), (distance < least).alias("guarded"))


def thresholds(measured: DataFrame) -> DataFrame:
    """lang_key, source_key and, for each measure, the bounds <measure>_lo and <measure>_hi."""
    return bounds(measured).groupBy("lang_key", "source_key").agg(*[F.max(F.when(F.col("measure") == m, F.col(b))).alias(f"{m}_{b}") for m in MEASURES for b in ("lo", "hi")])


def measures(counted: DataFrame) -> DataFrame:
    """counted: lang, source and the COUNTS.  Adds base_failed, the keys and the MEASURES (null without words)."""
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    keys = {"base_failed": base, "lang_key": F.coalesce("lang", F.lit("")), "source_key": F.coalesce("source", F.lit(""))}
    return counted.withColumns(keys | {m: F.when(F.col("n_words") > 0, F.expr(spec[0])) for m, spec in MEASURES.items()})


def guarded(docs: DataFrame) -> DataFrame:
    """Per measure: groups, and groups whose bounds rest on the least distance."""
    counted = cut(with_counts(docs.select("text", "lang", "source")).drop("text"))
    return bounds(measures(counted)).groupBy("measure").agg(F.count("*").alias("groups"), F.count_if("guarded").alias("guarded"))


def verdicts(counted: DataFrame) -> DataFrame:
    """counted: lang, source and the COUNTS, already cut.  Adds base_failed and kept."""
    measured = measures(counted)
    joined = measured.join(thresholds(measured), ["lang_key", "source_key"], "left")
    fine = F.lit(True)
    for m in MEASURES:
        fine = fine & F.coalesce(F.col(m).between(F.col(f"{m}_lo"), F.col(f"{m}_hi")), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & fine)


def quality(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the counts, base_failed and kept."""
    counted = cut(with_counts(docs.select("doc_id", "text", "lang", "source")).drop("text"))
    return verdicts(counted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir, "doc_id", "text", "lang", "source"))


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^ \t-\r]+') AS ws FROM d),
win AS (
  SELECT r, i, list_aggregate(ws[i:i + 2], 'string_agg', ' ') AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n >= 2),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY r),
line AS (SELECT r, l FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^ \t-\r]')),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM line GROUP BY r),
c AS (
  SELECT w.r, doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    length(regexp_replace(text, '[^!-/:-@\[-`{-~]', '', 'g'))::BIGINT AS n_marks
  FROM w LEFT JOIN dup ON w.r = dup.r LEFT JOIN rep ON w.r = rep.r),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
m AS (
  SELECT r, lang, source, base_failed, unnest(['symbols', 'marks', 'repeats', 'lines', 'length']) AS measure,
    unnest([10000 * (n_symbols + 1) // (n_words + 100), 10000 * n_marks // n_words, 10000 * n_repeat_words // (n_words + 100), 10000 * n_dup_lines // (n_lines + 10), 100 * word_chars // n_words]) AS v
  FROM v WHERE n_words > 0),
b AS (SELECT *, CASE WHEN s = 0 THEN v ELSE s * 32 + (v >> s) END AS bucket FROM (SELECT *, greatest(0, length(bin(v)) - 6)::INT AS s FROM m WHERE NOT base_failed)),
k AS (
  SELECT 0 AS level, lang, source, measure, bucket, count(*) AS n FROM b GROUP BY ALL
  UNION ALL SELECT 1, lang, '', measure, bucket, count(*) FROM b GROUP BY ALL
  UNION ALL SELECT 2, '', '', measure, bucket, count(*) FROM b GROUP BY ALL),
cum AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total,
    CASE WHEN bucket < 64 THEN bucket ELSE (bucket - (bucket // 32 - 1) * 32) << (bucket // 32 - 1)::INT END AS low
  FROM k),
q AS (
  SELECT level, lang, source, measure, any_value(total) AS total,
    min(low) FILTER (WHERE below * 100 >= total * CASE WHEN measure IN ('repeats', 'lines') THEN 50 ELSE 25 END) AS a, min(low) FILTER (WHERE below * 100 >= total * 50) AS mid,
    min(low) FILTER (WHERE below * 100 >= total * CASE WHEN measure IN ('repeats', 'lines') THEN 99 ELSE 75 END) AS b
  FROM cum GROUP BY level, lang, source, measure),
pick AS (
  SELECT o.lang, o.source, o.measure, CASE WHEN own.total >= 200 THEN own WHEN l.total >= 200 THEN l ELSE g END AS q
  FROM (SELECT DISTINCT lang, source, measure FROM m) o LEFT JOIN q own ON own.level = 0 AND own.lang = o.lang AND own.source = o.source AND own.measure = o.measure
    LEFT JOIN q l ON l.level = 1 AND l.lang = o.lang AND l.measure = o.measure JOIN q g ON g.level = 2 AND g.measure = o.measure),
t AS (
  SELECT lang, source, measure, q.b + x AS hi, CASE WHEN measure = 'length' THEN q.a - x ELSE -1 END AS lo
  FROM (SELECT *, CASE measure WHEN 'symbols' THEN 8 WHEN 'marks' THEN 5 WHEN 'length' THEN 6 ELSE 1 END * greatest(q.b - q.a, q.mid // 32 + 1) AS x FROM pick)),
bad AS (SELECT DISTINCT r FROM m JOIN t USING (lang, source, measure) WHERE v > hi OR v < lo)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM (SELECT *, r IN (SELECT r FROM bad) AS bad FROM v)
"""
