"""Importance resampling towards a target: documents that read like the target's texts are drawn more often.

Features are all runs of 1 to 3 words, hashed into BUCKETS.  The log ratio of a bucket's share in the target to that in the corpus
is its gain; a document's weight is the sum of the gains of its features.  With a Gumbel number made from the seed and the doc_id
added, the highest scores are a draw without replacement in proportion to the exponentials of the weights.  Counts are summed in each task
before they are shuffled; the gains are a table of BUCKETS numbers, whatever the corpus.

The draw is exact and sorts no more than the winners.  Keys (falling score, rising doc_id, ...) are unique, as a row number of the written table comes last.
In each round every partition tells the median of its keys on either side of the pivot and how many they are; the
median of these medians, weighted by those numbers, is the next pivot, and at least about a quarter of the keys that are left falls away with each.  The driver gets two
rows a partition and round; the table of keys is written anew when it has shrunk to an eighth.

Null texts have no features (weight 0); a null doc_id counts as the empty text in the hash and comes after all others among equal scores; repeated rows are drawn each
for itself; an empty table gives an empty result.  doc_id is an integer.  Columns of the names that are added are replaced.
"""

from __future__ import annotations

from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .crc import TABLE, crc32_of_spans, shifted
from .storage import cut, documents, written
from .words import PUNCTUATION, Words, bounded, slices, with_columns, words_of

BUCKETS = 10000
RUN_WORDS = 3
PERCENT = 5
LEAST_WORDS = 20
SEED = 42
#: So few keys that are left are brought to the driver and sorted there.
FEW = 10_000
#: Winners of a part when they are ranked.
PART_ROWS = 200_000
#: The order of the draw.
KEYS = ("k_score", "k_null", "k_id", "k_features", "k_row")


def buckets(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2 and 3 words: the words where they start and their buckets."""
    length = words.end - words.start
    one = crc32_of_spans(words.buf, words.start, words.end)
    space = np.full(len(one), crc32_of_spans(np.frombuffer(b" ", dtype=np.uint8), np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64))[0], dtype=np.uint32)
    behind = shifted(space, length) ^ one  # of a space and the word
    found, run = [(np.arange(len(one)), one)], one
    for k in range(2, RUN_WORDS + 1):
        at = words.windows(k)
        last = at + k - 1
        grown = np.zeros(len(one), dtype=np.uint32)
        grown[at] = shifted(run[at], length[last] + 1) ^ behind[last]
        found.append((at, grown[at]))
        run = grown
    return [(at, (crc % np.uint32(BUCKETS)).astype(np.int64)) for at, crc in found]


def bucket_counts(texts: DataFrame) -> DataFrame:
    """bucket, n: the features of all rows of the column text."""

    def run(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for i, j in slices(batch.column(0)):
                for _, found in buckets(words_of(batch.column(0).slice(i, j - i), PUNCTUATION, lower=True)):
                    total += np.bincount(found, minlength=BUCKETS)
        at = np.flatnonzero(total)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    return bounded(texts.select("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket; the two tables of counts have at most BUCKETS rows."""
    s, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for into, counts in ((s, corpus), (t, target)):
        for r in counts.collect():
            into[r["bucket"]] = r["n"]
    all_s, all_t = s.sum() + BUCKETS, t.sum() + BUCKETS
    return np.array([floor(1000 * log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], dtype=np.int64)


def with_weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """docs with n_words, n_features and weight."""

    def work(_, texts):
        words = words_of(texts, PUNCTUATION, lower=True)
        features, weight = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        for at, found in buckets(words):
            features[at] += 1
            weight[at] += gain[found]
        sums = [np.append(0, np.cumsum(x)) for x in (features, weight)]
        n, w = (np.diff(x[words.first]) for x in sums)
        return {"n_words": pa.array(words.counts, pa.int64()), "n_features": pa.array(n), "weight": pa.array(w)}

    return with_columns(docs, "text", work, {"n_words": T.LongType(), "n_features": T.LongType(), "weight": T.LongType()})


def gumbel_score(seed: int) -> Column:
    """The weight and a Gumbel number in thousandths, from the hash of the seed and the doc_id."""
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    u = (hashed + F.lit(0.5)) / F.lit(4294967296.0)
    return F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def _sides(pivot: tuple | None, lo: tuple | None, hi: tuple | None):
    """A task's part of a round: for either side of the pivot (all as one side without) how many keys are left and their median."""

    def below(columns, key):
        less, equal = np.zeros(len(columns[0]), dtype=bool), np.ones(len(columns[0]), dtype=bool)
        for c, v in zip(columns, key, strict=True):
            less |= equal & (c < v)
            equal &= c == v
        return less, equal

    def run(batches):
        parts = [[np.asarray(batch.column(i)) for i in range(len(KEYS))] for batch in batches]
        if not parts:
            return
        columns = [np.concatenate([p[i] for p in parts]) for i in range(len(KEYS))]
        left = np.ones(len(columns[0]), dtype=bool)
        if lo is not None:
            less, equal = below(columns, lo)
            left &= ~less & ~equal
        if hi is not None:
            left &= below(columns, hi)[0]
        columns = [c[left] for c in columns]
        if pivot is None:
            sides = [(0, np.ones(len(columns[0]), dtype=bool), 0)]
        else:
            less, equal = below(columns, pivot)
            sides = [(0, less, int(equal.sum())), (1, ~less & ~equal, 0)]
        rows = []
        for side, here, at_pivot in sides:
            own = [c[here] for c in columns]
            n = len(own[0])
            median = [None] * len(KEYS)
            if n:
                mid = np.lexsort(own[::-1])[(n - 1) // 2]
                median = [int(c[mid]) for c in own]
            rows.append((side, n, at_pivot, *median))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["side", "n", "at_pivot", *KEYS])

    return run


_SIDES = ", ".join(f"{c} long" for c in ("side", "n", "at_pivot", *KEYS))


def cutoff(keys: DataFrame, k: int) -> tuple:
    """The k-th smallest (from 1) of the unique KEYS of a written table with at least k rows, by weighted medians of the partitions' medians."""
    keys = keys.select(*KEYS)
    lo = hi = pivot = None
    need, held = k, None
    while True:
        rows = keys.mapInArrow(_sides(pivot, lo, hi), _SIDES).collect()  # two a partition
        sides = [[(tuple(r[c] for c in KEYS), r["n"]) for r in rows if r["side"] == s and r["n"]] for s in (0, 1)]
        if pivot is None:
            side = sides[0]
        else:
            below = sum(n for _, n in sides[0])
            if need == below + sum(r["at_pivot"] for r in rows):
                return pivot
            if need <= below:
                side, hi = sides[0], pivot
            else:
                side, lo, need = sides[1], pivot, need - below - 1
        left = sum(n for _, n in side)
        held = held or left
        if left <= FEW:
            return sorted(tuple(r) for r in keys.where(_between(lo, hi)).collect())[need - 1]
        if 8 * left <= held:
            keys, held = cut(keys.where(_between(lo, hi))), left
        side.sort()
        total = 0
        for pivot, n in side:  # noqa: B007
            total += n
            if 2 * total >= left:
                break


def _up_to(key: tuple, closed: bool) -> Column:
    """Whether a row's key comes before the given one (or is it, if closed)."""
    found = F.lit(closed)
    for c, v in reversed(list(zip(KEYS, key, strict=True))):
        found = (F.col(c) < v) | ((F.col(c) == v) & found)
    return found


def _between(lo: tuple | None, hi: tuple | None) -> Column:
    found = F.lit(True)
    if lo is not None:
        found = found & ~_up_to(lo, closed=True)
    return found if hi is None else found & _up_to(hi, closed=False)


def ranked(rows: DataFrame, n: int) -> DataFrame:
    """rows (n of them) with their rank by KEYS: dealt out in ranges, numbered within each, and the ranges' sizes added up."""
    parts = max(1, -(-n // PART_ROWS))
    dealt = written(rows.repartitionByRange(parts, *KEYS).withColumn("k_part", F.spark_partition_id()), "drawn")
    sizes = dealt.groupBy("k_part").agg(F.count("*").alias("n"))
    before = Window.orderBy("k_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    base = sizes.select("k_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("k_base"))
    within = F.row_number().over(Window.partitionBy("k_part").orderBy(*KEYS))
    return dealt.withColumn("rank", within).join(base, "k_part").withColumn("rank", F.col("rank") + F.col("k_base")).drop("k_part", "k_base")


def importance_sample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns of `keep`) with n_features, weight, score and rank: null where a row isn't drawn.  target: a table with the column text.
    percent of the documents with at least LEAST_WORDS words are drawn."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_features", "weight", "score", "rank", *KEYS)]
    scored = with_weights(docs.select(*[f"`{c}`" for c in dict.fromkeys([*keep, "doc_id", "text"])]), gain).withColumn("score", gumbel_score(seed))
    order = [-F.col("score"), F.col("doc_id").isNull().cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("n_features"), F.monotonically_increasing_id()]
    shown = [c for c in keep if c not in ("n_words",)]
    table = written(scored.withColumns(dict(zip(KEYS, order, strict=True))).select(*[f"`{c}`" for c in shown], "n_words", "n_features", "weight", "score", *KEYS), "scored")
    long_enough = table.where(F.col("n_words") >= LEAST_WORDS)
    draws = percent * long_enough.count() // 100
    columns = [*[f"`{c}`" for c in shown], "n_features", "weight", "score", "rank"]
    undrawn = F.lit(None).cast("long")
    if not draws:
        return table.withColumn("rank", undrawn).select(*columns)
    last = cutoff(long_enough, draws)
    drawn = (F.col("n_words") >= LEAST_WORDS) & _up_to(last, closed=True)
    winners = ranked(table.where(drawn), draws)
    return table.where(~drawn).withColumn("rank", undrawn).select(*columns).unionByName(winners.withColumn("rank", F.col("rank").cast("long")).select(*columns))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"), keep=["doc_id"])


#: CRC-32 byte by byte with the table of its polynomial.
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor({TABLE.tolist()}[(xor(c, b) & 255) + 1]::BIGINT, c >> 8)), 4294967295)"

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (
  SELECT r, f, count(*) AS n FROM (
    SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM d) GROUP BY ALL),
bf AS (
  SELECT f, count(*) AS n FROM (
    SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM b) GROUP BY ALL),
bucket AS (SELECT f, {_CRC} % 10000 AS k FROM (SELECT f FROM df UNION SELECT f FROM bf)),
s AS (SELECT k, sum(n)::DOUBLE AS n FROM df JOIN bucket USING (f) GROUP BY k),
t AS (SELECT k, sum(n)::DOUBLE AS n FROM bf JOIN bucket USING (f) GROUP BY k),
total AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) + 10000 AS s, (SELECT coalesce(sum(n), 0) FROM t) + 10000 AS t),
gain AS (
  SELECT r.range AS k, floor(1000 * ln((coalesce(t.n, 0) + 1) * total.s / ((coalesce(s.n, 0) + 1) * total.t)))::BIGINT AS g
  FROM range(10000) r LEFT JOIN s ON s.k = r.range LEFT JOIN t ON t.k = r.range, total),
weight AS (SELECT r, sum(n * g)::BIGINT AS weight FROM df JOIN bucket USING (f) JOIN gain USING (k) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n_words, (len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0))::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weight USING (r)),
place AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, r) END AS p FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN p <= 5 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100 THEN p END AS rank FROM place
"""
