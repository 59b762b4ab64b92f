"""Toxicity: a convolutional text classifier trained by numpy steps in Spark tasks and applied by Spark to whole texts.

A word's vector is the sum of hashed embeddings of the word and of its first 4 to 7 bytes.  Filters
of 1, 2 and 3 words slide over a text, each keeps its maximum, and a linear layer over
the maxima gives the score.  The classifier learns from the whole texts of all labelled rows that are not held out: they lie in shards by
doc_id, one for each SHARD_BYTES of text; the embeddings start from counts over all rows; in each of EPOCHS rounds every shard takes
its steps from the common weights, and Spark averages what they come to.  A fifth of the rows is held back from the steps to place the decision: the score is shifted
so that the best cut over all languages is THRESHOLD, and each language with enough
labelled rows gets a threshold of its own (for rejecting documents; it never enters a score).  Cuts come from counts of all of these rows by steps of 1 / STEPS of the logit.

Null and empty texts get the score of a text without words.  A null doc_id is not held out; repeated rows are
scored each for itself; with no labelled rows of both kinds every score is 0; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import delete, documents, fresh_dir, written
from .words import _BYTE_BASE, _BYTE_VALUES, PUNCTUATION, U64, _span_hash, _sums, bounded, buffer_of, slices, with_columns, words_of

THRESHOLD = 0.7
#: Rows of each label in labelled_sample() at most, and their bytes of text; nothing is learnt from it.
SAMPLE = {0: 3000, 1: 2000}
SAMPLE_BYTES = 48 << 20
#: Texts of more bytes come last in labelled_sample().
LONG = 256 << 10
BUCKETS = 1 << 16
WIDTH = 8
FILTERS = 8
SPANS = (1, 2, 3)
PREFIXES = (4, 5, 6, 7)
EPOCHS = 4
BATCH = 64
RATE = 0.12
SLICE_BYTES = 1 << 20
#: Bytes of text, labelled or not, for each of which there is a shard.
SHARD_BYTES = 64 << 20
#: Slices in which weights and counts are added up.
PIECES = 16
#: Counts of logits by steps of 1 / STEPS within +-MOST.
STEPS, MOST = 1024, 64
#: Labelled rows of each kind from which a language gets its own threshold.
ENOUGH = 10


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (words by kinds of feature, from 1 on) with two rows of zeros after each text, and where each text starts."""
    words = words_of(texts, PUNCTUATION, lower=True)
    sums = _sums(_BYTE_VALUES[words.buf], _BYTE_BASE)
    out = np.zeros((len(words) + 2 * len(texts), 1 + len(PREFIXES)), dtype=np.int32)
    place = np.arange(len(words)) + 2 * words.text_of_word()
    for k, n in enumerate((None, *PREFIXES)):
        end = words.end if n is None else np.minimum(words.end, words.start + n)
        out[place, k] = 1 + ((_span_hash(sums, words.start, end, _BYTE_BASE) + U64(k * 0x9E3779B1)) * U64(0x9E3779B97F4A7C15) >> U64(48)).astype(np.int32)
    return out, words.first + 2 * np.arange(len(words.first))


@dataclass
class Classifier:
    """The weights; shift and thresholds are set by calibrate()."""

    table: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS + 1, WIDTH), dtype=np.float32))
    filters: np.ndarray = field(default_factory=lambda: np.zeros((WIDTH, sum(SPANS), FILTERS), dtype=np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros((len(SPANS), FILTERS), dtype=np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(len(SPANS) * FILTERS, dtype=np.float32))
    base: float = 0.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    trained: bool = False

    def vectors(self, buckets: np.ndarray) -> np.ndarray:
        x = self.table[buckets[:, 0]]
        for k in range(1, buckets.shape[1]):
            x += self.table[buckets[:, k]]
        return x

    def maps(self, x: np.ndarray, none: np.ndarray) -> np.ndarray:
        """What each filter gives from each word on; from rows without a word on (`none`) the bias, as the words beyond are another text's."""
        parts = (x @ self.filters.reshape(WIDTH, -1)).reshape(len(x), sum(SPANS), FILTERS)
        found, at = [], 0
        for i, span in enumerate(SPANS):
            total = parts[:, at].copy()
            for o in range(1, span):
                total[:-o] += parts[o:, at + o]
            found.append(total + self.bias[i])
            at += span
        out = np.concatenate(found, axis=1)
        out[none] = self.bias.ravel()
        return out

    def logits(self, buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
        best = np.maximum.reduceat(self.maps(self.vectors(buckets), buckets[:, 0] == 0), starts[:-1], axis=0)
        return np.maximum(best, 0) @ self.out + self.base

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        if self.trained:
            for i, j in slices(texts, SLICE_BYTES):
                out[i:j] = 1 / (1 + np.exp(-(self.logits(*features(texts.slice(i, j - i))).astype(np.float64) + self.shift)))
        return out


def _parts(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Slices of about SLICE_BYTES and which texts they are of; a longer text comes in pieces between words, and spans of words across their borders aren't formed."""
    for i, j in slices(texts, SLICE_BYTES):
        part = texts.slice(i, j - i)
        buf = buffer_of(part)[0] if j == i + 1 else part[:0]
        if len(buf) <= SLICE_BYTES:
            yield np.arange(i, j), part
            continue
        begin = 0
        while begin < len(buf):
            end = min(begin + SLICE_BYTES, len(buf))
            while end < len(buf):  # a word of more than SLICE_BYTES stays whole
                border = np.flatnonzero(PUNCTUATION[buf[begin:end]])
                if len(border):
                    end = begin + int(border[-1]) + 1
                    break
                end = min(end + SLICE_BYTES, len(buf))
            yield np.array([i]), pa.array([buf[begin:end].tobytes()], pa.binary()).cast(pa.string())
            begin = end


_OFFSETS = np.repeat(np.cumsum((0, *SPANS[:-1])), FILTERS)
_SPANS = np.repeat(SPANS, FILTERS)
_WHICH = np.tile(np.arange(FILTERS), len(SPANS))


def _windows(model: Classifier, texts: pa.Array, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The maximum of each text and filter, and the buckets of the words from which on it has it.  A word stays with three chances in four, so that no single word is relied on."""
    best = np.full((len(texts), len(_SPANS)), -np.inf, dtype=np.float32)
    window = np.zeros((len(texts), len(_SPANS), max(SPANS), 1 + len(PREFIXES)), dtype=np.int32)
    for owner, part in _parts(texts):
        buckets, starts = features(part)
        keep = (rng.random(len(buckets)) < 0.75) | (buckets[:, 0] == 0)
        doc = np.repeat(np.arange(len(part)), np.diff(starts))[keep]
        buckets = buckets[keep]
        starts = np.searchsorted(doc, np.arange(len(part) + 1))
        none = buckets[:, 0] == 0
        maps = model.maps(model.vectors(buckets), none)
        at = np.stack([a + maps[a:b].argmax(axis=0) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)])
        found = maps[at, np.arange(maps.shape[1])]
        padded = np.concatenate([buckets, np.zeros((max(SPANS), buckets.shape[1]), dtype=np.int32)])
        words = padded[at[:, :, None] + np.arange(max(SPANS))]
        words[none[at]] = 0
        more = found > best[owner]
        best[owner] = np.where(more, found, best[owner])
        window[owner] = np.where(more[:, :, None, None], words, window[owner])
    return best, window


class Trainer:
    """Stochastic gradient steps with Adagrad; only the words at which a filter had its maximum get a gradient."""

    def __init__(self, model: Classifier, seed: int, rate: float = RATE):
        self.model, self.rng, self.rate, self.rows = copy.deepcopy(model), np.random.default_rng(seed), rate, 0
        self.square = {k: np.full_like(getattr(model, k), 1e-2) for k in ("table", "filters", "bias", "out")}
        self.base_square = 1e-2

    def learn(self, texts: pa.Array, labels: np.ndarray) -> None:
        order = self.rng.permutation(len(texts))
        for b in range(0, len(order), BATCH):
            self.step(texts.take(pa.array(order[b : b + BATCH])), labels[order[b : b + BATCH]])
        self.rows += len(texts)

    def move(self, name: str, at, gradient: np.ndarray) -> None:
        self.square[name][at] += gradient**2
        getattr(self.model, name)[at] -= self.rate * gradient / np.sqrt(self.square[name][at])

    def step(self, texts: pa.Array, labels: np.ndarray) -> None:
        model = self.model
        best, window = _windows(model, texts, self.rng)
        pooled = np.maximum(best, 0)
        error = 1 / (1 + np.exp(-(pooled @ model.out + model.base))) - labels
        error = (error / len(labels)).astype(np.float32)
        back = error[:, None] * model.out * (best > 0)
        filters, ids, gradients = np.zeros_like(model.filters), [], []
        for o in range(max(SPANS)):
            d, c = np.nonzero((back != 0) & (o < _SPANS)[None, :])
            g, words = back[d, c][:, None], window[d, c, o]
            np.add.at(filters, (slice(None), _OFFSETS[c] + o, _WHICH[c]), (g * model.table[words].sum(axis=1)).T)
            ids.append(words.ravel())
            gradients.append(np.repeat(g * model.filters[:, _OFFSETS[c] + o, _WHICH[c]].T, words.shape[1], axis=0))
        names, gradient = np.concatenate(ids), np.concatenate(gradients)
        if len(names):
            order = np.argsort(names, kind="stable")
            names, first = np.unique(names[order], return_index=True)
            total = np.add.reduceat(gradient[order], first, axis=0)
            self.move("table", names[names > 0], total[names > 0])
        self.move("filters", ..., filters)
        self.move("bias", ..., back.sum(axis=0).reshape(model.bias.shape))
        self.move("out", ..., error @ pooled)
        self.base_square += float(error.sum()) ** 2
        model.base -= self.rate * float(error.sum()) / self.base_square**0.5


_WEIGHTS = ("table", "filters", "bias", "out")


def _flat(model: Classifier) -> np.ndarray:
    return np.concatenate([*[getattr(model, k).ravel() for k in _WEIGHTS], [model.base]]).astype(np.float32)


def _set(model: Classifier, flat: np.ndarray) -> None:
    at = 0
    for k in _WEIGHTS:
        old = getattr(model, k)
        setattr(model, k, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
        at += old.size
    model.base = float(flat[at])


def _pieces(rows: int, values: np.ndarray) -> pa.RecordBatch:
    parts = [v.tobytes() for v in np.array_split(values, PIECES)]
    return pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([rows] * PIECES, pa.int64()), pa.array(parts, pa.binary())], names=["piece", "rows", "values"])


def _mean(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]], size: int) -> np.ndarray:
    """The mean of the float32 vectors that `work` makes of the batches of df, weighted by their rows; tasks add up a slice of the vectors each."""

    def made(batches):
        for rows, values in work(batches):
            yield _pieces(rows, values.astype(np.float32))

    def added(batches):
        total: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for piece, rows, values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                n, v = total.get(piece, (0, 0.0))
                total[piece] = (n + rows, v + rows * np.frombuffer(values, dtype=np.float32).astype(np.float64))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([(v / n).tobytes() for n, v in total.values()], pa.binary())], names=["piece", "values"])

    found = bounded(df).mapInArrow(made, "piece int, rows long, values binary").repartition("piece").mapInArrow(added, "piece int, values binary").collect()
    out = np.concatenate([np.frombuffer(r["values"], dtype=np.float64) for r in sorted(found, key=lambda r: r["piece"])])
    assert len(out) == size
    return out


def _shares(df: DataFrame, label: int) -> np.ndarray:
    """Of the rows of a label, the share in which each bucket occurs."""

    def work(batches):
        seen, rows = np.zeros(BUCKETS + 1), 0
        for batch in batches:
            texts = batch.column(1)
            has = np.zeros(0, dtype=bool)
            last = -1
            for owner, part in _parts(texts):
                buckets, starts = features(part)
                if len(owner) > 1 or owner[0] != last:
                    seen[: len(has)] += has
                    has = np.zeros(0, dtype=bool)
                last = int(owner[-1])
                if len(owner) == 1:  # perhaps a piece of a long text, in which a bucket counts once
                    has = has if len(has) else np.zeros(BUCKETS + 1, dtype=bool)
                    has[buckets.ravel()] = True
                    continue
                doc = np.repeat(np.arange(len(part)), np.diff(starts))
                seen += np.bincount(np.unique(doc[:, None] * (BUCKETS + 1) + buckets) % (BUCKETS + 1), minlength=BUCKETS + 1)
            seen[: len(has)] += has
            rows += len(texts)
        if rows:
            yield rows, seen / rows

    return _mean(df.where(F.col("toxic") == label), work, BUCKETS + 1)


def _round(df: DataFrame, model: Classifier, number: int) -> None:
    """A round of all shards; the model gets the mean of their weights."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        shard, trainer = None, None
        for batch in batches:
            shards = np.asarray(batch.column(0))
            borders = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(borders, borders[1:], strict=False):
                if a < b:
                    if shards[a] != shard:
                        if trainer:
                            yield trainer.rows, _flat(trainer.model)
                        shard = int(shards[a])
                        trainer = Trainer(shared.value, 1000 * shard + number, RATE / (1 + number) ** 0.5)
                    trainer.learn(batch.column(1).slice(a, b - a), np.asarray(batch.column(2))[a:b])
        if trainer:
            yield trainer.rows, _flat(trainer.model)

    _set(model, _mean(df, work, len(_flat(model))))
    shared.unpersist()


def _begin(share: list[np.ndarray], rows: list[int], seed: int = 7) -> Classifier:
    """The first coordinate starts from how much oftener a bucket's words stand in rows of label 1."""
    model, rng = Classifier(), np.random.default_rng(seed)
    seen = np.array([s * n for s, n in zip(share, rows, strict=True)])
    odds = np.log((seen[1] + 1) / (rows[1] + 2)) - np.log((seen[0] + 1) / (rows[0] + 2))
    trust = seen.sum(axis=0) / (seen.sum(axis=0) + 8)
    model.table = rng.normal(0, 0.02, model.table.shape).astype(np.float32)
    model.table[:, 0] += (0.3 * odds * trust).astype(np.float32)
    model.table[0] = 0
    model.filters = rng.normal(0, 0.3, model.filters.shape).astype(np.float32)
    model.filters[0] = np.abs(model.filters[0]) + 0.3
    model.out = np.full(model.out.shape, 0.15, dtype=np.float32)
    model.base = -1.5
    return model


def _cuts(counted: DataFrame, by: str) -> DataFrame:
    """counted: by, bin, n and hits.  Of each value of by: n, hits and the middle of the gap at which F1 is best."""
    down = Window.partitionBy(by).orderBy(F.desc("bin"))
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    run = counted.select(by, "bin", F.lead("bin").over(down).alias("next"), F.sum("n").over(upto).alias("n"), F.sum("hits").over(upto).alias("hits"), F.sum("hits").over(Window.partitionBy(by)).alias("all"))
    middle = F.when(F.col("next").isNull(), F.col("bin") - STEPS).otherwise((F.col("bin") + F.col("next")) / 2)
    best = F.max(F.struct((2 * F.col("hits") / (F.col("n") + F.col("all"))).alias("f1"), F.col("bin").alias("bin"), ((middle + 0.5) / STEPS).alias("cut")))
    return run.groupBy(by).agg(F.max("n").alias("n"), F.max("hits").alias("hits"), best["cut"].alias("cut"))


def calibrate(model: Classifier, rows: DataFrame) -> None:
    """rows: text, lang and toxic.  Sets the shift for all languages and a threshold for each language with enough rows of both labels."""
    shared = rows.sparkSession.sparkContext.broadcast(copy.deepcopy(model))

    def logit(_, texts):
        z = np.zeros(len(texts))
        for i, j in slices(texts, SLICE_BYTES):
            z[i:j] = shared.value.logits(*features(texts.slice(i, j - i)))
        return {"bin": pa.array(np.floor(np.clip(z, -MOST, MOST) * STEPS).astype(np.int32))}

    counted = with_columns(rows.select("text", "lang", "toxic"), "text", logit, {"bin": T.IntegerType()}).groupBy("lang", "bin").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits")).persist()
    whole = _cuts(counted.groupBy(F.lit(1).alias("all_rows"), "bin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")), "all_rows").first()
    model.shift = float(np.log(THRESHOLD / (1 - THRESHOLD))) - whole["cut"]
    enough = (F.col("hits") >= ENOUGH) & (F.col("n") - F.col("hits") >= ENOUGH)
    for r in _cuts(counted.where("lang is not null"), "lang").where(enough).collect():
        model.thresholds[r["lang"]] = 1 / (1 + float(np.exp(-(r["cut"] + model.shift))))
    counted.unpersist()
    shared.unpersist()


def held_out(doc_id="doc_id"):
    """Rows that labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, str | None, int]]:
    """Texts, languages and labels of a bounded sample of the rows that are not held out.

    Of each label at most SAMPLE rows, in the order of a hash of doc_id, and half of SAMPLE_BYTES of their texts: texts of
    more than LONG bytes come last, and one that would overflow what is left is not taken, so that no text displaces the others."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = None
    for label, most in SAMPLE.items():
        part = usable.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    chosen = chosen.select(F.col("doc_id").alias("id"), "toxic")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    # At most SAMPLE rows of distinct doc_ids; repeated rows of a doc_id count once.
    size = F.octet_length("text")
    rows = rows.where(size <= SAMPLE_BYTES // 2).groupBy("doc_id").agg(F.min(F.struct("text", "lang", "toxic")).alias("r")).select("r.*", F.xxhash64("doc_id").alias("h"))
    order = Window.partitionBy("toxic").orderBy(size > LONG, "h", "text").rowsBetween(Window.unboundedPreceding, 0)
    taken = rows.withColumn("sum", F.sum(size).over(order)).where(F.col("sum") <= SAMPLE_BYTES // 2)
    return [(r["text"], r["lang"], r["toxic"]) for r in taken.collect()]


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """shard, text, toxic, lang and back (held back from the steps) of all labelled rows that are not held out; repeated rows of a doc_id count once.  Shards are partitions, in the order of a hash of doc_id."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.where(~held_out()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 + size // SHARD_BYTES
    rows = rows.join(usable, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "toxic")).alias("r"))
    back = F.pmod(F.xxhash64("doc_id", F.lit("back")), F.lit(5)) == 0
    rows = rows.select(F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).cast("int").alias("shard"), F.col("r.text").alias("text"), F.col("r.toxic").alias("toxic"), F.col("r.lang").alias("lang"), back.alias("back"), F.xxhash64("doc_id").alias("h"))
    return rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "h", "text").drop("h")


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """The classifier learnt from all labelled rows."""
    spark = docs.sparkSession
    folder = fresh_dir(spark, "labelled")
    rows = written(labelled_rows(docs, labels), "labelled", folder)
    n = {(r["toxic"], r["back"]): r["n"] for r in rows.groupBy("toxic", "back").agg(F.count("*").alias("n")).collect()}
    count = lambda y, *sides: sum(n.get((y, s), 0) for s in sides)
    if not (count(0, False, True) and count(1, False, True)):
        delete(spark, folder)
        return Classifier()
    apart = min(count(y, s) for y in (0, 1) for s in (False, True)) >= 3
    ahead, back = (rows.where("not back"), rows.where("back")) if apart else (rows, rows)
    ahead = ahead.select("shard", "text", "toxic")
    sides = (False,) if apart else (False, True)
    model = _begin([_shares(ahead, y) for y in (0, 1)], [count(y, *sides) for y in (0, 1)])
    for number in range(EPOCHS):
        _round(ahead, model, number)
    model.trained = True
    calibrate(model, back)
    delete(spark, folder)
    return model


def with_score(docs: DataFrame, model: Classifier, column: str = "score") -> DataFrame:
    """docs and the score of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    return with_columns(docs, "text", lambda _, texts: {column: pa.array(shared.value.scores(texts))}, {column: T.DoubleType()})


def threshold_of(model: Classifier, lang):
    """The threshold of a language column."""
    out = F.lit(THRESHOLD)
    for name, value in sorted(model.thresholds.items()):
        out = F.when(lang == name, F.lit(float(value))).otherwise(out)
    return out


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, and rejected by the threshold of its language."""
    model = fit(docs, labels)
    scored = with_score(docs.select("doc_id", "text", "lang"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), (F.col("score") >= threshold_of(model, F.col("lang"))).alias("rejected"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the threshold of their language rejects."""
    model = fit(docs, labels)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    return with_score(packed, model).where(F.col("score") < threshold_of(model, F.col("row.lang"))).select("row.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity(documents(spark, sf_dir, "doc_id", "text", "lang"), labels)
