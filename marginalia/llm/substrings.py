"""Removal of repeated passages: every word in a window of LENGTH words that also starts elsewhere goes.

Anchors.  The places of a document's words modulo PERIOD that lie in COVER form a difference cover:
for any two places there is a shift below PERIOD that brings both onto cover places.  So if the
same LENGTH words start at two places, both have a cover place at the same shift, and there the same
ANCHOR = LENGTH - PERIOD + 1 words.  Only 5 of 21 windows of ANCHOR words are hashed and shuffled.

Extension.  Around each anchor that stands at two places or more, the windows of LENGTH words that
hold it are hashed (96 bits) and counted; those that stand twice are repeats.  As each window is counted with
all its partners, no pair is ever formed and a passage that a third of all documents share costs a row a task.

Before a shuffle each task settles what it can: a hash that stands twice in it is repeated, so its
places are flagged there and then, only one row goes out to tell others, and its further places are dealt out evenly.  Exact
copies beyond the second in a task send nothing.

A document is known by a 64-bit hash of its words, so copies (and repeated rows) share their flags.  Null texts have no words; a null
doc_id stays; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import documents, written
from .words import _WORD_BASE, U64, Words, _span_hash, _sums, as_long, bounded, mix, slices, with_columns, words_of

LENGTH = 35
PERIOD = 21
#: A perfect difference set modulo 21.
COVER = (3, 6, 7, 12, 14)
ANCHOR = LENGTH - PERIOD + 1

#: A row asks whether its hash stands elsewhere, tells that it does (and is flagged itself), or is flagged and needs no other.
ASKS, TELLS, SETTLED = 0, 1, 2
_ROW = "key long, doc long, tag long"


def doc_keys(words: Words, hashes: np.ndarray) -> np.ndarray:
    return _span_hash(_sums(hashes, _WORD_BASE), words.first[:-1], words.first[1:], _WORD_BASE)


class _Task:
    """What a task has seen: how often each document, and the hashes it has told."""

    def __init__(self):
        self.seen: dict[int, int] = {}
        self.told = np.zeros(0, dtype=np.uint64)

    def rows(self, keys: np.ndarray, text: np.ndarray, place: np.ndarray, hash_: np.ndarray, check: np.ndarray) -> pa.RecordBatch:
        """keys of the slice's documents; and for each window its text, place in the text, hash and second hash."""
        times = np.zeros(len(keys), dtype=np.int64)
        for d, key in enumerate(keys.tolist()):
            times[d] = self.seen.get(key, 0)
            self.seen[key] = times[d] + 1
        use = times[text] < 2
        text, place, hash_, check = text[use], place[use], hash_[use], check[use]
        order = np.argsort(hash_, kind="stable")
        same = (hash_[order[1:]] == hash_[order[:-1]]) & (check[order[1:]] == check[order[:-1]])
        again, twice = np.zeros(len(order), dtype=bool), times[text] == 1
        again[order[1:]] = same
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        known = np.isin(hash_, self.told)
        kind = np.where(twice | known, np.where(again | known, SETTLED, TELLS), ASKS)
        self.told = np.union1d(self.told, hash_[kind == TELLS])
        doc = keys[text]
        # The rows stay in the order of the documents, in which a shuffle's blocks compress better.
        key = np.where(kind == SETTLED, mix(doc + place.astype(np.uint64)), hash_)
        tag = (check >> U64(32) << U64(32)) | (place.astype(np.uint64) << U64(2)) | kind.astype(np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(as_long(key)), pa.array(as_long(doc)), pa.array(as_long(tag))], names=["key", "doc", "tag"])


def _hash(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """A hash of the windows of k words from each place on."""
    return _span_hash(_sums(hashes, _WORD_BASE), at, at + k, _WORD_BASE)


def _anchors(batches):
    task = _Task()
    for batch in batches:
        for i, j in slices(batch.column(0)):
            words = words_of(batch.column(0).slice(i, j - i))
            hashes = words.hashes()
            text = words.text_of_word()
            place = np.arange(len(words)) - words.first[text]
            last = words.counts[text] - ANCHOR
            at = np.flatnonzero(np.isin(place % PERIOD, COVER) & (place <= last) & (words.counts[text] >= LENGTH))
            if len(at):
                yield task.rows(doc_keys(words, hashes), text[at], place[at], _hash(hashes, at, ANCHOR), np.zeros(len(at), dtype=np.uint64))  # a false anchor costs work only


def _windows(batches):
    """Batches of text and places of repeated anchors."""
    task = _Task()
    for batch in batches:
        for i, j in slices(batch.column(0)):
            words = words_of(batch.column(0).slice(i, j - i))
            hashes = words.hashes()
            anchors = batch.column(1).slice(i, j - i)
            owner = np.repeat(np.arange(j - i), np.diff(np.asarray(anchors.offsets)))
            at = np.asarray(anchors.flatten()) + words.first[owner]
            # A window holds an anchor from PERIOD - 1 words before it on.
            change = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(change, np.maximum(at - (PERIOD - 1), words.first[owner]), 1)
            np.add.at(change, at + 1, -1)
            text = words.text_of_word()
            place = np.arange(len(words)) - words.first[text]
            at = np.flatnonzero((np.cumsum(change)[:-1] > 0) & (place <= words.counts[text] - LENGTH))
            if len(at):
                yield task.rows(doc_keys(words, hashes), text[at], place[at], _hash(hashes, at, LENGTH), _hash(mix(hashes + U64(0x5851F42D4C957F2D)), at, LENGTH))


def _repeated(rows: DataFrame) -> DataFrame:
    """doc and its places whose windows stand elsewhere too."""
    kind = F.col("tag").bitwiseAND(F.lit(3))
    rows = rows.withColumn("check", F.shiftright("tag", 32)).withColumn("settled", kind == SETTLED)
    n = F.count("*").over(Window.partitionBy("key", "check", "settled"))  # at most a row a task
    flagged = rows.withColumn("n", n).where((kind != ASKS) | (F.col("n") > 1))
    place = F.shiftright(F.col("tag").bitwiseAND(F.lit(0xFFFFFFFF)), 2).cast("int")
    return flagged.select("doc", place.alias("place")).groupBy("doc").agg(F.collect_set("place").alias("places"))


def _judge(_, texts: pa.Array) -> dict[str, pa.Array]:
    words = words_of(texts)
    data, start, end = words.joined()
    sha = [hashlib.sha256(data[start[i] : end[j - 1]] if j > i else b"").hexdigest() for i, j in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
    return {"doc": pa.array(as_long(doc_keys(words, words.hashes()))), "n_words": pa.array(words.counts), "sha": pa.array(sha)}


def _kept(places, words: Words, d: int, data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[int, bytes]:
    """How many words of text d are removed, and the kept ones joined."""
    i, n = int(words.first[d]), int(words.counts[d])
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, places, 1)
    np.add.at(change, places + LENGTH, -1)
    gone = np.cumsum(change)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.r_[True, gone, True]))
    runs = [data[start[i + a] : end[i + b - 1]] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
    return int(gone.sum()), b" ".join(runs)


def deduplicate(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (and the kept words as text)."""
    docs = docs.select("doc_id", "text")
    long = docs.select("text").where(F.length("text") > 2 * (LENGTH - 1))
    anchors = written(_repeated(bounded(long).mapInArrow(_anchors, _ROW)), "anchors")
    judged = with_columns(docs, "text", _judge, {"doc": T.LongType(), "n_words": T.LongType(), "sha": T.StringType()})
    kept_text = F.col("text") if with_text else F.when(F.col("places").isNotNull(), F.col("text"))
    judged = written(judged.join(anchors, "doc", "left").select("doc_id", "doc", "n_words", "sha", kept_text.alias("text"), "places"), "judged")
    repeats = written(_repeated(bounded(judged.where("places is not null").select("text", "places")).mapInArrow(_windows, _ROW)), "repeats")
    fields = [docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())] + ([T.StructField("text", T.StringType())] if with_text else [])

    def finish(batches):
        for batch in batches:
            for i, j in slices(batch.column(1)):
                part = batch.slice(i, j - i)
                words = words_of(part.column(1))
                data, start, end = words.joined()
                removed, sha, texts = [], part.column(3).to_pylist(), []
                for d, places in enumerate(part.column(4)):
                    at = np.asarray(places.values) if places.is_valid else np.zeros(0, dtype=np.int64)
                    n, kept = _kept(at, words, d, data, start, end) if len(at) or with_text else (0, b"")
                    if len(at):
                        sha[d] = hashlib.sha256(kept).hexdigest()
                    removed.append(n)
                    texts.append(kept.decode())
                made = [part.column(0), part.column(2), pa.array(removed, pa.int64()), pa.array(sha, pa.string())] + ([pa.array(texts, pa.string())] if with_text else [])
                yield pa.RecordBatch.from_arrays(made, names=[f.name for f in fields])

    found = judged.drop("places").join(repeats, "doc", "left").select("doc_id", "text", "n_words", "sha", F.transform("places", lambda x: x.cast("long")).alias("places"))
    return bounded(found).mapInArrow(finish, T.StructType(fields))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(documents(spark, sf_dir, "doc_id", "text"))


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS ws FROM documents),
win AS (SELECT r, i, hash(array_to_string(ws[i:i + 34], ' ')) AS h, md5(array_to_string(ws[i:i + 34], ' ')) AS m FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h, m) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT r, i + o AS p FROM rep, (SELECT unnest(range(0, 35)) AS o)),
word AS (SELECT r, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS w FROM d),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
