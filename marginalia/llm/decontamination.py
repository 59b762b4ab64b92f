"""Benchmark decontamination: rare words of test items lead to documents, and Smith-Waterman scores them.

The words of all texts are lower-cased runs of letters and digits.  An item is aligned with the document's
words (match 2, mismatch -1, gap -1), and the share of the best possible score is the result.  A share of at least THRESHOLD
needs that share of the item's n words matched, and all of these within (3 - 2 * THRESHOLD) * n words of the document.  So of the
n - h + k rarest words of an item (h: the least number of matches), at least k stand in that span, whatever the edits are:
where they do, the stretch of words is looked at with all words of the item: at least h of its words must be the item's within that span, and h of them
with each word counted no oftener than the item has it.  Where they
are, the item is aligned, and no pair at the threshold is missed.  How often a word stands in
the corpus only decides which words are looked up, not what is found.

The test items are a stated query set: they are taken in blocks of BLOCK items and BLOCK_BYTES of text at most (a longer item is a
block of its own), each block in two passes over all documents, so that what a task holds is bounded however large the test table is.

An item of fewer than LEAST words is found only where all its words stand in a row (one of its words would be half of it); it is
reported like any other, but removes no document, as it says too little.  Items without words are never found; null texts are empty; a null item_id or doc_id stays null in
the result; repeated rows of documents are results of their own, and repeated items count once; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import documents
from .words import PUNCTUATION, Words, as_long, per_slice, with_columns, words_of

LEAST = 3
BLOCK = 10_000
BLOCK_BYTES = 8 << 20
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: The share of an item's needed matches that its rare words must show before it is aligned.
SHOWN = 0.25
#: Alignments that are computed together, and the words of all their windows.
TOGETHER = 256
CELLS = 1 << 19
#: Rare words found in a stretch of documents at a time.
HITS = 2_000_000


@dataclass
class Items:
    """A block of test items: their word hashes, and their rare words as (hash, item) sorted by hash; needed of them, and least of all
    words, must stand within span words.  known are the words of all items, and own the pairs of item and word, as item * len(known) + word, each of which
    stands times in the item."""

    ids: list
    words: list[np.ndarray]
    hash: np.ndarray
    item: np.ndarray
    needed: np.ndarray
    span: np.ndarray
    least: np.ndarray
    known: np.ndarray
    own: np.ndarray
    times: np.ndarray


def items_of(rows: list[tuple[object, str | None]]) -> Items:
    """All words of the items; seeds() chooses among them."""
    words = words_of(pa.array([t or "" for _, t in rows], pa.string()), PUNCTUATION, lower=True)
    hashes = words.hashes() if len(words) else np.zeros(0, dtype=np.uint64)
    each = [hashes[i:j] for i, j in zip(words.first[:-1], words.first[1:], strict=True)]
    span = np.floor(words.counts * (3 - 2 * THRESHOLD)).astype(np.int64)
    least = np.where(words.counts < LEAST, words.counts, np.ceil(words.counts * THRESHOLD)).astype(np.int64)
    known, item = np.unique(hashes), words.text_of_word()
    own, times = np.unique(item * len(known) + np.searchsorted(known, hashes), return_counts=True)
    return Items([i for i, _ in rows], each, hashes, item, np.ones(len(rows), dtype=np.int64), span, least, known, own, times)


def counts(docs: DataFrame, items: Items) -> dict[int, int]:
    """How often each word of the items (a bounded block) stands in the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(np.unique(items.hash))

    def run(_, texts):
        known, words = shared.value, words_of(texts, PUNCTUATION, lower=True)
        if not len(known) or not len(words):
            return None
        hashes = words.hashes()
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        n = np.bincount(at[known[at] == hashes], minlength=len(known))
        found = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(as_long(known[found])), pa.array(n[found])], names=["word", "n"])

    made = per_slice(docs.select("text"), "text", run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"] & (2**64 - 1): r["n"] for r in made.collect()}


def seeds(items: Items, frequency: dict[int, int]) -> Items:
    """The rarest words of each item, as many as the needed number of matches leaves no way around."""
    sizes = np.array([len(w) for w in items.words], dtype=np.int64)
    least = np.ceil(sizes * THRESHOLD).astype(np.int64)
    needed = np.maximum(1, np.floor(least * SHOWN).astype(np.int64))
    often = np.array([frequency.get(int(h), 0) for h in items.hash], dtype=np.int64)
    order = np.lexsort((items.hash, often, items.item))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # An item of fewer than LEAST words is needed whole: its rarest word leads to it.
    looked_up = np.where(sizes < LEAST, 1, sizes - least + needed)
    kept = order[rank < np.repeat(looked_up, sizes)]
    pairs = np.unique(np.stack([items.hash[kept], items.item[kept].astype(np.uint64)]), axis=1)
    return replace(items, hash=pairs[0], item=pairs[1].astype(np.int64), needed=needed)


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman of (item, window) pairs of word hashes: the best scores and the places in the window after their last words."""
    wide = max(len(w) for _, w in pairs)
    window = np.zeros((len(pairs), wide), dtype=np.uint64)
    filled = np.zeros((len(pairs), wide), dtype=bool)
    for k, (_, w) in enumerate(pairs):
        window[k, : len(w)] = w
        filled[k, : len(w)] = True
    row = np.zeros((len(pairs), wide + 1), dtype=np.int32)
    best = np.zeros(len(pairs), dtype=np.int32)
    end = np.zeros(len(pairs), dtype=np.int64)
    ramp = np.arange(wide + 1, dtype=np.int32) * GAP
    lengths = np.array([len(i) for i, _ in pairs])
    for m in range(int(lengths.max())):
        word = np.array([i[m] if m < len(i) else 0 for i, _ in pairs], dtype=np.uint64)
        live = (m < lengths)[:, None] & filled
        new = np.zeros_like(row)
        step = np.where((window == word[:, None]) & live, MATCH, MISMATCH)
        np.maximum(row[:, :-1] + step, row[:, 1:] + GAP, out=new[:, 1:])
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new - ramp, axis=1) + ramp  # gaps along the window
        row = np.where(np.concatenate([live[:, :1], live], axis=1), new, 0)
        at = row.argmax(axis=1)
        value = row[np.arange(len(pairs)), at]
        better = value > best
        best[better], end[better] = value[better], at[better]
    return best, end


def matches(words: Words, items: Items) -> list[tuple[int, int, float, int, int]]:
    """(text, item, share, first word, last word) of the best alignment of each text and item at or above THRESHOLD."""
    if not len(items.hash) or not len(words):
        return []
    hashes = words.hashes()
    lo = np.searchsorted(items.hash, hashes)
    hit = np.flatnonzero(items.hash[np.minimum(lo, len(items.hash) - 1)] == hashes)
    lo = lo[hit]
    n = np.searchsorted(items.hash, hashes[hit], side="right") - lo
    jobs = _likely(hashes, items, _windows(words, items, hit, lo, n))
    jobs.sort(key=lambda x: x[3] - x[2])
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    c = 0
    while c < len(jobs):
        part = jobs[c : c + TOGETHER]
        while len(part) > 1 and len(part) * (part[-1][3] - part[-1][2]) > CELLS:
            part = part[: len(part) // 2]
        c += len(part)
        score, end = align([(items.words[k], hashes[a:b]) for _, k, a, b in part])
        share = score / (MATCH * np.array([len(items.words[k]) for _, k, _, _ in part]))
        good = [x for x in range(len(part)) if share[x] >= (THRESHOLD if len(items.words[part[x][1]]) >= LEAST else 1)]
        if good:
            # The first word: the alignment of the reversed words that ends there.
            _, back = align([(items.words[part[x][1]][::-1], hashes[part[x][2] : part[x][2] + int(end[x])][::-1]) for x in good])
            for x, length in zip(good, back.tolist(), strict=True):
                t, k, a, _ = part[x]
                last = a + int(end[x]) - int(words.first[t])
                new = (float(share[x]), last - length, last - 1)
                if (t, k) not in found or (-new[0], new[1]) < (-found[t, k][0], found[t, k][1]):
                    found[t, k] = new
    return [(t, k, *v) for (t, k), v in sorted(found.items())]


def _windows(words: Words, items: Items, hit: np.ndarray, lo: np.ndarray, n: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, item, first, end) of the stretches of words that may hold an item; word hit[i] is that of n[i] items from lo[i]."""
    jobs, widest = [], int(items.span.max())
    total = np.cumsum(n)
    cuts = np.flatnonzero(np.diff(total // HITS, prepend=0)) if len(total) else []
    for i, j in zip([0, *cuts], [*cuts, len(hit)], strict=True):
        if i == j:
            continue
        # Cut stretches overlap by the widest span, so that each span is whole in one of them.
        j = int(np.searchsorted(hit, hit[j - 1] + widest, side="right"))
        m = n[i:j]
        item = items.item[np.repeat(lo[i:j], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
        at = np.repeat(hit[i:j], m)
        key = (np.searchsorted(words.first, at, side="right") - 1) * len(items.ids) + item
        order = np.argsort(key, kind="stable")
        key, item, at = key[order], item[order], at[order]
        last = np.arange(len(at)) + items.needed[item] - 1
        near = np.flatnonzero(last < len(at))
        near = near[(key[last[near]] == key[near]) & (at[last[near]] - at[near] < items.span[item[near]])]
        last, key, item = at[last[near]], key[near], item[near]
        text = key // len(items.ids)
        a = np.maximum(words.first[text], last - items.span[item] + 1)
        b = np.minimum(words.first[text + 1], at[near] + items.span[item])
        new = np.ones(len(near), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (a[1:] > b[:-1])
        first = np.flatnonzero(new)
        end = np.append(first[1:], len(near)) - 1 if len(first) else first
        jobs += zip(text[first].tolist(), item[first].tolist(), a[first].tolist(), b[end].tolist(), strict=True)
    return jobs


def _own_words(items: Items, number: np.ndarray, item: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of stretches of words: (stretch, place, pair of item and word) of the words that are their item's.  number: of each word, -1 for those of no item."""
    size = b - a
    job = np.repeat(np.arange(len(size)), size)
    at = np.repeat(a, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    there = number[at] >= 0
    job, at = job[there], at[there]
    key = item[job] * len(items.known) + number[at]
    pair = np.minimum(np.searchsorted(items.own, key), len(items.own) - 1)
    there = items.own[pair] == key
    return job[there], at[there], pair[there]


def _likely(hashes: np.ndarray, items: Items, jobs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The parts of the stretches in which enough words are the item's within its span."""
    if not jobs:
        return []
    number = np.minimum(np.searchsorted(items.known, hashes), len(items.known) - 1)
    number[items.known[number] != hashes] = -1
    every = np.array(jobs, dtype=np.int64).T
    out = []
    cuts = np.flatnonzero(np.diff(np.cumsum(every[3] - every[2]) // HITS, prepend=0))
    for i, j in zip([0, *cuts], [*cuts, len(jobs)], strict=True):
        if i == j:
            continue
        text, item, a, b = every[:, i:j]
        job, at, _ = _own_words(items, number, item, a, b)
        last = np.arange(len(at)) + items.least[item[job]] - 1
        first = np.flatnonzero(last < len(at))
        first = first[(job[last[first]] == job[first]) & (at[last[first]] - at[first] < items.span[item[job[first]]])]
        if not len(first):
            continue
        last, job = at[last[first]], job[first]
        lo = np.maximum(a[job], last - items.span[item[job]] + 1)
        hi = np.minimum(b[job], at[first] + items.span[item[job]])
        new = np.ones(len(first), dtype=bool)
        new[1:] = (job[1:] != job[:-1]) | (lo[1:] > hi[:-1])
        start = np.flatnonzero(new)
        text, item, lo, hi = text[job[start]], item[job[start]], lo[start], hi[np.append(start[1:], len(new)) - 1]
        # Each word counts no oftener than the item has it.
        job, _, pair = _own_words(items, number, item, lo, hi)
        both, count = np.unique(job * len(items.own) + pair, return_counts=True)
        shared = np.bincount(both // len(items.own), weights=np.minimum(count, items.times[both % len(items.own)]), minlength=len(item))
        kept = shared >= items.least[item]
        out += zip(text[kept].tolist(), item[kept].tolist(), lo[kept].tolist(), hi[kept].tolist(), strict=True)
    return out


def blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The distinct items in blocks of about BLOCK items and BLOCK_BYTES."""
    items = benchmark.select("item_id", "text").distinct()
    rows, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(-(-rows // BLOCK), -(-size // BLOCK_BYTES))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _prepared(docs: DataFrame, block: DataFrame) -> Items:
    rows = sorted(((r["item_id"], r["text"]) for r in block.collect()), key=str)
    items = items_of(rows)
    return seeds(items, counts(docs, items))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs: doc_id, item_id, score, first_word and last_word (places among the document's words, from 0)."""
    spark = docs.sparkSession
    schema = T.StructType([docs.schema["doc_id"], benchmark.schema["item_id"], T.StructField("score", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())])
    out = spark.createDataFrame([], schema)
    item_type = T.StructType([benchmark.schema["item_id"]])
    for block in blocks(benchmark):
        shared = spark.sparkContext.broadcast(_prepared(docs, block))

        def run(part, texts, shared=shared):
            from pyspark.sql.pandas.types import to_arrow_type

            found = matches(words_of(texts, PUNCTUATION, lower=True), shared.value)
            if not found:
                return None
            text, item, score, first, last = zip(*found, strict=True)
            names = pa.array([shared.value.ids[k] for k in item], to_arrow_type(item_type[0].dataType))
            return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), names, pa.array(score), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=schema.names)

        out = out.union(per_slice(docs.select("doc_id", "text"), "text", run, schema))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows in which a test item of LEAST words or more was found."""
    spark, columns = docs.sparkSession, docs.columns
    for block in blocks(benchmark):
        shared = spark.sparkContext.broadcast(_prepared(docs, block))

        def run(_, texts, shared=shared):
            hit = np.zeros(len(texts), dtype=bool)
            found = matches(words_of(texts, PUNCTUATION, lower=True), shared.value)
            hit[[t for t, k, *_ in found if len(shared.value.words[k]) >= LEAST]] = True
            return {"hit": pa.array(hit)}

        packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("text").alias("text"))
        docs = with_columns(packed, "text", run, {"hit": T.BooleanType()}).where("not hit").select("row.*")
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contamination(documents(spark, sf_dir, "doc_id", "text"), benchmark)
