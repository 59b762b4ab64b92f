"""Near-duplicates by SimHash: exact comparison of fingerprints in tiles.

A fingerprint has 64 bits over the XXH64 hashes of a text's 4-word shingles.  Two documents are
linked if their fingerprints differ in at most RADIUS bits, and the components of those links are
the groups.  The links are exact: with the bits cut into RADIUS + 2 blocks, two linked
fingerprints agree in at least two blocks, so each fingerprint goes to one cell for each pair of
blocks (the values of both), and cells are compared whole.  Only distinct fingerprints are
compared, so a group of copies of any size is one row.

Every cell of three or more is compared in tiles: its fingerprints are sorted by population count, strips of STRIP are xored with those that
are left and their bits counted, and what lies beyond the radius of a strip in population count is skipped, as it can't hold a link; only
a spanning forest of the links is kept.  A cell of more than TILE fingerprints is dealt out as tiles of its
population counts, a pair of tiles a task, and pairs whose population counts differ beyond the radius are never made.

Nulls and texts without words have the fingerprint zero, linked like any other; a null doc_id
stays and is never the smallest of its group unless all are null; repeated rows stay; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .storage import cut, documents, written
from .words import as_long, with_columns, words_of

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Fingerprints of a cell, or of one population count of a large cell, that are compared in one task.
TILE = 4096
#: Rows of a tile that are compared at a time.
STRIP = 64
#: A component of more than one in HOT of all fingerprints is not dealt out by its root.
HOT = 1000


def fingerprints_of(texts: pa.Array) -> np.ndarray:
    """The signed fingerprints of a slice of texts."""
    words = words_of(texts, lower=True)
    data, start, end = words.joined()
    out = np.zeros(len(words.first) - 1, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for d, (i, j) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        if i == j:
            continue
        last = max(i + 1, j - SHINGLE + 1)
        hashes = np.fromiter((digest(data[a:b], SEED) for a, b in zip(start[i:last].tolist(), end[min(i + SHINGLE, j) - 1 : j].tolist(), strict=False)), dtype="<u8", count=last - i)
        ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[d] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return as_long(out)


def with_fingerprint(docs: DataFrame, column: str = "fingerprint", text: str = "text") -> DataFrame:
    """docs and the signed 64-bit fingerprint of each text."""
    return with_columns(docs, text, lambda _, texts: {column: pa.array(fingerprints_of(texts))}, {column: T.LongType()})


def _blocks(fingerprint) -> list:
    """RADIUS + 2 disjoint bit blocks of a 64-bit column."""
    n, out, at = RADIUS + 2, [], 0
    for i in range(n):
        width = 64 // n + (i < 64 % n)
        out.append((F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1)), width))
        at += width
    return out


def _cells(distinct: DataFrame) -> DataFrame:
    """(cell, pop, fp): a row for each pair of blocks; cell holds the number of the pair and the values of its blocks."""
    blocks = _blocks(F.col("fp"))
    cells = []
    for k, ((a, _), (b, width)) in enumerate(combinations(blocks, 2)):
        cells.append(F.shiftleft(F.shiftleft(a, width).bitwiseOR(b), 6).bitwiseOR(F.lit(k)))
    return distinct.select("fp", F.bit_count("fp").alias("pop"), F.explode(F.array(*cells)).alias("cell"))


def _tiles(cells: DataFrame) -> DataFrame:
    """cells with the columns a and b, the two tiles that are compared; rows of small cells stand once, those alone in a cell are left out."""
    counts = cells.groupBy("cell", "pop").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("cell").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("pop", F.ceil(F.col("n") / TILE).cast("int")))).alias("cut"))
    sizes = sizes.where("n > 1").select("cell", F.when(F.col("n") > TILE, F.col("cut")).alias("cut"))
    rows = cells.join(sizes, "cell")
    near = F.expr(f"""
        flatten(transform(sequence(pop - {RADIUS}, pop + {RADIUS}), q ->
            transform(sequence(1, coalesce(cut[q], 0)), t -> q * 1000000L + t)))""")
    near = F.filter(near, lambda x: x % 1000000 > 0)
    own = F.expr("pop * 1000000L + pmod(xxhash64(fp), cut[pop]) + 1")
    rows = rows.withColumn("own", F.when(F.col("cut").isNotNull(), own).otherwise(F.lit(0)))
    rows = rows.withColumn("other", F.explode(F.when(F.col("cut").isNotNull(), near).otherwise(F.array(F.lit(0).cast("long")))))
    return rows.select("cell", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between some distinct fingerprints, as pairs of places: each
    strip of reached places is compared with all that are not reached yet."""
    pops = np.bitwise_count(fps)
    order = np.argsort(pops, kind="stable")
    fps, pops = fps[order], pops[order].astype(np.int16)
    rest = np.arange(len(fps))
    links = []
    while len(rest) > 1:
        wave, rest = rest[:1], rest[1:]
        # Sorted by population count: what lies beyond the radius of the strip is skipped.
        while len(wave) and len(rest):
            strip, wave = wave[:STRIP], wave[STRIP:]
            lo = np.searchsorted(pops[rest], pops[strip].min() - RADIUS, side="left")
            hi = np.searchsorted(pops[rest], pops[strip].max() + RADIUS, side="right")
            near = np.bitwise_count(fps[strip][:, None] ^ fps[rest[lo:hi]][None, :]) <= RADIUS
            hit = near.any(axis=0)
            if hit.any():
                found = rest[lo:hi][hit]
                links += zip(order[strip[near[:, hit].argmax(axis=0)]].tolist(), order[found].tolist(), strict=True)
                rest = np.concatenate([rest[:lo], rest[lo:hi][~hit], rest[hi:]])
                wave = np.concatenate([wave, found])
    return links


def _links_of(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys."""
    bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    size = np.diff(bounds)
    left, right = [], []
    pairs = bounds[:-1][size == 2]
    close = pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= RADIUS]
    left.append(fps[close])
    right.append(fps[close + 1])
    for i, n in zip(bounds[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
        part = fps[i : i + n]
        if found := _forest(part):
            at = np.array(found)
            left.append(part[at[:, 0]])
            right.append(part[at[:, 1]])
    return np.concatenate(left), np.concatenate(right)


def _compare(batches):
    """Rows come sorted by cell and tiles; a group may go on in the next batch."""
    kept = None
    for batch in batches:
        table = pa.table([batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names)
        kept = table if kept is None else pa.concat_tables([kept, table])
        cols = [np.asarray(kept[c].combine_chunks()) for c in ("cell", "a", "b")]
        new = np.zeros(len(kept), dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        last = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if last:
            yield from _found(new[:last], kept["fp"].slice(0, last))
            kept = kept.slice(last)
    if kept is not None and len(kept):
        cols = [np.asarray(kept[c].combine_chunks()) for c in ("cell", "a", "b")]
        new = np.zeros(len(kept), dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        yield from _found(new, kept["fp"])


def _found(new: np.ndarray, fps) -> list[pa.RecordBatch]:
    left, right = _links_of(np.cumsum(new), np.asarray(fps.combine_chunks()).view(np.uint64))
    return [pa.RecordBatch.from_arrays([pa.array(as_long(left)), pa.array(as_long(right))], names=["a", "b"])] if len(left) else []


def links(distinct: DataFrame) -> DataFrame:
    """distinct: fingerprints (fp), each once.  Returns links (a, b) that connect the same fingerprints as all pairs within the radius do."""
    tiles = _tiles(_cells(distinct))
    dealt = tiles.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b")
    return dealt.mapInArrow(_compare, "a long, b long")


def groups(rows: DataFrame) -> DataFrame:
    """rows: doc_id and fp, already cut.  Returns (fp, root, component_id) for each fingerprint: the component's smallest fingerprint and doc_id.

    A component with more than one in HOT of all fingerprints is hot: there are fewer than HOT of them however large the table is, so they
    are broadcast, and their fingerprints never meet in one task."""
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    linked = connected_components(links(classes.select("fp")))
    rooted = cut(classes.join(linked, classes.fp == linked.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "low"))
    smallest = cut(rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n")))
    total = smallest.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(smallest.where(F.col("n") * HOT > total).select("root", "component_id"))  # fewer than HOT rows
    out = [rooted.join(hot, "root"), rooted.join(hot, "root", "left_anti").join(smallest, "root")]
    return out[0].select("fp", "root", "component_id").union(out[1].select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint in 16 hex digits, component_id."""
    rows = cut(with_fingerprint(docs.select("doc_id", "text"), "fp").select("doc_id", "fp"))
    return rows.join(groups(rows), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: that with the smallest doc_id (a null one last), of equal doc_ids that with the smaller hash of the
    whole row.  The rows are written once with their fingerprints and a number; the choice is made among numbers, and the texts
    are shuffled once."""
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(*hashed).alias("hash"), F.col("text").alias("text"))
    # The number is fixed by the table that is written, so a task that runs again can't change it.
    table = written(with_fingerprint(packed, "fp").select("row", "hash", "fp", F.monotonically_increasing_id().alias("number")), "fingerprints")
    rows = cut(table.select(F.col("row.doc_id").alias("doc_id"), "hash", "fp", "number"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash", "number")
    first = rows.groupBy("fp").agg(F.min(order).alias("first")).join(groups(rows), "fp")
    chosen = first.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.number").alias("number"))
    return table.join(chosen, "number").select("row.*")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
