"""Best-fit packing of documents into token sequences, with matching of large pieces.

A piece's place depends on its length alone, so the plan needs only the counts of the lengths 1
to capacity: at most 2048 rows, however large the corpus.  Pieces of over a third of the capacity
are large: from the longest on, each is matched with the longest large one that still fits, so
that no sequence gets more than two.  The rest, from the longest on, go to the fullest sequence
that has room (best fit), and new sequences are opened only where nothing has room.  The plan is a short
list of runs: so many pieces of one length, from a rank among that length on, go to consecutive
sequences at one offset.  Spark ranks the pieces of each length (in parts dealt out by a row number, as one length may hold
a large part of all pieces, all of them equal) and joins them with the runs.

Null and empty texts are pieces of one id (the end id).  Repeated rows are packed each for itself; a null
doc_id stays null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import cut, documents
from .tokens import SLICE_BYTES, encoder, public_path
from .words import bounded, slices

CAPACITY = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
#: A length is ranked in parts: of at most so many pieces, and of at most one in PARTS of all pieces.
PART_ROWS = 1_000_000
PARTS = 1000

_RUN = "length int, from_rank long, n long, each long, first_sequence long, at long"


def pieces_of(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece of each document: doc_id, piece, start, length, ids_crc32, and the ids if asked for."""
    kind = docs.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches):
        encode = encoder(public_path(vocabulary), END_ID).encode
        for batch in batches:
            for i, j in slices(batch.column(1), SLICE_BYTES):
                ids, offsets = encode(batch.column(1).slice(i, j - i))
                total = np.diff(offsets)
                n = -(-total // capacity)
                doc = np.repeat(np.arange(j - i), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                first = (total - capacity * (n - 1))[doc]
                start = np.where(piece == 0, 0, first + capacity * (piece - 1))
                length = np.where(piece == 0, first, capacity)
                begin = offsets[doc] + start
                data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                made = [batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    made.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)).astype(np.int32)), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(made, names=[f.name for f in fields])
        encoder.cache_clear()  # the worker goes on to other tasks
        pa.default_memory_pool().release_unused()

    return bounded(docs.select("doc_id", "text")).mapInArrow(run, T.StructType(fields))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, from_rank, n, each, first_sequence, at): the n pieces of that length from that
    rank on go, `each` to a sequence, to the sequences from first_sequence on, at the offset `at` and behind one another."""
    left = {s: n for s, n in counts.items() if n}
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # free length: (first sequence, number of sequences)
    gaps: list[int] = []
    opened = 0

    def put(size: int, n: int, each: int, first: int, at: int) -> None:
        runs.append((size, rank[size], n, each, first, at))
        rank[size] += n
        left[size] -= n

    def room(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in rooms:
                rooms[gap] = []
                insort(gaps, gap)
            rooms[gap].append((first, n))

    large = sorted(s for s in left if 3 * s > capacity)
    for a in reversed(large):
        while left[a]:
            b = next((s for s in reversed(large[: bisect_left(large, capacity - a + 1)]) if left[s] > (s == a)), None)
            n = left[a] if b is None else min(left[a], left[b]) if b != a else left[a] // 2
            put(a, n, 1, opened, 0)
            if b is not None:
                put(b, n, 1, opened, a)
            room(capacity - a - (b or 0), opened, n)
            opened += n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            k = bisect_left(gaps, s)
            if k == len(gaps):
                each = min(left[s], capacity // s)
                n = left[s] // each
                room(capacity, opened, n)
                opened += n
                continue
            gap = gaps[k]
            first, n = rooms[gap].pop()
            if not rooms[gap]:
                del rooms[gap], gaps[k]
            each = min(gap // s, left[s])
            use = min(n, left[s] // each)
            put(s, use * each, each, first, capacity - gap)
            room(gap - each * s, first, use)
            room(gap, first + use, n - use)
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces and the columns sequence_id and offset; it needs doc_id, piece, start, ids_crc32 and length, none above capacity."""
    spark = pieces.sparkSession
    columns = pieces.columns
    pieces = cut(pieces.withColumn("row", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = spark.createDataFrame(plan(counts, capacity), _RUN)
    # At most `capacity` rows, as the counts.
    most = max(1, min(PART_ROWS, -(-sum(counts.values()) // PARTS)))
    parts = F.broadcast(spark.createDataFrame([(k, -(-n // most)) for k, n in counts.items()], "length long, parts long"))
    salted = pieces.join(parts, "length").withColumn("salt", F.pmod(F.xxhash64("row"), "parts").cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")) - 1)
    ranked = ranked.join(base, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    # The runs are bounded by the capacity: a few for each length.
    runs = F.broadcast(runs.withColumnRenamed("length", "of"))
    placed = ranked.join(runs, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("from_rank") + F.col("n")))
    j = F.col("rank") - F.col("from_rank")
    return placed.select(
        *[F.col(c) for c in columns],
        (F.col("first_sequence") + F.floor(j / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(j, F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    return pack(pieces_of(docs, vocabulary, capacity, with_ids), capacity)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir, "doc_id", "text"))
