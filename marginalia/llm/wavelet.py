"""Token shards as wavelet matrices: one file holds the bit planes of a shard's ids and answers
access, rank, count and select without being unpacked.

Documents are dealt out by ranges of doc_id (and by a hash of the text within one doc_id, so that
repeated ids split too), each range is one shard, and each task writes its shard under a name of its
own and then renames it: a task that runs again writes the same file.  The ids of a shard are
numbered by its own sorted alphabet, so that it has no more planes than that needs.

File: magic, header length (both 8 bytes), JSON header, then the sections it names, all little-endian: alphabet, doc_ids,
doc_null, starts, the planes (packed bits, high bit first) and their ranks (ones before each block).

Null and empty texts hold the end id alone.  doc_id must be of an integer type (anything else is a TypeError); a null one sorts first; repeated rows stay, in the order of their
texts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import cut, documents, fresh_dir
from .tokens import encoder, public_path
from .words import bounded, slices

END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Bytes of text of a shard, and rows of one (a table of short or empty texts is split by rows).
SHARD_BYTES = 16 << 20
SHARD_ROWS = 200_000
#: Shards whose counts are summed in one task.
SHARDS_OF_A_SUM = 4096
#: Bytes of text that are encoded at a time, and distinct chunks that a worker remembers.
SLICE_BYTES = 12 << 20
REMEMBERED = 1_000_000
#: Bits of a block of the rank directory.
BLOCK = 512
MAGIC = b"WMATRIX1"


class WaveletMatrix:
    """Bit planes of numbers below 2 ** planes; plane 0 holds the highest bit, and each next plane holds
    the numbers with those of bit 0 moved ahead of those of bit 1."""

    def __init__(self, n: int, bits: np.ndarray, ranks: np.ndarray, alphabet: np.ndarray):
        self.n, self.bits, self.ranks, self.alphabet = n, bits, ranks, alphabet
        self.zeros = [n - self._ones(k, n) for k in range(len(bits))]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        used = np.zeros(int(ids.max()) + 1 if len(ids) else 0, dtype=bool)
        used[ids] = True
        alphabet = np.flatnonzero(used).astype(np.uint32)
        number = np.zeros(len(used), dtype=np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        number[alphabet] = np.arange(len(alphabet))
        rest = number[ids] if len(ids) else number
        planes = max(1, (len(alphabet) - 1).bit_length()) if len(alphabet) else 0
        n, width = len(ids), -(-len(ids) // BLOCK) * BLOCK // 8
        bits = np.zeros((planes, width), dtype=np.uint8)
        for k in range(planes):
            one = (rest >> (planes - 1 - k)) & 1 != 0
            packed = np.packbits(one)
            bits[k, : len(packed)] = packed
            rest = np.concatenate([rest[~one], rest[one]])
        ranks = np.zeros((planes, width * 8 // BLOCK + 1), dtype=np.uint32)
        if width:
            np.cumsum(np.bitwise_count(bits.view(np.uint64)).reshape(planes, -1, BLOCK // 64).sum(axis=2, dtype=np.uint32), axis=1, out=ranks[:, 1:])
        return cls(n, bits, ranks, alphabet)

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before place i."""
        block, byte = i // BLOCK, i // 8
        count = int(self.ranks[k, block]) + int(np.bitwise_count(self.bits[k, block * BLOCK // 8 : byte]).sum())
        return count + (int(self.bits[k, byte]) >> (8 - i % 8)).bit_count() if i % 8 else count

    def _bit(self, k: int, i: int) -> int:
        return int(self.bits[k, i // 8]) >> (7 - i % 8) & 1

    def __len__(self) -> int:
        return self.n

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(len(self.bits)):
            bit, ones = self._bit(k, i), self._ones(k, i)
            value = 2 * value + bit
            i = self.zeros[k] + ones if bit else i - ones
        return int(self.alphabet[value])

    def _number(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def _range(self, number: int, lo: int, hi: int) -> tuple[int, int]:
        for k in range(len(self.bits)):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if number >> (len(self.bits) - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """How often the id stands before place i."""
        number = self._number(token)
        if number is None:
            return 0
        lo, hi = self._range(number, 0, min(max(i, 0), self.n))
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, k: int, bit: int, j: int) -> int:
        """The place of the j-th (from 0) such bit of plane k."""
        before = self.ranks[k].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(before, j, side="right")) - 1
        inside = np.unpackbits(self.bits[k, block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(inside == bit)[j - int(before[block])])

    def select(self, token: int, j: int) -> int:
        """The place of the j-th (from 0) occurrence of the id, -1 if there are fewer."""
        number = self._number(token)
        if number is None:
            return -1
        lo, hi = self._range(number, 0, self.n)
        if not 0 <= j < hi - lo:
            return -1
        i = lo + j
        for k in reversed(range(len(self.bits))):
            bit = number >> (len(self.bits) - 1 - k) & 1
            i = self._select_bit(k, bit, i - self.zeros[k] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids, from the planes."""
        values = np.zeros(self.n, dtype=np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for k in reversed(range(len(self.bits))):
            one = np.unpackbits(self.bits[k], count=self.n).view(bool)
            out = np.empty_like(values)
            out[~one] = values[: self.zeros[k]]
            out[one] = values[self.zeros[k] :] | values.dtype.type(1 << (len(self.bits) - 1 - k))
            values = out
        return self.alphabet[values] if self.n else self.alphabet[:0]


def to_bytes(matrix: WaveletMatrix, doc_ids: np.ndarray, doc_null: np.ndarray, starts: np.ndarray) -> bytes:
    sections = {"alphabet": matrix.alphabet.astype("<u4"), "doc_ids": doc_ids.astype("<i8"), "doc_null": doc_null.astype("u1"), "starts": starts.astype("<i8"), "bits": matrix.bits, "ranks": matrix.ranks.astype("<u4")}
    header = json.dumps({"n": matrix.n, "planes": len(matrix.bits), "sections": [[k, v.dtype.str, v.size] for k, v in sections.items()]}).encode()
    return b"".join([MAGIC, len(header).to_bytes(8, "little"), header, *[v.tobytes() for v in sections.values()]])


def from_bytes(data) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray]:
    """The matrix, doc_ids, doc_null and starts of a file."""
    data = memoryview(data)
    if data[:8] != MAGIC:
        raise ValueError("not a wavelet shard")
    at = 16 + int.from_bytes(data[8:16], "little")
    header, found = json.loads(bytes(data[16:at])), {}
    for name, kind, size in header["sections"]:
        found[name] = np.frombuffer(data, dtype=kind, count=size, offset=at)
        at += found[name].nbytes
    bits, ranks = (found[k].reshape(header["planes"], -1) if header["planes"] else found[k].reshape(0, 0) for k in ("bits", "ranks"))
    matrix = WaveletMatrix(header["n"], bits, ranks, found["alphabet"])
    return matrix, found["doc_ids"], found["doc_null"].astype(bool), found["starts"]


def _put(folder: str, name: str, data: bytes) -> None:
    """Writes a file of the shared folder whole or not at all."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{path}/{name}")


def write_shards(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes shard-NNNNNN.wm files in ascending order of doc_id.  Returns per shard: shard, n_docs, n_tokens, start.
    docs is read from files or a checkpoint, whose rows have the same numbers when a task is run again: equal rows are dealt out by them."""
    kind = docs.schema["doc_id"].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise TypeError(f"doc_id must be an integer, not {kind}")  # the files hold 64-bit ids
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    n = max(1, -(-total // shard_bytes), -(-rows // SHARD_ROWS))
    dealt = docs.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(n, "doc_id", F.xxhash64("text"), "row").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches):
        encode = encoder(public_path(vocabulary), END_ID, REMEMBERED).encode
        ids, counts, names, nulls = [], [], [], []
        for batch in batches:
            for i, j in slices(batch.column(1), SLICE_BYTES):
                made, offsets = encode(batch.column(1).slice(i, j - i))
                ids.append(made.astype(np.uint16) if made.max() < 1 << 16 else made)
                counts.append(np.diff(offsets))
                name = batch.column(0).slice(i, j - i)
                nulls.append(np.asarray(name.is_null()))
                names.append(np.asarray(name.fill_null(0)))
        if not ids:
            return
        shard = TaskContext.get().partitionId()
        counts, ids = np.concatenate(counts), np.concatenate(ids)
        starts = np.append(0, np.cumsum(counts))
        _put(folder, f"shard-{shard:06d}.wm", to_bytes(WaveletMatrix.build(ids), np.concatenate(names), np.concatenate(nulls), starts))
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([len(counts)], pa.int64()), pa.array([len(ids)], pa.int64())], names=["shard", "n_docs", "n_tokens"])

    shards = cut(bounded(dealt).mapInArrow(run, "shard long, n_docs long, n_tokens long"))
    # Sums before each shard: within blocks of shards, and of the blocks before (a row a block).
    shards = shards.withColumn("block", F.expr(f"shard div {SHARDS_OF_A_SUM}"))
    within = F.sum("n_tokens").over(Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    before = F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = shards.groupBy("block").agg(F.sum("n_tokens").alias("n")).select("block", F.coalesce(before, F.lit(0)).alias("before"))
    return shards.withColumn("within", F.coalesce(within, F.lit(0))).join(blocks, "block").select("shard", "n_docs", "n_tokens", (F.col("before") + F.col("within")).alias("start"))


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: shard, doc_id, at (ids before it in the shard), n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.wm").load(folder)
    files = files.select(F.regexp_extract("path", r"shard-(\d+)\.wm$", 1).cast("long").alias("shard"), "content")

    def run(batches):
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                matrix, names, nulls, starts = from_bytes(content.as_buffer())
                data = memoryview(matrix.decode().astype("<u4")).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), shard)), pa.array(names, mask=nulls), pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame) -> DataFrame:
    """Writes the shards and reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = fresh_dir(spark, "wavelet")
    shards = write_shards(docs, folder)
    if shards.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    found = read_shards(spark, folder).join(shards.select("shard", "start"), "shard")
    return found.select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op8_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(documents(spark, sf_dir, "doc_id", "text"))
