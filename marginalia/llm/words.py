"""Words of a batch of texts as numpy arrays, and 64-bit hashes of words and of word windows.

Everything here works on one slice of an Arrow batch (a few MB of text); Spark deals the
batches out.  Nulls count as empty texts.  Hashes depend on the bytes alone, so that tasks
on different machines agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text that are worked on at a time; a longer text is a slice of its own.  Two workers of an executor share some hundred MB.
SLICE_BYTES = 2 << 20

#: Bytes of an Arrow batch between the JVM and a Python worker.
BATCH_BYTES = "16m"

U64 = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """True at the bytes of the given inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


#: Complement of the word class [^\x20\x09-\x0D].
SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))
#: Complement of the word class [^\x00-\x2F\x3A-\x60\x7B-\x7F]: ASCII letters (lower case), digits and all beyond ASCII stay.
PUNCTUATION = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Lower case of A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of SplitMix64: spreads every input bit over all output bits."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U64(_BYTE_BASE))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        steps = np.full(max(n + 1, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if len(have) <= 2 * SLICE_BYTES:
            _powers[base] = have
    return have


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base ** i; a window's hash is a difference of two, shifted back."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power(base, len(values))[: len(values)], out=out[1:], dtype=np.uint64)
    return out


def _span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    back = pow(base, -1, 1 << 64)
    return mix((sums[end] - sums[start]) * _power(back, len(sums))[start] + (end - start).astype(np.uint64))


class Words:
    """The words of some texts: byte spans in one buffer; first[d]:first[d + 1] are those of text d."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        self.buf, self.offsets = buf, offsets
        n = len(buf)
        inside = ~separators[buf]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0], after[-1] = False, False
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & ~(before & ~edge[:-1]))
        self.end = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return _span_hash(_sums(_BYTE_VALUES[self.buf], _BYTE_BASE), self.start, self.end, _BYTE_BASE)

    def windows(self, k: int) -> np.ndarray:
        """The starts of all windows of k words within one text."""
        last = np.repeat(self.first[1:], self.counts) - k
        at = np.arange(len(self))
        return at[at <= last]

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one space after each, and where each starts and ends there."""
        length = self.end - self.start
        start = np.zeros(len(length) + 1, dtype=np.int64)
        np.cumsum(length + 1, out=start[1:])
        out = np.full(start[-1], 0x20, dtype=np.uint8)
        keep = np.zeros(len(self.buf) + 1, dtype=np.int8)
        keep[self.start] += 1
        np.add.at(keep, self.end, -1)
        place = np.ones(start[-1], dtype=bool)
        place[start[1:] - 1] = False
        out[place] = self.buf[np.cumsum(keep[:-1], dtype=np.int8).astype(bool)]
        return out.tobytes(), start[:-1], start[:-1] + length


def window_hash(word_hashes: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each start on."""
    return _span_hash(_sums(word_hashes, _WORD_BASE), start, start + k, _WORD_BASE)


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes of text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).cast(pa.int64()))
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield begin, i
            begin, total = i, 0
        total += int(size)
    if begin < len(sizes):
        yield begin, len(sizes)


def buffer_of(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where its rows start; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, dtype=np.uint8)
    return (LOWER[buf] if lower else buf), offsets - offsets[0]


def words_of(column: pa.Array, separators: np.ndarray = SPACE, lower: bool = False) -> Words:
    return Words(*buffer_of(column, lower), separators)


def bounded(docs: DataFrame) -> DataFrame:
    """docs, with the batches that go to Python workers bounded in bytes."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return docs


def per_slice(docs: DataFrame, column: str, work: Callable[[pa.RecordBatch, pa.Array], pa.RecordBatch | None], schema: T.StructType | str) -> DataFrame:
    """Applies `work` to slices of the Arrow batches of docs; it gets the slice and its text column."""

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column))
            for i, j in slices(texts):
                part = batch.slice(i, j - i)
                out = work(part, texts.slice(i, j - i))
                if out is not None:
                    yield out
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return bounded(docs).mapInArrow(run, schema)


def with_columns(docs: DataFrame, column: str, work: Callable[[pa.RecordBatch, pa.Array], dict[str, pa.Array]], new: dict[str, T.DataType]) -> DataFrame:
    """docs with the columns of `new`, which `work` computes from slices; they replace columns of the same name."""
    kept = [f for f in docs.schema.fields if f.name not in new]
    names = [f.name for f in kept]
    source = docs.select(*[f"`{n}`" for n in names], f"`{column}`") if column not in names else docs.select(*[f"`{n}`" for n in names])

    def run(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        made = work(part, texts)
        return pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(n)) for n in names] + [made[n] for n in new], names=names + list(new))

    return per_slice(source, column, run, T.StructType(kept + [T.StructField(n, t) for n, t in new.items()]))
