"""Joins by the matching-blocks ratio of names, exact at any floor from LEAST_FLOOR on.

Names meet in tiles: all names of neighbouring lengths against one another, as a ratio bounds how far two lengths may differ.  A ratio of r means that at least r times half the two lengths are matched, in blocks of
which any two have something unmatched between them.  In names of 200 characters and more difflib starts blocks only at rare characters and at the very beginning, so there are few blocks, and the longest of them has
many characters: such names meet only where they have a run of that length in common, found by the least hashes of their windows.  Of the others numpy counts the characters of all pairs of a tile.  What may reach the
floor by its characters, then by its runs of three (or, of long names, of eight) and of two, as a block of b characters holds b - 1 runs of two, is compared as difflib does, as far as it can still reach what is sought.
The pairs of shorter names that are counted grow with the square of their number; a tile takes nanoseconds a pair and a bounded number of names.  Equal names are one.  Null and empty names meet none.
"""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scoring, text
from ..sources.shared import cut

#: Characters of a run of _runs(), which the joins no longer use: long names share too many of their rarest runs.
Q = 2
#: Below it the counts tell little.
LEAST_FLOOR = 0.82
#: Names of one side of a tile, and their characters.
TILE, TILE_CHARACTERS = 16_384, 6_000_000
#: How much longer than its shortest name the longest of a tile may be.
STEP = 1.23
#: Buckets of characters and of runs of two, and names of either side that are counted at once (so few that their counts stay in the cache).
KINDS, PAIRS, ROWS, COLUMNS = 128, 256, 64, 1024
#: Buckets of numbered runs of three, of which names are known by bits.
TRIPLES = 8192
#: Characters of a long run, and from where on difflib leaves out the frequent ones.
RUN, FREQUENT_FROM = 8, scoring.FREQUENT_FROM
#: Characters of a common run by which long names meet, with the hashes of its parts of which the least is kept; and meetings that are held at once.
COMMON, MEETINGS = ((24, 9), (16, 6), (12, 4)), 1 << 22
#: An odd number and its inverse, for the hashes of runs of any length.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
NAME_FLOOR, TIER_FLOOR = 0.9, 0.88
#: The weights of a venue's similarity, what an equal acronym and a nearly equal query add, and from where on a query is nearly equal.
RATIO_WEIGHT, WORD_WEIGHT = 0.68, 0.32
ACRONYM, QUERY, QUERY_FLOOR = 1.2, 0.3, 0.92
#: Words that say nothing about a conference, and acronyms of publishers.
VENUE_WORDS = "(?i)\\b(proceedings|proc|conference|international|annual|ieee|acm|cvf|symposium|workshop)\\b"
NO_ACRONYM = ("IEEE", "ACM", "CVF", "IAPR", "IET", "SPIE", "OSA", "IFIP")


def name_key(x: Column | str) -> Column:
    """A name in lower-case letters and digits, other runs as one space."""
    dashes = F.regexp_replace(F.lower(F.coalesce(text._c(x), F.lit(""))), "[\\x{2013}\\x{2014}\\x{2212}\\x{ad}]", "-")
    return F.trim(F.regexp_replace(dashes, "[^a-z0-9]+", " "))


def _runs(names: DataFrame) -> DataFrame:
    """id, n (characters), run: the runs of Q characters, the same one numbered."""
    letters = names.select("id", F.length("name").alias("n"), F.split("name", "").alias("c"))  # a place in a string is found by walking there, one in an array is not
    pair = F.zip_with(F.slice("c", 1, F.col("n") - 1), F.slice("c", 2, F.col("n") - 1), lambda x, y: F.concat(x, y))
    each = letters.select("id", "n", F.explode(pair).alias("run"))
    counted = each.groupBy("id", "n", "run").agg(F.count("*").cast("int").alias("times"))
    return counted.select("id", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("times")), lambda k: F.concat("run", k.cast("string")))).alias("run"))


def _rarest(runs: DataFrame, frequency: DataFrame, floor: float) -> DataFrame:
    """Of each name the rarest runs, as many as may be missing in a similar name and one."""
    # Most is missing where the other name is as short as it can be and lies whole in this one.
    missing = F.floor(F.col("n") * (2 * Q * (1 - floor) / (2 - floor)) + 1e-9)
    place = F.row_number().over(Window.partitionBy("id").orderBy("often", "run"))
    return runs.join(frequency, "run").withColumn("place", place).where(F.col("place") <= missing + 1).select("id", "n", "run")


def ratio_from(floor: float):
    """The ratio of two columns, 0 where it is below the floor (told by bounds where they can tell it)."""

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        out, matcher, last = [], SequenceMatcher(None), None
        for x, y in zip(a, b, strict=True):
            if y != last:
                matcher.set_seq2(y)  # what it knows of the second name is kept
                last = y
            matcher.set_seq1(x)
            value = matcher.ratio() if matcher.real_quick_ratio() >= floor and matcher.quick_ratio() >= floor else 0.0
            out.append(value if value >= floor else 0.0)
        return pd.Series(out, dtype=float)

    return ratio


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class _Names:
    """The names of one side of a tile in the order of their lengths, with the counts of their characters."""

    def __init__(self, ids, names):
        order = sorted(range(len(names)), key=lambda i: len(names[i]))
        self.ids, self.names = [ids[i] for i in order], [names[i] for i in order]
        self.size = np.array([len(x) for x in self.names], dtype=np.int64)
        self.codes = np.frombuffer("".join(self.names).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.first = np.append(0, np.cumsum(self.size))
        self.kind = np.dtype(np.uint8 if self.size[-1] < 256 else np.uint16 if self.size[-1] < 65536 else np.uint32)
        single = self._counted(np.repeat(np.arange(len(names)), self.size), self.codes % KINDS, KINDS)
        self.single = single.astype(self.kind)
        self.blocks = self._blocks(single, np.maximum.reduceat(self.codes, self.first[:-1]) >= KINDS)
        self.runs = {}

    def _counted(self, rows, keys, width):
        return np.bincount(rows * width + keys.astype(np.int64), minlength=len(self.names) * width).reshape(len(self.names), width)

    def _within(self, width):
        """The name of each run of `width` characters, and which runs of all characters lie within a name."""
        of = np.repeat(np.arange(len(self.names)), self.size)
        inside = of[width - 1 :] == of[: max(0, len(of) - width + 1)]
        return of[: len(inside)][inside], inside

    @staticmethod
    def _hashes(codes, width, shift):
        if len(codes) < width:
            return np.zeros(0, dtype=np.uint64)
        h = np.zeros(len(codes) - width + 1, dtype=np.uint64)
        for k in range(width):
            h = (h + codes[k : len(codes) - width + 1 + k]) * np.uint64(FACTOR)
            h ^= h >> np.uint64(29)
        return h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(shift)

    @cached_property
    def double(self):
        """Counts of the runs of two."""
        of, inside = self._within(2)
        return self._counted(of, self._hashes(self.codes, 2, 64 - 8)[inside], PAIRS).astype(self.kind)

    @cached_property
    def triple(self):
        """Bits of the runs of three, the same one numbered, and how many are set."""
        of, inside = self._within(3)
        runs = np.sort(of.astype(np.uint64) << np.uint64(40) | self._hashes(self.codes, 3, 24)[inside])
        start = np.flatnonzero(np.append(True, runs[1:] != runs[:-1])) if len(runs) else np.zeros(0, dtype=np.int64)
        number = np.arange(len(runs)) - np.repeat(start, np.diff(np.append(start, len(runs))))
        bucket = (runs + number.astype(np.uint64) * np.uint64(FACTOR) & np.uint64((1 << 40) - 1)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - TRIPLES.bit_length() + 1)
        code = _distinct(((runs >> np.uint64(40)) * np.uint64(TRIPLES) + bucket).astype(np.int64))
        bits, at = np.zeros(len(self.names) * TRIPLES // 8, dtype=np.uint8), code >> 3
        if len(code):
            new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            bits[at[new]] = np.add.reduceat(1 << (code & 7), new)
        return bits.view(np.uint64).reshape(len(self.names), -1), np.bincount(code // TRIPLES, minlength=len(self.names))

    @cached_property
    def _powers(self):
        powers = lambda x: np.cumprod(np.append(np.uint64(1), np.full(len(self.codes), x, dtype=np.uint64)))
        return np.append(np.uint64(0), np.cumsum((self.codes + np.uint64(1)) * powers(FACTOR)[:-1])), powers(INVERSE)

    def _sums(self, start, end, width):
        """Of each run of `width` characters of a stretch the sum of its characters times powers of FACTOR."""
        sums, inverse = self._powers
        last = max(start, end - width + 1)
        return (sums[start + width : last + width] - sums[start:last]) * inverse[start:last]

    def least_hashes(self, common, window):
        """Of each run of `common` characters the least hash of its `window` parts, with its name; names that have the run in common have the hash in common."""
        of, inside = self._within(common)
        if not len(of):
            return np.zeros(0, dtype=np.uint64), of
        h = self._sums(0, len(self.codes), common - window + 1)
        for shift in (29, 32):
            h ^= h >> np.uint64(shift)
            h *= np.uint64(0xD6E8FEB86659FD93)
        reach = 1
        while reach < window:
            step = min(reach, window - reach)
            h, reach = np.minimum(h[:-step], h[step:]), reach + step
        h = h[inside]
        new = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))
        return h[new], of[new]

    def _blocks(self, single, wide):
        """How many matching blocks another name may have with each as the second: all but one at the beginning hold a character that is rare in it."""
        out = np.where(single <= (self.size // 100 + 1)[:, None], single, 0).sum(axis=1) + 1
        for i in np.flatnonzero(wide):  # buckets of several characters don't tell which are rare
            times = np.unique(self.codes[self.first[i] : self.first[i + 1]], return_counts=True)[1]
            out[i] = times[times <= self.size[i] // 100 + 1].sum() + 1
        return np.where(self.size < FREQUENT_FROM, self.size, out)

    def long_runs(self, i):
        if i not in self.runs:
            self.runs[i] = np.sort(self._sums(self.first[i], self.first[i + 1], RUN))
        return self.runs[i]


def _common_runs(a: _Names, b: _Names, floor: float):
    """For each of b how long a run (of COMMON) it must share with a name of a that reaches the floor; 0 where it need not share any."""
    shortest = np.maximum(a.size[0], b.size * (floor / (2 - floor)))
    longest = np.ceil((shortest + b.size) * (floor / 2) - 1e-6) / b.blocks  # so many characters has the longest block at least
    out = np.zeros(len(b.ids), dtype=np.int64)
    for common, _ in reversed(COMMON):
        out[(longest >= common) & (b.size >= FREQUENT_FROM)] = common
    return out


def _meeting(a: _Names, b: _Names, columns, common: int, window: int):
    """Rows of a and of b (of `columns`) with a common run, each pair once."""
    value, row = a.least_hashes(common, window)
    order = np.argsort(value)
    value, row = value[order], row[order]
    sought, column = b.least_hashes(common, window)
    wanted = np.zeros(len(b.ids), dtype=bool)
    wanted[columns] = True
    sought, column = sought[wanted[column]], column[wanted[column]]
    at = np.searchsorted(value, sought)
    times = np.searchsorted(value, sought, side="right") - at
    met = times > 0
    at, times, column = at[met], times[met], column[met]
    ends = np.flatnonzero(np.append(column[1:] != column[:-1], True)) + 1 if len(column) else []
    total, start = np.append(0, np.cumsum(times)), 0
    for k, end in enumerate(ends):
        if k + 1 < len(ends) and total[ends[k + 1]] - total[start] <= MEETINGS:
            continue  # the next name has room in this slice
        n = times[start:end]
        inside = np.arange(n.sum()) - np.repeat(total[start:end] - total[start], n)
        code = _distinct(np.repeat(column[start:end], n) * len(a.ids) + row[np.repeat(at[start:end], n) + inside])
        yield code % len(a.ids), code // len(a.ids)
        start = end


def _counted_pairs(a: _Names, b: _Names, columns, floor: float):
    """Rows of a and of b (of `columns`) whose counts of characters allow the floor."""
    edge = np.searchsorted(b.size[columns], 256)
    for part in (columns[:edge], columns[edge:]):  # short names apart, as their counts take a byte
        for j in range(0, len(part), COLUMNS):
            own = part[j : j + COLUMNS]
            m = b.size[own]
            low, high = np.searchsorted(a.size, m[0] * (floor / (2 - floor)) - 1e-6), np.searchsorted(a.size, m[-1] * ((2 - floor) / floor) + 1e-6, side="right")
            for i in range(low, high, ROWS):
                n = a.size[i : min(i + ROWS, high)]
                # A common count is at most the lesser of the two lengths, so the type that holds it will do.
                kind = min(a.kind if n[-1] > 255 else np.dtype(np.uint8), b.kind if m[-1] > 255 else np.dtype(np.uint8), key=lambda t: t.itemsize)
                top = np.iinfo(kind).max
                x, y = np.minimum(a.single[i : i + len(n)], top).astype(kind), np.ascontiguousarray(np.minimum(b.single[own], top).astype(kind).T)
                common, part_ = np.zeros((len(n), len(m)), dtype=kind), np.empty((len(n), len(m)), dtype=kind)
                for k in np.flatnonzero(x.any(axis=0) & y.any(axis=1)):
                    np.minimum(x[:, k, None], y[k], out=part_)
                    common += part_
                r, c = np.nonzero(common >= np.ceil(np.add.outer(n, m) * (floor / 2) - 1e-6))
                yield i + r, own[c]


def _promising(a: _Names, b: _Names, floor: float):
    """Rows of a and of b whose lengths, characters and runs allow the floor, the ratio that the characters allow and how many long runs must be shared."""
    kinds = np.flatnonzero(a.single.any(axis=0) & b.single.any(axis=0))
    x, y = a.single[:, kinds], b.single[:, kinds]
    shared = _common_runs(a, b, floor)
    met = [_counted_pairs(a, b, np.flatnonzero(shared == 0), floor)] + [_meeting(a, b, np.flatnonzero(shared == common), common, window) for common, window in COMMON if (shared == common).any()]
    for pairs in met:
        for i, j in pairs:
            for s in range(0, len(i), 4096):
                p, q = i[s : s + 4096], j[s : s + 4096]
                common, both = np.minimum(x[p], y[q]).sum(axis=1, dtype=np.int64), a.size[p] + b.size[q]
                need = np.ceil(both * (floor / 2) - 1e-6)
                few = np.minimum(b.blocks[q], both - 2 * need + 1)
                fits = common >= need
                p, q, common, both, need, few = (v[fits] for v in (p, q, common, both, need, few))
                if len(p) and b.size[q].min() < FREQUENT_FROM:
                    (bits, own), (others, other) = a.triple, b.triple
                    triples = np.bitwise_count(bits[p] & others[q]).sum(axis=1, dtype=np.int64)
                    # A run that isn't shared takes a bucket of its own at most.
                    least = need - 2 * few + np.maximum(own[p] - np.maximum(a.size[p] - 2, 0), other[q] - np.maximum(b.size[q] - 2, 0))
                    fits = triples >= least
                    p, q, common, both, need, few = (v[fits] for v in (p, q, common, both, need, few))
                if len(p):
                    fits = np.minimum(a.double[p], b.double[q]).sum(axis=1, dtype=np.int64) >= need - few
                    yield from zip(p[fits].tolist(), q[fits].tolist(), (2 * common / both)[fits].tolist(), (need - (RUN - 1) * few)[fits].tolist(), strict=True)


def _tile(a: _Names, b: _Names, floor: float, best: bool):
    """left_id, right_id and ratio of the pairs of a tile that reach the floor; of each left name the best one alone, if that is wanted."""
    candidates: dict[int, list] = {}
    for i, j, most, least in _promising(a, b, floor):
        if least > 0:
            own, other = a.long_runs(i), b.long_runs(j)
            place = np.minimum(np.searchsorted(other, own), len(other) - 1)
            if (other[place] == own).sum() < least:
                continue
        if a.names[i] != b.names[j]:
            candidates.setdefault(i, []).append((-most, b.ids[j], j))
    out = []
    if best:
        for i, own in candidates.items():
            top = None
            for most, right, j in sorted(own):
                if top and (-most < top[0] or (-most == top[0] and right > top[1])):
                    break  # what follows can't be better
                value = scoring.matching_ratio(a.names[i], b.names[j], max(floor, top[0]) if top else floor)
                if value >= floor and (top is None or (-value, right) < (-top[0], top[1])):
                    top = (value, right)
            if top:
                out.append((a.ids[i], top[1], top[0]))
        return out
    for j, i in sorted((j, i) for i, own in candidates.items() for _, _, j in own):
        value = scoring.matching_ratio(a.names[i], b.names[j], floor)
        if value >= floor:
            out.append((a.ids[i], b.ids[j], value))
    return out


def _tiled(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """names with the length class and the part of it that each falls into, and the number of parts of the classes (a few hundred rows at most)."""
    classed = names.withColumn("of", F.floor(F.log(F.length("name").cast("double")) / math.log(STEP)).cast("int"))
    parts = classed.groupBy("of").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum(F.length("name").cast("long")) / TILE_CHARACTERS)).cast("int").alias("parts"))
    return classed, cut(parts)


def similar_pairs(left: DataFrame, right: DataFrame, floor: float = NAME_FLOOR, best: bool = False) -> DataFrame:
    """left_id, right_id and ratio of all pairs of different names with at least that ratio.  left, right: id and name, each name once.  best: of each left name those that may be its best one alone."""
    if floor < LEAST_FLOOR:
        raise ValueError(f"the floor must be at least {LEAST_FLOOR}")
    left, right = (t.where("name <> ''").select("id", "name") for t in (left, right))
    (a, parts_a), (b, parts_b) = _tiled(left), _tiled(right)
    reach = math.ceil(math.log((2 - floor) / floor) / math.log(STEP) + 1e-9)  # classes between two names of similar lengths
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    far = lambda own, other: F.abs(F.col(own) - F.col(other)) <= reach
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own_a, own_b = parts_a.toDF("of", "own"), parts_b.toDF("of", "own")
    # Each name goes to all tiles of its part: as many as the other side has parts of similar lengths.
    x = a.join(F.broadcast(own_a), "of").join(F.broadcast(parts_b.toDF("to", "parts")), far("of", "to")).select("id", "name", F.col("of").alias("x"), F.col("to").alias("y"), part("own").alias("u"), every("parts").alias("v"))
    y = b.join(F.broadcast(own_b), "of").join(F.broadcast(parts_a.toDF("to", "parts")), far("of", "to")).select("id", "name", F.col("to").alias("x"), F.col("of").alias("y"), every("parts").alias("u"), part("own").alias("v")).toDF("other_id", "other_name", "other_x", "other_y", "other_u", "other_v")

    def tile(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(one) and len(other):
            found = _tile(_Names(one["id"].tolist(), one["name"].tolist()), _Names(other["other_id"].tolist(), other["other_name"].tolist()), floor, best)
        return pd.DataFrame({"left_id": pd.Series([r[0] for r in found], dtype="int64"), "right_id": pd.Series([r[1] for r in found], dtype="int64"), "ratio": pd.Series([r[2] for r in found], dtype="float64")})

    keys, other_keys = ("x", "y", "u", "v"), ("other_x", "other_y", "other_u", "other_v")
    # A set number, as tiles take much longer than their bytes let the optimizer think.
    n = 8 * left.sparkSession.sparkContext.defaultParallelism
    return x.repartition(n, *keys).groupBy(*keys).cogroup(y.repartition(n, *other_keys).groupBy(*other_keys)).applyInPandas(tile, "left_id long, right_id long, ratio double")


def best_names(left: DataFrame, right: DataFrame, floor: float = NAME_FLOOR) -> DataFrame:
    """left_id, right_id, ratio and found ('equal', 'similar'): for each name of left (id, name) the one of right (id, name) that is equal, else the most similar; ties go to the smaller id.
    Repeated names on either side are compared once."""
    of = left.where("name <> ''").select(F.col("id").alias("left_id"), "name")
    classes = right.where("name <> ''").groupBy("name").agg(F.min("id").alias("id"))
    equal = of.join(classes, "name").select("left_id", F.col("id").alias("right_id"), F.lit(1.0).alias("ratio"), F.lit("equal").alias("found"))
    rest = of.join(classes.select("name"), "name", "left_anti").groupBy("name").agg(F.min("left_id").alias("id"))
    best = similar_pairs(rest, classes, floor, best=True).groupBy("left_id").agg(F.max(F.struct("ratio", (-F.col("right_id")).alias("less"))).alias("b")).select(F.col("left_id").alias("id"), (-F.col("b.less")).alias("right_id"), F.col("b.ratio").alias("ratio"))
    similar = best.join(rest, "id").join(of, "name").select("left_id", "right_id", "ratio", F.lit("similar").alias("found"))
    return equal.unionByName(similar)


def nearest_others(names: DataFrame, floor: float = NAME_FLOOR) -> DataFrame:
    """best_names() of a table (id, name) with itself: another row of the same name, else the one with the most similar name."""
    names = cut(names.where("name <> ''").select("id", "name"))
    first = names.groupBy("name").agg(F.min("id").alias("id"))
    second = names.join(first.withColumnRenamed("id", "first"), "name").where("id <> first").groupBy("name").agg(F.min("id").alias("second"))
    pair = first.join(second, "name")
    equal = names.join(pair.withColumnRenamed("id", "first"), "name").select(F.col("id").alias("left_id"), F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("right_id"), F.lit(1.0).alias("ratio"), F.lit("equal").alias("found"))
    alone = first.join(second.select("name"), "name", "left_anti").select("id", "name")
    best = similar_pairs(alone, first.select("id", "name"), floor, best=True).groupBy("left_id").agg(F.max(F.struct("ratio", (-F.col("right_id")).alias("less"))).alias("b"))
    return equal.unionByName(best.select("left_id", (-F.col("b.less")).alias("right_id"), F.col("b.ratio").alias("ratio"), F.lit("similar").alias("found")))


def venue_key(x: Column | str) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(text._c(x), F.lit(""))), "&", " and ")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9\\x{4e00}-\\x{9fff}]+", " "))


def plain_venue(x: Column | str) -> Column:
    """A venue without years, marks and the words that all conferences have."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(text._c(x), F.lit("")), "\\b(19|20)\\d{2}\\b", " "), "[()/,:;]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, VENUE_WORDS, " "), "\\s+", " "))


def acronym(x: Column | str) -> Column:
    """The acronym in brackets, else the first in capitals, else the initials; empty without one."""
    x = F.trim(F.regexp_replace(F.coalesce(text._c(x), F.lit("")), "\\s+", " "))
    marked = F.regexp_extract(x, "\\(([A-Z][A-Z0-9]{2,12})\\)", 1)
    capitals = F.get(F.filter(F.regexp_extract_all(x, F.lit("\\b([A-Z][A-Z0-9]{2,12})\\b"), F.lit(1)), lambda c: ~c.isin(*NO_ACRONYM)), F.lit(0))
    initials = F.upper(F.array_join(F.transform(F.regexp_extract_all(x, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.substring(w, 1, 1)), ""))
    return F.when((marked != "") & ~marked.isin(*NO_ACRONYM), marked).when(capitals.isNotNull(), capitals).when(F.length(initials).between(3, 10), initials).otherwise("")


def _similar(a: Column, b: Column, ratio: Column) -> Column:
    """The blend of ratio and common words of two keys."""
    words = lambda k: F.array_distinct(F.split(k, " "))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.least(F.lit(1.0), RATIO_WEIGHT * ratio + WORD_WEIGHT * scoring.jaccard(words(a), words(b))))


def venue_tiers(venues: DataFrame, tiers: DataFrame) -> DataFrame:
    """venues: venue.  tiers: tier_id, title, acronym and rank.  For each venue the rank of the conference that it names: by similarity of the name, more where the acronym is the same or one of
    the venue's short forms is nearly the title.  Venues without one have no row; ties go to the smaller tier_id."""
    v = venues.select("venue").distinct().where(F.trim("venue") != "")
    v = v.select("venue", venue_key("venue").alias("whole"), venue_key(plain_venue("venue")).alias("plain"), acronym("venue").alias("short")).withColumn("short_key", venue_key("short"))
    t = tiers.where(F.trim(F.coalesce("rank", F.lit(""))) != "").select("tier_id", "title", F.upper(F.trim(F.coalesce("acronym", F.lit("")))).alias("acronym"), "rank", venue_key("title").alias("key")).where("key <> ''")
    titles = t.groupBy("key").agg(F.min("tier_id").alias("id")).select("id", F.col("key").alias("name"))
    forms = v.select(F.explode(F.array("whole", "plain", "short_key")).alias("name")).where("name <> ''").distinct().withColumn("id", F.xxhash64("name"))
    # A blend of the floor needs a ratio of this at least, as common words add no more than their weight.
    least = (TIER_FLOOR - WORD_WEIGHT) / RATIO_WEIGHT
    found = similar_pairs(forms.select("id", "name"), titles, least).join(forms.select(F.col("id").alias("left_id"), F.col("name").alias("form")), "left_id").join(titles.select(F.col("id").alias("right_id"), F.col("name").alias("key")), "right_id").select("form", "key", "ratio")
    same = forms.select(F.col("name").alias("form")).join(titles.select(F.col("name").alias("key")), F.col("form") == F.col("key")).select("form", "key", F.lit(1.0).alias("ratio"))
    close = cut(found.unionByName(same))
    by_name = v.select("venue", F.explode(F.array_distinct(F.array("whole", "plain", "short_key"))).alias("form")).join(close.select("form", "key"), "form").join(t.select("key", "tier_id"), "key").select("venue", "tier_id")
    by_acronym = v.where("short <> ''").join(t, F.upper("short") == F.col("acronym")).select("venue", "tier_id")
    pairs = by_name.union(by_acronym).distinct().join(v, "venue").join(t, "tier_id")
    ratio = ratio_from(0.0)
    each = pairs.withColumns({f"s_{c}": _similar(F.col(c), F.col("key"), ratio(c, "key")) for c in ("whole", "plain", "short_key")})
    name = F.greatest("s_whole", "s_plain")
    score = name + F.when((F.col("short") != "") & (F.upper("short") == F.col("acronym")), ACRONYM).otherwise(0.0) + F.when(F.greatest("s_whole", "s_plain", "s_short_key") >= QUERY_FLOOR, QUERY).otherwise(0.0)
    best = each.withColumn("score", F.round(score, 6)).where(F.col("score") >= TIER_FLOOR).groupBy("venue").agg(F.max(F.struct("score", (-F.col("tier_id")).alias("less"), F.round(name, 3).alias("confidence"), "title", "acronym", "rank")).alias("b"))
    return best.select("venue", (-F.col("b.less")).alias("tier_id"), "b.score", "b.confidence", "b.title", "b.acronym", "b.rank")
