"""Exact search for the vectors with the largest inner products, longest vectors first.

Components become integers (floor of SCALE times them).  All vectors are dealt out by falling length into parts, each packed as tiles; the
queries are packed as groups.  Rounds go through the parts in that order, each with four times as many parts
as all before it: a group meets a part only if its longest vector could still reach the score that the group has to beat
(Cauchy-Schwarz), and what was found so far is the mark to beat in the next round.  Within a part tiles are visited by falling length until no
query can gain.  In a tile the leading coordinates of a rotation (the right singular vectors of all vectors, from their matrix of second moments) give
a partial sum; the lengths of what remains bound the rest.  Only pairs whose bound reaches the mark are multiplied out in integers, so scores, ties and order are exact, however
the bounds are rounded.

Groups meet parts by an equal key (part and group), both of bounded size; a part's vectors of equal length and id are dealt apart by row.  Results of a round are at most K
a query and part.  Vectors that are null or hold null or non-finite components take no part; shorter ones count as filled up with zeros.  Components
beyond the limit for which every score fits a long (2 ** 28 in 64 dimensions) count as the limit.  A row with a null id is a candidate, but no query; ties go to the smaller id, nulls
last.  A row is not its own candidate, a repeated row is.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import cut, written
from .vectors import dimension, floored, in_steps, summed, whole
from .words import bounded

K = 10
EVERY = 100
SCALE = 1024
#: Vectors of a part, and the parts there are at least; of a tile; and queries of a group.
PART_ROWS = 65_536
LEAST_PARTS = 32
TILE_ROWS = 1024
GROUP_ROWS = 1024
#: Each round has so many times the parts of all rounds before it, and one.
GROWTH = 3
#: Leading coordinates of the rotation, as a share of all.
LEADING = 0.25
#: Bounds are raised by this share of the lengths' product for rounding.
SLACK = 1e-9
#: If more pairs of a tile than this share survive, the tile is multiplied out whole.
DENSE = 0.05

_ROWS = "row long, vec_id long, length double, x binary"
_FOUND = "grp long, pos int, query_id long, vec_id long, score long"


def _limit(d: int) -> int:
    return 1 << min(30, (62 - (d - 1).bit_length()) // 2)


def rows_of(vectors: DataFrame, d: int) -> DataFrame:
    """row, vec_id, length and the 32-bit integers of each whole vector."""
    most = _limit(d)

    def run(batches):
        for batch in batches:
            for step in in_steps(batch, TILE_ROWS):
                good, matrix = whole(step.column(2), d)
                x = floored(matrix, SCALE, most)
                data = x.astype("<i4")
                mask = pa.array(good)
                yield pa.RecordBatch.from_arrays(
                    [step.column(0).filter(mask), step.column(1).filter(mask), pa.array(np.sqrt(np.sum(x.astype(float) ** 2, axis=1))), pa.array([r.tobytes() for r in data], pa.binary())], names=["row", "vec_id", "length", "x"]
                )

    return bounded(vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")).mapInArrow(run, _ROWS)


def _matrix(cells: list[bytes], d: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), dtype="<i4").reshape(-1, d).astype(np.int64)


def rotation(rows: DataFrame, d: int) -> np.ndarray:
    """The right singular vectors of all vectors as columns, by falling singular value."""

    def products(batch):
        x = _matrix(batch.column(0).to_pylist(), d).astype(float)
        return (x.T @ x).ravel()

    moments = np.zeros(d * d)
    for place, v in summed(rows.select("x"), products).items():
        moments[place] = v
    return np.linalg.eigh(moments.reshape(d, d))[1][:, ::-1]


def packed(rows: DataFrame, most: int) -> DataFrame:
    """Each partition's rows, in their order, as packs of at most so many: part, pack, n, longest, lengths, ids, nulls, rows, x."""

    def pack(part, number, held):
        row, ids, length, x = (pa.concat_arrays([h[i] for h in held]) for i in range(4))
        lengths = np.asarray(length)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([len(lengths)], pa.int64()), pa.array([float(lengths.max())]), pa.array([lengths.tolist()], pa.list_(pa.float64())),
                pa.array([np.asarray(ids.fill_null(0)).astype("<i8").tobytes()], pa.binary()), pa.array([np.asarray(ids.is_null()).astype("u1").tobytes()], pa.binary()),
                pa.array([np.asarray(row).astype("<i8").tobytes()], pa.binary()), pa.array([b"".join(x.to_pylist())], pa.binary()),
            ],
            names=["part", "pack", "n", "longest", "lengths", "ids", "nulls", "rows", "x"],
        )

    def run(batches):
        part, number, held, n = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(most - n, batch.num_rows - at)
                held.append([batch.column(i).slice(at, take) for i in range(4)])
                at, n = at + take, n + take
                if n == most:
                    yield pack(part, number, held)
                    number, held, n = number + 1, [], 0
        if n:
            yield pack(part, number, held)

    return bounded(rows.select("row", "vec_id", "length", "x")).mapInArrow(run, "part long, pack long, n long, longest double, lengths array<double>, ids binary, nulls binary, rows binary, x binary")


class Best:
    """The k best candidates of each query so far, as flat arrays in order of query, falling score and rising id."""

    def __init__(self, k: int, marks: np.ndarray):
        self.k, self.marks = k, marks  # marks: the score that a candidate has to reach (float; -inf: none)
        self.query = self.score = self.id = np.zeros(0, dtype=np.int64)
        self.null = np.zeros(0, dtype=bool)

    def add(self, query, score, ids, null) -> None:
        query, score, ids, null = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((ids, null, -score, query))
        query = query[order]
        first = np.searchsorted(query, query)  # where the query's candidates begin
        keep = np.arange(len(query)) - first < self.k
        order, query = order[keep], query[keep]
        self.query, self.score, self.id, self.null = query, score[order], ids[order], null[order]
        last = np.flatnonzero(np.arange(len(query)) - np.searchsorted(query, query) == self.k - 1)
        self.marks[query[last]] = np.maximum(self.marks[query[last]], self.score[last])


def search_tile(best: Best, active: np.ndarray, q: np.ndarray, q_rows: np.ndarray, q_turned: np.ndarray, q_length: np.ndarray, tile: dict, turn: np.ndarray) -> int:
    """Adds to best what the tile has for the active queries; tells how many pairs were multiplied out."""
    c, d = tile["x"], len(turn)
    lead = max(1, int(d * LEADING))
    c_turned = c @ turn[:, :lead]
    c_rest = np.sqrt(np.maximum(tile["lengths"] ** 2 - np.sum(c_turned**2, axis=1), 0))
    own, marks = q_turned[active, :lead], best.marks[active]
    q_rest = np.sqrt(np.maximum(q_length[active] ** 2 - np.sum(own**2, axis=1), 0))
    # What is left of a length is a difference of squares: its rounding is covered too.
    slack = SLACK * np.outer(q_length[active], tile["lengths"])
    alive = own @ c_turned.T + np.outer(q_rest + 1e-6 * q_length[active], c_rest + 1e-6 * tile["lengths"]) + slack >= marks[:, None]
    n = int(alive.sum())
    if n > DENSE * alive.size:
        whole_scores = (q[active].astype(float) @ c.T.astype(float)).astype(np.int64) if len(turn) * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) < 2.0**53 else q[active] @ c.T
        n = alive.size
        at_own = q_rows[active][:, None] == tile["rows"][None, :]
        least = marks
        if alive.shape[1] > best.k:
            kept = np.where(at_own, np.iinfo(np.int64).min, whole_scores)
            least = np.maximum(marks, np.partition(kept, alive.shape[1] - best.k, axis=1)[:, alive.shape[1] - best.k])
        i, j = np.nonzero((whole_scores >= least[:, None]) & ~at_own)
        scores = whole_scores[i, j]
    else:
        i, j = np.nonzero(alive)
        scores = np.einsum("ij,ij->i", q[active[i]], c[j])
        keep = (scores >= marks[i]) & (q_rows[active[i]] != tile["rows"][j])
        i, j, scores = i[keep], j[keep], scores[keep]
    best.add(active[i], scores, tile["ids"][j], tile["nulls"][j])
    return n


def _unpacked(row: dict, d: int) -> dict:
    return {
        "x": np.frombuffer(row["x"], dtype="<i4").reshape(-1, d).astype(np.int64), "lengths": np.asarray(row["lengths"], dtype=float), "ids": np.frombuffer(row["ids"], dtype="<i8"),
        "nulls": np.frombuffer(row["nulls"], dtype="u1").astype(bool), "rows": np.frombuffer(row["rows"], dtype="<i8"),
    }


def _meet(d: int, k: int, turn: np.ndarray):
    """A part's tiles against a group of queries."""

    def run(tiles: pa.Table, group: pa.Table) -> pa.Table:
        found = [[] for _ in range(5)]
        tiles = sorted(tiles.select(["pack", "lengths", "ids", "nulls", "rows", "x"]).to_pylist(), key=lambda t: t["pack"])
        for row in group.to_pylist():
            own = _unpacked(row, d)
            marks = np.full(row["n"], -np.inf)
            for mark in row["marks"] or []:
                marks[mark["pos"]] = mark["score"]
            best, turned = Best(k, marks), own["x"] @ turn
            for packed_tile in tiles:
                tile = _unpacked(packed_tile, d)
                active = np.flatnonzero(own["lengths"] * tile["lengths"][0] * (1 + SLACK) >= best.marks)
                if not len(active):
                    break
                search_tile(best, active, own["x"], own["rows"], turned, own["lengths"], tile, turn)
            for into, made in zip(found, (np.full(len(best.query), row["grp"]), best.query, own["ids"][best.query], np.ma.array(best.id, mask=best.null), best.score), strict=True):
                into.append(made)
        arrays = [np.concatenate(x) if i != 3 else np.ma.concatenate(x) for i, x in enumerate(found)]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        made = [pa.array(np.ma.getdata(x), kind, mask=np.ma.getmaskarray(x) if i == 3 else None) for i, (x, kind) in enumerate(zip(arrays, kinds, strict=True))]
        return pa.table(made, names=["grp", "pos", "query_id", "vec_id", "score"])

    return run


def _in_order(found: DataFrame) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("grp", "pos").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))))


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest inner products of each row whose vec_id is divisible by `every`, among all other rows."""
    spark = vectors.sparkSession
    d = dimension(vectors)
    empty = "query_id long, rank int, vec_id long, score long"
    if not d:
        return spark.createDataFrame([], empty)
    rows = written(rows_of(vectors, d), "vectors")
    n, asked = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    if not asked or n < 2:
        return spark.createDataFrame([], empty)
    turn = rotation(rows, d)
    parts = max(LEAST_PARTS, -(-n // PART_ROWS))
    falling = [F.desc("length"), F.asc("vec_id"), F.asc("row")]
    tiles = written(packed(rows.repartitionByRange(parts, *falling).sortWithinPartitions(*falling), TILE_ROWS), "tiles")
    queries = rows.where(F.col("vec_id") % every == 0).repartition(max(1, -(-asked // GROUP_ROWS)), "row")
    groups = written(packed(queries, GROUP_ROWS).withColumn("grp", F.shiftleft("part", 32) + F.col("pack")).drop("part", "pack"), "queries")
    reach = tiles.groupBy("part").agg(F.max("longest").alias("reach"))
    best, lo, hi = None, 0, 1
    while lo < parts:
        if best is None:
            marked = groups.withColumn("marks", F.lit(None).cast("array<struct<pos:int,score:long>>"))
        else:
            marks = best.where(F.col("rank") == k).groupBy("grp").agg(F.collect_list(F.struct("pos", "score")).alias("marks"))  # a group's queries
            marked = groups.join(marks, "grp", "left")
        # The length from which on a vector can reach the mark of some query of the group; null if one has none.
        needed = F.when((F.size("marks") == F.col("n")) & F.expr("forall(marks, m -> m.score > 0)"), F.expr(f"array_min(transform(marks, m -> m.score / lengths[m.pos])) * (1 - {SLACK})"))
        pairs = marked.select("grp", needed.alias("needed"), F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(min(hi, parts) - 1).cast("long"))).alias("part")).join(reach, "part").where("needed is null or reach >= needed").select("grp", "part")
        left = tiles.where(F.col("part").between(lo, hi - 1)).join(pairs.withColumnRenamed("grp", "met"), "part")
        right = marked.join(pairs, "grp")
        found = bounded(left).groupBy("part", "met").cogroup(right.groupBy("part", "grp")).applyInArrow(_meet(d, k, turn), _FOUND)
        every_one = found if best is None else found.unionByName(best.drop("rank"))
        best = cut(_in_order(every_one).where(F.col("rank") <= k))
        lo, hi = hi, hi + GROWTH * hi
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP13_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS query, q.vec_id AS query_id, o.r, o.vec_id, list_dot_product(q.x::DOUBLE[], o.x::DOUBLE[])::BIGINT AS score FROM v q, v o WHERE q.vec_id % 100 = 0 AND q.r <> o.r),
p AS (SELECT query_id, vec_id, score, (row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM p WHERE rank <= 10
"""
