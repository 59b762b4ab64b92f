"""Importance resampling, whitening and exact search against plain Python and numpy, with odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from marginalia.llm import resampling, topk, whitening
from marginalia.llm.crc import crc32_of_spans, shifted

from .helpers import empty_docs, lower, odd_docs, odd_rows, prose

VECTORS = "vec_id long, embedding array<float>, label int, score string, component string"


def test_crc_of_spans_and_of_spans_put_together():
    r = random.Random(3)
    data = bytes(r.randrange(256) for _ in range(3000))
    buf = np.frombuffer(data, dtype=np.uint8)
    start = np.array([r.randrange(2000) for _ in range(300)])
    end = start + np.array([r.choice([0, 1, 2, 7, 47, 48, 49, 700]) for _ in range(300)])
    found = crc32_of_spans(buf, start, end)
    assert found.tolist() == [zlib.crc32(data[a:b]) for a, b in zip(start, end, strict=True)]
    tail = np.array([0, 1, 5, 999] * 75)
    both = shifted(found, tail) ^ np.array([zlib.crc32(bytes(n)) for n in tail], dtype=np.uint32)
    assert both.tolist() == [zlib.crc32(data[a:b] + bytes(n)) for a, b, n in zip(start, end, tail, strict=True)]
    assert len(crc32_of_spans(buf, start[:0], end[:0])) == 0


def _features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def _drawn(rows, target):
    """The contract in plain Python; rows: (doc_id, text)."""
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for f in _features(text)[1]:
                counts[zlib.crc32(f.encode()) % 10000] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t, strict=True)]
    out = []
    for doc_id, text in rows:
        w, f = _features(text)
        weight = sum(gain[zlib.crc32(x.encode()) % 10000] for x in f)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2]))
    ranked = [(*x[:1], *x[2:], i + 1 if i < 5 * len(order) // 100 else None) for i, x in enumerate(order)]
    return ranked + [(*x[:1], *x[2:], None) for x in out if x[1] < 20]


def _rows(df, *columns):
    return sorted([tuple(r[c] for c in columns) for r in df.collect()], key=repr)


@pytest.mark.parametrize("few", [10_000, 1])
def test_draw_against_plain_python(spark, monkeypatch, few):
    """Also with ties: many copies of one row, with the same id and without one."""
    monkeypatch.setattr(resampling, "FEW", few)
    monkeypatch.setattr(resampling, "PART_ROWS", 7)
    rows = [(i, prose(random.Random(i).randint(0, 60), i)) for i in range(150)]
    rows += [(x[0], x[1]) for x in odd_rows()] + [(None, prose(40, 7))] * 60 + [(500, prose(40, 8))] * 60
    target = [prose(30, 8), None, "", prose(40, 900)]
    docs = spark.createDataFrame([(*x, "own") for x in rows], "doc_id long, text string, rank string").repartition(6)
    got = resampling.importance_sample(docs, spark.createDataFrame([(t,) for t in target], "text string"), keep=["doc_id"])
    assert _rows(got, "doc_id", "n_features", "weight", "score", "rank") == sorted(_drawn(rows, target), key=repr)


def test_draw_of_odd_documents_keeps_their_columns(spark):
    bench = spark.createDataFrame([(prose(30, 8),)], "text string")
    got = resampling.importance_sample(odd_docs(spark), bench)
    assert got.count() == len(odd_rows()) and {"text", "lang", "fingerprint"} <= set(got.columns)
    assert got.where("rank is not null").count() == 5 * sum(len(_features(x[1])[0]) >= 20 for x in odd_rows()) // 100
    assert resampling.importance_sample(empty_docs(spark), bench).count() == 0
    assert resampling.importance_sample(odd_docs(spark), bench.where("false"), keep=["doc_id"]).count() == len(odd_rows())


def test_components_against_numpy():
    r = np.random.default_rng(2)
    turn = np.linalg.qr(r.standard_normal((40, 40)))[0]
    spectra = [r.random(40), np.r_[np.full(5, 4.0), np.full(3, 4.0 - 1e-9), np.ones(32)], np.r_[np.arange(1, 6.0), np.zeros(35)], np.ones(40)]
    for values in spectra:
        matrix = turn @ np.diag(values) @ turn.T
        found, vectors = whitening.leading_components((matrix + matrix.T) / 2, 16)
        want = np.sort(values)[::-1][: len(found)]
        assert len(found) == min(16, np.sum(values > 0))
        assert np.allclose(found, want, rtol=1e-12, atol=1e-14)
        assert np.allclose(matrix @ vectors.T, vectors.T * found, atol=1e-12) and np.allclose(vectors @ vectors.T, np.eye(len(found)), atol=1e-12)


def _odd_vectors(n=120, d=6, seed=5):
    r = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in r.standard_normal(d) * r.choice([0.01, 1.0, 9.0])]) for i in range(n)]
    rows += [(n + 1, None), (n + 2, [1.0, None, 0.0]), (n + 3, [float("nan")] + [0.0] * (d - 1)), (n + 4, [float("inf")] * d), (n + 5, []), (n + 6, [1.0, -2.0]), (None, [0.5] * d), (None, [0.5] * d)]
    rows += [rows[0], rows[0], rows[100], rows[100]] + [(n + 10 + i, [0.25] * d) for i in range(40)] + [(n + 100, [0.25] * d), (-100, [-0.25] * d), (0, [0.0] * d)]
    return rows


def _table(spark, rows):
    return spark.createDataFrame([(*x, 1, "own", "own") for x in rows], VECTORS).repartition(5)


def _whole(rows, d=6):
    good = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return [i for i, _ in good], np.array([np.float32(v + [0.0] * (d - len(v))) for _, v in good]).astype(float)


def test_whitening_against_numpy(spark):
    rows = _odd_vectors()
    ids, c = _whole(rows)
    x = np.floor(64 * c) + 1_000_000
    fit = np.unique(x, axis=0)
    n, mean = len(fit), fit.mean(axis=0)
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    want = sorted((i is None, i or 0, k + 1, int(v)) for i, v in zip(ids, np.sum((n * x - fit.sum(axis=0)) ** 2, axis=1), strict=True) for k in range(6))
    got = whitening.whiten(_table(spark, rows)).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["component"], r["deviation"]) for r in got) == want
    assert {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    for k in range(6):
        value, along = values[5 - k], (x - mean) @ vectors[:, 5 - k]
        own = [r for r in got if r["component"] == k + 1]
        assert max(abs(r["explained"] - value / values.sum()) for r in own) < 1e-12
        for sign in (1, -1):
            close = np.allclose(np.sort([r["whitened"] for r in own]), np.sort(sign * along / np.sqrt(value)), atol=1e-8)
            if close:
                break
        assert close


def test_whitening_of_few_equal_and_huge_vectors(spark):
    assert whitening.whiten(_table(spark, [])).count() == 0
    assert whitening.whiten(_table(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(_table(spark, [(i, [1.0, 2.0]) for i in range(9)])).count() == 0
    two = whitening.whiten(_table(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (2, [3.0, 2.0])])).collect()
    assert sorted((r["vec_id"], r["component"], abs(round(r["whitened"], 9)), r["explained"]) for r in two) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]
    huge = whitening.whiten(_table(spark, [(1, [1e30, 2.0]), (2, [-1e30, 2.0]), (3, [0.0, 0.0])])).collect()
    assert all(r["deviation"] is None for r in huge if r["vec_id"] != 3) and all(math.isfinite(r["whitened"]) for r in huge)


def _best(rows, k=10, d=6):
    ids, c = _whole(rows, d)
    x = np.floor(1024 * c).astype(np.int64)
    out = []
    for q, i in enumerate(ids):
        if i is not None and i % 100 == 0:
            found = sorted((-int(x[q] @ x[j]), o is None, o or 0) for j, o in enumerate(ids) if j != q)[:k]
            out += [(i, rank + 1, None if null else o, -s) for rank, (s, null, o) in enumerate(found)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("part", "parts", "tile", "group"), [(65_536, 32, 1024, 1024), (9, 3, 4, 2), (50, 1, 7, 3)])
def test_search_against_all_pairs(spark, monkeypatch, part, parts, tile, group):
    for name, value in (("PART_ROWS", part), ("LEAST_PARTS", parts), ("TILE_ROWS", tile), ("GROUP_ROWS", group)):
        monkeypatch.setattr(topk, name, value)
    rows = _odd_vectors(320)
    assert _rows(topk.top_k(_table(spark, rows)), "query_id", "rank", "vec_id", "score") == _best(rows)


def test_search_of_few_rows(spark):
    for rows in ([], [(100, None)], [(0, [1.0])], [(0, [1.0] * 6), (1, [2.0] * 6), (None, [3.0] * 6)], [(3, [1.0] * 6)] * 4):
        assert _rows(topk.top_k(_table(spark, rows)), "query_id", "rank", "vec_id", "score") == _best(rows)


def test_bounds_spare_most_products():
    """Vectors along few directions, of very different lengths: most pairs are never multiplied out, and nothing is lost."""
    r = np.random.default_rng(4)
    x = np.floor((r.standard_normal((4000, 4)) @ r.standard_normal((4, 32)) + 0.05 * r.standard_normal((4000, 32))) * r.lognormal(5, 1, (4000, 1))).astype(np.int64)
    length = np.sqrt(np.sum(x.astype(float) ** 2, axis=1))
    order = np.argsort(-length)
    turn = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1]
    q = np.arange(0, 4000, 100)
    best, done = topk.Best(10, np.full(len(q), -np.inf)), 0
    for i in range(0, 4000, 250):
        at = order[i : i + 250]
        tile = {"x": x[at], "lengths": length[at], "ids": at, "nulls": np.zeros(len(at), dtype=bool), "rows": at}
        active = np.flatnonzero(length[q] * length[at[0]] * (1 + topk.SLACK) >= best.marks)
        if len(active):
            done += topk.search_tile(best, active, x[q], q, x[q] @ turn, length[q], tile, turn)
    for k, i in enumerate(q):
        want = sorted((-int(x[i] @ x[j]), j) for j in range(4000) if j != i)[:10]
        assert [(-s, j) for s, j in zip(best.score[best.query == k].tolist(), best.id[best.query == k].tolist(), strict=True)] == want
    assert done < 0.2 * len(q) * 4000
