"""Vector codes and whitening against plain versions, and the parts that these stand on."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.llm import covertree, queries, whitening


def awkward(d=16, n=700, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, d))
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 5] + rng.normal(size=d) * 0.05], int(i % 7) if i % 11 else None) for i in rng.permutation(n)]
    copy = rows[0][1]
    rows += [(1000 + i, copy, 3) for i in range(300)]  # one hot group
    rows += [(5, rows[1][1], 1), (None, rows[2][1], 2), (2000, [0.0] * d, None), (2001, [-v for v in copy], 8), (2002, copy, 8), (2002, copy, 8)]
    rows += [(3000, None, 1), (3001, [*copy[:-1], None], 1), (3002, [*copy[:-1], math.inf], 1), (3003, [*copy[:-1], math.nan], 1), (3004, copy[:-1], 1), (3005, [], 1)]
    return rows


def frame(spark, rows):
    extra = {c: F.lit("own") for c in ("id", "code", "error", "n", "component", "_label", "ids", "trees")}
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4).withColumns(extra)


def kept(rows, d):
    return [r for r in rows if r[1] is not None and len(r[1]) == d and all(x is not None and math.isfinite(x) for x in r[1])]


def plain_codes(rows, d, parts=8, entries=16, rounds=6):
    rows = sorted(kept(rows, d), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    wide = d + -d % parts
    numbers = [[math.floor(4096 * x) for x in r[1]] + [0] * (wide - d) for r in rows]
    w = wide // parts
    cut = [[v[p * w : (p + 1) * w] for v in numbers] for p in range(parts)]
    book = [[list(x) for x in cut[p][:entries]] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, x: min(range(len(book[p])), key=lambda e: (apart(x, book[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for x in cut[p]:
                groups.setdefault(nearest(p, x), []).append(x)
            for e, xs in groups.items():
                book[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for i, r in enumerate(rows):
        codes = [nearest(p, cut[p][i]) for p in range(parts)]
        out.append([r[0], r[2], bytes(codes).hex(), min(sum(apart(cut[p][i], book[p][c]) for p, c in enumerate(codes)), (1 << 63) - 1)])
    totals = {}
    for r in out:
        totals[r[1]] = totals.get(r[1], 0) + r[3]
    return [(*r, min(totals[r[1]], (1 << 63) - 1)) for r in out], hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()


@pytest.mark.parametrize("d", [16, 13])
def test_codes(spark, d):
    rows = awkward(d)
    got, book = covertree.vector_codes(frame(spark, rows))
    want, digest = plain_codes(rows, d)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and covertree.book_digest(book) == digest


def test_codes_of_few_and_of_huge_vectors(spark):
    big, low, high = (float(np.float32(x)) for x in (1e12, -3e15, 2e15))
    few = [(1, [0.5] * 8, 1), (2, [0.25] * 8, None), (3, [big, *[low] * 7], 1), (4, [big, *[low] * 6, high], 1)]
    got, book = covertree.vector_codes(frame(spark, few))
    want, digest = plain_codes(few, 8)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and covertree.book_digest(book) == digest
    none, book = covertree.vector_codes(frame(spark, [(1, None, 1), (2, [], 1)]))
    assert none.collect() == [] and book == []


def test_cover_tree():
    rng = np.random.default_rng(1)
    points = np.unique(np.concatenate([rng.integers(-50, 50, (300, 4)), rng.integers(0, 3, (200, 4)), rng.integers(3000, 3040, (500, 4))]), axis=0).astype(float)
    tree, place = covertree.CoverTree.built(points, np.ones(len(points), np.int64))
    assert (tree.points[place] == points).all() and sorted(place) == list(range(len(points)))
    for node in range(len(tree.first)):
        a, b = tree.low[node], tree.high[node]
        assert tree.first[node] == a and np.sqrt(((tree.points[a:b] - tree.points[a]) ** 2).sum(axis=1)).max() == tree.radius[node]
        below = range(tree.child_from[node], tree.child_to[node])
        assert not below or (tree.low[below[0]] == a and tree.high[below[-1]] == b and all(tree.high[i] == tree.low[i + 1] for i in below[:-1]))
        # Children that entered together are farther from each other than half of what the farthest of them is from the node.
        entered = tree.points[[tree.first[i] for i in below[1:]]]
        if len(entered) > 1:
            apart = np.sqrt(((entered[:, None] - entered[None]) ** 2).sum(axis=2))[~np.eye(len(entered), dtype=bool)]
            assert apart.min() > np.sqrt(((entered - tree.points[a]) ** 2).sum(axis=1)).max() / 2 - 1e-9
    entries = np.concatenate([points[::97], points[::97][:3]]).astype(np.int64)  # ties among equal entries
    labels, count = tree.assigned(entries)
    want = covertree.squared(tree.points.astype(np.int64), entries).argmin(axis=1)
    assert (labels == want).all()
    sums, n = tree.sums(labels, len(entries))
    assert all((sums[e] == tree.points[want == e].sum(axis=0)).all() and n[e] == (want == e).sum() for e in range(len(entries)))


def test_subtrees_spare_comparisons():
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (16, 8))
    points = np.unique(np.concatenate([c + rng.integers(-30, 30, (60, 8)) for c in centres]), axis=0).astype(float)
    tree, _ = covertree.CoverTree.built(points, np.ones(len(points), np.int64))
    labels, count = tree.assigned(centres.astype(np.int64))
    assert (labels == covertree.squared(tree.points.astype(np.int64), centres.astype(np.int64)).argmin(axis=1)).all()
    assert count < len(points) * len(centres) / 4


def test_cholesky_and_jacobi():
    rng = np.random.default_rng(4)
    for rank, d in ((12, 12), (5, 12), (1, 3)):
        base = rng.normal(size=(d, rank)) * np.logspace(0, -5, rank)
        a = base @ base.T
        factor, order = whitening.pivoted_cholesky(a)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, a[np.ix_(order, order)], atol=1e-14) and (np.diff(np.diagonal(factor)) <= 0).all() and np.allclose(np.triu(factor, 1), 0)
        values, vectors = whitening.principal(a)
        # Singular values of the base are the roots: small ones too, which the product alone would lose.
        assert np.allclose(values, np.linalg.svd(base)[1][:rank] ** 2, rtol=1e-5) and np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-12)
        assert np.allclose(a @ vectors, vectors * values, atol=1e-12)
    assert whitening.principal(np.zeros((3, 3)))[1].shape == (3, 0)


def plain_whitening(rows, d):
    rows = kept(rows, d)
    x = [[math.floor(64 * v) + 1_000_000 for v in r[1]] for r in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[(n * v - s) / n for v, s in zip(row, sums, strict=True)] for row in x])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    return rows, [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x], centred @ vectors[:, ::-1], values[::-1], covariance


def test_whitening(spark):
    d = 16
    rows = [(i, v, label) for i, (_, v, label) in enumerate(awkward(d, 400))]
    got = whitening.whiten(frame(spark, rows)).collect()
    own, deviations, turned, values, covariance = plain_whitening(rows, d)
    assert len(got) == len(own) * d and {r["n"] for r in got} == {len(own)}
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert all(by[r[0], 1]["deviation"] == deviations[i] for i, r in enumerate(own))
    white = np.array([[by[r[0], k + 1]["whitened"] for k in range(d)] for r in own])
    want = turned / np.sqrt(values)
    assert np.allclose(white * np.sign((white * want).sum(axis=0)), want, atol=1e-6)
    assert np.allclose([by[own[0][0], k + 1]["explained"] for k in range(d)], values / np.trace(covariance), rtol=1e-9)
    assert np.allclose(white.T @ white / len(own), np.eye(d), atol=1e-8) and got[0]["identity_error"] < 1e-9


def test_whitening_without_full_rank(spark):
    rows = [(i, [float(i % 5), 1.0, 2.0 * (i % 5), 3e18], 1) for i in range(40)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 160 and {r["component"] for r in got if r["whitened"] is not None} == {1} and sum(r["explained"] for r in got) == pytest.approx(40)
    assert len(whitening.whiten(frame(spark, rows[:1])).collect()) == 4 and whitening.whiten(frame(spark, [(1, None, 1)])).collect() == []
    far = [(1, [-1e14, 0.0], 1), (2, [1e14, 1.0], 1), (3, [0.0, 0.5], 1)]
    assert {r["deviation"] for r in whitening.whiten(frame(spark, far)).collect()} == {None, (3 * 32 - 96) ** 2}


def test_registered(spark, tmp_path):
    frame(spark, awkward(64, 300)).select("vec_id", "embedding", "label").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert queries.op13_whitening(spark, str(tmp_path)).count() == len(kept(awkward(64, 300), 64)) * 32
    row = queries.op12_vector_codes(spark, str(tmp_path)).first()
    assert set(row.asDict()) == {"vec_id", "code", "error", "label_error", "codebooks_sha256"} and len(row["code"]) == 16 and json.dumps(row["error"])
