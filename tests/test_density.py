"""Density clusters against a plain version."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_functions import saver

from tesserae.operators import density as D
from tesserae.operators import measures as M


def brute(points, least, eps):
    ids = sorted(points)
    unit = np.array([points[i] for i in ids], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    far = np.round(1 - np.round(unit @ unit.T, 6), 6)
    core_distance = [float(np.sort(np.delete(far[k], k))[least - 2]) if len(ids) >= least else None for k in range(len(ids))]
    if eps is None:
        eps = round(float(np.percentile([c for c in core_distance if c is not None], 75)), 6)
    core = [c is not None and c <= eps for c in core_distance]
    cluster = {}
    for k in range(len(ids)):
        if core[k] and k not in cluster:
            open_, cluster[k] = [k], ids[k]
            while open_:
                x = open_.pop()
                for y in range(len(ids)):
                    if core[y] and y not in cluster and far[x][y] <= eps:
                        cluster[y] = ids[k]
                        open_.append(y)
    out = {}
    for k, i in enumerate(ids):
        near = [(far[k][y], ids[y], cluster[y]) for y in range(len(ids)) if core[y] and y != k and far[k][y] <= eps]
        out[i] = (cluster[k] if core[k] else min(near)[2] if near else D.NOISE, core_distance[k])
    return out


@pytest.mark.parametrize("rows, eps", [(4096, 0.02), (7, 0.02), (13, None)])
def test_clusters(spark, tmp_path, rows, eps):
    """Arcs, dense groups with copies, chains over many blocks, and lone points."""
    rng = random.Random(2)
    angles = [rng.gauss(0.5, 0.05) for _ in range(25)] + [2 + 0.11 * k for k in range(20)] + [4.0] * 6 + [rng.uniform(0, 6.28) for _ in range(9)]
    ids = rng.sample(range(1000), len(angles))
    points = {i: [math.cos(a), math.sin(a), rng.uniform(-0.05, 0.05)] for i, a in zip(ids, angles, strict=True)}
    df = spark.createDataFrame([(i, v) for i, v in points.items()], "id long, v array<double>")
    got = {r.id: (r.cluster, r.core) for r in D.density_clusters(df, saver(spark, str(tmp_path)), 5, eps, rows).collect()}
    want = brute(points, 5, eps)
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 1e-6 for i in want)
    assert len({c for c, _ in want.values()}) > 2 and D.NOISE in {c for c, _ in want.values()}


def test_clusters_of_copies(spark, tmp_path):
    """Copies of one vector in all blocks, vectors in single precision, and vectors without length, which are near none."""
    rng = random.Random(6)
    points = {i: [1.0, 2.0, 0.5] if i % 2 else [float(rng.randint(-1, 1)) or 2.0 for _ in range(3)] for i in range(120)}
    df = spark.createDataFrame([(i, v) for i, v in points.items()] + [(500, [0.0] * 3), (501, [0.0] * 3)], "id long, v array<double>")
    got = {r.id: (r.cluster, r.core) for r in D.density_clusters(df, saver(spark, str(tmp_path)), 4, 0.004, 9).collect()}
    want = brute(points, 4, 0.004)
    assert {got.pop(500), got.pop(501)} == {(D.NOISE, None)}
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()} and len({c for c, _ in want.values()}) > 2
    assert all(abs(got[i][1] - want[i][1]) < 1e-6 for i in want)


def test_vectors_are_stored_once(spark, tmp_path):
    """Blocks meet where they are saved: no vector is written out for each pair of blocks, and items are grouped without vectors."""
    plans, seen, inner = [], [], saver(spark, str(tmp_path))

    def save(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        seen.append(inner(df))
        return seen[-1]

    df = spark.range(600).selectExpr("id", "array(cos(id * 0.37), sin(id * 0.37), 0.1 * (id % 7)) as v")
    assert D.density_clusters(df, save, 5, None, 10).count() == 600
    assert not [p for p in plans if "explode" in p] and sum("CartesianProduct" in p for p in plans) == 2
    assert sum(x.agg(F.sum("n")).first()[0] for x in seen if "v" in x.columns) == 600


def test_vectors_of_two_lengths_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.5, 1.0])], "id long, v array<double>").coalesce(1)
    with pytest.raises(Exception, match="one length"):
        D.density_clusters(df, saver(spark, str(tmp_path)))


def test_few_points(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "id long, v array<double>")
    assert {tuple(r) for r in D.density_clusters(df, saver(spark, str(tmp_path / "a"))).collect()} == {(1, D.NOISE, None), (2, D.NOISE, None)}
    assert D.density_clusters(df.limit(0), saver(spark, str(tmp_path / "b"))).count() == 0


def test_connected(spark, tmp_path):
    """A long chain, a star, loops, copies of an edge and both directions."""
    rng = random.Random(4)
    chain = list(range(100, 140))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:], strict=False)) + [(7, k) for k in range(8, 30)] + [(3, 3), (2, 1), (1, 2), (2, 1)]
    got = {r.id: r.root for r in D.connected(spark.createDataFrame(edges, "a long, b long"), saver(spark, str(tmp_path))).collect()}
    assert got == {k: 100 for k in chain} | {k: 7 for k in range(7, 30)} | {1: 1, 2: 1}


def test_ratings_leave_noise_out(spark):
    rows = [(k % 3, "abc"[k % 3]) for k in range(30)] + [(-1, "a")] * 20
    df = spark.createDataFrame(rows, "cluster int, category string")
    assert tuple(M.adjusted_rand(df, "cluster", "category", noise=-1).first()) == (1.0, "strong")
    assert M.adjusted_rand(df, "cluster", "category").first().ari < 1
    assert tuple(M.adjusted_rand(df.limit(0), "cluster", "category", noise=-1).first()) == (0.0, "weak")
    assert sorted(map(tuple, M.composition(df, "cluster", "category", noise=-1).collect())) == [(0, "a", 10), (1, "b", 10), (2, "c", 10)]
