"""Centroid clustering against a plain model in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from data import NAMES

from strophe.llm import centroids


def plain(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [c for _, c in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda c: min((far(c, z), j) for j, z in enumerate(centres))
    for _ in range(rounds):
        mine = [nearest(c)[1] for _, c in kept]
        new = []
        for j, z in enumerate(centres):
            members = [c for (_, c), m in zip(kept, mine) if m == j]
            new.append([sum(x) // len(members) for x in zip(*members)] if members else z)
        centres = new
    found = [(i, *nearest(c)) for i, c in kept]
    small = lambda n: n if n < 1 << 63 else None
    per = [[d for _, d, m in found if m == j] for j in range(len(centres))]
    sums = [None if any(d >= 1 << 63 for d in ds) else small(sum(ds)) for ds in per]
    every = None if any(d >= 1 << 63 for _, d, _ in found) else small(sum(d for _, d, _ in found))
    names = [hashlib.sha256(",".join(map(str, z)).encode()).hexdigest() for z in centres]
    return sorted(((i, m, small(d), sums[m], every, names[m]) for i, d, m in found), key=repr)


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def run(spark, rows, kind="float", **k):
    extra = [c for c in (*NAMES, "c", "short", "cluster", "distance", "inertia", "high", "low", "hash") if c not in ("vec_id", "embedding")]
    extra = list(dict.fromkeys(extra))
    df = spark.createDataFrame([(i, e, *["x"] * len(extra)) for i, e in rows], f"vec_id long, embedding array<{kind}>, " + ", ".join(f"{c} string" for c in extra)).repartition(3)
    return sorted((tuple(r[c] for c in COLUMNS) for r in centroids.cluster(df, **k).collect()), key=repr)


def vectors(seed=1, n=150, spread=0.2):
    rng = random.Random(seed)
    hearts = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    near = lambda h: [float(np.float32(x + rng.gauss(0, spread))) for x in h]
    return [(i, near(hearts[i % 5])) for i in range(n)]


def test_against_plain(spark):
    good = vectors()
    bad = [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [None] + [0.5] * 63), (905, [float("nan")] + [0.5] * 63), (906, [float("inf")] * 64), (907, [-0.0] * 64)]
    odd = [(None, good[0][1]), (7, good[7][1]), (7, good[8][1]), (950, good[3][1]), (951, good[3][1])]  # null and repeated ids, equal vectors
    assert run(spark, good + bad + odd) == plain(good + bad + odd)


def test_hot_vector_and_ties(spark):
    rows = [(i, [0.25] * 64) for i in range(200)] + [(1000 + i, [0.0] * 32 + [x] * 32) for i, x in enumerate((0.5, -0.5, 0.5, -0.5))]
    assert run(spark, rows) == plain(rows)  # most centroids are equal, so the smallest number wins and others stay empty


def test_sizes(spark):
    few = vectors(2, 3)
    assert run(spark, few) == plain(few)
    assert run(spark, []) == [] and run(spark, [(1, None), (2, [1.0])]) == []
    assert centroids.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).columns == list(COLUMNS)


def test_wide_components(spark):
    """Where a square leaves 64 bits, integers of any size decide; what doesn't fit the result's type is null."""
    rng = random.Random(5)
    for size in (1e5, 1e7, 1e20, 3e38):
        rows = [(i, [float(np.float32(rng.uniform(-size, size))) for _ in range(64)]) for i in range(40)]
        assert run(spark, rows, rounds=3) == plain(rows, rounds=3)
    rows = [(i, [float(np.float32(x)) for x in np.random.default_rng(i).normal(0, 1, 64)]) for i in range(20)] + [(99, [1e300] + [0.0] * 63)]
    assert run(spark, rows, "double", rounds=2) == plain(rows[:-1], rounds=2)


def test_bounds_hold_and_screen():
    """No bound is above its distance, and on grouped vectors most centroids get no exact distance."""
    for seed, spread in ((1, 0.05), (2, 0.3), (3, 3.0)):
        c = np.floor(np.array([e for _, e in vectors(seed, 400, spread)]) * 1024)
        centres = [[int(x) for x in v] for v in c[:8]]
        short = centroids.compress(c)
        low = centroids.lower_bounds(short, centroids.compress(np.array(centres, float)))
        far = np.stack([centroids.distances(c, z, False) for z in centres], 1)
        assert (low <= far).all()
        where, best, exact = centroids.assign(c, short, centres)
        assert (best == far.min(1)).all() and (where == far.argmin(1)).all() and len(c) <= exact <= far.size
        if spread < 0.3:
            assert exact < 0.5 * far.size
    flat = np.full((5, 64), 3.0)
    assert centroids.assign(flat, centroids.compress(flat), [[3] * 64, [3] * 64])[0].tolist() == [0] * 5


@pytest.mark.parametrize("size", [1.0, 2.0**20, 2.0**27, 2.0**137])
def test_bounds_of_large_numbers(size):
    rng = np.random.default_rng(int(size) % 97)
    c = np.floor(rng.uniform(-size, size, (60, 64)))
    c[:20] = c[0] + np.floor(rng.uniform(0, 3, (20, 64)))  # nearly equal large vectors
    low = centroids.lower_bounds(centroids.compress(c), centroids.compress(c[:8]))
    for k in range(8):
        far = centroids.distances(c, [int(x) for x in c[k]], True)
        assert all(a <= b for a, b in zip(low[:, k].tolist(), far.tolist()))
