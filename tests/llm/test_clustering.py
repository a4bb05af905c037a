"""Centroid clustering against plain Lloyd rounds; cover trees against their definition."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from ledgerloom.llm import centroid_clustering
from ledgerloom.llm.centroid_clustering import CoverTree, assign, cluster_vectors, squared

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string"


def brute(rows, clusters, rounds, size=64):
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, *_ in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:clusters]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
        return min(range(len(d)), key=lambda k: (d[k], k)), min(d)

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(nearest(v)[0], []).append(v)
        for c, vs in own.items():
            centroids[c] = [sum(col) // len(vs) for col in zip(*vs, strict=True)]
    got = [(i, *nearest(v)) for i, v in kept]
    by = {}
    for _, c, d in got:
        by[c] = by.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, by[c], sum(by.values()), digest[c]) for i, c, d in got), key=repr)


def vectors(seed, n=150):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    rows = [(k, [x + rng.gauss(0, rng.choice([0.01, 0.3])) for x in rng.choice(middles)], "x", "y") for k in range(n)]
    rows += [(1000 + k, rows[3][1], "x", "y") for k in range(40)]  # one vector that many have
    rows += [(2000 + k, [round(x) / 256 for x in rng.choices([0, 1], k=64)], None, None) for k in range(20)]
    nan = float("nan")
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [0.0] * 63, [nan] + [0.0] * 63, [float("-inf")] + [0.0] * 63]
    rows += [(3000 + k, v, "x", "y") for k, v in enumerate(bad)]
    return [*rows, rows[5], rows[5], (None, rows[7][1], "x", "y"), (9, rows[8][1], "x", "y")]


@pytest.mark.parametrize("block, leaf, clusters", [(2048, 24, 40), (50, 4, 7)])
def test_clusters(spark, monkeypatch, block, leaf, clusters):
    monkeypatch.setattr(centroid_clustering, "BLOCK", block)
    monkeypatch.setattr(centroid_clustering, "LEAF", leaf)
    rows = vectors(clusters)
    got = cluster_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), clusters=clusters).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, clusters, 5)


def test_few_and_none(spark):
    rows = [(1, [0.5] * 64, "x", "y"), (2, [0.25] * 64, "x", "y"), (3, [0.25] * 64, "x", "y")]
    assert sorted(map(tuple, cluster_vectors(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == brute(rows, 40, 5)
    for rows in ([], [(1, None, "x", "y")], [(1, [float("nan")] * 64, "x", "y")]):
        assert cluster_vectors(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_large_components(spark):
    """Beyond what doubles hold exactly; and so large that a distance is no long."""
    rng = random.Random(1)
    rows = [(k, [rng.choice([-1, 1]) * rng.uniform(1e4, 5e5) for _ in range(64)], "x", "y") for k in range(30)]
    got = cluster_vectors(spark.createDataFrame([*rows, (99, [1e300] * 64, "x", "y")], SCHEMA), clusters=4).collect()
    assert sorted(((*r[:3], r[5]) for r in map(tuple, got)), key=repr) == [(*r[:3], r[5]) for r in brute(rows, 4, 5)]


@pytest.mark.parametrize("seed", range(4))
def test_cover_trees(seed):
    rng = np.random.default_rng(seed)
    middles = rng.integers(-300, 300, (6, 8))
    points = np.unique(middles[rng.integers(0, 6, 700)] + rng.integers(-9, 9, (700, 8)), axis=0)
    tree = CoverTree(points, 10)
    assert sorted(tree.order) == list(range(len(points)))
    far = np.sqrt(squared(points, points))
    for i in range(len(tree.centre)):
        own = tree.order[tree.lo[i] : tree.hi[i]]
        assert tree.centre[i] in own and far[tree.centre[i], own].max() <= tree.radius[i]
        if tree.n_children[i]:
            children = range(tree.first[i], tree.first[i] + tree.n_children[i])
            assert [tree.lo[c] for c in children] + [tree.hi[i]] == [tree.lo[i]] + [tree.hi[c] for c in children]
        else:
            assert len(own) <= 10 or tree.radius[i] == 0
    again = CoverTree.unpack(tree.pack())
    assert all(np.array_equal(getattr(tree, f), getattr(again, f)) for f in CoverTree.FIELDS)
    centroids = middles + rng.integers(-3, 3, middles.shape)
    whole, each = assign(points, tree, centroids, CoverTree(centroids, 1))
    got = np.empty(len(points), int)
    for lo, hi, c in (*whole, *each):
        got[tree.order[lo:hi]] = c
    assert np.array_equal(got, squared(points, centroids).argmin(1))
    assert sum(hi - lo for lo, hi, _ in whole) > len(points) / 2  # most vectors are settled by their node alone
