"""Centroid clustering against plain integer arithmetic."""

import hashlib
import math
import random

import numpy as np
import pytest

from areaspark.llm import centroids


def plain(rows, count=16, rounds=3):
    """(id, cluster, distance) of every kept row, and the centroids; Python integers throughout."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * float(x)) for x in v]))
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:count]
    at = [list(v) for _, v in first]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(at))

    for _ in range(rounds):
        own = [[] for _ in at]
        for _, v in kept:
            own[place(v)[1]].append(v)
        at = [[sum(x) // len(o) for x in zip(*o)] if o else c for o, c in zip(own, at)]
    return [(i, *place(v)[::-1]) for i, v in kept] if at else [], at


def same(table, rows, kind="float", **more):
    df = table([(i, v, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster string")
    found, last = centroids.cluster(df, **more)
    want, at = plain(rows, more.get("count", 16), more.get("rounds", 3))
    got = sorted((tuple(r) for r in found.collect()), key=str)
    each = {k: sum(d for _, c, d in want if c == k) for k in range(len(at))}
    assert got == sorted(((i, c, d, each[c], sum(each.values())) for i, c, d in want), key=str)
    assert last == at
    return got


def numbers(rng, n, scale=1.0):
    centres = [[rng.gauss(0, scale) for _ in range(64)] for _ in range(9)]
    return [[float(np.float32(x + rng.gauss(0, scale / 3))) for x in rng.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_plain_arithmetic(table, seed):
    rng = random.Random(seed)
    vectors = numbers(rng, 300)
    vectors += vectors[:40]  # ties and repeated vectors
    same(table, list(enumerate(vectors)))


def test_odd_vectors_and_rows(table):
    rng = random.Random(5)
    v = numbers(rng, 60)
    rows = list(enumerate(v)) + [(3, v[3]), (3, v[4]), (None, v[5]), (100, None), (101, []), (102, v[0][:63]), (103, [*v[0], 1.0])]
    rows += [(104, [float("nan"), *v[0][1:]]), (105, [*v[0][:63], float("inf")]), (106, [None, *v[0][1:]]), (107, [-0.0] * 64), (108, [0.0] * 64)]
    same(table, rows, "double")


def test_fewer_vectors_than_centroids_and_none(table):
    v = numbers(random.Random(6), 5)
    assert len(same(table, list(enumerate(v)))) == 5
    assert same(table, [(1, None), (2, [1.0])]) == []
    assert same(table, []) == []


def test_one_hot_vector_and_empty_centroids(table):
    v = numbers(random.Random(7), 30)
    same(table, list(enumerate([v[0]] * 200 + v)))
    same(table, list(enumerate([v[0]] * 40)))


def test_large_components_stay_exact(table):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-6e5, 6e5) for _ in range(64)]) for i in range(24)]
    same(table, rows, "double")
    with pytest.raises(OverflowError):
        centroids.cluster(table([(i, [2e6 * (-1) ** i] * 64) for i in range(40)], "vec_id long, embedding array<double>"), count=1)
    beyond = centroids.cluster(table([(1, [3e6] * 64), (2, [1e300] * 64)], "vec_id long, embedding array<double>"))
    assert beyond[0].count() == 0 and beyond[1] == []


def test_transform_keeps_distances():
    rng = np.random.default_rng(9)
    a, b = rng.integers(-900, 900, (2, 50, 64))
    wide = ((centroids.transform(a) - centroids.transform(b)) ** 2).sum(1)
    assert (wide == 64 * ((a - b) ** 2).sum(1)).all()
    order = centroids.coarse_to_fine(64)
    assert sorted(order) == list(range(64)) and order[0] == 0 and centroids.steps(64)[-1] == (32, 64)
    with pytest.raises(ValueError):
        centroids.cluster(None, size=48)
