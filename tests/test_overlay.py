"""Dissolved outlines of polygons with different corners, and centroids on the sphere."""

import math
import random

import pytest
from compare import rows
from pyspark.sql import functions as F

from areaspark.operators import overlay, spatial

SCHEMA = "k string, x1 double, y1 double, x2 double, y2 double"


def ring(k, corners):
    return [(k, *a, *b) for a, b in zip(corners, [*corners[1:], corners[0]])]


def area(edges):
    return abs(sum(x1 * y2 - x2 * y1 for _, x1, y1, x2, y2 in edges)) / 2


def test_neighbours_with_different_corners(spark):
    """Two small boxes on top of a long one: the border cancels although no edge is the same."""
    edges = ring("g", [(0, 0), (4, 0), (4, 1), (0, 1)]) + ring("g", [(0, 1), (1, 1), (1, 2), (0, 2)]) + ring("g", [(1, 1), (3, 1), (3, 2), (1, 2)])
    df = spark.createDataFrame([(k, *map(float, e)) for k, *e in edges], SCHEMA)
    out = rows(overlay.dissolve(df, ["k"]))
    assert area(out) == 7.0
    # nothing of the shared border is left, the free part of it stays
    assert [r for r in out if r[2] == r[4] == 1.0] == [("g", 4.0, 1.0, 3.0, 1.0)]
    assert not [r for r in out if r[1] == r[3] == 1.0]


def test_groups_do_not_mix_and_null_keys_match(spark):
    edges = ring(None, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]) + ring(None, [(2.0, 0.0), (3.0, 0.0), (3.0, 1.0), (2.0, 1.0)])
    edges += ring("h", [(2.0, 1.0), (3.0, 1.0), (3.0, 2.0), (2.0, 2.0)]) + [("h", 1.0, 1.0, 1.0, 1.0)]
    out = rows(overlay.dissolve(spark.createDataFrame(edges, SCHEMA), ["k"]))
    assert area([r for r in out if r[0] is None]) == 5.0 and area([r for r in out if r[0] == "h"]) == 1.0
    assert overlay.dissolve(spark.createDataFrame([], SCHEMA), ["k"]).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_plane_cut_at_random(spark, seed):
    """Slanted strips, each cut at its own places and with corners of its own, dissolve to the whole."""
    rng = random.Random(seed)
    turn = lambda p: (0.6 * p[0] - 0.8 * p[1], 0.8 * p[0] + 0.6 * p[1])
    edges, members = [], []
    for strip in range(6):
        cuts = [0.0, *sorted(rng.uniform(0, 10) for _ in range(rng.randint(0, 8))), 10.0]
        for a, b in zip(cuts, cuts[1:]):
            low = [a, *sorted(rng.uniform(a, b) for _ in range(rng.randint(0, 3))), b]
            corners = [(x, float(strip)) for x in low] + [(b, strip + 1.0), (a, strip + 1.0)]
            members.append(ring("g", [turn(c) for c in corners]))
            edges += members[-1]
    out = overlay.dissolve(spark.createDataFrame(edges, SCHEMA), ["k"]).collect()
    assert area([tuple(r) for r in out]) == pytest.approx(60.0, abs=1e-6) == pytest.approx(sum(map(area, members)), abs=1e-6)
    # only pieces of the four outer sides are left
    for r in out:
        for x, y in ((r["x1"], r["y1"]), (r["x2"], r["y2"])):
            u, v = 0.6 * x + 0.8 * y, 0.6 * y - 0.8 * x
            assert min(abs(u), abs(u - 10), abs(v), abs(v - 6)) < 1e-8
    assert sum(math.hypot(r["x2"] - r["x1"], r["y2"] - r["y1"]) for r in out) == pytest.approx(32.0, abs=1e-6)


def test_long_edge_with_many_corners(spark):
    """1,000 small boxes along one edge; a corner meets the edges of its own cell only."""
    edges = ring("g", [(0.0, -1.0), (1000.0, -1.0), (1000.0, 0.0), (0.0, 0.0)])
    for n in range(1000):
        edges += ring("g", [(float(n), 0.0), (n + 1.0, 0.0), (n + 1.0, 1.0), (float(n), 1.0)])
    out = [tuple(r) for r in overlay.dissolve(spark.createDataFrame(edges, SCHEMA).repartition(4), ["k"]).collect()]
    assert area(out) == 2000.0 and len(out) == 1000 + 5


def test_octant_and_parts_on_the_sphere(spark):
    octant = [("o", 0.0, 0.0, 90.0, 0.0), ("o", 90.0, 0.0, 0.0, 90.0), ("o", 0.0, 90.0, 0.0, 0.0)]
    back = [("r", x2, y2, x1, y1) for _, x1, y1, x2, y2 in octant]
    twice = [("t", *e[1:]) for e in octant] + [("t", x1 + 90, y1, x2 + 90, y2) for _, x1, y1, x2, y2 in octant]
    cap = [("c", 120.0 * n, 60.0, 120.0 * (n + 1), 60.0) for n in range(3)]
    got = {r["k"]: r for r in overlay.sphere_centroids(spark.createDataFrame(octant + back + twice + cap, SCHEMA), ["k"]).collect()}
    tilt = math.degrees(math.atan(1 / math.sqrt(2)))
    for k in "or":
        assert (got[k]["size"], got[k]["X"], got[k]["Y"]) == pytest.approx((math.pi / 2, 45.0, tilt))
    assert (got["t"]["size"], got["t"]["X"], got["t"]["Y"]) == pytest.approx((math.pi, 90.0, 45.0))
    assert got["c"]["Y"] == pytest.approx(90.0) and 0 < got["c"]["size"] < 2 * math.pi * (1 - math.sin(math.radians(60)))


def test_small_polygon_is_planar_and_holes_count(spark):
    """Near the equator a box of a hundredth of a degree with a hole has the centroid of the plane."""
    outer = ring("h", [(0.0, 0.0), (0.04, 0.0), (0.04, 0.02), (0.0, 0.02)])
    hole = ring("h", [(0.01, 0.005), (0.01, 0.015), (0.02, 0.015), (0.02, 0.005)])
    df = spark.createDataFrame(outer + hole, SCHEMA)
    flat, round_ = spatial.centroids(df, ["k"]).first(), overlay.sphere_centroids(df, ["k"]).first()
    assert (round_["X"], round_["Y"]) == pytest.approx((flat["X"], flat["Y"]), abs=1e-8)
    assert round_["size"] == pytest.approx(flat["size"] * math.radians(1) ** 2, rel=1e-6)
    moved = df.withColumns({"y1": F.col("y1") + 60, "y2": F.col("y2") + 60})
    assert overlay.sphere_centroids(moved, ["k"]).first()["size"] == pytest.approx(round_["size"] * math.cos(math.radians(60.01)), rel=1e-4)


def test_across_the_date_line(spark):
    box = ring("d", [(179.0, 0.0), (-179.0, 0.0), (-179.0, 2.0), (179.0, 2.0)])
    got = overlay.sphere_centroids(spark.createDataFrame(box, SCHEMA), ["k"]).first()
    assert abs(got["X"]) == pytest.approx(180.0) and got["Y"] == pytest.approx(1.0, abs=1e-3)
