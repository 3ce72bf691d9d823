"""Skew, spatial brute force and plan shape."""

import math
import random
import re

import pytest
from compare import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from areaspark.operators import joins, overlay, spatial, windows
from areaspark.plans import locate, survey
from areaspark.plans.survey import City

FOLDER = "/root/testdata/sf0.001"


def _hot(spark, n=3000):
    """A third of all rows under one key, many of them exact copies."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
        F.lit("v").alias("variable"),
        F.when(F.col("id") % 3 == 0, F.lit(2.0)).otherwise((F.col("id") % 7).cast("double")).alias("estimate"),
    )


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _runs(df):
    """Executed plan after a run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_join_reads_only_what_is_asked(spark):
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    parts = spark.read.parquet(f"{FOLDER}/part.parquet").select("p_partkey", "p_brand")
    joined = joins.null_safe_join(lines, parts, {"l_partkey": "p_partkey"}).where("l_returnflag = 'R'").select("l_orderkey", "p_brand")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "lineitem" in x)
    assert "EqualTo(l_returnflag,R)" in scan
    schema = re.search(r"ReadSchema: struct<([^>]*)", scan)[1]
    assert sorted(c.split(":")[0] for c in schema.split(",")) == ["l_orderkey", "l_partkey", "l_returnflag"]


def test_equal_rows_of_a_hot_key_are_split(spark, no_broadcast):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(0, 60_000, 1, 16).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.lit("equal").alias("v"))
        small = df.select("k").distinct().withColumn("n", F.length("k"))
        joined = joins.null_safe_join(df, small, ["k"])
        assert "skew=true" in _runs(joined) and joined.count() == 60_000
        total = joins.null_safe_join(df, small, ["k"], "left").groupBy("k").agg(F.sum("n").alias("s"))
        assert "skew=true" in _runs(total)
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_group_total_on_a_hot_key(spark, no_broadcast):
    added = windows.with_group_values(_hot(spark), ["k"], {"total": F.sum("estimate")})
    out = added.groupBy("k").agg(
        F.count("*").alias("n"), F.min("total").alias("a"), F.max("total").alias("b"), F.sum("estimate").alias("s")
    )
    assert all(r["a"] == r["b"] == pytest.approx(r["s"]) for r in out.collect())
    assert out.where("k = 'hot'").first()["n"] == 1000


def test_apportion_on_a_hot_source(spark):
    df = _hot(spark).withColumnRenamed("k", "GEOID")
    cross = df.select("GEOID").distinct().select("GEOID", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("hood")).withColumn(
        "Allocation", F.when(F.col("hood") == "A", 0.25).otherwise(0.75)
    )
    total = df.agg(F.sum("estimate")).first()[0]
    got = dict(survey.apportion(df, cross, "GEOID", ["hood"]).select("hood", "estimate").collect())
    assert got == pytest.approx({"A": total * 0.25, "B": total * 0.75})


SHAPES = {
    "concave": [(0, 0), (4, 0), (4, 4), (2, 1.5), (0, 4)],
    "square": [(1, 1), (6, 1), (6, 6), (1, 6)],
    "sliver": [(-3, -3), (5, 5.1), (5, 5.3)],
    "far": [(20, 20), (21, 20), (21, 21)],
}


def _edges(spark):
    out = []
    for name, ring in SHAPES.items():
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            out.append((name, float(ax), float(ay), float(bx), float(by)))
    return spark.createDataFrame(out, "area string, x1 double, y1 double, x2 double, y2 double")


def _inside(ring, x, y):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        if cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def test_cells_do_not_grow_with_a_polygon(spark):
    corners = [(0, 0), (400, 0), (400, 400), (0, 400)]
    edges = spark.createDataFrame([("a", *map(float, p), *map(float, q)) for p, q in zip(corners, corners[1:] + corners[:1])], "area string, x1 double, y1 double, x2 double, y2 double")
    assert spatial.polygon_cells(edges, ["area"], 0.25).count() < 4000
    points = spark.createDataFrame([(1, 399.9, 0.1), (2, 400.1, 5.0), (3, 200.0, 200.0), (4, 0.0, 77.7), (5, None, 1.0)], "id int, X double, Y double")
    both = edges.unionByName(_edges(spark))
    got = rows(spatial.points_in_polygons(points, both, ["area"], how="left").select("id", "area"))
    assert got == [(1, "a"), (2, None), (3, "a"), (4, "a"), (5, None)]


def test_copies_of_a_round_polygon(spark):
    """A circle with 20,000 corners: an edge is copied once per cell it passes; points against the true circle."""
    n = 20_000
    ring = [(5 + 3 * math.cos(2 * math.pi * k / n), 5 + 3 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    edges = spark.createDataFrame([("o", *p, *q) for p, q in zip(ring, ring[1:] + ring[:1])], "area string, x1 double, y1 double, x2 double, y2 double")
    cells = spatial.polygon_cells(edges, ["area"], 0.01)
    copies = cells.agg(F.sum(F.when(F.col("edges").isNotNull(), F.size("edges")))).first()[0]
    assert copies < 30_000
    rnd = random.Random(3)
    pts = [(k, rnd.uniform(1.5, 8.5), rnd.uniform(1.5, 8.5)) for k in range(3_000)]
    got = {r["ID"] for r in spatial.points_in_polygons(spark.createDataFrame(pts, "ID int, X double, Y double"), edges, ["area"], cell=0.01).collect()}
    assert got == {k for k, x, y in pts if math.hypot(x - 5, y - 5) < 3}


@pytest.mark.parametrize("aside", [spatial.ASIDE, 0.0])
def test_grid_lines_through_corners(spark, monkeypatch, aside):
    """Polygons and points on the grid itself, also with grid lines on round coordinates."""
    monkeypatch.setattr(spatial, "ASIDE", aside)
    rings = {"a": [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)], "b": [(0, 0), (0, 3), (3, 3), (3, 0), (2, 0), (2, 2), (1, 2), (1, 0)], "c": [(-1, 0), (1, 2), (3, 0), (1, -2)]}
    rows_ = [(k, *map(float, p), *map(float, q)) for k, ring in rings.items() for r in (ring,) for p, q in zip(r, r[1:] + r[:1])]
    edges = spark.createDataFrame(rows_, "area string, x1 double, y1 double, x2 double, y2 double")
    pts = [(31 * i + j, -2 + i / 5, -3 + j / 5) for i in range(31) for j in range(31)]
    want = sorted((a, k) for k, x, y in pts for a, ring in rings.items() if _inside(ring, x, y))
    got = spatial.points_in_polygons(spark.createDataFrame(pts, "ID int, X double, Y double"), edges, ["area"], cell=0.5)
    assert sorted((r["area"], r["ID"]) for r in got.collect()) == want


@pytest.mark.parametrize("cell", [0.02, 0.3, 1.0, 7.0])
def test_points_in_polygons_against_brute_force(spark, cell):
    rnd = random.Random(5)
    pts = [(i, rnd.uniform(-4, 8), rnd.uniform(-4, 8)) for i in range(800)]
    pts += [(800 + i, float(i % 9 - 2), float(i // 9 - 2)) for i in range(81)]
    pts += [(900 + i, 1.0, 1.0) for i in range(300)]
    want = sorted((a, i) for i, x, y in pts for a, ring in SHAPES.items() if _inside(ring, x, y))
    df = spark.createDataFrame(pts, "ID int, X double, Y double")
    got = spatial.points_in_polygons(df, _edges(spark), ["area"], cell=cell)
    assert sorted((r["area"], r["ID"]) for r in got.collect()) == want
    left = spatial.points_in_polygons(df, _edges(spark), ["area"], cell=cell, how="left")
    assert left.select("ID").distinct().count() == len(pts)
    assert left.where("area is null").count() == len(pts) - len({i for _, i in want})
    poly = spatial.polygons_with_points(df, _edges(spark), ["area"], cell=cell)
    assert poly.where("area = 'far'").collect()[0]["ID"] is None


def test_dissolve_and_centroid(spark):
    cells = []
    for i in range(3):
        for j in range(2):
            ring = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]
            cells += [("g", float(ax), float(ay), float(bx), float(by)) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1])]
    edges = spark.createDataFrame(cells, "area string, x1 double, y1 double, x2 double, y2 double")
    outline = overlay.dissolve(edges, ["area"])
    assert outline.count() == 10
    r = spatial.centroids(outline, ["area"]).first()
    assert (r["size"], r["X"], r["Y"]) == pytest.approx((6.0, 1.5, 1.0))


def test_two_stage_drops_borders_and_keeps_two_hoods(spark):
    def box(cols, x, y, w):
        ring = [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
        return [(*cols, float(ax), float(ay), float(bx), float(by)) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1])]

    munis = spark.createDataFrame(box(("c", "City"), 0, 0, 2) + box(("c", "Other"), 2, 0, 2), "County string, Municipality string, x1 double, y1 double, x2 double, y2 double")
    hoods = spark.createDataFrame(box(("H1",), 0, 0, 1) + box(("H2",), 0.5, 0, 1), "Neighborhood string, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(0.2, 0.2), (0.2, 0.2), (0.7, 0.5), (2.0, 1.0), (3.0, 1.0), (1.9, 1.9), (9.0, 9.0), (None, None)], "X double, Y double")
    got = locate.two_stage(pts, munis, hoods, City("City", "c", "Ohio"))
    assert sorted((r["X"], r["Neighborhood"]) for r in got.collect()) == [(0.2, "H1"), (0.7, "H1"), (0.7, "H2"), (3.0, "Other")]


PLANS = [
    "theme_race", "apportion_crosswalk", "cohort_registry", "cohort_admissions", "join_nullsafe_sql", "join_valid_time",
    "spatial_join_inner", "win_group_total", "win_row_number_ordered", "join_cross_scalar", "bench_mean_min_max", "flag_condition",
]


@pytest.mark.parametrize("key", PLANS)
def test_plan_shape(spark, no_broadcast, key):
    """Equality keys everywhere, no Python workers, no window over a whole table."""
    plan = entry.queries()[key](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for word in ("NestedLoop", "Cartesian", "Python", "Pandas"):
        assert word not in plan
    lines = plan.splitlines()
    whole = [i for i, line in enumerate(lines) if re.search(r"\bWindow \[", line) and "SinglePartition" in "".join(lines[i : i + 4])]
    # dense ids add up the sizes of at most 65 ranges in one task
    assert len(whole) <= (1 if key == "win_row_number_ordered" else 0)


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["pred_year_in"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate,1997-01-01" in plan
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_shipdate:timestamp_ntz>", plan)
