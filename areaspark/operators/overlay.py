"""Outlines of unions, and centroids on the sphere, of polygons given as edge tables.

Polygons of a group need not have the same corners on a shared border: every edge is first cut at the corners of the group that
lie on it (noding), so that what two members share becomes equal pieces, which cancel. Corners meet edges in grid cells
of about as many as the group has edges, so neither a long edge nor a large group meets all corners.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaspark.operators import joins
from areaspark.operators.spatial import EDGE

#: Cells that a group is wide or high, at most.
MOST = 4_096


def _cell(v: Column, low: Column, size: Column) -> Column:
    return F.floor((v - low) / size).cast("long")


def _upto(a: Column, b: Column) -> Column:
    return F.explode(F.sequence(F.least(a, b), F.greatest(a, b)))


def noded(edges: DataFrame, keys: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Every edge in the pieces between the corners of its group that lie on it, at most ``tolerance`` away.

    The pieces run like the edge and end exactly in those corners. Edges without length drop out.
    """
    keys = list(keys)
    low = lambda a, b: F.min(F.least(a, b))
    wide = F.greatest(F.max(F.greatest("x1", "x2")) - low("x1", "x2"), F.max(F.greatest("y1", "y2")) - low("y1", "y2"))
    cells = F.least(F.ceil(F.sqrt(F.count(F.lit(1)))), F.lit(MOST))
    grids = edges.groupBy(*keys).agg(low("x1", "x2").alias("gx"), low("y1", "y2").alias("gy"), wide.alias("wide"), cells.alias("cells"))
    grids = grids.select(*keys, "gx", "gy", F.when(F.col("wide") > 0, F.col("wide") / F.col("cells")).otherwise(1.0).alias("size"))
    placed = joins.null_safe_join(edges.select(*keys, *EDGE).where("x1 <> x2 OR y1 <> y2"), grids, keys)

    gx, gy, size = F.col("gx"), F.col("gy"), F.col("size")
    corners = placed.select(*keys, F.col("x1").alias("x"), F.col("y1").alias("y"), "gx", "gy", "size").union(
        placed.select(*keys, "x2", "y2", "gx", "gy", "size")
    )
    corners = corners.select(*keys, "x", "y", _cell(F.col("x"), gx, size).alias("cx"), _cell(F.col("y"), gy, size).alias("cy")).distinct()

    # the cells within the tolerance of an edge: in each grid row those of its part in the row
    near = F.lit(tolerance)
    rows = placed.withColumn("cy", _upto(_cell(F.least("y1", "y2") - near, gy, size), _cell(F.greatest("y1", "y2") + near, gy, size)))
    rise, run = F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")
    row_low, row_high = gy + F.col("cy") * size - near, gy + (F.col("cy") + 1) * size + near
    clip = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    from_, to = (F.when(rise == 0, F.lit(float(n))).otherwise(clip(F.try_divide(y - F.col("y1"), rise))) for n, y in enumerate((row_low, row_high)))
    ax, bx = F.col("x1") + from_ * run, F.col("x1") + to * run
    passed = rows.withColumn("cx", _upto(_cell(F.least(ax, bx) - near, gx, size), _cell(F.greatest(ax, bx) + near, gx, size)))

    # where along the edge a corner lies, 0 to 1, and how far beside it
    length2 = run * run + rise * rise
    along = ((F.col("x") - F.col("x1")) * run + (F.col("y") - F.col("y1")) * rise) / length2
    aside = F.abs((F.col("x") - F.col("x1")) * rise - (F.col("y") - F.col("y1")) * run) / F.sqrt(length2)
    other = lambda n: (F.col("x") != F.col(f"x{n}")) | (F.col("y") != F.col(f"y{n}"))
    met = joins.null_safe_join(passed.select(*keys, *EDGE, "cx", "cy"), corners, [*keys, "cx", "cy"])
    met = met.where((along > 0) & (along < 1) & (aside <= near) & other(1) & other(2))
    cuts = met.groupBy(*keys, *EDGE).agg(F.array_sort(F.collect_set(F.struct(along.alias("t"), "x", "y"))).alias("cuts"))

    cut = joins.null_safe_join(placed.select(*keys, *EDGE), cuts, [*keys, *EDGE], "left")
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    inner = F.transform(F.coalesce("cuts", F.array().cast("array<struct<t:double,x:double,y:double>>")), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y")))
    stops = cut.select(*keys, F.concat(F.array(point("x1", "y1")), inner, F.array(point("x2", "y2"))).alias("stops"))
    pairs = F.arrays_zip(F.slice("stops", F.lit(1), F.size("stops") - 1).alias("a"), F.slice("stops", F.lit(2), F.size("stops") - 1).alias("b"))
    pieces = stops.select(*keys, F.explode(pairs).alias("p"))
    return pieces.select(*keys, *[F.col(f"p.{end}.{axis}").alias(f"{axis}{n}") for n, end in ((1, "a"), (2, "b")) for axis in ("x", "y")])


def dissolve(edges: DataFrame, keys: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Outline of the union of the polygons that share the same keys.

    Members may touch but not overlap. A piece of border that two members share is interior and cancels, whatever
    corners they have on it.
    """
    a = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    b = F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    side = noded(edges, keys, tolerance).select(*keys, *EDGE, F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    left = side.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*EDGE)).alias("e"))
    return left.where("n = 1").select(*keys, "e.*")


#: Mean radius of the earth in metres.
EARTH = 6_371_008.8


def sphere_centroids(edges: DataFrame, keys: Sequence[str], radius: float = 1.0) -> DataFrame:
    """Size and centroid of each outline on the sphere; x is the longitude and y the latitude in degrees.

    Edges are arcs of great circles, shorter than half of one. The position summed over an area is half the sum, over its edges, of
    arc length times the unit normal of the arc's plane; its direction is the centroid. Holes run against the outer rings,
    and parts may be several: their edges simply add. The smaller of the two areas that a ring divides is meant.
    """
    lon1, lat1, lon2, lat2 = (F.radians(F.col(c)) for c in EDGE)
    parts = edges.select(
        *keys, lon1.alias("l1"), lat1.alias("p1"), lon2.alias("l2"), lat2.alias("p2"),
        *[f.alias(f"{axis}{n}") for n, lon, lat in ((1, lon1, lat1), (2, lon2, lat2)) for axis, f in (("x", F.cos(lat) * F.cos(lon)), ("y", F.cos(lat) * F.sin(lon)), ("z", F.sin(lat)))],
    )
    c = F.col
    parts = parts.withColumns({
        "nx": c("y1") * (c("z2") - c("z1")) - c("z1") * (c("y2") - c("y1")),
        "ny": c("z1") * (c("x2") - c("x1")) - c("x1") * (c("z2") - c("z1")),
        "nz": c("x1") * (c("y2") - c("y1")) - c("y1") * (c("x2") - c("x1")),
        "dot": c("x1") * c("x2") + c("y1") * c("y2") + c("z1") * c("z2"),
        # turn in longitude, the short way round
        "turn": F.pmod(c("l2") - c("l1") + F.pi(), 2 * F.pi()) - F.pi(),
    })
    sine = F.sqrt(c("nx") * c("nx") + c("ny") * c("ny") + c("nz") * c("nz"))
    arc = F.coalesce(F.try_divide(F.atan2(sine, c("dot")), sine), F.lit(0.0))
    # area between an arc and the equator
    under = 2 * F.atan2(F.tan(c("turn") / 2) * F.sin((c("p1") + c("p2")) / 2), F.cos((c("p1") - c("p2")) / 2))
    sums = parts.groupBy(*keys).agg(
        F.sum(arc * c("nx")).alias("sx"), F.sum(arc * c("ny")).alias("sy"), F.sum(arc * c("nz")).alias("sz"),
        F.sum(under).alias("area"), F.sum("turn").alias("round"), F.avg("x1").alias("mx"), F.avg("y1").alias("my"), F.avg("z1").alias("mz"),
    )
    # a ring around a pole turns once in longitude and encloses what its arcs and the equator do not
    area = F.abs(F.when(F.abs(c("round")) > F.pi(), 2 * F.pi() - F.abs(c("area"))).otherwise(c("area")))
    area = F.least(area, 4 * F.pi() - area)
    # a clockwise outline gives the opposite direction
    sign = F.signum(c("sx") * c("mx") + c("sy") * c("my") + c("sz") * c("mz"))
    sx, sy, sz = (sign * c(s) for s in ("sx", "sy", "sz"))
    flat = F.sqrt(sx * sx + sy * sy)
    none = (flat == 0) & (sz == 0)
    return sums.select(
        *keys, (area * F.lit(radius * radius)).alias("size"),
        F.when(~none, F.degrees(F.atan2(sy, sx))).alias("X"), F.when(~none, F.degrees(F.atan2(sz, flat))).alias("Y"),
    )
