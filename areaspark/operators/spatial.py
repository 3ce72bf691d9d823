"""Points in polygons and centroids on edge tables.

A polygon is a set of edge rows: its area keys and ``x1, y1, x2, y2``. All
coordinates share one planar reference system.

The join works on grids. Each polygon lists the grid cells it meets, on the finest of
the grids (each twice as coarse as the one before) on which it is at most ``SPAN``
cells wide and high; a cell that no edge of the polygon passes through is wholly
inside (kept without edges) or wholly outside (dropped). A point meets only the
polygons of its own cell, and only the edges that pass through it: the path from the point to the right side of
its cell and down that side to the corner, of which the cell knows whether it is inside, crosses no other edge.
So an edge is copied once per cell it passes, and neither the cells nor the work per point grow with the size of a
polygon. Grid lines run beside round coordinates; a cell whose corner still comes too near an edge keeps
all edges right of it instead. Boundary points belong to every polygon they touch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaspark.operators import joins

EDGE = ["x1", "y1", "x2", "y2"]
# cells that a polygon is wide or high, at most about
SPAN = 64
# grid lines lie this share of a cell beside multiples of its size
ASIDE = 0.3183098861837907
# share of a cell's size that an edge keeps from a corner that is asked about
NEAR = 1e-7


def _cell(v: Column, size: Column | float) -> Column:
    return F.floor(v / (size if isinstance(size, Column) else F.lit(size)) - ASIDE).cast("long")


def _line(number: Column, size: Column) -> Column:
    """Coordinate at which a cell begins."""
    return (number + ASIDE) * size


def _size(level: Column, cell: float) -> Column:
    return F.lit(float(cell)) * F.pow(F.lit(2.0), level)


def polygon_levels(edges: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """Grid of each polygon: 0 has cells of size ``cell``, every further one cells twice as large."""
    low = lambda a, b: F.min(F.least(a, b))
    high = lambda a, b: F.max(F.greatest(a, b))
    extent = F.greatest(high("x1", "x2") - low("x1", "x2"), high("y1", "y2") - low("y1", "y2"))
    doublings = F.ceil(F.log2(extent / F.lit(float(cell * SPAN))))
    return edges.groupBy(*keys).agg(F.greatest(F.coalesce(doublings, F.lit(0)), F.lit(0)).cast("int").alias("level"))


def _crosses(e: Column, x: Column, y: Column) -> Column:
    """Does a ray to the right of the point cross the edge?"""
    spans = (e["y1"] > y) != (e["y2"] > y)
    at = (e["x2"] - e["x1"]) * (y - e["y1"]) / F.when(spans, e["y2"] - e["y1"]) + e["x1"]
    return spans & (x < at)


def _on_edge(e: Column, x: Column, y: Column) -> Column:
    flat = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    return (
        (flat == 0)
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )


def _side(e: Column, x: Column, y: Column) -> Column:
    """Positive on one side of an edge's line, negative on the other."""
    return (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])


def _right_of(e: Column, x: Column, y: Column) -> Column:
    """Does the edge's line run right of the point, or above it if it is level?"""
    side = _side(e, x, y)
    return F.when(e["y2"] > e["y1"], side > 0).when(e["y2"] < e["y1"], side < 0).otherwise(e["y1"] > y)


def covers(edges: Column, x: Column, y: Column, right: Column, low: Column, corner: Column) -> Column:
    """Point inside or on the boundary.

    ``edges`` are those of the point's cell, ``right`` the coordinate of its right side, ``low`` that of its lower one, ``corner`` whether
    the corner of the two is inside. Without ``corner``, ``edges`` are all those of the grid row not left of the cell.
    """
    ray = F.size(F.filter(edges, lambda e: _crosses(e, x, y)))

    def turned(e: Column) -> Column:
        # on the way to the right side, and down that side
        ahead = ((e["y1"] > y) != (e["y2"] > y)) & _crosses(e, x, y) & ~_right_of(e, right, y)
        beside = ((e["x1"] > right) != (e["x2"] > right)) & (_right_of(e, right, y) != _right_of(e, right, low))
        return ahead != beside

    path = F.size(F.filter(edges, turned))
    inside = F.when(corner.isNull(), ray % 2 == 1).otherwise((path % 2 == 1) != corner)
    return inside | F.exists(edges, lambda e: _on_edge(e, x, y))


def polygon_cells(edges: DataFrame, keys: Sequence[str], cell: float, levels: DataFrame | None = None) -> DataFrame:
    """Grid cells of each polygon, with the edges to test (NULL: wholly inside).

    ``levels`` are those of :func:`polygon_levels`, where they are known already.

    One polygon's edges within one grid row form one array; a polygon is a single
    geometry value, so this is bounded by its number of corners.
    """
    levels = polygon_levels(edges, keys, cell) if levels is None else levels
    leveled = joins.null_safe_join(edges.select(*keys, *EDGE), levels, list(keys))
    size = _size(F.col("level"), cell)
    crossed = leveled.select(
        *keys, "level", *EDGE, F.explode(F.sequence(_cell(F.least("y1", "y2"), size), _cell(F.greatest("y1", "y2"), size))).alias("cy")
    )
    # the part of an edge in a grid row, and a little more
    run, rise = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    share = lambda y: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(y - F.col("y1"), rise)))
    from_ = F.when(rise == 0, F.lit(0.0)).otherwise(share(_line(F.col("cy"), size) - NEAR * size))
    to = F.when(rise == 0, F.lit(1.0)).otherwise(share(_line(F.col("cy") + 1, size) + NEAR * size))
    ax, bx = F.col("x1") + from_ * run, F.col("x1") + to * run
    rows = crossed.select(
        *keys, "level", F.struct(*EDGE).alias("e"), "cy",
        _cell(F.least(ax, bx) - NEAR * size, size).alias("lx"), _cell(F.greatest(ax, bx) + NEAR * size, size).alias("hx"),
    )
    bands = rows.groupBy(*keys, "level", "cy").agg(
        F.collect_list(
            F.struct("e.x1", "e.y1", "e.x2", "e.y2", "lx", "hx")
        ).alias("edges"),
        F.min("lx").alias("from_x"),
        F.max("hx").alias("to_x"),
    )
    cells = bands.select(
        *keys, "level", "cy", "edges", F.explode(F.sequence("from_x", "to_x")).alias("cx")
    )
    right, low = _line(F.col("cx") + 1, size), _line(F.col("cy"), size)
    spans = lambda e: (e["y1"] > low) != (e["y2"] > low)
    own = F.filter("edges", lambda e: (e["lx"] <= F.col("cx")) & (F.col("cx") <= e["hx"]))
    corner = F.size(F.filter("edges", lambda e: spans(e) & _right_of(e, right, low))) % 2 == 1
    # an edge of this cell or its neighbour so near the cell's corner that rounding could put it on either side, or ending on a grid line
    reach = lambda e: F.abs(e["x2"] - e["x1"]) + F.abs(e["y2"] - e["y1"])
    here = lambda e: (e["lx"] <= F.col("cx") + 1) & (F.col("cx") <= e["hx"])
    at_line = lambda e: (F.abs(e["x1"] - right) <= NEAR * size) | (F.abs(e["x2"] - right) <= NEAR * size)
    level_line = lambda e: (F.abs(e["y1"] - low) <= NEAR * size) | (F.abs(e["y2"] - low) <= NEAR * size)
    unsure = F.exists("edges", lambda e: level_line(e) | (here(e) & ((F.abs(_side(e, right, low)) <= NEAR * size * reach(e)) | at_line(e))))
    cells = cells.withColumns({"own": own, "corner": corner, "unsure": unsure})
    passed = F.size("own") > 0
    # a cell without edges is inside where its corner is, or where its middle is
    middle_x, middle_y = right - 0.5 * size, low + 0.5 * size
    inside = F.when(F.col("unsure"), F.size(F.filter("edges", lambda e: (e["hx"] >= F.col("cx")) & _crosses(e, middle_x, middle_y))) % 2 == 1).otherwise(F.col("corner"))
    # edges left of a cell neither hold its points nor meet the rays that leave them to the right
    tested = F.when(F.col("unsure"), F.filter("edges", lambda e: e["hx"] >= F.col("cx"))).otherwise(F.col("own"))
    return (
        cells.where(passed | inside)
        .select(
            *keys, "level", "cx", "cy", F.when(passed, tested).alias("edges"),
            F.when(passed & ~F.col("unsure"), F.col("corner")).alias("corner"), right.alias("right"), low.alias("low"),
        )
    )


def points_in_polygons(
    points: DataFrame,
    edges: DataFrame,
    keys: Sequence[str],
    x: str = "X",
    y: str = "Y",
    cell: float = 0.25,
    how: str = "inner",
    within: Sequence[str] = (),
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Attach the keys of every polygon that holds the point.

    ``how="left"`` keeps unmatched points with NULL keys. A crowded cell is split
    by adaptive execution when the polygons are too many to broadcast. ``within`` names columns of both sides, the parent of a
    polygon and the parent already found for a point: only children of that parent meet the point, whatever else its cell holds.
    The polygons' levels are read twice, as are the matches with ``how="left"`` over several levels; ``keep`` may write both once.
    """
    parents = [f"__in_{c}" for c in within]
    if within:
        edges = edges.withColumns({p: F.col(c) for p, c in zip(parents, within)})
    known = keep(polygon_levels(edges, [*keys, *parents], cell))
    # the grids in use: as many as the sizes of the polygons have powers of two, at most
    levels = sorted(r["level"] for r in known.select("level").distinct().collect()) or [0]
    if how == "left" and len(levels) > 1:
        matched = keep(points_in_polygons(points, edges, keys, x, y, cell, within=within, keep=keep))
        rest = joins.null_safe_join(points, matched.select(x, y, *within).distinct(), [x, y, *within], "left_anti")
        kinds = {f.name: f.dataType for f in matched.schema.fields}
        missing = [F.lit(None).cast(kinds[c]).alias(c) if c in keys else F.col(c) for c in matched.columns]
        return matched.unionByName(rest.select(*missing))
    cells = polygon_cells(edges, [*keys, *parents], cell, known)
    if within:  # a null parent is a parent like any other
        cells = cells.withColumn("__parent", F.to_json(F.struct(*parents), {"ignoreNullFields": "false"})).drop(*parents)
    size = _size(F.col("__level"), cell)
    level = F.lit(levels[0]) if len(levels) == 1 else F.explode(F.array(*map(F.lit, levels)))
    keyed = points.withColumn("__level", level).withColumns({"__cx": _cell(F.col(x), size), "__cy": _cell(F.col(y), size)})
    renamed = cells.withColumnsRenamed({k: f"__p_{k}" for k in keys})
    hit = (
        (F.col("__level") == F.col("level"))
        & (F.col("__cx") == F.col("cx"))
        & (F.col("__cy") == F.col("cy"))
        & (F.col("edges").isNull() | covers(F.col("edges"), F.col(x), F.col(y), F.col("right"), F.col("low"), F.col("corner")))
    )
    if within:
        own = F.to_json(F.struct(*[F.col(c).alias(p) for p, c in zip(parents, within)]), {"ignoreNullFields": "false"})
        keyed = keyed.withColumn("__own", own)
        hit = hit & (F.col("__own") == F.col("__parent"))
    joined = keyed.join(renamed, hit, how)
    kept = [c for c in points.columns if c not in keys]
    return joined.select(*kept, *[F.col(f"__p_{k}").alias(k) for k in keys])


def polygons_with_points(
    points: DataFrame,
    edges: DataFrame,
    keys: Sequence[str],
    x: str = "X",
    y: str = "Y",
    cell: float = 0.25,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Every polygon with its points; a polygon without points has one row of NULLs.

    The matches are read twice; ``keep`` may write them once.
    """
    matched = keep(points_in_polygons(points, edges, keys, x, y, cell, keep=keep))
    empty = joins.null_safe_join(
        edges.select(*keys).distinct(), matched.select(*keys).distinct(), list(keys), "left_anti"
    )
    kinds = {f.name: f.dataType for f in matched.schema.fields}
    return matched.unionByName(
        empty.select(
            *[
                F.col(c) if c in keys else F.lit(None).cast(kinds[c]).alias(c)
                for c in matched.columns
            ]
        )
    )


def centroids(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Size and centroid of each outline, from sums over its edges."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    sums = edges.groupBy(*keys).agg(
        F.sum(cross).alias("c"),
        F.sum((F.col("x1") + F.col("x2")) * cross).alias("sx"),
        F.sum((F.col("y1") + F.col("y2")) * cross).alias("sy"),
    )
    return sums.select(
        *keys,
        (F.abs("c") / 2).alias("size"),
        F.try_divide("sx", F.col("c") * 3).alias("X"),
        F.try_divide("sy", F.col("c") * 3).alias("Y"),
    )
