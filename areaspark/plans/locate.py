"""Placing points: municipality first, then neighbourhood inside the city."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaspark.operators import joins, overlay, spatial, windows
from areaspark.plans.survey import City

# fixed values: coordinates for areas whose centroid falls outside or is unreadable
CENTROID_OVERRIDES = {
    "Sycamore Township": (-84.3788, 39.20386),
    "Columbia Township": (-84.40098, 39.17114),
    "East End": (None, 39.122),
    "Riverside": (None, 39.07735),
}


def unambiguous(placed: DataFrame, point_keys: Sequence[str]) -> DataFrame:
    """Drop points that fall in more than one area (points on a shared border)."""
    return windows.only_single_rows(placed, point_keys)


def two_stage(
    points: DataFrame,
    municipality_edges: DataFrame,
    neighbourhood_edges: DataFrame,
    city: City,
    cell: float = 0.25,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """County, Municipality and Neighborhood of distinct points (X, Y).

    The placed points are read twice (inside and outside the city); ``keep`` may
    write them once, see :func:`areaspark.session.keep`.

    Points in two municipalities are dropped; points in two neighbourhoods are
    kept once for each. Points of the city outside every neighbourhood drop out.
    """
    distinct = points.select("X", "Y").where("X is not null and Y is not null").distinct()
    placed = keep(
        unambiguous(
            spatial.points_in_polygons(distinct, municipality_edges, ["County", "Municipality"], cell=cell, keep=keep), ["X", "Y"]
        )
    )
    inside = placed.where(F.col("Municipality") == city.name)
    hoods = spatial.points_in_polygons(inside, neighbourhood_edges, ["Neighborhood"], cell=cell, keep=keep)
    outside = placed.where(F.col("Municipality") != city.name).withColumn("Neighborhood", F.col("Municipality"))
    return outside.unionByName(hoods)


def resolve_by_crosswalk(
    ambiguous: DataFrame, tract_edges: DataFrame, crosswalk: DataFrame, cell: float = 0.25
) -> DataFrame:
    """Municipality of points on a border, through the tract that holds them.

    ``ambiguous`` has ID, X, Y and one row per candidate State, County,
    Municipality; a candidate stays when the point's tract is allotted to it.
    """
    spots = ambiguous.select("ID", "X", "Y").distinct()
    tracts = spatial.points_in_polygons(spots, tract_edges, ["GEOID"], cell=cell).select("ID", "GEOID").distinct()
    keys = ["State", "County", "Municipality"]
    # a point lies in one tract or a few, so it is placed before the crosswalk is asked
    candidates = joins.null_safe_join(ambiguous.select("ID", *keys), tracts, ["ID"])
    allotted = joins.null_safe_join(candidates, crosswalk.select("GEOID", *keys), ["GEOID", *keys])
    return allotted.select("ID", *keys)


def centroid_override(
    centroids: DataFrame, overrides: Mapping[str, tuple] = CENTROID_OVERRIDES, key: str = "Neighborhood"
) -> DataFrame:
    """Fixed coordinates for listed areas; either coordinate may stay as computed."""
    def fixed(axis: int, col: str) -> Column:
        out = F.col(col)
        for name, xy in overrides.items():
            if xy[axis] is not None:
                out = F.when(F.col(key) == name, F.lit(xy[axis])).otherwise(out)
        return out

    return centroids.withColumns({"X": fixed(0, "X"), "Y": fixed(1, "Y")})


def area_dimension(areas: DataFrame, tiers: DataFrame, outlines: DataFrame, keys: Sequence[str], sphere: bool = False) -> DataFrame:
    """Areas with id, tier and centroid, one row each. ``sphere``: corners are longitudes and latitudes."""
    centre = centroid_override((overlay.sphere_centroids if sphere else spatial.centroids)(outlines, keys)).drop("size")
    return joins.assemble_wide([(areas, "inner"), (tiers, "inner"), (centre, "inner")], list(keys))


def points_in_area(
    points: DataFrame,
    municipality_edges: DataFrame,
    city: City,
    cell: float = 0.25,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> tuple[DataFrame, DataFrame]:
    """Located points with their municipality, and the part shown on the city map.

    ``points`` has Name, Type, X, Y, Address. The city map shows the city, its
    enclaves and every school.
    """
    located = keep(
        spatial.points_in_polygons(
            points.where("X is not null and Y is not null").distinct(), municipality_edges, ["County", "Municipality"], cell=cell
        )
    )
    city_map = located.where(
        F.col("Municipality").isin([city.name, *city.enclaves]) | (F.col("Type") == "School")
    )
    return located, city_map


def point_key(x: Column | str = "X", y: Column | str = "Y") -> Column:
    """Id of a coordinate pair, for joins that should not compare doubles."""
    return windows.surrogate_id(x, y)
