"""Population-weighted deprivation index at several levels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaspark.functions import missing, text
from areaspark.operators import joins, names
from areaspark.plans import catalog
from areaspark.plans.survey import City


def city_index(
    bg_rows: DataFrame, allocation: DataFrame, index: DataFrame, city: City, merges: Mapping[str, str]
) -> DataFrame:
    """Index per neighbourhood; shares are taken over all tracts, with or without an index."""
    shares = names.merge_neighbourhoods(allocation, merges).where(F.col("Municipality") == city.name)
    pops = (
        bg_rows.where((F.col("variable") == catalog.POPULATION) & F.col("estimate").isNotNull())
        .groupBy("GEOID")
        .agg(F.sum("estimate").alias("estimate"))
    )
    tracts = (
        joins.null_safe_join(pops, shares, ["GEOID"])
        .groupBy(text.prefix("GEOID", 11).alias("census_tract_fips"), "Municipality", "Neighborhood")
        .agg(F.sum(F.col("estimate") * F.col("Allocation")).alias("Population"))
    )
    # sum(pop / all_pop * index) = sum(pop * index) / all_pop: one pass, tracts
    # without an index count in the divisor only
    joined = joins.null_safe_join(tracts, index.withColumn("known", F.lit(True)), ["census_tract_fips"], "left")
    known = F.col("known").isNotNull()
    return (
        joined.groupBy("Municipality", "Neighborhood")
        .agg(
            missing.ratio(
                missing.sum_strict_where(known, F.col("Population") * F.col("dep_index")),
                missing.sum_strict("Population"),
            ).alias("value"),
            F.max(known).alias("known"),
        )
        .where("known")
        .select(F.lit(city.county).alias("County"), "Municipality", "Neighborhood", "value")
    )


def place_index(
    tract_rows: DataFrame,
    crosswalk: DataFrame,
    index: DataFrame,
    overrides: Mapping[str, str] = names.COUNTY_OVERRIDES,
    with_state: bool = False,
) -> DataFrame:
    """Index per place; shares are taken over the tracts that have an index."""
    pops = (
        tract_rows.where(F.col("variable") == catalog.POPULATION)
        .groupBy("GEOID")
        .agg(missing.sum_strict("estimate").alias("estimate"))
    )
    keys = ["County", "State", "Municipality"] if with_state else ["County", "Municipality"]
    # the index drops tracts that only one side of the full join knows
    joined = joins.null_safe_join(
        joins.null_safe_join(pops, crosswalk, ["GEOID"], "full"), index, {"GEOID": "census_tract_fips"}
    )
    pop = F.col("estimate") * F.col("Allocation")
    # sum(pop / town_pop * index) = sum(pop * index) / town_pop: no second pass
    return (
        names.override_county(joined, overrides)
        .groupBy(*keys)
        .agg(missing.ratio(missing.sum_strict(pop * F.col("dep_index")), missing.sum_strict(pop)).alias("value"))
        .withColumn("Neighborhood", F.col("Municipality"))
    )


def rollup_index(places: DataFrame, pops: DataFrame) -> DataFrame:
    """County and metro index from places, weighted by population.

    ``places`` has State, County, Municipality, value; ``pops`` the same keys and
    Population. The metro row reads "All".
    """
    keys = ["State", "County", "Municipality"]
    joined = joins.null_safe_join(pops.select(*keys, "Population"), places.select(*keys, "value"), keys)
    weighted = joined.select("State", "County", "Population", (F.col("value") * F.col("Population")).alias("w"))
    sums = [missing.sum_strict(c).alias(c) for c in ("w", "Population")]
    county = weighted.groupBy("State", "County").agg(*sums)
    # a global aggregate, so the metro row exists even without places
    metro = county.agg(*sums).select(F.lit("All").alias("State"), F.lit("All").alias("County"), "w", "Population")
    return county.unionByName(metro).select(
        "State", "County", missing.ratio("w", "Population").alias("DeprivationIndex")
    )


def all_levels(
    bg_rows: DataFrame,
    allocation: DataFrame,
    tract_rows: DataFrame,
    crosswalk: DataFrame,
    index: DataFrame,
    city: City,
    merges: Mapping[str, str] = names.NEIGHBOURHOOD_MERGES,
    overrides: Mapping[str, str] = names.COUNTY_OVERRIDES,
) -> DataFrame:
    """Index of places and city neighbourhoods in one table."""
    return place_index(tract_rows, crosswalk, index, overrides).unionByName(
        city_index(bg_rows, allocation, index, city, merges)
    )
