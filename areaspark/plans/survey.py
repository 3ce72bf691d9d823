"""From long survey rows to the hub table of area x variable estimates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaspark.functions import missing, text
from areaspark.operators import joins, names, windows
from areaspark.plans import catalog

AREA = ["County", "Municipality", "Neighborhood"]


@dataclass(frozen=True)
class City:
    """The city shown by neighbourhood, and the municipalities it encloses."""

    name: str
    county: str
    state: str
    enclaves: Sequence[str] = field(default_factory=tuple)


# fixed values
CINCINNATI = City("Cincinnati", "Hamilton", "Ohio", ("Norwood", "St. Bernard", "Elmwood Place"))


def apportion(
    rows: DataFrame,
    crosswalk: DataFrame,
    source: str,
    targets: Sequence[str],
    measures: Sequence[str] = ("variable",),
    weight: str = "Allocation",
    value: str = "estimate",
) -> DataFrame:
    """Estimate x share of the source area, summed to the target areas.

    Rows are first summed per source area and measure, which is exact because
    the share is constant there. The fan-out join then sees one row per source
    area and measure, however many rows one source area holds.
    """
    sources = rows.where(F.col(value).isNotNull()).groupBy(source, *measures).agg(F.sum(value).alias(value))
    joined = joins.null_safe_join(sources, crosswalk.select(source, *targets, weight), [source])
    return joined.groupBy(*targets, *measures).agg(F.sum(F.col(value) * F.col(weight)).alias(value))


def municipality_long(rows: DataFrame, overrides: Mapping[str, str] = names.COUNTY_OVERRIDES) -> DataFrame:
    """Strict totals per municipality and variable, split places merged."""
    # names repeat on every row, so sum per raw name first and clean the few names left
    sums = rows.groupBy("NAME", "variable").agg(missing.sum_strict("estimate").alias("estimate"))
    named = names.override_county(names.harmonise_places(sums), overrides)
    out = named.groupBy("Municipality", "County", "variable").agg(missing.sum_strict("estimate").alias("estimate"))
    return out.withColumn("Neighborhood", F.col("Municipality"))


def city_long(
    bg_rows: DataFrame, allocation: DataFrame, city: City, merges: Mapping[str, str] = names.NEIGHBOURHOOD_MERGES
) -> DataFrame:
    """Apportioned totals per city neighbourhood and variable, without the median."""
    shares = names.merge_neighbourhoods(allocation, merges).where(F.col("Municipality") == city.name)
    return apportion(
        bg_rows.where(F.col("variable") != catalog.MEDIAN_INCOME),
        shares,
        "GEOID",
        ["Municipality", "Neighborhood"],
    ).withColumn("County", F.lit(city.county))


def hub(city_rows: DataFrame, municipality_rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Neighbourhood and municipality totals in one table, with label levels.

    Labels are split once per dictionary row, not once per area.
    """
    cols = [*AREA, "variable", "estimate"]
    levels = catalog.with_levels(dictionary)
    # neighbourhood rows need a dictionary entry, municipality rows keep theirs without one
    hoods = joins.null_safe_join(city_rows.select(cols), levels, ["variable"])
    munis = joins.null_safe_join(
        municipality_rows.where(F.col("variable") != catalog.MEDIAN_INCOME).select(cols), levels, ["variable"], "left"
    )
    return hoods.unionByName(munis).withColumn(
        "Neighborhood", F.coalesce("Neighborhood", "Municipality")
    )


def areas(hub_rows: DataFrame) -> DataFrame:
    """One row per area, numbered by title-cased neighbourhood and county."""
    distinct = hub_rows.select(*AREA).distinct()
    return windows.dense_ids(
        distinct,
        {"name": text.title_case("Neighborhood"), "county": F.col("County"), "muni": F.col("Municipality")},
        "HoodID",
    )


def area_views(areas_rows: DataFrame, city: City) -> tuple[DataFrame, DataFrame]:
    """Rows of the municipality view and of the city view.

    The city view holds the city's neighbourhoods and enclosed municipalities,
    without the row of the whole city.
    """
    own = F.col("Neighborhood") == F.col("Municipality")
    muni = areas_rows.where(own)
    inner = areas_rows.where(
        F.col("Municipality").isin([city.name, *city.enclaves]) & (F.col("Neighborhood") != city.name)
    )
    return muni, inner


def tract_crosswalk(raw: DataFrame, counties: Sequence[str]) -> DataFrame:
    """Clean tract-to-municipality shares and build the tract id."""
    # the state is the last word: a county may have several
    known = F.coalesce(F.col("County").rlike("^.+ [A-Z]{2}$"), F.lit(True))
    checked = F.when(known, F.col("County")).otherwise(F.raise_error(F.concat(F.lit("no county and state: "), F.col("County"))).cast("string"))
    state = F.substring_index(checked, " ", -1)
    county = {"State": state, "County": F.regexp_replace("County", " [A-Z]{2}$", "")}
    place = text.before_any("Municipality", ["CCD", " city", ",", "village"])
    place = text.remove_first_text(place, "The Village of")
    return (
        raw.where(missing.is_in("County", counties))
        .select(
            county["County"].alias("County"),
            names.state_name(county["State"]).alias("State"),
            text.trim_space(text.title_case(place)).alias("Municipality"),
            F.col("Allocation"),
            text.tract_id("CountyCode", "Tract").alias("GEOID"),
        )
    )


def household_shares(
    bg_rows: DataFrame, allocation: DataFrame, city: City, merges: Mapping[str, str], base: str = "tract"
) -> DataFrame:
    """Share of a tract's households in each city neighbourhood.

    ``base="tract"`` divides by all parts of the tract, ``base="city"`` by the
    part inside the city only.
    """
    shares = names.merge_neighbourhoods(allocation, merges)
    if base == "city":
        shares = shares.where(F.col("Municipality") == city.name)
    rows = (
        bg_rows.where(F.col("variable") == catalog.HOUSEHOLDS)
        .where(F.col("estimate").isNotNull())
        .groupBy("GEOID")
        .agg(F.sum("estimate").alias("estimate"))
    )
    parts = (
        joins.null_safe_join(rows, shares, ["GEOID"])
        .withColumn("TractID", text.prefix("GEOID", 11))
        .groupBy("TractID", "Municipality", "Neighborhood")
        .agg(F.sum(F.col("estimate") * F.col("Allocation")).alias("HoodTractHH"))
    )
    # at most one row per neighbourhood of a tract
    out = windows.with_group_total(parts, ["TractID"], "HoodTractHH", "TractHH", bounded=True)
    return (
        out.where(F.col("Municipality") == city.name)
        .withColumn("Allocation", missing.ratio("HoodTractHH", "TractHH"))
        .select("TractID", "Municipality", "Neighborhood", "TractHH", "HoodTractHH", "Allocation")
    )


def interpolate_assistance(tract_rows: DataFrame, shares: DataFrame, city: City) -> DataFrame:
    """Tract-only assistance counts spread to neighbourhoods by household share."""
    def pick(v: str) -> Column:
        return missing.sum_strict_where(F.col("variable") == v, "estimate")

    wide = (
        tract_rows.where(F.col("variable").isin(catalog.PUBLIC_ASSISTANCE, catalog.HOUSEHOLDS))
        .groupBy("GEOID")
        .agg(pick(catalog.HOUSEHOLDS).alias("PopHH"), pick(catalog.PUBLIC_ASSISTANCE).alias("TotalAssistance"))
    )
    joined = joins.null_safe_join(wide, shares, {"GEOID": "TractID"})
    return (
        joined.groupBy("Municipality", "Neighborhood")
        .agg(
            *[
                missing.sum_strict(F.col(c) * F.col("Allocation")).alias(c)
                for c in ("PopHH", "TotalAssistance")
            ]
        )
        .withColumn("County", F.lit(city.county))
    )


def _income_per_source(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median and households per source area; areas without a median are left out."""
    return (
        rows.where(F.col("variable").isin(catalog.HOUSEHOLDS, catalog.MEDIAN_INCOME))
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.col("variable") == catalog.MEDIAN_INCOME, F.col("estimate"))).alias("MedianIncome"),
            missing.sum_strict_where(F.col("variable") == catalog.HOUSEHOLDS, "estimate").alias("HH"),
        )
        .where(F.col("MedianIncome").isNotNull())
    )


def income_city(bg_rows: DataFrame, allocation: DataFrame, city: City, merges: Mapping[str, str]) -> DataFrame:
    """Household-weighted income per neighbourhood: households are apportioned, medians are not."""
    shares = names.merge_neighbourhoods(allocation, merges).where(F.col("Municipality") == city.name)
    joined = joins.null_safe_join(_income_per_source(bg_rows, ["GEOID"]), shares, ["GEOID"])
    hh = F.col("HH") * F.col("Allocation")
    return (
        joined.groupBy("Municipality", "Neighborhood")
        .agg(
            missing.ratio(
                missing.sum_strict(F.col("MedianIncome") * hh), missing.sum_strict(hh)
            ).alias("value")
        )
        .select(F.lit(city.county).alias("County"), "Municipality", "Neighborhood", "value")
    )


def income_municipality(muni_rows: DataFrame, overrides: Mapping[str, str] = names.COUNTY_OVERRIDES) -> DataFrame:
    parts = names.override_county(names.harmonise_places(_income_per_source(muni_rows, ["GEOID", "NAME"])), overrides)
    return (
        parts.groupBy("County", "Municipality")
        .agg(
            missing.ratio(
                missing.sum_strict(F.col("MedianIncome") * F.col("HH")), missing.sum_strict("HH")
            ).alias("value")
        )
        .select("County", "Municipality", F.col("Municipality").alias("Neighborhood"), "value")
    )


def income(
    bg_rows: DataFrame,
    allocation: DataFrame,
    muni_rows: DataFrame,
    city: City,
    merges: Mapping[str, str] = names.NEIGHBOURHOOD_MERGES,
    overrides: Mapping[str, str] = names.COUNTY_OVERRIDES,
) -> DataFrame:
    return income_municipality(muni_rows, overrides).unionByName(income_city(bg_rows, allocation, city, merges))
