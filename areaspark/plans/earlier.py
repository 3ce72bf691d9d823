"""The earlier generation: four area levels built from variable categories."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaspark.functions import missing, text
from areaspark.operators import joins, names
from areaspark.plans import catalog, survey
from areaspark.plans.survey import City

# --- fixed values -----------------------------------------------------------
MEDIAN = "MedianHHIncome"
CATEGORIES = [
    "Age25", "Age5", "Assistance", "Black", "Children", "English", "Families", "HHWithChildren",
    "HighSchool", "Hispanic", "Households", "HousingUnits", "LimitedEnglish", "Population",
    "Poverty", "Uninsured", "Vacant", "White",
]
KEYS = ["State", "County", "Municipality", "Neighborhood"]
# rate -> (numerator, denominator)
RATES = {
    "AssistanceRate": ("Assistance", "Households"), "BlackRate": ("Black", "Population"),
    "ChildRate": ("Children", "Population"), "OtherLanguageRate": ("OtherLanguage", "Age5"),
    "ChildHHRate": ("HHWithChildren", "Households"), "HighSchoolRate": ("HighSchool", "Age25"),
    "HispanicRate": ("Hispanic", "Population"), "LimitedEnglishRate": ("LimitedEnglish", "Age5"),
    "PovertyRate": ("Poverty", "Families"), "UninsuredRate": ("Uninsured", "Population"),
    "VacancyRate": ("Vacant", "HousingUnits"), "WhiteRate": ("White", "Population"),
}
ORDER = [
    "Population", "White", "WhiteRate", "Black", "BlackRate", "Hispanic", "HispanicRate", "Children",
    "ChildRate", "Uninsured", "UninsuredRate", "Households", "HHWithChildren", "ChildHHRate",
    "Assistance", "AssistanceRate", "MedianHHIncome", "Age25", "HighSchool", "HighSchoolRate",
    "Families", "Poverty", "PovertyRate", "HousingUnits", "Vacant", "VacancyRate", "Age5",
    "OtherLanguage", "OtherLanguageRate", "LimitedEnglish", "LimitedEnglishRate",
]
# --- end of fixed values ----------------------------------------------------


def category_wide(
    rows: DataFrame, lookup: DataFrame, ids: list[str], categories: list[str] | None = None, strict: bool = True
) -> DataFrame:
    """Variables mapped to categories and summed per area, one column per category.

    Summing per area and variable first keeps the lookup join small.
    """
    agg = missing.sum_strict if strict else F.sum
    wanted = CATEGORIES if categories is None else categories
    sums = rows.groupBy(*ids, "variable").agg(agg("estimate").alias("estimate"))
    tagged = joins.null_safe_join(sums, lookup, ["variable"])
    pick = missing.sum_strict_where if strict else (lambda c, v: F.sum(F.when(c, F.col(v))))
    return tagged.groupBy(*ids).agg(*[pick(F.col("category") == c, "estimate").alias(c) for c in wanted])


def city_levels(
    bg_rows: DataFrame, allocation: DataFrame, tract_rows: DataFrame, lookup: DataFrame, city: City
) -> DataFrame:
    """Neighbourhood totals and income of the city, counts rounded."""
    cats = [c for c in CATEGORIES if c != "Assistance"]
    bg = category_wide(bg_rows, lookup, ["GEOID"], [*cats, MEDIAN])
    shares = allocation.where(F.col("Municipality") == city.name)
    joined = joins.null_safe_join(bg, shares, ["GEOID"]).withColumn("Income", F.col(MEDIAN) * F.col("Households"))
    share = F.col("Allocation")
    known = F.col("Income").isNotNull()
    sums = joined.groupBy("Municipality", "Neighborhood").agg(
        *[missing.sum_strict(F.col(c) * share).alias(c) for c in cats],
        F.sum(F.col("Income") * share).alias("Income"),
        F.sum(F.when(known, F.col("Households") * share)).alias("IncomeHH"),
    )
    hh = survey.household_shares(bg_rows, allocation, city, {}, base="city")
    tracts = (
        tract_rows.where(F.col("variable") == catalog.PUBLIC_ASSISTANCE)
        .groupBy("GEOID")
        .agg(missing.sum_strict("estimate").alias("estimate"))
    )
    assistance = (
        joins.null_safe_join(tracts, hh.select("TractID", "Neighborhood", "Allocation"), {"GEOID": "TractID"})
        .groupBy("Neighborhood")
        .agg(missing.sum_strict(F.col("estimate") * F.col("Allocation")).alias("Assistance"))
    )
    out = joins.null_safe_join(sums, assistance, ["Neighborhood"])
    rounded = [*cats, "Income", "IncomeHH", "Assistance"]
    return out.select(
        F.lit(city.state).alias("State"),
        F.lit(city.county).alias("County"),
        "Municipality",
        "Neighborhood",
        *[F.bround(c, 0).alias(c) for c in rounded],
    )


def municipality_levels(
    muni_rows: DataFrame, lookup: DataFrame, overrides: Mapping[str, str] = names.COUNTY_OVERRIDES
) -> DataFrame:
    """Municipality totals and income; missing and zero estimates are left out first."""
    keys = ["State", "County", "Municipality"]
    rows = muni_rows.where("estimate is not null and estimate > 0")
    parts = category_wide(rows, lookup, ["GEOID", "NAME"], [*CATEGORIES, MEDIAN])
    named = names.override_county(names.harmonise_places(parts), overrides)
    # parts with neither a median nor households say nothing about income
    told = F.col(MEDIAN).isNotNull() | F.col("Households").isNotNull()
    return (
        named.groupBy(*keys)
        .agg(
            *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in CATEGORIES],
            missing.sum_strict_where(told, F.col(MEDIAN) * F.col("Households")).alias("Income"),
            missing.sum_strict_where(told, "Households").alias("IncomeHH"),
            F.max(told).alias("told"),
        )
        .where("told")
        .drop("told")
        .withColumn("Neighborhood", F.lit(None).cast("string"))
    )


def county_levels(county_rows: DataFrame, lookup: DataFrame) -> DataFrame:
    wide = category_wide(county_rows, lookup, ["NAME"], [*CATEGORIES, MEDIAN])
    named = names.split_area_name(wide, "NAME", ("County", "State"))
    return named.select(
        "State",
        text.remove_first_text("County", " County").alias("County"),
        F.lit(None).cast("string").alias("Municipality"),
        F.lit(None).cast("string").alias("Neighborhood"),
        *CATEGORIES,
        (F.col(MEDIAN) * F.col("Households")).alias("Income"),
        F.col("Households").alias("IncomeHH"),
    )


def metro_level(counties: DataFrame, label: str = "All") -> DataFrame:
    measures = [*CATEGORIES, "Income", "IncomeHH"]
    return counties.agg(*[missing.sum_strict(m).alias(m) for m in measures]).select(
        F.lit(label).alias("State"),
        F.lit(label).alias("County"),
        F.lit(None).cast("string").alias("Municipality"),
        F.lit(None).cast("string").alias("Neighborhood"),
        *measures,
    )


def rates_wide(levels: DataFrame, index: DataFrame) -> DataFrame:
    """Rates of every level joined with the deprivation index.

    Levels without a neighbourhood or municipality match on NULL keys; areas
    that only have an index stay with NULL measures.
    """
    pairs = {"OtherLanguage": F.col("Age5") - F.col("English")}
    inner = joins.null_safe_join(levels, index.select(*KEYS), KEYS, "left_semi").withColumns(pairs)
    rated = inner.withColumns({r: missing.ratio(n, d) for r, (n, d) in RATES.items()}).withColumn(
        MEDIAN, missing.ratio("Income", "IncomeHH")
    )
    return joins.null_safe_join(rated.select(*KEYS, *ORDER), index.select(*KEYS, "DeprivationIndex"), KEYS, "full")
