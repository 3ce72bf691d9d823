"""The earlier asthma data: from patients' addresses to registry and admission sums per area.

Every patient row carries the identity of its cleaned address. Distinct addresses are located once, in three branches (a municipality
without neighbourhoods, a border between municipalities, the city), and the stacked places come back to the patients on that
identity alone, so the address text is compared nowhere.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaspark.functions import dates
from areaspark.operators import address, joins, spatial, windows
from areaspark.plans import cohorts, locate
from areaspark.plans.survey import City

# --- fixed values -----------------------------------------------------------
COUNTIES = {"Ohio": ["Hamilton", "Clermont", "Butler", "Warren"], "Kentucky": ["Boone", "Campbell", "Kenton"], "Indiana": ["Dearborn"]}
COUNTY_CODES = {
    ("Ohio", "061"): "Hamilton", ("Ohio", "017"): "Butler", ("Ohio", "025"): "Clermont", ("Ohio", "165"): "Warren",
    ("Kentucky", "015"): "Boone", ("Kentucky", "037"): "Campbell", ("Kentucky", "117"): "Kenton", ("Indiana", "029"): "Dearborn",
}
#: Days by which ages were divided.
YEAR = 385.25
# --- end of fixed values ----------------------------------------------------

PARTS = ["City", "state", "Zip", "Address"]
AREA = ["State", "County", "Municipality", "Neighborhood"]
_LINES = ["add_line_1", "add_line_2", "city", "state", "zip"]


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def registry_rows(
    config: DataFrame, membership: DataFrame, record: DataFrame, patient: DataFrame, registries: Column, as_of: dt.date | str,
    counties: Mapping[str, Sequence[str]] = COUNTIES,
) -> DataFrame:
    """Active members of the wanted registries under 18, of the region or of one of its states without a county."""
    active = membership.where("status_c = 1").select("registry_id", "record_id").distinct()
    members = joins.null_safe_join(active, config.where(registries).select("registry_id"), ["registry_id"], "left_semi")
    ids = joins.null_safe_join(members.select("record_id"), record.select("record_id", "networked_id"), ["record_id"]).select(F.col("networked_id").alias("pat_id")).distinct()
    young = patient.where(~F.col("add_line_1").like(cohorts.HOSPITAL_LINE)).where(dates.age_years("birth_date", as_of, YEAR) < 18)
    here = _any([(F.col("state") == s) & (F.col("county").isin([c.upper() for c in names_]) | F.col("county").isNull()) for s, names_ in counties.items()])
    rows = joins.null_safe_join(young.where(here), ids, ["pat_id"], "left_semi")
    return rows.select("pat_id", *_LINES, "birth_date", "county").distinct().select(*_LINES, F.lit(1).alias("Registry"), F.lit(0).alias("Admission"))


def admission_rows(encounters: DataFrame, year: int, codes: Mapping[tuple[str, str], str] = COUNTY_CODES) -> DataFrame:
    """Asthma admissions of a year, of the region's county codes or of one of its states without a code."""
    at, code, state = F.col("hosp_admsn_time"), F.col("countyfp"), F.col("state")
    first, after = (F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (year, year + 1))
    rows = encounters.where((at >= first) & (at < after) & (F.col("asthma_admission") == 1) & ~F.col("add_line_1").like(cohorts.HOSPITAL_LINE))
    states = sorted({s for s, _ in codes})
    here = _any([(state == s) & code.isin([c for t, c in codes if t == s]) for s in states]) | (state.isin(states) & code.isNull())
    return rows.where(here).select(*_LINES, F.lit(0).alias("Registry"), F.lit(1).alias("Admission"))


def with_address(rows: DataFrame) -> DataFrame:
    """Cleaned address parts and their identity, ``ID``; what isn't needed any more goes."""
    return address.clean_address(rows).select(windows.surrogate_id(*PARTS).alias("ID"), *PARTS, "Registry", "Admission")


def blockgroup_hood(placed: DataFrame, blockgroup_edges: DataFrame, allocation: DataFrame, city: City, cell: float = 0.25) -> DataFrame:
    """Neighbourhood of the city's points through the block group that holds them.

    ``placed`` has ID, X, Y and County of points known to lie in the city; block groups of other counties are not looked at. A point
    whose block groups are allotted to several neighbourhoods is dropped, as is one without any.
    """
    shares = allocation.where(F.col("Municipality") == city.name).select("GEOID", "Neighborhood").distinct()
    found = spatial.points_in_polygons(placed, blockgroup_edges, ["GEOID"], cell=cell, within=["County"]).select("ID", "GEOID")
    hoods = joins.null_safe_join(found, shares, ["GEOID"]).select("ID", "Neighborhood").distinct()
    return windows.only_single_rows(hoods, ["ID"]).select(
        "ID", F.lit(city.state).alias("State"), F.lit(city.county).alias("County"), F.lit(city.name).alias("Municipality"), "Neighborhood"
    )


def places(
    points: DataFrame, municipality_edges: DataFrame, tract_edges: DataFrame, blockgroup_edges: DataFrame, crosswalk: DataFrame,
    allocation: DataFrame, city: City, cell: float = 0.25, keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """State, County, Municipality and Neighborhood of located addresses (ID, X, Y).

    ``municipality_edges`` name State, County and Municipality. Outside the city there is no neighbourhood; on a border the tract decides.
    ``keep`` may write the points with their municipalities, which all branches read.
    """
    muni = ["State", "County", "Municipality"]
    hit = spatial.points_in_polygons(points, municipality_edges, muni, cell=cell)
    count = hit.groupBy("ID").agg(F.count(F.lit(1)).alias("candidates"))
    hit = keep(joins.null_safe_join(hit.select("ID", "X", "Y", *muni), count, ["ID"]))
    single = hit.where("candidates = 1")
    none = F.lit(None).cast("string").alias("Neighborhood")
    outside = single.where(F.col("Municipality") != city.name).select("ID", *muni, none)
    border = locate.resolve_by_crosswalk(hit.where("candidates > 1").drop("candidates"), tract_edges, crosswalk, cell).select("ID", *muni, none)
    inside = blockgroup_hood(single.where(F.col("Municipality") == city.name).select("ID", "X", "Y", "County"), blockgroup_edges, allocation, city, cell)
    return outside.unionByName(border).unionByName(inside)


def back_to_patients(patients: DataFrame, placed: DataFrame) -> DataFrame:
    """Registry and admission marks with the areas of their address; a row for each place of it."""
    return joins.null_safe_join(patients.select("ID", "Registry", "Admission"), placed, ["ID"]).drop("ID")
