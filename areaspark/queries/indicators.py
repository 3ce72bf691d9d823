"""Survey indicators: hub, themes, deprivation, income, benchmarks, earlier generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaspark.functions import missing
from areaspark.operators import benchmark, joins, names
from areaspark.plans import catalog, deprivation, earlier, statistics, survey, themes
from areaspark.queries import shapes
from areaspark.queries.registry import Tables, query, view
from areaspark.queries.scalars import CLEAN_SQL
from areaspark.queries.shapes import CITY, COUNTY_STATES, MERGES, OVERRIDES

AREA = survey.AREA
KEYS = "County, Municipality, Neighborhood"


def own_row() -> Column:
    """Rows of whole municipalities."""
    return F.col("Municipality") == F.col("Neighborhood")


def strict(expr: str, agg: str = "sum") -> str:
    return f"CASE WHEN count({expr}) = count(*) THEN {agg}({expr}) END"


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def merged(col: str = "Neighborhood") -> str:
    return f"CASE WHEN {col} IN ('Hood-3', 'Hood-4') THEN 'Hood-3-Hood-4' ELSE {col} END"


def overridden(col: str = "County") -> str:
    return f"CASE Municipality WHEN 'Nation_3 Township' THEN 'EUROPE' WHEN 'Nation_7 Township' THEN 'ASIA' ELSE {col} END"


# --- hub ---------------------------------------------------------------------

view(
    "ox_named_muni",
    f"""SELECT GEOID, Municipality, {overridden()} AS County, State, variable, estimate FROM (SELECT GEOID, {CLEAN_SQL} AS Municipality,
    replace(string_split(NAME, ', ')[2], ' County', '') AS County, string_split(NAME, ', ')[3] AS State, variable, estimate FROM px_muni_rows)""",
)
view(
    "ox_muni_long",
    f"""SELECT County, Municipality, Municipality AS Neighborhood, variable, {strict('estimate')} AS estimate FROM ox_named_muni
    GROUP BY County, Municipality, variable""",
)
view(
    "ox_hood_long",
    f"""SELECT 'AFRICA' AS County, Municipality, {merged()} AS Neighborhood, variable, sum(estimate * Allocation) AS estimate
    FROM px_bg_rows r JOIN px_alloc a ON r.GEOID = a.GEOID WHERE Municipality = 'Nation_0' AND variable <> 'B19049_001' AND estimate IS NOT NULL
    GROUP BY Municipality, 3, variable""",
)
view(
    "ox_hub",
    f"""SELECT {KEYS}, u.variable, estimate, w[1] AS Group1, w[2] AS Group2, w[3] AS Group3, w[4] AS Group4, w[5] AS Group5, concept FROM
    (SELECT h.*, string_split(d.label, ':!!') AS w, d.concept FROM ox_hood_long h JOIN px_dict d ON h.variable = d.variable
    UNION ALL SELECT m.*, string_split(d.label, ':!!') AS w, d.concept FROM ox_muni_long m LEFT JOIN px_dict d ON m.variable = d.variable
    WHERE m.variable <> 'B19049_001') u""",
)


def hub(t: Tables, of: Column | None = None) -> DataFrame:
    """``of``: a condition on label levels; other variables are left out before they are summed."""
    words = catalog.dictionary(t.spark)
    bg, muni = t.px_bg_rows, t.px_muni_rows
    if of is not None:
        named = catalog.with_levels(words).where(of).select("variable")
        bg, muni = (joins.null_safe_join(rows, named, ["variable"], "left_semi") for rows in (bg, muni))
    return survey.hub(survey.city_long(bg, t.px_alloc, CITY, MERGES), survey.municipality_long(muni, OVERRIDES), words)


def kept_hub(t: Tables) -> DataFrame:
    """The hub for queries that read it more than once."""
    return t.kept("hub", lambda: hub(t))


# Spark only: survey rows of a source area, read once, under numbers instead of names; the one variable that counties count by another rule
# has a row for them (1) and one for the other geographies (2)
_ONCE = f"""SELECT source, idx, inline(CASE WHEN variable = 'B25002_003'
    THEN array(named_struct('rule', 1, 'estimate', CAST(l_quantity AS DOUBLE)), named_struct('rule', 2, 'estimate', estimate))
    ELSE array(named_struct('rule', 0, 'estimate', estimate)) END)
    FROM (SELECT l_suppkey AS source, l_quantity, v.idx, v.variable, CAST({shapes.ESTIMATE} AS DOUBLE) AS estimate {shapes.ROWS})"""
_LEVELS = {
    "block group": shapes.bg_geoid("source"), "tract": shapes.tract_geoid("source"),
    "place": f"CAST(source % 25 AS STRING) || '-' || CAST({shapes.PART.replace('l_suppkey', 'source')} AS STRING)", "county": "CAST(source % 5 AS STRING)",
}


def _listed(*geographies: str) -> str:
    return "array(" + ", ".join(f"named_struct('geography', '{g}', 'GEOID', {_LEVELS[g]})" for g in geographies) + ")"


# the areas of four geographies that a source area counts in
_COUNTS_IN = f"inline(CASE rule WHEN 1 THEN {_listed('county')} WHEN 2 THEN {_listed('block group', 'tract', 'place')} ELSE {_listed(*_LEVELS)} END)"
_NAMED = f"""SELECT 'place' AS geography, CAST(nk AS STRING) || '-' || CAST(part AS STRING) AS GEOID, GEOID AS place, NAME FROM px_muni_names
    UNION ALL SELECT 'county', CAST(r_regionkey AS STRING), CAST(NULL AS STRING), replace(r_name, ' ', '-') || ' County, ' || {shapes.state_name('r_regionkey')} FROM region"""


def read_once(t: Tables) -> Tables:
    """The survey tables of a query that needs several of them, from one aggregation over one scan."""

    def make() -> DataFrame:
        # sum per source area before a row counts in four areas
        sources = statistics.collect(t.sql(_ONCE), ["source", "idx", "rule"])
        named = joins.null_safe_join(sources, t.px_vars, ["idx"])
        areas = statistics.regroup(named.selectExpr("variable", *statistics.MERGED, _COUNTS_IN))
        found = joins.null_safe_join(areas, t.sql(_NAMED), ["geography", "GEOID"], "left")
        named = found.where(F.col("geography").isin("block group", "tract") | F.col("NAME").isNotNull())
        return named.withColumn("GEOID", F.coalesce("place", "GEOID")).drop("place")

    found = t.kept("statistics", make)
    t.put("px_bg_rows", statistics.rows(found, "block group").drop("NAME"))
    t.put("px_tract", statistics.rows(found, "tract").drop("NAME"))
    t.put("px_muni_rows", statistics.rows(found, "place"))
    t.put("px_county", statistics.rows(found, "county").drop("GEOID"))
    t.put("px_bg", statistics.one_each(found, "block group", catalog.MEDIAN_INCOME).drop("NAME"))
    t.put("px_muni", statistics.one_each(found, "place", catalog.MEDIAN_INCOME))
    return t


@query("merge_split_places", f"SELECT County, Municipality, variable, round({strict('estimate')}, 6) AS estimate FROM ox_named_muni GROUP BY ALL")
def _(t: Tables):
    sums = t.px_muni_rows.groupBy("NAME", "variable").agg(missing.sum_strict("estimate").alias("estimate"))
    named = names.harmonise_places(sums)
    return r6(names.merge_split_places(named, ["County", "Municipality", "variable"], "estimate", OVERRIDES), "estimate")


@query("apportion_crosswalk", f"SELECT {KEYS}, variable, round(estimate, 6) AS estimate FROM ox_hood_long")
def _(t: Tables):
    return r6(survey.city_long(t.px_bg_rows, t.px_alloc, CITY, MERGES), "estimate").select(*AREA, "variable", "estimate")


@query(
    "stack_levels",
    f"SELECT {KEYS}, variable, round(estimate, 6) AS estimate, Group1, Group2, Group3, Group4, Group5, concept FROM ox_hub",
)
def _(t: Tables):
    return r6(hub(t), "estimate").select(*AREA, "variable", "estimate", *[f"Group{i}" for i in range(1, 6)], "concept")


_CATEGORIES = [*earlier.CATEGORIES, earlier.MEDIAN]


@query(
    "category_map_sum",
    f"""SELECT NAME, {', '.join(f"max(CASE WHEN category = '{c}' THEN total END) AS {c}" for c in _CATEGORIES)}
    FROM (SELECT NAME, category, CASE WHEN count(estimate) = count(*) THEN sum(estimate) END AS total
    FROM px_muni_rows r JOIN px_cat c ON r.variable = c.variable GROUP BY ALL) GROUP BY NAME""",
)
def _(t: Tables):
    return earlier.category_wide(t.px_muni_rows, catalog.category_lookup(t.spark), ["NAME"], _CATEGORIES)


# --- themes ------------------------------------------------------------------

view(
    "ox_pop_rows",
    f"""SELECT {KEYS}, CASE WHEN concept LIKE 'Sex%' THEN 'Population' WHEN concept LIKE 'Geographical%' THEN 'Mobility' WHEN concept LIKE 'Households%' THEN 'HH'
    WHEN concept LIKE 'Educational%' THEN 'Over25' WHEN concept LIKE 'Age%' THEN 'Over5' WHEN concept LIKE 'Poverty%' THEN 'Poverty' ELSE 'HousingUnits' END AS m, estimate
    FROM ox_hub WHERE ends_with(variable, '_001') AND NOT contains(concept, 'Income')""",
)
POPS = ["Population", "Mobility", "HH", "Over25", "Over5", "Poverty", "HousingUnits"]
view(
    "ox_pops",
    f"SELECT {KEYS}, " + ", ".join(f"max(CASE WHEN m = '{p}' THEN estimate END) AS Pop{p}" for p in POPS) + f" FROM ox_pop_rows GROUP BY {KEYS}",
)


def class_view(name: str, where: str, case: str, classes: list[str], drop: str | None = None) -> None:
    """Totals of a theme: filter, class, sum, pivot."""
    keep = f"WHERE cls <> '{drop}'" if drop else ""
    cells = ", ".join(f"max(CASE WHEN cls = '{c}' THEN total END) AS Total{c}" for c in classes)
    view(
        name,
        f"""SELECT {KEYS}, {cells} FROM (SELECT {KEYS}, cls, {strict('estimate')} AS total FROM (SELECT {KEYS}, {case} AS cls, estimate FROM ox_hub
        WHERE {where}) GROUP BY {KEYS}, cls) {keep} GROUP BY {KEYS}""",
    )


class_view(
    "ox_race",
    "contains(concept, 'Race')",
    "CASE WHEN contains(Group2, 'White') THEN 'White' WHEN contains(Group2, 'Black') THEN 'Black' WHEN contains(Group2, 'Hispanic') THEN 'Hispanic' ELSE 'Other' END",
    ["White", "Black", "Hispanic"],
    "Other",
)
class_view(
    "ox_lang",
    "contains(concept, 'Language')",
    "CASE WHEN Group2 IS NULL THEN 'Total' WHEN contains(Group3, 'English') THEN 'English' ELSE 'NotWell' END",
    ["English", "NotWell"],
    "Total",
)
_HH = ", ".join(f"'B11012_{i:03d}'" for i in (3, 4, 6, 7, 9, 10, 11, 12, 14, 15, 16, 17))
class_view(
    "ox_hh",
    f"variable IN ({_HH})",
    """CASE WHEN contains(Group2, 'couple') THEN CASE WHEN starts_with(Group3, 'With children') THEN 'TwoParent' ELSE 'Couple' END
    ELSE CASE WHEN starts_with(Group3, 'With children') THEN 'SingleParent' ELSE 'Single' END END""",
    ["Couple", "Single", "SingleParent", "TwoParent"],
)
class_view(
    "ox_mobile",
    "variable IN ('B07201_002', 'B07201_004', 'B07201_014')",
    "CASE WHEN starts_with(Group2, 'Same') THEN 'SameHome' WHEN Group3 IS NOT NULL THEN 'SameCity' ELSE 'Abroad' END",
    ["Abroad", "SameCity", "SameHome"],
)
class_view(
    "ox_dep",
    "variable BETWEEN 'B15003_017' AND 'B15003_025' OR variable IN ('B17010_002', 'B25002_003') OR contains(variable, 'B27010')",
    """CASE WHEN starts_with(concept, 'Educational') THEN 'NoHighSchool' WHEN starts_with(concept, 'Poverty') THEN 'Poverty'
    WHEN starts_with(concept, 'Occupancy') THEN 'Vacant' ELSE 'Uninsured' END""",
    ["NoHighSchool", "Poverty", "Uninsured", "Vacant"],
)


def ratio(n: str, d: str, name: str) -> str:
    return f"round({n} / nullif({d}, 0), 6) AS {name}"


def join_pops(v: str) -> str:
    return f"FROM {v} v JOIN ox_pops p USING ({KEYS})"


@query("reference_pops", f"SELECT {KEYS}, {', '.join(f'round(Pop{p}, 6) AS Pop{p}' for p in POPS)} FROM ox_pops")
def _(t: Tables):
    return r6(themes.reference_pops(hub(t)), *[f"Pop{p}" for p in POPS])


def _theme(t: Tables, name: str) -> DataFrame:
    wide = themes.theme_wide(hub(t), name)
    return r6(wide, *[c for c in wide.columns if c not in AREA])


def _r(c: str) -> str:
    return f"round({c}, 6) AS {c}"


@query(
    "theme_race",
    f"""SELECT {KEYS}, {_r('TotalBlack')}, {_r('TotalWhite')}, {_r('TotalHispanic')}, {_r('PopPopulation')}, {ratio('TotalBlack', 'PopPopulation', 'RateBlack')},
    {ratio('TotalWhite', 'PopPopulation', 'RateWhite')}, {ratio('TotalHispanic', 'PopPopulation', 'RateHispanic')} {join_pops('ox_race')}""",
)
def _(t: Tables):
    return _theme(t, "race")


@query(
    "theme_language",
    f"""SELECT {KEYS}, round(PopOver5 - TotalEnglish, 6) AS TotalOtherThanEnglish, {_r('TotalNotWell')}, {_r('PopOver5')},
    {ratio('(PopOver5 - TotalEnglish)', 'PopOver5', 'RateOtherThanEnglish')}, {ratio('TotalNotWell', 'PopOver5', 'RateNotWell')} {join_pops('ox_lang')}""",
)
def _(t: Tables):
    return _theme(t, "language")


_HHK = ["Couple", "Single", "SingleParent", "TwoParent"]


@query(
    "theme_households",
    f"""SELECT {KEYS}, {', '.join(_r(f'Total{k}') for k in _HHK)}, {_r('PopHH')}, {', '.join(ratio(f'Total{k}', 'PopHH', f'Rate{k}') for k in _HHK)} {join_pops('ox_hh')}""",
)
def _(t: Tables):
    return _theme(t, "households")


_US = "(PopMobility - TotalSameHome - TotalSameCity - TotalAbroad)"


@query(
    "theme_mobility",
    f"""SELECT {KEYS}, {_r('TotalSameHome')}, {_r('TotalSameCity')}, round({_US}, 6) AS TotalOtherUS, {_r('TotalAbroad')}, {_r('PopMobility')},
    {', '.join(ratio(f'Total{k}', 'PopMobility', f'Rate{k}') for k in ('SameHome', 'SameCity', 'Abroad'))}, {ratio(_US, 'PopMobility', 'RateOtherUS')} {join_pops('ox_mobile')}""",
)
def _(t: Tables):
    return _theme(t, "mobility")


_DEP = [("Poverty", "Poverty"), ("Uninsured", "Population"), ("NoHighSchool", "Over25"), ("Vacant", "HousingUnits")]


@query(
    "theme_deprivation_inputs",
    f"""SELECT {KEYS}, {', '.join(_r(f'Total{k}') for k, _ in _DEP)}, {', '.join(_r(f'Pop{p}') for _, p in _DEP)},
    {', '.join(ratio(f'Total{k}', f'Pop{p}', f'Rate{k}') for k, p in _DEP)} {join_pops('ox_dep')}""",
)
def _(t: Tables):
    return _theme(t, "deprivation")


CHILD_BANDS = "('Under 5 years', '5 to 9 years', '10 to 14 years', '15 to 17 years')"
view("ox_children", f"SELECT {KEYS}, {strict('estimate')} AS Children FROM ox_hub WHERE Group3 IN {CHILD_BANDS} GROUP BY {KEYS}")


@query("children_count", f"SELECT {KEYS}, {_r('Children')} FROM ox_children")
def _(t: Tables):
    return r6(themes.children(hub(t, catalog.child_kind().isNotNull())), "Children")


@query(
    "theme_age_gender",
    f"""WITH a AS (SELECT {KEYS}, Group2 AS Gender, CASE replace(Group3, ' years', '') WHEN '15 to 17' THEN '15 to 19' WHEN '18 and 19' THEN '15 to 19'
    WHEN '20' THEN '20 to 24' WHEN '21' THEN '20 to 24' WHEN '22 to 24' THEN '20 to 24' WHEN '60 and 61' THEN '60 to 64' WHEN '62 to 64' THEN '60 to 64'
    WHEN '65 and 66' THEN '65 to 69' WHEN '67 to 69' THEN '65 to 69' ELSE replace(Group3, ' years', '') END AS Age, estimate
    FROM ox_hub WHERE concept = 'Sex by Age' AND Group3 IS NOT NULL),
    s AS (SELECT {KEYS}, Gender, Age, {strict('estimate')} AS Population FROM a GROUP BY {KEYS}, Gender, Age)
    SELECT {KEYS}, Gender, Age, round(Population, 6) AS Population, round_even(100 * Population / nullif(sum(Population) OVER (PARTITION BY {KEYS}), 0), 1) AS Pct FROM s""",
)
def _(t: Tables):
    return r6(themes.age_gender(hub(t)), "Population")


# --- interpolation, assistance, income ----------------------------------------


def hh_view(name: str, base_city: bool) -> None:
    where = "WHERE variable = 'B11012_001' AND estimate IS NOT NULL" + (" AND Municipality = 'Nation_0'" if base_city else "")
    view(
        name,
        f"""SELECT TractID, Municipality, Neighborhood, TractHH, HoodTractHH, HoodTractHH / nullif(TractHH, 0) AS Allocation FROM
        (SELECT *, sum(HoodTractHH) OVER (PARTITION BY TractID) AS TractHH FROM (SELECT substring(r.GEOID, 1, 11) AS TractID, Municipality,
        {merged()} AS Neighborhood, sum(estimate * Allocation) AS HoodTractHH FROM px_bg_rows r JOIN px_alloc a ON r.GEOID = a.GEOID {where} GROUP BY 1, 2, 3))
        WHERE Municipality = 'Nation_0'""",
    )


hh_view("ox_hh_share", False)
hh_view("ox_hh_share_city", True)
view(
    "ox_tract_hh",
    f"""SELECT GEOID, max(CASE WHEN variable = 'B11012_001' THEN e END) AS PopHH, max(CASE WHEN variable = 'B19058_002' THEN e END) AS TotalAssistance
    FROM (SELECT GEOID, variable, {strict('estimate')} AS e FROM px_tract WHERE variable IN ('B11012_001', 'B19058_002') GROUP BY 1, 2) GROUP BY GEOID""",
)
_INTER = f"""SELECT 'AFRICA' AS County, Municipality, Neighborhood, {strict('PopHH * Allocation')} AS PopHH, {strict('TotalAssistance * Allocation')} AS TotalAssistance
    FROM ox_tract_hh t JOIN {{}} h ON t.GEOID = h.TractID GROUP BY Municipality, Neighborhood"""
view("ox_inter", _INTER.format("ox_hh_share"))
view("ox_inter_city", _INTER.format("ox_hh_share_city"))


def interpolated(t: Tables, base: str = "tract") -> DataFrame:
    shares = survey.household_shares(t.px_bg_rows, t.px_alloc, CITY, MERGES, base)
    return survey.interpolate_assistance(t.px_tract, shares, CITY)


for _key, _view, _base in (("share_interpolate", "ox_inter", "tract"), ("share_interpolate_city", "ox_inter_city", "city")):

    @query(_key, f"SELECT {KEYS}, round(PopHH, 4) AS PopHH, round(TotalAssistance, 4) AS TotalAssistance FROM {_view}")
    def _(t: Tables, base: str = _base):
        return interpolated(t, base).select(*AREA, F.round("PopHH", 4).alias("PopHH"), F.round("TotalAssistance", 4).alias("TotalAssistance"))


view(
    "ox_assist",
    f"""SELECT *, TotalAssistance / nullif(PopHH, 0) AS AssistancePct FROM (SELECT {KEYS}, max(CASE WHEN variable = 'B11012_001' THEN estimate END) AS PopHH,
    max(CASE WHEN variable = 'B19058_002' THEN estimate END) AS TotalAssistance FROM ox_hub WHERE variable IN ('B11012_001', 'B19058_002')
    AND Municipality = Neighborhood GROUP BY {KEYS} UNION ALL SELECT {KEYS}, PopHH, TotalAssistance FROM ox_inter)""",
)


def assistance(t: Tables) -> DataFrame:
    return themes.assistance(kept_hub(t), interpolated(t))


@query("theme_assistance", f"SELECT {KEYS}, round(PopHH, 4) AS PopHH, round(TotalAssistance, 4) AS TotalAssistance, {_r('AssistancePct')} FROM ox_assist")
def _(t: Tables):
    out = assistance(t)
    return out.select(
        *AREA, F.round("PopHH", 4).alias("PopHH"), F.round("TotalAssistance", 4).alias("TotalAssistance"), F.round("AssistancePct", 6).alias("AssistancePct")
    )


view(
    "ox_income",
    f"""WITH b AS (SELECT GEOID, max(CASE WHEN variable = 'B19049_001' THEN estimate END) AS med, max(CASE WHEN variable = 'B11012_001' THEN estimate END) AS hh
      FROM px_bg GROUP BY GEOID),
    m AS (SELECT GEOID, NAME, max(CASE WHEN variable = 'B19049_001' THEN estimate END) AS med, max(CASE WHEN variable = 'B11012_001' THEN estimate END) AS hh
      FROM px_muni GROUP BY GEOID, NAME),
    n AS (SELECT Municipality, {overridden()} AS County, med, hh FROM (SELECT {CLEAN_SQL} AS Municipality, replace(string_split(NAME, ', ')[2], ' County', '') AS County, med, hh
      FROM m WHERE med IS NOT NULL))
    SELECT County, Municipality, Municipality AS Neighborhood, ({strict('med * hh')}) / nullif({strict('hh')}, 0) AS value FROM n GROUP BY County, Municipality
    UNION ALL SELECT 'AFRICA', Municipality, {merged()}, ({strict('med * hh * Allocation')}) / nullif({strict('hh * Allocation')}, 0)
    FROM b JOIN px_alloc a ON b.GEOID = a.GEOID WHERE Municipality = 'Nation_0' AND med IS NOT NULL GROUP BY Municipality, 3""",
)


def income(t: Tables) -> DataFrame:
    return survey.income(t.px_bg, t.px_alloc, t.px_muni, CITY, MERGES, OVERRIDES)


@query("theme_income", f"SELECT {KEYS}, round(value, 4) AS value FROM ox_income")
def _(t: Tables):
    return income(t).select(*AREA, F.round("value", 4).alias("value"))


# --- deprivation ---------------------------------------------------------------

view(
    "ox_crosswalk",
    """SELECT string_split(County, ' ')[1] AS County, CASE string_split(County, ' ')[2] WHEN 'OH' THEN 'Ohio' WHEN 'KY' THEN 'Kentucky' ELSE 'Indiana' END AS State,
    replace(replace(trim(regexp_replace(Municipality, '(CCD| city|,|village).*', '')), 'NATION', 'Nation'), 'township', 'Township') AS Municipality, Allocation,
    CountyCode || lpad(string_split(Tract, '.')[1], 4, '0') || rpad(coalesce(string_split(Tract, '.')[2], ''), 2, '0') AS GEOID FROM px_talloc_raw
    WHERE County IN ('AFRICA OH', 'AMERICA OH', 'ASIA KY', 'EUROPE KY', 'MIDDLE-EAST IN')""",
)


def crosswalk(t: Tables) -> DataFrame:
    return survey.tract_crosswalk(t.px_talloc_raw, COUNTY_STATES)


view(
    "ox_di_city",
    f"""WITH p AS (SELECT substring(r.GEOID, 1, 11) AS tract, Municipality, {merged()} AS Neighborhood, sum(estimate * Allocation) AS pop
      FROM px_bg_rows r JOIN px_alloc a ON r.GEOID = a.GEOID WHERE Municipality = 'Nation_0' AND variable = 'B01001_001' AND estimate IS NOT NULL GROUP BY 1, 2, 3),
    w AS (SELECT *, pop / nullif(sum(pop) OVER (PARTITION BY Municipality, Neighborhood), 0) AS share FROM p)
    SELECT 'AFRICA' AS County, Municipality, Neighborhood, sum(share * dep_index) AS value FROM w JOIN px_index i ON w.tract = i.census_tract_fips GROUP BY Municipality, Neighborhood""",
)


@query("deprivation_city", f"SELECT {KEYS}, {_r('value')} FROM ox_di_city")
def _(t: Tables):
    return r6(deprivation.city_index(t.px_bg_rows, t.px_alloc, t.px_index, CITY, MERGES), "value")


def di_place(name: str, state: str) -> None:
    view(
        name,
        f"""WITH p AS (SELECT GEOID, {strict('estimate')} AS e FROM px_tract WHERE variable = 'B01001_001' GROUP BY GEOID),
        j AS (SELECT coalesce(p.GEOID, c.GEOID) AS GEOID, County, State, Municipality, e * Allocation AS pop FROM p FULL JOIN ox_crosswalk c ON p.GEOID = c.GEOID),
        k AS (SELECT Municipality, {overridden()} AS County, State, pop, dep_index FROM j JOIN px_index i ON j.GEOID = i.census_tract_fips),
        w AS (SELECT *, pop / nullif({strict('pop').replace('count(*)', 'count(*) OVER g').replace('count(pop)', 'count(pop) OVER g').replace('sum(pop)', 'sum(pop) OVER g')}, 0) AS share
          FROM k WINDOW g AS (PARTITION BY {state} County, Municipality))
        SELECT {state} County, Municipality, Municipality AS Neighborhood, {strict('share * dep_index')} AS value FROM w GROUP BY {state} County, Municipality""",
    )


di_place("ox_di_place", "")
di_place("ox_di_place_state", "State,")
view("ox_di", f"SELECT {KEYS}, value FROM ox_di_place UNION ALL SELECT {KEYS}, value FROM ox_di_city")


@query("deprivation_place", f"SELECT {KEYS}, {_r('value')} FROM ox_di_place")
def _(t: Tables):
    out = deprivation.place_index(t.px_tract, crosswalk(t), t.px_index, OVERRIDES)
    return r6(out.select(*AREA, "value"), "value")


def di(t: Tables) -> DataFrame:
    return deprivation.all_levels(t.px_bg_rows, t.px_alloc, t.px_tract, crosswalk(t), t.px_index, CITY, MERGES, OVERRIDES).select(*AREA, "value")


_PLACE_POPS = f"SELECT State, County, Municipality, sum(estimate) AS Population FROM ox_named_muni WHERE variable = 'B01001_001' GROUP BY 1, 2, 3"
view(
    "ox_di_rolled",
    f"""WITH j AS (SELECT p.State, p.County, p.Population, d.value FROM ({_PLACE_POPS}) p JOIN ox_di_place_state d USING (State, County, Municipality)),
    c AS (SELECT State, County, {strict('value * Population')} AS w, sum(Population) AS Population FROM j GROUP BY State, County)
    SELECT State, County, w / nullif(Population, 0) AS DeprivationIndex FROM c UNION ALL SELECT 'All', 'All', ({strict('w')}) / nullif(sum(Population), 0) FROM c""",
)


def place_pops(t: Tables) -> DataFrame:
    rows = t.px_muni_rows.where(F.col("variable") == catalog.POPULATION).groupBy("NAME").agg(missing.sum_strict("estimate").alias("estimate"))
    named = names.override_county(names.harmonise_places(rows), OVERRIDES)
    return named.groupBy("State", "County", "Municipality").agg(missing.sum_strict("estimate").alias("Population"))


@query("deprivation_rollup", f"SELECT State, County, {_r('DeprivationIndex')} FROM ox_di_rolled")
def _(t: Tables):
    places = rolled_places(t)
    return r6(deprivation.rollup_index(places, place_pops(t)), "DeprivationIndex")


# --- benchmarks ------------------------------------------------------------------


def bench_sql(v: str, measures: list[str], total: dict[str, str], pop: str) -> str:
    """CTE text of long rates with mean, min and max; three separate passes. One missing value makes a sum or an extreme missing."""
    own = "Municipality = Neighborhood"
    rate = {m: f"{total[m]} / nullif({pop}, 0)" for m in measures}
    means = " UNION ALL ".join(f"SELECT '{m}' AS name, ({strict(total[m])}) / nullif({strict(pop)}, 0) AS Mean FROM w WHERE {own}" for m in measures)
    ext = " UNION ALL ".join(f"SELECT '{m}' AS name, {strict(rate[m], 'min')} AS Min, {strict(rate[m], 'max')} AS Max FROM w" for m in measures)
    long = " UNION ALL ".join(f"SELECT {KEYS}, '{m}' AS name, {total[m]} / nullif({pop}, 0) AS value FROM w" for m in measures)
    return f"WITH w AS (SELECT * FROM {v} v JOIN ox_pops p USING ({KEYS})), mn AS ({means}), ex AS ({ext}), lg AS ({long}), b AS (SELECT lg.*, Mean, Min, Max FROM lg JOIN mn USING (name) JOIN ex USING (name))"


_SHADE = "CASE WHEN value > Mean THEN (value - Mean) / nullif(Max - Mean, 0) ELSE (value - Mean) / nullif(Mean - Min, 0) END"
_TEXTLOC = "CASE WHEN value > 0.9 THEN value - 0.025 ELSE value + 0.04 END"
_RACES = ["White", "Black", "Hispanic"]


def race_rates(t: Tables) -> DataFrame:
    return benchmark.compare_rates(t.kept("race", lambda: themes.theme_wide(hub(t), "race")), AREA, _RACES, "PopPopulation", own_row())


_RACE_SQL = bench_sql("ox_race", _RACES, {r: f"Total{r}" for r in _RACES}, "PopPopulation")


@query("bench_mean_min_max", f"{_RACE_SQL} SELECT {KEYS}, name, {_r('value')}, {_r('Mean')}, {_r('Min')}, {_r('Max')} FROM b")
def _(t: Tables):
    return r6(race_rates(t).drop("Shade", "Textloc"), "value", "Mean", "Min", "Max")


@query(
    "bench_shade_diverging",
    f"{bench_sql('ox_hh', _HHK, {k: f'Total{k}' for k in _HHK}, 'PopHH')} SELECT {KEYS}, name, round({_SHADE}, 6) AS Shade, round({_TEXTLOC}, 6) AS Textloc FROM b",
)
def _(t: Tables):
    out = benchmark.compare_rates(t.kept("households", lambda: themes.theme_wide(hub(t), "households")), AREA, _HHK, "PopHH", own_row())
    return r6(out.select(*AREA, "name", "Shade", "Textloc"), "Shade", "Textloc")


def zscore_sql(values: str, variable: str) -> str:
    return f"""WITH v AS ({values}), wt AS (SELECT ({strict('v.value * h.estimate')}) / nullif({strict('h.estimate')}, 0) AS Mean FROM v JOIN ox_hub h USING ({KEYS})
      WHERE h.variable = '{variable}' AND Municipality = Neighborhood),
    st AS (SELECT {strict('value', 'min')} AS Min, {strict('value', 'max')} AS Max, CASE WHEN count(value) = count(*) THEN stddev_samp(value) END AS SD FROM v),
    z AS (SELECT v.*, Mean, Min, Max, SD, (value - Mean) / nullif(SD, 0) AS ZScore FROM v, wt, st),
    x AS (SELECT max(ZScore) AS hi, min(ZScore) AS lo FROM z),
    s AS (SELECT z.*, CASE WHEN ZScore IS NULL THEN NULL WHEN ZScore > 0 THEN (ZScore / nullif(hi, 0) + 1) / 2 ELSE (-ZScore / nullif(lo, 0) + 1) / 2 END AS Scale FROM z, x)"""


def weights(t: Tables, variable: str) -> DataFrame:
    return kept_hub(t).where(F.col("variable") == variable)


_POV = f"SELECT {KEYS}, TotalPoverty / nullif(PopPoverty, 0) AS value {join_pops('ox_dep')}"


def poverty(t: Tables) -> DataFrame:
    return themes.theme_wide(kept_hub(t), "deprivation").select(*AREA, F.col("RatePoverty").alias("value"))


@query(
    "zscore_halfscale",
    f"""{zscore_sql(_POV, 'B17010_001')} SELECT {KEYS}, {', '.join(_r(c) for c in ('value', 'Mean', 'Min', 'Max', 'SD', 'ZScore', 'Scale'))},
    round(CASE WHEN Scale > 0.9 THEN Scale - 0.025 ELSE Scale + 0.04 END, 6) AS Textloc FROM s""",
)
def _(t: Tables):
    values = t.kept("poverty", lambda: poverty(t))
    out = benchmark.zscore_halfscale(values, weights(t, "B17010_001"), AREA, own_row())
    return r6(out, "value", "Mean", "Min", "Max", "SD", "ZScore", "Scale", "Textloc")


_INC = f"SELECT {KEYS}, value FROM ox_income"


@query(
    "direction_flip",
    f"""SELECT 'Poverty' AS name, {KEYS}, round(1 - Scale, 6) AS Shade FROM ({zscore_sql(_POV, 'B17010_001')} SELECT * FROM s)
    UNION ALL SELECT 'MedianIncome', {KEYS}, round(Scale, 6) FROM ({zscore_sql(_INC, 'B11012_001')} SELECT * FROM s)""",
)
def _(t: Tables):
    pov = benchmark.zscore_halfscale(t.kept("poverty", lambda: poverty(t)), weights(t, "B17010_001"), AREA, own_row()).withColumn("name", F.lit("Poverty"))
    inc = benchmark.zscore_halfscale(t.kept("income", lambda: income(t)), weights(t, "B11012_001"), AREA, own_row()).withColumn("name", F.lit("MedianIncome"))
    both = pov.unionByName(inc)
    shade = benchmark.direction_shade(F.col("Scale"), F.col("name").isin("MedianIncome", "NoHS"))
    return both.select("name", *AREA, F.round(shade, 6).alias("Shade"))


# All seven indicators in one table: name, values, their variable of weight; high values are good for some.
_INDICATORS = [
    ("DeprivationIndex", f"SELECT {KEYS}, value FROM ox_di", "B01001_001", False),
    ("Poverty", _POV, "B17010_001", False),
    ("Assistance", f"SELECT {KEYS}, AssistancePct AS value FROM ox_assist", "B11012_001", False),
    ("MedianIncome", _INC, "B11012_001", True),
    ("Uninsured", f"SELECT {KEYS}, TotalUninsured / nullif(PopPopulation, 0) AS value {join_pops('ox_dep')}", "B01001_001", False),
    ("NoHS", f"SELECT {KEYS}, TotalNoHighSchool / nullif(PopOver25, 0) AS value {join_pops('ox_dep')}", "B15003_001", True),
    ("Vacant", f"SELECT {KEYS}, TotalVacant / nullif(PopHousingUnits, 0) AS value {join_pops('ox_dep')}", "B25002_001", False),
]


@query(
    "indicator_comparison",
    " UNION ALL ".join(
        f"SELECT '{n}' AS name, {KEYS}, HoodID, round(Mean, 5) AS Mean, round(Scale, 5) AS Scale, round({'Scale' if good else '1 - Scale'}, 5) AS Shade FROM ({zscore_sql(v, w)} SELECT * FROM s) JOIN ox_areas USING ({KEYS})"
        for n, v, w, good in _INDICATORS
    ),
)
def _(t: Tables):
    read_once(t)
    rates = themes.theme_wide(kept_hub(t), "deprivation")
    names_ = {"Poverty": "RatePoverty", "Uninsured": "RateUninsured", "NoHS": "RateNoHighSchool", "Vacant": "RateVacant"}
    values = rates.select(*AREA, *[F.col(c).alias(n) for n, c in names_.items()]).unpivot(AREA, list(names_), "name", "value")
    for name, part in (("DeprivationIndex", di(t)), ("Assistance", assistance(t).withColumn("value", F.col("AssistancePct"))), ("MedianIncome", income(t))):
        values = values.unionByName(part.select(*AREA, F.lit(name).alias("name"), "value"))
    by_weight = {}
    for name, _, weight, _ in _INDICATORS:
        by_weight.setdefault(weight, []).append(F.lit(name))
    names_of = F.create_map(*[x for w, ns in by_weight.items() for x in (F.lit(w), F.array(*ns))])
    weighted = kept_hub(t).where(F.col("variable").isin(list(by_weight))).select(*AREA, F.explode(names_of[F.col("variable")]).alias("name"), "estimate")
    out = benchmark.zscore_by(t.kept("values", lambda: values), weighted, AREA, "name", own_row())
    good = [n for n, *_, high in _INDICATORS if high]
    shade = benchmark.direction_shade(F.col("Scale"), F.col("name").isin(good))
    out = out.select("name", *AREA, F.round("Mean", 5).alias("Mean"), F.round("Scale", 5).alias("Scale"), F.round(shade, 5).alias("Shade"))
    areas = survey.areas(kept_hub(t)).select(*AREA, "HoodID")
    return joins.null_safe_join(out, areas, AREA)


# Four themes against their own denominators: name, total and population of each measure.
_COMPARED = [
    ("ox_race", _RACES, {r: f"Total{r}" for r in _RACES}, "PopPopulation"),
    ("ox_lang", ["OtherThanEnglish", "NotWell"], {"OtherThanEnglish": "(PopOver5 - TotalEnglish)", "NotWell": "TotalNotWell"}, "PopOver5"),
    ("ox_hh", _HHK, {k: f"Total{k}" for k in _HHK}, "PopHH"),
    ("ox_mobile", ["SameHome", "SameCity", "Abroad", "OtherUS"], {"SameHome": "TotalSameHome", "SameCity": "TotalSameCity", "Abroad": "TotalAbroad", "OtherUS": _US}, "PopMobility"),
]


@query(
    "theme_benchmarks",
    " UNION ALL ".join(
        f"SELECT * FROM ({bench_sql(v, m, total, pop)} SELECT {KEYS}, name, {_r('value')}, {_r('Mean')}, {_r('Min')}, {_r('Max')}, round({_SHADE}, 5) AS Shade FROM b)" for v, m, total, pop in _COMPARED
    ),
)
def _(t: Tables):
    compared = ["race", "language", "households", "mobility"]
    wide = t.kept("themes", lambda: themes.totals_and_rates(hub(t), compared, together=False))
    denominators = {m: pop for _, measures, _, pop in _COMPARED for m in measures}
    members = {m: F.col(f"In{name}") for name, (_, measures, _, _) in zip(compared, _COMPARED) for m in measures}
    out = benchmark.compare_rates(wide, AREA, list(denominators), denominators, own_row(), members=members)
    return r6(out.drop("Textloc"), "value", "Mean", "Min", "Max").withColumn("Shade", F.round("Shade", 5))


_TIER = "CASE WHEN {0} >= 0.6 THEN 'Highest' WHEN {0} >= 0.475 THEN 'Higher' WHEN {0} >= 0.35 THEN 'Medium' WHEN {0} >= 0.225 THEN 'Lower' ELSE 'Lowest' END"


@query(
    "tier_bucket",
    f"SELECT {KEYS}, {_TIER.format('value')} AS Tier, CASE {_TIER.format('value')} WHEN 'Highest' THEN 5 WHEN 'Higher' THEN 4 WHEN 'Medium' THEN 3 WHEN 'Lower' THEN 2 ELSE 1 END AS rank FROM ox_di",
)
def _(t: Tables):
    out = di(t).withColumn("Tier", benchmark.tier(F.col("value")))
    return out.select(*AREA, "Tier", benchmark.tier_rank(F.col("Tier")).alias("rank"))


_AREAS_SQL = f"SELECT *, row_number() OVER (ORDER BY Neighborhood, County, Municipality) AS HoodID FROM (SELECT DISTINCT {KEYS} FROM ox_hub)"
view("ox_areas", _AREAS_SQL)
_VIEW_LIST = "('Nation_0', 'Nation_1', 'Nation_2', 'Nation_3 Township')"


@query(
    "area_subsets",
    f"""SELECT 'muni' AS view, {KEYS}, HoodID FROM ox_areas WHERE Municipality = Neighborhood
    UNION ALL SELECT 'city', {KEYS}, HoodID FROM ox_areas WHERE Municipality IN {_VIEW_LIST} AND Neighborhood <> 'Nation_0'""",
)
def _(t: Tables):
    muni, city = survey.area_views(t.kept("areas", lambda: survey.areas(kept_hub(t))), CITY)
    return muni.withColumn("view", F.lit("muni")).unionByName(city.withColumn("view", F.lit("city")))


@query(
    "chart_label",
    f"""WITH v AS (SELECT 'DI' AS name, {KEYS}, value FROM ox_di UNION ALL SELECT 'MedianIncome', {KEYS}, value FROM ox_income UNION ALL SELECT 'Poverty', {KEYS}, TotalPoverty / nullif(PopPoverty, 0) {join_pops('ox_dep')})
    SELECT name, {KEYS}, CASE WHEN value IS NULL THEN 'NA' WHEN name = 'DI' THEN CAST(round_even(value, 3) AS VARCHAR)
    WHEN name = 'MedianIncome' THEN '$' || regexp_replace(CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR), '([0-9]+)([0-9]{{3}})$', '\\1,\\2')
    ELSE CASE WHEN round_even(value * 100, 1) = trunc(round_even(value * 100, 1)) THEN CAST(CAST(round_even(value * 100, 1) AS BIGINT) AS VARCHAR) ELSE CAST(round_even(value * 100, 1) AS VARCHAR) END || '%' END AS label FROM v""",
)
def _(t: Tables):
    from areaspark.functions import numbers

    rows = (
        di(t).withColumn("name", F.lit("DI"))
        .unionByName(income(t).withColumn("name", F.lit("MedianIncome")))
        .unionByName(poverty(t).withColumn("name", F.lit("Poverty")))
    )
    v = F.col("value")
    label = (
        F.when(v.isNull(), "NA")
        .when(F.col("name") == "DI", F.bround(v, 3).cast("string"))
        .when(F.col("name") == "MedianIncome", numbers.thousands(numbers.truncate_int(v), "$"))
        .otherwise(numbers.percent_text(v))
    )
    return rows.select("name", *AREA, label.alias("label"))


_MEASURES = ["DI", "MedianIncome", "Poverty"]


@query(
    "chart_pad_missing",
    f"""WITH v AS (SELECT 'DI' AS name, {KEYS}, value FROM ox_di UNION ALL SELECT 'MedianIncome', {KEYS}, value FROM ox_income WHERE value > 50000),
    a AS (SELECT DISTINCT {KEYS} FROM v), m AS (SELECT * FROM (VALUES ('DI'), ('MedianIncome'), ('Poverty')) AS t(name))
    SELECT {', '.join(f'a.{k}' for k in AREA)}, m.name, round(v.value, 4) AS value FROM a CROSS JOIN m LEFT JOIN v ON v.name = m.name AND
    {' AND '.join(f'v.{k} IS NOT DISTINCT FROM a.{k}' for k in AREA)}""",
)
def _(t: Tables):
    rows = t.kept(
        "measures",
        lambda: di(t).withColumn("name", F.lit("DI")).unionByName(income(t).where("value > 50000").withColumn("name", F.lit("MedianIncome"))),
    )
    return benchmark.pad_missing_measures(rows, AREA, _MEASURES).select(*AREA, "name", F.round("value", 4).alias("value"))


# --- earlier generation -----------------------------------------------------------

_CATS = earlier.CATEGORIES
_EKEYS = "State, County, Municipality, Neighborhood"


def _cells(measure: str = "total", cats: list[str] | None = None) -> str:
    return ", ".join(f"max(CASE WHEN category = '{c}' THEN {measure} END) AS {c}" for c in (cats or _CATS))


def _cat_rows(rows: str, ids: str, where: str = "") -> str:
    return f"(SELECT {ids}, category, {strict('estimate')} AS total FROM {rows} r JOIN px_cat c ON r.variable = c.variable {where} GROUP BY {ids}, category)"


_NO_ASSIST = [c for c in _CATS if c != "Assistance"]
view(
    "ox_e_city",
    f"""WITH b AS (SELECT GEOID, {_cells(cats=[*_NO_ASSIST, 'MedianHHIncome'])} FROM {_cat_rows('px_bg_rows', 'GEOID')} GROUP BY GEOID),
    j AS (SELECT b.*, MedianHHIncome * Households AS Income, a.Municipality, a.Neighborhood, a.Allocation FROM b JOIN px_alloc a ON b.GEOID = a.GEOID WHERE Municipality = 'Nation_0'),
    s AS (SELECT Municipality, Neighborhood, {', '.join(f'{strict(f"{c} * Allocation")} AS {c}' for c in _NO_ASSIST)} FROM j GROUP BY 1, 2),
    i AS (SELECT Neighborhood, sum(Income * Allocation) AS Income, sum(Households * Allocation) AS IncomeHH FROM j WHERE Income IS NOT NULL GROUP BY 1),
    h AS (SELECT substring(r.GEOID, 1, 11) AS tract, Neighborhood, sum(estimate * Allocation) AS hh FROM px_bg_rows r JOIN px_alloc a ON r.GEOID = a.GEOID
      WHERE Municipality = 'Nation_0' AND variable = 'B11012_001' AND estimate IS NOT NULL GROUP BY 1, 2),
    w AS (SELECT *, hh / nullif(sum(hh) OVER (PARTITION BY tract), 0) AS share FROM h),
    t AS (SELECT GEOID, {strict('estimate')} AS e FROM px_tract WHERE variable = 'B19058_002' GROUP BY 1),
    n AS (SELECT Neighborhood, {strict('e * share')} AS Assistance FROM t JOIN w ON t.GEOID = w.tract GROUP BY 1)
    SELECT 'Ohio' AS State, 'AFRICA' AS County, s.Municipality, s.Neighborhood, {', '.join(f'round_even(s.{c}, 0) AS {c}' for c in _NO_ASSIST)},
    round_even(Income, 0) AS Income, round_even(IncomeHH, 0) AS IncomeHH, round_even(n.Assistance, 0) AS Assistance
    FROM s LEFT JOIN i ON s.Neighborhood = i.Neighborhood JOIN n ON s.Neighborhood = n.Neighborhood""",
)
view(
    "ox_e_muni",
    f"""WITH g AS (SELECT GEOID, NAME, {_cells(cats=[*_CATS, 'MedianHHIncome'])} FROM {_cat_rows('px_muni_rows', 'GEOID, NAME', 'WHERE estimate > 0')} GROUP BY GEOID, NAME),
    n AS (SELECT *, {overridden('Cty')} AS County FROM (SELECT *, {CLEAN_SQL} AS Municipality, replace(string_split(NAME, ', ')[2], ' County', '') AS Cty, string_split(NAME, ', ')[3] AS State FROM g)),
    a AS (SELECT State, County, Municipality, {', '.join(f'coalesce(sum({c}), 0) AS {c}' for c in _CATS)} FROM n GROUP BY 1, 2, 3),
    i AS (SELECT State, County, Municipality, {strict('MedianHHIncome * Households')} AS Income, {strict('Households')} AS IncomeHH FROM n
      WHERE MedianHHIncome IS NOT NULL OR Households IS NOT NULL GROUP BY 1, 2, 3)
    SELECT State, County, Municipality, CAST(NULL AS VARCHAR) AS Neighborhood, {', '.join(_CATS)}, Income, IncomeHH FROM a JOIN i USING (State, County, Municipality)""",
)
view(
    "ox_e_county",
    f"""SELECT string_split(NAME, ', ')[2] AS State, replace(string_split(NAME, ', ')[1], ' County', '') AS County, CAST(NULL AS VARCHAR) AS Municipality, CAST(NULL AS VARCHAR) AS Neighborhood,
    {', '.join(_CATS)}, MedianHHIncome * Households AS Income, Households AS IncomeHH FROM
    (SELECT NAME, {_cells(cats=[*_CATS, 'MedianHHIncome'])} FROM {_cat_rows('px_county', 'NAME')} GROUP BY NAME)""",
)
_M = [*_CATS, "Income", "IncomeHH"]
view(
    "ox_e_levels",
    f"""SELECT {_EKEYS}, {', '.join(_M)} FROM ox_e_city UNION ALL SELECT {_EKEYS}, {', '.join(_M)} FROM ox_e_muni UNION ALL SELECT {_EKEYS}, {', '.join(_M)} FROM ox_e_county
    UNION ALL SELECT 'All', 'All', NULL, NULL, {', '.join(strict(c) for c in _M)} FROM ox_e_county""",
)
view(
    "ox_e_index",
    f"""SELECT 'Ohio' AS State, County, Municipality, Neighborhood, value AS DeprivationIndex FROM ox_di_city
    UNION ALL SELECT State, County, Municipality, NULL, value FROM ox_di_place_state UNION ALL SELECT State, County, NULL, NULL, DeprivationIndex FROM ox_di_rolled""",
)
_ERATES = ", ".join(f"{n} / nullif({d}, 0) AS {r}" for r, (n, d) in earlier.RATES.items())
view(
    "ox_e_wide",
    f"""WITH l AS (SELECT *, Age5 - English AS OtherLanguage FROM ox_e_levels), r AS (SELECT l.*, {_ERATES}, Income / nullif(IncomeHH, 0) AS MedianHHIncome FROM l
      WHERE EXISTS (SELECT 1 FROM ox_e_index i WHERE {' AND '.join(f'i.{k} IS NOT DISTINCT FROM l.{k}' for k in _EKEYS.split(', '))}))
    SELECT {', '.join(f'coalesce(r.{k}, i.{k}) AS {k}' for k in _EKEYS.split(', '))}, {', '.join(earlier.ORDER)}, i.DeprivationIndex FROM r FULL JOIN ox_e_index i
    ON {' AND '.join(f'i.{k} IS NOT DISTINCT FROM r.{k}' for k in _EKEYS.split(', '))}""",
)


def earlier_wide(t: Tables) -> DataFrame:
    read_once(t)
    lookup = catalog.category_lookup(t.spark)
    # the earlier data has no merged neighbourhoods; keep the shape's merges for one index
    alloc = names.merge_neighbourhoods(t.px_alloc, {})
    city = earlier.city_levels(t.px_bg_rows, alloc, t.px_tract, lookup, CITY)
    muni = earlier.municipality_levels(t.px_muni_rows, lookup, OVERRIDES)
    county = t.kept("county", lambda: earlier.county_levels(t.px_county, lookup))
    levels = t.kept(
        "levels", lambda: city.unionByName(muni).unionByName(county).unionByName(earlier.metro_level(county))
    )
    return earlier.rates_wide(levels, t.kept("index", lambda: earlier_index(t)))


def rolled_places(t: Tables) -> DataFrame:
    return t.kept("places", lambda: deprivation.place_index(t.px_tract, crosswalk(t), t.px_index, OVERRIDES, with_state=True))


def earlier_index(t: Tables) -> DataFrame:
    """Deprivation index of all four levels."""
    places = rolled_places(t)
    none = F.lit(None).cast("string")
    return (
        deprivation.city_index(t.px_bg_rows, t.px_alloc, t.px_index, CITY, MERGES)
        .select(F.lit(CITY.state).alias("State"), *AREA, F.col("value").alias("DeprivationIndex"))
        .unionByName(places.select("State", "County", "Municipality", none.alias("Neighborhood"), F.col("value").alias("DeprivationIndex")))
        .unionByName(
            deprivation.rollup_index(places, place_pops(t)).select(
                "State", "County", none.alias("Municipality"), none.alias("Neighborhood"), "DeprivationIndex"
            )
        )
    )


@query(
    "rates_wide_2021",
    f"SELECT {_EKEYS}, {', '.join(f'round({c}, 5) AS {c}' for c in earlier.ORDER)}, round(DeprivationIndex, 5) AS DeprivationIndex FROM ox_e_wide",
)
def _(t: Tables):
    wide = earlier_wide(t)
    return wide.select(*earlier.KEYS, *[F.round(c, 5).alias(c) for c in [*earlier.ORDER, "DeprivationIndex"]])


_ALL = "coalesce({0}, 'All')"
_LM = [*earlier.RATES, earlier.MEDIAN, "DeprivationIndex"]
_RAW = ", ".join(f"'{m}'" for m in ("WhiteRate", "BlackRate", "HispanicRate", "ChildRate", "ChildHHRate", "OtherLanguageRate", "LimitedEnglishRate"))
view(
    "ox_e_labelled",
    f"""SELECT *, CASE WHEN Neighborhood <> 'All' THEN 'Neighborhood' WHEN Municipality <> 'All' THEN 'Municipality' WHEN County <> 'All' THEN 'County' ELSE 'All' END AS Level
    FROM (SELECT State, County, coalesce(Municipality, 'All') AS Municipality, coalesce(Neighborhood, 'All') AS Neighborhood,
    {', '.join(_LM)} FROM ox_e_wide)""",
)


def labelled(t: Tables) -> DataFrame:
    rows = t.kept("earlier", lambda: earlier_wide(t)).withColumns({k: F.coalesce(k, F.lit("All")) for k in ("Municipality", "Neighborhood")})
    return benchmark.level_and_label(rows)


_ELONG = " UNION ALL ".join(f"SELECT Level, County, Municipality, Neighborhood, '{m}' AS variable, {m} AS value FROM ox_e_labelled" for m in _LM)
view("ox_e_long", _ELONG)


def pairing_view(name: str, metro_levels: list[str]) -> None:
    metro = " UNION ALL ".join(f"SELECT '{lv}' AS Level, variable, value AS Mean FROM ox_e_long WHERE County = 'All'" for lv in metro_levels)
    view(
        name,
        f"""SELECT Level, variable, Mean, Minimum, Maximum FROM ({metro} UNION ALL SELECT 'Neighborhood', variable, value FROM ox_e_long WHERE Municipality = 'Nation_0' AND Neighborhood = 'All') m
        JOIN (SELECT Level, variable, min(value) AS Minimum, max(value) AS Maximum FROM ox_e_long GROUP BY 1, 2) e USING (Level, variable)""",
    )


pairing_view("ox_pair_a", ["Municipality", "County"])
pairing_view("ox_pair_b", ["Municipality", "County", "All"])


@query(
    "bench_level_pairing",
    """SELECT 'a' AS variant, Level, variable, round(Mean, 5) AS Mean, round(Minimum, 5) AS Minimum, round(Maximum, 5) AS Maximum FROM ox_pair_a
    UNION ALL SELECT 'b', Level, variable, round(Mean, 5), round(Minimum, 5), round(Maximum, 5) FROM ox_pair_b""",
)
def _(t: Tables):
    rows = labelled(t)
    out = None
    for variant, pairing in (("a", benchmark.PAIRING_METRO_LABELLED_COUNTY), ("b", benchmark.PAIRING_METRO_LABELLED_ALL)):
        part = benchmark.level_benchmarks(rows, _LM, CITY.name, pairing).withColumn("variant", F.lit(variant))
        out = part if out is None else out.unionByName(part)
    return out.select("variant", "Level", "variable", *[F.round(c, 5).alias(c) for c in ("Mean", "Minimum", "Maximum")])


_SCALED = f"""SELECT r.Level, r.County, r.Municipality, r.Neighborhood, r.variable, r.value, CASE WHEN r.variable IN ({_RAW}) THEN value ELSE (value - Minimum) / nullif(Maximum - Minimum, 0) END AS Scale,
    CASE WHEN value > Mean THEN (value - Mean) / nullif(Maximum - Mean, 0) WHEN value IS NULL OR Mean IS NULL THEN NULL ELSE (value - Mean) / nullif(Mean - Minimum, 0) END AS Shade
    FROM {{0}} r JOIN ox_pair_a b ON r.Level = b.Level AND r.variable = b.variable"""
view("ox_e_rates", "SELECT * FROM ox_e_long WHERE County <> 'All'")
view(
    "ox_e_enclaves",
    "SELECT 'Neighborhood' AS Level, County, Municipality, Municipality AS Neighborhood, variable, value FROM ox_e_rates WHERE Municipality IN ('Nation_1', 'Nation_2', 'Nation_3 Township')",
)
_OUT = "Level, County, Municipality, Neighborhood, variable, round(Scale, 5) AS Scale, round(Shade, 5) AS Shade"


def _level_rows(t: Tables):
    rows = labelled(t)
    bench = benchmark.level_benchmarks(rows, _LM, CITY.name, benchmark.PAIRING_METRO_LABELLED_COUNTY)
    long = rows.where("County <> 'All'").select("Level", *AREA, *_LM).unpivot(["Level", *AREA], _LM, "variable", "value")
    return long, bench


@query("bench_minmax_scale", f"SELECT {_OUT} FROM ({_SCALED.format('ox_e_rates')})")
def _(t: Tables):
    long, bench = _level_rows(t)
    out = benchmark.compare_levels(long, bench)
    return out.select("Level", *AREA, "variable", F.round("Scale", 5).alias("Scale"), F.round("Shade", 5).alias("Shade"))


@query("bench_enclave_copy", f"SELECT {_OUT} FROM ({_SCALED.format('ox_e_enclaves')})")
def _(t: Tables):
    long, bench = _level_rows(t)
    out = benchmark.compare_levels(benchmark.copy_enclaves(long, CITY.enclaves), bench)
    return out.select("Level", *AREA, "variable", F.round("Scale", 5).alias("Scale"), F.round("Shade", 5).alias("Shade"))
