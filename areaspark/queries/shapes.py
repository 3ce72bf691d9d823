"""Shapes: driver tables in the form of the engine's input tables.

Areas: a supplier is a block group, five suppliers a tract, ``key % 25`` a
municipality (nation), its region the county. Survey rows are line items, patients
are customers, addresses come from orders, encounters from line items.
"""

from __future__ import annotations

from areaspark.plans import catalog
from areaspark.plans import cohorts as people_codes
from areaspark.plans.survey import City
from areaspark.queries.registry import shape

CITY = City("Nation_0", "AFRICA", "Ohio", ("Nation_1", "Nation_2", "Nation_3 Township"))
MERGES = {"Hood-3": "Hood-3-Hood-4", "Hood-4": "Hood-3-Hood-4"}
OVERRIDES = {"Nation_3 Township": "EUROPE", "Nation_7 Township": "ASIA"}
COUNTIES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE-EAST"]
COUNTY_STATES = ["AFRICA OH", "AMERICA OH", "ASIA KY", "EUROPE KY", "MIDDLE-EAST IN"]

VARIABLES = [*catalog.variable_list(), catalog.PUBLIC_ASSISTANCE, *catalog.earlier_list()]


def whole(expr: str) -> str:
    return f"CAST(floor({expr}) AS BIGINT)"


def text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def tract_no(key: str) -> str:
    return f"({whole(f'{key} / 5')} % 9000 + 1)"


def tract6(key: str) -> str:
    t = tract_no(key)
    return f"lpad({text(t)}, 4, '0') || CASE {t} % 3 WHEN 0 THEN '00' WHEN 1 THEN '10' ELSE '02' END"


def tract_text(key: str) -> str:
    t = tract_no(key)
    return f"{text(t)} || CASE {t} % 3 WHEN 0 THEN '' WHEN 1 THEN '.1' ELSE '.02' END"


def tract_geoid(key: str) -> str:
    return f"'39061' || {tract6(key)}"


def bg_geoid(key: str) -> str:
    return f"'39061' || {tract6(key)} || {text(f'{key} % 5')}"


def state_name(key: str) -> str:
    return f"CASE WHEN {key} % 5 < 2 THEN 'Ohio' WHEN {key} % 5 < 4 THEN 'Kentucky' ELSE 'Indiana' END"


def state_code(key: str) -> str:
    return f"CASE WHEN {key} % 5 < 2 THEN 'OH' WHEN {key} % 5 < 4 THEN 'KY' ELSE 'IN' END"


def place(key: str) -> str:
    """Clean municipality name of a nation key."""
    return f"'Nation_' || {text(key)} || CASE {key} % 4 WHEN 3 THEN ' Township' ELSE '' END"


def address(c: str) -> dict[str, str]:
    return {
        "add_line_1": (
            f"CASE WHEN {c} % 29 = 0 THEN NULL WHEN {c} % 31 = 0 THEN '222 E Main St' ELSE {text(f'{c} % 700')} || ' Main St' || "
            f"CASE {c} % 3 WHEN 1 THEN ' Apt 3' WHEN 2 THEN ' #4' ELSE '' END END"
        ),
        "add_line_2": f"CASE WHEN {c} % 4 = 0 THEN NULL ELSE 'Floor ' || {text(f'{c} % 2')} END",
        "city": f"'Nation_' || {text(f'{c} % 25')}",
        "state": f"CASE WHEN {c} % 37 = 0 THEN 'Texas' ELSE {state_name(c)} END",
        "zip": f"CASE WHEN {c} % 17 = 0 THEN NULL ELSE '45' || lpad({text(f'{c} % 25')}, 3, '0') || '-1234' END",
    }


def listed(cols: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in cols.items())


shape("px_vars", catalog.values_text(list(enumerate(VARIABLES)), ["idx", "variable"]))
shape("px_dict", catalog.values_text(catalog.dictionary_rows(), ["variable", "label", "concept"]))
# Written out from the rule, not from the plan: table and numbers of each category.
_CATEGORIES = {
    "Population": ("B01001", [1]), "Children": ("B01001", [3, 4, 5, 6, 27, 28, 29, 30]), "White": ("B02001", [2]), "Black": ("B02001", [3]),
    "Hispanic": ("B03002", [12]), "Households": ("B11005", [1]), "HHWithChildren": ("B11005", [2]), "Age25": ("B15003", [1]),
    "HighSchool": ("B15003", list(range(17, 26))), "Age5": ("B16004", [1]), "English": ("B16004", [3, 25, 47]),
    "LimitedEnglish": ("B16004", [n + m for n in (0, 22, 44) for m in (7, 8, 12, 13, 17, 18, 22, 23)]),
    "Families": ("B17010", [1]), "Poverty": ("B17010", [2]), "MedianHHIncome": ("B19049", [1]), "Assistance": ("B19058", [2]),
    "HousingUnits": ("B25002", [1]), "Vacant": ("B25002", [3]), "Uninsured": ("B27010", [17, 33, 50, 66]),
}
shape(
    "px_cat",
    "SELECT * FROM (VALUES " + ", ".join(f"('{t}_{n:03d}', '{c}')" for c, (t, ns) in _CATEGORIES.items() for n in ns) + ") AS t(variable, category)",
)

# Survey rows. Totals are scaled up; medians and vacancies have missing estimates.
ESTIMATE = (
    "CASE WHEN v.variable IN ('B19049_001', 'B25002_003') AND l_orderkey % 97 = 0 THEN NULL "
    "WHEN v.variable = 'B19049_001' THEN l_extendedprice "
    "WHEN substring(v.variable, 7, 4) = '_001' THEN l_quantity * 40 ELSE l_quantity END"
)
ROWS = f"FROM lineitem l JOIN px_vars v ON l.l_partkey % {len(VARIABLES)} = v.idx"
shape("px_bg_rows", f"SELECT {bg_geoid('l_suppkey')} AS GEOID, v.variable, {ESTIMATE} AS estimate {ROWS}")
# one row per area and variable where a median must be unique
shape("px_bg", "SELECT GEOID, variable, CASE WHEN variable = 'B19049_001' THEN max(estimate) ELSE sum(estimate) END AS estimate FROM px_bg_rows GROUP BY GEOID, variable")
shape("px_tract", f"SELECT {tract_geoid('l_suppkey')} AS GEOID, v.variable, {ESTIMATE} AS estimate {ROWS}")
PART = f"CASE WHEN l_suppkey % 25 IN (3, 7) AND {whole('l_suppkey / 25')} % 2 = 1 THEN 1 ELSE 0 END"


def _muni_name(part: int, county: str, where: str) -> str:
    return f"""SELECT n_nationkey AS nk, {part} AS part, '39' || lpad({text('n_nationkey')}, 4, '0') || '{part}' AS GEOID,
      CASE WHEN n_nationkey = 24 THEN 'The Village of ' ELSE '' END || n_name ||
      CASE n_nationkey % 4 WHEN 0 THEN ' city' WHEN 1 THEN ' CCD' WHEN 2 THEN ' village' ELSE ' township' END || ', ' ||
      {county} || ' County, ' || {state_name('n_nationkey')} AS NAME
      FROM nation JOIN region ON n_regionkey = r_regionkey {where}"""


shape(
    "px_muni_names",
    _muni_name(0, "replace(r_name, ' ', '-')", "")
    + " UNION ALL "
    + _muni_name(1, "'AMERICA'", "WHERE n_nationkey IN (3, 7)"),
)
shape(
    "px_muni_rows",
    f"""SELECT m.GEOID, m.NAME, s.variable, s.estimate FROM (
      SELECT l_suppkey % 25 AS nk, {PART} AS part, v.variable, {ESTIMATE} AS estimate {ROWS}
    ) s JOIN px_muni_names m ON s.nk = m.nk AND s.part = m.part""",
)
shape(
    "px_muni",
    "SELECT GEOID, NAME, variable, CASE WHEN variable = 'B19049_001' THEN max(estimate) ELSE sum(estimate) END AS estimate FROM px_muni_rows GROUP BY GEOID, NAME, variable",
)
shape(
    "px_county",
    f"""SELECT replace(r_name, ' ', '-') || ' County, ' || {state_name('r_regionkey')} AS NAME, s.variable, s.estimate FROM (
      SELECT l_suppkey % 5 AS rk, v.variable,
      CASE WHEN v.variable = 'B25002_003' THEN l_quantity ELSE {ESTIMATE} END AS estimate {ROWS}
    ) s JOIN region ON s.rk = r_regionkey""",
)
shape(
    "px_survey_long",
    f"""SELECT 'block group' AS geography, {state_code('l_suppkey')} AS state, 'C' || {text('l_suppkey % 7')} AS county,
      2022 - CAST(l_orderkey % 2 AS INT) AS year, {bg_geoid('l_suppkey')} AS GEOID, 'area ' || {text('l_suppkey')} AS NAME, v.variable, {ESTIMATE} AS estimate {ROWS}
      UNION ALL SELECT 'tract', {state_code('l_suppkey')}, 'C' || {text('l_suppkey % 7')},
      2022 - CAST(l_orderkey % 2 AS INT), {tract_geoid('l_suppkey')}, 'area ' || {text('l_suppkey')}, v.variable, {ESTIMATE} {ROWS}""",
)

# Crosswalks and index
BG = f"SELECT {bg_geoid('s_suppkey')} AS GEOID, min(s_nationkey) AS h, min(s_suppkey) AS k FROM supplier GROUP BY {bg_geoid('s_suppkey')}"


def _alloc(i: int, share: float) -> str:
    return (
        f"SELECT GEOID, CASE WHEN k % 10 < 8 THEN 'Nation_0' ELSE 'Nation_1' END AS Municipality, "
        f"CASE WHEN k % 10 < 8 THEN 'Hood-' || {text(f'(h + {i}) % 25')} ELSE 'Nation_1' END AS Neighborhood, "
        f"CAST({share} AS DOUBLE) AS Allocation FROM ({BG}) b"
    )


shape("px_alloc", f"{_alloc(0, 0.6173)} UNION ALL {_alloc(1, 0.3827)}")
shape(
    "px_index",
    f"""SELECT (max(s_acctbal) + 1000) / 11000 AS dep_index, {tract_geoid('s_suppkey')} AS census_tract_fips
    FROM supplier GROUP BY {tract_geoid('s_suppkey')} HAVING max(s_acctbal) >= 7000""",
)


def _talloc(i: int, share: float) -> str:
    return (
        f"SELECT '39061' AS CountyCode, b.Tract, replace(r_name, ' ', '-') || ' ' || {state_code('n_nationkey')} AS County, "
        f"n_name || CASE n_nationkey % 4 WHEN 0 THEN ' city' WHEN 1 THEN ' CCD' WHEN 2 THEN ' village, part' ELSE ' township' END AS Municipality, "
        f"CAST({share} AS DOUBLE) AS Allocation FROM (SELECT {tract_text('s_suppkey')} AS Tract, min(s_nationkey) AS h FROM supplier "
        f"GROUP BY {tract_text('s_suppkey')}) b JOIN nation ON n_nationkey = (b.h + {i}) % 25 JOIN region ON n_regionkey = r_regionkey"
    )


shape("px_talloc_raw", f"{_talloc(0, 0.7)} UNION ALL {_talloc(1, 0.3)}")

# Clinical
BIRTH = "CAST('2024-01-01' AS DATE) - CAST((c_custkey * 37) % 9000 AS INT)"
COUNTY = "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE upper(replace(r_name, ' ', '-')) END"
shape(
    "px_patient",
    f"""SELECT 'P' || {text('c_custkey')} AS pat_id, {BIRTH} AS birth_date, {listed(address('c_custkey'))}, {COUNTY} AS county
    FROM customer JOIN region ON c_custkey % 5 = r_regionkey""",
)
_PARTS = ["add_line_1", "add_line_2", "city", "state", "zip"]
shape(
    "px_cache",
    f"""SELECT {', '.join(_PARTS)},
      CASE WHEN k % 5 = 4 THEN NULL ELSE ((k * 7919) % 1000) / 200 END AS X,
      CASE WHEN k % 5 = 4 THEN NULL ELSE ((k * 104729) % 1000) / 200 END AS Y,
      CASE WHEN k % 47 = 0 THEN NULL WHEN k % 43 = 0 THEN 1 ELSE 0 END AS foster, 0 AS rmh,
      CASE WHEN k % 41 = 0 THEN 1 ELSE 0 END AS pobox, 0 AS own_site, 0 AS stjoe, 0 AS unknown_address, 0 AS foreign_address, 1 AS geocode_attempted
    FROM (SELECT {listed(address('c_custkey'))}, min(c_custkey) AS k, min(c_mktsegment) AS segment FROM customer
      GROUP BY {', '.join(address('c_custkey').values())}) a WHERE segment <> 'BUILDING'""",
)
shape(
    "px_history",
    f"""SELECT 'P' || {text('o_custkey')} AS pat_id, {listed(address('o_orderkey % 150'))},
      CAST(o_orderdate AS DATE) AS eff_start_date,
      CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INT) END AS eff_end_date
    FROM orders""",
)
ENC_ID = f"'E' || {text('l_orderkey')} || '-' || {text('l_linenumber')}"
# every code of a listed condition, its prefixes, codes beside them, and none
_CODES = [*people_codes.ASTHMA_CODES, *people_codes.DIABETES_CODES, "F32.1", "R45.1", "F", "R45", None, "Z00.1", "J45.9", "E11", "R44", "E10.1", "R73.0", "J45.2"]
_EXCLUDING = [
    *people_codes.EXCEPTION_CODES, *[f"{p}1" for p in people_codes.EXCEPTION_PREFIXES], *people_codes.EXCEPTION_PREFIXES,
    "D57.1", "D57.3", "D57.30", "D57", "J96.0", "Z99.12", "Z99", "E84.1", "Q23.1", None,
]


def _nth(key: str, values: list, rest: str) -> str:
    """The value at a key's number; ``rest`` beyond the last."""
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values)) + f" ELSE {rest} END"


DX = _nth(f"l_partkey % {len(_CODES) + 10}", _CODES, "'Z00.1'")
DEPARTMENT = "CASE WHEN (l_orderkey + l_linenumber) % 20 = 0 THEN 20026290 ELSE 10401080 + (l_orderkey + l_linenumber) % 20 END"
shape(
    "px_encounter",
    f"""SELECT {ENC_ID} AS pat_enc_csn_id, 'P' || {text('o_custkey')} AS pat_id, l_shipdate AS hosp_admsn_time,
      {DX} AS disch_icd_1, CAST({DEPARTMENT} AS INT) AS department_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
shape("px_account_dx", "SELECT l_orderkey AS hsp_account_id, l_partkey AS dx_id FROM lineitem")
shape(
    "px_dx_code",
    f"SELECT p_partkey AS dx_id, {_nth('p_partkey % 200', _EXCLUDING, 'p_brand')} AS code FROM part",
)
shape("px_account_encounter", f"SELECT l_orderkey AS hsp_account_id, {ENC_ID} AS pat_enc_csn_id FROM lineitem")
shape("px_config", "SELECT DISTINCT event_type AS registry_id, 'pediatric ' || event_type || ' registry' AS registry_name FROM events")
RECORD = f"'R' || {text('user_id')} || event_type"
shape(
    "px_membership",
    f"SELECT event_type AS registry_id, {RECORD} AS record_id, CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END AS status_c FROM events",
)
shape("px_record", f"SELECT DISTINCT {RECORD} AS record_id, 'P' || {text('user_id')} AS networked_id FROM events")

# Points and polygons
shape(
    "px_points",
    f"SELECT c_custkey AS ID, ((c_custkey * 7919) % 1000) / 200 AS X, ((c_custkey * 104729) % 1000) / 200 AS Y FROM customer",
)


def _box(area: str, x: str, y: str, step: str, source: str) -> str:
    lo_x, hi_x, lo_y, hi_y = f"{x} / {step}", f"({x} + 1) / {step}", f"{y} / {step}", f"({y} + 1) / {step}"
    corners = [(lo_x, lo_y), (hi_x, lo_y), (hi_x, hi_y), (lo_x, hi_y)]
    sides = []
    for i in range(4):
        (ax, ay), (bx, by) = corners[i], corners[(i + 1) % 4]
        sides.append(
            f"SELECT {area}, CAST({ax} AS DOUBLE) AS x1, CAST({ay} AS DOUBLE) AS y1, CAST({bx} AS DOUBLE) AS x2, CAST({by} AS DOUBLE) AS y2 FROM {source}"
        )
    return " UNION ALL ".join(sides)


_OVERLAP = [
    (1.5, 1.5, 3.5, 1.5), (3.5, 1.5, 3.5, 3.5), (3.5, 3.5, 2.5, 2.0), (2.5, 2.0, 1.5, 3.5), (1.5, 3.5, 1.5, 1.5),
]
shape(
    "px_edges_muni",
    _box(
        f"replace(r_name, ' ', '-') AS County, {place('n_nationkey')} AS Municipality",
        "n_nationkey % 5",
        whole("n_nationkey / 5"),
        "1",
        "nation JOIN region ON n_regionkey = r_regionkey",
    )
    + " UNION ALL SELECT 'EXTRA', 'Overlap', CAST(x1 AS DOUBLE), CAST(y1 AS DOUBLE), CAST(x2 AS DOUBLE), CAST(y2 AS DOUBLE) FROM ("
    + catalog.values_text(_OVERLAP, ["x1", "y1", "x2", "y2"])
    + ") o",
)
# a wall of bricks: every second row is half a brick further, so neighbours have different corners
shape(
    "px_edges_brick",
    _box(
        "CASE WHEN n_nationkey % 5 < 3 THEN 'Bricks-West' ELSE 'Bricks-East' END AS County",
        f"(n_nationkey % 5 + 0.5 * ({whole('n_nationkey / 5')} % 2))",
        whole("n_nationkey / 5"),
        "1",
        "nation",
    ),
)
# block groups of the city's county: four in each of its 25 boxes; one of another county over the first ones
shape("px_quarters", "SELECT n_nationkey AS n, q FROM nation JOIN (SELECT r_regionkey AS q FROM region WHERE r_regionkey < 4) r ON TRUE")
shape(
    "px_edges_bg",
    _box(
        f"'AFRICA' AS County, {bg_geoid('(n * 4 + q + 1)')} AS GEOID", "(n % 5 * 2 + q % 2)", f"({whole('n / 5')} * 2 + {whole('q / 2')})", "10", "px_quarters"
    )
    + " UNION ALL "
    + _box(f"'ASIA' AS County, {bg_geoid('1')} AS GEOID", "0", "0", "2", "region WHERE r_regionkey = 0"),
)
# most block groups lie in one neighbourhood, every fifth in two
shape("px_bg_hood", "SELECT GEOID, Municipality, Neighborhood FROM px_alloc WHERE Allocation > 0.5 OR substring(GEOID, 12, 1) = '0'")
shape(
    "px_edges_places",
    f"""SELECT CASE WHEN County IN ('AFRICA', 'AMERICA') THEN 'Ohio' WHEN County IN ('ASIA', 'EUROPE') THEN 'Kentucky' ELSE 'Indiana' END AS State, County, Municipality, x1, y1, x2, y2 FROM px_edges_muni""",
)
shape(
    "px_network",
    f"""SELECT 'P' || {text('o_custkey')} AS pat_id, {listed(address('o_orderkey % 3000'))}, CAST(o_orderdate AS TIMESTAMP) AS hosp_admsn_time,
      CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '061' WHEN 2 THEN '017' WHEN 3 THEN '015' WHEN 4 THEN '037' WHEN 5 THEN '029' ELSE '999' END AS countyfp,
      CASE WHEN o_orderkey % 4 = 3 THEN 1 ELSE 0 END AS asthma_admission FROM orders""",
)
_HOUSE = "(coalesce(TRY_CAST(substring(Address, 1, greatest(instr(Address, ' ') - 1, 0)) AS BIGINT), 7) * 37 + coalesce(TRY_CAST(substring(Zip, 3, 3) AS BIGINT), 5) * 11)"
# what a geocoder says of an address; column text of a cleaned address table
GEOCODED = {
    "lon": f"({_HOUSE} * 7919 % 1000) / 200", "lat": f"({_HOUSE} * 104729 % 1000) / 200",
    "precision": f"CASE WHEN {_HOUSE} % 13 = 0 THEN 'city' ELSE 'range' END", "geocode_result": f"CASE WHEN {_HOUSE} % 17 = 0 THEN 'imprecise_geocode' ELSE 'geocoded' END",
}
shape(
    "px_e_areas",
    f"""SELECT DISTINCT State, County, Municipality, 'All' AS Neighborhood FROM px_edges_places UNION ALL SELECT DISTINCT State, County, 'All', 'All' FROM px_edges_places
    UNION ALL SELECT 'All', 'All', 'All', 'All' FROM region WHERE r_regionkey = 0
    UNION ALL SELECT DISTINCT 'Ohio', 'AFRICA', 'Nation_0', 'Hood-' || {text('n_nationkey')} FROM nation""",
)
shape("px_e_children", "SELECT State, County, Municipality, Neighborhood, CAST(length(Municipality) * 100 + length(Neighborhood) % 6 - 5 AS DOUBLE) AS Children FROM px_e_areas")
HOOD = "CASE WHEN n_nationkey IN (3, 4) THEN 'Hood-3-Hood-4' ELSE 'Hood-' || CAST(n_nationkey AS STRING) END"
shape("px_edges_hood", _box(f"{HOOD} AS Neighborhood", "n_nationkey % 5", whole("n_nationkey / 5"), "5", "nation"))
TRACT_BOX = f"'39061' || {tract6('n_nationkey * 5')}"
shape("px_edges_tract", _box(f"{TRACT_BOX} AS GEOID", "n_nationkey % 5", whole("n_nationkey / 5"), "1", "nation"))

# Text lists
shape(
    "px_school_lines",
    f"""SELECT CASE WHEN p_partkey % 97 = 0 THEN 'The Promise Center Winton Ridge Lane, Cincinnati, OH 45232'
      WHEN p_partkey % 89 = 0 THEN 'Aiken New Tech School ' || {text('p_partkey')} || ' Belmont Ave, Cincinnati, OH 45224'
      WHEN p_partkey % 83 = 0 THEN 'Gamble Montessori Elementary School ' || {text('p_partkey')} || ' Dover St, Cincinnati, OH 45238'
      WHEN p_partkey % 79 = 0 THEN 'Mt. Washington School ' || {text('p_partkey')} || ' Mears Ave, Cincinnati, OH'
      WHEN p_partkey % 73 = 0 THEN 'Virtual High School ' || {text('p_partkey')} || ' Clifton Ave, Cincinnati, OH 45219'
      ELSE p_name || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' School' WHEN 2 THEN ' Primary School' ELSE ' Junior High School' END
        || ' ' || {text('100 + p_partkey % 900')} || ' ' || p_type || ' Ave, Cincinnati, OH ' || {text('45200 + p_partkey % 50')} || ' extra' END AS value
    FROM part""",
)
shape(
    "px_pharmacy",
    f"""SELECT 'H' || {text('p_partkey')} AS pharmacy_id, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 'Active' ELSE 'Hidden' END AS record_state_name,
      CASE p_partkey % 12
      WHEN 0 THEN 'RX ' || p_brand || '-LEBANON, OH-' || {text('p_partkey')} || ' MAIN ST'
      WHEN 1 THEN 'RX ' || p_brand || '--FLORENCE, KY-' || {text('p_partkey')} || ' MALL RD STE 4'
      WHEN 2 THEN 'RX ' || p_brand || '-STORE 4-' || 'MASON, OH-' || {text('p_partkey')} || ' TYLERSVILLE AT CEDAR'
      WHEN 3 THEN 'RX ' || p_brand || '-DEPT-BLOCK-AURORA, IN-' || {text('p_partkey')} || ' GREEN BLVD'
      WHEN 4 THEN 'RX ' || p_brand || '-DEPT-BLOCK-CORNER-HARRISON, OH'
      WHEN 5 THEN 'RX ' || p_brand || '-DAYTON, TX-' || {text('p_partkey')} || ' ELM'
      WHEN 6 THEN 'RX ' || p_brand
      WHEN 7 THEN 'RX ' || p_brand || '-7-MILFORD, OH-PLAZA-' || {text('p_partkey')} || ' RIVER RD SUITE 9-NON E-RX'
      WHEN 8 THEN 'RX ' || p_brand || '-8-MILFORD, OH-PLAZA-EAST WING-' || {text('p_partkey')} || ' MAPLE, X'
      WHEN 9 THEN 'RX ' || p_brand || '-9-BATAVIA, EAST, OH-' || {text('p_partkey')} || ' OAK'
      WHEN 10 THEN 'RX ' || p_brand || '-10 HIGH ST AT LOW--BETHEL, OH'
      ELSE 'RX ' || p_brand || '-11-LOVELAND, OH--' || {text('p_partkey')} || ' LOVE ST' END AS pharmacy_name
    FROM part""",
)
shape(
    "px_geocoded",
    f"""SELECT {text('c_custkey')} AS ID, c_name AS address, ((c_custkey * 104729) % 1000) / 200 AS lat, ((c_custkey * 7919) % 1000) / 200 AS lon,
      CASE WHEN c_custkey % 4 = 0 THEN 'city' ELSE 'range' END AS precision,
      CASE WHEN c_custkey % 9 = 0 THEN 'imprecise_geocode' ELSE 'geocoded' END AS geocode_result FROM customer""",
)
