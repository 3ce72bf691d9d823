"""Schemas of the input tables. Ids stay text so leading zeros survive."""

from __future__ import annotations

# Survey and dictionary
SURVEY_LONG = "GEOID string, NAME string, variable string, estimate double, geography string, state string, county string, year int"
DICTIONARY = "name string, label string, concept string, geography string"

# Crosswalks: the files' columns by position, those named skip_* are not kept
BG_ALLOCATION = (
    "GEOID string, skip_1 string, skip_2 string, skip_3 string, Municipality string, Allocation double, Neighborhood string"
)
TRACT_ALLOCATION = (
    "CountyCode string, Tract string, skip_1 string, County string, Municipality string, skip_2 string, Allocation double"
)
DEPRIVATION = "dep_index double, census_tract_fips string, skip_1 string, skip_2 string, skip_3 string, skip_4 string, skip_5 string, skip_6 string"

# Clinical
REGISTRY_CONFIG = "registry_id string, registry_name string"
REGISTRY_MEMBERSHIP = "registry_id string, record_id string, status_c int"
REGISTRY_RECORD = "record_id string, networked_id string"
PATIENT = (
    "pat_id string, birth_date date, add_line_1 string, add_line_2 string, city string, state string, zip string, county string"
)
GEOCODE_CACHE = (
    "add_line_1 string, add_line_2 string, city string, state string, zip string, X double, Y double, "
    "foster int, rmh int, pobox int, own_site int, stjoe int, unknown_address int, foreign_address int, geocode_attempted int"
)
ENCOUNTER = (
    "pat_enc_csn_id string, pat_id string, birth_date date, hosp_admsn_time timestamp_ntz, disch_icd_1 string, "
    "disch_icd_2 string, adt_pat_class string, department_id int, department_name string"
)
ADDRESS_HISTORY = (
    "pat_id string, addr_hx_line1 string, addr_hx_line2 string, city_hx string, state string, zip_hx string, county string, "
    "eff_start_date date, eff_end_date date"
)

# Places
GEOCODE_RESULT = "ID string, address string, lat double, lon double, precision string, geocode_result string"
POLYGON_EDGES = (
    "state string, county string, GEOID string, ring int, seq int, x1 double, y1 double, x2 double, y2 double"
)
PHARMACY = "pharmacy_id string, pharmacy_name string, record_state_name string"
