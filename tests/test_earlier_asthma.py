"""The earlier asthma chain on hand-made rows, and points searched inside a parent only."""

import datetime as dt

from compare import rows
from pyspark.sql import functions as F

from areaspark.operators import spatial
from areaspark.plans import cohorts, earlier_asthma
from areaspark.plans.survey import City

CITY = City("Town", "Hamilton", "Ohio")
BOX = "x1 double, y1 double, x2 double, y2 double"


def box(names, x, y, w, h):
    corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    return [(*names, *map(float, a), *map(float, b)) for a, b in zip(corners, [*corners[1:], corners[0]])]


def test_children_of_other_parents_are_not_met(spark):
    """Two counties have a child over the same place; a point meets that of its own county only, null parents included."""
    edges = box(("A", "a1"), 0, 0, 2, 2) + box(("B", "b1"), 0, 0, 2, 2) + box((None, "n1"), 0, 0, 1, 1) + box(("A", "a2"), 2, 0, 40, 40)
    df = spark.createDataFrame(edges, f"parent string, child string, {BOX}")
    points = spark.createDataFrame([(1, 0.5, 0.5, "A"), (2, 0.5, 0.5, "B"), (3, 0.5, 0.5, None), (4, 1.5, 1.5, None), (5, 2.0, 1.0, "A"), (6, 30.0, 9.0, "B")], "id int, X double, Y double, parent string")
    got = rows(spatial.points_in_polygons(points, df, ["child"], within=["parent"], cell=0.1).select("id", "child"))
    assert got == [(1, "a1"), (2, "b1"), (3, "n1"), (5, "a1"), (5, "a2")]
    left = rows(spatial.points_in_polygons(points, df, ["child"], within=["parent"], cell=0.1, how="left").select("id", "child"))
    assert left == sorted([*got, (4, None), (6, None)], key=str)


def test_registry_and_admissions_of_the_region(spark):
    config = spark.createDataFrame([("r1", "pediatric asthma registry"), ("r2", "pediatric diabetes registry")], "registry_id string, registry_name string")
    membership = spark.createDataFrame([("r1", f"d{k}", 2 if k == 7 else 1) for k in range(9)] + [("r2", "d8", 1), ("r1", "d0", 1)], "registry_id string, record_id string, status_c int")
    record = spark.createDataFrame([(f"d{k}", f"p{k}") for k in range(9)], "record_id string, networked_id string")
    young, old = dt.date(2015, 1, 1), dt.date(2004, 6, 1)
    people = [
        ("p0", young, "1 A St", "Ohio", "HAMILTON"), ("p1", old, "1 A St", "Ohio", "HAMILTON"), ("p2", young, "222 E Ave", "Ohio", "HAMILTON"), ("p3", young, "2 A St", "Ohio", "BOONE"),
        ("p4", young, "3 A St", "Kentucky", "BOONE"), ("p5", young, "4 A St", "Indiana", None), ("p6", young, "5 A St", "Texas", None), ("p7", young, "6 A St", "Ohio", "HAMILTON"), ("p8", young, None, "Ohio", "HAMILTON"),
    ]
    patient = spark.createDataFrame([(i, b, line, None, "town", s, "45202-1", c) for i, b, line, s, c in people], "pat_id string, birth_date date, add_line_1 string, add_line_2 string, city string, state string, zip string, county string")
    got = earlier_asthma.registry_rows(config, membership, record, patient, F.col("registry_name").like("%asthma%"), "2023-06-01")
    assert rows(got.select("add_line_1", "Registry", "Admission")) == [("1 A St", 1, 0), ("3 A St", 1, 0), ("4 A St", 1, 0)]
    at = lambda y: dt.datetime(y, 12, 31, 23, 0)
    calls = [("Ohio", "061", at(2022), 1), ("Ohio", "015", at(2022), 1), ("Kentucky", "015", at(2022), 1), ("Ohio", None, at(2022), 1), ("Texas", None, at(2022), 1), ("Ohio", "061", at(2023), 1), ("Ohio", "061", at(2022), 0)]
    encounters = spark.createDataFrame([(f"{k} B St", None, "town", s, "45202", t, c, a) for k, (s, c, t, a) in enumerate(calls)], "add_line_1 string, add_line_2 string, city string, state string, zip string, hosp_admsn_time timestamp_ntz, countyfp string, asthma_admission int")
    assert rows(earlier_asthma.admission_rows(encounters, 2022).select("add_line_1", "Registry", "Admission")) == [("0 B St", 0, 1), ("2 B St", 0, 1), ("3 B St", 0, 1)]


def test_addresses_go_through_three_branches_and_come_back(spark):
    munis = box(("Ohio", "Hamilton", "Town"), 0, 0, 2, 2) + box(("Ohio", "Hamilton", "Vale"), 2, 0, 2, 2)
    muni_edges = spark.createDataFrame(munis, f"State string, County string, Municipality string, {BOX}")
    tracts = spark.createDataFrame(box(("t1",), 0, 0, 2, 2) + box(("t2",), 2, 0, 2, 2), f"GEOID string, {BOX}")
    groups = box(("Hamilton", "g1"), 0, 0, 1, 2) + box(("Hamilton", "g2"), 1, 0, 1, 2) + box(("Boone", "g3"), 0, 0, 2, 2)
    group_edges = spark.createDataFrame(groups, f"County string, GEOID string, {BOX}")
    crosswalk = spark.createDataFrame([("t1", "Ohio", "Hamilton", "Town"), ("t2", "Ohio", "Hamilton", "Vale")], "GEOID string, State string, County string, Municipality string")
    shares = spark.createDataFrame([("g1", "Town", "East"), ("g2", "Town", "East"), ("g2", "Town", "West"), ("g3", "Town", "Far"), ("g1", "Vale", "No")], "GEOID string, Municipality string, Neighborhood string")
    lines = [("1 Elm St Apt 3", 1, 0), ("1 ELM ST ", 0, 1), ("1 elm st #9", 1, 0), ("2 Elm St", 1, 0), ("3 Elm St", 0, 1), ("4 Elm St", 1, 0), ("9 Elm St", 1, 0)]
    raw = spark.createDataFrame([(line, None, "town", "Ohio", None, r, a) for line, r, a in lines], "add_line_1 string, add_line_2 string, city string, state string, zip string, Registry int, Admission int")
    patients = earlier_asthma.with_address(raw)
    assert patients.select("ID").distinct().count() == 5
    spots = {"1 ELM ST": (0.5, 0.5), "2 ELM ST": (1.5, 0.5), "3 ELM ST": (3.0, 1.0), "4 ELM ST": (2.0, 1.0)}
    named = {r["ID"]: r["Address"].strip() for r in patients.select("ID", "Address").distinct().collect()}
    points = spark.createDataFrame([(i, *spots[a]) for i, a in named.items() if a in spots], "ID string, X double, Y double")
    placed = earlier_asthma.places(points, muni_edges, tracts, group_edges, crosswalk, shares, CITY)
    # in one neighbourhood; in two (dropped); outside the city; on the border, in both tracts; not located (dropped)
    assert sorted(((named[r["ID"]], r["Municipality"], r["Neighborhood"]) for r in placed.collect()), key=str) == [
        ("1 ELM ST", "Town", "East"), ("3 ELM ST", "Vale", None), ("4 ELM ST", "Town", None), ("4 ELM ST", "Vale", None),
    ]
    back = earlier_asthma.back_to_patients(patients, placed)
    census = spark.createDataFrame([("Ohio", "Hamilton", "Town", "East", 10.0), ("Ohio", "Hamilton", "Vale", "All", 0.0), ("All", "All", "All", "All", 100.0), ("Ohio", "Hamilton", "Town", "West", 5.0)], "State string, County string, Municipality string, Neighborhood string, Children double")
    out = cohorts.earlier_area_totals(back, census).select("Municipality", "Neighborhood", "AsthmaRegistry", "AsthmaAdmissions", "AsthmaRegistryRate")
    assert rows(out) == [("All", "All", 4, 2, 0.04), ("Town", "East", 2, 1, 0.2), ("Town", "West", 0, 0, 0.0), ("Vale", "All", 1, 1, 0.0)]
