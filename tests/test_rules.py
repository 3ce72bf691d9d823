"""One small hand-computed table per rule."""

import datetime as dt

import pytest
from compare import rows
from pyspark.sql import functions as F

from areaspark import session
from areaspark.functions import dates, missing, numbers, text
from areaspark.operators import address, benchmark, joins, names, ordering, placelists, reshape, windows
from areaspark.plans import catalog, cohorts, deprivation, survey
from areaspark.plans.survey import City
from areaspark.sources import readers, sinks


def test_null_keys_match_and_appear_once(spark):
    a = spark.createDataFrame([("x", None, 1), ("x", "n", 2)], "m string, h string, a int")
    b = spark.createDataFrame([("x", None, 10), ("y", None, 20)], "m string, h string, b int")
    assert rows(joins.null_safe_join(a, b)) == [("x", None, 1, 10)]
    full = joins.null_safe_join(a, b, how="full")
    assert full.columns == ["m", "h", "a", "b"]
    assert rows(full) == [("x", "n", 2, None), ("x", None, 1, 10), ("y", None, None, 20)]
    assert rows(joins.null_safe_join(a, b, how="right")) == [("x", None, 1, 10), ("y", None, None, 20)]


def test_strict_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0)], "k string, v double")
    out = df.groupBy("k").agg(
        missing.sum_strict("v"), missing.min_strict("v"), missing.max_strict("v"), missing.mean_strict("v"), missing.stddev_strict("v")
    )
    got = rows(out)
    assert got[0] == ("a", None, None, None, None, None)
    assert got[1][:5] == ("b", 6.0, 2.0, 4.0, 3.0) and got[1][5] == pytest.approx(2**0.5)


def test_strict_conditional_sum(spark):
    df = spark.createDataFrame([("a", "p", 1.0), ("a", "q", None), ("a", "p", 2.0), ("b", "q", 5.0)], "k string, c string, v double")
    out = reshape.widen_sums(df, ["k"], {"p": F.col("c") == "p", "q": F.col("c") == "q"}, "v")
    assert rows(out) == [("a", 3.0, None), ("b", None, 5.0)]


def test_ifelse_keeps_unknown_and_case_when_does_not(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "v int")
    out = df.select("v", missing.if_else(F.col("v") > 2, F.lit("a"), F.lit("b")), F.when(F.col("v") > 2, "a").otherwise("b"))
    assert rows(out) == [(1, "b", "b"), (5, "a", "a"), (None, None, "b")]


def test_not_in_keeps_missing(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    assert rows(df.where(missing.not_in("v", ["a"]))) == [("b",), (None,)]
    assert rows(df.where(missing.is_in("v", ["a"]))) == [("a",)]


def test_division_by_zero_is_missing(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (1.0, 2.0)], "n double, d double")
    assert [r[0] for r in df.select(missing.ratio("n", "d")).collect()] == [None, None, 0.5]
    odd = spark.createDataFrame([(float("inf"),), (float("nan"),), (1.0,)], "v double")
    assert [r[0] for r in odd.select(missing.finite_or_null("v")).collect()] == [None, None, 1.0]
    assert odd.where(missing.is_missing("v")).count() == 1


def test_rounding_half_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-0.5,)], "v double")
    assert [r[0] for r in df.select(numbers.half_even("v")).collect()] == [2.0, 4.0, 0.0]


def test_paste_prints_missing(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert df.select(text.paste("x", "y", sep=", ")).first()[0] == "a, NA"


@pytest.mark.parametrize(
    "raw, want",
    [
        ("north avondale-paddock hills", "North Avondale-Paddock Hills"),
        ("O'BRYONVILLE", "O'bryonville"),
        ("NATION_7 of/the WEST", "Nation_7 Of/The West"),
        ("st. bernard", "St. Bernard"),
        ("", ""),
    ],
)
def test_title_case(spark, raw, want):
    assert spark.range(1).select(text.title_case(F.lit(raw))).first()[0] == want


def test_remove_first(spark):
    one = spark.range(1)
    assert one.select(text.remove_first_text(F.lit("a.b.c"), ".")).first()[0] == "ab.c"
    assert one.select(text.remove_first(F.lit("x12y34"), "[0-9]+")).first()[0] == "xy34"
    df = spark.createDataFrame([("aXbXc", "X"), ("abc", "z"), ("a.c abc", "a.c")], "s string, n string")
    assert [r[0] for r in df.select(text.remove_first_of("s", "n")).collect()] == ["abXc", "abc", " abc"]
    assert [r[0] for r in df.select(text.remove_first_of("s", "n", literal=False)).collect()] == ["abXc", "abc", " abc"]


@pytest.mark.parametrize("tract, want", [("12.1", "001210"), ("12.01", "001201"), ("203", "020300"), ("1012.5", "101250"), ("7", "000700")])
def test_tract_id(spark, tract, want):
    assert spark.range(1).select(text.tract_id(F.lit("39061"), F.lit(tract))).first()[0] == "39061" + want


@pytest.mark.parametrize("raw, want", [("12 Main", 12.0), ("no", None), ("A1,234.5x", 1234.5), ("-3", -3.0)])
def test_parse_number(spark, raw, want):
    assert spark.range(1).select(numbers.parse_number(F.lit(raw))).first()[0] == want


def test_exact_split_is_an_assertion(spark):
    df = spark.createDataFrame([("A city, X County, Ohio",), ("broken",)], "NAME string")
    with pytest.raises(Exception, match="does not have 3 parts"):
        names.split_area_name(df).collect()
    good, bad = names.split_quarantine(df, "NAME", ["m", "c", "s"], ", ")
    assert good.count() == 1 and rows(bad) == [("broken",)]


def test_label_levels(spark):
    df = spark.createDataFrame([("v", "Estimate!!Total:!!Male:!!20 years"), ("w", None)], "variable string, label string")
    got = rows(catalog.with_levels(df))
    assert got == [("v", "Estimate!!Total", "Male", "20 years", None, None), ("w", None, None, None, None, None)]
    six = spark.createDataFrame([("v", ":!!".join("abcdef"))], "variable string, label string")
    with pytest.raises(Exception, match="more than five levels"):
        catalog.with_levels(six).collect()


def test_catalog_has_127_variables():
    ids = catalog.variable_list()
    assert len(ids) == len(set(ids)) == 127
    assert "B16004_067" in ids and "B01001_049" in ids and "B11012_017" in ids
    assert len(catalog.category_rows()) == 62


def test_pivot_rejects_duplicate_cells(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2)], "k int, n string, v int")
    with pytest.raises(Exception, match="more than one row"):
        reshape.widen(df, ["k"], "n", "v", ["a", "b"]).collect()


def test_rollup_keeps_stored_nulls(spark):
    df = spark.createDataFrame([("s", None, 1), ("s", "c", 2)], "st string, co string, v int")
    assert rows(reshape.rollup_labelled(df, ["st", "co"], ["v"])) == [("All", "All", 3), ("s", "All", 3), ("s", "c", 2), ("s", None, 1)]


def test_sort_missing_last(spark):
    df = spark.createDataFrame([(None,), (2,), (1,)], "v int")
    assert [r[0] for r in ordering.sort_rows(df, "v").collect()] == [1, 2, None]
    assert [r[0] for r in ordering.sort_rows(df, "v", descending=["v"]).collect()] == [2, 1, None]


def test_single_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, None)], "id int, v string")
    assert rows(windows.only_single_rows(df, ["id"])) == [(1, "a"), (3, None)]


def test_dense_ids_match_a_global_order(spark):
    data = [(f"n{(i * 37) % 101:03d}" if i % 10 else None, i) for i in range(500)]
    df = spark.createDataFrame(data, "n string, i int")
    got = {r["i"]: r["id"] for r in windows.dense_ids(df, {"n": F.col("n"), "i": F.col("i")}, "id", cuts=7).collect()}
    order = sorted(data, key=lambda r: (r[0] is None, r[0] or "", r[1]))
    assert got == {i: at for at, (_, i) in enumerate(order, 1)}


def test_surrogate_id_tells_missing_parts_apart(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", None)], "x string, y string")
    ids = [r[0] for r in df.select(windows.surrogate_id("x", "y")).collect()]
    assert ids[0] == ids[2] != ids[1]


def test_attach_scalar_rejects_more_rows(spark):
    df = spark.range(3)
    assert rows(joins.attach_scalar(df, df.agg(F.max("id").alias("top")))) == [(0, 2), (1, 2), (2, 2)]
    with pytest.raises(Exception):
        joins.attach_scalar(df, df.select(F.col("id").alias("x"))).collect()


def test_valid_time_is_half_open(spark):
    d = dt.date
    history = spark.createDataFrame(
        [("p", "old", d(2022, 1, 1), d(2022, 6, 1)), ("p", "new", d(2022, 6, 1), None), ("q", "past", d(2020, 1, 1), d(2021, 1, 1))],
        "pat string, line string, s date, e date",
    )
    events = spark.createDataFrame(
        [("p", dt.datetime(2022, 5, 31, 23)), ("p", dt.datetime(2022, 6, 1)), ("p", dt.datetime(2023, 12, 31, 23)), ("q", dt.datetime(2022, 1, 1)), ("p", dt.datetime(2024, 1, 1))],
        "pat string, at timestamp_ntz",
    )
    out = joins.join_valid_time(events, history, ["pat"], "at", "s", "e", "2022-01-01", "2023-12-31")
    assert [(r["line"], r["at"].year) for r in out.orderBy("at").collect()] == [("old", 2022), ("new", 2022), ("new", 2023)]


def test_age_rule(spark):
    df = spark.createDataFrame([(dt.date(2006, 6, 30),)], "b date")
    got = df.select(dates.age_years("b", "2024-06-30"), dates.age_years("b", "2024-06-30", 385.25)).first()
    assert got[0] == pytest.approx(6575 / 365.25) and got[1] == pytest.approx(6575 / 385.25)


def _admissions(spark):
    return spark.createDataFrame(
        [
            ("p1", "e1", 2022, "C", "M", "N", 1, 0, None),
            ("p1", "e2", 2022, "C", "M", "N", 1, 0, 1),
            ("p2", "e3", 2022, "C", "M", "N", 0, 1, 0),
            ("p2", "e3", 2022, "C", "M", "N", 0, 1, 0),
            ("p1", "e4", 2023, "C", "M", "N", 0, 0, 0),
            ("p3", "e5", 2023, "C", "M", "O", 0, 0, 0),
        ],
        "pat_id string, pat_enc_csn_id string, y int, County string, Municipality string, Neighborhood string, Asthma int, Diabetes int, MH int",
    )


def test_yearly_mean_over_present_years(spark):
    out = cohorts.admission_totals(_admissions(spark).fillna({"MH": 0}), F.col("y"))
    got = {r["Neighborhood"]: r.asDict() for r in out.collect()}
    assert got["N"]["Asthma_Admits"] == 1.0 and got["N"]["Asthma_Admitted"] == 0.5
    assert got["N"]["Total_Admits"] == 2.0 and got["N"]["Total_Admitted"] == 1.5
    assert got["N"]["MH_Admits"] == 0.5
    # one year only: divided by one, unless the number of years is given
    assert got["O"]["Total_Admits"] == 1.0
    fixed = {r["Neighborhood"]: r["Total_Admits"] for r in cohorts.admission_totals(_admissions(spark), F.col("y"), periods=2).collect()}
    assert fixed == {"N": 2.0, "O": 0.5}


def test_unknown_flag_strict(spark):
    out = cohorts.admission_totals(_admissions(spark), F.col("y"), strict=True)
    got = {r["Neighborhood"]: r.asDict() for r in out.collect()}
    # 2022 holds an unknown flag: its sum becomes 0 and one unknown person counts
    assert got["N"]["MH_Admits"] == 0.0 and got["N"]["MH_Admitted"] == 1.0


def test_flags(spark):
    df = spark.createDataFrame(
        [("e1", "J45.21", 1), ("e2", "J45.21", 1), ("e3", None, 1), ("e4", None, 10401085), ("e5", "R45.8", 1), ("e6", "E15", 1)],
        "pat_enc_csn_id string, disch_icd_1 string, department_id int",
    )
    ex = spark.createDataFrame([("e2",), ("e2",)], "pat_enc_csn_id string")
    loose = rows(cohorts.flag_conditions(df, ex).select("pat_enc_csn_id", "Asthma", "Diabetes", "MH"))
    assert loose == [("e1", 1, 0, 0), ("e2", 0, 0, 0), ("e3", 0, 0, 0), ("e4", 0, 0, 1), ("e5", 0, 0, 1), ("e6", 0, 1, 0)]
    strict = {r["pat_enc_csn_id"]: r["MH"] for r in cohorts.flag_conditions(df, ex, strict=True).collect()}
    assert strict["e3"] is None and strict["e4"] == 1


def test_missing_exclusion_flag_excludes(spark):
    cols = ", ".join(f"{f} int" for f in cohorts.UNUSABLE_FLAGS)
    df = spark.createDataFrame([(0,) * 7, (0, 0, None, 0, 0, 0, 0), (1, 0, 0, 0, 0, 0, 0)], cols)
    assert df.where(cohorts.usable_address()).count() == 1


CITY = City("City", "County", "Ohio")


def test_index_weights_before_and_after_the_join(spark):
    bg = spark.createDataFrame([("39061000100" + "1", catalog.POPULATION, 10.0), ("39061000200" + "1", catalog.POPULATION, 30.0)], "GEOID string, variable string, estimate double")
    alloc = spark.createDataFrame([("390610001001", "City", "Hood", 1.0), ("390610002001", "City", "Hood", 1.0)], "GEOID string, Municipality string, Neighborhood string, Allocation double")
    index = spark.createDataFrame([(0.4, "39061000100")], "dep_index double, census_tract_fips string")
    # the tract without an index keeps its share of the divisor
    assert deprivation.city_index(bg, alloc, index, CITY, {}).first()["value"] == pytest.approx(0.1)
    tracts = spark.createDataFrame([("39061000100", catalog.POPULATION, 10.0), ("39061000200", catalog.POPULATION, 30.0)], "GEOID string, variable string, estimate double")
    cross = spark.createDataFrame([("County", "Ohio", "City", 1.0, "39061000100"), ("County", "Ohio", "City", 1.0, "39061000200")], "County string, State string, Municipality string, Allocation double, GEOID string")
    assert deprivation.place_index(tracts, cross, index).first()["value"] == pytest.approx(0.4)


def test_apportion_worked_example(spark):
    rows_ = spark.createDataFrame([("g", "v", 100.0), ("g", "v", None), ("h", "v", 50.0)], "GEOID string, variable string, estimate double")
    cross = spark.createDataFrame([("g", "A", 0.62), ("g", "B", 0.38), ("h", "B", 1.0)], "GEOID string, hood string, Allocation double")
    got = dict(survey.apportion(rows_, cross, "GEOID", ["hood"]).select("hood", "estimate").collect())
    assert got == pytest.approx({"A": 62.0, "B": 88.0})
    assert sum(got.values()) == pytest.approx(150.0)


def test_household_share_bases(spark):
    bg = spark.createDataFrame([("390610001001", catalog.HOUSEHOLDS, 60.0), ("390610001002", catalog.HOUSEHOLDS, 40.0)], "GEOID string, variable string, estimate double")
    alloc = spark.createDataFrame([("390610001001", "City", "Hood", 1.0), ("390610001002", "Other", "Other", 1.0)], "GEOID string, Municipality string, Neighborhood string, Allocation double")
    assert survey.household_shares(bg, alloc, CITY, {}).first()["Allocation"] == pytest.approx(0.6)
    assert survey.household_shares(bg, alloc, CITY, {}, base="city").first()["Allocation"] == pytest.approx(1.0)


def test_halfscale_ends_and_middle(spark):
    keys = ["County", "Municipality", "Neighborhood"]
    values = spark.createDataFrame([("c", "a", "a", 1.0), ("c", "b", "b", 3.0), ("c", "d", "d", 8.0), ("c", "a", "h", 4.0)], "County string, Municipality string, Neighborhood string, value double")
    weights = values.select(*keys, F.lit(1.0).alias("estimate"))
    out = benchmark.zscore_halfscale(values, weights, keys, F.col("Municipality") == F.col("Neighborhood"))
    got = {r["Neighborhood"]: r["Scale"] for r in out.collect()}
    assert got["a"] == pytest.approx(0.0) and got["d"] == pytest.approx(1.0) and got["h"] == pytest.approx(0.5)


def test_tiers(spark):
    df = spark.createDataFrame([(0.6,), (0.475,), (0.35,), (0.225,), (0.1,), (None,)], "v double")
    assert [r[0] for r in df.select(benchmark.tier(F.col("v"))).collect()] == ["Highest", "Higher", "Medium", "Lower", "Lowest", "Lowest"]


def test_cascade_prefers_the_first_provider(spark):
    places = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    a = spark.createDataFrame([(1, 1.0, 1.0), (2, None, None)], "k int, lat double, long double")
    b = spark.createDataFrame([(1, 9.0, 9.0), (2, 2.0, 2.0)], "k int, lat double, long double")
    assert rows(address.geocode_cascade(places, [a, b], ["k"])) == [(1, 1.0, 1.0), (2, 2.0, 2.0)]


def test_schools(spark):
    lines = [
        "Aiken New Tech High 5641 Belmont Ave, Cincinnati, OH 45224",
        "The Promise Center Winton Ridge Lane, Cincinnati, OH 45232",
        "Mt. Washington School 1730 Mears Ave, Cincinnati, OH",
        "Virtual High School 425 Ezzard Dr, Cincinnati, OH 45203",
    ]
    words = F.split("v", " ", -1)
    df = spark.createDataFrame([(x,) for x in lines], "v string").select([F.get(words, F.lit(i)).alias(c) for i, c in enumerate(placelists.SCHOOL_COLUMNS)])
    got = {r["Name"]: (r["Address"], r["Zip"]) for r in placelists.parse_schools(df).collect()}
    assert got == {
        "Aiken High School": ("5641 Belmont Ave", "45224"),
        # without a house number the first seven tokens are the name, so no zip is left
        "The Promise Center": ("5425 Winton Ridge Lane", None),
        "Mt. Washington School": ("1730 Mears Ave", "45230"),
    }


def test_area_views(spark):
    areas = spark.createDataFrame([("c", "City", "City", 1), ("c", "City", "Hood", 2), ("c", "In", "In", 3), ("c", "Out", "Out", 4)], "County string, Municipality string, Neighborhood string, HoodID int")
    muni, city = survey.area_views(areas, City("City", "c", "Ohio", ("In",)))
    assert [r[-1] for r in rows(muni)] == [1, 3, 4]
    assert sorted(r[-1] for r in city.collect()) == [2, 3]


def test_surplus_parts_are_refused_merged_or_left_out(spark):
    df = spark.createDataFrame([("a-b-c",), ("a",), (None,)], "v string")

    def parts(surplus):
        return rows(df.select(*[c.alias(n) for n, c in text.split_columns("v", "-", ["x", "y"], surplus).items()]))

    with pytest.raises(Exception, match="more than 2 parts: a-b-c"):
        parts("error")
    assert parts("merge") == [("a", "b-c"), ("a", None), (None, None)]
    assert parts("drop") == [("a", "b"), ("a", None), (None, None)]


def test_lines_keep_surplus_words_and_lose_their_header(spark):
    lines = spark.createDataFrame([('one "two" three four',), ("one",)], "value string")
    path = sinks.write_lines(lines, session.work_folder(spark, "lines"))
    got = rows(readers.tokens(spark, path, ["a", "b", "c"], surplus="merge"))
    assert got == [("one", '"two"', "three four"), ("one", None, None)]
    with pytest.raises(Exception, match="more than 3 parts"):
        readers.tokens(spark, path, ["a", "b", "c"]).collect()


def test_schools_and_pharmacies_stop_at_surplus_parts(spark):
    line = "North Hill School 12 Main St, Cincinnati, OH 45202, extra"
    words = readers.token_columns(spark.createDataFrame([(line,)], "value string"), placelists.SCHOOL_COLUMNS, surplus="merge")
    with pytest.raises(Exception, match="more than 3 parts"):
        placelists.parse_schools(words).collect()
    shop = spark.createDataFrame([("1", "RX-A, B, C, D, OH-1 ELM")], "pharmacy_id string, pharmacy_name string")
    with pytest.raises(Exception, match="more than 4 parts"):
        placelists.parse_pharmacies(shop).collect()
    shop = spark.createDataFrame([("1", "RX--a-b-c-d-e-MASON, OH")], "pharmacy_id string, pharmacy_name string")
    with pytest.raises(Exception, match="more than 5 parts"):
        placelists.parse_pharmacies_earlier(shop).collect()


def test_counties_of_several_words(spark):
    raw = spark.createDataFrame([("39061", "12.01", "St. Clair OH", "Mason city", 1.0)], "CountyCode string, Tract string, County string, Municipality string, Allocation double")
    row = survey.tract_crosswalk(raw, ["St. Clair OH"]).first()
    assert (row["County"], row["State"]) == ("St. Clair", "Ohio")
    with pytest.raises(Exception, match="no county and state"):
        survey.tract_crosswalk(raw.withColumn("County", F.lit("Clair")), ["Clair"]).collect()


def test_measure_is_the_last_word_of_a_name(spark):
    wide = spark.createDataFrame([("c", "m", "n", 3.0)], "County string, Municipality string, Neighborhood string, Sickle_Cell_Registry double")
    children = spark.createDataFrame([("c", "m", "n", 60.0)], "County string, Municipality string, Neighborhood string, Children double")
    row = cohorts.rates_per_hundred(wide, children).first()
    assert (row["Condition"], row["Measure"], row["Rate"]) == ("Sickle_Cell", "Registry", 5.0)


def test_earlier_households_come_from_their_own_table():
    found = dict(catalog.category_rows())
    assert found["B11005_001"] == "Households" and found["B11005_002"] == "HHWithChildren"
    assert "B11012_001" not in found and "B11012_003" not in found and len(set(found.values())) == 19


@pytest.mark.parametrize("kept", [False, True])
def test_dense_ids_follow_the_order(spark, kept):
    df = spark.range(500).select(F.when(F.col("id") % 7 > 0, (F.col("id") * 37 % 500)).alias("v"), "id").repartition(5)
    keep = (lambda f: session.keep(f, "ranges")) if kept else None
    got = windows.dense_ids(df, {"v": F.col("v"), "id": F.col("id")}, "n", keep).collect()
    want = sorted(got, key=lambda r: (r["v"] is None, r["v"] or 0, r["id"]))
    assert [r["n"] for r in want] == list(range(1, 501))


def test_one_of_several_positions_is_always_the_same(spark):
    places = spark.createDataFrame([("a",), ("b",)], "k string")
    first = spark.createDataFrame([("a", 2.0, 9.0), ("a", 1.0, 5.0), ("b", None, 1.0)], "k string, lat double, long double").repartition(3)
    second = spark.createDataFrame([("b", 7.0, 8.0), ("a", 0.0, 0.0)], "k string, lat double, long double")
    assert rows(address.geocode_cascade(places, [first, second], ["k"])) == [("a", 1.0, 5.0), ("b", 7.0, 8.0)]


def test_themes_keep_their_own_areas(spark):
    """An area without mobility rows still counts for race, and only there."""
    from areaspark.plans import themes

    cells = [("A", "B01001_001", 100.0), ("A", "B02001_002", 60.0), ("A", "B07201_001", 90.0), ("A", "B07201_002", 80.0), ("B", "B01001_001", 50.0), ("B", "B02001_002", 10.0)]
    long = spark.createDataFrame([("C", m, m, v, e) for m, v, e in cells], "County string, Municipality string, Neighborhood string, variable string, estimate double")
    df = catalog.with_levels(long.join(catalog.dictionary(spark), "variable"))
    own = F.col("Municipality") == F.col("Neighborhood")
    wide = themes.totals_and_rates(df, ["race", "mobility"], together=False)
    names_ = {r["Municipality"]: (r["Inrace"], r["Inmobility"]) for r in wide.collect()}
    assert names_ == {"A": (True, True), "B": (True, False)}
    assert [r["Municipality"] for r in themes.totals_and_rates(df, ["race", "mobility"]).collect()] == ["A"]
    rates = wide.select("County", "Municipality", "Neighborhood", "PopPopulation", "Inrace", "Inmobility", F.lit(1.0).alias("TotalX"), F.lit(0.5).alias("RateX"))
    got = benchmark.compare_rates(rates, ["Municipality"], ["X"], "PopPopulation", own, members={"X": F.col("Inmobility")})
    assert {r["Municipality"] for r in got.collect()} == {m for m, (_, mob) in names_.items() if mob}
