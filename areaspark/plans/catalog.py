"""Survey variables: ids, label text, and what each one counts towards.

Ids and labels follow the published American Community Survey detailed tables.
They are produced from the layout of each table rather than listed one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areaspark.functions import missing

# --- fixed values -----------------------------------------------------------
AGE_BANDS = [
    "Under 5 years", "5 to 9 years", "10 to 14 years", "15 to 17 years",
    "18 and 19 years", "20 years", "21 years", "22 to 24 years",
    "25 to 29 years", "30 to 34 years", "35 to 39 years", "40 to 44 years",
    "45 to 49 years", "50 to 54 years", "55 to 59 years", "60 and 61 years",
    "62 to 64 years", "65 and 66 years", "67 to 69 years", "70 to 74 years",
    "75 to 79 years", "80 to 84 years", "85 years and over",
]
CHILD_BANDS = ["Under 5 years", "5 to 9 years", "10 to 14 years", "15 to 17 years"]
MERGED_BANDS = {
    "15 to 17": "15 to 19", "18 and 19": "15 to 19",
    "20": "20 to 24", "21": "20 to 24", "22 to 24": "20 to 24",
    "60 and 61": "60 to 64", "62 to 64": "60 to 64",
    "65 and 66": "65 to 69", "67 to 69": "65 to 69",
}
FIVE_YEAR_BANDS = [
    "Under 5", "5 to 9", "10 to 14", "15 to 19", "20 to 24", "25 to 29",
    "30 to 34", "35 to 39", "40 to 44", "45 to 49", "50 to 54", "55 to 59",
    "60 to 64", "65 to 69", "70 to 74", "75 to 79", "80 to 84", "85 and over",
]
MEDIAN_INCOME = "B19049_001"
HOUSEHOLDS = "B11012_001"
POPULATION = "B01001_001"
PUBLIC_ASSISTANCE = "B19058_002"
MOBILITY_IDS = ["B07201_002", "B07201_004", "B07201_014"]
HOUSEHOLD_IDS = [f"B11012_{i:03d}" for i in (3, 4, 6, 7, 9, 10, 11, 12, 14, 15, 16, 17)]
GRADUATE_IDS = [f"B15003_{i:03d}" for i in range(17, 26)]
UNINSURED_IDS = [f"B27010_{i:03d}" for i in (17, 33, 50, 66)]
CONCEPTS = {
    "B01001": "Sex by Age",
    "B02001": "Race",
    "B03002": "Hispanic or Latino Origin by Race",
    "B07201": "Geographical Mobility in the Past Year for Current Residence in the United States",
    "B11012": "Households by Type",
    "B15003": "Educational Attainment for the Population 25 Years and Over",
    "B16004": "Age by Language Spoken at Home by Ability to Speak English for the Population 5 Years and Over",
    "B17010": "Poverty Status in the Past 12 Months of Families by Family Type",
    "B19049": "Median Household Income in the Past 12 Months by Age of Householder",
    "B25002": "Occupancy Status",
    "B27010": "Types of Health Insurance Coverage by Age",
}
RACES = [
    "White alone", "Black or African American alone", "American Indian and Alaska Native alone",
    "Asian alone", "Native Hawaiian and Other Pacific Islander alone", "Some Other Race alone",
    "Two or More Races:", "Two or More Races:!!Two races including Some Other Race",
    "Two or More Races:!!Two races excluding Some Other Race, and three or more races",
]
HOUSEHOLD_KINDS = [
    ("Married-couple household:", ["With children of the householder under 18 years",
                                   "With no children of the householder under 18 years"]),
    ("Cohabiting couple household:", ["With children of the householder under 18 years",
                                      "With no children of the householder under 18 years"]),
    ("Female householder, no spouse or partner present:",
     ["Living alone", "With children of the householder under 18 years",
      "With relatives, no children of the householder under 18 years", "With only nonrelatives present"]),
    ("Male householder, no spouse or partner present:",
     ["Living alone", "With children of the householder under 18 years",
      "With relatives, no children of the householder under 18 years", "With only nonrelatives present"]),
]
DEGREES = [
    "Regular high school diploma", "GED or alternative credential", "Some college, less than 1 year",
    "Some college, 1 or more years, no degree", "Associate's degree", "Bachelor's degree",
    "Master's degree", "Professional school degree", "Doctorate degree",
]
LANGUAGES = ["Speak Spanish", "Speak other Indo-European languages",
             "Speak Asian and Pacific Island languages", "Speak other languages"]
SPEAKER_AGES = ["5 to 17 years", "18 to 64 years", "65 years and over"]
INSURED_AGES = ["Under 19 years", "19 to 34 years", "35 to 64 years", "65 years and over"]
# --- end of fixed values ----------------------------------------------------

TOTAL = "Estimate!!Total:"


def numbered(table: str, *numbers: int) -> list[str]:
    """Variable ids of one table: ``numbered("B15003", 1, 17)`` -> B15003_001, B15003_017."""
    return [f"{table}_{n:03d}" for n in numbers]


def dictionary_rows() -> list[tuple[str, str, str]]:
    """(variable, label, concept) of the 127 dictionary variables."""
    rows: list[tuple[str, str]] = [("B01001_001", TOTAL)]
    for start, sex in ((2, "Male"), (26, "Female")):
        rows.append((f"B01001_{start:03d}", f"{TOTAL}!!{sex}:"))
        rows += [
            (f"B01001_{start + i:03d}", f"{TOTAL}!!{sex}:!!{band}")
            for i, band in enumerate(AGE_BANDS, 1)
        ]
    rows += [(f"B02001_{i:03d}", f"{TOTAL}!!{race}") for i, race in enumerate(RACES, 2)]
    rows.append(("B03002_012", f"{TOTAL}!!Hispanic or Latino:"))
    rows += [
        ("B07201_001", TOTAL),
        ("B07201_002", f"{TOTAL}!!Same house 1 year ago"),
        ("B07201_004", f"{TOTAL}!!Different house in United States 1 year ago:!!Same metropolitan statistical area:"),
        ("B07201_014", f"{TOTAL}!!Abroad 1 year ago"),
    ]
    rows.append((HOUSEHOLDS, TOTAL))
    n = 1
    for kind, members in HOUSEHOLD_KINDS:
        n += 1
        rows.append((f"B11012_{n:03d}", f"{TOTAL}!!{kind}"))
        for m in members:
            n += 1
            rows.append((f"B11012_{n:03d}", f"{TOTAL}!!{kind}!!{m}"))
    rows.append(("B15003_001", TOTAL))
    rows += [(f"B15003_{i:03d}", f"{TOTAL}!!{d}") for i, d in enumerate(DEGREES, 17)]
    rows.append(("B16004_001", TOTAL))
    for base, age in zip((2, 24, 46), SPEAKER_AGES):
        rows.append((f"B16004_{base + 1:03d}", f"{TOTAL}!!{age}:!!Speak only English"))
        for j, lang in enumerate(LANGUAGES):
            for k, level in ((5, "not well"), (6, "not at all")):
                rows.append(
                    (f"B16004_{base + 5 * j + k:03d}",
                     f'{TOTAL}!!{age}:!!{lang}:!!Speak English "{level}"')
                )
    rows += [
        ("B17010_001", TOTAL),
        ("B17010_002", f"{TOTAL}!!Income in the past 12 months below poverty level:"),
        (MEDIAN_INCOME, "Estimate!!Median household income in the past 12 months:!!Total:"),
        ("B25002_001", TOTAL),
        ("B25002_003", f"{TOTAL}!!Vacant"),
    ]
    rows += [
        (v, f"{TOTAL}!!{a}:!!No health insurance coverage") for v, a in zip(UNINSURED_IDS, INSURED_AGES)
    ]
    return [(v, label, CONCEPTS[v[:6]]) for v, label in rows]


def variable_list() -> list[str]:
    """The dictionary variables, without the public-assistance one."""
    return [v for v, _, _ in dictionary_rows()]


def earlier_category(variable: str) -> str | None:
    """Category of a variable in the earlier, category-based dataset."""
    table, n = variable[:6], int(variable[7:])
    if table == "B01001":
        return "Population" if n == 1 else ("Children" if n in (3, 4, 5, 6, 27, 28, 29, 30) else None)
    if table == "B16004":
        if n == 1:
            return "Age5"
        return "English" if n in (3, 25, 47) else "LimitedEnglish"
    if table == "B15003":
        return "Age25" if n == 1 else "HighSchool"
    if table == "B27010":
        return "Uninsured"
    # fixed values
    return {
        "B02001_002": "White", "B02001_003": "Black", "B03002_012": "Hispanic",
        "B11005_001": "Households", "B11005_002": "HHWithChildren",
        "B17010_001": "Families", "B17010_002": "Poverty",
        "B19049_001": "MedianHHIncome", "B19058_002": "Assistance",
        "B25002_001": "HousingUnits", "B25002_003": "Vacant",
    }.get(variable)


def earlier_list() -> list[str]:
    """Variables that only the earlier dataset asks for: households, and those with a person under 18."""
    return numbered("B11005", 1, 2)


def category_rows() -> list[tuple[str, str]]:
    ids = [*variable_list(), PUBLIC_ASSISTANCE, *earlier_list()]
    return [(v, c) for v in ids if (c := earlier_category(v)) is not None]


def values_text(rows: Sequence[tuple], columns: Sequence[str]) -> str:
    """SQL text of a small inline table."""
    def literal(v) -> str:
        if v is None:
            return "CAST(NULL AS STRING)"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v)

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(columns)})"


def inline_table(spark: SparkSession, rows: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    """A small inline table. Its size is known to the optimizer, so it is broadcast by size."""
    return spark.sql(values_text(rows, columns))


def dictionary(spark: SparkSession) -> DataFrame:
    return inline_table(spark, dictionary_rows(), ["variable", "label", "concept"])


def category_lookup(spark: SparkSession) -> DataFrame:
    return inline_table(spark, category_rows(), ["variable", "category"])


def with_levels(df: DataFrame) -> DataFrame:
    """Split ``label`` into Group1..Group5, missing levels NULL; a sixth level is an error."""
    parts = F.split("label", ":!!", -1)
    checked = F.when(
        F.size(parts) > 5, F.raise_error(F.concat(F.lit("label with more than five levels: "), F.col("label")))
    ).otherwise(F.get(parts, F.lit(0)))
    return df.withColumns(
        {"Group1": checked, **{f"Group{i + 1}": F.get(parts, F.lit(i)) for i in range(1, 5)}}
    ).drop("label")


def denominator_kind() -> Column:
    """Which population a table total counts; NULL for every other variable."""
    concept = F.col("concept")
    kind = (
        F.when(concept.startswith("Sex"), "Population")
        .when(concept.startswith("Geographical"), "Mobility")
        .when(concept.startswith("Households"), "HH")
        .when(concept.startswith("Educational"), "Over25")
        .when(concept.startswith("Age"), "Over5")
        .when(concept.startswith("Poverty"), "Poverty")
        .otherwise("HousingUnits")
    )
    return F.when(F.col("variable").endswith("_001") & ~concept.contains("Income"), kind)


def race_kind() -> Column:
    g = F.col("Group2")
    return F.when(
        F.col("concept").contains("Race"),
        F.when(g.contains("White"), "White").when(g.contains("Black"), "Black").when(g.contains("Hispanic"), "Hispanic"),
    )


def language_kind() -> Column:
    return F.when(
        F.col("concept").contains("Language") & F.col("Group2").isNotNull(),
        F.when(F.col("Group3").contains("English"), "English").otherwise("NotWell"),
    )


def household_kind() -> Column:
    parent = F.coalesce(F.col("Group3").startswith("With children"), F.lit(False))
    couple = F.coalesce(F.col("Group2").contains("couple"), F.lit(False))
    return F.when(
        F.col("variable").isin(HOUSEHOLD_IDS),
        F.when(couple & parent, "TwoParent").when(couple, "Couple").when(parent, "SingleParent").otherwise("Single"),
    )


def mobility_kind() -> Column:
    return F.when(
        F.col("variable").isin(MOBILITY_IDS),
        F.when(F.col("Group2").startswith("Same"), "SameHome")
        .when(F.col("Group3").isNotNull(), "SameCity")
        .otherwise("Abroad"),
    )


def deprivation_kind() -> Column:
    wanted = F.col("variable").isin([*GRADUATE_IDS, "B17010_002", "B25002_003"]) | F.col("variable").contains("B27010")
    concept = F.col("concept")
    return F.when(
        wanted,
        F.when(concept.startswith("Educational"), "NoHighSchool")
        .when(concept.startswith("Poverty"), "Poverty")
        .when(concept.startswith("Occupancy"), "Vacant")
        .otherwise("Uninsured"),
    )


def child_kind() -> Column:
    return F.when(missing.is_in("Group3", CHILD_BANDS), "Children")
