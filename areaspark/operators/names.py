"""Area-name harmonising, recodes and code lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaspark.functions import missing, text

# fixed values: name parts that are not part of a place's name
PLACE_SUFFIXES = [" city", " CCD", " village", "The Village of "]
STATE_NAMES = {"OH": "Ohio", "KY": "Kentucky", "IN": "Indiana"}
STATE_CODES = {"Ohio": "OH", "Kentucky": "KY", "Indiana": "IN"}
COUNTY_CODES = {
    ("Ohio", "061"): "Hamilton", ("Ohio", "017"): "Butler",
    ("Ohio", "025"): "Clermont", ("Ohio", "165"): "Warren",
    ("Kentucky", "015"): "Boone", ("Kentucky", "037"): "Campbell",
    ("Kentucky", "117"): "Kenton", ("Indiana", "029"): "Dearborn",
}
COUNTY_OVERRIDES = {"Loveland": "Hamilton", "Milford": "Clermont", "Fairfield": "Butler"}
NEIGHBOURHOOD_MERGES = {
    "North Avondale": "North Avondale-Paddock Hills",
    "Paddock Hills": "North Avondale-Paddock Hills",
}
BOUNDARY_NAME_MERGES = {
    "Villages at Roll Hill": "Roll Hill",
    "Lower Price Hill": "Lower Price Hill-Queensgate",
    "Queensgate": "Lower Price Hill-Queensgate",
    "North Avondale - Paddock Hills": "North Avondale-Paddock Hills",
}


def place_name(col: Column | str, remove: Sequence[str] = tuple(PLACE_SUFFIXES)) -> Column:
    """Place name without its legal kind, in title case."""
    out = F.col(col) if isinstance(col, str) else col
    for part in remove:
        out = text.remove_first_text(out, part)
    return text.title_case(out)


def split_area_name(
    df: DataFrame, column: str = "NAME", names: Sequence[str] = ("Municipality", "County", "State"), delimiter: str = ", "
) -> DataFrame:
    """Split an area name into exactly the given parts; other counts are an error."""
    parts = F.split(column, text.literal_pattern(delimiter), -1)
    first = F.when(
        F.size(parts) != len(names),
        F.raise_error(F.concat(F.lit(f"{column} does not have {len(names)} parts: "), F.col(column))),
    ).otherwise(F.get(parts, F.lit(0)))
    cols = {names[0]: first, **{n: F.get(parts, F.lit(i)) for i, n in enumerate(names) if i}}
    return df.withColumns(cols)


def split_quarantine(
    df: DataFrame, column: str, names: Sequence[str], delimiter: str
) -> tuple[DataFrame, DataFrame]:
    """Rows that split into exactly the given parts, and the rows that do not."""
    fits = F.coalesce(text.piece_count(column, delimiter) == len(names), F.lit(False))
    good = df.where(fits).withColumns(text.split_columns(column, delimiter, names, "drop"))  # none is left over
    return good, df.where(~fits)


def harmonise_places(
    df: DataFrame, column: str = "NAME", remove: Sequence[str] = tuple(PLACE_SUFFIXES), delimiter: str = ", "
) -> DataFrame:
    """Municipality, County and State from a full area name."""
    out = split_area_name(df, column, ("Municipality", "County", "State"), delimiter)
    return out.withColumns(
        {
            "Municipality": place_name("Municipality", remove),
            "County": text.remove_first_text("County", " County"),
        }
    )


def override_county(df: DataFrame, overrides: Mapping[str, str] = COUNTY_OVERRIDES) -> DataFrame:
    """One county for places that cross county lines."""
    return df.withColumn("County", text.recode("Municipality", overrides, F.col("County")))


def merge_split_places(
    df: DataFrame, keys: Sequence[str], value: str, overrides: Mapping[str, str] = COUNTY_OVERRIDES
) -> DataFrame:
    """Parts of a place in several counties become one row per key."""
    return override_county(df, overrides).groupBy(*keys).agg(missing.sum_strict(value).alias(value))


def merge_neighbourhoods(df: DataFrame, merges: Mapping[str, str] = NEIGHBOURHOOD_MERGES) -> DataFrame:
    return df.withColumn("Neighborhood", text.recode("Neighborhood", merges))


def state_name(col: Column | str) -> Column:
    """State name of a two-letter code; the last state is the fallback."""
    codes = {k: v for k, v in STATE_NAMES.items() if k != "IN"}
    return text.recode(col, codes, F.lit("Indiana"))


def state_code(col: Column | str) -> Column:
    names = {k: v for k, v in STATE_CODES.items() if k != "Indiana"}
    return text.recode(col, names, F.lit("IN"))


def county_name(
    state: Column | str, code: Column | str, codes: Mapping[tuple[str, str], str] = COUNTY_CODES
) -> Column:
    """County name from a state name and a county code; NULL when not listed."""
    both = F.concat_ws("|", state, code)
    return text.recode(both, {f"{s}|{c}": n for (s, c), n in codes.items()}, F.lit(None))


def boundary_place_name(col: Column | str) -> Column:
    """Place name from a boundary label: the text before its kind, in title case."""
    out = text.before_any(col, ["village", "city", "CCD", ","])
    out = text.trim_space(text.title_case(out))
    return F.when(out.contains("Indian Hill"), "Indian Hill").otherwise(out)
