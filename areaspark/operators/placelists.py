"""Schools and pharmacies from loosely structured text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaspark.functions import missing, numbers, text
from areaspark.operators.reshape import staged

# --- fixed values -----------------------------------------------------------
SCHOOL_COLUMNS = ["A", "B", "C", "D", "E", "G", "H", "I", "J", "K", "L", "M"]
SCHOOL_CITY, SCHOOL_STATE = "Cincinnati", "OH"
NOT_SCHOOLS = ["Cincinnati Digital Academy", "Virtual High School", "Hospital/Satellite Program Office"]
PROMISE_WORD, PROMISE_NAME = "Promise", "The Promise Center"
PROMISE_NUMBER, PROMISE_STREET = "5425", "Winton Ridge Lane"
SCHOOL_ZIPS = {"Mt. Washington School": "45230"}
SCHOOL_RENAMES = {
    "Gamble Montessori Elementary": "Gamble Montessori Elementary School",
    "Aiken": "Aiken High School",
}
PHARMACY_STATES = ["OH", "KY", "IN"]
NO_ELECTRONIC = "NON E-RX"
ROOM_WORDS = ["SUITE", " STE", " ROOM", " PO ", " RM "]
TAIL_WORDS = [" AT ", " STE", " SUITE "]
# --- end of fixed values ----------------------------------------------------


def parse_schools(lines: DataFrame, columns: Sequence[str] = tuple(SCHOOL_COLUMNS)) -> DataFrame:
    """Name and address of schools from blank-separated tokens.

    The house number is the first number among the third to ninth token; the
    tokens before it (at most eight) are the name; the text after it holds
    "street, city, state zip". A fourth part between commas is an error.
    """
    promise = F.coalesce(F.col("B") == PROMISE_WORD, F.lit(False))
    number = F.coalesce(*[numbers.number_text(numbers.parse_number(c)) for c in columns[2:9]])
    middle = F.array(*[F.col(c) for c in columns[2:7]])
    df = staged(lines, {"Number": F.when(promise, PROMISE_NUMBER).otherwise(number)})
    # tokens before the number; all five when the number is not a token of its own
    df = staged(df, {"at": F.array_position(middle, F.col("Number"))})
    before = F.when(F.col("at") > 0, F.col("at") - 1).otherwise(F.lit(len(columns[2:7])))
    df = staged(df, {"taken": F.slice(middle, F.lit(1), before.cast("int"))})
    taken = F.col("taken")
    name = F.when(
        F.col("Number").isNotNull() & ~F.exists(taken, lambda t: t.isNull()),
        F.array_join(F.concat(F.array(F.coalesce("A", F.lit("NA")), F.coalesce("B", F.lit("NA"))), taken), " "),
    )
    df = staged(df, {"Name": name, "line": text.paste(*columns)})
    df = staged(df, {"line": text.remove_first_of("line", "Name")})
    df = staged(df, {"line": text.remove_first_of("line", "Number")})
    df = staged(df, text.split_columns(text.trim_space("line"), ",", ["street", "town", "tail"]))
    tail = text.trim_space("tail")
    name = F.col("Name")
    for word, full in SCHOOL_RENAMES.items():
        name = F.when(F.coalesce(F.col("Name").contains(word), F.lit(False)), full).otherwise(name)
    out = df.select(
        F.when(promise, PROMISE_NAME).otherwise(name).alias("Name"),
        "Number",
        F.when(promise, PROMISE_STREET).otherwise(F.col("street")).alias("Street"),
        F.lit(SCHOOL_CITY).alias("City"),
        F.lit(SCHOOL_STATE).alias("State"),
        text.recode("Name", SCHOOL_ZIPS, text.piece(tail, " ", 1)).alias("Zip"),
    )
    return (
        out.distinct()
        .where(missing.not_in("Name", NOT_SCHOOLS))
        .select(
            "Name",
            text.paste("Number", "Street").alias("Address"),
            "City",
            "State",
            "Zip",
            F.lit("School").alias("Type"),
        )
    )


def _first_with_comma(candidates: Sequence[Column]) -> Column:
    return F.coalesce(*[F.when(c.contains(","), c) for c in candidates])


def parse_pharmacies(df: DataFrame, column: str = "pharmacy_name") -> DataFrame:
    """Name, address, city and state from "name - … - CITY, ST - address" texts."""
    top = text.split_columns(column, "-", ["p0", "p1", "p2"], "merge")
    df = staged(df, top)
    second = missing.if_else(F.col("p1") == "", F.col("p2"), F.col("p1"))
    df = staged(df, {"second": second})
    block = text.trim_space(missing.if_else(F.col("second").contains(","), F.col("second"), F.col("p2")))
    df = staged(df, {"block": block})
    df = staged(df, text.split_columns("block", "-", ["c0", "c1", "c2", "c3"], "merge"))
    place = _first_with_comma([F.col("c0"), text.trim_space("c1"), text.trim_space("c2")])
    df = staged(df, {"place": place}).where(F.col("place").isNotNull())
    parts = text.split_columns("place", ",", ["City", "s1", "s2", "s3"])
    df = staged(
        df,
        {
            "City": parts["City"],
            "State": text.trim_space(F.coalesce(parts["s3"], parts["s2"], parts["s1"])),
            "unit": text.trim_space(text.before_any("c2", ROOM_WORDS)),
        },
    ).where(F.col("State").isin(PHARMACY_STATES))
    last = text.before_any(
        F.when(F.col("c3").contains(NO_ELECTRONIC), None).otherwise(text.trim_space("c3")), [","]
    )
    unit = F.col("unit")
    numbered = missing.is_in(text.prefix(unit, 1), [str(i) for i in range(1, 10)])
    street = F.when(numbered & (F.length(unit) >= 4), unit)
    joined = F.when(numbered | unit.isNull(), F.col("c1")).otherwise(text.paste("c1", unit))
    address = F.coalesce(street, last, text.trim_space(joined), F.col("p2"))
    return df.select(
        F.col("p0").alias("Name"),
        text.trim_space(text.before_any(address, TAIL_WORDS)).alias("Address"),
        "City",
        "State",
        F.lit(None).cast("string").alias("Zip"),
        F.lit("Pharmacy").alias("Type"),
    )


def parse_pharmacies_earlier(df: DataFrame, column: str = "pharmacy_name") -> DataFrame:
    """Earlier variant: the address is the first part that starts with its own number."""
    df = staged(df, text.split_columns(column, "-", ["p0", "p1", "p2"], "merge"))
    df = staged(df, text.split_columns("p2", "--", ["n3", "n4", "n5"], "merge"))
    df = staged(df, {"second": missing.if_else(F.col("p1") == "", F.col("n3"), F.col("p1"))})
    block = text.trim_space(missing.if_else(F.col("second").contains(","), F.col("second"), F.col("n3")))
    df = staged(df, {"block": block})
    df = staged(df, text.split_columns("block", "-", [f"c{i}" for i in range(5)]))
    place = _first_with_comma(
        [text.trim_space("c0"), text.trim_space("c1"), F.col("c2"), F.col("c3"), F.col("c4")]
    )
    df = staged(df, {"place": place}).where(F.col("place").isNotNull())
    parts = text.split_columns("place", ",", ["City", "State"], "drop")  # what follows a state is left out by rule
    df = staged(df, {"City": parts["City"], "State": text.trim_space(parts["State"])}).where(F.col("State").isin(PHARMACY_STATES))

    def numbered(c: Column) -> Column:
        return c.startswith(numbers.number_text(numbers.parse_number(c)))

    df = staged(df, {"a": text.trim_space(text.piece("n3", " AT ", 0))})
    # each step falls back to the next part; an unnumbered first fallback asks the city block
    df = staged(df, {"a": missing.if_else(numbered(F.col("a")), F.col("a"), text.trim_space("n4"))})
    df = staged(df, {"a": F.when(numbered(F.col("a")).isNull(), text.trim_space("c1")).otherwise(F.col("a"))})
    df = staged(df, {"a": missing.if_else(numbered(F.col("a")), F.col("a"), text.trim_space("c2"))})
    return df.where(numbered(F.col("a"))).select(
        "pharmacy_id", F.col("p0").alias("name"), F.col("a").alias("Address"), "City", "State"
    )
