"""Address cleaning, address keys and the hand-over to and from geocoders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaspark.functions import text
from areaspark.operators import joins, names, windows

# fixed values: words that start the unit part of an address line
UNIT_WORDS = ["APT", "#", "UNIT"]
PRECISE = "range"
IMPRECISE = "imprecise_geocode"


def clean_address(df: DataFrame) -> DataFrame:
    """Upper-case street line without its unit, upper-case city, five-digit zip."""
    line = F.upper(F.coalesce("add_line_1", "add_line_2"))
    return df.withColumns(
        {
            "City": F.upper("city"),
            "Zip": text.prefix("zip", 5),
            "Address": text.before_any(line, UNIT_WORDS),
        }
    )


def one_line(parts: Sequence[Column | str], zip_code: Column | str | None = None) -> Column:
    """Address on one line: parts joined by ", ", then a blank and the zip code."""
    line = text.paste(*parts, sep=", ")
    return line if zip_code is None else text.paste(line, zip_code, sep=" ")


def address_ids(df: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Distinct addresses with an id made from the address itself."""
    return df.select(*parts).distinct().withColumn("ID", windows.surrogate_id(*parts))


def for_geocoder(addresses: DataFrame, state: str = "state") -> DataFrame:
    """ID and one-line text of addresses still to be located."""
    code = names.state_code(F.col(state))
    return addresses.select(
        "ID", one_line([F.col("add_line_1"), F.col("city"), code], F.col("zip")).alias("address")
    )


def cache_split(df: DataFrame, parts: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct coordinates already known, and distinct addresses still to locate."""
    known = df.where("X is not null").select("X", "Y").distinct()
    open_ = address_ids(df.where("X is null"), parts)
    return known, open_


def precise_only(results: DataFrame) -> DataFrame:
    return results.where((F.col("precision") == PRECISE) & (F.col("geocode_result") != IMPRECISE))


def geocode_cascade(
    places: DataFrame, providers: Sequence[DataFrame], key: Sequence[str], lat: str = "lat", lon: str = "long"
) -> DataFrame:
    """Coordinates from the first provider that knows the place; misses drop out.

    Each provider table has the key, ``lat`` and ``long``; each is looked up once
    and the first known position in provider order is taken, of several positions
    of one place the smallest. ``places`` has one
    row per place.
    """
    out = places
    for i, table in enumerate(providers):
        known = (
            table.where(F.col(lat).isNotNull())
            .groupBy(*key)
            .agg(F.min(F.struct(F.col(lat).alias(lat), F.col(lon).alias(lon))).alias(f"__at{i}"))
        )
        out = joins.null_safe_join(out, known, list(key), "left")
    found = F.coalesce(*[F.col(f"__at{i}") for i in range(len(providers))])
    return out.select(*places.columns, found.alias("__at")).where("__at is not null").select(*places.columns, "__at.*")


def roundtrip(ids: DataFrame, original: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Bring per-address results back to all original rows with that address."""
    return joins.null_safe_join(original, ids, list(parts))
