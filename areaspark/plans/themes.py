"""Indicator themes: totals, denominators and rates per area.

Every total is a conditional sum, so any number of themes is one aggregation
over the hub table: one shuffle instead of filter -> group -> pivot -> join per
theme.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaspark.functions import missing, text
from areaspark.operators import reshape, windows
from areaspark.plans import catalog

AREA = ["County", "Municipality", "Neighborhood"]
DENOMINATORS = ["Population", "Mobility", "HH", "Over25", "Over5", "Poverty", "HousingUnits"]


@dataclass(frozen=True)
class Theme:
    """A theme: how a variable is classed, its classes, and the rates made of them."""

    kind: Column
    classes: Sequence[str]
    # rate name -> (total, denominator)
    rates: Mapping[str, tuple[str, str]]
    # totals that are a denominator less other totals
    remainders: Mapping[str, tuple[str, Sequence[str]]]


def theme(name: str) -> Theme:
    if name == "race":
        return Theme(
            catalog.race_kind(),
            ["White", "Black", "Hispanic"],
            {r: (r, "Population") for r in ("Black", "White", "Hispanic")},
            {},
        )
    if name == "language":
        return Theme(
            catalog.language_kind(),
            ["English", "NotWell"],
            {"OtherThanEnglish": ("OtherThanEnglish", "Over5"), "NotWell": ("NotWell", "Over5")},
            {"OtherThanEnglish": ("Over5", ["English"])},
        )
    if name == "households":
        kinds = ["Couple", "Single", "SingleParent", "TwoParent"]
        return Theme(catalog.household_kind(), kinds, {k: (k, "HH") for k in kinds}, {})
    if name == "mobility":
        return Theme(
            catalog.mobility_kind(),
            ["Abroad", "SameCity", "SameHome"],
            {k: (k, "Mobility") for k in ("SameHome", "SameCity", "OtherUS", "Abroad")},
            {"OtherUS": ("Mobility", ["SameHome", "SameCity", "Abroad"])},
        )
    if name == "deprivation":
        return Theme(
            catalog.deprivation_kind(),
            ["NoHighSchool", "Poverty", "Uninsured", "Vacant"],
            {
                "Poverty": ("Poverty", "Poverty"),
                "Uninsured": ("Uninsured", "Population"),
                "NoHighSchool": ("NoHighSchool", "Over25"),
                "Vacant": ("Vacant", "HousingUnits"),
            },
            {},
        )
    raise ValueError(f"unknown theme {name!r}")


ALL_THEMES = ["race", "language", "households", "mobility", "deprivation"]


def reference_pops(hub: DataFrame) -> DataFrame:
    """Denominators Pop* per area."""
    kind = catalog.denominator_kind()
    return reshape.widen_sums(
        hub.withColumn("__kind", kind).where("__kind is not null"),
        AREA,
        {f"Pop{m}": F.col("__kind") == m for m in DENOMINATORS},
        "estimate",
    )


def totals_and_rates(hub: DataFrame, names: Sequence[str] = tuple(ALL_THEMES), together: bool = True) -> DataFrame:
    """Total*, Pop* and Rate* of the chosen themes, in one pass over the hub.

    ``together``: areas need at least one row of every chosen theme and of the denominators. Otherwise each theme has its own set
    of areas: a column In* for each theme tells whether the area has rows of it, and areas in none are left out.
    """
    chosen = {n: theme(n) for n in names}
    kinds = {f"__{n}": t.kind for n, t in chosen.items()}
    kinds["__pop"] = catalog.denominator_kind()
    tagged = hub.withColumns(kinds)
    sums = {f"Pop{d}": F.col("__pop") == d for d in DENOMINATORS}
    for n, t in chosen.items():
        # "Poverty" is a class and a denominator; prefixes keep them apart
        sums.update({f"Total{c}": F.col(f"__{n}") == c for c in t.classes})
    present = {f"__n{i}": F.count(k) for i, k in enumerate(kinds)}
    wide = tagged.groupBy(*AREA).agg(
        *[missing.sum_strict_where(c, "estimate").alias(n) for n, c in sums.items()],
        *[c.alias(n) for n, c in present.items()],
    )
    has = {k: F.col(flag) > 0 for k, flag in zip(kinds, present)}
    if together:
        wide = wide.where(reduce(lambda a, b: a & b, has.values())).drop(*present)
    else:
        own = {f"In{n}": has[f"__{n}"] for n in chosen}
        wide = wide.where(has["__pop"] & reduce(lambda a, b: a | b, own.values())).withColumns(own).drop(*present)
    extra: dict[str, Column] = {}
    for t in chosen.values():
        for total, (base, parts) in t.remainders.items():
            left = F.col(f"Pop{base}")
            for p in parts:
                left = left - F.col(f"Total{p}")
            extra[f"Total{total}"] = left
    wide = wide.withColumns(extra) if extra else wide
    return wide.withColumns(
        {
            f"Rate{r}": missing.ratio(f"Total{total}", f"Pop{base}")
            for t in chosen.values()
            for r, (total, base) in t.rates.items()
        }
    )


def theme_wide(hub: DataFrame, name: str) -> DataFrame:
    """One theme with its own denominators."""
    t = theme(name)
    pops = list(dict.fromkeys(f"Pop{b}" for _, b in t.rates.values()))
    totals = list(dict.fromkeys([f"Total{x}" for x, _ in t.rates.values()]))
    rates = [f"Rate{r}" for r in t.rates]
    return totals_and_rates(hub, [name]).select(*AREA, *totals, *pops, *rates)


def children(hub: DataFrame) -> DataFrame:
    """Persons under 18 per area."""
    return (
        hub.where(catalog.child_kind().isNotNull())
        .groupBy(*AREA)
        .agg(missing.sum_strict("estimate").alias("Children"))
    )


def age_gender(hub: DataFrame) -> DataFrame:
    """Five-year age bands by gender, with the share of the area's population."""
    band = text.remove_first_text("Group3", " years")
    rows = (
        hub.where((F.col("concept") == "Sex by Age") & F.col("Group3").isNotNull())
        .withColumns({"Gender": F.col("Group2"), "Age": text.recode(band, catalog.MERGED_BANDS)})
        .groupBy(*AREA, "Gender", "Age")
        .agg(missing.sum_strict("estimate").alias("Population"))
    )
    # at most one row per gender and age band of an area
    out = windows.with_group_total(rows, AREA, "Population", "Total", bounded=True)
    return out.withColumn(
        "Pct", F.bround(missing.ratio(F.col("Population") * 100, "Total"), 1)
    ).select(*AREA, "Gender", "Age", "Population", "Pct")


def assistance(hub: DataFrame, interpolated: DataFrame) -> DataFrame:
    """Public-assistance totals and rate: municipality rows plus interpolated neighbourhoods."""
    own = hub.where(
        F.col("variable").isin(catalog.PUBLIC_ASSISTANCE, catalog.HOUSEHOLDS)
        & (F.col("Neighborhood") == F.col("Municipality"))
    )
    wide = reshape.widen_sums(
        own,
        AREA,
        {
            "PopHH": F.col("variable") == catalog.HOUSEHOLDS,
            "TotalAssistance": F.col("variable") == catalog.PUBLIC_ASSISTANCE,
        },
        "estimate",
    )
    both = wide.unionByName(interpolated.select(*wide.columns))
    return both.withColumn("AssistancePct", missing.ratio("TotalAssistance", "PopHH"))
