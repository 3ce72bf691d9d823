"""Comparison of each area with the metro: means, extremes, shades, tiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaspark.functions import missing
from areaspark.operators import joins

# --- fixed values -----------------------------------------------------------
TIERS = ["Lowest", "Lower", "Medium", "Higher", "Highest"]
TIER_FLOORS = {"Highest": 0.6, "Higher": 0.475, "Medium": 0.35, "Lower": 0.225}
LABEL_LIMIT, LABEL_BELOW, LABEL_ABOVE = 0.9, 0.025, 0.04
RAW_SCALE_RATES = [
    "WhiteRate", "BlackRate", "HispanicRate", "ChildRate", "ChildHHRate",
    "OtherLanguageRate", "LimitedEnglishRate", "AsthmaRegistryRate", "AsthmaAdmissionRate",
]
# --- end of fixed values ----------------------------------------------------


def diverging_shade(value: Column, mean: Column, low: Column, high: Column) -> Column:
    """Position between the mean and the nearer extreme, -1..1; NULL without a range."""
    above = missing.ratio(value - mean, high - mean)
    below = missing.ratio(value - mean, mean - low)
    return missing.if_else(value > mean, above, below)


def minmax_scale(value: Column, low: Column, high: Column, keep_raw: Column) -> Column:
    """Value in 0..1 between the extremes; measures that are rates already keep their value."""
    return F.when(keep_raw, value).otherwise(missing.ratio(value - low, high - low))


def label_offset(value: Column) -> Column:
    """Where a bar's label goes: inside long bars, above the others."""
    return missing.if_else(value > LABEL_LIMIT, value - LABEL_BELOW, value + LABEL_ABOVE)


def tier(value: Column) -> Column:
    """Five tiers; a missing value falls to the lowest."""
    out = None
    for name, floor in TIER_FLOORS.items():
        out = F.when(value >= floor, name) if out is None else out.when(value >= floor, name)
    return out.otherwise("Lowest")


def tier_rank(tier_name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier_name).cast("int")


def rate_benchmarks(
    wide: DataFrame,
    measures: Sequence[str],
    denominator: str | Mapping[str, str],
    own: Column,
    strict: bool = True,
    members: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Mean, Min and Max of each Rate* in one aggregation, one row per measure.

    ``denominator`` is one for all measures or names one for each. The mean is the metro rate over the rows marked ``own`` (whole
    municipalities), so neighbourhoods are not counted twice; the extremes are
    over all rows. ``members`` restricts a measure to rows of its own; other measures keep theirs in the same aggregation.
    """
    denominators = {m: denominator if isinstance(denominator, str) else denominator[m] for m in measures}
    of = {m: (members or {}).get(m, F.lit(True)) for m in measures}

    def extreme(agg, m: str) -> Column:
        rate = F.when(of[m], F.col(f"Rate{m}"))
        return F.when(F.count(rate) == F.count(F.when(of[m], F.lit(1))), agg(rate)) if strict else agg(rate)

    one = wide.agg(
        F.array(
            *[
                F.struct(
                    F.lit(m).alias("name"),
                    missing.ratio(
                        missing.sum_strict_where(own & of[m], f"Total{m}"), missing.sum_strict_where(own & of[m], denominators[m])
                    ).alias("Mean"),
                    extreme(F.min, m).alias("Min"),
                    extreme(F.max, m).alias("Max"),
                )
                for m in measures
            ]
        ).alias("b")
    )
    return one.select(F.inline("b"))


def compare_rates(
    wide: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    denominator: str | Mapping[str, str],
    own: Column,
    strict: bool = True,
    members: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Long rates with metro mean, extremes, shade and label offset.

    A measure has a row for each area that is one of its ``members`` (all areas, if it names none).
    """
    bench = rate_benchmarks(wide, measures, denominator, own, strict, members)
    if members is None:
        long = wide.select(*keys, *[F.col(f"Rate{m}").alias(m) for m in measures]).unpivot(
            list(keys), list(measures), "name", "value"
        )
    else:
        cells = [
            F.struct(F.lit(m).alias("name"), F.col(f"Rate{m}").alias("value"), members.get(m, F.lit(True)).alias("member")) for m in measures
        ]
        long = wide.select(*keys, F.inline(F.array(*cells))).where("member").drop("member")
    joined = joins.null_safe_join(long, bench, ["name"])
    v = F.col("value")
    return joined.withColumns(
        {
            "Shade": diverging_shade(v, F.col("Mean"), F.col("Min"), F.col("Max")),
            "Textloc": label_offset(v),
        }
    )


def zscore_halfscale(values: DataFrame, weights: DataFrame, keys: Sequence[str], own: Column) -> DataFrame:
    """z-score against the weighted mean, scaled so that min = 0, mean = .5, max = 1.

    ``values`` has the keys and ``value``; ``weights`` the keys and ``estimate``
    (one row per area). The extremes of the z-score follow from those of the
    value, so one aggregation over the table is enough.
    """
    marked = joins.null_safe_join(values, weights.select(*keys, "estimate"), list(keys)).where(own)
    mean = marked.agg(
        missing.ratio(missing.sum_strict(F.col("value") * F.col("estimate")), missing.sum_strict("estimate")).alias("Mean")
    )
    spread = values.agg(
        missing.min_strict("value").alias("Min"),
        missing.max_strict("value").alias("Max"),
        missing.stddev_strict("value").alias("SD"),
    )
    return _half_scaled(joins.attach_scalar(joins.attach_scalar(values, mean), spread))


def zscore_by(values: DataFrame, weights: DataFrame, keys: Sequence[str], name: str, own: Column) -> DataFrame:
    """The same for several measures at once: ``values`` and ``weights`` carry the measure in the column ``name``.

    One aggregation gives mean, extremes and spread of every measure.
    """
    weighed = joins.null_safe_join(values, weights.select(*keys, name, F.col("estimate").alias("__w"), F.lit(True).alias("__has")), [*keys, name], "left")
    counts = F.coalesce(F.col("__has"), F.lit(False)) & own
    bench = weighed.groupBy(name).agg(
        missing.ratio(missing.sum_strict_where(counts, F.col("value") * F.col("__w")), missing.sum_strict_where(counts, "__w")).alias("Mean"),
        missing.min_strict("value").alias("Min"),
        missing.max_strict("value").alias("Max"),
        missing.stddev_strict("value").alias("SD"),
    )
    return _half_scaled(joins.null_safe_join(values, bench, [name]))


def _half_scaled(out: DataFrame) -> DataFrame:
    """z-score, scale and label offset of rows with value, Mean, Min, Max and SD."""
    out = out.withColumn("ZScore", missing.ratio(F.col("value") - F.col("Mean"), "SD"))
    up = missing.ratio(F.col("ZScore"), missing.ratio(F.col("Max") - F.col("Mean"), "SD"))
    down = missing.ratio(F.col("ZScore"), missing.ratio(F.col("Min") - F.col("Mean"), "SD"))
    out = out.withColumn("Scale", missing.if_else(F.col("ZScore") > 0, (up + 1) / 2, (1 - down) / 2))
    return out.withColumn("Textloc", label_offset(F.col("Scale")))


def direction_shade(scale: Column, high_is_good: Column) -> Column:
    """Shade of a scale: kept where high is good, reversed where low is good."""
    return F.when(high_is_good, scale).otherwise(1 - scale)


def level_and_label(df: DataFrame, label: str = "All") -> DataFrame:
    """Level of a row, and its display label, from which keys are closed."""
    hood, muni, county = (F.col(c) != label for c in ("Neighborhood", "Municipality", "County"))
    return df.withColumns(
        {
            "Level": F.when(hood, "Neighborhood").when(muni, "Municipality").when(county, "County").otherwise(label),
            "Label": F.when(hood, F.col("Neighborhood")).when(muni, F.col("Municipality")).otherwise(F.col("County")),
        }
    )


# How a benchmark row's level is used: level of the compared rows -> level of the mean
PAIRING_METRO_LABELLED_COUNTY = {"Neighborhood": "Municipality", "Municipality": "All", "County": "All"}
PAIRING_METRO_LABELLED_ALL = {"Neighborhood": "Municipality", "Municipality": "All", "County": "All", "All": "All"}


def level_benchmarks(
    wide: DataFrame, measures: Sequence[str], city: str, pairing: Mapping[str, str], label: str = "All"
) -> DataFrame:
    """Mean, Minimum and Maximum per compared level and measure.

    The extremes are those of the level's own rows; the mean is the value of the
    row that ``pairing`` names: the metro row ("All") or the whole-city row
    ("Municipality").
    """
    long = wide.select("Level", "County", "Municipality", "Neighborhood", *measures).unpivot(
        ["Level", "County", "Municipality", "Neighborhood"], list(measures), "variable", "value"
    )
    extremes = long.groupBy("Level", "variable").agg(F.min("value").alias("Minimum"), F.max("value").alias("Maximum"))
    whole_city = (F.col("Municipality") == city) & (F.col("Neighborhood") == label)
    means = long.where((F.col("County") == label) | whole_city)
    # levels of compared rows served by each mean row
    served = F.when(
        F.col("Level") == "Municipality",
        F.array(*[F.lit(k) for k, v in pairing.items() if v == "Municipality"]),
    ).otherwise(F.array(*[F.lit(k) for k, v in pairing.items() if v == label]))
    paired = means.select(F.explode(served).alias("Level"), "variable", F.col("value").alias("Mean"))
    return joins.null_safe_join(paired, extremes, ["Level", "variable"])


def compare_levels(rows: DataFrame, bench: DataFrame) -> DataFrame:
    """Long rows of several levels against their level's benchmarks."""
    joined = joins.null_safe_join(rows, bench, ["Level", "variable"])
    v = F.col("value")
    scale = minmax_scale(v, F.col("Minimum"), F.col("Maximum"), F.col("variable").isin(RAW_SCALE_RATES))
    return joined.withColumns(
        {
            "Shade": diverging_shade(v, F.col("Mean"), F.col("Minimum"), F.col("Maximum")),
            "Scale": scale,
            "Textloc": label_offset(scale),
        }
    )


def copy_enclaves(rows: DataFrame, enclaves: Sequence[str]) -> DataFrame:
    """Enclosed municipalities repeated as neighbourhood rows."""
    return rows.where(F.col("Municipality").isin(list(enclaves))).withColumns(
        {"Level": F.lit("Neighborhood"), "Neighborhood": F.col("Municipality")}
    )


def shade_limits(rows: DataFrame, low_rows: Column, high_rows: Column | None = None) -> DataFrame:
    """Smallest and largest shade; the two ends may use different subsets."""
    high_rows = low_rows if high_rows is None else high_rows
    return rows.agg(
        F.min(F.when(low_rows, F.col("Shade"))).alias("low"),
        F.max(F.when(high_rows, F.col("Shade"))).alias("high"),
    )


def pad_missing_measures(
    rows: DataFrame, area_keys: Sequence[str], measures: Sequence[str], name: str = "name"
) -> DataFrame:
    """Every area gets every measure; absent ones come with NULL values."""
    grid = rows.select(*area_keys).distinct().withColumn(
        name, F.explode(F.array(*[F.lit(m) for m in measures]))
    )
    return joins.null_safe_join(grid, rows, [*area_keys, name], "left")
