"""Patient and encounter cohorts, condition flags, and their totals per area."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaspark.functions import dates, missing, text
from areaspark.operators import joins, reshape

AREA = ["County", "Municipality", "Neighborhood"]
ADDRESS = ["add_line_1", "add_line_2", "city", "state", "zip"]

# --- fixed values -----------------------------------------------------------
STATES = ["Ohio", "Kentucky", "Indiana"]
UNUSABLE_FLAGS = ["foster", "rmh", "pobox", "own_site", "stjoe", "unknown_address", "foreign_address"]
HOSPITAL_LINE = "%222 E%"
ASTHMA_CODES = [
    "J45.21", "J45.22", "J45.31", "J45.32", "J45.41", "J45.42", "J45.51", "J45.52", "J45.901", "J45.902",
]
DIABETES_CODES = [
    "E08.10", "E10.10", "E10.11", "E10.65", "E10.9", "E11.10", "E11.649", "E11.65", "E11.69", "E11.9",
    "E13.10", "E13.65", "E15", "E16.1", "E16.2", "R73.01", "R73.02", "R73.03", "R73.09",
]
MENTAL_HEALTH_DEPARTMENTS = [
    20026290, 10401085, 10401086, 10401087, 10401088, 10401089, 10401090, 10401091, 10401092, 10401093, 10401094,
]
MENTAL_HEALTH_PREFIXES = ["F", "R45"]
EXCEPTION_CODES = ["E94.9", "E84.8", "E84.19", "E84.0", "E84.11", "Z93.0", "Z99.11", "Z99.1"]
EXCEPTION_PREFIXES = ["J96.1", "J96.2", "Q20.", "Q24.", "Q25.", "Q89.3"]
SICKLE_CELL_PREFIX, SICKLE_CELL_TRAIT = "D57.", "D57.3"
CONDITIONS = ["Asthma", "Diabetes", "MH"]
# --- end of fixed values ----------------------------------------------------


def usable_address(flags: Sequence[str] = tuple(UNUSABLE_FLAGS)) -> Column:
    """All exclusion flags known and not set (a missing flag excludes, as in SQL)."""
    return reduce(lambda a, b: a & b, [F.col(f) != 1 for f in flags])


def with_geocode(df: DataFrame, cache: DataFrame) -> DataFrame:
    """Coordinates and flags of the row's address; five parts match, NULL equals NULL.

    Rows without a cached address drop out. The cache has one row per address.
    """
    return joins.null_safe_join(df, cache, ADDRESS)


def registry_rows(
    config: DataFrame,
    membership: DataFrame,
    record: DataFrame,
    patient: DataFrame,
    cache: DataFrame,
    registries: Column,
    as_of: dt.date | str | None = None,
    max_age: float | None = 18,
    inclusive: bool = True,
    divisor: float = dates.DAYS_PER_YEAR,
    flags: Sequence[str] = tuple(UNUSABLE_FLAGS),
) -> DataFrame:
    """Active members of the wanted registries at a usable address, up to an age; equal rows stay."""
    wanted = config.where(registries).select("registry_id", "registry_name")
    active = membership.where("status_c = 1").select("registry_id", "record_id").distinct()
    # reduce to one row per registry and patient before any patient data is moved
    members = joins.null_safe_join(active, wanted, ["registry_id"])
    enrolled = (
        joins.null_safe_join(members, record.select("record_id", "networked_id"), ["record_id"])
        .select("registry_id", "registry_name", F.col("networked_id").alias("pat_id"))
        .distinct()
    )
    people = patient.where(~F.col("add_line_1").like(HOSPITAL_LINE)).withColumn(
        "birth_date", F.col("birth_date").cast("date")
    )
    if max_age is not None:
        age = dates.age_years("birth_date", as_of, divisor)
        people = people.where(age <= max_age if inclusive else age < max_age)
    usable = cache.where(usable_address(flags) & F.col("state").isin(STATES)).select(*ADDRESS, "X", "Y")
    return joins.null_safe_join(enrolled, with_geocode(people, usable), ["pat_id"])


def registry_cohort(*args, **kwargs) -> DataFrame:
    """The rows of :func:`registry_rows`, each once."""
    return registry_rows(*args, **kwargs).distinct()


def admission_rows(
    encounter: DataFrame,
    history: DataFrame,
    cache: DataFrame,
    first: str,
    last: str,
    flags: Sequence[str] = tuple(UNUSABLE_FLAGS),
) -> DataFrame:
    """Encounters of a time window with the address valid at admission; equal rows stay.

    ``history`` names its address parts as the cache does. Whoever needs few columns takes them before rows are made
    unique, so that the address doesn't travel with every encounter.
    """
    # locate the addresses first: fewer rows than encounters, and unusable ones drop early
    usable = cache.where(usable_address(flags)).select(*ADDRESS, "X", "Y")
    there = with_geocode(history.where(F.col("state").isin(STATES)), usable)
    joined = joins.join_valid_time(
        encounter, there, ["pat_id"], "hosp_admsn_time", "eff_start_date", "eff_end_date", first, last
    )
    return joined.withColumn("contact_date", F.col("hosp_admsn_time").cast("date")).drop(
        "hosp_admsn_time", "eff_start_date", "eff_end_date"
    )


def admission_cohort(*args, **kwargs) -> DataFrame:
    """The rows of :func:`admission_rows`, each once."""
    return admission_rows(*args, **kwargs).distinct()


def exception_encounters(account_dx: DataFrame, dx_code: DataFrame, account_encounter: DataFrame) -> DataFrame:
    """Encounters whose account carries a diagnosis that rules the asthma flag out."""
    excluded = text.listed_or_starts("code", EXCEPTION_CODES, [SICKLE_CELL_PREFIX, *EXCEPTION_PREFIXES], SICKLE_CELL_TRAIT)
    ids = dx_code.where(excluded).select("dx_id").distinct()
    accounts = joins.null_safe_join(account_dx.select("hsp_account_id", "dx_id"), ids, ["dx_id"], "left_semi").select(
        "hsp_account_id"
    ).distinct()
    return joins.null_safe_join(
        account_encounter.select("hsp_account_id", "pat_enc_csn_id"), accounts, ["hsp_account_id"], "left_semi"
    ).select("pat_enc_csn_id").distinct()


def flag_conditions(encounters: DataFrame, exceptions: DataFrame, strict: bool = False) -> DataFrame:
    """0/1 flags Asthma, Diabetes and MH of each encounter.

    A missing diagnosis outside the listed departments leaves MH unknown:
    ``strict`` keeps it NULL, otherwise it counts as 0.
    """
    dx = F.col("disch_icd_1")
    prefixed = reduce(lambda a, b: a | b, [dx.startswith(p) for p in MENTAL_HEALTH_PREFIXES])
    mental = missing.is_in("department_id", MENTAL_HEALTH_DEPARTMENTS) | prefixed
    if not strict:
        mental = F.coalesce(mental, F.lit(False))
    flagged = joins.flag_exists(encounters, exceptions, ["pat_enc_csn_id"], "AsthmaException")
    return flagged.withColumns(
        {
            "Asthma": (missing.is_in(dx, ASTHMA_CODES) & (F.col("AsthmaException") == 0)).cast("int"),
            "Diabetes": missing.is_in(dx, DIABETES_CODES).cast("int"),
            "MH": mental.cast("int"),
        }
    )


def mental_known() -> Column:
    """The MH flag with unknown counted as 0."""
    return F.coalesce("MH", F.lit(0))


def known_points(cache: DataFrame, located: DataFrame) -> DataFrame:
    """Cached addresses at located points: no other row can be placed later, so the others need not be joined."""
    return joins.null_safe_join(cache.where("X is not null and Y is not null"), located.select("X", "Y"), ["X", "Y"], "left_semi")


def at_located_points(rows: DataFrame, located: DataFrame) -> DataFrame:
    """Bring the areas of located points back to the rows with the same X and Y.

    A ``county`` text of the row's own gives way to the located County.
    """
    rows = rows.drop("county")
    return joins.null_safe_join(rows.where("X is not null and Y is not null"), located, ["X", "Y"])


def admission_totals(
    rows: DataFrame,
    period: Column,
    conditions: Sequence[str] = tuple(CONDITIONS),
    periods: int | None = None,
    strict: bool = False,
) -> DataFrame:
    """Yearly mean of admissions and of distinct patients per area and condition.

    ``rows`` has the area keys, pat_id, pat_enc_csn_id and the flags. The mean is
    over the periods in which the area has rows; ``periods`` fixes the divisor.
    Distinct patients are counted in two plain aggregations (per patient, then
    per area), so no row is expanded once per distinct count.
    """
    once = rows.select(*AREA, period.alias("Period"), "pat_id", "pat_enc_csn_id", *conditions).distinct()
    per_patient = once.groupBy(*AREA, "Period", "pat_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"n_{c}") for c in conditions],
        *[F.max(F.col(c).isNull()).alias(f"u_{c}") for c in conditions],
    )
    cols = []
    for c in conditions:
        known, some = F.coalesce(F.sum(f"n_{c}"), F.lit(0)), F.count(F.when(F.col(f"n_{c}") > 0, F.lit(1)))
        if strict:
            unknown = F.max(f"u_{c}")
            known = F.when(unknown, F.lit(0)).otherwise(known)
            some = some + F.when(unknown, F.lit(1)).otherwise(F.lit(0))
        cols += [known.alias(f"{c}_Admits"), some.alias(f"{c}_Admitted")]
    per_period = per_patient.groupBy(*AREA, "Period").agg(
        *cols, F.sum("n").alias("Total_Admits"), F.count(F.lit(1)).alias("Total_Admitted")
    )
    names = [f"{c}_{m}" for c in [*conditions, "Total"] for m in ("Admits", "Admitted")]
    mean = F.avg if periods is None else (lambda c: F.sum(c) / F.lit(float(periods)))
    return per_period.groupBy(*AREA).agg(*[mean(n).alias(n) for n in names])


def registry_totals(rows: DataFrame, diseases: Sequence[str]) -> DataFrame:
    """Distinct registry patients per area and disease, absent = 0.

    The disease is the second of the three words of the registry name.
    """
    words = F.split("registry_name", " ", -1)
    disease = F.when(
        F.size(words) != 3, F.raise_error(F.concat(F.lit("registry name is not three words: "), F.col("registry_name")))
    ).otherwise(text.title_case(F.get(words, F.lit(1))))
    once = rows.select("pat_id", "registry_name", *AREA).distinct().withColumn("Disease", disease)
    return once.groupBy(*AREA).agg(
        *[F.count(F.when(F.col("Disease") == d, F.lit(1))).alias(f"{d}_Registry") for d in diseases]
    )


def merge_hospital(admissions: DataFrame, registry: DataFrame) -> DataFrame:
    """Both totals per area; an absent total is 0."""
    out = joins.null_safe_join(admissions, registry, AREA, "full")
    measures = [c for c in out.columns if c not in AREA]
    return out.withColumns({m: F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in measures})


def with_city_total(hospital: DataFrame, city: str) -> DataFrame:
    measures = [c for c in hospital.columns if c not in AREA]
    return reshape.append_subtotal(
        hospital, F.col("Municipality") == city, {"Neighborhood": city}, AREA, measures
    )


def rates_per_hundred(hospital: DataFrame, children: DataFrame) -> DataFrame:
    """Long rates per 100 children by condition and measure."""
    measures = [c for c in hospital.columns if c not in AREA]
    joined = joins.null_safe_join(hospital, children, AREA)
    long = joined.unpivot([*AREA, "Children"], measures, "name", "value")
    # the measure is the last word: a condition may hold underscores
    parts = {"Measure": F.substring_index("name", "_", -1), "Condition": F.regexp_replace("name", "_[^_]*$", "")}
    return long.select(
        *AREA,
        "Children",
        parts["Condition"].alias("Condition"),
        parts["Measure"].alias("Measure"),
        "value",
        missing.ratio(F.col("value") * 100, "Children").alias("Rate"),
    )


def compare_hospital(rates: DataFrame, children: DataFrame) -> DataFrame:
    """Metro mean, extremes, spread and z-score shade per condition and measure."""
    own = F.col("Municipality") == F.col("Neighborhood")
    base = children.where(own).agg(missing.sum_strict("Children").alias("MetroChildren"))
    bench = joins.attach_scalar(
        rates.groupBy("Condition", "Measure").agg(
            F.min("Rate").alias("Min"),
            F.max("Rate").alias("Max"),
            F.stddev_samp("Rate").alias("SD"),
            missing.sum_strict_where(own, "value").alias("MetroValue"),
        ),
        base,
    ).select(
        "Condition", "Measure", "Min", "Max", "SD",
        missing.ratio(F.col("MetroValue") * 100, "MetroChildren").alias("Mean"),
    )
    joined = joins.null_safe_join(rates, bench, ["Condition", "Measure"])
    return joined.withColumn("Shade", missing.ratio(F.col("Rate") - F.col("Mean"), "SD"))


def earlier_area_totals(patients: DataFrame, census: DataFrame, label: str = "All") -> DataFrame:
    """Registry and admission sums with "All" roll-ups, on every area of the census side.

    ``patients`` has State, the area keys, Registry and Admission (0/1 per row).
    """
    keys = ["State", "County", "Municipality", "Neighborhood"]
    sums = patients.groupBy(*keys).agg(
        F.sum("Registry").alias("AsthmaRegistry"), F.sum("Admission").alias("AsthmaAdmissions")
    )
    measures = ["AsthmaRegistry", "AsthmaAdmissions"]
    rolled = reshape.rollup_labelled(sums, keys, measures, label)
    # rows without a neighbourhood count in their place's total only; states are no level
    levels = rolled.where(F.col("Neighborhood").isNotNull()).where(
        (F.col("County") != label) | (F.col("State") == label)
    )
    joined = joins.null_safe_join(levels, census, keys, "right")
    return joined.withColumns(
        {
            **{m: F.coalesce(F.col(m), F.lit(0)) for m in measures},
            "AsthmaRegistryRate": F.coalesce(missing.ratio(F.coalesce("AsthmaRegistry", F.lit(0)), "Children"), F.lit(0.0)),
            "AsthmaAdmissionRate": F.coalesce(missing.ratio(F.coalesce("AsthmaAdmissions", F.lit(0)), "Children"), F.lit(0.0)),
        }
    )
