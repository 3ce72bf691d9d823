"""Survey rows of all geographies, summed once.

Every total, share, index and benchmark starts from sums per source area and variable. One aggregation over the long survey table
makes them for all geographies; its columns can be merged (part by part, year by year), and :func:`rows` gives back, for
one geography, at most three rows per area and variable that no later sum, strict or not, can tell from
the survey's own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["geography", "GEOID", "variable"]
#: Column of the statistics and how two of them merge.
MERGED = {"n": F.sum, "known": F.sum, "positive": F.sum, "rest": F.sum, "top": F.max}


def collect(survey: DataFrame, keys: Sequence[str] = tuple(KEYS)) -> DataFrame:
    """Per geography, area and variable: rows ``n``, ``known`` estimates, sum of the ``positive`` ones and of the ``rest``, largest one (``top``).

    Other ``keys`` collect by source area first, for :func:`regroup`.
    """
    value = F.col("estimate")
    return survey.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("known"),
        F.sum(F.when(value > 0, value)).alias("positive"), F.sum(F.when(value <= 0, value)).alias("rest"), F.max(value).alias("top"),
    )


def merge(*parts: DataFrame) -> DataFrame:
    """Statistics of several parts of a survey as those of the whole."""
    return regroup(reduce(DataFrame.unionByName, parts))


def regroup(statistics: DataFrame) -> DataFrame:
    """Statistics of source areas, each listed for every area it counts in, as those of the areas."""
    return statistics.groupBy(*KEYS).agg(*[how(c).alias(c) for c, how in MERGED.items()])


def rows(statistics: DataFrame, geography: str) -> DataFrame:
    """``GEOID``, ``variable`` and ``estimate``: the positive sum, the other sum, and a missing value if there was one, each if any.

    Further columns of the statistics stay.
    """
    own = statistics.where(F.col("geography") == geography)
    kept = [c for c in own.columns if c != "geography" and c not in MERGED]
    sums = F.filter(F.array("positive", "rest"), lambda x: x.isNotNull())
    missing = F.when(F.col("known") < F.col("n"), F.array(F.lit(None).cast("double"))).otherwise(F.array().cast("array<double>"))
    return own.select(*kept, F.explode(F.concat(sums, missing)).alias("estimate"))


def one_each(statistics: DataFrame, geography: str, largest: str) -> DataFrame:
    """One row per area and variable: the sum of the known estimates, of the variable ``largest`` the largest one."""
    own = statistics.where(F.col("geography") == geography)
    kept = [c for c in own.columns if c != "geography" and c not in MERGED]
    total = F.when(F.col("known") > 0, F.coalesce("positive", F.lit(0.0)) + F.coalesce("rest", F.lit(0.0)))
    return own.select(*kept, F.when(F.col("variable") == largest, F.col("top")).otherwise(total).alias("estimate"))
