"""Survey statistics, and how often queries read their sources over all jobs."""

import random

import pytest
from compare import rows
from pyspark.sql import functions as F

from areaspark.functions import missing
from areaspark.plans import statistics
from areaspark.queries import load

FOLDER = "/root/testdata/sf0.001"


def scans(spark, run, table):
    """Scans of a table in the plans of everything that ``run`` executes."""
    store = spark._jsparkSession.sharedState().statusStore()

    def executions():
        found = store.executionsList()
        return {found.apply(k).executionId() for k in range(found.size())}

    before = executions()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    n = 0
    for key in executions() - before:
        nodes = store.planGraph(key).allNodes()
        for k in range(nodes.size()):
            node = nodes.apply(k)
            n += node.name().startswith("Scan parquet") and f"/{table}.parquet" in node.desc()
    return n


@pytest.mark.parametrize("key,most", [("indicator_comparison", 1), ("rates_wide_2021", 1), ("bench_level_pairing", 1), ("dataset_final", 4)])
def test_scans_over_all_jobs(spark, key, most):
    """The survey is read once; the final dataset also reads encounters, diagnoses and accounts, which lineitem stands for as well."""
    run = lambda: load.queries()[key](spark, FOLDER).write.format("noop").mode("overwrite").save()
    assert scans(spark, run, "lineitem") == most


def survey(spark, seed):
    rng = random.Random(seed)
    cells = [(g, f"a{rng.randint(0, 3)}", f"v{rng.randint(0, 2)}", rng.choice([None, 0.0, -2.0, 1.0, 5.0, 2.5])) for g in ("tract", "place") for _ in range(80)]
    return spark.createDataFrame(cells, "geography string, GEOID string, variable string, estimate double")


def aggs():
    return [
        missing.sum_strict("estimate"), F.sum("estimate"), missing.sum_strict_where(F.col("estimate") > 0, "estimate"), F.sum(F.when(F.col("estimate") > 0, F.col("estimate"))),
        F.max(F.col("estimate").isNull()),
    ]


def test_rows_of_statistics_sum_like_the_survey(spark):
    df = survey(spark, 3)
    found = statistics.collect(df)
    for geography in ("tract", "place", "county"):
        own = df.where(F.col("geography") == geography)
        again = statistics.rows(found, geography)
        assert again.columns == ["GEOID", "variable", "estimate"]
        for keys in (["GEOID", "variable"], ["variable"], []):
            assert rows(again.groupBy(*keys).agg(*aggs())) == rows(own.groupBy(*keys).agg(*aggs()))
        one = rows(statistics.one_each(found, geography, "v1").where("variable = 'v1'"))
        assert one == rows(own.where("variable = 'v1'").groupBy("GEOID", "variable").agg(F.max("estimate")))
        two = rows(statistics.one_each(found, geography, "v1").where("variable = 'v0'"))
        assert two == rows(own.where("variable = 'v0'").groupBy("GEOID", "variable").agg(F.sum("estimate")))


def test_statistics_merge(spark):
    parts = [survey(spark, k) for k in (1, 2, 5)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    merged = statistics.merge(*[statistics.collect(p) for p in parts])
    order = merged.columns
    assert rows(merged) == rows(statistics.collect(whole).select(order))
